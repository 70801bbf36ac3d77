"""Linguistic and structural matching after Madhavan, Bernstein and Rahm (VLDB 2001).

Names are cut into word tokens. Two tokens are similar if equal, if the thesaurus relates
them, or by their common prefix or suffix. The linguistic similarity of two columns is
the mean of the best token similarities in both directions. Leaves start with the
compatibility of their types as structural similarity; the share of leaves with a strong
link raises or lowers that of the whole pair. Only pairs that reach the acceptance
threshold are returned.

The threshold implies a least linguistic similarity, and that a number of tokens of both columns
that may lack a similar one. So columns meet only where one of a few of their rarest tokens, taken
from both sides, has a similar one in the other; frequent words bring no columns together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_COLUMNS, dtype_family
from schemaweft.functions.names import word_tokens
from schemaweft.operators.ranking import ranked
from schemaweft.session import merged, settle


@dataclass(frozen=True)
class CupidParameters:
    """Thresholds and weights; ``th_accept`` 0.7 is the default of the matched results."""

    th_accept: float = 0.7
    th_token: float = 0.7
    th_high: float = 0.6
    th_low: float = 0.35
    c_inc: float = 1.2
    c_dec: float = 0.9
    w_struct: float = 0.2
    min_affix: int = 3

    @property
    def least_lsim(self) -> float:
        """Linguistic similarity below which no pair can be accepted."""
        best_ssim = min(1.0, SAME_TYPE * self.c_inc)
        return (self.th_accept - self.w_struct * best_ssim) / (1 - self.w_struct)


# Initial structural similarity of two leaf types, at most 0.5.
SAME_TYPE = 0.5
OTHER_TYPES = 0.1
RELATED_TYPES = {
    ("integer", "real"): 0.4,
    ("bool", "integer"): 0.3,
    ("text", "time"): 0.2,
    ("integer", "text"): 0.2,
    ("real", "text"): 0.2,
}


def type_compatibility(a: Column, b: Column) -> Column:
    out = F.when(a == b, F.lit(SAME_TYPE))
    for (x, y), value in RELATED_TYPES.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(value))
    return out.otherwise(F.lit(OTHER_TYPES))


def _affix_keys(vocabulary: DataFrame, token: str, longer: bool, p: CupidParameters) -> DataFrame:
    """Tokens under the prefixes and suffixes by which a similar token can be found.

    A common affix of at least ``th_token`` of the longer token covers that share of it,
    so the longer token is listed under one prefix and one suffix; a shorter one under
    those of every length that could be asked for.
    """
    length = F.length("token")
    least = F.greatest(F.ceil(length * p.th_token - 1e-9).cast("int"), F.lit(p.min_affix))
    lengths = F.array(least) if longer else F.sequence(least, length)
    return (
        vocabulary.filter(length >= least)
        .withColumn("n", F.explode(lengths))
        .select(
            F.col("token").alias(token),
            F.explode(
                F.array(
                    F.concat(F.lit("p"), F.expr("left(token, n)")),
                    F.concat(F.lit("s"), F.expr("right(token, n)")),
                )
            ).alias("affix"),
        )
    )


def _common(a: str, b: str, side: str) -> Column:
    """Length of the common prefix ('left') or suffix ('right') of two columns."""
    upto = F.least(F.length(a), F.length(b))
    return F.expr(
        f"aggregate(sequence(1, least(length({a}), length({b}))), 0, "
        f"(n, i) -> if({side}({a}, i) = {side}({b}, i), i, n))"
    ) * F.when(upto > 0, 1).otherwise(0)


def token_similarity(
    src_tokens: DataFrame, tgt_tokens: DataFrame, thesaurus: DataFrame | None, p: CupidParameters
) -> DataFrame:
    """t1, t2, sim for source and target tokens at or above the token threshold.

    Both inputs have a column ``token``. ``thesaurus`` has term, synonym and weight and
    is read in both directions.
    """
    one, two = src_tokens.select("token").distinct(), tgt_tokens.select("token").distinct()
    parts = [one.join(two, "token").select(F.col("token").alias("t1"), F.col("token").alias("t2"), F.lit(1.0).alias("sim"))]
    if thesaurus is not None:
        both = thesaurus.select(F.lower("term").alias("t1"), F.lower("synonym").alias("t2"), F.col("weight").cast("double").alias("sim"))
        both = both.unionByName(both.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "sim"))
        parts.append(
            both.join(one.withColumnRenamed("token", "t1"), "t1", "left_semi").join(
                two.withColumnRenamed("token", "t2"), "t2", "left_semi"
            ).select("t1", "t2", "sim")
        )
    for longer in (True, False):
        met = _affix_keys(one, "t1", longer, p).join(_affix_keys(two, "t2", not longer, p), "affix")
        affix = F.greatest(_common("t1", "t2", "left"), _common("t1", "t2", "right"))
        parts.append(
            met.filter(F.col("t1") != F.col("t2"))
            .select("t1", "t2")
            .distinct()
            .withColumn("sim", affix / F.greatest(F.length("t1"), F.length("t2")))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("t1", "t2").agg(F.max("sim").alias("sim")).filter(F.col("sim") >= p.th_token)


def _edges(src_tokens: DataFrame, tgt_tokens: DataFrame, similar: DataFrame) -> DataFrame:
    """pair_id, t1, t2, sim, f1, f2: similar tokens that a pair holds, with the columns that hold them."""
    one = src_tokens.groupBy("pair_id", F.col("token").alias("t1")).agg(F.count("*").alias("f1"))
    two = tgt_tokens.groupBy("pair_id", F.col("token").alias("t2")).agg(F.count("*").alias("f2"))
    return one.join(merged(similar), "t1").join(merged(two), ["pair_id", "t2"])


def _links(tokens: DataFrame, edges: DataFrame, own: str, other: str) -> DataFrame:
    """Per column the best similarity of its tokens with each token of the other side."""
    similar = edges.select("pair_id", F.col(own).alias("token"), other, "sim")
    return (
        tokens.select("pair_id", "ord", "token")
        .join(merged(similar), ["pair_id", "token"])
        .groupBy("pair_id", "ord", other)
        .agg(F.max("sim").alias("sim"))
        .groupBy("pair_id", "ord")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("t"), "sim"))).alias("links"))
    )


def _rare_tokens(tokens: DataFrame, edges: DataFrame, own: str, fan_out: str) -> DataFrame:
    """pair_id, ord, n, m, rare: the number of a column's tokens, and the ``m`` of them with a similar
    token on the other side, those first that the fewest columns there answer."""
    answered = edges.groupBy("pair_id", F.col(own).alias("token")).agg(F.sum(fan_out).alias("h"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "token"))))
    return (
        tokens.select("pair_id", "ord", "token")
        .join(merged(answered), ["pair_id", "token"], "left")
        .groupBy("pair_id", "ord")
        .agg(F.count("*").alias("n"), F.count("h").alias("m"), F.transform(ordered, lambda x: x.token).alias("rare"))
    )


def _looked_up(src: tuple[Column, Column], tgt: tuple[Column, Column], p: CupidParameters) -> tuple[Column, Column]:
    """How many of their rarest tokens a source and a target are met at, from both sides' (n, m).

    An accepted pair leaves at most the share ``1 - least_lsim`` of all tokens of both columns without
    a similar one. Tokens that none in the pair answers are known to be among them; of any other
    ``spare + 1`` at least one has a partner.
    """
    (n_src, m_src), (n_tgt, m_tgt) = src, tgt
    spare = F.floor((n_src + n_tgt) * (1 - p.least_lsim + 1e-9) + 1e-9) - (n_src - m_src) - (n_tgt - m_tgt)
    # A column that has an unanswered token has often lost its rarest one, so the other side is looked up.
    first = F.when(m_src == n_src, F.lit(1)).otherwise(F.lit(0))
    of_src = F.when(spare < 0, 0).when(spare == 0, first).otherwise(F.ceil((spare + 1) / 2)).cast("int")
    return of_src, F.when(spare < 0, 0).otherwise(spare + 1 - of_src).cast("int")


def _met(
    own: DataFrame, other: DataFrame, edges: DataFrame, other_tokens: DataFrame, upto: Callable, own_token: str, other_token: str, cell: int
) -> DataFrame:
    """(pair_id, ord, other_ord) of columns that meet at one of the first tokens of ``own``.

    A token is looked up among the columns of each number of tokens for which it is asked at all.
    Those that many ask for or many hold are cut into cells of at most ``cell`` columns a side.
    """
    kinds = other.groupBy("pair_id").agg(F.collect_set(F.struct(F.col("n").alias("n2"), F.col("m").alias("m2"))).alias("kinds"))
    key = ["pair_id", "token", "n2", "m2"]
    asked = settle(
        own.join(merged(kinds), "pair_id")
        .select("pair_id", "ord", "n", "m", "rare", F.explode("kinds").alias("kind"))
        .withColumn("upto", upto((F.col("n"), F.col("m")), (F.col("kind.n2"), F.col("kind.m2"))))
        .filter(F.col("upto") > 0)
        .select("pair_id", "ord", "kind.*", F.explode(F.slice("rare", F.lit(1), F.col("upto"))).alias(own_token))
        .join(merged(edges.select("pair_id", "t1", "t2")), ["pair_id", own_token])
        .select("pair_id", F.col(other_token).alias("token"), "n2", "m2", "ord")
    )
    held = other_tokens.select("pair_id", "ord", "token").join(
        merged(other.select("pair_id", "ord", F.col("n").alias("n2"), F.col("m").alias("m2"))), ["pair_id", "ord"]
    )
    asking = asked.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("int").alias("n_rows"))
    holding = held.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("int").alias("n_cols"))
    cells = settle(asking.join(merged(holding), key))

    def dealt(column: str, own_part: str, own_parts: str, each: str, parts: str) -> tuple[Column, ...]:
        part = F.pmod(F.xxhash64(column), F.col(own_parts)).cast("int").alias(own_part)
        return (*map(F.col, key), F.col(column), part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias(each))

    left = asked.join(merged(cells), key).select(*dealt("ord", "grid_row", "n_rows", "grid_col", "n_cols"))
    right = held.withColumnRenamed("ord", "other_ord").join(merged(cells), key).select(
        *dealt("other_ord", "grid_col", "n_cols", "grid_row", "n_rows")
    )
    return left.join(merged(right), [*key, "grid_row", "grid_col"]).select("pair_id", "ord", "other_ord")


def meetings(src_tokens: DataFrame, tgt_tokens: DataFrame, edges: DataFrame, p: CupidParameters, cell: int) -> DataFrame:
    """pair_id, src_ord, tgt_ord of the columns to compare; all that reach the least similarity are among them."""
    src, tgt = settle(_rare_tokens(src_tokens, edges, "t1", "f2")), settle(_rare_tokens(tgt_tokens, edges, "t2", "f1"))
    by_src = _met(src, tgt, edges, tgt_tokens, lambda s, t: _looked_up(s, t, p)[0], "t1", "t2", cell)
    by_tgt = _met(tgt, src, edges, src_tokens, lambda t, s: _looked_up(s, t, p)[1], "t2", "t1", cell)
    return (
        by_src.withColumnsRenamed({"ord": "src_ord", "other_ord": "tgt_ord"})
        .unionByName(by_tgt.withColumnsRenamed({"ord": "tgt_ord", "other_ord": "src_ord"}))
        .distinct()
    )


def _gain(links: str, tokens: str) -> Column:
    """Sum of the link similarities of the listed tokens."""
    return F.expr(
        f"aggregate({links}, 0D, (s, l) -> s + if(array_contains({tokens}, l.t), l.sim, 0D))"
    )


def linguistic_candidates(
    catalog: DataFrame, thesaurus: DataFrame | None, p: CupidParameters, cell: int
) -> DataFrame:
    """All pairs at or above the least linguistic similarity, with ``lsim`` and types."""
    words = settle(
        catalog.select(
            "pair_id",
            "side",
            F.col("ordinal").cast("bigint").alias("ord"),
            "name",
            dtype_family(F.col("dtype")).alias("family"),
            word_tokens(F.col("name")).alias("tokens"),
        )
    )
    single = words.select("pair_id", "side", "ord", F.explode("tokens").alias("token"))
    src_tokens = single.filter(F.col("side") == "source")
    tgt_tokens = single.filter(F.col("side") == "target")
    similar = settle(token_similarity(src_tokens, tgt_tokens, thesaurus, p))
    edges = settle(_edges(src_tokens, tgt_tokens, similar))
    met = meetings(src_tokens, tgt_tokens, edges, p, cell)

    def described(side: str, links: DataFrame, prefix: str, name: str) -> DataFrame:
        own = words.filter(F.col("side") == side).join(merged(links), ["pair_id", "ord"])
        return own.select(
            "pair_id",
            F.col("ord").alias(f"{prefix}_ord"),
            F.col("name").alias(name),
            F.col("family").alias(f"{prefix}_family"),
            F.col("tokens").alias(f"{prefix}_tokens"),
            F.col("links").alias(f"{prefix}_links"),
        )

    met = met.join(merged(described("source", _links(src_tokens, edges, "t1", "t2"), "src", "src")), ["pair_id", "src_ord"])
    met = met.join(merged(described("target", _links(tgt_tokens, edges, "t2", "t1"), "tgt", "tgt")), ["pair_id", "tgt_ord"])
    both = F.size("src_tokens") + F.size("tgt_tokens")
    lsim = (_gain("tgt_links", "src_tokens") + _gain("src_links", "tgt_tokens")) / both
    return (
        met.withColumn("lsim", lsim)
        .filter(F.col("lsim") >= p.least_lsim - 1e-9)
        .select("pair_id", "src", "src_ord", "src_family", "tgt", "tgt_ord", "tgt_family", "lsim")
    )


def cupid_match(
    catalog: DataFrame,
    k: int | None = None,
    thesaurus: DataFrame | None = None,
    parameters: CupidParameters | None = None,
    cell: int = 4096,
) -> DataFrame:
    """Accepted pairs per source, best first; sources without one abstain."""
    p = parameters or CupidParameters()
    if p.least_lsim <= 0:
        raise ValueError("th_accept is so low that pairs without any common word would pass")
    leaves = settle(
        linguistic_candidates(catalog, thesaurus, p, cell).withColumn(
            "ssim", type_compatibility(F.col("src_family"), F.col("tgt_family"))
        )
    )

    def weighted(ssim: Column) -> Column:
        return F.round(p.w_struct * ssim + (1 - p.w_struct) * F.col("lsim"), 9)

    strong = leaves.filter(weighted(F.col("ssim")) >= p.th_accept)
    sizes = catalog.groupBy("pair_id").agg(F.count("*").alias("n_leaves"))
    linked = (
        strong.select("pair_id", F.explode(F.array(
            F.struct(F.lit("s").alias("side"), F.col("src_ord").alias("ord")),
            F.struct(F.lit("t").alias("side"), F.col("tgt_ord").alias("ord")),
        )).alias("leaf"))
        .distinct()
        .groupBy("pair_id")
        .agg(F.count("*").alias("n_linked"))
    )
    share = F.coalesce("n_linked", F.lit(0)) / F.col("n_leaves")
    tables = sizes.join(linked, "pair_id", "left").select(
        "pair_id",
        F.when(share > p.th_high, p.c_inc).when(share < p.th_low, p.c_dec).otherwise(1.0).alias("factor"),
    )
    final = weighted(F.least(F.lit(1.0), F.col("ssim") * F.col("factor")))
    accepted = (
        leaves.join(tables, "pair_id")
        .withColumn("score", final)
        .filter(F.col("score") >= p.th_accept)
        .select(*PREDICTION_COLUMNS[:-1])
    )
    return ranked(accepted, k)
