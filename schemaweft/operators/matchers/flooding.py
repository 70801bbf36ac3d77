"""Similarity propagation after Melnik, Garcia-Molina and Rahm (ICDE 2002).

Each schema is a graph: the table has an edge ``column`` to every column, a column has an
edge ``name`` to its name and ``type`` to its type family. The pairwise connectivity
graph of two schemas then has one node per pair of columns and per pair of names: the
product of the two sides. It is never built.

All update rules are linear but for the division by the largest value. Two column pairs
with the same pair of types receive the same flow from the table and type nodes and
differ only by the initial similarity of their names. So after any number of rounds

    score(column pair) = alpha * initial name similarity + beta(source type, target type)

with one alpha per schema pair and one beta per pair of type families. The rounds run on
these few numbers, for all schema pairs in parallel, and are exactly those of the full
graph. Initial similarities are the trigram similarities of all name pairs. What the rounds
need of them is their sums, sums of squares and largest values per pair of families, which the
trigram matcher's cells add up; no list of pairs is made.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import dtype_family
from schemaweft.operators.matchers.trigram import FIRST, LEVEL, PROFILE_KEY, SUMS, trigram_profiles
from schemaweft.operators.ranking import first_targets
from schemaweft.session import merged, settle

# The fix-point function travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMULAS = ("basic", "a", "b", "c")
SOLVED_SCHEMA = (
    "pair_id string, src_family string, tgt_family string, n_src bigint, n_tgt bigint, "
    "alpha double, beta double, rounds int, residual double, converged boolean"
)


class Propagation:
    """State of the nodes of one schema pair, one entry per pair of type families.

    Column pairs and name pairs are ``slope * s + base`` in their initial similarity s.
    """

    def __init__(self, classes: pd.DataFrame):
        self.n = (classes["n_src"] * classes["n_tgt"]).to_numpy(dtype=float)
        self.s_sum = classes["s_sum"].to_numpy(dtype=float)
        self.s_squares = classes["s_squares"].to_numpy(dtype=float)
        self.s_max = classes["s_max"].to_numpy(dtype=float)
        same = (classes["src_family"] == classes["tgt_family"]).to_numpy(dtype=float)
        zero = np.zeros(len(classes))
        # slopes of columns and names; bases of columns, names and types; table
        self.initial = (0.0, 1.0, zero, zero, same, 0.0)

    def flow(self, x: tuple) -> tuple:
        """What the neighbours pass on; an edge's weight is one over the fan-out."""
        col_slope, name_slope, col, name, kind, table = x
        received = col_slope * self.s_sum + self.n * col
        return (
            name_slope,
            col_slope,
            name + table / self.n.sum() + kind / self.n,
            col,
            received,
            received.sum(),
        )

    def largest(self, x: tuple) -> float:
        col_slope, name_slope, col, name, kind, table = x
        return max(
            (col_slope * self.s_max + col).max(), (name_slope * self.s_max + name).max(), kind.max(), table
        )

    def distance(self, x: tuple, y: tuple) -> float:
        """Euclidean length of the difference over all nodes of the full graph."""
        d = tuple(a - b for a, b in zip(x, y))
        squares = (d[4] ** 2).sum() + d[5] ** 2
        for slope, base in ((d[0], d[2]), (d[1], d[3])):
            squares += (slope**2 * self.s_squares + 2 * slope * base * self.s_sum + self.n * base**2).sum()
        return float(np.sqrt(max(squares, 0.0)))

    def step(self, x: tuple, formula: str) -> tuple:
        def plus(*states: tuple) -> tuple:
            return tuple(sum(parts[1:], parts[0]) for parts in zip(*states))

        if formula == "basic":
            new = plus(x, self.flow(x))
        elif formula == "a":
            new = plus(self.initial, self.flow(x))
        elif formula == "b":
            new = self.flow(plus(self.initial, x))
        else:
            start = plus(self.initial, x)
            new = plus(start, self.flow(start))
        top = self.largest(new)
        return tuple(part / top for part in new) if top > 0 else new


#: A pair whose residual has found no new least value for so many rounds does not come to rest.
PATIENCE = 1000


def _solver(formula: str, max_rounds: int | None, epsilon: float):
    def solve(classes: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values(["src_family", "tgt_family"]).reset_index(drop=True)
        graph = Propagation(classes)
        state, rounds, residual = graph.initial, 0, float("inf")
        least, since = residual, 0
        while residual > epsilon and (since < PATIENCE if max_rounds is None else rounds < max_rounds):
            new = graph.step(state, formula)
            state, rounds, residual = new, rounds + 1, graph.distance(new, state)
            least, since = (residual, 0) if residual < least else (least, since + 1)
        return classes[["pair_id", "src_family", "tgt_family", "n_src", "n_tgt"]].assign(
            alpha=state[0], beta=state[2], rounds=rounds, residual=residual, converged=residual <= epsilon
        )

    return solve


def _families(catalog: DataFrame, side: str, prefix: str) -> DataFrame:
    return catalog.filter(F.col("side") == side).select(
        "pair_id",
        F.col("ordinal").cast("bigint").alias(f"{prefix}_ord"),
        F.col("name").alias(prefix),
        dtype_family(F.col("dtype")).alias(f"{prefix}_family"),
    )


class NotConverged(ValueError):
    """Some pairs did not come to rest, or not within the rounds allowed."""


class Flooding:
    """Solved propagation of a catalog: levels of similarity, first targets, the class table.

    ``k`` is the largest number of first targets that ``top_k`` can be asked for; without ``whole``, levels
    of similarity add to the sums but are not kept, so there is no ``shortlist``. ``seeds``
    (pair_id, src_ord, tgt_ord, score) replaces the trigram similarities. Wide pairs need many rounds
    (about the root of their number of column pairs), so by default these go on as long as they come
    closer to rest. With ``epsilon`` 0 exactly ``max_rounds`` rounds are run; otherwise pairs that do not
    come to rest, or not in ``max_rounds`` if given, are an error.
    """

    def __init__(
        self,
        catalog: DataFrame,
        seeds: DataFrame | None = None,
        k: int = 5,
        formula: str = "c",
        max_rounds: int | None = None,
        epsilon: float = 1e-6,
        whole: bool = True,
        **cells: int,
    ):
        if formula not in FORMULAS:
            raise ValueError(f"formula must be one of {FORMULAS}")
        if epsilon <= 0 and max_rounds is None:
            raise ValueError("without epsilon the number of rounds has to be given")
        self.k, self.whole = k, whole
        self.src = _families(catalog, "source", "src")
        self.tgt = _families(catalog, "target", "tgt")
        self.found = settle(trigram_profiles(catalog, k, with_levels=whole, **cells) if seeds is None else self._given(seeds))
        type_pair = ["pair_id", "src_family", "tgt_family"]
        sums = (
            self.found.select("pair_id", "src_family", F.inline("sums"))
            .groupBy("pair_id", "src_family", F.col("family").alias("tgt_family"))
            .agg(F.sum("s_sum").alias("s_sum"), F.sum("s_squares").alias("s_squares"), F.max("s_max").alias("s_max"))
        )
        n_src = self.src.groupBy("pair_id", "src_family").agg(F.count("*").alias("n_src"))
        n_tgt = self.tgt.groupBy("pair_id", "tgt_family").agg(F.count("*").alias("n_tgt"))
        # At most six families a side, so at most 36 rows per schema pair.
        classes = n_src.join(n_tgt, "pair_id").join(sums, type_pair, "left").fillna(0.0)
        self.classes = settle(
            classes.groupBy("pair_id").applyInPandas(_solver(formula, max_rounds, epsilon), SOLVED_SCHEMA)
        )
        restless = self.classes.filter(~F.col("converged")).select("pair_id").distinct().limit(5).collect() if epsilon > 0 else []
        if restless:
            limit = "as long as they came closer to rest" if max_rounds is None else f"after {max_rounds} rounds"
            raise NotConverged(f"{limit}, among others: {[r.pair_id for r in restless]}")

    def _given(self, seeds: DataFrame) -> DataFrame:
        """The rows of ``trigram_profiles`` for given similarities."""
        source = ["pair_id", "src_ord"]
        pairs = (
            seeds.filter(F.col("score") > 0)
            .select(*source, "tgt_ord", F.col("score").alias("s"))
            .join(self.tgt.withColumnRenamed("tgt_family", "family"), ["pair_id", "tgt_ord"])
        )
        levels = pairs.groupBy(*source, "family", "s").agg(F.count("*").alias("n"), F.min(F.struct("tgt_ord", "tgt")).alias("t"))
        sums = levels.groupBy(*source, "family").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("s_sum"), F.sum(F.col("n") * F.col("s") * F.col("s")).alias("s_squares"), F.max("s").alias("s_max")
        )
        first = first_targets(pairs, self.k, [*source, "family"], F.col("s").desc())
        lists = {
            "levels": (levels.select(*source, "family", "s", "n", "t.*"), LEVEL),
            "first": (first.select(*source, "family", "s", "tgt_ord", "tgt"), FIRST),
            "sums": (sums, SUMS),
        }
        out = self.src
        for name, (rows, kind) in lists.items():
            each = rows.groupBy(*source).agg(F.collect_list(F.struct(*[c.split()[0] for c in kind.split(", ")])).alias(name))
            out = out.join(merged(each), source, "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
        return out

    def _by_kind(self, *columns: str) -> DataFrame:
        """pair_id, src_family, kinds: by the family of the targets what was solved for it."""
        return self.classes.groupBy("pair_id", "src_family").agg(
            F.map_from_entries(F.collect_list(F.struct("tgt_family", F.struct(*columns)))).alias("kinds")
        )

    def shortlist(self) -> DataFrame:
        """The whole ranking of every source, with pairs of equal standing in one row.

        A row stands for the ``n_targets`` targets of a type family that have one similarity ``s``
        to the source, and so one score; ``tgt`` is the first of them by ordinal. The targets that
        share no trigram with it are in one row a family, without a name.
        """
        if not self.whole:
            raise ValueError("built without the whole ranking")

        type_pair = ["pair_id", "src_family", "tgt_family"]
        solved = self.classes.select(*type_pair, "alpha", "beta")
        listed = (
            self.found.select(*PROFILE_KEY, F.inline("levels"))
            .withColumnsRenamed({"family": "tgt_family", "n": "n_targets"})
            .join(solved, type_pair)
            .withColumn("score", F.col("alpha") * F.col("s") + F.col("beta"))
        )
        # A source of a wide pair has sums for each chunk.
        own = F.filter("sums", lambda part: part.family == F.col("tgt_family"))
        n_listed = F.aggregate(own, F.lit(0).cast("bigint"), lambda n, part: n + part.n)
        rest = (
            self.found.select(*PROFILE_KEY, "sums")
            .join(self.classes, ["pair_id", "src_family"])
            .withColumn("n_targets", F.col("n_tgt") - n_listed)
            .filter(F.col("n_targets") > 0)
        )
        columns = ["pair_id", "src", "src_ord", "tgt", "tgt_ord", "tgt_family", "s", "score", "n_targets"]
        return listed.select(*columns).unionByName(
            rest.select(
                "pair_id",
                "src",
                "src_ord",
                F.lit(None).cast("string").alias("tgt"),
                F.lit(None).cast("bigint").alias("tgt_ord"),
                "tgt_family",
                F.lit(0.0).alias("s"),
                F.col("beta").alias("score"),
                "n_targets",
            )
        )

    def top_k(self, k: int) -> DataFrame:
        """The first ``k`` of every source's ranking, ties by target ordinal.

        In a family of targets scores follow the similarity, so its first ``k`` are enough. Those
        without a similarity rank by type class and ordinal: the first ``k`` per source type will do.
        """
        if k > self.k:
            raise ValueError(f"built for the first {self.k} targets")
        heads = first_targets(self.tgt, k, ["pair_id", "tgt_family"])
        background = heads.join(
            self.classes.select("pair_id", "src_family", "tgt_family", F.col("beta").alias("score")),
            ["pair_id", "tgt_family"],
        )
        background = first_targets(background, k, ["pair_id", "src_family"], F.round("score", 9).desc())
        padding = background.groupBy("pair_id", "src_family").agg(
            F.collect_list(F.struct(F.negate(F.round("score", 9)).alias("by"), "tgt_ord", "tgt", "score")).alias("padding")
        )

        def scored(target: Column) -> Column:
            kind = F.element_at("kinds", target.family)
            score = kind.alpha * target.s + kind.beta
            return F.struct(F.negate(F.round(score, 9)).alias("by"), target.tgt_ord.alias("tgt_ord"), target.tgt.alias("tgt"), score.alias("score"))

        def unlisted(first: Column) -> Column:
            return F.filter("padding", lambda t: ~F.array_contains(first, F.struct(t.tgt_ord, t.tgt)))

        # Rows are ranked where they are: a source's candidates are in one. What was listed is bound once, not once per use.
        names = F.array(F.transform("first", lambda t: F.struct(t.tgt_ord, t.tgt)))
        best = F.slice(F.array_sort(F.concat(F.transform("first", scored), F.flatten(F.transform(names, unlisted)))), 1, k)
        return (
            self.found.select(*PROFILE_KEY, "first")
            .join(self._by_kind("alpha", "beta").join(padding, ["pair_id", "src_family"]), ["pair_id", "src_family"])
            .select("pair_id", "src", "src_ord", F.posexplode(best).alias("pos", "t"))
            .select("pair_id", "src", "src_ord", "t.tgt", "t.tgt_ord", "t.score", (F.col("pos") + 1).alias("rank"))
        )


def flooding_match(catalog: DataFrame, k: int = 5, **options) -> DataFrame:
    """First ``k`` targets per source; ``Flooding(...).shortlist()`` has the whole ranking."""
    return Flooding(catalog, k=k, whole=False, **options).top_k(k)
