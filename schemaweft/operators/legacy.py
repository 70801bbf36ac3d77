"""Legacy-schema transforms on catalogs: rename, retype, split, merge, drop, add junk.

A schema state has one row per current column:

    pair_id, ordinal bigint, name, dtype,
    origins array<struct<src_ord bigint, src string, lead boolean>>

``origins`` is the column's lineage: empty for junk, two entries after a merge. ``lead``
marks the first current column of an original, the one that a later step on that
original acts on. Lineage travels inside the row, so composing steps needs no joins, and
all steps but the merge are projections over all pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import dtype_family
from schemaweft.functions import names
from schemaweft.functions.values import JUNK_COLUMNS, JUNK_DTYPES

# Original columns that the role-bound steps act on, and their new names.
SPLIT_ROLE, SPLIT_NAMES = "name", ("NAME1", "NAME2")
MERGE_ROLES, MERGED_NAME = ("address_line_1", "address_line_2"), "STRAS"
UNIT_ROLE = "amount"
DROP_ROLE = "status"

# The order of the standard ten-step corruption.
STANDARD_STEPS = (
    "case_flip",
    "drop_column",
    "split_field",
    "merge_fields",
    "unit_change",
    "date_format",
    "abbreviate",
    "strip_vowels",
    "table_prefix",
    "add_junk",
)

STATE_COLUMNS = ["pair_id", "ordinal", "name", "dtype", "origins"]
JUNK_ORDINAL = 1 << 40

Step = Callable[[DataFrame], DataFrame]


def initial_state(catalog: DataFrame) -> DataFrame:
    """Source side of a catalog; every column is its own origin."""
    return catalog.filter(F.col("side") == "source").select(
        "pair_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "name",
        "dtype",
        F.array(
            F.struct(
                F.col("ordinal").cast("bigint").alias("src_ord"),
                F.col("name").alias("src"),
                F.lit(True).alias("lead"),
            )
        ).alias("origins"),
    )


def leads(role: str) -> Column:
    """True for the first current column of the original column ``role``."""
    return F.exists("origins", lambda o: (o.src == role) & o.lead)


def rename(state: DataFrame, new_name: Column) -> DataFrame:
    return state.withColumn("name", new_name)


def abbreviate(state: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    return rename(state, names.abbreviate(F.col("name"), dictionary))


def strip_vowels(state: DataFrame) -> DataFrame:
    return rename(state, names.strip_vowels(F.col("name")))


def table_prefix(state: DataFrame, code: Column | str = names.DEFAULT_TABLE_CODE) -> DataFrame:
    """``code`` may be an expression over ``pair_id``."""
    return rename(state, names.table_prefix(F.col("name"), code))


def case_flip(state: DataFrame) -> DataFrame:
    return rename(state, names.case_flip(F.col("name")))


def date_format(state: DataFrame) -> DataFrame:
    is_date = dtype_family(F.col("dtype")) == "time"
    return state.withColumn("dtype", F.when(is_date, "int").otherwise(F.col("dtype")))


def unit_change(state: DataFrame, role: str = UNIT_ROLE) -> DataFrame:
    return state.withColumn("dtype", F.when(leads(role), "int").otherwise(F.col("dtype")))


def split_field(state: DataFrame, role: str = SPLIT_ROLE) -> DataFrame:
    """Two adjacent columns in place of one; both inherit its lineage, the first leads."""
    follower = F.transform(
        "origins", lambda o: F.struct(o.src_ord.alias("src_ord"), o.src.alias("src"), F.lit(False).alias("lead"))
    )
    halves = F.array(
        F.struct(
            F.lit(0).alias("at"),
            F.lit(SPLIT_NAMES[0]).alias("name"),
            F.lit("str").alias("dtype"),
            F.col("origins").alias("origins"),
        ),
        F.struct(
            F.lit(1).alias("at"),
            F.lit(SPLIT_NAMES[1]).alias("name"),
            F.lit("str").alias("dtype"),
            follower.alias("origins"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), "name", "dtype", "origins"))
    return state.select(
        "pair_id", "ordinal", F.explode(F.when(leads(role), halves).otherwise(whole)).alias("c")
    ).select(
        "pair_id",
        (F.col("ordinal") * 2 + F.col("c.at")).alias("ordinal"),
        "c.name",
        "c.dtype",
        "c.origins",
    )


def merge_fields(state: DataFrame, roles: tuple[str, str] = MERGE_ROLES) -> DataFrame:
    """One column at the place of the first line; the second goes, and adds its lineage.

    Without a second line in the pair nothing merges. Only the role columns of each pair are
    shuffled, into one row a pair. If the second line comes first in the schema it is merged and
    removed all the same.
    """
    first, second = leads(roles[0]), leads(roles[1])
    line = F.struct("ordinal", "name", "dtype", "origins", first.alias("first"))
    pairs = state.filter(first | second).groupBy("pair_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    firsts = F.filter("lines", lambda x: x["first"])
    added = F.flatten(F.transform(F.filter("lines", lambda x: ~x["first"]), lambda x: x["origins"]))
    merges = F.exists("lines", lambda x: x["first"]) & F.exists("lines", lambda x: ~x["first"])
    as_merged = F.transform(
        firsts,
        lambda x: F.struct(
            x["ordinal"].alias("ordinal"),
            F.lit(MERGED_NAME).alias("name"),
            F.lit("str").alias("dtype"),
            F.concat(x["origins"], added).alias("origins"),
            x["first"].alias("first"),
        ),
    )
    merged = pairs.select("pair_id", F.explode(F.when(merges, as_merged).otherwise(F.col("lines"))).alias("c")).select(
        "pair_id", "c.ordinal", "c.name", "c.dtype", "c.origins"
    )
    return state.filter(~(first | second)).unionByName(merged)


def drop_column(state: DataFrame, role: str = DROP_ROLE) -> DataFrame:
    """Drop the current column of an original; its lineage goes with it."""
    return state.filter(~leads(role))


def add_junk(state: DataFrame) -> DataFrame:
    """Append the junk columns to every pair, after all others, without any origin."""
    junk = F.array(
        *[
            F.struct(F.lit(JUNK_ORDINAL + i).alias("ordinal"), F.lit(n).alias("name"), F.lit(t).alias("dtype"))
            for i, (n, t) in enumerate(zip(JUNK_COLUMNS, JUNK_DTYPES))
        ]
    )
    rows = (
        state.select("pair_id")
        .distinct()
        .select("pair_id", F.inline(junk))
        .withColumn("origins", F.array().cast("array<struct<src_ord:bigint,src:string,lead:boolean>>"))
    )
    return state.unionByName(rows)


CATALOG_STEPS: dict[str, Step] = {
    "abbreviate": abbreviate,
    "strip_vowels": strip_vowels,
    "table_prefix": table_prefix,
    "date_format": date_format,
    "split_field": split_field,
    "merge_fields": merge_fields,
    "unit_change": unit_change,
    "case_flip": case_flip,
    "drop_column": drop_column,
    "add_junk": add_junk,
}


def check_steps(steps: Sequence[str]) -> None:
    """Unknown step names fail before anything runs."""
    unknown = [s for s in steps if s not in CATALOG_STEPS]
    if unknown:
        raise KeyError(f"unknown legacy steps: {unknown}")


def apply_steps(
    state: DataFrame, steps: Sequence[str] = STANDARD_STEPS, options: dict[str, dict] | None = None
) -> DataFrame:
    """Fold the named steps over a state; ``options`` holds keyword arguments per step."""
    check_steps(steps)
    for step in steps:
        state = CATALOG_STEPS[step](state, **(options or {}).get(step, {}))
    return state.select(*STATE_COLUMNS)


def lineage(state: DataFrame) -> DataFrame:
    """pair_id, src (NULL for junk), tgt: one row per origin of every current column."""
    return state.select("pair_id", F.col("name").alias("tgt"), F.explode_outer("origins").alias("o")).select(
        "pair_id", F.col("o.src").alias("src"), "tgt"
    )


def truth_of(state: DataFrame) -> DataFrame:
    return lineage(state).filter(F.col("src").isNotNull()).distinct()


def target_side(state: DataFrame) -> DataFrame:
    return state.select("pair_id", F.lit("target").alias("side"), "ordinal", "name", "dtype")


def legacy_pairs(source_catalog: DataFrame, state: DataFrame) -> DataFrame:
    """Catalog of the source side and the transformed target side."""
    own = source_catalog.filter(F.col("side") == "source").select(
        "pair_id", "side", F.col("ordinal").cast("bigint").alias("ordinal"), "name", "dtype"
    )
    return own.unionByName(target_side(state))


def duplicate_targets(state: DataFrame) -> DataFrame:
    """Target names that occur more than once in a pair."""
    return (
        state.groupBy("pair_id", "name").agg(F.count("*").alias("n_columns")).filter(F.col("n_columns") > 1)
    )
