"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, equal ranges of the key hold about
equally many documents, so (source, range) groups are bounded however large the source is.
Prefix sums of sizes run inside the ranges and over the ranges' totals, and each source is cut
at its exact budget: whole epochs first, then documents in key order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.llm.common import join_small, settle

MAX_EPOCHS = 3
ROWS_PER_RANGE = 20_000


def source_targets(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_docs -> the same with ``target``: a row per source.

    Sources in order of code points, NULL last, weigh ``cycle``, repeating. Targets share the
    total of all sizes by weight; none is above ``max_epochs`` times its source's size, and the
    excess goes to the others by weight. With sources in order of cap / weight, the level at
    which the rest is shared is the largest of (total - caps before) / (weights from here on).
    One window over one row per source; sources are as many as the mix has weights for.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place + 1).cast("int")).cast("long"))
    cap = (F.col("source_size") * max_epochs).cast("long")
    fills = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, everything = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(ahead), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    leveled = weighed.withColumn("level", left.cast("double") / weights.cast("double"))
    target = F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight"))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def random_key(id_column: str, seed: int):
    """60 hash-random bits of the id, as a non-negative bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    size_column: str = "size",
    cycle: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``copies`` (whole ones), ``cut`` (units of a
    further, partial one) and ``taken`` = copies * size + cut.

    The units taken of a source sum to its target, rounded. NULL sizes count as 0; NULL
    sources are one source; documents without an id share one key; rows equal in id and size
    may swap. An empty table gives an empty result. Names that begin with ``_mix_`` are taken.
    """
    size = F.coalesce(F.col(size_column), F.lit(0)).cast("long")
    keyed = docs.withColumns({"_mix_source": F.col(source_column), "_mix_size": size, "_mix_key": random_key(id_column, seed)})
    totals = keyed.groupBy(F.col("_mix_source").alias("source")).agg(
        F.sum("_mix_size").alias("source_size"), F.count("*").alias("n_docs")
    )
    targets = settle(source_targets(totals, cycle, max_epochs))
    aliased = targets.select(
        F.col("source").alias("_mix_name"),
        F.col("source_size").alias("_mix_total"),
        F.col("target").alias("_mix_target"),
        F.ceil(F.col("n_docs") / rows_per_range).cast("long").alias("_mix_ranges"),
    )
    aimed = join_small(keyed, aliased, F.col("_mix_source").eqNullSafe(F.col("_mix_name")), "inner")
    # The upper 40 of the 60 bits, scaled to the number of ranges.
    at = F.shiftright(F.shiftright("_mix_key", 20) * F.col("_mix_ranges"), 40)
    aimed = aimed.withColumn("_mix_range", at)
    sums = aimed.groupBy("_mix_name", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"))
    before = Window.partitionBy("_mix_name").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        sums.select(
            F.col("_mix_name").alias("_mix_n"), F.col("_mix_range").alias("_mix_r"), F.sum("_mix_sum").over(before).alias("_mix_before")
        ).filter(F.col("_mix_before").isNotNull())
    )
    inside = (
        Window.partitionBy("_mix_name", "_mix_range")
        .orderBy("_mix_key", F.col(id_column), "_mix_size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = aimed.withColumn("_mix_end", F.sum("_mix_size").over(inside))
    same = F.col("_mix_name").eqNullSafe(F.col("_mix_n")) & (F.col("_mix_range") == F.col("_mix_r"))
    placed = join_small(summed, starts, same)
    budget = F.round("_mix_target").cast("long")
    copies = F.when(F.col("_mix_total") > 0, F.floor(budget / F.col("_mix_total"))).otherwise(F.lit(0)).cast("long")
    start = F.coalesce("_mix_before", F.lit(0)) + F.col("_mix_end") - F.col("_mix_size")
    counted = placed.withColumns({"copies": copies, "_mix_start": start})
    rest = budget - F.col("copies") * F.col("_mix_total") - F.col("_mix_start")
    counted = counted.withColumn("cut", F.greatest(F.lit(0), F.least(rest, F.col("_mix_size"))).cast("long"))
    return counted.select(
        *docs.columns,
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        "copies",
        "cut",
        (F.col("copies") * F.col("_mix_size") + F.col("cut")).alias("taken"),
    )
