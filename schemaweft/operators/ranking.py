"""Ranking of scored candidates per source column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_COLUMNS

SOURCE_KEY = ["pair_id", "src_ord"]


def ranked(scored: DataFrame, k: int | None = None, by: Column | None = None) -> DataFrame:
    """Order by score, best first, ties by target ordinal; keep the first ``k``.

    The row-number filter plans a group limit below the shuffle, so a source with very
    many candidates sends at most ``k`` rows per task.
    """
    score = F.col("score") if by is None else by
    order = Window.partitionBy(*SOURCE_KEY).orderBy(score.desc(), F.col("tgt_ord"))
    out = scored.withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select(*PREDICTION_COLUMNS)


def first_targets(tgt: DataFrame, k: int, keys: list[str], *before: Column) -> DataFrame:
    """The first ``k`` targets of every group by the given order, then by ordinal."""
    order = Window.partitionBy(*keys).orderBy(*before, F.col("tgt_ord"))
    return tgt.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def top_1(predictions: DataFrame) -> DataFrame:
    """First candidate of every source that has one."""
    return predictions.filter(F.col("rank") == 1)


def regroup(flat: DataFrame) -> DataFrame:
    """Candidate lists per source from flat scored pairs, best first."""
    return ranked(flat)
