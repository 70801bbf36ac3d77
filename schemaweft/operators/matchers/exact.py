"""Equal names and equal normalised names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_COLUMNS, sources, targets
from schemaweft.functions.names import normalized
from schemaweft.session import merged


def _match_on_key(catalog: DataFrame, key, k: int) -> DataFrame:
    """One candidate per source: the first target, by ordinal, with the same key."""
    src = sources(catalog).withColumn("key", key(F.col("src")))
    first = (
        targets(catalog)
        .groupBy("pair_id", key(F.col("tgt")).alias("key"))
        .agg(F.min(F.struct("tgt_ord", "tgt")).alias("first"))
    )
    return (
        src.join(merged(first), ["pair_id", "key"])
        .withColumns(
            {
                "tgt": F.col("first.tgt"),
                "tgt_ord": F.col("first.tgt_ord"),
                "score": F.lit(1.0),
                "rank": F.lit(1),
            }
        )
        .filter(F.lit(k > 0))
        .select(*PREDICTION_COLUMNS)
    )


def exact_match(catalog: DataFrame, k: int = 1) -> DataFrame:
    """Same string, case-sensitive; score 1.0, otherwise no candidate."""
    return _match_on_key(catalog, lambda name: name, k)


def normalized_match(catalog: DataFrame, k: int = 1) -> DataFrame:
    """Same lower-case name without underscores; the first target wins a collision."""
    return _match_on_key(catalog, normalized, k)
