"""The catalog model: schema columns as rows.

catalog      pair_id string, side 'source' | 'target', ordinal bigint, name string, dtype string
truth        pair_id string, src string, tgt string
predictions  pair_id string, src string, src_ord bigint, tgt string, tgt_ord bigint,
             score double, rank int

``ordinal`` only has to be a total order within a side; it need not be dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_SCHEMA = (
    "pair_id string, src string, src_ord bigint, tgt string, tgt_ord bigint, score double, rank int"
)
PREDICTION_COLUMNS = ["pair_id", "src", "src_ord", "tgt", "tgt_ord", "score", "rank"]

# Dtype spellings per family. Six families bound the number of type classes.
DTYPE_FAMILIES = {
    "integer": ["int", "integer", "bigint", "long", "smallint", "tinyint", "int64", "int32"],
    "real": ["float", "double", "decimal", "numeric", "float64", "float32"],
    "text": ["str", "string", "varchar", "char", "text", "object"],
    "time": ["datetime", "timestamp", "timestamp_ntz", "date"],
    "bool": ["bool", "boolean"],
}


def dtype_family(dtype):
    """integer, real, text, time, bool, or 'other' for anything else and NULL."""
    low = F.lower(dtype)
    family = F.when(low.startswith("decimal"), F.lit("real"))
    for name, spellings in DTYPE_FAMILIES.items():
        family = family.when(low.isin(spellings), F.lit(name))
    return family.otherwise(F.lit("other"))


def sources(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("side") == "source").select(
        "pair_id", F.col("name").alias("src"), F.col("ordinal").cast("bigint").alias("src_ord")
    )


def targets(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("side") == "target").select(
        "pair_id", F.col("name").alias("tgt"), F.col("ordinal").cast("bigint").alias("tgt_ord")
    )


def no_predictions(catalog: DataFrame) -> DataFrame:
    """The result of asking for zero candidates."""
    return catalog.sparkSession.createDataFrame([], PREDICTION_SCHEMA)
