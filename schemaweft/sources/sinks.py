"""Report, audit and summary files, one folder per matcher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_SCHEMA

HITS = f"{PREDICTION_SCHEMA}, kind string, matcher string"
AUDIT_COLUMNS = "pair_id string, name string, ordinal bigint, kind string"
AUDIT_TOTALS = (
    "n_dropped_source_columns bigint, n_junk_target_columns bigint, "
    "n_dropped_source_mappings bigint, n_junk_target_mappings bigint, f1 double, matcher string"
)


def write_report(report: DataFrame, ranks: DataFrame, root: str) -> None:
    """Metrics as JSON lines by matcher, and the rank list in its chunks beside them."""
    report.write.partitionBy("matcher").json(f"{root}/report")
    ranks.write.partitionBy("matcher").json(f"{root}/ranks")


def write_audit(hits: DataFrame, columns: DataFrame, totals: DataFrame, matchers: list[str], root: str) -> None:
    """Dropped-source and junk-target hits as JSON lines, in a folder for every matcher, also
    for one without hits; beside them the columns they were judged by (the same for all
    matchers, by kind) and one line of counts and F1 a matcher."""
    for matcher in matchers:
        hits.filter(F.col("matcher") == matcher).drop("matcher").write.json(f"{root}/audit/matcher={matcher}")
    columns.write.partitionBy("kind").json(f"{root}/audit_columns")
    totals.write.partitionBy("matcher").json(f"{root}/audit_totals")


def read_audit(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits, columns and totals as ``write_audit`` was given them."""
    return tuple(
        spark.read.schema(schema).json(f"{root}/{folder}")
        for folder, schema in (("audit", HITS), ("audit_columns", AUDIT_COLUMNS), ("audit_totals", AUDIT_TOTALS))
    )


def write_summary(summary: DataFrame, root: str) -> None:
    summary.write.json(f"{root}/summary")
