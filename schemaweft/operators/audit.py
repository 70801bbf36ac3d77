"""Audits: predictions on sources without a target and on targets without a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_SCHEMA, sources, targets
from schemaweft.session import merged

HIT_COLUMNS = ["matcher", "pair_id", "src", "src_ord", "tgt", "tgt_ord", "score", "rank"]


def flatten(nested: DataFrame) -> DataFrame:
    """(src, tgt, score) rows from one row per source with ``candidates``, best first.

    ``candidates``: array<struct<tgt, score>>; all other columns are kept.
    """
    kept = [c for c in nested.columns if c != "candidates"]
    return nested.select(*kept, F.posexplode("candidates").alias("pos", "c")).select(
        *kept, "c.tgt", "c.score", (F.col("pos") + 1).alias("rank")
    )


def nest(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per source with its candidate list, best first."""
    keys = keys or ["pair_id", "src"]
    ordered = F.array_sort(F.collect_list(F.struct("rank", "tgt", "score")))
    return predictions.groupBy(*keys).agg(
        F.transform(ordered, lambda c: F.struct(c.tgt.alias("tgt"), c.score.alias("score"))).alias("candidates")
    )


def _real(lineage: DataFrame) -> DataFrame:
    return lineage.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull())


def dropped_sources(catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """pair_id, src, src_ord of source columns without any target."""
    return sources(catalog).join(merged(_real(lineage)), ["pair_id", "src"], "left_anti")


def junk_targets(catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """pair_id, tgt, tgt_ord of target columns without any source."""
    return targets(catalog).join(merged(_real(lineage)), ["pair_id", "tgt"], "left_anti")


def dropped_hits(predictions: DataFrame, dropped: DataFrame) -> DataFrame:
    """Predictions of any rank whose source has no target."""
    return predictions.join(merged(dropped.select("pair_id", "src")), ["pair_id", "src"], "left_semi").select(*HIT_COLUMNS)


def junk_hits(predictions: DataFrame, junk: DataFrame) -> DataFrame:
    """Predictions of any rank whose target has no source."""
    return predictions.join(merged(junk.select("pair_id", "tgt")), ["pair_id", "tgt"], "left_semi").select(*HIT_COLUMNS)


def audit_hits(predictions: DataFrame, catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """Both kinds of hits with a ``kind`` column, 'dropped' or 'junk'."""
    dropped = dropped_hits(predictions, dropped_sources(catalog, lineage))
    junk = junk_hits(predictions, junk_targets(catalog, lineage))
    return dropped.withColumn("kind", F.lit("dropped")).unionByName(junk.withColumn("kind", F.lit("junk")))


def audited_columns(catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """pair_id, name, ordinal, kind: the dropped source columns and the junk target columns."""
    dropped = dropped_sources(catalog, lineage).select("pair_id", F.col("src").alias("name"), F.col("src_ord").alias("ordinal"))
    junk = junk_targets(catalog, lineage).select("pair_id", F.col("tgt").alias("name"), F.col("tgt_ord").alias("ordinal"))
    return dropped.withColumn("kind", F.lit("dropped")).unionByName(junk.withColumn("kind", F.lit("junk")))


def totals(hits: DataFrame, columns: DataFrame, report: DataFrame, matchers: list[str]) -> DataFrame:
    """One row a matcher: both column counts, both hit counts and the F1 of ``report``."""
    listed = columns.groupBy().agg(
        F.count_if(F.col("kind") == "dropped").alias("n_dropped_source_columns"),
        F.count_if(F.col("kind") == "junk").alias("n_junk_target_columns"),
    )
    each = listed.withColumn("matcher", F.explode(F.array(*[F.lit(m) for m in matchers])))
    counts = summary(hits, matchers).drop("report", "audit")
    return each.join(counts, "matcher").join(report.select("matcher", "f1"), "matcher", "left")


def summary(hits: DataFrame, matchers: list[str]) -> DataFrame:
    """Per matcher its report and audit paths and both hit counts, zeros included."""
    spark = hits.sparkSession
    names = spark.createDataFrame([(m,) for m in matchers], "matcher string")
    counts = hits.groupBy("matcher").agg(
        F.count_if(F.col("kind") == "dropped").alias("n_dropped"),
        F.count_if(F.col("kind") == "junk").alias("n_junk"),
    )
    return names.join(counts, "matcher", "left").select(
        "matcher",
        F.concat(F.lit("report/matcher="), "matcher").alias("report"),
        F.concat(F.lit("audit/matcher="), "matcher").alias("audit"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped_source_mappings"),
        F.coalesce("n_junk", F.lit(0)).alias("n_junk_target_mappings"),
    )


# Checks: each returns the violating rows with pair_id and a text column ``violation``.


def sentinel_mismatch(catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """Junk targets by lineage against the targets listed with a NULL source."""
    derived = junk_targets(catalog, lineage).select("pair_id", "tgt").distinct()
    listed = lineage.filter(F.col("src").isNull()).select("pair_id", "tgt").distinct()
    return (
        derived.exceptAll(listed)
        .withColumn("violation", F.lit("junk target without sentinel"))
        .unionByName(listed.exceptAll(derived).withColumn("violation", F.lit("sentinel that is no junk target")))
        .select("pair_id", F.col("tgt").alias("name"), "violation")
    )


def truth_violations(truth: DataFrame) -> DataFrame:
    """Sources whose target set is empty or holds a NULL."""
    per_source = truth.groupBy("pair_id", "src").agg(
        F.count("tgt").alias("n_tgt"), F.count_if(F.col("tgt").isNull()).alias("n_null")
    )
    reason = F.when(F.col("n_tgt") == 0, "empty target set").when(F.col("n_null") > 0, "NULL target")
    return (
        per_source.withColumn("violation", reason)
        .filter(F.col("violation").isNotNull() & F.col("src").isNotNull())
        .select("pair_id", F.col("src").alias("name"), "violation")
    )


def check_prediction_shape(predictions: DataFrame) -> None:
    """Columns and types of a matcher's result; raises on a difference."""
    expected = dict(part.split() for part in PREDICTION_SCHEMA.split(", "))
    found = dict(predictions.dtypes)
    wrong = {c: found.get(c) for c, t in expected.items() if found.get(c) != t}
    if wrong:
        raise TypeError(f"predictions differ from '{PREDICTION_SCHEMA}' in {wrong}")


def prediction_violations(predictions: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Candidates with NULL names, scores outside [0, 1] or ranks that are not 1..n."""
    keys = [*(batch or []), "pair_id", "src_ord"]
    score = F.col("score")
    per_row = F.when(F.col("tgt").isNull() | F.col("src").isNull(), "NULL name").when(
        score.isNull() | (score < 0) | (score > 1), "score outside [0, 1]"
    )
    rows = predictions.withColumn("violation", per_row).filter(F.col("violation").isNotNull()).select(
        "pair_id", F.col("src").alias("name"), "violation"
    )
    ranks = (
        predictions.groupBy(*keys)
        .agg(F.max("src").alias("name"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.count("*").alias("n"))
        .filter((F.col("first") != 1) | (F.col("last") != F.col("n")))
        .select("pair_id", "name", F.lit("ranks are not 1..n").alias("violation"))
    )
    return rows.unionByName(ranks)


def coverage_violations(catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """Source and target columns outside the truth, for pairs that must be fully covered."""
    return (
        dropped_sources(catalog, lineage)
        .select("pair_id", F.col("src").alias("name"), F.lit("source without target").alias("violation"))
        .unionByName(
            junk_targets(catalog, lineage).select(
                "pair_id", F.col("tgt").alias("name"), F.lit("target without source").alias("violation")
            )
        )
    )


def violation_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violation, n; one row with n = 0 for a check without violations."""
    out = None
    for name, rows in checks.items():
        counted = rows.groupBy("violation").agg(F.count("*").alias("n"))
        known = rows.sparkSession.createDataFrame([(name,)], "check string")
        part = known.join(counted.withColumn("check", F.lit(name)), "check", "left").select(
            "check", F.coalesce("violation", F.lit("none")).alias("violation"), F.coalesce("n", F.lit(0)).alias("n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def candidate_profile(predictions: DataFrame, all_src: DataFrame, matchers: list[str]) -> DataFrame:
    """matcher, pair_id, src, n_candidates for every source, zero included."""
    every = all_src.select("pair_id", "src").withColumn("matcher", F.explode(F.array(*[F.lit(m) for m in matchers])))
    counts = predictions.groupBy("matcher", "pair_id", "src").agg(F.count("*").alias("n"))
    return every.join(merged(counts), ["matcher", "pair_id", "src"], "left").select(
        "matcher", "pair_id", "src", F.coalesce("n", F.lit(0)).alias("n_candidates")
    )


def zero_candidate_sources(predictions: DataFrame, all_src: DataFrame) -> DataFrame:
    """Sources that a single matcher abstained on."""
    return all_src.select("pair_id", "src").join(predictions, ["pair_id", "src"], "left_anti")
