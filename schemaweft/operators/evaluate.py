"""Match quality: outcomes per source, counts, rank metrics, coverage curves.

Predictions may carry extra batch columns (``matcher``, ``seed``); they are named in
``by`` and every measure is computed for all of them in the same plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.catalog import sources
from schemaweft.session import merged

TRUTH_KEY = ["pair_id", "src"]
DEFAULT_THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(11))


def truth_sets(truth: DataFrame) -> DataFrame:
    """pair_id, src, sorted array of distinct valid targets."""
    return (
        truth.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull())
        .groupBy(*TRUTH_KEY)
        .agg(F.sort_array(F.collect_set("tgt")).alias("tgts"))
    )


def _labelled(all_src: DataFrame, labels: list[str], column: str) -> DataFrame:
    return all_src.withColumn(column, F.explode(F.array(*[F.lit(x) for x in labels])))


def outcomes(
    predictions: DataFrame, truth: DataFrame, all_src: DataFrame, matchers: list[str]
) -> DataFrame:
    """One row per (matcher, source column): tp, fp, fn or tn, and the first correct rank.

    A source without truth is fp if it has any candidate, else tn, and has no rank. A
    source with truth is tp if its first candidate is correct, else fn, also when the
    first candidate is wrong.

    ``all_src``: pair_id, src, src_ord. ``matchers`` lists the matchers to report, so
    one that predicted nothing still gets its rows. All three inputs are shuffled on
    (pair_id, src) and the aggregation reuses that partitioning.
    """
    expected = truth.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    judged = predictions.select("matcher", "pair_id", "src", "tgt", "score", "rank").join(
        merged(truth_sets(expected)), TRUTH_KEY, "left"
    ).withColumn("hit", F.coalesce(F.array_contains("tgts", F.col("tgt")), F.lit(False)))
    per_source = judged.groupBy("matcher", *TRUTH_KEY).agg(
        F.count("*").alias("n_cand"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 1, F.col("tgt"))).alias("top_tgt"),
        F.bool_or((F.col("rank") == 1) & F.col("hit")).alias("top_hit"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"),
    )
    has_truth = expected.groupBy(*TRUTH_KEY).agg(F.lit(True).alias("has_truth"))
    every = _labelled(all_src.select("pair_id", "src", "src_ord"), matchers, "matcher")
    joined = every.join(merged(has_truth), TRUTH_KEY, "left").join(merged(per_source), ["matcher", *TRUTH_KEY], "left")
    known = F.coalesce("has_truth", F.lit(False))
    any_candidate = F.coalesce("n_cand", F.lit(0)) > 0
    top_hit = F.coalesce("top_hit", F.lit(False))
    outcome = (
        F.when(~known & any_candidate, "fp").when(~known, "tn").when(top_hit, "tp").otherwise("fn")
    )
    return joined.select(
        "matcher",
        "pair_id",
        "src",
        "src_ord",
        outcome.alias("outcome"),
        F.when(known, F.col("rank")).alias("rank"),
        known.alias("has_truth"),
        F.coalesce("n_cand", F.lit(0)).cast("bigint").alias("n_cand"),
        "top_tgt",
        "top_score",
        top_hit.alias("top_hit"),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 where the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1, mrr and recall_at_3 to the counts of ``confusion``."""
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .withColumn("mrr", ratio(F.col("reciprocal_ranks"), F.col("n_ranked")))
        .withColumn("recall_at_3", ratio(F.col("hits_at_3"), F.col("n_ranked")))
        .drop("reciprocal_ranks", "n_ranked", "hits_at_3")
    )


def _count_columns() -> list[Column]:
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")]
    return [
        *counts,
        F.count_if("has_truth").alias("n_ranked"),
        F.coalesce(F.sum(F.lit(1.0) / F.col("rank")), F.lit(0.0)).alias("reciprocal_ranks"),
        F.count_if(F.col("rank") <= 3).alias("hits_at_3"),
    ]


def confusion(outcome_rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn per group, with the sums that the rank metrics need."""
    return outcome_rows.groupBy(*by).agg(*_count_columns())


def report(outcome_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro-averaged metrics over all pairs of every group."""
    return with_metrics(confusion(outcome_rows, by or ["matcher"]))


def report_with_pairs(outcome_rows: DataFrame) -> DataFrame:
    """One row per matcher over all pairs (pair_id NULL) and one per matcher and pair."""
    totals = (
        outcome_rows.rollup("matcher", "pair_id")
        .agg(*_count_columns(), F.grouping("matcher").alias("is_grand"))
        .filter(F.col("is_grand") == 0)
        .drop("is_grand")
    )
    return with_metrics(totals)


def rank_list(outcome_rows: DataFrame, chunk: int = 1000) -> DataFrame:
    """First-correct ranks in source order, NULL where none was correct.

    The list of a matcher grows with the catalog, so it is kept as consecutive chunks of
    at most ``chunk`` ordinals per pair: matcher, pair_id, chunk, ranks array<int>.
    """
    return (
        outcome_rows.filter("has_truth")
        .withColumn("chunk", F.floor(F.col("src_ord") / F.lit(chunk)).cast("bigint"))
        .groupBy("matcher", "pair_id", "chunk")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("src_ord", "rank"))), lambda x: x.rank
            ).alias("ranks")
        )
    )


def coverage_curve(
    outcome_rows: DataFrame,
    thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS,
    by: list[str] | None = None,
) -> DataFrame:
    """Coverage over all sources and precision of the covered ones, per threshold.

    One pass: every threshold is a pair of conditional counts and the rows are unfolded
    after the aggregation.
    """
    keys = by or ["matcher"]
    above = [F.col("top_score") >= F.lit(float(t)) for t in thresholds]
    measures = [F.count("*").alias("n_src")]
    for i, covered in enumerate(above):
        measures.append(F.count_if(covered).alias(f"covered_{i}"))
        measures.append(F.count_if(covered & F.col("top_hit")).alias(f"correct_{i}"))
    points = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"covered_{i}").alias("n_covered"),
                F.col(f"correct_{i}").alias("n_correct"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        outcome_rows.groupBy(*keys)
        .agg(*measures)
        .select(*keys, "n_src", F.inline(points))
        .select(
            *keys,
            "threshold",
            "n_covered",
            ratio(F.col("n_covered"), F.col("n_src")).alias("coverage"),
            ratio(F.col("n_correct"), F.col("n_covered")).alias("precision_at_coverage"),
        )
    )


def tagged(predictions: dict[str, DataFrame]) -> DataFrame:
    """Union of the predictions of several matchers with a ``matcher`` column."""
    parts = [df.withColumn("matcher", F.lit(name)) for name, df in predictions.items()]
    return reduce(DataFrame.unionByName, parts)


def all_sources(catalog: DataFrame) -> DataFrame:
    return sources(catalog)
