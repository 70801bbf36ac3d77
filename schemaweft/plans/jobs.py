"""Whole jobs: evaluate matchers on a catalog, audit them, probe their stability."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from schemaweft.catalog import sources
from schemaweft.operators import audit, evaluate, legacy, stability
from schemaweft.operators.matchers.cupid import cupid_match
from schemaweft.operators.matchers.exact import exact_match, normalized_match
from schemaweft.operators.matchers.flooding import flooding_match
from schemaweft.operators.matchers.sequence import sequence_match
from schemaweft.operators.matchers.trigram import trigram_match
from schemaweft.session import settle
from schemaweft.sources import pairs, sinks
from schemaweft.sources.generator import base_catalog

Matcher = Callable[[DataFrame], DataFrame]

MATCHERS: dict[str, Matcher] = {
    "exact_match": exact_match,
    "normalized_match": normalized_match,
    "jaccard_trigram_match": trigram_match,
    "levenshtein_ratio_match": sequence_match,
    "cupid_match": cupid_match,
    "similarity_flooding_match": flooding_match,
}
NAME_MATCHERS = ("exact_match", "normalized_match", "jaccard_trigram_match", "levenshtein_ratio_match")


@dataclass(frozen=True)
class Evaluation:
    """Predictions of the chosen matchers and what is measured on them."""

    matchers: list[str]
    predictions: DataFrame
    outcomes: DataFrame

    def report(self) -> DataFrame:
        return evaluate.report(self.outcomes)

    def ranks(self) -> DataFrame:
        return evaluate.rank_list(self.outcomes)


def run_eval(
    catalog: DataFrame, truth: DataFrame, matchers: dict[str, Matcher], all_src: DataFrame | None = None
) -> Evaluation:
    """Every matcher once over all pairs; predictions are kept for reports and audits.

    ``all_src`` (pair_id, src, src_ord) replaces the source columns of the catalog as the
    list of columns to judge.
    """
    predictions = settle(evaluate.tagged({name: match(catalog) for name, match in matchers.items()}))
    names = list(matchers)
    rows = evaluate.outcomes(predictions, truth, sources(catalog) if all_src is None else all_src, names)
    return Evaluation(names, predictions, rows)


def write_audit(run: Evaluation, catalog: DataFrame, lineage: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write the audit of a run: hits, column lists and totals; returns hits and report."""
    hits = settle(audit.audit_hits(run.predictions, catalog, lineage))
    columns = settle(audit.audited_columns(catalog, lineage))
    report = settle(run.report())
    sinks.write_audit(hits, columns, audit.totals(hits, columns, report, run.matchers), run.matchers, root)
    return hits, report


def audit_job(catalog: DataFrame, lineage: DataFrame, matchers: dict[str, Matcher], root: str) -> DataFrame:
    """Evaluate, write reports, rank lists, audits and the summary; returns the summary."""
    run = run_eval(catalog, lineage, matchers)
    run = replace(run, outcomes=settle(run.outcomes))
    audit.check_prediction_shape(run.predictions)
    hits, report = write_audit(run, catalog, lineage, root)
    sinks.write_report(report, run.ranks(), root)
    result = settle(audit.summary(hits, run.matchers))
    sinks.write_summary(result, root)
    return result


def synthetic_audit(pair_ids: DataFrame, root: str, matchers: tuple[str, ...] = NAME_MATCHERS) -> DataFrame:
    """Corrupt the base schema by the standard steps for every pair id and audit matchers."""
    catalog = base_catalog(pair_ids)
    state = legacy.apply_steps(legacy.initial_state(catalog))
    lineage = settle(legacy.lineage(state))
    both = settle(legacy.legacy_pairs(catalog, state))
    return audit_job(both, lineage, {m: MATCHERS[m] for m in matchers}, root)


def benchmark_audit(
    spark: SparkSession,
    data_root: str,
    dataset: str,
    scenario: str,
    noise_level: str | None,
    root: str,
    matchers: tuple[str, ...] = tuple(MATCHERS),
) -> DataFrame:
    """The same audit over all benchmark pairs on disk."""
    catalog = settle(pairs.read_catalog(spark, data_root, dataset, scenario, noise_level))
    truth = settle(pairs.read_truth(spark, data_root, dataset, scenario, noise_level))
    return audit_job(catalog, truth, {m: MATCHERS[m] for m in matchers}, root)


def shuffle_probe(
    catalog: DataFrame, truth: DataFrame, matcher: Matcher, seeds: tuple[int, ...] = stability.DEFAULT_SEEDS
) -> DataFrame:
    """Sources that lose their correct first candidate when target columns are reordered."""
    original = matcher(catalog)
    moved = stability.by_seed(matcher(stability.shuffled(catalog, seeds)))
    return stability.lost_top_1(original, moved, truth)
