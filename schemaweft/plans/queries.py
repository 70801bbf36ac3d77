"""Registered queries: every operator over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.catalog import sources
from schemaweft.functions import names, values
from schemaweft.operators import audit, evaluate, legacy, migrate, stability
from schemaweft.operators.matchers.cupid import cupid_match
from schemaweft.operators.matchers.exact import exact_match, normalized_match
from schemaweft.operators.matchers.flooding import Flooding, flooding_match
from schemaweft.operators.matchers.sequence import sequence_match
from schemaweft.operators.matchers.trigram import trigram_match
from schemaweft.plans import jobs
from schemaweft.plans import workload as w
from schemaweft.session import merged, settle, shared_folder
from schemaweft.sources import pairs, sinks
from schemaweft.sources.generator import base_table

MATCHERS_3 = {"exact": exact_match, "normalized": normalized_match, "trigram": trigram_match}
MATCHERS_4 = {**MATCHERS_3, "sequence": sequence_match}
MATCHERS_6 = {**MATCHERS_4, "cupid": cupid_match, "flooding": flooding_match}


class Documents:
    """The document catalog with its lineage; derived once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.columns = settle(w.document_columns(spark, sf_dir))
        self.catalog = w.document_catalog(self.columns)
        self.truth = w.document_truth(self.columns)
        self.lineage = w.document_lineage(self.columns)

    def evaluated(self, matchers: dict | None = None) -> jobs.Evaluation:
        return jobs.run_eval(settle(self.catalog), self.truth, matchers or MATCHERS_3)

    def matched(self, matcher, **options) -> DataFrame:
        return matcher(settle(self.catalog), **options)


def _predictions(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "pair_id", "src", "src_ord", "tgt", "tgt_ord", F.round("score", 6).alias("score"), "rank")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and generators


def base_table_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = w.table(spark, sf_dir, "orders").select("o_orderkey")
    rows = base_table(keys, "o_orderkey")
    return rows.withColumn("created_at", F.col("created_at").cast("date").cast("string"))


def catalog_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    mapped = evaluate.truth_sets(d.truth).groupBy("pair_id").agg(
        F.count("*").alias("n_mapped"), F.sum(F.size("tgts")).alias("n_matches")
    )
    return pairs.pair_metadata(d.catalog).join(mapped, "pair_id")


class BenchmarkFiles:
    """The document pairs as benchmark files: pairs of an even name length at noise level ev, others ec."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        d, self.root = Documents(spark, sf_dir), shared_folder(spark)
        level = F.when(F.length("pair_id") % 2 == 0, "_ev").otherwise("_ec")
        named = [df.withColumn("pair_id", F.concat("pair_id", level)) for df in (d.catalog, d.truth)]
        pairs.write_pairs(*named, self.root, *BENCHMARK)


BENCHMARK = ("documents", "by_source")


def benchmark_pair_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one noise level, listed and read by the readers of benchmark files."""
    where = (BenchmarkFiles(spark, sf_dir).root, *BENCHMARK, "ev")
    catalog, truth = settle(pairs.read_catalog(spark, *where)), pairs.read_truth(spark, *where)
    types = catalog.groupBy("pair_id").agg(
        *[F.count_if(F.col("dtype") == t).alias(f"n_{t}") for t in ("int", "float", "str")],
        F.sum(F.length("name")).cast("bigint").alias("n_letters"),
    )
    counts = truth.groupBy("pair_id").agg(F.count("*").alias("n_matches"))
    listed = pairs.list_pairs(spark, *where).join(pairs.pair_metadata(catalog), "pair_id")
    return listed.join(types, "pair_id").join(counts, "pair_id")


# Legacy transforms


def _renamed(spark: SparkSession, sf_dir: str, step: str, **options) -> DataFrame:
    d = Documents(spark, sf_dir)
    state = legacy.apply_steps(legacy.initial_state(d.catalog), [step], {step: options})
    return state.select(
        "pair_id", F.col("ordinal"), F.element_at("origins", 1).src.alias("src"), F.col("name").alias("tgt")
    )


def legacy_abbreviate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, "abbreviate", dictionary=w.WORD_ABBREVIATIONS)


def legacy_strip_vowels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, "strip_vowels")


def legacy_table_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, "table_prefix", code=F.col("pair_id"))


def legacy_case_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(spark, sf_dir, "case_flip")


def legacy_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts")]
    out = None
    for name, column in parts:
        dates = w.table(spark, sf_dir, name).select(values.date_as_int(F.col(column)).alias("day"))
        counted = dates.groupBy("day").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "day", "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def legacy_split_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = w.table(spark, sf_dir, "part").select(F.lit("part").alias("tab"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    customer = w.table(spark, sf_dir, "customer").select(F.lit("customer").alias("tab"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return migrate.split_field(migrate.LegacyTable.of(part.unionByName(customer))).df


def legacy_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt have no second line."""
    nation = w.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = (
        w.table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "s_suppkey",
            F.col("s_name").alias("address_line_1"),
            F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("n_name")).alias("address_line_2"),
        )
    )
    return migrate.merge_fields(migrate.LegacyTable.of(lines)).df


def legacy_unit_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = w.table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("tab"), F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.col("o_totalprice").alias("amount")
    )
    lines = w.table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("tab"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount")
    )
    return migrate.unit_change(migrate.LegacyTable.of(orders.unionByName(lines))).df


def legacy_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = w.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return migrate.drop_column(migrate.LegacyTable.of(orders), "o_orderstatus").df


def legacy_add_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrate.add_junk(migrate.LegacyTable.of(w.table(spark, sf_dir, "orders").select("o_orderkey"))).df


def legacy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten value-side steps on the base table of the orders' keys."""
    rows = base_table(w.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").drop("row_key")
    return migrate.migrate(rows).df


def legacy_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of the standard steps over every tenant's base schema."""
    _, state = w.tenant_state(spark, sf_dir)
    return legacy.lineage(state)


# Matchers


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(Documents(spark, sf_dir).matched(exact_match))


def match_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(Documents(spark, sf_dir).matched(normalized_match))


def match_trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(Documents(spark, sf_dir).matched(trigram_match))


def match_sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(Documents(spark, sf_dir).matched(sequence_match))


def match_cupid(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(short, word, 1.0) for word, short in w.WORD_ABBREVIATIONS.items()]
    thesaurus = spark.createDataFrame(entries, "term string, synonym string, weight double")
    return _predictions(Documents(spark, sf_dir).matched(cupid_match, thesaurus=thesaurus))


def match_flooding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    return _predictions(Flooding(settle(d.catalog), whole=False).top_k(5))


def match_flooding_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of every source, equally similar targets of a type family in one row."""
    d = Documents(spark, sf_dir)
    return _rounded(Flooding(settle(d.catalog)).shortlist(), "score", "s")


# Evaluation


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated()
    return run.outcomes.select("matcher", "pair_id", "src", "outcome", "n_cand")


def eval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated()
    return run.outcomes.filter("has_truth").select("matcher", "pair_id", "src", F.coalesce("rank", F.lit(0)).alias("rank"))


METRICS = ("precision", "recall", "f1", "mrr", "recall_at_3")


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated(MATCHERS_4)
    whole = evaluate.report_with_pairs(run.outcomes).withColumn("pair_id", F.coalesce("pair_id", F.lit("all")))
    return _rounded(whole, *METRICS)


def eval_six_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all six matchers, by schema pair."""
    run = Documents(spark, sf_dir).evaluated(MATCHERS_6)
    by_pair = evaluate.report(run.outcomes, ["matcher", "pair_id"])
    return _rounded(by_pair.select("matcher", "pair_id", "tp", "fp", "fn", "tn", *METRICS), *METRICS)


def eval_fixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over a given list of sources, here those of even ordinals, instead of the catalog's."""
    d = Documents(spark, sf_dir)
    listed = sources(d.catalog).filter(F.col("src_ord") % 2 == 0)
    return _rounded(jobs.run_eval(settle(d.catalog), d.truth, MATCHERS_3, all_src=listed).report().select("matcher", "tp", "fp", "fn", "tn", *METRICS), *METRICS)


def eval_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and rank lists written by matcher and read back."""
    run, root = Documents(spark, sf_dir).evaluated(), shared_folder(spark)
    sinks.write_report(run.report(), run.ranks(), root)
    ranks = spark.read.json(f"{root}/ranks").groupBy("matcher").agg(F.sum(F.size("ranks")).alias("n_ranks"))
    report = spark.read.json(f"{root}/report").join(ranks, "matcher")
    return _rounded(report.select("matcher", "tp", "fp", "fn", "tn", *METRICS, "n_ranks"), *METRICS)


def eval_rank_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated()
    shown = F.array_join(F.transform("ranks", lambda r: F.coalesce(r.cast("string"), F.lit("null"))), ",")
    return run.ranks().select("matcher", "pair_id", "chunk", shown.alias("ranks"))


def eval_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated()
    return _rounded(evaluate.coverage_curve(run.outcomes), "coverage", "precision_at_coverage")


# Audits


def audit_dropped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    hits = audit.dropped_hits(d.evaluated().predictions, audit.dropped_sources(d.catalog, d.lineage))
    return _predictions(hits, "matcher")


def audit_junk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    hits = audit.junk_hits(d.evaluated().predictions, audit.junk_targets(d.catalog, d.lineage))
    return _predictions(hits, "matcher")


def _audited(spark: SparkSession, sf_dir: str) -> tuple[list[str], str]:
    d, root = Documents(spark, sf_dir), shared_folder(spark)
    run = d.evaluated()
    jobs.write_audit(run, d.catalog, d.lineage, root)
    return run.matchers, root


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matchers, root = _audited(spark, sf_dir)
    return audit.summary(sinks.read_audit(spark, root)[0], matchers)


def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that audit files hold, by matcher: what hits add up to, listed columns, counts and F1."""
    matchers, root = _audited(spark, sf_dir)
    hits, columns, totals = sinks.read_audit(spark, root)
    listed = columns.groupBy().agg(
        F.count("*").alias("n_listed"), F.sum("ordinal").alias("sum_ordinal"), F.sum(F.length("name")).alias("name_chars")
    )
    added = hits.groupBy("matcher").agg(
        F.count("*").alias("n_hits"),
        F.count_distinct("pair_id").alias("n_pairs"),
        F.sum("rank").alias("sum_rank"),
        F.sum("src_ord").alias("sum_src_ord"),
        F.sum("tgt_ord").alias("sum_tgt_ord"),
        F.sum(F.length("src") + F.length("tgt")).alias("hit_chars"),
        F.round(F.sum(F.round("score", 6)), 3).alias("sum_score"),
    )
    whole = totals.join(added, "matcher", "left").fillna(0)
    each = listed.withColumn("matcher", F.explode(F.array(*[F.lit(m) for m in matchers])))
    return _rounded(whole.join(each, "matcher"), "f1")


def audit_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic audit for every tenant at once."""
    return jobs.synthetic_audit(w.tenant_pairs(spark, sf_dir), shared_folder(spark))


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    predictions = d.matched(normalized_match)
    audit.check_prediction_shape(predictions)
    unlisted = d.lineage.filter(F.col("src").isNotNull() | (F.col("tgt") != "INTERNAL_CODE"))
    return audit.violation_counts(
        {
            "sentinels": audit.sentinel_mismatch(d.catalog, d.lineage),
            "sentinels_broken": audit.sentinel_mismatch(d.catalog, unlisted),
            "truth": audit.truth_violations(d.truth),
            "predictions": audit.prediction_violations(predictions),
            "coverage": audit.coverage_violations(d.catalog, d.lineage),
        }
    )


def audit_candidate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Documents(spark, sf_dir)
    run = d.evaluated()
    return audit.candidate_profile(run.predictions, sources(d.catalog), run.matchers)


def audit_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as one candidate list per source, read back and flattened."""
    run, root = Documents(spark, sf_dir).evaluated(), shared_folder(spark)
    audit.nest(run.predictions, ["matcher", "pair_id", "src"]).write.json(f"{root}/predictions")
    schema = "matcher string, pair_id string, src string, candidates array<struct<tgt: string, score: double>>"
    return _rounded(audit.flatten(spark.read.schema(schema).json(f"{root}/predictions")), "score")


def audit_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six matchers over the benchmark files of one noise level."""
    files = BenchmarkFiles(spark, sf_dir)
    return jobs.benchmark_audit(spark, files.root, *BENCHMARK, "ev", shared_folder(spark))


# Stability and triage


def stability_shuffle_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram candidates of the tenants' columns often tie, so the order decides."""
    catalog, state = w.tenant_state(spark, sf_dir)
    state = settle(state)
    lost = jobs.shuffle_probe(settle(legacy.legacy_pairs(catalog, state)), legacy.truth_of(state), trigram_match)
    return _rounded(lost, "orig_score", "shuf_score")


def stability_shuffle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First candidates of the document catalog under every seed, and how many are correct."""
    d = Documents(spark, sf_dir)
    moved = stability.by_seed(trigram_match(stability.shuffled(settle(d.catalog)), 1))
    correct = moved.join(merged(d.truth), ["pair_id", "src", "tgt"], "left_semi").groupBy("seed").agg(F.count("*").alias("n_correct"))
    return moved.groupBy("seed").agg(F.count("*").alias("n_sources")).join(correct, "seed")


def stability_shuffle_flooding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose first target by propagation is correct only in the original order."""
    d = Documents(spark, sf_dir)
    lost = jobs.shuffle_probe(settle(d.catalog), d.truth, lambda catalog: flooding_match(catalog, k=1))
    return _rounded(lost, "orig_score", "shuf_score")


def stability_ties_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = stability.ties_and_margins(Documents(spark, sf_dir).matched(trigram_match))
    return ties.select(
        "pair_id", "src", "tgt", "rank", "n_tied", F.round(F.coalesce("margin", F.lit(-1.0)), 6).alias("margin")
    )


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated()
    return stability.triage(run.outcomes, 0.5).select("matcher", "pair_id", "src", "decision")


def triage_six_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Documents(spark, sf_dir).evaluated(MATCHERS_6)
    return stability.triage(run.outcomes, 0.5).select("matcher", "pair_id", "src", "decision")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        base_table_generate,
        catalog_metadata,
        benchmark_pair_load,
        legacy_abbreviate,
        legacy_strip_vowels,
        legacy_table_prefix,
        legacy_case_flip,
        legacy_date_format,
        legacy_split_field,
        legacy_merge_fields,
        legacy_unit_change,
        legacy_drop_column,
        legacy_add_junk,
        legacy_table,
        legacy_lineage,
        match_exact,
        match_normalized,
        match_trigram_topk,
        match_sequence_ratio,
        match_cupid,
        match_flooding,
        match_flooding_shortlist,
        eval_outcomes,
        eval_ranks,
        eval_report,
        eval_six_matchers,
        eval_fixed_sources,
        eval_report_files,
        eval_rank_list,
        eval_coverage_curve,
        audit_dropped_hits,
        audit_junk_hits,
        audit_summary,
        audit_files,
        audit_tenants,
        audit_checks,
        audit_candidate_profile,
        audit_flattened,
        audit_benchmark,
        stability_shuffle_lost,
        stability_shuffle_documents,
        stability_shuffle_flooding,
        stability_ties_margin,
        triage,
        triage_six_matchers,
    )
}
