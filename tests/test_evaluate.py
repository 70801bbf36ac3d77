import pytest
from conftest import SYNTHETIC_SOURCE, SYNTHETIC_TARGET

from schemaweft.catalog import PREDICTION_SCHEMA, sources
from schemaweft.operators import audit, evaluate, stability
from schemaweft.plans import jobs

SYNTHETIC_TRUTH = {
    "id": ["CUST_D"],
    "name": ["CUST_NM1", "CUST_NM2"],
    "email": ["CUST_ML"],
    "address_line_1": ["CUST_STRS"],
    "address_line_2": ["CUST_STRS"],
    "created_at": ["CUST_CRTD_T"],
    "amount": ["CUST_MNT"],
}
RANKED = {"a": [("q", 0.9), ("x", 0.5)], "b": [("y", 0.9)], "c": [("z", 0.9), ("w", 0.5), ("v", 0.3), ("q", 0.1)]}


@pytest.fixture
def demo(spark):
    """Outcomes of hand-written predictions over sources a..d with truth a-x, b-y, c-z."""
    truth = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("p", "c", "z")], "pair_id string, src string, tgt string")
    all_src = spark.createDataFrame([("p", s, i) for i, s in enumerate("abcd")], "pair_id string, src string, src_ord bigint")

    def judge(**matchers):
        rows = [
            (m, "p", s, 0, t, i, score, i + 1)
            for m, preds in matchers.items()
            for s, candidates in preds.items()
            for i, (t, score) in enumerate(candidates)
        ]
        predictions = spark.createDataFrame(rows, "matcher string, " + PREDICTION_SCHEMA)
        return evaluate.outcomes(predictions, truth, all_src, list(matchers))

    return judge


def test_demo_counts_and_metrics(demo):
    rows = demo(
        right={"a": [("x", 0.9)], "b": [("y", 0.9)], "c": [("z", 0.9)]},
        wrong={"a": [("w", 0.9)], "b": [("v", 0.9)], "c": [("u", 0.9)], "outside": [("x", 1.0)]},
        silent={},
        ranked=RANKED,
        extra={"d": [("x", 0.2)]},
    )
    report = {r.matcher: r for r in evaluate.report(rows).collect()}
    counts = {m: (r.tp, r.fp, r.fn, r.tn) for m, r in report.items()}
    assert counts == {
        "right": (3, 0, 0, 1),
        "wrong": (0, 0, 3, 1),
        "silent": (0, 0, 3, 1),
        "ranked": (2, 0, 1, 1),
        "extra": (0, 1, 3, 0),
    }
    assert (report["right"].precision, report["right"].f1, report["right"].mrr) == (1.0, 1.0, 1.0)
    assert (report["silent"].precision, report["silent"].f1, report["silent"].mrr) == (0.0, 0.0, 0.0)
    assert report["ranked"].mrr == pytest.approx(0.833333, abs=1e-6)
    assert report["ranked"].recall_at_3 == 1.0
    ranks = {r.matcher: r.ranks for r in evaluate.rank_list(rows).collect()}
    assert ranks["ranked"] == [2, 1, 1] and ranks["silent"] == [None] * 3


def test_coverage_and_triage(demo):
    rows = demo(ranked=RANKED)
    curve = {r.threshold: r for r in evaluate.coverage_curve(rows, (0.9, 0.95)).collect()}
    assert curve[0.9].coverage == 0.75
    assert curve[0.9].precision_at_coverage == pytest.approx(2 / 3)
    assert (curve[0.95].coverage, curve[0.95].precision_at_coverage) == (0.0, 0.0)
    decisions = [r.decision for r in stability.triage(rows, 0.9).orderBy("src_ord").collect()]
    assert decisions == ["accept"] * 3 + ["no_candidate"]
    assert {r.decision for r in stability.triage(rows, 0.95).collect()} == {"review", "no_candidate"}


def test_rank_list_chunks(demo):
    chunks = evaluate.rank_list(demo(ranked=RANKED), chunk=2).orderBy("chunk").collect()
    assert [c.ranks for c in chunks] == [[2, 1], [1]]


@pytest.fixture(scope="module")
def synthetic(spark):
    rows = [
        ("p", side, i + 1, n, "str")
        for side, names in (("source", SYNTHETIC_SOURCE), ("target", SYNTHETIC_TARGET))
        for i, n in enumerate(names)
    ]
    catalog = spark.createDataFrame(rows, "pair_id string, side string, ordinal bigint, name string, dtype string")
    lineage = spark.createDataFrame(
        [("p", s, t) for s, ts in SYNTHETIC_TRUTH.items() for t in ts] + [("p", None, t) for t in SYNTHETIC_TARGET[7:]],
        "pair_id string, src string, tgt string",
    )
    return catalog, lineage, jobs.run_eval(catalog, lineage, {m: jobs.MATCHERS[m] for m in jobs.NAME_MATCHERS})


def test_synthetic_goldens(synthetic):
    _, _, run = synthetic
    counts = {r.matcher: (r.tp, r.fp, r.fn, r.tn) for r in run.report().collect()}
    assert counts == {
        "exact_match": (0, 0, 7, 1),
        "normalized_match": (0, 0, 7, 1),
        "jaccard_trigram_match": (1, 1, 6, 0),
        "levenshtein_ratio_match": (2, 1, 5, 0),
    }
    ranks = {r.matcher: r.ranks for r in run.ranks().collect()}
    assert ranks["jaccard_trigram_match"] == [1, 2, 4, 5, 5, None, None]
    assert ranks["levenshtein_ratio_match"] == [2, 2, 2, None, None, 1, 1]
    assert ranks["exact_match"] == [None] * 7
    f1 = {r.matcher: r.f1 for r in run.report().collect()}
    assert f1["jaccard_trigram_match"] == pytest.approx(0.2222222222)
    assert f1["levenshtein_ratio_match"] == pytest.approx(0.4)


def test_synthetic_hits(synthetic):
    catalog, lineage, run = synthetic
    hits = audit.audit_hits(run.predictions, catalog, lineage)
    summary = {
        r.matcher: (r.n_dropped_source_mappings, r.n_junk_target_mappings)
        for r in audit.summary(hits, run.matchers).collect()
    }
    assert summary == {
        "exact_match": (0, 0),
        "normalized_match": (0, 0),
        "jaccard_trigram_match": (5, 0),
        "levenshtein_ratio_match": (5, 11),
    }
    status = hits.filter("matcher = 'levenshtein_ratio_match' and kind = 'dropped'").orderBy("rank").collect()
    assert [(r.tgt, round(r.score, 6)) for r in status] == [
        ("CUST_STRS", 0.533333),
        ("CUST_MNT", 0.428571),
        ("CUST_CRTD_T", 0.352941),
        ("CUST_D", 0.333333),
        ("CUST_ML", 0.307692),
    ]


def test_checks(synthetic, spark):
    catalog, lineage, run = synthetic
    assert audit.sentinel_mismatch(catalog, lineage).count() == 0
    broken = lineage.filter("tgt != 'LEGACY_FLAG'")
    assert [r.name for r in audit.sentinel_mismatch(catalog, broken).collect()] == ["LEGACY_FLAG"]
    assert audit.truth_violations(lineage).count() == 0
    with_null = lineage.unionByName(spark.createDataFrame([("p", "status", None)], lineage.schema))
    assert audit.truth_violations(with_null).collect()[0].violation == "empty target set"
    violations = {(r.name, r.violation) for r in audit.coverage_violations(catalog, lineage).collect()}
    assert ("status", "source without target") in violations and len(violations) == 4
    assert audit.prediction_violations(run.predictions, ["matcher"]).count() == 0
    audit.check_prediction_shape(run.predictions)
    with pytest.raises(TypeError):
        audit.check_prediction_shape(run.predictions.drop("rank"))


def test_candidate_profile_and_nesting(synthetic):
    catalog, _, run = synthetic
    profile = audit.candidate_profile(run.predictions, sources(catalog), run.matchers)
    counts = {(r.matcher, r.n_candidates) for r in profile.collect()}
    assert ("exact_match", 0) in counts and ("jaccard_trigram_match", 5) in counts
    one = run.predictions.filter("matcher = 'levenshtein_ratio_match'")
    again = audit.flatten(audit.nest(one))
    wanted = {(r.src, r.tgt, r.score, r["rank"]) for r in one.collect()}
    assert {(r.src, r.tgt, r.score, r["rank"]) for r in again.collect()} == wanted
    assert audit.zero_candidate_sources(one, sources(catalog)).count() == 0


def test_rollup_has_pairs_and_totals(synthetic):
    _, _, run = synthetic
    rows = evaluate.report_with_pairs(run.outcomes).collect()
    assert {r.pair_id for r in rows} == {None, "p"} and len(rows) == 8


def test_shuffle_probe_and_ties(synthetic):
    catalog, lineage, run = synthetic
    lost = jobs.shuffle_probe(catalog, lineage, jobs.MATCHERS["jaccard_trigram_match"]).collect()
    assert lost and {r.src for r in lost} == {"id"} and {r.orig_tgt for r in lost} == {"CUST_D"}
    assert jobs.shuffle_probe(catalog, lineage, jobs.MATCHERS["normalized_match"]).count() == 0
    trigram = run.predictions.filter("matcher = 'jaccard_trigram_match'")
    ties = stability.ties_and_margins(trigram).filter("src = 'id'").orderBy("rank").collect()
    assert [r.n_tied for r in ties] == [5] * 5 and [r.margin for r in ties] == [0.0] * 4 + [None]


def test_permuted_ordinals_are_one_to_one(spark):
    from pyspark.sql import functions as F

    ids = spark.range(5000).withColumn("o", F.when(F.col("id") < 4990, F.col("id")).otherwise((1 << 40) + F.col("id")))
    for seed in stability.DEFAULT_SEEDS:
        assert ids.select(stability.permuted_ordinal(F.col("o"), F.lit(seed).cast("bigint"))).distinct().count() == 5000


def test_first_ordinal_moves_under_every_seed(spark):
    from pyspark.sql import functions as F

    ids = spark.range(10).select(F.col("id").alias("o"))
    for seed in stability.DEFAULT_SEEDS:
        order = [r.o for r in ids.orderBy(stability.permuted_ordinal(F.col("o"), F.lit(seed).cast("bigint"))).collect()]
        assert order[0] != 0 and sorted(order) == list(range(10))


def test_joins_on_columns_are_not_broadcast(demo, spark):
    """Files of predictions and truth are small beside their rows, so their size must not decide."""
    rows = demo(ranked=RANKED, silent={})
    catalog = spark.createDataFrame([("p", "source", 1, "a", "str"), ("p", "target", 2, "x", "str")], "pair_id string, side string, ordinal bigint, name string, dtype string")
    lineage = spark.createDataFrame([("p", "a", "x")], "pair_id string, src string, tgt string")
    predictions = rows.select("matcher", "pair_id", "src", "src_ord", "top_tgt", "top_score").toDF("matcher", "pair_id", "src", "src_ord", "tgt", "score")
    predictions = predictions.selectExpr("*", "src_ord AS tgt_ord", "1 AS rank")
    for df in (rows, audit.audit_hits(predictions, catalog, lineage), audit.candidate_profile(predictions, sources(catalog), ["ranked"])):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
