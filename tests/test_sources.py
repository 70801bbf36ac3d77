import csv
import json

import pytest

from schemaweft.plans import jobs
from schemaweft.sources import pairs, sinks


@pytest.fixture
def root(tmp_path):
    def write(pair, source, target, matches, rows=""):
        folder = tmp_path / "TPC-DI" / "Unionable" / pair
        folder.mkdir(parents=True)
        (folder / f"{pair}_source.csv").write_text(source + "\n" + rows)
        (folder / f"{pair}_target.csv").write_text(target + "\n")
        found = [{"source_column": s, "target_column": t, "note": 1} for s, t in matches]
        (folder / f"{pair}_mapping.json").write_text(json.dumps({"matches": found}, indent=2))

    write(
        "a_ac1_ev",
        'AgencyID,LastName,"x, y",City,City,',
        "gncd,lstnm,ct",
        [("AgencyID", "gncd"), ("LastName", "lstnm"), ("City", "ct")],
        "1,x,2.5,True,a,\n2,,3,False,b,\n",
    )
    write("b_ac2_ev", "id,name", "ID,nm1,nm2", [("id", "ID"), ("name", "nm1"), ("name", "nm2")])
    write("c_ac2_ec", "id", "ID", [("id", "ID")])
    return str(tmp_path)


WHERE = ("TPC-DI", "Unionable")


def test_pairs_and_noise_level(spark, root):
    assert pairs.list_pairs(spark, root, *WHERE).count() == 3
    assert sorted(r.pair_id for r in pairs.list_pairs(spark, root, *WHERE, "ev").collect()) == ["a_ac1_ev", "b_ac2_ev"]


def test_catalog_and_truth(spark, root):
    catalog = pairs.read_catalog(spark, root, *WHERE, "ev")
    rows = {(r.pair_id, r.side, r.ordinal): (r.name, r.dtype) for r in catalog.collect()}
    assert [rows["a_ac1_ev", "source", i] for i in range(1, 7)] == [
        ("AgencyID", "int"),
        ("LastName", "str"),
        ("x, y", "float"),
        ("City", "bool"),
        ("City.1", "str"),
        ("Unnamed: 5", "float"),
    ]
    assert [rows["b_ac2_ev", "target", i][0] for i in range(1, 4)] == ["ID", "nm1", "nm2"]
    assert len(rows) == 14
    truth = {(r.pair_id, r.src, r.tgt) for r in pairs.read_truth(spark, root, *WHERE, "ev").collect()}
    assert ("b_ac2_ev", "name", "nm1") in truth and ("b_ac2_ev", "name", "nm2") in truth and len(truth) == 6
    metadata = {r.pair_id: (r.n_source_cols, r.n_target_cols) for r in pairs.pair_metadata(catalog, *WHERE).collect()}
    assert metadata == {"a_ac1_ev": (6, 3), "b_ac2_ev": (2, 3)}


def test_values_of_one_pair(spark, root):
    table = pairs.read_pair_table(spark, root, *WHERE, "a_ac1_ev", "source")
    assert table.count() == 2 and dict(table.dtypes)["AgencyID"] == "int"


def test_written_pairs_read_back(spark, root, tmp_path):
    catalog, truth = pairs.read_catalog(spark, root, *WHERE), pairs.read_truth(spark, root, *WHERE)
    out = str(tmp_path / "out")
    assert pairs.write_pairs(catalog, truth, out, *WHERE) == 9
    again, truth_again = pairs.read_catalog(spark, out, *WHERE), pairs.read_truth(spark, out, *WHERE)
    assert again.select("pair_id", "side", "ordinal", "name").exceptAll(catalog.select("pair_id", "side", "ordinal", "name")).count() == 0
    assert again.count() == catalog.count()
    assert truth_again.exceptAll(truth).count() == 0 and truth_again.count() == truth.count()


def test_records_with_line_breaks_and_many_quoted_names(spark, tmp_path):
    names = [f'na"me, {i}\nof {i}' if i % 3 else f"plain {i}" for i in range(20_000)]
    rows = [names, [str(i) for i in range(20_000)], ["", *["2.5"] * 19_999]]
    folder = tmp_path / "D" / "S" / "wide_ev"
    folder.mkdir(parents=True)
    with open(folder / "wide_ev_source.csv", "w", newline="", encoding="utf-8-sig") as out:
        csv.writer(out).writerows(rows[:1] + [[]] + rows[1:])
    (folder / "wide_ev_target.csv").write_text('a,"b\n\nc",d\n\n1,"x\n\ny",True\n')
    (folder / "wide_ev_mapping.json").write_text('{"matches": []}')
    catalog = pairs.read_catalog(spark, str(tmp_path), "D", "S").collect()
    source = {r.ordinal: (r.name, r.dtype) for r in catalog if r.side == "source"}
    assert [source[i + 1][0] for i in range(20_000)] == names
    assert source[1][1] == "int" and {source[i][1] for i in range(2, 20_001)} == {"float"}
    target = sorted((r.ordinal, r.name, r.dtype) for r in catalog if r.side == "target")
    assert target == [(1, "a", "int"), (2, "b\n\nc", "str"), (3, "d", "bool")]


def test_records_across_blocks_of_a_file(spark, tmp_path):
    """A block may begin inside quotes; which lines begin records follows from the quotes before it."""
    folder = tmp_path / "D" / "S" / "p"
    folder.mkdir(parents=True)
    rows = [["id", "text"]] + [[str(i), f'line one {i}\nline "two"\n\nlast' if i % 2 else f"single {i}"] for i in range(3000)]
    for side in ("source", "target"):
        with open(folder / f"p_{side}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows(rows)
    had = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = pairs.read_records(spark, f"{tmp_path}/D/S/*/*_{{source,target}}.csv").withColumn("cells", pairs.cells("text")).collect()
    finally:
        for name, value in had.items():
            spark.conf.set(name, value)
    for side in ("source", "target"):
        assert [r.cells for r in sorted((r for r in got if r.side == side), key=lambda r: r.record)] == rows


def test_benchmark_audit_writes_reports(spark, root, tmp_path):
    out = str(tmp_path / "audit")
    names = ("normalized_match", "levenshtein_ratio_match")
    summary = {r.matcher: r for r in jobs.benchmark_audit(spark, root, *WHERE, "ev", out, names).collect()}
    assert summary["normalized_match"].n_dropped_source_mappings == 0
    assert summary["levenshtein_ratio_match"].n_dropped_source_mappings == 9
    report = {r.matcher: r for r in spark.read.json(f"{out}/report").collect()}
    assert (report["normalized_match"].tp, report["normalized_match"].fn) == (1, 4)
    ranks = spark.read.json(f"{out}/ranks").filter("matcher = 'normalized_match'").orderBy("pair_id").collect()
    assert [r.ranks for r in ranks] == [[None, None, None], [1, None]]
    hits = spark.read.json(f"{out}/audit").collect()
    assert {r.kind for r in hits} == {"dropped"} and len(hits) == 9
    assert (tmp_path / "audit/audit/matcher=normalized_match").is_dir()
    again, columns, totals = sinks.read_audit(spark, out)
    assert sorted((r.matcher, r.pair_id, r.src, r.tgt, r.rank) for r in again.collect()) == sorted((r.matcher, r.pair_id, r.src, r.tgt, r.rank) for r in hits)
    dropped = {(r.pair_id, r.name) for r in columns.filter("kind = 'dropped'").collect()}
    assert dropped and {(r.pair_id, r.src) for r in hits} <= dropped
    rows = {r.matcher: r for r in totals.collect()}
    assert set(rows) == set(names) and rows["normalized_match"].n_dropped_source_mappings == 0
    assert {r.n_dropped_source_columns for r in rows.values()} == {len(dropped)}
    assert all(rows[m].f1 == report[m].f1 for m in names)
