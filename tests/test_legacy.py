import datetime

import pytest
from conftest import SYNTHETIC_TARGET

from schemaweft.functions import names, values
from schemaweft.operators import legacy, migrate
from schemaweft.sources.generator import BASE_SCHEMA, base_catalog, sample_table
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def base(spark):
    return base_catalog(spark.createDataFrame([("p",), ("q",)], "pair_id string"))


def state_names(state, pair="p"):
    return [(r.name, r.dtype) for r in state.filter(F.col("pair_id") == pair).orderBy("ordinal").collect()]


def run(base, steps, **options):
    return legacy.apply_steps(legacy.initial_state(base), steps, options)


def test_standard_steps(base):
    state = run(base, legacy.STANDARD_STEPS)
    for pair in ("p", "q"):
        assert [n for n, _ in state_names(state, pair)] == SYNTHETIC_TARGET
    assert dict(state_names(state))["CUST_CRTD_T"] == "int" and dict(state_names(state))["CUST_MNT"] == "int"
    lineage = {(r.src, r.tgt) for r in legacy.lineage(state).filter("pair_id = 'p'").collect()}
    assert ("name", "CUST_NM1") in lineage and ("name", "CUST_NM2") in lineage
    assert ("address_line_1", "CUST_STRS") in lineage and ("address_line_2", "CUST_STRS") in lineage
    assert (None, "LEGACY_FLAG") in lineage and not any(s == "status" for s, _ in lineage)
    assert len(lineage) == 11
    assert legacy.duplicate_targets(state).count() == 0


def test_unknown_step_fails_first(base):
    with pytest.raises(KeyError):
        run(base, ["case_flip", "no_such_step"])


def test_abbreviate_reads_lower_case_only(base):
    assert ("ADDR_LINE_1", "str") in state_names(run(base, ["abbreviate"]))
    assert ("ADDRESS_LINE_1", "str") in state_names(run(base, ["case_flip", "abbreviate"]))


def test_junk_lineage_follows_later_renames(base):
    state = run(base, ["add_junk", "strip_vowels"])
    junk = {r.tgt for r in legacy.lineage(state).filter("src is null").collect()}
    assert junk == {"LGCY_FLG", "NTRNL_CD", "MGRTN_BTCH"}


def test_merge_without_or_before_second_line(spark, catalog_of):
    one = catalog_of({"p": (["address_line_1", "x"], [])})
    assert [n for n, _ in state_names(run(one, ["merge_fields"]))] == ["address_line_1", "x"]
    turned = catalog_of({"p": (["address_line_2", "x", "address_line_1"], [])})
    assert [n for n, _ in state_names(run(turned, ["merge_fields"]))] == ["x", "STRAS"]
    second = catalog_of({"p": (["address_line_2", "x"], [])})
    assert [n for n, _ in state_names(run(second, ["merge_fields"]))] == ["address_line_2", "x"]


def test_split_keeps_position_and_dropping_takes_the_first_half(base):
    assert [n for n, _ in state_names(run(base, ["split_field"]))][:4] == ["id", "NAME1", "NAME2", "email"]
    again = state_names(run(base, ["split_field", "split_field"]))
    assert [n for n, _ in again][1:4] == ["NAME1", "NAME2", "NAME2"]
    assert legacy.duplicate_targets(run(base, ["split_field", "split_field"])).count() == 2


def test_table_prefix_code_per_pair(base):
    state = run(base, ["table_prefix"], table_prefix={"code": F.col("pair_id")})
    assert ("P_ID", "int") in state_names(state) and ("Q_ID", "int") in state_names(state, "q")


def test_name_expressions(spark):
    df = spark.createDataFrame([("Straße_AeIou_x",), ("",), ("ab",), ("AbcAbc",)], "n string")
    rows = df.select(
        names.strip_vowels(F.col("n")).alias("v"),
        names.normalized(F.col("n")).alias("k"),
        names.trigrams(F.col("n")).alias("g"),
        names.word_tokens(F.col("n")).alias("t"),
    ).collect()
    assert [r.v for r in rows] == ["STRSS__X", "", "B", "BCBC"]
    assert rows[0].k == "straßeaeioux"
    assert rows[1].g == [] and rows[2].g == [] and sorted(rows[3].g) == ["abc", "bca", "cab"]
    assert rows[3].t == ["abc"] and rows[0].t == ["ae", "iou", "straße", "x"]


def test_value_expressions(spark):
    df = spark.createDataFrame(
        [
            (19.99, "Ann Mary  Lee ", "1 Main St", "Apt 2", datetime.datetime(2024, 2, 3)),
            (-0.5, "Cher", "1 Main St", "", datetime.datetime(1999, 12, 31)),
            (1e12, "\t ", "x", None, datetime.datetime(2024, 1, 1)),
            (1.0, None, None, "y", None),
        ],
        "a double, n string, l1 string, l2 string, d timestamp_ntz",
    )
    rows = df.select(
        values.minor_units(F.col("a")).alias("a"),
        values.first_word(F.col("n")).alias("f"),
        values.last_word(F.col("n")).alias("l"),
        values.merged_lines(F.col("l1"), F.col("l2")).alias("m"),
        values.date_as_int(F.col("d")).alias("d"),
    ).collect()
    assert [r.a for r in rows] == [1998, -50, 100000000000000, 100]
    assert [(r.f, r.l) for r in rows] == [("Ann", "Lee"), ("Cher", ""), ("", ""), ("", "")]
    assert [r.m for r in rows] == ["1 Main St, Apt 2", "1 Main St", "x", None]
    assert [r.d for r in rows] == [20240203, 19991231, 20240101, None]


def test_base_table(spark):
    df = sample_table(spark, 2000, seed=3)
    assert df.columns == [n for n, _ in BASE_SCHEMA]
    r = df.agg(
        F.min("id"), F.max("id"), F.min("amount"), F.max("amount"), F.count_if(F.col("address_line_2") == ""), F.countDistinct("status")
    ).first()
    assert 1 <= r[0] and r[1] <= 9999 and 10 <= r[2] and r[3] <= 1000 and 1200 < r[4] < 1600 and r[5] == 4
    assert df.exceptAll(sample_table(spark, 2000, seed=3)).count() == 0
    assert df.exceptAll(sample_table(spark, 2000, seed=4)).count() > 0


def test_migrated_table_has_the_rows_of_the_original(spark):
    source = sample_table(spark, 50)
    table = migrate.migrate(source)
    assert table.df.columns == SYNTHETIC_TARGET
    assert ("name", "CUST_NM2") in table.lineage() and (None, "LEGACY_FLAG") in table.lineage()
    assert len(table.lineage()) == 11
    before, after = source.collect(), table.df.collect()
    assert len(after) == 50
    for old, new in zip(before, after):
        assert f"{new.CUST_NM1} {new.CUST_NM2}" == old.name
        assert new.CUST_STRS == (f"{old.address_line_1}, {old.address_line_2}" if old.address_line_2 else old.address_line_1)
        assert new.CUST_MNT == int(old.amount * 100)
        assert new.CUST_CRTD_T == int(old.created_at.strftime("%Y%m%d"))


def test_date_format_retypes_all_date_types(catalog_of):
    names = [("a", "timestamp"), ("b", "timestamp_ntz"), ("c", "date"), ("d", "datetime"), ("e", "string"), ("f", None)]
    state = legacy.date_format(legacy.initial_state(catalog_of({"p": (names, [])})))
    assert {r["name"]: r["dtype"] for r in state.collect()} == {"a": "int", "b": "int", "c": "int", "d": "int", "e": "string", "f": None}
