from pyspark.sql import functions as F

from schemaweft.plans import workload as w


def test_a_source_is_one_schema_whatever_its_ids(spark, tmp_path):
    docs = [(5, "alpha beta", "en", "web"), (10_005, "gamma delta", "en", "web"), (70_000, "other words", "de", "books")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = w.document_columns(spark, str(tmp_path))
    schemas = {}
    for r in columns.collect():
        schemas.setdefault(r.pair_id, set()).add(r.ordinal)
    assert sorted(schemas.values(), key=min) == [{5, 10_005}, {70_000}]


def test_names_come_from_all_words(spark):
    texts = spark.createDataFrame([("A bb extraordinarily long zebra",), ("",), (None,), ("12 34",)], "text string")
    got = texts.select(w.column_name(F.col("text"), F.lit("en"))).collect()
    assert [r[0] for r in got] == ["a_extraordinarily_zebra", "en_text", "en_text", "en_text"]
