"""Estimates from sketches of ordinary texts, against whole shingle sets."""

import random

from pyspark.sql import functions as F

from schemaweft.llm import fingerprints


def test_near_copies_of_ordinary_texts_are_found(spark):
    draw = random.Random(7)
    rows = []
    for _ in range(300):
        words = [f"w{draw.randrange(5000)}" for _ in range(160)]
        cut = draw.randrange(8, 24)
        rows.append((" ".join(words), " ".join(words[cut:]), (156 - cut) / 156))
    df = spark.createDataFrame(rows, "text string, copy string, true double")
    sketched = fingerprints.with_sketch(fingerprints.with_sketch(df), "copy", "other")
    off = F.abs(fingerprints.jaccard(F.col("sketch"), F.col("other")) - F.col("true"))
    row = sketched.select(off.alias("off")).agg(F.mean("off").alias("mean"), F.max("off").alias("most")).first()
    assert row.mean < 0.03 and row.most < 0.2
