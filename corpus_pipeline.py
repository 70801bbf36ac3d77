"""Corpus pipeline: language ID, near-duplicates, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.llm import languages, mixing, ngram_join, packing, private_data
from schemaweft.llm.common import settle, word_count
from schemaweft.llm.queries import table, tokenizer_path

#: Words whose ids a worker of the last stage keeps.
REMEMBERED = 200_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compress well by one language only; the rest is rejected and goes."""
    trained = languages.dictionaries(docs)
    return languages.identify(docs, trained).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with masked texts; n_chars is that of the masked text."""
    clean = private_data.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its budget: whole copies, and of one document a source its first words."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    mixed = mixing.mix(sized, size_column="_size")
    whole = F.col("copies") + F.when((F.col("cut") == F.col("_size")) & (F.col("cut") > 0), 1).otherwise(0)
    part = (F.col("cut") > 0) & (F.col("cut") < F.col("_size"))
    copies = F.when(whole > 0, F.array_repeat(F.lit(False), whole.cast("int"))).otherwise(F.array().cast("array<boolean>"))
    rows = mixed.withColumn("_part", F.explode(F.concat(copies, F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    head = F.expr(r"regexp_extract(text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', cut, '}+'), 0)")
    text = F.when(F.col("_part"), head).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece with its place and ids.

    Workers that have served the other stages hold memory already, so fewer words are remembered.
    """
    return packing.pack_apart(packing.tokenise(docs, tokenizer_path(), with_ids=True, remembered=REMEMBERED))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: The first, second and last stage have no SQL form; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
