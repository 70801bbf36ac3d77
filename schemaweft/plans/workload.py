"""Catalogs derived from the provided tables.

* Document catalog: every document is a column of the table that its source wrote; its name
  comes from the words of the text.
* Tenant catalog: every customer is a tenant with its own copy of the base schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.functions import names
from schemaweft.functions.values import JUNK_COLUMNS, JUNK_DTYPES
from schemaweft.operators import legacy
from schemaweft.sources.generator import base_catalog

# Abbreviations of words that are frequent in the documents.
WORD_ABBREVIATIONS = {
    "with": "wth",
    "and": "nd",
    "anan": "ann",
    "was": "ws",
    "als": "as",
    "anble": "anbl",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_name(text: Column, lang: Column) -> Column:
    """First, longest and last word of the whole text, by code points; words are runs of letters."""
    # A text repeats its words: they are told apart before each is looked at.
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")

    def joined(ws: Column) -> Column:
        longest = F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
        return F.concat_ws("_", F.array_min(ws), longest, F.array_max(ws))

    # Binding the word list to a lambda variable splits the text once, not once per use.
    name = F.transform(F.array(words), joined)[0]
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(lang, F.lit("_text")))


# The dtype of a column by the language of its document.
DTYPE_OF_LANG = {"en": "string", "fr": "double", "de": "bigint"}


def document_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, ordinal, name, dtype, new_name (NULL if dropped): one row per column.

    The text is read and reduced to a name in one projection; only these short rows are
    shuffled. Of equal names in one schema the smallest document id stays. German names
    get the table prefix, French ones lose their vowels, Spanish ones are upper-cased,
    English ones of good quality are abbreviated; toxic documents are dropped.
    """
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    documents = texts.select(
        F.coalesce("source", F.lit("")).alias("pair_id"),
        "doc_id",
        "lang",
        "source",
        column_name(F.col("text"), F.col("lang")).alias("name"),
    )
    unique = documents.groupBy("pair_id", "name").agg(
        F.min(F.struct("doc_id", "lang", "source")).alias("first")
    ).select("pair_id", "name", "first.*")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    lang, name = F.col("lang"), F.col("name")
    renamed = (
        F.when(lang == "de", names.table_prefix(name, F.col("source")))
        .when(lang == "fr", names.strip_vowels(name))
        .when(lang == "es", names.case_flip(name))
        .when(F.col("quality") == 1, names.abbreviate(name, WORD_ABBREVIATIONS))
        .otherwise(name)
    )
    dtype = F.lit("timestamp")
    for code, spark_type in DTYPE_OF_LANG.items():
        dtype = F.when(lang == code, spark_type).otherwise(dtype)
    return unique.join(labels, "doc_id", "left").select(
        "pair_id",
        F.col("doc_id").alias("ordinal"),
        "name",
        dtype.alias("dtype"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, renamed).alias("new_name"),
    )


def document_catalog(columns: DataFrame) -> DataFrame:
    """Both sides: the columns, and their kept and renamed versions with junk appended.

    Of equal target names in a pair the smallest ordinal stays.
    """
    side = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("name").alias("n")),
            F.struct(F.lit("target").alias("side"), F.col("new_name").alias("n")),
        )
    )
    own = (
        columns.select("pair_id", "ordinal", "dtype", side.alias("c"))
        .filter(F.col("c.n").isNotNull())
        .groupBy("pair_id", "c.side", F.col("c.n").alias("name"))
        .agg(F.min(F.struct("ordinal", "dtype")).alias("first"))
        .select("pair_id", "side", "first.ordinal", "name", "first.dtype")
    )
    junk = F.array(
        *[
            F.struct(
                F.lit("target").alias("side"),
                F.lit(legacy.JUNK_ORDINAL + i).alias("ordinal"),
                F.lit(n).alias("name"),
                F.lit(t).alias("dtype"),
            )
            for i, (n, t) in enumerate(zip(JUNK_COLUMNS, JUNK_DTYPES))
        ]
    )
    appended = columns.select("pair_id").distinct().select("pair_id", F.inline(junk))
    return own.unionByName(appended)


def document_truth(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("new_name").isNotNull()).select(
        "pair_id", F.col("name").alias("src"), F.col("new_name").alias("tgt")
    )


def document_lineage(columns: DataFrame) -> DataFrame:
    """Truth rows, and one row with a NULL source per junk target."""
    junk = (
        columns.select("pair_id")
        .distinct()
        .select("pair_id", F.lit(None).cast("string").alias("src"), F.explode(F.array(*map(F.lit, JUNK_COLUMNS))).alias("tgt"))
    )
    return document_truth(columns).unionByName(junk)


def tenant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("pair_id"))


def tenant_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source catalog of all tenants and its state after the standard steps."""
    catalog = base_catalog(tenant_pairs(spark, sf_dir))
    return catalog, legacy.apply_steps(legacy.initial_state(catalog))
