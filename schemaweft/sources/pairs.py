"""Benchmark pairs on disk: two CSV files and a mapping JSON per pair directory.

    <root>/<dataset>/<scenario>/<pair>/<pair>_source.csv | _target.csv | _mapping.json

Each reader scans the files of all pairs at once. A ``.csv`` or ``.json`` may also be a
directory of part files, as Spark writes them.
"""

from __future__ import annotations

import csv
import io
import json
import sys

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaweft.catalog import dtype_family

# What writes a pair travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [T.StructField("source_column", T.StringType()), T.StructField("target_column", T.StringType())]
                )
            ),
        )
    ]
)

# Stands for a comma between cells: a code point that Unicode keeps out of exchanged text.
CELL_BREAK = "\ufdd0"
QUOTE = '"'


def _glob(root: str, dataset: str, scenario: str, noise_level: str | None, suffix: str) -> str:
    """The noise level prunes pair directories before any file is listed."""
    pair = "*" if noise_level is None else f"*_{noise_level}"
    return f"{root.rstrip('/')}/{dataset}/{scenario}/{pair}/*_{suffix}"


def _path_part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), pattern, group)


def _located(rows: DataFrame, kind: str) -> DataFrame:
    """Add dataset, scenario and pair_id from the path; keep files named after their pair."""
    pattern = rf"([^/]+)/([^/]+)/([^/]+)/\3_({kind})\.(?:csv|json)(?:/[^/]*)?$"
    return rows.select(
        "*",
        _path_part(pattern, 1).alias("dataset"),
        _path_part(pattern, 2).alias("scenario"),
        _path_part(pattern, 3).alias("pair_id"),
        _path_part(pattern, 4).alias("kind"),
    ).filter(F.col("pair_id") != "")


def list_pairs(
    spark: SparkSession, root: str, dataset: str, scenario: str, noise_level: str | None = None
) -> DataFrame:
    """dataset, scenario, pair_id of every pair directory; reads no file content."""
    files = (
        spark.read.format("binaryFile")
        .load(_glob(root, dataset, scenario, noise_level, "mapping.json"))
        .select("_metadata")
    )
    return _located(files, "mapping").select("dataset", "scenario", "pair_id").distinct()


def cells(record: Column) -> Column:
    """Cells of a CSV record: cut at commas outside double quotes, quotes taken off.

    Every other part between quotes is outside of them, so the work is linear in the record.
    """
    parts = F.split(record, QUOTE, -1)
    outside = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", CELL_BREAK)).otherwise(p))
    return F.transform(F.split(F.array_join(outside, QUOTE), CELL_BREAK, -1), _unquoted)


def _unquoted(cell: Column) -> Column:
    bare = F.trim(cell)
    inner = F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit(QUOTE * 2), F.lit(QUOTE))
    quoted = bare.startswith(QUOTE) & bare.endswith(QUOTE) & (F.length(bare) > 1)
    return F.when(quoted, inner).otherwise(cell)


BLOCK_KEY = ["file", "block"]


def _running(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier lines of the file.

    Inside a block of the file by a window, over its blocks by one number each, so a file of any
    size is the work of as many tasks as it has blocks.
    """
    sums = lines.groupBy(*BLOCK_KEY).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*BLOCK_KEY, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*BLOCK_KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(before, BLOCK_KEY).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """dataset, scenario, pair_id, side, file, record (number in the file), text of all CSV records.

    A line begins a record if the number of quotes before it in its file is even; one that begins
    and ends outside of quotes is a record as it stands, the others are put together. Blank lines
    between records are skipped; line breaks inside quotes become line feeds.
    """
    rows = spark.read.text(path).select("value", "_metadata")
    lines = _located(rows, "source|target").select(
        "dataset",
        "scenario",
        "pair_id",
        F.col("kind").alias("side"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", "^\ufeff", "").alias("text"),
    )
    quotes = (F.length("text") - F.length(F.translate("text", QUOTE, ""))).cast("bigint")
    counted = _running(lines.withColumn("quotes", quotes), F.col("quotes"), "quoted")
    begins = (F.col("quoted") % 2 == 0) & (F.trim("text") != "")
    flagged = counted.withColumn("begins", begins).filter(F.col("begins") | (F.col("quoted") % 2 == 1))
    numbered = _running(flagged, F.col("begins").cast("bigint"), "n_before")
    numbered = numbered.withColumn("record", F.col("n_before") + F.col("begins").cast("bigint"))
    key = ["dataset", "scenario", "pair_id", "side", "file", "record"]
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    torn = numbered.filter(~whole).groupBy(*key).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).getField("text"), "\n").alias("text")
    )
    return numbered.filter(whole).select(*key, "text").unionByName(torn)


def _dtype() -> Column:
    """Narrowest of int, float, bool and str over the values of a group that are not its header."""
    given = ~F.col("header") & (F.trim("value") != "")
    value = F.trim("value")
    n = F.count_if(given)

    def all_of(test: Column) -> Column:
        return F.count_if(given & test) == n

    return (
        F.when(F.count_if(~F.col("header")) == 0, "str")
        .when(n == 0, "float")
        .when(all_of(value.rlike(r"^[+-]?\d{1,18}$")), "int")
        .when(all_of(value.try_cast("double").isNotNull()), "float")
        .when(all_of(value.isin("True", "False", "TRUE", "FALSE", "true", "false")), "bool")
        .otherwise("str")
    )


def read_catalog(
    spark: SparkSession, root: str, dataset: str, scenario: str, noise_level: str | None = None
) -> DataFrame:
    """Catalog of all pairs from their header records, with types inferred from the values.

    Repeated header names get the suffixes .1, .2, ... and empty ones a positional name. A
    side in several part files has its header in the first. Names and types come from one
    aggregation by column; no value is joined to its header.
    """
    path = _glob(root, dataset, scenario, noise_level, "{source,target}.csv")
    keys = ["pair_id", "side"]
    listed = _located(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("_metadata"), "source|target")
    first = listed.groupBy("pair_id", F.col("kind").alias("side")).agg(F.min("_metadata.file_path").alias("file"))
    # The files' names only: a row a file.
    first = first.select(F.col("file").alias("first_file"))
    records = read_records(spark, path).join(first, F.col("file") == F.col("first_file"), "left")
    header = F.col("first_file").isNotNull() & (F.col("record") == 1)
    values = records.select(*keys, header.alias("header"), F.posexplode(cells(F.col("text"))).alias("pos", "value"))
    columns = values.groupBy(*keys, "pos").agg(
        F.max(F.when(F.col("header"), F.col("value"))).alias("cell"), _dtype().alias("dtype")
    ).filter(F.col("cell").isNotNull())
    repeats = Window.partitionBy(*keys, "cell").orderBy("pos")
    return (
        columns.withColumn("cell", F.when(F.col("cell") == "", F.concat(F.lit("Unnamed: "), "pos")).otherwise(F.col("cell")))
        .withColumn("nth", F.row_number().over(repeats) - 1)
        .select(
            *keys,
            (F.col("pos") + 1).cast("bigint").alias("ordinal"),
            F.when(F.col("nth") > 0, F.concat_ws(".", "cell", "nth")).otherwise(F.col("cell")).alias("name"),
            "dtype",
        )
    )


def read_truth(
    spark: SparkSession, root: str, dataset: str, scenario: str, noise_level: str | None = None
) -> DataFrame:
    """pair_id, src, tgt from the mapping files; other keys of the files are ignored."""
    mappings = (
        spark.read.schema(MAPPING_SCHEMA)
        .option("multiLine", True)
        .json(_glob(root, dataset, scenario, noise_level, "mapping.json"))
        .select("matches", "_metadata")
    )
    return (
        _located(mappings, "mapping")
        .select("pair_id", F.explode("matches").alias("m"))
        .select("pair_id", F.col("m.source_column").alias("src"), F.col("m.target_column").alias("tgt"))
        .distinct()
    )


def read_pair_table(spark: SparkSession, root: str, dataset: str, scenario: str, pair: str, side: str) -> DataFrame:
    """The values of one side of one pair, types inferred."""
    path = f"{root.rstrip('/')}/{dataset}/{scenario}/{pair}/{pair}_{side}.csv"
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def pair_metadata(catalog: DataFrame, dataset: str | None = None, scenario: str | None = None) -> DataFrame:
    """Number of source and target columns of every pair."""
    counts = catalog.groupBy("pair_id").agg(
        F.count_if(F.col("side") == "source").alias("n_source_cols"),
        F.count_if(F.col("side") == "target").alias("n_target_cols"),
    )
    if dataset is None and scenario is None:
        return counts
    return counts.select(F.lit(dataset).alias("dataset"), F.lit(scenario).alias("scenario"), "*")


# Two cells that a reader of types takes for what a column's dtype family is.
SAMPLES = {"integer": ("1", "-2"), "real": ("1.5", "2"), "bool": ("True", "False")}
TEXT_SAMPLE = ('a, "b"\nc', "")


def write_pairs(catalog: DataFrame, truth: DataFrame, root: str, dataset: str, scenario: str) -> int:
    """Write pairs in the layout that the readers read; the number of files written.

    Each side of a pair is a task: its header, quoted where needed, and two rows of samples; so is
    each mapping. Files are opened through ``pyarrow.fs`` under their final names, so a repeated task
    writes the same file again. A header is one record, as wide as a schema.
    """
    base = f"{root.rstrip('/')}/{dataset}/{scenario}"

    def written(pair: str, suffix: str, text: str) -> pd.DataFrame:
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(f"{folder}/{pair}", recursive=True)
        with store.open_output_stream(f"{folder}/{pair}/{pair}_{suffix}") as out:
            out.write(text.encode())
        return pd.DataFrame({"n": [1]})

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        samples = [SAMPLES.get(f, TEXT_SAMPLE) for f in rows["family"]]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([rows["name"], [s[0] for s in samples], [s[1] for s in samples]])
        return written(key[0], f"{key[1]}.csv", out.getvalue())

    def mapping(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [{"source_column": s, "target_column": t} for s, t in zip(rows["src"], rows["tgt"])]
        return written(key[0], "mapping.json", json.dumps({"matches": found}))

    sides = catalog.select("pair_id", "side", "ordinal", "name", dtype_family(F.col("dtype")).alias("family"))
    tables = sides.groupBy("pair_id", "side").applyInPandas(table, "n bigint")
    mappings = truth.select("pair_id", "src", "tgt").groupBy("pair_id").applyInPandas(mapping, "n bigint")
    return tables.unionAll(mappings).count()
