"""What several operators share: words, shared tables, bounded joins, positions in groups, workers' memory."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.session import settle, shared_folder

__all__ = ["settle", "shared_folder", "words", "word_count", "lower_ascii", "join_small", "positions", "text_key", "retained", "tidy"]

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; an empty array for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """Identity of a text (NULL as the empty text), for joins that need not carry it."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def join_small(df: DataFrame, small: DataFrame, condition, how: str = "left", limit: int = 50_000) -> DataFrame:
    """Join with a settled table that is broadcast only while it is known to have few rows.

    Beyond ``limit`` rows Spark plans the join as it likes and splits hot keys itself.
    """
    return df.join(F.broadcast(small) if small.count() <= limit else small, condition, how)


def positions(df: DataFrame, group: list[str], order: list, rows: int = 100_000) -> DataFrame:
    """``df`` with ``pos``: 1, 2, ... within each group in the order given.

    Rows are dealt out by range of (group, order), so a group of any size is spread over many
    ranges of about ``rows`` rows. Only the first group of a range can have begun in an earlier
    one: what it had there is one number per range. Rows equal in group and order may swap.
    """
    spark = df.sparkSession
    df = settle(df)
    n = max(1, math.ceil(df.count() / rows))
    ranged = settle(df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(
        F.col("_range").alias("_r"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.sum("_n").over(before).alias("_before"),
    ).filter(F.col("_before").isNotNull())
    condition = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        condition &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    numbered = join_small(ranged.withColumn("_own", own), settle(carried), condition)
    pos = (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long")
    return numbered.select(*df.columns, pos.alias("pos"))


_RETAINED: dict[Any, Any] = {}


def retained(step: Any, make: Callable[[], Any] = dict) -> Any:
    """What ``step`` keeps in its worker between tasks, made once.

    Workers outlive stages and serve the next ones, so what another step kept is dropped.
    """
    if step not in _RETAINED:
        _RETAINED.clear()
        _give_back()
        _RETAINED[step] = make()
    return _RETAINED[step]


def _give_back() -> None:
    """Hand what was freed back to the system: allocators hold on to it, and a worker idles or serves on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory is handed back as each is done with and when the task is."""
    try:
        for batch in batches:
            yield batch
            del batch
            _give_back()
    finally:
        _give_back()
