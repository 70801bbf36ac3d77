"""Column expressions over cell values: the value side of the legacy transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that the junk step appends, with their value lists.
JUNK_COLUMNS = ("LEGACY_FLAG", "INTERNAL_CODE", "MIGRATION_BATCH")
JUNK_DTYPES = ("int", "str", "str")
INTERNAL_CODES = ("A102", "B205", "C307", "X999")
MIGRATION_BATCHES = ("batch_01", "batch_02", "batch_03")


def date_as_int(value: Column) -> Column:
    """yyyyMMdd as an integer, by arithmetic so that it stays in generated code."""
    return F.year(value) * 10000 + F.month(value) * 100 + F.dayofmonth(value)


def minor_units(value: Column) -> Column:
    """Amount times 100, truncated toward zero; bigint so that large amounts fit."""
    return (value * 100).cast("bigint")


def _words(value: Column) -> Column:
    stripped = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.split(stripped, r"(?U)\s+")


def first_word(value: Column) -> Column:
    """First whitespace token; NULL and blank give the empty string."""
    return F.coalesce(F.try_element_at(_words(value), F.lit(1)), F.lit(""))


def last_word(value: Column) -> Column:
    """Last whitespace token if there are two or more, else the empty string."""
    words = _words(value)
    return F.when(F.size(words) > 1, F.element_at(words, -1)).otherwise(F.lit(""))


def merged_lines(line_1: Column, line_2: Column) -> Column:
    return F.when(
        F.coalesce(line_2, F.lit("")) != "", F.concat(line_1, F.lit(", "), line_2)
    ).otherwise(line_1)


def pick(values: tuple, index: Column) -> Column:
    """Element of a literal list by a zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def junk_values(key: Column) -> dict[str, Column]:
    """Values of the junk columns, repeatable arithmetic on a row key."""
    legacy_flag = F.pmod(key, F.lit(2)).cast("int")
    internal_code = pick(INTERNAL_CODES, F.pmod(key, F.lit(4)))
    migration_batch = pick(MIGRATION_BATCHES, F.pmod(key, F.lit(3)))
    return dict(zip(JUNK_COLUMNS, (legacy_flag, internal_code, migration_batch)))
