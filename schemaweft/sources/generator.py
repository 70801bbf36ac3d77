"""The base table: eight columns of repeatable values, by arithmetic on a row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.functions.values import pick

# The base schema, its value lists and ranges.
BASE_SCHEMA = (
    ("id", "int"),
    ("name", "str"),
    ("email", "str"),
    ("address_line_1", "str"),
    ("address_line_2", "str"),
    ("created_at", "datetime"),
    ("amount", "float"),
    ("status", "str"),
)
FULL_NAMES = (
    "Lionel Messi",
    "Cristiano Ronaldo",
    "Bob Allen",
    "Alice Williams",
    "Charlie Brown",
    "Diana Ross",
    "Edward Chen",
    "Fiona Garcia",
)
STREETS = ("Main St", "Oak Ave", "Pine Rd", "Cedar Ln", "Maple Dr", "Birch Blvd")
STATUSES = ("active", "inactive", "pending", "suspended")
ANCHOR = "2024-01-01 00:00:00"

MODULUS = 2147483648


def draw(key: Column, column: int, size: int, seed: int = 0) -> Column:
    """A repeatable value in [0, size): one linear congruential step per row and column."""
    start = F.pmod(key, F.lit(MODULUS - 1)) * F.lit(1103515245)
    mixed = F.pmod(start + F.lit(12345 * (column + 1) + seed), F.lit(MODULUS))
    return F.pmod(F.shiftright(mixed, 8), F.lit(size))


def base_columns(key: Column, seed: int = 0) -> dict[str, Column]:
    """Expressions of the base schema over a bigint row key."""

    def d(column: int, size: int) -> Column:
        return draw(key, column, size, seed)

    unit = (
        F.when(d(6, 3) == 0, F.concat(F.lit("Apt "), (d(7, 50) + 1).cast("string")))
        .when(d(6, 3) == 1, F.concat(F.lit("Suite "), (d(7, 401) + 100).cast("string")))
        .otherwise(F.concat(F.lit("Unit "), (d(7, 20) + 1).cast("string")))
    )
    return {
        "id": d(0, 9999) + 1,
        "name": pick(FULL_NAMES, d(1, 8)),
        "email": F.concat(F.lit("user"), (d(2, 999) + 1).cast("string"), F.lit("@example.com")),
        "address_line_1": F.concat_ws(" ", (d(3, 9900) + 100).cast("string"), pick(STREETS, d(4, 6))),
        "address_line_2": F.when(d(5, 10) < 7, F.lit("")).otherwise(unit),
        "created_at": F.lit(ANCHOR).cast("timestamp_ntz")
        - F.make_dt_interval(days=d(8, 366).cast("int")),
        "amount": (d(9, 99001) + 1000) / F.lit(100.0),
        "status": pick(STATUSES, d(10, 4)),
    }


def base_table(keys: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """``row_key`` and the eight base columns for every key."""
    at = F.col(key).cast("bigint")
    return keys.select(at.alias("row_key"), *[c.alias(n) for n, c in base_columns(at, seed).items()])


def sample_table(spark: SparkSession, n_rows: int = 50, seed: int = 0) -> DataFrame:
    """``n_rows`` rows of the base schema."""
    return base_table(spark.range(n_rows), "id", seed).drop("row_key")


def base_catalog(pairs: DataFrame) -> DataFrame:
    """The base schema as the source side of every ``pair_id``."""
    columns = F.array(
        *[
            F.struct(F.lit(i + 1).cast("bigint").alias("ordinal"), F.lit(n).alias("name"), F.lit(t).alias("dtype"))
            for i, (n, t) in enumerate(BASE_SCHEMA)
        ]
    )
    return pairs.select("pair_id", F.lit("source").alias("side"), F.inline(columns))
