"""Each document beside the next one, with its texts moved once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.llm.common import positions, settle

MOST_RANGES = 16_384


def _sortable(number: Column) -> Column:
    """A bigint as 16 hexadecimal digits that sort as it does."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def _order(doc_id: Column, text: Column) -> Column:
    """A string that sorts by descending id, NULL last, then by a hash of the text."""
    down = F.when(doc_id.isNull(), F.lit("n" + "0" * 16)).otherwise(F.concat(F.lit("d"), _sortable(F.bitwise_not(doc_id.cast("long")))))
    return F.concat(down, _sortable(F.xxhash64(text)))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are not above ``key``, by bisection."""
    steps = [2**k for k in reversed(range(max(1, len(bounds).bit_length())))]
    table = F.split(F.lit(",".join(bounds)), ",") if bounds else F.array().cast("array<string>")

    def step(low: Column, width: Column) -> Column:
        return F.when(F.get(table, low + width - 1) <= key, low + width).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, rows: int = 20_000) -> DataFrame:
    """doc_id, text, next_doc_id, next_text: of ``docs`` (doc_id, text) by descending doc_id.

    After the last document comes the first; a single one is its own next. NULL ids come last, a
    NULL text is an empty one. Of equal ids the hash of the text decides, and every row of equal
    ones counts, so that each but the last has its like as next. Other columns go; an empty table
    gives an empty one.

    Ranges of about ``rows`` documents (longer ones where there would be over 16,384) are bounded
    by what a pass over ids and hashes finds. In each the next document is the next row; the
    first one of the range that follows is put in behind the last.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), _order(F.col("doc_id"), text).alias("order"))
    # Which of equal rows goes to which range is free, so this number need not be the same in two readings.
    own = own.withColumn("key", F.concat("order", F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
    thin = settle(own.select("key"))
    n = thin.count()
    step = max(rows, math.ceil(n / MOST_RANGES))
    cuts = positions(thin, [], [F.col("key")]).filter(F.col("pos") % step == 0).select("key").orderBy("key")
    ranged = own.withColumn("range", _range_of(F.col("key"), [r.key for r in cuts.collect()]))
    begins = ranged.groupBy("range").agg(F.min("order").alias("begin")).orderBy("range").collect()
    before = {r.begin: [] for r in begins}
    for r, follower in zip(begins, begins[1:] + begins[:1]):
        before[follower.begin].append(r.range)
    # At most one row a range; a document may begin several where equal rows fill them.
    listed = ",".join(f"{begin}:{i}" for begin, of in before.items() for i in of)
    places = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(listed), ",")).alias("place")).filter("place != ''").select(
        F.substring_index("place", ":", 1).alias("begin"), F.substring_index("place", ":", -1).cast("int").alias("range")
    )
    firsts = own.join(F.broadcast(places), F.col("order") == F.col("begin")).filter(F.col("range").isNotNull()).dropDuplicates(["range"])
    behind = firsts.select("doc_id", "text", F.lit("z").alias("key"), "range")
    every = ranged.select("doc_id", "text", "key", "range").unionByName(behind)
    order = Window.partitionBy("range").orderBy("key")
    following = F.lead(F.struct("doc_id", "text")).over(order)
    return (
        every.select("doc_id", "text", "key", following.alias("following"))
        .filter(F.col("key") != "z")
        .select("doc_id", "text", F.col("following.doc_id").alias("next_doc_id"), F.col("following.text").alias("next_text"))
    )
