"""Set-overlap join inside schema pairs through an inverted index.

Columns carry small element sets (word tokens). Two columns of one pair meet
only at their rarest common element, so a candidate is produced once and frequent
elements are met only by columns that have nothing rarer in common. Postings of an
element that many columns share are cut into a grid of cells of bounded size, so no task
gets a whole hot element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.session import merged

ELEMENT_KEY = ["pair_id", "elem"]


def rare_first(sets: DataFrame) -> DataFrame:
    """Order each set rarest element first, keeping elements that occur on both sides.

    ``sets``: pair_id, side, ord, name, elems, plus any payload columns named in the
    frame. Returns one row per column that shares an element with the other side, with
    ``elems`` as array<struct<n_tgt, elem, n_src>>.
    """
    payload = [c for c in sets.columns if c not in ("pair_id", "side", "ord", "elems")]
    single = sets.withColumn("elem", F.explode("elems")).drop("elems")
    is_source = F.col("side") == "source"
    stats = (
        single.groupBy(*ELEMENT_KEY)
        .agg(F.count_if(~is_source).alias("n_tgt"), F.count_if(is_source).alias("n_src"))
        .filter((F.col("n_tgt") > 0) & (F.col("n_src") > 0))
    )
    return (
        single.join(merged(stats), ELEMENT_KEY)
        .groupBy("pair_id", "side", "ord", *payload)
        .agg(F.sort_array(F.collect_list(F.struct("n_tgt", "elem", "n_src"))).alias("elems"))
    )


def _cells(count: Column, cell: int) -> Column:
    return F.ceil(count / F.lit(float(cell))).cast("int")


def meet(
    src: DataFrame, tgt: DataFrame, keep: Column, condition: Column, cell: int = 4096, start: Column | None = None
) -> DataFrame:
    """Join source sets to target sets at their rarest common element.

    ``src``: pair_id, src_ord, elems (rare-first structs) and payload; ``tgt`` alike with
    tgt_ord. ``keep`` is the number of leading source elements to look up; with ``start``, those
    before it are not, and pairs that share one of them are left out. ``condition``
    may use payload columns of both sides and ``ub``, an upper bound of the overlap.
    Adds ``overlap``, the exact number of common elements.
    """
    left = (
        src.withColumn("keep", keep)
        .filter(F.col("keep") > 0)
        .withColumn("s_elems", F.transform("elems", lambda e: e.elem))
        .select("*", F.posexplode(F.slice("elems", F.lit(1), F.col("keep").cast("int"))).alias("i", "e"))
        .withColumn("s_left", F.size("s_elems") - F.col("i"))
    )
    if start is not None:
        left = left.filter(F.col("i") >= start)
    right = (
        tgt.withColumn("t_elems", F.transform("elems", lambda e: e.elem))
        .select("*", F.posexplode("elems").alias("j", "e"))
        .withColumn("t_left", F.size("t_elems") - F.col("j"))
    )
    # Source rows own a row of the grid and visit every column of it; targets vice versa.
    left = left.select(
        *[c for c in left.columns if c not in ("elems", "e", "keep", "i")],
        F.col("e.elem").alias("elem"),
        F.pmod(F.xxhash64("src_ord"), _cells(F.col("e.n_src"), cell)).cast("int").alias("grid_row"),
        F.explode(F.sequence(F.lit(0), _cells(F.col("e.n_tgt"), cell) - 1)).alias("grid_col"),
    )
    right = right.select(
        *[c for c in right.columns if c not in ("elems", "e", "j")],
        F.col("e.elem").alias("elem"),
        F.pmod(F.xxhash64("tgt_ord"), _cells(F.col("e.n_tgt"), cell)).cast("int").alias("grid_col"),
        F.explode(F.sequence(F.lit(0), _cells(F.col("e.n_src"), cell) - 1)).alias("grid_row"),
    )
    bounded = left.join(merged(right), [*ELEMENT_KEY, "grid_row", "grid_col"]).withColumn(
        "ub", F.least("s_left", "t_left")
    )
    return (
        bounded.filter(condition)
        .withColumn("common", F.array_intersect("s_elems", "t_elems"))
        .filter(F.element_at("common", 1) == F.col("elem"))
        .withColumn("overlap", F.size("common"))
        .drop("common", "s_elems", "t_elems", "s_left", "t_left", "grid_row", "grid_col", "elem", "ub")
    )
