"""Top-k targets per source over the whole pair, on a grid of bounded cells.

Every source of a pair has to be ranked against every target of it. The work is cut into
cells of at most about ``src_cell`` x ``tgt_cell`` columns, so a pair that holds a third
of the catalog is many tasks, none of them large, and a cell returns at most ``k`` rows
per source, never its product. Targets are chunked by size (name length, number of
trigrams), so that a source skips the chunks whose sizes cannot reach the score it has.

Narrow pairs share a cell: they are put into lots of about a cell's size, so thousands of
small schemas do not become thousands of tiny tasks.

A source first meets its home chunk. A pair with one chunk is then done; in a wider one
the k-th home score is the bar for the other chunks of the pair.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.catalog import PREDICTION_COLUMNS, dtype_family, no_predictions, sources, targets
from schemaweft.operators.ranking import SOURCE_KEY, ranked
from schemaweft.session import merged, settle

# The cell functions travel with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: More pairs than these are not sent to every executor.
MANY_PAIRS = 10_000

CELL_KEY = ["lot", "grid_row", "band", "chunk"]
CELL_SCHEMA = "pair_id string, src_ord bigint, src string, tgt_ord bigint, tgt string, score double"

# (target texts, their smallest ordinals, {source text: bar}, k) -> (source text, [(target index, score)])
Scorer = Callable[[list[str], list[int], dict[str, float], int], Iterator[tuple[str, list[tuple[int, float]]]]]


def pair_plans(sized: DataFrame, src_cell: int, tgt_cell: int) -> DataFrame:
    """One row per pair: its grid rows and the size bands of its targets.

    ``sized``: pair_id, side, size. Bands are half octaves of the size, so there are few
    per pair; targets that fit one cell form a single band.
    """
    band = F.floor(2 * F.log2(F.col("size") + 1)).cast("int")
    is_target = F.col("side") == "target"
    per_band = sized.groupBy("pair_id", band.alias("band")).agg(
        F.count_if(is_target).alias("n"),
        F.count_if(~is_target).alias("n_src"),
        F.min(F.when(is_target, F.col("size"))).alias("lo"),
        F.max(F.when(is_target, F.col("size"))).alias("hi"),
    )
    chunks = F.ceil(F.col("n") / F.lit(float(tgt_cell))).cast("int")
    plans = per_band.groupBy("pair_id").agg(
        F.ceil(F.sum("n_src") / F.lit(float(src_cell))).cast("int").alias("n_rows"),
        F.sum("n").alias("n_tgt"),
        F.sum("n_src").alias("n_src"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sort_array(
            F.collect_list(F.when(F.col("n") > 0, F.struct("band", chunks.alias("n_chunks"), "lo", "hi")))
        ).alias("bands"),
    )
    one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(1).alias("n_chunks"), "lo", "hi"))
    fits = F.col("n_tgt") <= tgt_cell
    return plans.filter((F.col("n_rows") > 0) & (F.col("n_tgt") > 0)).select(
        "pair_id",
        "n_rows",
        F.col("n_src"),
        F.col("n_tgt"),
        F.when(fits, one).otherwise(F.col("bands")).alias("bands"),
        (~fits).alias("wide"),
    )


def with_lots(plans: DataFrame, src_cell: int, tgt_cell: int) -> tuple[DataFrame, bool]:
    """Add ``lot``: the pair itself, or the lot that it shares with other narrow pairs.

    A pair is narrow if it fits one cell eight times. The number of lots follows from the
    number of columns in narrow pairs, so a lot stays about one cell large. Also tells
    whether any pair is wide. Plans of many pairs are joined by merging: their files are
    small, the rows in them are not.
    """
    narrow = (F.col("n_rows") == 1) & (F.col("n_src") * 8 <= src_cell) & (F.col("n_tgt") * 8 <= tgt_cell)

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(narrow, F.col(column))), F.lit(0))

    cells = F.greatest(total("n_src") / src_cell, total("n_tgt") / tgt_cell)
    whole = plans.agg(
        cells.alias("cells"), F.coalesce(F.bool_or("wide"), F.lit(False)).alias("wide"), F.count("*").alias("n")
    ).first()
    lots = max(1, math.ceil(whole["cells"]))
    shared = F.concat(F.lit("lot "), F.pmod(F.xxhash64("pair_id"), F.lit(lots)).cast("string"))
    lot = F.when(narrow, shared).otherwise(F.concat(F.lit("pair "), "pair_id"))
    located = plans.withColumn("lot", lot)
    return (merged(located) if whole["n"] > MANY_PAIRS else located), whole["wide"]


def cell_tasks(spark: SparkSession) -> int:
    """Tasks for the cells: the session's shuffle width, at least two per core."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(width, 2 * spark.sparkContext.defaultParallelism)


def _located(src: DataFrame, plans: DataFrame, reach: Callable[[Column, Column], Column], *more: str) -> DataFrame:
    """Sources with their grid row, the largest score that every band allows by its sizes,
    and the band and chunk that they visit first."""
    size = F.col("size")

    def visit(b: Column) -> Column:
        nearest = F.least(F.greatest(size, b.lo), b.hi)
        return F.struct(
            reach(size, nearest).alias("reach"), b.band.alias("band"), b.n_chunks.alias("n_chunks")
        )

    return (
        src.join(plans, "pair_id")
        .select(
            "lot",
            "pair_id",
            "src_ord",
            "src",
            "low",
            "wide",
            *more,
            F.pmod(F.xxhash64("src_ord"), "n_rows").cast("int").alias("grid_row"),
            F.transform("bands", visit).alias("visits"),
        )
        .withColumn("first", F.array_max("visits"))
        .withColumn("home_chunk", F.pmod(F.xxhash64("src_ord"), F.col("first.n_chunks")).cast("int"))
    )


def _home_visits(located: DataFrame) -> DataFrame:
    return located.select(
        "lot",
        "grid_row",
        F.col("first.band").alias("band"),
        F.col("home_chunk").alias("chunk"),
        "pair_id",
        "src_ord",
        "src",
        "low",
        F.lit(0.0).alias("bar"),
    )


def _other_visits(located: DataFrame, bars: DataFrame) -> DataFrame:
    """All chunks of a wide pair but the home chunk, if they can reach the source's bar."""
    everywhere = (
        located.filter("wide")
        .join(merged(bars), SOURCE_KEY, "left")
        .withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        .withColumn("visit", F.explode("visits"))
        .filter(F.col("visit.reach") >= F.col("bar"))
        .withColumn("band", F.col("visit.band"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("visit.n_chunks") - 1)))
    )
    at_home = (F.col("band") == F.col("first.band")) & (F.col("chunk") == F.col("home_chunk"))
    return everywhere.filter(~at_home)


def _placed(tgt: DataFrame, plans: DataFrame, *more: str) -> DataFrame:
    """Targets in their chunk, once per grid row of their pair."""
    size = F.col("size")
    own = F.filter("bands", lambda b: (b.lo <= size) & (size <= b.hi))[0]
    return (
        tgt.join(plans, "pair_id")
        .withColumn("own", own)
        .withColumn("band", F.col("own.band"))
        .withColumn("chunk", F.pmod(F.xxhash64("tgt_ord"), F.col("own.n_chunks")).cast("int"))
        .withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
        .select(*CELL_KEY, "pair_id", "tgt_ord", "tgt", "low", "wide", *more)
    )


def _cell_function(scorer: Scorer, k: int):
    def targets_by_text(rows: list[tuple]) -> dict[str, list[tuple[int, str]]]:
        """Equal lower-case targets score alike, so only their first k by ordinal count."""
        holders: dict[str, list[tuple[int, str]]] = {}
        for ordinal, name, low in sorted(rows):
            same = holders.setdefault(low, [])
            if len(same) < k:
                same.append((ordinal, name))
        return holders

    def by_pair(df: pd.DataFrame, *columns: str) -> dict[str, list[tuple]]:
        rows: dict[str, list[tuple]] = {}
        for pair_id, *values in zip(df["pair_id"], *(df[c] for c in columns)):
            rows.setdefault(pair_id, []).append(tuple(values))
        return rows

    def cell(src: pd.DataFrame, tgt: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        scored: dict[tuple, list] = {}
        tgt_rows = by_pair(tgt, "tgt_ord", "tgt", "low")
        for pair_id, src_rows in by_pair(src, "src_ord", "src", "low", "bar").items():
            holders = targets_by_text(tgt_rows.get(pair_id, []))
            if not holders:
                continue
            sharing: dict[str, list[tuple[int, str]]] = {}
            bars: dict[str, float] = {}
            for ordinal, name, low, bar in src_rows:
                sharing.setdefault(low, []).append((ordinal, name))
                bars[low] = min(bar, bars.get(low, bar))
            texts = list(holders)
            firsts = [holders[t][0][0] for t in texts]
            # Pairs of a lot often repeat a schema; its names are scored once.
            problem = (tuple(texts), tuple(firsts), tuple(bars.items()))
            if problem not in scored:
                scored[problem] = list(scorer(texts, firsts, bars, k))
            for text, best in scored[problem]:
                cut = sorted((-score, o, n) for i, score in best for o, n in holders[texts[i]])[:k]
                for src_ord, src_name in sharing[text]:
                    found.extend((pair_id, src_ord, src_name, o, n, -score) for score, o, n in cut)
        return pd.DataFrame(found, columns=["pair_id", "src_ord", "src", "tgt_ord", "tgt", "score"])

    return cell


def _dealt(left: DataFrame, right: DataFrame):
    """The sources and targets of every cell, grouped.

    Cells are few bytes and much work: sized by bytes they would end in too few tasks. toDF
    gives the right side, which shares the plan table, columns of its own.
    """
    n_tasks = cell_tasks(left.sparkSession)
    left = left.repartition(n_tasks, *CELL_KEY)
    right = right.toDF(*right.columns).repartition(n_tasks, *CELL_KEY)
    return left.groupBy(*CELL_KEY), right.groupBy(*CELL_KEY)


def _cell_join(left: DataFrame, right: DataFrame, cell, schema: str) -> DataFrame:
    """``cell`` over the sources and targets of every cell."""
    left, right = _dealt(left, right)
    return left.cogroup(right).applyInPandas(cell, schema)


def grid_every(catalog: DataFrame, cell, schema: str, src_cell: int, tgt_cell: int) -> tuple[DataFrame, bool]:
    """``cell(sources, targets)`` on Arrow tables so that every source meets every target of its pair once.

    For results that need the whole product but not its rows: a cell sums up what it sees. Sources
    come as pair_id, src_ord, src, low, src_family; targets as pair_id, tgt_ord, tgt, low, family, wide. Also tells
    whether any pair is wide, so that its sources are in several cells.
    """
    low, one_size, family = F.lower("name").alias("low"), F.lit(0).alias("size"), dtype_family(F.col("dtype"))
    src = catalog.filter(F.col("side") == "source").select(
        "pair_id", F.col("name").alias("src"), F.col("ordinal").cast("bigint").alias("src_ord"), low, one_size,
        family.alias("src_family"),
    )
    tgt = catalog.filter(F.col("side") == "target").select(
        "pair_id", F.col("name").alias("tgt"), F.col("ordinal").cast("bigint").alias("tgt_ord"), low, one_size,
        family.alias("family"),
    )
    sized = catalog.select("pair_id", "side", one_size)
    plans, any_wide = with_lots(settle(pair_plans(sized, src_cell, tgt_cell)), src_cell, tgt_cell)
    located = _located(src, plans, lambda a, b: F.lit(1.0), "src_family").withColumn("visit", F.explode("visits"))
    visits = located.withColumn("band", F.col("visit.band")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("visit.n_chunks") - 1))
    )
    left = visits.select(*CELL_KEY, "pair_id", "src_ord", "src", "low", "src_family")
    right = _placed(tgt, plans, "family").select(*CELL_KEY, "pair_id", "tgt_ord", "tgt", "low", "family", "wide")
    left, right = _dealt(left, right)
    return left.cogroup(right).applyInArrow(cell, schema), any_wide


def grid_top_k(
    catalog: DataFrame,
    k: int,
    scorer: Scorer,
    size: Column,
    reach: Callable[[Column, Column], Column],
    src_cell: int = 256,
    tgt_cell: int = 4096,
) -> DataFrame:
    """Predictions of the exact top-k by ``scorer`` over all targets of every pair.

    ``size`` is an expression over ``low``, the lower-case name, and ``reach`` bounds the
    score of two names by their sizes.
    """
    if k <= 0:
        return no_predictions(catalog)
    src = sources(catalog).withColumn("low", F.lower("src")).withColumn("size", size)
    tgt = targets(catalog).withColumn("low", F.lower("tgt")).withColumn("size", size)
    sized = catalog.select("pair_id", "side", F.lower("name").alias("low")).select("pair_id", "side", size.alias("size"))
    plans, any_wide = with_lots(settle(pair_plans(sized, src_cell, tgt_cell)), src_cell, tgt_cell)
    located, placed = _located(src, plans, reach), _placed(tgt, plans)
    cell = _cell_function(scorer, k)
    left_columns = [*CELL_KEY, "pair_id", "src_ord", "src", "low", "bar"]
    right_columns = [*CELL_KEY, "pair_id", "tgt_ord", "tgt", "low"]

    def compare(left: DataFrame, right: DataFrame) -> DataFrame:
        return _cell_join(left.select(*left_columns), right.select(*right_columns), cell, CELL_SCHEMA)

    columns = PREDICTION_COLUMNS[:-1]
    home = compare(_home_visits(located), placed).select(*columns)
    if not any_wide:
        return ranked(home, k)
    home = settle(home)
    bars = (
        ranked(home, k).filter(F.col("rank") == k).select(*SOURCE_KEY, F.col("score").alias("bar"))
    )
    others = compare(_other_visits(located, bars), placed.filter("wide")).select(*columns)
    return ranked(home.unionByName(others), k)
