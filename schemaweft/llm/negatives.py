"""Hard negatives by rotated one-bit codes.

Vectors are turned by a fixed random rotation. A code keeps the signs of a rotated vector, and with it
the vector's alignment: the length of its shadow on those signs. What the code leaves is coded
again by the same rule, a few times; the length of the last rest is kept. Between two coded vectors, counts of
differing bits give an estimate of the inner product, and by Cauchy-Schwarz the true one is no
further away than the rests allow. Rows whose interval cannot hold a wanted score are left out; the
others get their integer score, so results are exact.

Anchors and vectors meet in blocks: cells of bounded size, whatever the table and its labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.llm.common import settle

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256
#: Codes of a stored vector and of an anchor; more of them make intervals narrower.
LEVELS, ANCHOR_LEVELS = 4, 6
#: Components in a chunk of vectors and in a block of anchors; anchors scored at a time.
CHUNK_VALUES, BLOCK_VALUES = 1 << 18, 1 << 20
STEP = 64
SEED = 20
#: Integers are exact in doubles up to here.
EXACT = 2.0**53
#: Bounds of a bigint; scores beyond them count as the bound.
LEAST, MOST = -(2**63), 2**63 - 1
INDEX = "row bigint, vec_id bigint, label bigint, dim int, q binary, codes binary, figures binary"


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of ``x``, padded to a power of two of at least 64, turned by random signs and Hadamard steps."""
    width = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, width]).integers(0, 2, (2, width)) * 2.0 - 1
    for turn in signs:
        out *= turn
        span = 1
        while span < width:
            pairs = out.reshape(len(x), -1, 2, span)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
            span *= 2
        out /= math.sqrt(width)
    return out


def coded(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes as uint64 [row, level, word], figures [row, alignment... , |rest|, |coded part|, |row|])."""
    rest = rotated(x)
    whole = rest.copy()
    codes, figures = [], []
    for _ in range(levels):
        signs = rest >= 0
        alignment = np.abs(rest).mean(1)
        rest = rest - np.where(signs, alignment[:, None], -alignment[:, None])
        codes.append(np.packbits(signs, axis=1).view("<u8"))
        figures.append(alignment)
    figures += [np.linalg.norm(rest, axis=1), np.linalg.norm(whole - rest, axis=1), np.linalg.norm(whole, axis=1)]
    return np.stack(codes, 1), np.stack(figures, 1)


def intervals(anchors: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products [anchor, vector], and how far off they can be."""
    (c, f), (b, g) = anchors, vectors
    width = 64 * c.shape[2]
    estimate = np.zeros((len(c), len(b)))
    for level in range(b.shape[1]):
        own = np.zeros_like(estimate)
        for m in range(c.shape[1]):
            differ = np.zeros(estimate.shape, np.uint16)
            for w in range(c.shape[2]):
                differ += np.bitwise_count(c[:, None, m, w] ^ b[None, :, level, w])
            own += f[:, m, None] * (width - 2.0 * differ)
        estimate += own * g[None, :, level]
    rest, near, norm = g[:, -3], g[:, -2], g[:, -1]
    # <x, y> = <coded x, coded y> + <coded x, rest of y> + <rest of x, y>; the last part covers rounding.
    off = norm_times(rest, f[:, -1]) + norm_times(near, f[:, -3]) + 1e-9 * norm_times(norm, f[:, -1]) + 1e-3
    return estimate, off


def norm_times(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return anchors[:, None] * rows[None, :]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of vector ``a`` with the rows of ``b``, exact at any size."""
    if len(b) == 0 or np.abs(a).max() * np.abs(b).max() * len(a) < EXACT:
        return (b @ a).astype(np.int64)
    whole = [int(x) for x in a]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in b]
    return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)


def first_rows(k: int, rows, estimate, off, ids, scored: Callable[[np.ndarray], np.ndarray], low=-math.inf, high=math.inf):
    """(rows, scores) of the first ``k`` of ``rows`` by score within [low, high], ties by id.

    The best estimates are scored first; where k of them are good, the k-th is a bar for the rest.
    """
    top = estimate + off
    rows = rows[(top[rows] >= low) & (estimate[rows] - off[rows] <= high)]
    near = rows[estimate[rows] <= high]
    if len(near) > 2 * k:
        seeds = near[np.argpartition(-estimate[near], 2 * k)[: 2 * k]]
        good = scored(seeds)
        good = good[(good >= low) & (good <= high)]
        if len(good) >= k:
            low = max(low, int(np.partition(good, len(good) - k)[len(good) - k]))
            rows = rows[top[rows] >= low]
    scores = scored(rows)
    fits = (scores >= low) & (scores <= high)
    rows, scores = rows[fits], scores[fits]
    # Negating the least bigint would overflow; -1 - s orders the same way.
    best = np.lexsort((ids[rows], -1 - scores))[:k]
    return rows[best], scores[best]


def _values(column, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(q, "<f4" if len(q) == 4 * dim else "<f8") for q in column.to_pylist()], np.float64).reshape(-1, dim)


def index(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The stored codes of ``vectors`` (vec_id, label, embedding): integers, codes and figures of each row."""

    def encode(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                q = np.floor(scale * np.array(some["x"].to_pylist(), np.float64))
                codes, figures = coded(q, LEVELS)
                small = np.abs(q).max(1) < 2**24
                raw = [row.astype("<f4" if s else "<f8").tobytes() for row, s in zip(q, small, strict=True)]
                columns = [some["row"], some["vec_id"], some["label"], some["dim"], pa.array(raw, pa.binary())]
                columns += [pa.array([r.tobytes() for r in part], pa.binary()) for part in (codes, figures.astype("<f8"))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "dim", "q", "codes", "figures"])

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    taken = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    taken = taken.filter((F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    rows = taken.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.size("embedding").alias("dim"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    return settle(rows.mapInArrow(encode, INDEX))


def _cells(anchors: DataFrame, vectors: DataFrame, blocks: int, chunks: int, schema: str, find) -> DataFrame:
    """``find`` over every cell: a block of anchors with a chunk of vectors of the same length."""

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        # Both sides come from one table; aliases tell their columns apart.
        return placed.select(*[F.col(c).alias(c) for c in placed.columns])

    key = ["dim", "block", "chunk"]
    left, right = dealt(anchors, "block", blocks, "chunk", chunks), dealt(vectors, "chunk", chunks, "block", blocks)

    def scored(a: pa.Table, v: pa.Table) -> pa.Table:
        rows = []
        if a.num_rows and v.num_rows:
            dim = v["dim"][0].as_py()
            mine, theirs = _values(a["q"], dim), _values(v["q"], dim)
            words = max(64, 1 << (dim - 1).bit_length()) // 64
            codes = np.array([np.frombuffer(c, "<u8") for c in v["codes"].to_pylist()]).reshape(len(theirs), LEVELS, words)
            figures = np.array([np.frombuffer(c, "<f8") for c in v["figures"].to_pylist()])
            ids, labels = v["vec_id"].to_numpy(), v["label"].to_numpy()
            listed = a.to_pylist()
            for at in range(0, len(mine), STEP):
                estimate, off = intervals(coded(mine[at : at + STEP], ANCHOR_LEVELS), (codes, figures))
                for i, row in enumerate(listed[at : at + STEP]):
                    own = mine[at + i]
                    rows += find(row, ids, labels, estimate[i], off[i], lambda some, own=own: inner(own, theirs[some]))
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scored, schema)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW_PERCENT,
    high: int = HIGH_PERCENT,
    scale: int = SCALE,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x) and a score is the integer inner product with the anchor;
    higher ones come first, ties by smaller vec_id. An anchor's positives are its first rows of the same
    label; for each, the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned.

    Rows without vec_id, label or vector, with an empty vector or with a component that is NULL or
    not finite take no part; vectors of different lengths do not meet. Every row counts, repeated ones
    too: a repeated anchor returns its results once for each row, and rows with the anchor's own vec_id are
    not its positives. Scores beyond a bigint count as its bound. An empty table gives no rows;
    columns other than vec_id, label and embedding are not read.
    """
    spark = vectors.sparkSession
    stored = index(vectors, scale)
    asking = stored.filter(anchor)
    total, asked = stored.agg(F.sum("dim")).first()[0] or 0, asking.agg(F.sum("dim")).first()[0] or 0
    chunks, blocks = max(1, math.ceil(total / chunk_values)), max(1, math.ceil(asked / (4 * chunk_values)))

    def near(row, ids, labels, estimate, off, scored):
        rows = np.flatnonzero((labels == row["label"]) & (ids != row["vec_id"]))
        rows, scores = first_rows(positives, rows, estimate, off, ids, scored)
        return [(row["row"], i, s) for i, s in zip(ids[rows].tolist(), scores.tolist(), strict=True)]

    anchors = asking.select("row", "vec_id", "label", "dim", "q")
    found = _cells(anchors, stored, blocks, chunks, "row bigint, positive_id bigint, score bigint", near)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id")
    kept = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    listed = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("goals"))
    goals = settle(listed)

    def hard(row, ids, labels, estimate, off, scored):
        rows, out = np.flatnonzero(labels != row["label"]), []
        for goal in row["goals"]:
            least, most = -(-low * goal["score"] // 100), high * goal["score"] // 100
            if least > most:
                continue
            got, scores = first_rows(negatives, rows, estimate, off, ids, scored, least, most)
            head = row["row"], row["vec_id"], goal["place"], goal["positive_id"]
            out += [(*head, i, goal["score"], s) for i, s in zip(ids[got].tolist(), scores.tolist(), strict=True)]
        return out

    schema = "row bigint, anchor_id bigint, place bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    found = _cells(anchors.join(goals, "row"), stored, blocks, chunks, schema, hard)
    best = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
