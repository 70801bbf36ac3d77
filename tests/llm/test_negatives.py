"""Hard negatives against plain Python."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from schemaweft.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row string, q string, block int, rank int, goals string"


def brute(rows):
    good = []
    for vec_id, label, x in rows:
        if vec_id is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        good.append((vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = Counter()
    for a, label, q in good:
        if a % 100:
            continue
        others = [(-sum(map(int.__mul__, q, p)), i, b) for i, b, p in good if len(p) == len(q)]
        same = sorted((s, i) for s, i, b in others if b == label and i != a)[:5]
        hard = sorted((s, i) for s, i, b in others if b != label)
        for p, i in same:
            fits = [(s, j) for s, j in hard if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out.update((a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fits))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, None) for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **more)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_equals_brute_force_over_many_cells(spark):
    draw = np.random.default_rng(1)
    rows = [(i, int(draw.integers(0, 4)), draw.normal(size=24).tolist()) for i in range(900)]
    # Ties, repeated rows, ids that two rows share, a repeated anchor.
    rows += [(1000 + i, i % 4, rows[3][2]) for i in range(40)] + rows[7:9] + [(11, 2, rows[5][2])] + [rows[100]]
    want = brute(rows)
    assert len(want) > 200
    assert found(spark, rows, chunk_values=2000) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]),
        (1, 1, [1.0, 0.25]),
        (2, 2, [0.5, 0.5]),
        (3, 2, [0.5, 0.5]),
        (4, 1, [nan, 1.0]),
        (5, 2, [inf, 1.0]),
        (6, 2, [None, 1.0]),
        (7, None, [0.5, 0.5]),
        (8, 2, None),
        (9, 2, []),
        (None, 2, [0.5, 0.5]),
        (100, 1, [0.0, 0.0]),
        (200, 1, [0.5]),
        (201, 1, [1.0]),
        (202, 3, [0.5]),
        (300, 5, [1e6, 1e6, -3.0]),
        (301, 5, [1e6, 1e6, 7.0]),
        (302, 6, [4e5, 4e5, 1.0]),
        (303, 6, [4e5, 4e5, 2.0]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()
    # Scores beyond a bigint count as its bound and nothing fails.
    assert found(spark, [(0, 1, [3e38]), (1, 1, [3e38]), (2, 2, [2e38])]) == Counter()


def test_intervals_hold_the_inner_product():
    draw = np.random.default_rng(2)
    for dim in (1, 3, 64, 65, 200):
        x, y = np.floor(256 * draw.normal(size=(300, dim))), np.floor(256 * draw.normal(size=(20, dim)))
        x[0] = 0
        estimate, off = negatives.intervals(negatives.coded(y, negatives.ANCHOR_LEVELS), negatives.coded(x, negatives.LEVELS))
        true = y @ x.T
        assert (np.abs(true - estimate) <= off).all()
        # Four codes leave a small rest, so the filter filters.
        assert np.median(off) < 0.3 * np.median(np.linalg.norm(x, axis=1)) * np.median(np.linalg.norm(y, axis=1))
