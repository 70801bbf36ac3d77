"""The fingerprint query on awkward rows, against plain Python."""

import hashlib
import random

import pytest

from schemaweft.llm import fingerprints
from schemaweft.llm.neighbours import with_next
from schemaweft.llm.queries import op2_fingerprints


def shingles(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(n=120, seed=5):
    draw, rows = random.Random(seed), []
    for i in range(n):
        rows.append((i, " ".join(f"wörd{draw.randrange(400)} 𝄞"[: draw.randrange(3, 9)] for _ in range(draw.randrange(0, 300)))))
    return rows + [(-(2**63), "least"), (2**63 - 1, "most most"), (500, None), (501, ""), (502, " \n"), (503, "A b " * 4000)]


@pytest.mark.parametrize("rows", [3, 20_000])
def test_next_document(spark, rows):
    known = corpus()
    df = spark.createDataFrame(known, "doc_id long, text string").repartition(3)
    order = sorted(((i, t or "") for i, t in known), reverse=True)
    want = {i: (t, *order[(k + 1) % len(order)]) for k, (i, t) in enumerate(order)}
    assert {r.doc_id: (r.text, r.next_doc_id, r.next_text) for r in with_next(df, rows).collect()} == want


def test_next_of_repeated_rows_null_ids_single_and_none(spark):
    rows = [(7, "same")] * 9 + [(3, "x"), (None, "n"), (None, "n"), (9, "top")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, range int")
    got = sorted((str(r.doc_id), str(r.next_doc_id), r.next_text) for r in with_next(df, 2).collect())
    assert got == sorted([("9", "7", "same"), *[("7", "7", "same")] * 8, ("7", "3", "x"), ("3", "None", "n"), ("None", "None", "n"), ("None", "9", "top")])
    one = with_next(df.filter("doc_id = 3")).first()
    assert (one.next_doc_id, one.next_text) == (3, "x")
    assert with_next(df.filter("doc_id = 4")).collect() == []


def test_query_against_plain_python(spark, tmp_path):
    known = corpus()
    spark.createDataFrame(known, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(((i, t or "") for i, t in known), reverse=True)
    got = {r.doc_id: r for r in op2_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited, r = text[: len(text) - half] + after[:half], got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(shingles(text) | shingles(edited)) > 100:
            assert abs(r.near_edited - likeness(shingles(text), shingles(edited))) < 0.15
        assert abs(r.near_next - likeness(shingles(text), shingles(after))) < 0.15


def test_fingerprints_of_equal_texts(spark):
    texts = ["one two three four five six", "One TWO three four five six", "one two three four five seven", "", None, "one"]
    df = fingerprints.with_sketch(spark.createDataFrame([(t,) for t in texts], "text string"))
    a, b, c, empty, none, one = [r[0] for r in df.select(fingerprints.fingerprint(df.sketch)).collect()]
    assert a == b != c and empty == none == "" and one
