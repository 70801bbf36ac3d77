"""Latent states of lines: a poor document may hold content; base counts against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from schemaweft.llm import line_quality
from schemaweft.llm.queries import op6_line_quality

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(n=400, seed=11):
    draw, rows = random.Random(seed), []
    prose = lambda: "The " + " ".join(f"word{draw.randrange(900)}" for _ in range(draw.randrange(8, 20))) + "."
    junk = lambda: " | ".join(f"x{draw.randrange(900)}###" for _ in range(draw.randrange(3, 9)))
    for i in range(n):
        good = i % 3 > 0
        lines = [prose() if good else junk() for _ in range(draw.randrange(6, 14))]
        if not good and i % 2:
            lines[3:3] = [prose(), prose(), prose()]
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    windows = Counter(zip(words, words[1:], words[2:]))
    twice = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    same = sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(twice) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), same, len(twice), failed


def test_poor_documents_may_hold_content(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5], LABELS)
    field = line_quality.train(docs, labels)
    text, poor = dict(r[:2] for r in rows), {r[0] for r in rows if not r[2]}
    right = 0
    for r in line_quality.judge(docs, field).collect():
        lines = text[r.doc_id].split("\n")
        right += r.boilerplate == [i for i, x in enumerate(lines) if "|" in x]
        weight = [len(x.replace(" ", "")) for x in lines]
        kept = sum(w for i, w in enumerate(weight) if i not in set(r.boilerplate)) / sum(weight)
        assert abs(r.content_share - kept) < 1e-9
        assert r.kept == (not r.base_failed and kept >= line_quality.CONTENT_SHARE)
        assert r.doc_id in poor or r.content_share == 1
    assert right >= 0.95 * len(rows)


def test_query_and_base_counts(spark, tmp_path):
    rows = corpus(60) + [(100, None, 0), (101, "", 1), (102, "same line\n" * 80, 1), (102, "a | b", 0), (None, " \n\t\n  ", 0)]
    spark.createDataFrame([r[:2] for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[2], 0) for r in rows], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = op6_line_quality(spark, str(tmp_path)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    ).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(str((r[0], *plain_counts(r[1]))) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_sample_is_bounded_and_repeats(spark):
    rows = corpus(90)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)
    a, b = (line_quality.train(docs.repartition(n), labels, sample_sequences=20) for n in (2, 5))
    assert (a.emit == b.emit).all() and (a.step == b.step).all()
    assert line_quality.train(docs, labels.withColumn("quality", F.lit(None).cast("int"))).emit.any() == False  # noqa: E712
