"""Merkle proofs against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from schemaweft.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, run int, pos int, node string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, [(siblings, sides)] of each node): siblings level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, at in zip(paths, place):
            run, k = runs[at // 16], at % 16
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        place = [p // 16 for p in place]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows, altered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*altered(r)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in names]
    root, tops = climb([t[0] for t in trees])
    out = Counter()
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, own, fold, doc_id), path in zip(sorted(groups[name]), paths):
            for before, after in path + top:
                fold = h(before + fold + after)
            proof = h("".join(b + a for b, a in path + top))
            out[doc_id, own, subroot, root, proof, fold, fold == root] += 1
    return out


def lowered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
    return (r[0], low if hit else r[1], *r[2:])


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, 2, "n") for r in rows], SCHEMA)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.proofs(docs, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def test_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUNS_PER_LINK", 3)
    rows = [(i, f"Text {i} É" * (i % 4), "en", "hot", i) for i in range(700)]
    rows += [(1000 + i, "A", None, f"s{i}", None) for i in range(20)]
    rows += [(2000 + i, None, "de", "Ünder", 3) for i in range(16)] + [(3000 + i, "b", "de", "n", 3) for i in range(17)]
    rows += [(None, "no id", None, None, None), (None, "B", None, None, 1), (5, "", "", "", 0), (6, "same", "en", "t", 1), (6, "same", "en", "t", 1), (6, "Other", "en", "t", 1)]
    rows += [(4000, "Long " * 100_000, "en", "long", 1)]
    want = brute(rows, lowered)
    assert {k[-1] for k in want} == {True, False}
    assert found(spark, rows) == want


def test_one_row_and_none(spark):
    rows = [(15, "Only", "en", "a", 4)]
    assert found(spark, rows) == brute(rows, lowered)
    rows = [(i, "Only", "en", "a", 4) for i in range(18)]
    assert found(spark, rows) == brute(rows, lowered)
    assert found(spark, []) == Counter()
