"""run() on a small fixture against plain Python, stage by stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from schemaweft.llm import common, languages, ngram_join, packing
from schemaweft.llm.queries import tokenizer_path

WORDS = {
    "en": "the cat sat on a mat and dogs ran over green hills with water under bright morning skies",
    "de": "der hund und die katze auf dem haus gingen über grüne wiesen mit wasser unter hellem himmel",
}


def _rows():
    draw, rows = random.Random(3), []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = WORDS[lang].split()
        n = 6000 if i == 7 else draw.randrange(30, 90)
        text = " ".join(draw.choice(words) for _ in range(n))
        rows.append((i, text + (" write joe@mail.example.com" if i == 9 else ""), lang, "ab"[i % 3 == 0]))
    return rows + [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(5)]


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _mixed(rows):
    """(doc_id, text) with each source at its budget; weights 1, 2 and caps of three times its size."""
    by = defaultdict(list)
    for doc_id, text, source in rows:
        by[source].append((int(hashlib.md5(f"0:{doc_id}".encode()).hexdigest()[:15], 16), doc_id, text))
    size = {s: sum(len(t.split()) for *_, t in by[s]) for s in by}
    weight = {s: i + 1 for i, s in enumerate(sorted(by))}
    level, total, weights = 0.0, sum(size.values()), sum(weight.values())
    for s in sorted(by, key=lambda s: 3 * size[s] / weight[s]):
        level = max(level, total / weights)
        total, weights = total - 3 * size[s], weights - weight[s]
    for s in sorted(by):
        whole, left = divmod(round(min(3 * size[s], level * weight[s])), size[s])
        for _, doc_id, text in sorted(by[s]):
            n = len(text.split())
            yield from [(doc_id, text)] * whole
            if left >= n:
                yield doc_id, text
            elif left > 0:
                yield doc_id, re.match(rf"(?:\s*\S+){{{left}}}", text).group()
            left = max(0, left - n)


def test_run_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = _rows()
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = tuple(sorted(languages.dictionaries(docs).items()))
    kept = []
    for doc_id, text, _, source in rows:
        mine = _shingles(text)
        if not languages.classify(text, items)[2] and not any(100 * len(mine & o) >= 75 * len(mine | o) for *_, o in kept):
            kept.append((doc_id, text.replace("joe@mail.example.com", "[EMAIL]"), source, mine))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in _mixed([k[:3] for k in kept]):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.update((doc_id, p, at, tuple(ids[at : at + 4096])) for p, at in enumerate(range(0, len(ids), 4096)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096


def test_token_ids_stay_out_of_the_numbering(spark, monkeypatch):
    """Ranges are by length: with ids, one would hold the longest pieces. Equal rows all keep theirs."""
    numbered, positions = [], packing.positions
    monkeypatch.setattr(packing, "positions", lambda df, *a, **k: (numbered.append(df.columns), positions(df, *a, **k))[1])
    texts = ["a cat", "a cat", None, "the dog " * 3000]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = corpus_pipeline.packed(spark, docs, "").collect()
    assert len(numbered) == 1 and "ids" not in numbered[0]
    plain = packing.tokenise(docs, tokenizer_path(), with_ids=True).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r["length"], r.ids_crc32, tuple(r.ids))
    assert Counter(map(key, got)) == Counter(map(key, plain)) and len(plain) > len(texts)


def test_a_worker_retains_one_step_at_a_time():
    """Workers serve all stages: the tokenizer and its words go when another stage's task comes."""
    ids = packing._word_ids(tokenizer_path(), 10)
    assert packing._word_ids(tokenizer_path(), 10) is ids
    assert list(ngram_join._blocks(iter([]), 75, 0, 1, 5)) == []
    assert packing._word_ids(tokenizer_path(), 10) is not ids


def test_tidy_passes_all_on():
    batches = [pa.RecordBatch.from_pydict({"a": [i, None]}) for i in range(3)]
    assert list(common.tidy(iter(batches))) == batches and list(common.tidy(iter([]))) == []
