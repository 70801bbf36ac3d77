"""Every training-data operator on awkward rows, against plain Python where SQL has no form."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from schemaweft.llm import chat, fingerprints, languages, line_quality, mixing, ngram_join, packing, private_data, repeats, warc
from schemaweft.llm.queries import tokenizer_path
from schemaweft.llm.suffixes import _doubled, common_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, source string, extra string"
BASE = " ".join(f"w{i}" for i in range(60))
EDIT = BASE.replace("w30", "other")
LONG = " ".join(f"l{i}" for i in range(30000))
ROWS = [
    (1, BASE, "en", "a", "x"),
    (2, EDIT, "en", "a", None),
    (3, BASE.upper(), None, None, "x"),
    (4, "one two", "en", "b", ""),
    (5, "ONE two", "en", "b", ""),
    (6, None, None, "b", ""),
    (7, "", "en", None, ""),
    (8, " \n\t ", "en", "a", ""),
    (9, LONG, "en", "c", ""),
    (10, "mail joe.x@mail.example.com or +1 (377) 555-0271, 10.0.0.1 and 999.1.1.1, 4111 1111 1111 1111", "en", "c", ""),
    (10, "same id, other text", "en", "c", ""),
    (None, "no id", None, None, None),
    (11, "twice", "en", "a", ""),
    (11, "twice", "en", "a", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for g, r in zip(group, rows):
        least[g].append(r[0])
    found = [min((x for x in least[g] if x is not None), default=None) for g in group]
    return Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, found))


def test_join_equals_brute_force(spark, docs, none):
    near = [(100 + i, BASE.replace(f"w{i}", "new").replace(f"w{i + 7}", "x") if i % 3 else BASE + f" t{i}", "en", "a", "") for i in range(40)]
    rows = ROWS + near
    found = ngram_join.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert ngram_join.similar_documents(none).count() == 0


def test_one_document_of_each_group_stays(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 6, 7, 8, 9, 10, 10, None, 11])


def test_long_lists_meet_in_cells(spark, monkeypatch):
    """Near copies of one text, of which only some are similar to one another, over many cells."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for doc in range(160):
        words = list(base)
        for at in draw.integers(0, 150, int(draw.integers(0, 12))):
            words[at] = f"x{doc}y{at}"
        rows.append((doc, " ".join(words), "en", "a", None))
    met = []
    whole = ngram_join._asked_in_cells

    def seen(every, sizes, percent):
        met.append(every.count())
        return whole(every, sizes, percent)

    monkeypatch.setattr(ngram_join, "_asked_in_cells", seen)
    found = ngram_join.similar_documents(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert met and met[0] > 0


@pytest.mark.parametrize("chunk", [16, 4096])
def test_pairs_of_several_centers_are_met_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    lists = [(center, 10 * center + i, c, c % 2 == 0 or i > 0, c // 3) for center in (1, 2, 3) for i in (0, 1) for c in range(40) if c > 3 * center * i]
    every = spark.createDataFrame(lists, "center long, list long, class long, asks boolean, component long")
    sizes = spark.createDataFrame([(c, 100 + c % 28, [0, 0]) for c in range(40)], "class long, n long, bits array<long>")
    n, members = {c: 100 + c % 28 for c in range(40)}, {}
    for _, name, c, asks, _ in lists:
        members.setdefault(name, []).append((c, asks))
    wanted = {(u, v) for m in members.values() for u, asks in m for v, _ in m if asks and u // 3 != v // 3 and n[u] >= n[v]}
    found = ngram_join._asked_in_cells(every, sizes, 75).collect()
    assert Counter((r.u, r.v) for r in found) == Counter((min(p), max(p)) for p in wanted)


def test_parities_apart():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 2**64, n, np.uint64)) for n in (3, 60, 64, 65, 100, 128, 130, 200)]
    bits = [ngram_join.parity(s) for s in sets]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    fits = [len(bits[a]) in (len(bits[b]), 2 * len(bits[b])) or 2 * len(bits[a]) == len(bits[b]) for a, b in zip(u, v)]
    for a, b, apart in zip(u[fits], v[fits], ngram_join._apart(u[fits], v[fits], bits)):
        width = 64 * min(len(bits[a]), len(bits[b]))
        odd = [np.bincount((sets[i] % np.uint64(width)).astype(int), minlength=width) % 2 for i in (a, b)]
        assert apart == (odd[0] != odd[1]).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_units_suffice():
    for n in (1, 2, 4, 7, 12, 40, 100, 900):
        elements = np.sort(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        keys, flags = ngram_join.set_keys(elements, np.zeros(n, bool), 75, 0)
        assert len(keys) == len(flags) > 0
    with pytest.raises(ngram_join.Unallocated):
        ngram_join.allocate(np.array([1]), np.array([1.0]), 2)


def test_fingerprints_estimate_and_merge(spark, docs, none):
    a, b = (" ".join(f"{p}{i}" for i in range(4000)) for p in "ab")
    df = spark.createDataFrame([(a, a + " " + b, None), ("", None, " \t")], "s string, t string, u string")
    for c in "stu":
        df = fingerprints.with_sketch(df, c, f"k{c}")
    row, empty = df.select(
        fingerprints.containment(df.ks, df.kt).alias("c"), fingerprints.jaccard(df.ks, df.kt).alias("j"), fingerprints.fingerprint(df.ku).alias("f"),
        (fingerprints.merge(df.ks, df.kt) == df.kt).alias("m"),
    ).collect()
    assert row.c == 1.0 and row.m and abs(row.j - 0.5) < 0.06 and row.f == ""
    assert empty.j == 1.0 and empty.c == 1.0
    assert fingerprints.with_sketch(docs).count() == len(ROWS) and fingerprints.with_sketch(none).count() == 0


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(packing.tokenise(docs, tokenizer_path(), with_ids=True)).collect()
    by_doc = defaultdict(Counter)
    for _, (doc_id, text, *_) in enumerate(ROWS):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            by_doc[doc_id][(p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = defaultdict(Counter)
    places = defaultdict(list)
    for r in pieces:
        got[r.doc_id][(r.piece, r.start, r["length"], r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r["length"]))
    assert got == by_doc
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0] + [n for _, n in sorted(spans)][:-1]).tolist()
        assert sum(n for _, n in spans) <= 4096
    assert packing.pack(packing.tokenise(none, tokenizer_path())).count() == 0


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(tokenizer_path())
    texts = ["", "Don't 'S it's", "<|endoftext|> x<|ENDOFTEXT|>", "É é İ!! Σ ﬁ x\u0085y a\x1cb", "a1b22 ### a.b,c", " ́a"]
    for text, ids in zip(texts, words.batch(texts)):
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_best_two_fit_plan():
    counts = {60: 3, 50: 2, 30: 4, 20: 5, 7: 9}
    bins = packing.plan(counts, 100)
    used = Counter()
    for times, lengths in bins:
        assert sum(lengths) <= 100
        used.update({n: times * c for n, c in Counter(lengths).items()})
    assert used == counts
    assert packing._two_for(np.array([0, 0, 0, 1, 2, 0, 0, 1, 0, 0, 0]), Counter({7: 1}), 7, 1, 10) == [4, 4]


def test_mix_takes_each_budget(spark, none):
    rows = [(i, "abc"[i % 3] if i % 5 else None, i % 7) for i in range(300)] + [(None, "z", None), (1, "a", 5), (1, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, rows_per_range=10).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * (r["size"] or 0)
    assert taken == {r.source: round(r.target) for r in got}
    assert sorted(map(str, mixing.mix(df, rows_per_range=1000).collect())) == sorted(map(str, got))
    assert mixing.mix(none.selectExpr("doc_id", "source", "1L as size")).count() == 0


def test_private_data(spark, docs, none):
    found = {(r.doc_id, r.text): r for r in private_data.find(docs).collect()}
    text = ROWS[9][1]
    kinds = {s.kind: text[s.start : s.end] for s in found[10, text].base_spans}
    assert kinds == {"email": "joe.x@mail.example.com", "phone": "+1 (377) 555-0271", "ip": "10.0.0.1", "card": "4111 1111 1111 1111"}
    assert found[6, None].spans == [] and found[9, LONG].spans == []
    tricky = "a@b.c_d@e.f é 1.2.3.4.5.6.7.8 " + "9" * 50 + " a@" * 50
    one = spark.createDataFrame([(tricky,)], "text string").select(private_data.base_spans(private_data.F.col("text")).alias("s")).first().s
    assert [tricky[s.start : s.end] for s in one] == ["a@b.c", "_d@e.f", "1.2.3.4", "5.6.7.8"]
    told = [(i, f"codeword{'' if i < 4 else i} is with kim@corp.example.org today number{i}", "en", "a", "") for i in range(4)]
    plain = [(100 + i, f"is with today and more of text{i}", "en", "a", "") for i in range(60)]
    clean = {r.doc_id: r.text for r in private_data.sanitise(spark.createDataFrame(told + plain, DOCS)).collect()}
    assert clean[0] == " is with [EMAIL] today number0" and clean[100] == plain[0][1]
    assert private_data.sanitise(none).count() == 0


def test_languages(spark, docs, none):
    english, german = "the cat sat on the mat and the dog", "der hund und die katze auf dem haus"
    rows = [(i, f"{english} {i}" if i % 2 else f"{german} {i}", "en" if i % 2 else "de") for i in range(60)]
    trained = languages.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(trained) == ["de", "en"]
    items = tuple(sorted(trained.items()))
    assert languages.classify("the dog and the cat sat", items)[0] == "en"
    assert languages.classify("und die katze auf dem haus " * 300, items)[0] == "de"
    for nothing in (None, "", "123 ###"):
        assert languages.classify(nothing, items) == ("und", 0.0, True)
    got = languages.identify(docs, trained)
    assert got.columns == [*docs.columns, "lang_pred", "score", "rejected"] and got.count() == len(ROWS)
    assert languages.identify(none, trained).count() == 0 and languages.dictionaries(none) == {}


def test_line_quality(spark, docs, none):
    good = "\n".join("This is a line of quite plain prose that ends well." for _ in range(1))
    poor = "a | b | c | d\nx | y ### | z"
    rows = [(i, (good + f" More {i} words.") if i % 2 else f"{poor} {i} | q", None, None, None) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    field = line_quality.train(spark.createDataFrame(rows, DOCS), labels)
    states = field.viterbi(line_quality.line_features([good, good, "a | b | c ### | d", "x | y | z | ### w"]))
    assert states.tolist()[0] == line_quality.CONTENT and states.tolist()[-1] == line_quality.BOILERPLATE
    assert line_quality.base_counts("a b c a b c\n\nx\nx\n #") == (9, 9, 1, 1, 6)
    got = {(r.doc_id, r.n_words): r for r in line_quality.judge(docs, field).collect()}
    assert got[6, 0].base_failed and not got[6, 0].kept and not got[1, 60].base_failed
    assert line_quality.judge(none, field).count() == 0
    assert line_quality.train(none, labels.limit(0)).viterbi(np.ones((2, line_quality.N_FEATURES))).tolist() == [1, 1]


def test_suffixes_of_names():
    draw = np.random.default_rng(8)
    for names in (draw.integers(0, 3, 200), np.tile(draw.integers(0, 9, 7), 30), np.zeros(50, np.int64), np.arange(20)[::-1], np.zeros(1, np.int64)):
        assert _doubled(names).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (30, 1), (200, 2), (300, 3), (500, 200)):
        data = rng.integers(0, k, n).astype(np.uint8)
        text = data.tobytes()
        want = sorted(range(n), key=lambda i: text[i:])
        sa = suffix_array(data)
        assert sa.tolist() == want
        lengths = common_prefixes(data, sa)
        for a, b, m in zip(want, want[1:], lengths[1:]):
            assert text[a : a + m] == text[b : b + m] and text[a : a + m + 1] != text[b : b + m + 1]


def test_repeated_bytes_equal_brute_force(spark, docs, none):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, f"{' '.join(word() for _ in range(40))} {passage[: 300 + 20 * i]} {word()}", "", "", "") for i in range(12)]
    rows += [(50, "ab" * 500, "", "", ""), (51, passage + passage, "", "", ""), *ROWS]
    texts = [(r[1] or "").encode() for r in rows]
    starts = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    want = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if starts[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.repeated_bytes(spark.createDataFrame(rows, DOCS)).drop("spans").collect()
    assert Counter(map(tuple, got)) == want
    assert repeats.repeated_bytes(none).count() == 0


def test_warc_round_trip_and_lookup(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://www.a.example.com/x?y=1", big, 0), (2, "https://b.example.org/", big, 0), (3, None, None, 0), (None, "not a url", big, 0), (4, "http://a.example.com/x?y=1", "small\r\n\r\nbody", 0)]
    root = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, extra int"), root)
    warc.write_index(spark, root)
    got = {r.page_id: r for r in warc.captures(spark, root, True).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 1200
    assert got[2].record_type == "response" and bytes(got[2].payload) == big.encode()
    assert got[None].refers_to == 2 and got[3].payload_bytes == 0
    assert bytes(got[4].payload) == b"small\r\n\r\nbody"
    assert {r.page_id for r in warc.lookup(spark, root, "http://a.example.com/x?y=1").collect()} == {1, 4}
    assert warc.lookup(spark, root, "http://nowhere.example/").count() == 0
    assert warc.surt("HTTP://www.A.example.com:8080/P?q") == "com,example,a:8080)/p?q"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be", 0), (1, 1, "ann", "hi <|end|>", 0), (1, 2, "bob", None, 0), (1, 3, None, "?", 0), (None, 1, "ann", "x", 0), (None, 1, "ann", "x", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra int")
    got = chat.perspectives(turns, turns_per_part=2).collect()
    whole = defaultdict(str)
    for r in sorted(got, key=lambda r: r.part):
        whole[r.conv_id, r.speaker] += r.dialogue
        at, trained = 0, ""
        for run in r["mask"]:
            trained += r.dialogue[at : at + run["length"]] if run["trained"] else ""
            at += run["length"]
        assert at == len(r.dialogue) and len(trained) == r.n_trained
    assert whole[1, "bob"] == "<|system|>\nbe<|end|>\n<|user name=ann|>\nhi < |end|><|end|>\n<|assistant|>\n<|end|>\n<|user name=unknown|>\n?<|end|>\n"
    assert whole[None, "ann"] == "<|assistant|>\nx<|end|>\n" * 2 and set(whole) == {(1, "ann"), (1, "bob"), (None, "ann")}
    assert chat.perspectives(turns.limit(0)).count() == 0
