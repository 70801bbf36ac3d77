"""Personal data and the terms that disclose it, against plain Python over all texts."""

import math
import random
import re
from collections import Counter

from schemaweft.llm import private_data

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        twice = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, PATTERNS)):
        found += [(m.start(), rank, m.end(), kind, m.group()) for m in re.finditer(pattern, text) if valid(kind, m.group())]
    return sorted(found)


def entities(spans):
    out = set()
    for _, _, _, kind, value in spans:
        digits = "".join(c for c in value if c.isdigit())
        wider = {
            "email": value.lower().rsplit("@", 1)[-1],
            "ip": ".".join(value.split(".")[:2]),
            "card": digits[:6],
            "phone": re.match(r"\+[0-9]+", value + " ").group() if kind == "phone" else "",
        }[kind]
        out |= {(kind,), (kind, "class", wider), (kind, "value", digits if kind in ("card", "phone") else value.lower())}
    return out


def least_rate(hits, tries, z=private_data.CONFIDENCE):
    rate = hits / tries
    spread = z * math.sqrt(rate * (1 - rate) / tries + z * z / (4 * tries * tries))
    return (rate + z * z / (2 * tries) - spread) / (1 + z * z / tries)


def plain(texts, threshold):
    """All spans of each distinct text: (start, end, kind)."""
    texts = {t or "" for t in texts}
    spans = {t: base(t) for t in texts}
    words = {t: set(re.split(r"[\x20\x09-\x0d]+", t.lower())) - {""} for t in texts}
    n_t = Counter(w for t in texts for w in words[t])
    n_c = Counter(c for t in texts for c in entities(spans[t]))
    n_ct = Counter((c, w) for t in texts for c in entities(spans[t]) for w in words[t])
    out = {}
    for t in texts:
        found = [(s, r, e, k) for s, r, e, k, _ in spans[t]]
        for m in re.finditer(r"[^\x20\x09-\x0d]+", t):
            if any(s < m.end() and e > m.start() for s, _, e, _, _ in spans[t]):
                continue
            w, telling = m.group().lower(), []
            for c in entities(spans[t]):
                both = n_ct[c, w]
                if both > 1 and n_c[c] < len(texts):
                    share = 1 + math.log(least_rate(both - 1, n_t[w] - 1)) / math.log(len(texts) / n_c[c])
                    if share >= threshold:
                        telling.append(both == n_t[w])
            if telling:
                found.append((m.start(), 4, m.end(), "gone" if any(telling) else "term"))
        out[t] = [(s, e, k) for s, _, e, k in sorted(found)]
    return out


def corpus(n=400, seed=3):
    """Texts of common words; some hold personal data, beside words that follow a value, a class or a kind."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        text = [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(0, 40))]
        if i % 9 == 0:
            text += ["reach", f"a{i % 7}@mail{i % 3}.example.com", f"team{i % 3}", f"Nick{i % 7}", "\n"]
        if i % 11 == 0:
            text += [f"10.{i % 4}.0.{i % 5}", f"host{i % 4}", "+1 (377) 555-0271" if i % 2 else "4111 1111 1111 1111"]
        if i % 60 == 1:
            text += ["reach", "host1"]
        draw.shuffle(text)
        rows.append(" ".join(text))
    return rows + [None, "", " \t\n"] + rows[:30] * 3


def test_terms_against_plain_python(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kinds = Counter()
    for threshold in (private_data.DISCLOSURE, 0.5):
        expected = plain(texts, threshold)
        for r in private_data.find(df, threshold).collect():
            assert [(s.start, s.end, s.kind) for s in r.spans] == expected[r.text or ""]
            kinds.update(s.kind for s in r.spans)
    assert {"term", "gone", *KINDS} <= set(kinds)


def test_registered_query_against_plain_python(spark, tmp_path):
    from schemaweft.llm.queries import op5_private_data

    rows = [(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(corpus(150))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain([t for _, t in rows], private_data.DISCLOSURE)
    want = sorted((str(i), ",".join(f"{k}:{s}:{e}" for s, e, k in expected[t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), r.spans) for r in op5_private_data(spark, str(tmp_path)).collect()) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_private_data(spark, f"{tmp_path}/none").collect() == []


def test_columns_of_the_same_names_are_kept(spark):
    df = spark.createDataFrame([("to a@b.c", 1, 2, 3, 4, 5)], "text string, spans int, key int, term_key int, row int, base_spans int")
    clean = private_data.sanitise(df).first()
    assert clean.asDict() == {"text": "to [EMAIL]", "spans": 1, "key": 2, "term_key": 3, "row": 4, "base_spans": 5}
    found = private_data.find(df).first()
    assert (found.key, found.term_key, found.row, len(found.spans)) == (2, 3, 4, 1)
