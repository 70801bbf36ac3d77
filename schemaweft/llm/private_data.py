"""Information-theoretic sanitisation of personal data.

Base spans are matches of fixed patterns. Terms near them may reveal them too. What is protected
are entities: a matched value, the class it belongs to (mail domain, network, card prefix, calling
code) and its kind. Over the distinct texts of the whole corpus a term t discloses an entity c to
the degree PMI(c; t) / IC(c) = 1 + log p(c | t) / log(N / n_c), the share of the entity's
information that the term gives away. A text is no witness against itself, and few texts prove
little: p(c | t) is the lower confidence bound of (n_ct - 1) out of (n_t - 1). So no least support is
set; rare entities need fewer witnesses than common ones, as their terms have more to give away.
In a text that holds c, terms that reach the disclosure threshold are generalised, and those that
never stand without c are removed.

Everything is DataFrame functions. Patterns are written so that Java's matcher runs in linear
time: a match can only begin where a run begins, so the scan does not start anew inside it.
Terms and entities are counted under 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweft.llm.common import settle, text_key, words

# Kinds in the order in which spans of equal start are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # Of a run of address characters only its begin can begin a match, or the end of the last one.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only runs of 14 digits and more can be valid; shorter ones need no match.
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold to be worth the search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?=[0-9])|$)){4}$"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
DISCLOSURE = 0.75
CONFIDENCE = 1.645  # of the lower bound, one-sided 95 %
SALTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    reverse = F.split(F.reverse(_digits(value)), "")

    def add(total: Column, i: Column) -> Column:
        digit = F.get(reverse, i).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(_digits(value)) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(BYTE)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """Valid matches of one kind: array of spans, in code points, end exclusive.

    ``split`` gives what lies between the matches; lengths of both, summed up, give places.
    """
    pattern = F.lit(PATTERNS[kind])
    both = F.struct(
        F.split(text, PATTERNS[kind]).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")
    )

    def place(b: Column) -> Column:
        steps = F.zip_with(
            b["between"],
            b["found"],
            lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("n"), hit.alias("hit")),
        )
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

        def add(state: Column, s: Column) -> Column:
            begin = state["at"] + s["gap"]
            span = F.struct(
                begin.alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (begin + s["n"]).alias("end"),
                F.lit(kind).alias("kind"),
                s["hit"].alias("value"),
            )
            return F.struct((begin + s["n"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        hits = F.filter(steps, lambda s: s["hit"].isNotNull())
        return F.filter(F.aggregate(hits, start, add)["spans"], lambda s: _valid(kind, s["value"]))

    found = F.transform(F.array(both), place)[0]
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All valid matches of all kinds, by start and then kind."""
    known = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[matches(known, k) for k in KINDS]))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def _entities(spans: Column) -> Column:
    """Hashes of the values, classes and kinds of base spans, each once."""

    def levels(s: Column) -> Column:
        value, digits = F.lower(s["value"]), _digits(s["value"])
        wider = (
            F.when(s["kind"] == "email", F.substring_index(value, "@", -1))
            .when(s["kind"] == "ip", F.substring_index(value, ".", 2))
            .when(s["kind"] == "card", F.substring(digits, 1, 6))
            .otherwise(F.regexp_extract(value, r"^\+[0-9]+", 0))
        )
        exact = F.when(s["kind"].isin("card", "phone"), digits).otherwise(value)
        return F.array(F.xxhash64(s["kind"]), F.xxhash64(s["kind"], F.lit("class"), wider), F.xxhash64(s["kind"], F.lit("value"), exact))

    return F.array_distinct(F.flatten(F.transform(spans, levels)))


def _term_hashes(text: Column) -> Column:
    return F.transform(_terms(text), lambda w: F.xxhash64(w))


def holders(docs: DataFrame) -> DataFrame:
    """key, text, spans of the distinct texts of ``docs`` (text) that have base spans."""
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    some = found.filter(F.size("spans") > 0).withColumn("key", text_key(F.col("text")))
    return settle(some.groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans")))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: distinct texts of ``docs`` (text) that hold a term.

    One row of each distinct text is chosen first; its terms are then counted where they are, so
    that what is shuffled per term is a partial sum.
    """
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    return texts.select(F.explode(_term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosure(n: int, n_c: Column, n_t: Column, n_ct: Column, confidence: float = CONFIDENCE) -> Column:
    """Share of an entity's information that a term gives away at least; 0 where nothing is known."""
    tries, hits, z2 = n_t - 1, n_ct - 1, confidence**2
    rate = hits / tries
    spread = confidence * F.sqrt(rate * (1 - rate) / tries + z2 / (4 * tries * tries))
    bound = (rate + z2 / (2 * tries) - spread) / (1 + z2 / tries)
    return F.when((hits > 0) & (n_c < n), 1 + F.log(bound) / F.log(n / n_c)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, held: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """key, term (hash), gone: terms of the texts in ``held`` that give away what these hold.

    Terms are lower-cased words; counts run over all distinct texts of ``docs`` (text). Entities
    in too few texts for any term to reach the threshold are left out before terms meet them.
    """
    n = docs.select(text_key(F.col("text")).alias("key")).distinct().count()
    each = held.select("key", F.explode(_entities(F.col("spans"))).alias("entity"))
    counts = each.groupBy("entity").agg(F.count("*").alias("n_c"))
    best = counts.filter(disclosure(n, F.col("n_c"), F.col("n_c"), F.col("n_c")) >= threshold)
    # A common entity may be in most texts: its rows are dealt out over salts.
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = each.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "salt"])
    known = found.groupBy("key").agg(F.collect_list(F.struct("entity", "n_c")).alias("entities"))
    near = settle(held.join(known, "key").select("key", "entities", _term_hashes(F.col("text")).alias("terms")))
    met = near.select("entities", F.explode("terms").alias("term")).select("term", F.explode("entities").alias("e"))
    n_ct = met.groupBy("e.entity", "e.n_c", "term").agg(F.count("*").alias("n_ct"))
    # With n_t unknown yet: it is n_ct at least, so the share is at most this.
    able = n_ct.filter(disclosure(n, F.col("n_c"), F.col("n_ct"), F.col("n_ct")) >= threshold)
    scored = able.join(term_counts(docs), "term")
    telling = settle(
        scored.filter(disclosure(n, F.col("n_c"), F.col("n_t"), F.col("n_ct")) >= threshold)
        .groupBy("term")
        .agg(F.collect_list(F.struct("entity", (F.col("n_ct") == F.col("n_t")).alias("gone"))).alias("of"))
    )
    rows = near.select("key", F.transform("entities", lambda e: e["entity"]).alias("own"), F.explode("terms").alias("term"))
    hits = F.filter("of", lambda o: F.array_contains("own", o["entity"]))
    return (
        rows.join(telling, "term")
        .withColumn("hits", hits)
        .filter(F.size("hits") > 0)
        .select("key", "term", F.exists("hits", lambda o: o["gone"]).alias("gone"))
    )


def term_spans(docs: DataFrame, held: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """term_key, term_spans: spans of the disclosing terms, by distinct text that has any.

    A term that never stands without the entity is of kind ``gone``, others of kind ``term``. Words that
    overlap a base span are part of it and no terms.
    """
    telling = settle(disclosing_terms(docs, held, threshold))
    texts = held.join(telling.select("key").distinct(), "key", "left_semi")
    # One break character each: a word then begins where the lengths before it, plus one each, end.
    pieces = texts.select("key", "spans", F.posexplode(F.split("text", r"[\x20\x09-\x0D]")).alias("at", "piece"))
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("piece").cast("long") + 1).over(upto) - 1
    placed = pieces.filter(F.col("at") >= 0).withColumn("end", end).withColumn("start", F.col("end") - F.length("piece"))
    free = ~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    terms = placed.filter((F.col("piece") != "") & free).withColumn("term", F.xxhash64(F.lower("piece"))).join(telling, ["key", "term"])
    kind = F.when(F.col("gone"), "gone").otherwise("term")
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), kind.alias("kind"), F.col("piece").alias("value"))
    return terms.groupBy(F.col("key").alias("term_key")).agg(F.sort_array(F.collect_list(span)).cast(f"array<{SPAN}>").alias("term_spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with spans (by start; they may overlap) replaced by the marks of their kinds."""
    marks = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.element_at(marks, s["kind"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, add)
    rest = F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))[0]
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def find(docs: DataFrame, threshold: float = DISCLOSURE, keep_text: bool = True) -> DataFrame:
    """``docs`` (with text) plus ``base_spans`` and ``spans`` (those and the terms').

    A NULL or empty text has no spans; an empty table gives an empty one. Every row is handled,
    repeated ones alike. Other columns are kept whatever their names; only ``base_spans`` and
    ``spans`` of the caller are replaced. Without ``keep_text`` the text goes before the join.
    """
    held = holders(docs)
    more = settle(term_spans(docs, held, threshold))
    out = [c for c in docs.columns if c.lower() not in ("base_spans", "spans") and (keep_text or c != "text")]
    kept = F.struct(*[F.col(f"`{c}`") for c in out]) if out else F.struct(F.lit(None).alias("none"))
    rows = docs.select(kept.alias("row"), base_spans(F.col("text")).alias("base_spans"), text_key(F.col("text")).alias("key"))
    joined = rows.join(more, F.col("key") == F.col("term_key"), "left")
    every = F.array_sort(F.concat("base_spans", F.coalesce("term_spans", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(*[F.col(f"row.`{c}`") for c in out], "base_spans", every.alias("spans"))


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """The rows of ``docs`` with their texts masked; NULL texts stay NULL, all columns are kept."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find(rows, threshold)
    text = masked(F.col("text"), F.col("spans")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
