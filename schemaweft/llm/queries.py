"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.llm import chat, fingerprints, languages, line_quality, merkle, mixing, negatives, ngram_join, packing, private_data, records, repeats, warc
from schemaweft.llm.common import lower_ascii, settle, shared_folder, word_count
from schemaweft.llm.neighbours import with_next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likeness to what they resemble.

    Texts are shuffled once, to stand beside the next document; sketches are made there and
    never travel. Repeated rows count each, see ``with_next``.
    """
    both = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - half)
    both = both.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    for text, out in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch")):
        both = fingerprints.with_sketch(both, text, out)
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        "next_doc_id",
    )


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(settle(docs)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM s WINDOW before AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
k AS (
  SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start,
         CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS copies
  FROM k)
SELECT doc_id, size, source_size, target,
       copies * size + greatest(0, least(budget - copies * source_size - start, size)) AS taken
FROM p
"""


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

    def counted(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, private_data.KINDS),
        F.sha2(private_data.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        private_data.span_list(F.col("spans")).alias("spans"),
    )


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.judge(docs, field).drop("boilerplate")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, indexed, and read back through the index."""
    root = shared_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    warc.write_index(spark, root)
    return warc.captures(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM g
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    trained = languages.dictionaries(docs.filter(fold != 0))
    rows = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return languages.identify(rows, trained, keep_text=False)


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.perspectives(table(spark, sf_dir, "conversations"))
    runs = F.transform("mask", lambda r: F.concat(r["length"].cast("string"), F.when(r["trained"], ":1").otherwise(":0")))
    return shown.withColumn("mask", F.array_join(runs, ","))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP10_SQL = """
WITH n AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS pos
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role <> 'system'),
r AS (
  SELECT n.conv_id, speaker, CAST((pos - 1) // 256 AS BIGINT) AS part, pos,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body, coalesce(role = speaker, false) AS own
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS dialogue,
       string_agg(length(head) || ':0,' || length(body) || CASE WHEN own THEN ':1' ELSE ':0' END, ',' ORDER BY pos) AS mask,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_trained
FROM r GROUP BY conv_id, speaker, part
"""



def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides vec_id, the label is the next one; every hundredth id is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.q) = len(v.q)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in record files, read back in shuffled order."""
    found = records.token_records(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), seed=1)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 5 divides the id's checksum, of a text in lower case."""
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    columns = [altered if c == "text" else F.col(c) for c in merkle.COLUMNS]
    return merkle.proofs(table(spark, sf_dir, "documents"), merkle.leaf(*columns))


def _op13_sql(levels: int = 8) -> str:
    """Levels of source trees and of the tree over their subroots, one after the other."""

    def side(value: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(side(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    steps = "[CAST(xor(c, b) AS UBIGINT)] || CAST(range(8) AS UBIGINT[])"
    crc = (
        "xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)), "
        f"lambda c, b: list_reduce({steps}, lambda s, k: xor(s >> 1, CAST(3988292384 AS UBIGINT) * (s & 1)))), CAST(4294967295 AS UBIGINT))"
    )
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS tampered FROM documents)",
        "r0 AS (SELECT coalesce('s:' || source, 'n') AS tree, doc_id, leaf, leaf AS hash, tampered AS fold, '' AS proof, NULL AS subroot, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)",
    ]
    # A row is a document; at each level it knows its node's hash and number and what it folds to.
    at = "r0"
    for tree in ("tree", "'t'"):
        if tree == "'t'":
            ctes.append(f"u AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM (SELECT DISTINCT CASE WHEN tree <> 'n' THEN tree END AS source FROM {at}))")
            ctes.append(
                f"top AS (SELECT 't' AS tree, doc_id, leaf, hash, fold, proof, hash AS subroot, pos AS idx FROM {at} JOIN u ON source IS NOT DISTINCT FROM CASE WHEN tree <> 'n' THEN tree END)"
            )
            at = "top"
        for _ in range(levels):
            n = len(ctes)
            ctes.append(f"m{n} AS (SELECT DISTINCT tree, idx, hash FROM {at})")
            ctes.append(f"c{n} AS (SELECT tree, count(*) AS nodes FROM m{n} GROUP BY tree)")
            ctes.append(f"g{n} AS (SELECT tree, idx // 16 AS up, list(hash ORDER BY idx) AS hashes FROM m{n} GROUP BY tree, idx // 16)")
            before = "array_to_string(hashes[1:idx % 16], '')"
            after = "array_to_string(hashes[idx % 16 + 2:], '')"
            ctes.append(
                f"r{n} AS (SELECT {at}.tree, doc_id, leaf, CASE WHEN nodes > 1 THEN sha256(array_to_string(hashes, '')) ELSE hash END AS hash, "
                f"CASE WHEN nodes > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold, "
                f"CASE WHEN nodes > 1 THEN proof || {before} || {after} ELSE proof END AS proof, subroot, idx // 16 AS idx "
                f"FROM {at} JOIN g{n} ON {at}.tree = g{n}.tree AND idx // 16 = up JOIN c{n} ON {at}.tree = c{n}.tree)"
            )
            at = f"r{n}"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = hash AS verified FROM {at}"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_fingerprints,
        op3_best_two_fit,
        op4_source_mix,
        op5_private_data,
        op6_line_quality,
        op7_warc,
        op8_language,
        op9_repeated_bytes,
        op10_perspectives,
        op11_hard_negatives,
        op12_token_records,
        op13_merkle_manifest,
    )
}
ORACLES = {"op4_source_mix": OP4_SQL, "op7_warc": OP7_SQL, "op10_perspectives": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_merkle_manifest": _op13_sql()}
