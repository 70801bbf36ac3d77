"""Suffix-array dedup: bytes of strings that occur more than once, over all documents.

Every window of ``WINDOW`` bytes has a least gram hash (its key). Equal windows have equal keys,
so windows meet by key, and all windows of a key that follow one another travel as one context.
Contexts whose key is in use elsewhere are laid out in shards; a suffix array by induced
sorting and permuted common prefixes show which windows of a shard occur twice. Equal
contexts are counted first and enter once, so a group of copies is as small as one of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import join_small, settle
from schemaweft.llm.shingles import mix
from schemaweft.llm.suffixes import common_prefixes, suffix_array

WINDOW, GRAM = 400, 16
#: Bytes of a shard, about; contexts from which the windows of a key are dealt out further.
SHARD_BYTES, HOT_CONTEXTS = 2_000_000, 2_000
_K = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _K)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_K), n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from each place on."""
    h, width = _BYTES[data], 1
    while width < gram:
        h = h[:-width] * _power(width) + h[width:]
        width *= 2
    return mix(h + np.uint64(seed))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by running minima within blocks."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    onward = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(back[:count], onward[width - 1 : width - 1 + count])


def window_keys(data: np.ndarray, window: int = WINDOW, gram: int = GRAM, seed: int = 0) -> np.ndarray:
    return sliding_least(gram_hashes(data, gram, seed), window - gram + 1)


def _key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def text_key(text: str) -> Column:
    """128 bits of the text's SHA-256, as the tasks compute it."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _runs(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts of a text: windows that follow one another and have one key."""
    for batch in batches:
        rows = []
        for text in batch.column(0):
            raw = text.as_py().encode("utf-8", "replace")
            if len(raw) < window:
                continue
            grams = gram_hashes(np.frombuffer(raw, np.uint8), gram)
            keys = sliding_least(grams, window - gram + 1)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            own = np.diff(np.append(starts, len(keys)))
            # A window can only recur within its run if the gram of its key does in the text.
            low = np.sort(grams[grams <= keys.max()])
            again = np.isin(keys[starts], low[1:][low[1:] == low[:-1]])
            key = _key(raw)
            for lo, n, k, r in zip(starts.tolist(), own.tolist(), keys[starts].view(np.int64).tolist(), again.tolist()):
                context = xxhash.xxh3_64_intdigest(raw[lo : lo + n + window - 1]) - (1 << 63)
                rows.append((key, lo, n, k, context, r))
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "lo", "own", "m", "c", "again"])


def _contexts(batches: Iterator[pa.RecordBatch], window: int, gram: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, with the shard where all windows equal to theirs are.

    Contexts of a hot key are cut where further keys, by other hashes, change: their windows
    are dealt out by all of these keys.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            text, wanted = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            key, raw, rows = batch.column(0)[i].as_py(), text.encode("utf-8", "replace"), []
            for run in wanted:
                lo, own, at = run["lo"], run["own"], np.full(1, run["m"], np.int64).view(np.uint64)
                cuts, names = [0], mix(at)
                if run["hot"]:
                    data = np.frombuffer(raw[lo : lo + own + window - 1], np.uint8)
                    name = np.repeat(mix(at), own)
                    for seed in (1, 2, 3):
                        name = mix(name * _K + window_keys(data, window, gram, seed))
                    cuts = np.flatnonzero(np.append(True, name[1:] != name[:-1])).tolist()
                    names = name[cuts]
                for a, b, name in zip(cuts, [*cuts[1:], own], names.tolist()):
                    rows.append((name % shards, key, lo + a, b - a, raw[lo + a : lo + b + window - 1]))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "key", "lo", "own", "context"])


SPANS = "key binary, a int, b int"


def _spans(keys: list, a: list, b: list) -> pa.Table:
    return pa.table({"key": pa.array(keys, pa.binary()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})


def _repeated(table: pa.Table, window: int) -> pa.Table:
    """Byte ranges covered by the windows of a shard that occur twice in it."""
    contexts, lows, owns = (table.column(n).to_pylist() for n in ("context", "lo", "own"))
    lengths = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum(lengths) - lengths
    sa = suffix_array(data)
    block = np.cumsum(common_prefixes(data, sa) < window)
    owned = np.zeros(len(data) + 1, np.int64)
    owned[begins] += 1
    np.subtract.at(owned, begins + np.array(owns), 1)
    owned = np.cumsum(owned)[:-1] > 0
    mine = owned[sa]
    counts = np.bincount(block[mine], minlength=int(block[-1]) + 1)
    twice = np.zeros(len(data), bool)
    twice[sa[mine & (counts[block] >= 2)]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
    first, last = edges[::2], edges[1::2] - 1
    # Runs of windows may go on over the end of a context only in appearance.
    at = np.searchsorted(begins, first, side="right") - 1
    out = ([], [], [])
    for f, e, i in zip(first.tolist(), last.tolist(), at.tolist()):
        while f <= e:
            stop = min(e, int(begins[i]) + owns[i] - 1)
            shift = lows[i] - int(begins[i])
            for x, v in zip(out, (i, f + shift, stop + shift + window)):
                x.append(v)
            f, i = stop + 1, i + 1
    key = table.column("key").to_pylist()
    return _spans([key[i] for i in out[0]], out[1], out[2])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            raw, merged = text.encode("utf-8", "replace"), []
            for s in sorted((s["a"], s["b"]) for s in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((key, len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": b} for a, b in merged]))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of ``docs``.

    A byte goes if a ``window``-byte string that covers it starts at two places of the corpus,
    in whatever rows; matches never cross rows. NULL and empty texts have no bytes. Repeated
    rows are documents that repeat each other. ``spans`` are the byte ranges removed.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = settle(whole.select("text").mapInArrow(lambda it: _runs(it, window, gram), "key binary, lo int, own int, m bigint, c bigint, again boolean"))
    met = runs.groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.max("again").alias("again"))
    met = met.filter("n > 1 or again").select("m", (F.col("again") | (F.col("c_low") < F.col("c_high"))).alias("mixed"))
    shared = runs.drop("again").join(met, "m")
    groups = settle(
        shared.groupBy("m", "c", "mixed").agg(F.count("*").alias("copies"), F.min(F.struct("key", "lo", "own")).alias("one"))
    )
    # Every window of a context that occurs twice does so itself.
    twice = runs.join(groups.filter("copies > 1").select("m", "c"), ["m", "c"], "left_semi")
    copied = twice.select("key", F.col("lo").alias("a"), (F.col("lo") + F.col("own") + window - 1).alias("b"))
    mixed = groups.filter("mixed")
    hot = settle(mixed.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CONTEXTS).select(F.col("m").alias("hot_m")))
    sorted_ = settle(join_small(mixed, hot, F.col("m") == F.col("hot_m")).select("one.*", "m", F.col("hot_m").isNotNull().alias("hot")))
    size = sorted_.agg(F.sum(F.col("own") + window - 1)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    by_text = sorted_.groupBy("key").agg(F.collect_list(F.struct("lo", "own", "m", "hot")).alias("wanted"))
    concerned = settle(sorted_.select(F.col("key").alias("k")).union(copied.select("key")).distinct())
    keyed = whole.select(text_key("text").alias("key"), "text")
    texts = settle(join_small(keyed, concerned, F.col("key") == F.col("k"), "left_semi", limit=200_000).groupBy("key").agg(F.first("text").alias("text")))
    laid = texts.join(by_text, "key").select("key", "text", "wanted")
    contexts = laid.mapInArrow(lambda it: _contexts(it, window, gram, shards), "shard bigint, key binary, lo int, own int, context binary")
    found = contexts.groupBy("shard").applyInArrow(lambda t: _repeated(t, window), SPANS)
    spans = copied.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    removed = texts.join(spans, "key").select("key", "text", "spans").mapInArrow(
        _removed, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:int,b:int>>"
    )
    removed = settle(removed).withColumnRenamed("key", "k")
    every = whole.select("doc_id", text_key("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return join_small(every, removed, F.col("key") == F.col("k")).select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
    )
