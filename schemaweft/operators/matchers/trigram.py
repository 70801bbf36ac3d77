"""Jaccard similarity of lower-case character trigrams: first targets, and levels of similarity.

Both are found in the cells of a grid, each of which holds the inverted index of its targets. First
targets skip the chunks whose numbers of trigrams cannot reach a source's bar; levels need every pair
that shares a trigram.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from schemaweft.functions.names import trigrams
from schemaweft.operators.grid import grid_every, grid_top_k
from schemaweft.operators.ranking import ranked
from schemaweft.operators.setjoin import meet, rare_first
from schemaweft.session import merged, settle

# The cell functions travel with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _grams(text: str | None) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)} if text else set()


#: Share of a source's trigrams, the rarest, that are looked up first, for its bar.
SEED_SHARE = 0.6


def gram_codes(name: Column) -> Column:
    """Distinct trigrams as numbers: three code points of 21 bits each."""

    def code(gram: Column) -> Column:
        points = [F.ascii(F.substr(gram, F.lit(i), F.lit(1))).cast("bigint") for i in (1, 2, 3)]
        return F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]

    return F.transform(trigrams(name), code)


class TrigramIndex:
    """Postings of a catalog's trigrams by pair, and how far each source would have to read them.

    Tells what a whole index would read (``lookups``); ``trigram_match`` indexes chunk by chunk.

    Trigrams are ordered rarest first. A source first looks up the rarest ``SEED_SHARE`` of its own,
    whose postings are short; the k-th score found there is its bar ``t``. A target that reaches it shares
    at least ``t * n`` of the source's ``n`` trigrams, so it holds one of the first
    ``e - ceil(t * n) + 1`` of the ``e`` that occur among the targets: the others, those with the
    longest postings, are not read. What both sides still have behind the common trigram bounds
    the score before any set is compared. Postings that many columns share are dealt into cells of at
    most ``cell`` columns a side.
    """

    def __init__(self, catalog: DataFrame, k: int, cell: int = 4096):
        self.k, self.cell = k, cell
        grams = gram_codes(F.col("name"))
        sets = catalog.select("pair_id", "side", F.col("ordinal").cast("bigint").alias("ord"), "name", grams.alias("elems"))
        ordered = settle(rare_first(sets.withColumn("n", F.size("elems"))))
        self.src = ordered.filter(F.col("side") == "source").select(
            "pair_id", F.col("ord").alias("src_ord"), F.col("name").alias("src"), F.col("n").alias("n_src_grams"), "elems"
        )
        self.tgt = ordered.filter(F.col("side") == "target").select(
            "pair_id", F.col("ord").alias("tgt_ord"), F.col("name").alias("tgt"), F.col("n").alias("n_tgt_grams"), "elems"
        )
        self.seeds = settle(ranked(self._met(self.src.withColumn("bar", F.lit(0.0)), self.seeding()), k))
        bars = self.seeds.filter(F.col("rank") == k).select("pair_id", "src_ord", F.col("score").alias("bar"))
        self.barred = settle(
            self.src.join(bars, ["pair_id", "src_ord"], "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        )

    @staticmethod
    def seeding() -> Column:
        """Number of leading trigrams that are looked up first."""
        return F.ceil(F.size("elems") * SEED_SHARE).cast("int")

    @staticmethod
    def keep() -> Column:
        """Number of leading trigrams to look up under the bar; all while there is none."""
        needed = F.greatest(F.ceil(F.col("bar") * F.col("n_src_grams") - 1e-9), F.lit(1))
        return (F.size("elems") - needed + 1).cast("int")

    def _met(self, src: DataFrame, keep: Column, start: Column | None = None) -> DataFrame:
        """Scored pairs that share a looked-up trigram and can reach the source's bar."""
        total = F.col("n_src_grams") + F.col("n_tgt_grams")
        possible = F.col("ub") / (total - F.col("ub")).cast("double") >= F.col("bar")
        met = meet(src, self.tgt, keep, possible, self.cell, start)
        score = F.col("overlap") / (total - F.col("overlap")).cast("double")
        return met.select("pair_id", "src", "src_ord", "tgt", "tgt_ord", score.alias("score"), "bar").filter("score >= bar").drop("bar")

    def lookups(self) -> DataFrame:
        """pair_id, src_ord, bar, and the postings that are read and that there are."""
        kept = F.slice("elems", F.lit(1), F.greatest(self.keep(), self.seeding()))
        read = F.aggregate(kept, F.lit(0).cast("bigint"), lambda n, e: n + e.n_tgt)
        every = F.aggregate("elems", F.lit(0).cast("bigint"), lambda n, e: n + e.n_tgt)
        return self.barred.select("pair_id", "src_ord", "bar", read.alias("n_read"), every.alias("n_postings"))


#: Sources that are scored together; trigrams that must be met in postings; postings of more than this part of a chunk are long.
BLOCK, SPARE, LONG = 64, 4, 64


def _by_shared_grams(
    texts: list[str], firsts: list[int], bars: dict[str, float], k: int
) -> Iterator[tuple[str, list[tuple[int, float]]]]:
    """Score only targets that share enough trigrams for the bar, through the postings of the chunk.

    Fewer than ``k`` such targets are padded with the chunk's first targets at 0.0: of
    its first k at most as many are hits as there are hits, so enough zeros remain.
    """
    postings: dict[str, list[int]] = {}
    sizes = np.empty(len(texts))
    for i, text in enumerate(texts):
        grams = _grams(text)
        sizes[i] = len(grams)
        for gram in grams:
            postings.setdefault(gram, []).append(i)
    lists = {gram: np.array(members) for gram, members in postings.items()}
    order = np.array(firsts, dtype=np.int64)
    yield from _over_bars(lists, sizes, order, {text: bar for text, bar in bars.items() if bar > 0}, k)
    padding = np.argsort(order, kind="stable")[:k].tolist()
    for text, bar in bars.items():
        if bar > 0:
            continue
        grams = _grams(text)
        met = [lists[g] for g in grams if g in lists]
        best: list[tuple[int, float]] = []
        if met:
            overlap = np.bincount(np.concatenate(met), minlength=len(texts))
            hits = np.flatnonzero(overlap)
            shared = overlap[hits]
            scores = shared / (len(grams) + sizes[hits] - shared)
            floor = 0.0
            if len(hits) > k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= floor)
            near = near[np.lexsort((order[hits[near]], -scores[near]))[:k]]
            best = list(zip(hits[near].tolist(), scores[near].tolist()))
        if len(best) < k:
            seen = {i for i, _ in best}
            best += [(i, 0.0) for i in padding if i not in seen]
        yield text, best


def _over_bars(
    lists: dict[str, np.ndarray], sizes: np.ndarray, order: np.ndarray, bars: dict[str, float], k: int
) -> Iterator[tuple[str, list[tuple[int, float]]]]:
    """First ``k`` targets that reach the source's bar, ``BLOCK`` sources at a time.

    A target of ``m`` trigrams that reaches the bar ``t`` shares at least ``t * (n + m) / (1 + t)`` of a source's ``n``.
    So one that shares ``SPARE`` fewer than that with all but the longest postings is no hit: the longest are
    not read. They are kept as rows of 0 and 1 too, at most ``LONG`` times as many as a target has trigrams on average,
    where the targets left are looked up.
    """
    if not bars or not len(sizes):
        yield from ((text, []) for text in bars)
        return
    n_tgt, smallest = len(sizes), sizes.min()
    # Trigrams are numbered by the lengths of their postings, so the last ones are the long ones.
    by_length = sorted(lists.values(), key=len)
    number = {g: i for i, g in enumerate(sorted(lists, key=lambda g: len(lists[g])))}
    first_long = sum(len(members) * LONG <= n_tgt for members in by_length)
    # The last row stands for no trigram.
    rows = np.zeros((len(by_length) - first_long + 1, n_tgt), np.uint8)
    for row, members in enumerate(by_length[first_long:]):
        rows[row, members] = 1
    # A target shares no more trigrams than it has.
    kind = np.uint8 if sizes.max() < 256 else np.uint32
    items = list(bars.items())
    for at in range(0, len(items), BLOCK):
        block = items[at : at + BLOCK]
        n, enough = np.zeros(len(block)), np.full(len(block), np.iinfo(kind).max, kind)
        read: list[np.ndarray] = []
        reader: list[int] = []
        unread: list[list[int]] = []
        for i, (text, bar) in enumerate(block):
            grams = _grams(text)
            n[i] = len(grams)
            needed = max(math.ceil(max(bar * len(grams), bar * (len(grams) + smallest) / (1 + bar)) - 1e-9), 1)
            met = sorted([number[g] for g in grams if g in number])
            unread.append([])
            if needed > min(len(met), sizes.max()):
                continue
            while needed > SPARE and met[-1] >= first_long:
                unread[-1].append(met.pop() - first_long)
                needed -= 1
            enough[i] = needed
            read += [by_length[g] for g in met]
            reader += [i] * len(met)
        overlap = np.zeros(len(block) * n_tgt, kind)
        if read:
            start = np.repeat(np.array(reader) * n_tgt, list(map(len, read)))
            np.add.at(overlap, np.concatenate(read) + start, kind(1))
        found = np.flatnonzero(overlap.reshape(len(block), -1) >= enough[:, None])
        row, hits = np.divmod(found, n_tgt)
        width = max(map(len, unread))
        padded = np.array([u + [len(rows) - 1] * (width - len(u)) for u in unread], np.int64).reshape(len(block), width)
        shared = overlap[found] + rows[padded[row], hits[:, None]].sum(axis=1, dtype=np.int64)
        scores = shared / (n[row] + sizes[hits] - shared)
        kept = scores >= np.array([bar for _, bar in block])[row]
        row, hits, scores = row[kept], hits[kept], scores[kept]
        best = np.lexsort((order[hits], -scores, row))
        ends = np.searchsorted(row[best], np.arange(len(block) + 1))
        for i, (text, _) in enumerate(block):
            top = best[ends[i] : min(ends[i] + k, ends[i + 1])]
            yield text, list(zip(hits[top].tolist(), scores[top].tolist()))


def trigram_match(catalog: DataFrame, k: int = 5, cell: int = 8192) -> DataFrame:
    """Exact top-k of every source over all targets of its pair; zero scores are kept.

    Names under three characters have no trigrams and score 0.0, even when equal. A cell holds
    about ``cell`` columns a side; the pair's sources are its queries, and its targets are indexed in it.
    """

    def reach(a: Column, b: Column) -> Column:
        return F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))

    return grid_top_k(catalog, k, _by_shared_grams, F.size(trigrams(F.col("low"))), reach, cell, cell)


#: Postings of more than this part of a pair's targets are kept as rows of 0 and 1.
DENSE = 32
#: Sources that go into one batch of a cell's result.
BATCH = 256

LEVEL = "family string, s double, n bigint, tgt_ord bigint, tgt string"
FIRST = "family string, s double, tgt_ord bigint, tgt string"
SUMS = "family string, n bigint, s_sum double, s_squares double, s_max double"
PROFILE_KEY = ["pair_id", "src_ord", "src", "src_family"]
PROFILE_SCHEMA = (
    "pair_id string, src_ord bigint, src string, src_family string, wide boolean, "
    + ", ".join(f"{name} array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>" for name, kind in (("levels", LEVEL), ("first", FIRST), ("sums", SUMS)))
)


def _gram_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts, as in ``gram_codes``, and the numbers of the texts that hold them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = np.flatnonzero(owner[2:] == owner[: max(len(owner) - 2, 0)])
    return points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2], owner[whole]


class LevelIndex:
    """A pair's targets in a cell, ordered by family and ordinal, with their trigrams' postings.

    What a source has in common with all of them is counted by (common trigrams, family, size of the target):
    few numbers, from which the levels, their sums and the first targets follow.
    """

    def __init__(self, ordinals: np.ndarray, texts: list[str], families: list[str]):
        self.families = sorted(set(families))
        number = {f: i for i, f in enumerate(self.families)}
        family = np.array([number[f] for f in families], np.int64)
        #: Rows of the given targets in this order.
        self.rows = np.lexsort((ordinals, family))
        family = family[self.rows]
        self.n = len(texts)
        codes, owner = _gram_numbers([texts[i] for i in self.rows.tolist()])
        grams, ids = np.unique(codes, return_inverse=True)
        postings = np.sort(ids.astype(np.int64) * self.n + owner)
        ids, self.members = np.divmod(postings[np.diff(postings, prepend=-1) > 0], max(self.n, 1))
        self.begin = np.searchsorted(ids, np.arange(len(grams) + 1))
        self.number = dict(zip(grams.tolist(), range(len(grams))))
        kinds, self.kind = np.unique(family * (1 << 32) + np.bincount(self.members, minlength=self.n), return_inverse=True)
        self.kind_family, self.kind_size = kinds >> 32, (kinds & 0xFFFFFFFF).astype(float)
        self.bounds = np.searchsorted(family, np.arange(len(self.families) + 1)).tolist()
        # Memory that sources use one after another.
        self.code, self.last_first = np.empty(self.n, np.int64), np.arange(self.n - 1, -1, -1)
        often = np.flatnonzero(np.diff(self.begin) * DENSE > self.n)
        self.dense = {g: row for row, g in enumerate(often.tolist())}
        self.matrix = np.zeros((len(often), self.n), np.uint8)
        for row, g in enumerate(often.tolist()):
            self.matrix[row, self.members[self.begin[g] : self.begin[g + 1]]] = 1

    def common(self, met: list[int]) -> np.ndarray:
        """By target, how many of the trigrams it holds."""
        kind = np.uint8 if len(met) < 256 else np.uint32
        out, read = np.zeros(self.n, kind), []
        for g in met:
            if g in self.dense:
                out += self.matrix[self.dense[g]]
            else:
                read.append(self.members[self.begin[g] : self.begin[g + 1]])
        if read:
            np.add.at(out, np.concatenate(read), kind(1))
        return out

    def of(self, text: str | None, k: int, with_levels: bool) -> tuple | None:
        """(levels, first, sums) of a source as columns, targets by their place here; None if no trigram is common."""
        grams = _grams(text)
        met = [self.number[c] for c in (ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams) if c in self.number]
        if not met:
            return None
        common, n_kinds = self.common(met), len(self.kind_size)
        # Short numbers are added up faster; what reads the codes needs long ones.
        kind = np.uint16 if (len(met) + 1) * n_kinds < 1 << 16 else np.int64
        code = self.code
        code[:] = np.multiply(common, kind(n_kinds), dtype=kind) + self.kind.astype(kind)
        counts = np.bincount(code, minlength=(len(met) + 1) * n_kinds)
        bins = np.flatnonzero(counts[n_kinds:]) + n_kinds
        shared, kind = np.divmod(bins, n_kinds)
        s = shared / (len(grams) + self.kind_size[kind] - shared)
        order = np.lexsort((-s, self.kind_family[kind]))
        bins, shared, s, family = bins[order], shared[order], s[order], self.kind_family[kind[order]]
        new = np.r_[True, (np.diff(s) != 0) | (np.diff(family) != 0)]
        start, level = np.flatnonzero(new), np.cumsum(new) - 1
        n, level_family, level_s = np.add.reduceat(counts[bins], start), family[start], s[start]
        heads = np.flatnonzero(np.r_[True, np.diff(level_family) != 0])
        sums = (
            level_family[heads],
            np.add.reduceat(n, heads),
            np.add.reduceat(n * level_s, heads),
            np.add.reduceat(n * level_s * level_s, heads),
            level_s[heads],
        )
        levels = None
        if with_levels:
            # Written from the last target to the first, so that the first one stays.
            least = np.empty(len(counts), np.int64)
            least[code[::-1]] = self.last_first
            levels = level_family, level_s, n, np.minimum.reduceat(least[bins], start)
        # A level is asked for if fewer than k targets of its family stand before it.
        before = np.cumsum(n) - n
        wanted = before - np.repeat(before[heads], np.diff(np.r_[heads, len(n)])) < k
        place = np.full(len(counts), -1)
        place[bins] = np.where(wanted[level], level, -1)
        asked = wanted[level]
        picked = []
        for f in level_family[heads].tolist() if k > 0 else ():
            lo, hi = self.bounds[f], self.bounds[f + 1]
            near = np.flatnonzero(common[lo:hi] >= shared[asked & (family == f)].min()) + lo
            at = place[code[near]]
            best = at[at >= 0] * self.n + near[at >= 0]
            best = np.sort(np.partition(best, k - 1)[:k] if len(best) > k else best)
            picked.append(best % self.n)
        picks = np.concatenate([np.empty(0, np.int64), *picked])
        at = place[code[picks]]
        return levels, (level_family[at], level_s[at], picks), sums


def _profile_function(k: int, with_levels: bool, schema: pa.Schema):
    def nested(name: str, parts: list[tuple | None], families: pa.Array, ordinals: np.ndarray, names: pa.Array) -> pa.Array:
        """One list a source; a part's first column is the family, its last the target, but for sums."""
        kind = schema.field(name).type
        columns = [np.concatenate(c) for c in zip(*(p for p in parts if p is not None))]
        ends = np.cumsum([0] + [0 if p is None else len(p[0]) for p in parts])
        if not columns:
            return pa.array([[]] * len(parts), kind)
        targets = [] if name == "sums" else [pa.array(ordinals[columns[-1]]), names.take(pa.array(columns[-1]))]
        plain = [families.take(pa.array(columns[0])), *map(pa.array, columns[1 : len(columns) - bool(targets)]), *targets]
        fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
        rows = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(plain, fields)], fields=fields)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=kind)

    def one_pair(src: pa.Table, tgt: pa.Table) -> Iterator[pa.RecordBatch]:
        ordinals = tgt["tgt_ord"].to_numpy()
        index = LevelIndex(ordinals, [t or "" for t in tgt["low"].to_pylist()], tgt["family"].to_pylist())
        ordinals, names = ordinals[index.rows], tgt["tgt"].combine_chunks().take(pa.array(index.rows))
        families, wide = pa.array(index.families), tgt["wide"][0].as_py()
        for at in range(0, len(src), BATCH):
            block = src.slice(at, BATCH)
            found = [index.of(t, k, with_levels) or (None, None, None) for t in block["low"].to_pylist()]
            lists = [nested(name, list(part), families, ordinals, names) for name, part in zip(("levels", "first", "sums"), zip(*found))]
            plain = [block[c].combine_chunks().cast(schema.field(c).type) for c in PROFILE_KEY]
            yield pa.RecordBatch.from_arrays([*plain, pa.array([wide] * len(block)), *lists], schema=schema)

    def rows_of(table: pa.Table) -> dict[str, np.ndarray]:
        pairs = table["pair_id"].combine_chunks().dictionary_encode()
        codes = pairs.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(pairs.dictionary) + 1))
        return {p: order[ends[i] : ends[i + 1]] for i, p in enumerate(pairs.dictionary.to_pylist())}

    def cell(src: pa.Table, tgt: pa.Table) -> pa.Table:
        of_src, of_tgt = rows_of(src), rows_of(tgt)
        both = ((src.take(pa.array(of_src[p])), tgt.take(pa.array(of_tgt[p]))) for p in of_src if p in of_tgt)
        return pa.Table.from_batches([batch for pair in both for batch in one_pair(*pair)], schema)

    return cell


def trigram_profiles(
    catalog: DataFrame, k: int = 5, src_cell: int = 8192, tgt_cell: int = 262_144, with_levels: bool = True
) -> DataFrame:
    """One row a source about its positive similarities to all targets of its pair, without the pairs.

    ``levels``: so many targets ``n`` of ``family`` have the similarity ``s``, and the first of them by ordinal; a
    name's length bounds how many there are. ``first``: its first ``k`` targets of every family, best first. ``sums``:
    by family the number of similarities, their sum and that of their squares, and the largest. Without ``with_levels`` the levels are
    counted alike, but not listed. A source meets all targets of its pair in one cell, unless these are
    more than ``tgt_cell``: then the parts of a source, one for each chunk, are put together by an aggregation, and
    ``first`` has the first ``k`` of every chunk.
    """
    schema = to_arrow_schema(StructType.fromDDL(PROFILE_SCHEMA))
    parts, any_wide = grid_every(catalog, _profile_function(k, with_levels, schema), PROFILE_SCHEMA, src_cell, tgt_cell)
    if not any_wide:
        return parts
    parts = settle(parts)
    wide = parts.filter("wide")
    first = F.min(F.struct("tgt_ord", "tgt")).alias("first")
    levels = (
        wide.select(*PROFILE_KEY, F.inline("levels"))
        .groupBy(*PROFILE_KEY, "family", "s")
        .agg(F.sum("n").alias("n"), first)
        .groupBy("pair_id", "src_ord")
        .agg(F.collect_list(F.struct("family", "s", "n", "first.tgt_ord", "first.tgt")).alias("levels"))
    )
    whole = (
        wide.groupBy(*PROFILE_KEY, "wide")
        .agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("first", "sums")])
        .join(merged(levels), ["pair_id", "src_ord"], "left")
        .withColumn("levels", F.coalesce("levels", F.array().cast(parts.schema["levels"].dataType)))
    )
    return parts.filter(~F.col("wide")).unionByName(whole)


def trigram_levels(catalog: DataFrame, k: int = 5, **cells: int) -> DataFrame:
    """``trigram_profiles`` in plain rows: levels have ``n`` > 0, the first targets 0."""
    profiles = settle(trigram_profiles(catalog, k, **cells))
    columns = ["pair_id", "src_ord", "src", "family", "s", "n", "tgt_ord", "tgt"]
    single = profiles.select(*PROFILE_KEY, F.inline("first")).withColumn("n", F.lit(0).cast("bigint"))
    return profiles.select(*PROFILE_KEY, F.inline("levels")).select(*columns).unionByName(single.select(*columns))
