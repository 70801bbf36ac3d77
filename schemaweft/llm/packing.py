"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily with the longest piece that fits; then its smallest piece is replaced
by two unpacked ones that fill the widened gap more tightly. Lengths are bounded by the sequence
length, so the plan is made over counts by length: bins with the same lengths are planned
together, and the plan is as small for a billion pieces as for a thousand. Pieces find
their places by their number within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import join_small, positions, retained, settle, tidy

LENGTH = 4096
END_ID = 1
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000
RUNS = regex.compile(r"\p{L}+|[^\p{L}]+")


class WordIds:
    """Token ids of texts by a tokenizer of words: ASCII white space always ends a token.

    Each distinct word is put together once, from its runs of letters and what is between them.
    Runs of letters are tokenised many at a time, as one text; a token that ends a word shows
    where the next begins. Words with an apostrophe and texts in which a special token could
    stand are left to the tokenizer as they are.
    """

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.runs: dict[str, bytes] = {}
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, "<u4")
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[bytes]) -> None:
        """Number the words and keep their ids, one after the other, in ``flat``."""
        split = [_split(w.decode()) for w in new]
        fresh = [r for r in dict.fromkeys(chain.from_iterable(split)) if r not in self.runs]
        letters = [r for r in fresh if r.isalpha()]
        for at in range(0, len(letters), 500):
            some = letters[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.runs.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for r in fresh:
            if r not in self.runs:
                self.runs[r] = self._whole(r).tobytes()
        ids = [b"".join(map(self.runs.__getitem__, runs)) for runs in split]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total, first = int(counts.sum()), len(self.number)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), "<u4")
        self.starts[first : first + len(new)] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + len(new)] = counts
        self.number.update(zip(new, range(first, first + len(new))))
        self.used += total

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        # The tokenizer lower-cases; doing so for A-Z first lets more words be known.
        data = [t.encode("utf-8", "replace").lower() for t in texts]
        whole = [any(s in d for s in self.specials) for d in data]
        split = [[] if w else d.split() for d, w in zip(data, whole)]
        if len(self.number) > self.remembered:
            self.forget()
        new = list(set().union(*split).difference(self.number))
        if new:
            self._learn(new)
        out = []
        for text, special, words in zip(texts, whole, split):
            if special:
                out.append(self._whole(text))
                continue
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            counts = self.counts[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(total)])
        return out


def _split(word: str) -> list[str]:
    """Runs of letters and of others; the whole word where they can't be told apart safely."""
    if word.isascii():
        return [word] if "'" in word or word.isalpha() else RUNS.findall(word)
    small = "".join(map(str.lower, word))
    safe = "'" not in word and len(small) == len(word) and is_normalized("NFC", word) and is_normalized("NFC", small)
    return RUNS.findall(small) if safe else [word]


def _word_ids(path: str, remembered: int) -> WordIds:
    """One per worker and tokenizer, kept between batches and tasks until another step's task comes."""
    return retained((path, remembered), lambda: WordIds(path, remembered))


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenise(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, text -> one row per piece of at most ``length`` tokens.

    A document is its ids and the end id; only longer ones are cut, each piece but the last
    being full. A NULL or empty text is the end id alone. Ids come along on request. A worker forgets its
    words' ids beyond ``remembered`` words: fewer of them save memory and cost time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(tokenizer_path, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                encoded = encoder.batch([t or "" for t in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), length)):
                        part = ids[start : start + length]
                        row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))
                        rows.append((*row, part.astype("<i4")) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(6 if with_ids else 5)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: tidy(cut(it)), PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in a bin) of a best-two-fit packing of pieces, by counts."""
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bins = []
    while left.any():
        present = left > 0
        at_most = np.maximum.accumulate(np.where(present, np.arange(length + 1), 0))
        # Many bins of one kind are planned at once while every length in them lasts.
        filled: list[int] = []
        use: Counter[int] = Counter()
        gap = length
        while gap > 0:
            n = int(at_most[gap])
            while n and use[n] >= left[n]:
                n = int(at_most[n - 1])
            if not n:
                break
            again = min(gap // n, int(left[n]) - use[n])
            filled += [n] * again
            use[n] += again
            gap -= n * again
        if gap > 0 and len(filled) > 0:
            smallest = filled[-1]
            pair = _two_for(left, use, smallest, gap, length)
            if pair:
                use[smallest] -= 1
                filled.pop()
                filled += pair
                use.update(pair)
        times = min(int(left[n]) // c for n, c in use.items() if c)
        for n, c in use.items():
            left[n] -= c * times
        bins.append((times, filled))
    return bins


def _two_for(left: np.ndarray, use: Counter, smallest: int, gap: int, length: int) -> list[int] | None:
    """The two unpacked lengths that fill gap + smallest best, if better than ``smallest`` does."""
    room = gap + smallest
    free = left.copy()
    for n, c in use.items():
        free[n] -= c
    have = np.flatnonzero(free[: room + 1] > 0)
    have = have[have > 0]
    if len(have) == 0:
        return None
    fits = np.maximum.accumulate(np.where(free > 0, np.arange(length + 1), 0))
    second = fits[room - have]
    # The same length twice takes two of it.
    alone = (second == have) & (free[have] < 2)
    second[alone] = fits[np.maximum(have[alone] - 1, 0)]
    sums = np.where(second > 0, have + second, 0)
    best = int(sums.argmax())
    if sums[best] <= smallest:
        return None
    return sorted((int(have[best]), int(second[best])), reverse=True)


def slots(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number, sequence of the first, offset): places by length.

    The pieces of a length are numbered from 1; those from first to last go, one each, to the
    sequences from that of the first on, all at the same offset.
    """
    out, taken, sequence = [], Counter(), 0
    for times, lengths in bins:
        offset = 0
        for n in lengths:
            out.append((n, taken[n] + 1, taken[n] + times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, length: int = LENGTH, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (length between 1 and ``length``) with sequence_id and offset.

    Places depend on counts and ``order`` alone; pieces equal in it may swap. An empty table
    gives none. The plan has at most ``length`` counts as its input and is made on the driver.
    """
    numbered = settle(positions(pieces, ["length"], list(order)))
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "slot_length bigint, first bigint, last bigint, sequence bigint, offset bigint, page bigint"
    # A slot is listed under every page of numbers that it covers, as an equality for the join.
    places = slots(plan(counts, length))
    page = max(1, max(counts.values(), default=1) // 64)
    rows = [(n, a, b, s, o, p) for n, a, b, s, o in places for p in range(a // page, b // page + 1)]
    placed = numbered.sparkSession.createDataFrame(rows, schema)
    number = F.col("pos")
    condition = (
        (F.col("length") == F.col("slot_length"))
        & (F.floor(number / page) == F.col("page"))
        & number.between(F.col("first"), F.col("last"))
    )
    joined = join_small(numbered, placed, condition, "inner", limit=2_000_000)
    return joined.select(
        *pieces.columns, (F.col("sequence") + number - F.col("first")).alias("sequence_id"), F.col("offset")
    )


def pack_apart(pieces: DataFrame, wide: tuple[str, ...] = ("ids",), length: int = LENGTH) -> DataFrame:
    """As ``pack``, for pieces with wide columns: these meet their places by row, at the end.

    Numbering puts pieces in order by length into a few ranges, so that one would hold the longest of all.
    """
    rows = settle(pieces.withColumn("_row", F.monotonically_increasing_id()))
    places = pack(rows.drop(*wide), length).withColumnRenamed("_row", "_place")
    whole = rows.select("_row", *wide).join(places, F.col("_row") == F.col("_place"))
    return whole.select(*pieces.columns, "sequence_id", "offset")
