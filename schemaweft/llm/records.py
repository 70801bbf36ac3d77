"""Token ids in files of length-delimited records, with an offset index for shuffled reads.

A record is a frame around one document's ids::

    uint64 length | uint32 checksum of the length | payload | uint32 checksum of the payload

little-endian, checksums CRC-32C, rotated by 15 bits and shifted by a constant, so that checksums
of data that hold checksums stay apart. The payload is ``uint32 flags, int64 doc_id, ids...``, ids
as uint16 where the vocabulary allows it, else as uint32, padded to a whole word. Flags: 1 for a
doc_id, 2 for two bytes of padding, 4 for ids of four bytes. Beside each data file lies
``<file>.index``: for each record the uint64 offset and the number of ids before it, and the file's end.

Files hold consecutive ranges of doc_id. A task writes its file under a name of its own and returns a
manifest row; only files in the settled manifest count, so what a lost or repeated task left
behind is never read. Files are opened through ``pyarrow.fs``, so the shared folder may be any
store that it knows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweft.llm.common import settle, shared_folder

END_ID = 0
#: Bytes of text to a file, and records to a unit of reading.
FILE_BYTES = 32 << 20
UNIT_RECORDS = 1024
#: Bytes of text that are encoded and framed at a time, and distinct words whose ids a worker remembers.
STEP_BYTES = 8 << 20
REMEMBERED = 800_000
#: The reflected polynomial of CRC-32C and the constant of masked checksums.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: Words of a frame before its payload, of the payload's head, and behind the payload.
FRAME, HEAD, TAIL = 3, 3, 1
HAS_ID, PADDED, WIDE = 1, 2, 4
#: Words of a segment whose checksum is taken in step with those of all others.
SEGMENT = 256
#: Marks that stand alone behind a letter, and the first character that is not taken for one.
MARKS, LETTERS_END = ".,;:!?)", "\u0250"
MANIFEST = "part int, path string, records bigint, tokens bigint, bytes bigint"


class Numbers(dict):
    """Words in the order in which they are first asked for: asking numbers a new one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class ByteIds:
    """Token ids by a byte-level tokenizer whose tokens hold white space only in front.

    A text is cut before single spaces and line breaks, where no token can span, and each
    distinct word is tokenised once, many at a time; byte lengths of tokens show where the next word
    begins. Marks behind a letter are tokens of their own, so a word with marks is put together.
    Texts with other white space, longer runs of it or special tokens go to the tokenizer as they are.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        # Words that are left to the tokenizer stand for one id, the first, until their text is.
        self.flat = np.zeros(1, "<u4")
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _left_alone(self, led: pa.Array) -> np.ndarray:
        """Texts (behind a line break) that are not cut: see the class."""
        found = pc.or_(pc.ends_with(led, " "), pc.ends_with(led, "\n\n"))
        for part in ("  ", " \n", "\n\n\n", "\n\n ", *self.specials):
            found = pc.or_(found, pc.match_substring(led, part))
        return found.to_numpy(zero_copy_only=False)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has."""
        ids = [self._whole("".join(chunks[at : at + 5000])) for at in range(0, len(chunks), 5000)]
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        sizes = np.cumsum([len(c.encode()) for c in chunks], dtype=np.int64)
        return flat, np.diff(np.searchsorted(np.cumsum(self.size[flat]), sizes, side="right"), prepend=0)

    def _learn(self, new: list[str]) -> None:
        whole, stems, marks = [], {}, {}
        for w in new:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem and stem[-1].isalpha() and stem[-1] < LETTERS_END:
                stems[w] = stem
                marks.setdefault(w[len(stem) :], len(marks))
                if stem not in self.number:
                    whole.append(stem)
                    self.number[stem]
            else:
                whole.append(w)
        chunks = [w if w[:1] in ("\n", "") else " " + w for w in whole]
        odd = [not c[1:].isprintable() for c in chunks]
        flat, counts = self._ids([c for c, bad in zip(chunks, odd, strict=True) if not bad])
        grown = np.zeros(len(self.number) - len(self.counts), np.int64)
        self.starts, self.counts = np.concatenate([self.starts, grown]), np.concatenate([self.counts, grown])
        self.odd = np.concatenate([self.odd, grown > 0])
        at = np.fromiter(map(self.number.__getitem__, whole), np.int64, len(whole))
        self.odd[at], self.counts[at] = odd, 1
        at = at[~np.array(odd, bool)]
        self.counts[at], self.starts[at] = counts, len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, flat])
        if stems:
            tails = [self._whole(m) for m in marks]
            n = np.array([len(x) for x in tails])
            tail = np.fromiter((marks[w[len(s) :]] for w, s in stems.items()), np.int64, len(stems))
            at, base = (np.fromiter(map(self.number.__getitem__, names), np.int64, len(stems)) for names in (stems, stems.values()))
            both = np.concatenate([self.flat, *tails])
            starts = np.stack([self.starts[base], (len(self.flat) + np.cumsum(n) - n)[tail]], 1)
            counts = np.stack([self.counts[base], n[tail]], 1)
            self.odd[at] = self.odd[base]
            self.counts[at] = counts.sum(1)
            self.starts[at] = len(self.flat) + np.cumsum(self.counts[at]) - self.counts[at]
            self.flat = np.concatenate([self.flat, gathered(both, starts.ravel(), counts.ravel())])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` behind those of each, and how many each has."""
        if len(self.number) > REMEMBERED:
            self.forget()
        led = pc.binary_join_element_wise("\n", texts, "")
        alone = self._left_alone(led)
        # Each text is "", its line break with the first word, and its other words.
        led = pc.if_else(pa.array(alone), "\n", led)
        pieces = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        encoded, firsts = pieces.flatten().dictionary_encode(), pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        known, words = len(self.number), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[encoded.indices.to_numpy()]
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        counts = np.add.reduceat(self.counts[place], firsts)
        alone |= np.add.reduceat(self.odd[place].astype(np.int64), firsts) > 0
        # The line break in front of a text gives way to the end of the text before.
        ids = np.roll(gathered(self.flat, self.starts[place], self.counts[place]), -1)
        ends = np.cumsum(counts)
        ids[ends - 1] = end_id
        if alone.any():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(alone):
                parts[i] = np.append(self._whole(texts[i].as_py()), np.uint32(end_id))
            ids, counts = np.concatenate(parts), np.array([len(part) for part in parts], np.int64)
        return ids, counts


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one behind the other."""
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: what a word does to a checksum, and what SEGMENT zero words do to one."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [table]
    for _ in range(3):
        rows.append((rows[-1] >> np.uint32(8)) ^ table[rows[-1] & np.uint32(255)])
    word = np.stack(rows[::-1])
    far = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(SEGMENT):
        far = _step(word, far)
    return word, far


def _step(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    low, high = x & np.uint32(0xFFFF), x >> np.uint32(16)
    return tables[0][low & 255] ^ tables[1][low >> 8] ^ tables[2][high & 255] ^ tables[3][high >> 8]


WORD_TABLES, FAR_TABLES = _tables()


def masked_checksums(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of the runs words[start : start + count], at least a word each.

    Runs are cut into segments, the first of them the short one; segments go in step, word by word,
    and are then put together in step, segment by segment.
    """
    pieces = -(-counts // SEGMENT)
    order = np.argsort(-pieces, kind="stable")
    starts, counts, pieces = starts[order], counts[order], pieces[order]
    first = counts - (pieces - 1) * SEGMENT
    run = np.repeat(np.arange(len(counts)), pieces)
    place = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[run] + np.where(place > 0, first[run] + (place - 1) * SEGMENT, 0)
    length = np.where(place > 0, SEGMENT, first[run])
    by_length = np.argsort(-length, kind="stable")
    begin, length = begin[by_length], length[by_length]
    state = np.where(place[by_length] > 0, np.uint32(0), np.uint32(0xFFFFFFFF))
    active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
    for k in range(int(length.max(initial=0))):
        n = active[k]
        state[:n] = _step(WORD_TABLES, state[:n] ^ words[begin[:n] + k])
    segments = np.empty_like(state)
    segments[by_length] = state
    at = np.cumsum(pieces) - pieces
    sums = segments[at].copy() if len(at) else np.zeros(0, np.uint32)
    for k in range(1, int(pieces.max(initial=0))):
        n = np.searchsorted(-pieces, -k, side="left")
        sums[:n] = _step(FAR_TABLES, sums[:n]) ^ segments[at[:n] + k]
    sums = ~sums
    out = np.empty_like(sums)
    out[order] = ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(MASK_DELTA)
    return out


def framed(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The records, as words, and the number of words of each."""
    body = counts if wide else (counts + 1) // 2
    sizes = FRAME + HEAD + body + TAIL
    at = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), "<u4")
    words[at] = 4 * (HEAD + body)
    padded = 0 if wide else counts % 2
    words[at + FRAME] = HAS_ID * doc_ids.is_valid().to_numpy(zero_copy_only=False) + PADDED * padded + WIDE * wide
    known = doc_ids.fill_null(0).to_numpy().view(np.uint64)
    words[at + FRAME + 1] = known & np.uint64(0xFFFFFFFF)
    words[at + FRAME + 2] = known >> np.uint64(32)
    kind, per = ("<u4", 1) if wide else ("<u2", 2)
    begin = per * (at + FRAME + HEAD) - (np.cumsum(counts) - counts)
    words.view(kind)[np.repeat(begin, counts) + np.arange(len(ids))] = ids
    words[at + 2] = masked_checksums(words, at, np.full(len(at), 2))
    words[at + sizes - 1] = masked_checksums(words, at + FRAME, HEAD + body)
    return words, sizes


def write_records(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every text, ``end_id`` behind them, under ``root``; the manifest, settled.

    Files and the records in them ascend by doc_id, rows without one first; rows of one doc_id stay in
    the order in which the table is read, repeated rows are records of their own, and one doc_id
    may fill any number of files. A NULL text is an empty one: its record holds ``end_id`` only. A very
    long text is one record. An empty table gives an empty manifest. Only doc_id and text are read.
    """
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = read.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    keyed = read.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row")]
    dealt = keyed.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, listed, part, end = None, None, [], None, np.zeros(2, np.int64)
        target, inside = fs.FileSystem.from_uri(root)
        path = f"{inside}/{uuid.uuid4().hex}.records"
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode, out, part = ByteIds(tokenizer_path), target.open_output_stream(path), batch["part"][0].as_py()
            length = pc.cumulative_sum(pc.binary_length(batch["text"]).cast(pa.int64())).to_numpy()
            at = 0
            while at < batch.num_rows:
                last = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + STEP_BYTES, side="right")))
                some = batch.slice(at, last - at)
                ids, counts = encode(some["text"], end_id)
                words, sizes = framed(some["doc_id"], ids, counts, wide=len(encode.size) > 1 << 16)
                out.write(words.tobytes())
                ends = end + np.stack([4 * np.cumsum(sizes), np.cumsum(counts)], 1)
                listed += [np.vstack([end, ends[:-1]])]
                end, at = ends[-1], last
        if out is not None:
            out.close()
            index = np.vstack([*listed, end]).astype("<u8")
            with target.open_output_stream(path + ".index") as beside:
                beside.write(index.tobytes())
            row = part, path.rpartition("/")[2], len(index) - 1, int(end[1]), int(end[0])
            kinds = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "path", "records", "tokens", "bytes"])

    return settle(dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(write, MANIFEST))


def read_records(spark: SparkSession, manifest: DataFrame, root: str, seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids (binary, uint32): a row per record.

    Units of consecutive records are found by the index and read with one range read each. With a
    ``seed``, units are dealt out at random and the records of a unit come in random order. Lengths and
    checksums are verified; a record that fails them is an error. An empty manifest gives no rows.
    """
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    # A row a file of some 32 MB: no more rows than a listing of the folder.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(UNIT_RECORDS).cast("long")))
    units = based.select("path", "records", "base", first.alias("first"))
    key = F.xxhash64(F.lit(seed or 0), "path", "first") if seed is not None else F.struct("path", "first")
    n = max(1, math.ceil(total / FILE_BYTES), spark.sparkContext.defaultParallelism if total else 1)
    dealt = units.repartition(n, key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for unit in batch.to_pylist():
                last = min(unit["first"] + UNIT_RECORDS, unit["records"])
                with store.open_input_file(f"{folder}/{unit['path']}.index") as listed:
                    raw = listed.read_at(16 * (last - unit["first"] + 1), 16 * unit["first"])
                offsets, before = np.frombuffer(raw, "<u8").astype(np.int64).reshape(-1, 2).T
                with store.open_input_file(f"{folder}/{unit['path']}") as data:
                    words = np.frombuffer(data.read_at(int(offsets[-1] - offsets[0]), int(offsets[0])), "<u4")
                at = (offsets[:-1] - offsets[0]) // 4
                counts = np.diff(before)
                verify(words, at, np.diff(offsets) // 4, counts)
                order = np.arange(len(at)) if seed is None else np.random.default_rng([seed, unit["first"]]).permutation(len(at))
                flags, low, high = words[at + FRAME], words[at + FRAME + 1].astype(np.uint64), words[at + FRAME + 2].astype(np.uint64)
                doc_ids = (low | high << np.uint64(32)).view(np.int64)
                begin = (4 * (at + FRAME + HEAD))[order].tolist()
                raw, kinds = words.tobytes(), np.where(flags & WIDE, "<u4", "<u2")[order].tolist()
                bodies = [np.frombuffer(raw, k, n, b).astype("<u4").tobytes() for b, n, k in zip(begin, counts[order].tolist(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[order], pa.int64(), mask=(flags & HAS_ID)[order] == 0),
                        pa.array((unit["base"] + before[:-1])[order], pa.int64()),
                        pa.array(counts[order], pa.int64()),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def verify(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
    """ValueError unless the frames at ``at`` have the lengths that the index gives, and their checksums."""
    flags = words[at + FRAME]
    body = np.where(flags & WIDE, counts, (counts + 1) // 2)
    sound = (sizes == FRAME + HEAD + body + TAIL) & (words[at] == 4 * (HEAD + body)) & (words[at + 1] == 0)
    sound &= words[at + 2] == masked_checksums(words, at, np.full(len(at), 2))
    sound &= words[at + sizes - 1] == masked_checksums(words, at + FRAME, sizes - FRAME - TAIL)
    if not sound.all():
        raise ValueError(f"{int((~sound).sum())} of {len(at)} records are damaged")


def token_records(docs: DataFrame, tokenizer_path: str, seed: int | None = None) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared one and read them back (see both)."""
    spark = docs.sparkSession
    root = shared_folder(spark)
    return read_records(spark, write_records(docs, tokenizer_path, root), root, seed)
