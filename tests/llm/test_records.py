"""Record files of token ids: an exact round trip, and damage that is noticed."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from schemaweft.llm import records
from schemaweft.llm.queries import tokenizer_path
from schemaweft.session import shared_folder

PATH = tokenizer_path("byte_bpe_50k.json")
PIECES = "a b é ß 日本 the Word 's I'm 12 x1 , . ;) ... <|endoftext|> ᠎ \x1c".split(" ") + [" ", " ", "\n", "\n\n", "\t", "　", "\xa0", "  ", "\r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts(n, seed):
    draw = random.Random(seed)
    plain = PIECES[:16] + [" ", "\n"] * 6
    return ["".join(draw.choice(PIECES if i % 3 else plain) for _ in range(draw.randrange(0, 16))) for i in range(n)]


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 500)
    encode = records.ByteIds(PATH)
    for at in range(8):
        some = texts(1000, at) + ["", " ", "\n", "\n\n", " \n", "a\n", "a\n\n", "a ", "word, word. word)", "\n a", "\n\n a", "\n\nb"]
        ids, counts = encode(pa.array(some), 7)
        for text, own in zip(some, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 7], repr(text)


def masked(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    # Published value: 32 zero bytes have CRC-32C 8A9136AA.
    crc = 0x8A9136AA
    assert masked(bytes(32)) == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    words = np.random.default_rng(1).integers(0, 2**32, 3000, dtype=np.uint32)
    starts, counts = np.array([0, 3, 100, 200, 0, 5, 0]), np.array([8, 1, 255, 256, 257, 513, 3000])
    got = records.masked_checksums(words, starts, counts)
    assert got.tolist() == [masked(words[s : s + n].tobytes()) for s, n in zip(starts, counts)]
    assert len(records.masked_checksums(words, starts[:0], counts[:0])) == 0


def test_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(records, "UNIT_RECORDS", 7)
    monkeypatch.setattr(records, "STEP_BYTES", 300)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(101, 3))]
    rows += [(None, "no id"), (None, None), (-5, "below zero"), (4, "same id"), (4, "same id"), (2**62, "large id"), (500, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, path string, part int, start int, _row string")
    for file_bytes, seed in ((1 << 25, None), (2000, 5)):
        root = shared_folder(spark)
        manifest = records.write_records(docs.repartition(3), PATH, root, file_bytes=file_bytes)
        got = sorted(records.read_records(spark, manifest, root, seed).collect(), key=lambda r: r.start)
        assert len(got) == len(rows)
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        at = 0
        left = sorted((r[0] is not None, r[0] or 0, zlib.crc32(np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4"))) for r in rows)
        assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == left
        for r in got:
            assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
            at += r.n_tokens
    assert manifest.count() > 3


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert records.token_records(docs, PATH).collect() == []


def test_damage_is_an_error(spark):
    root = shared_folder(spark)
    manifest = records.write_records(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), PATH, root)
    store, folder = fs.FileSystem.from_uri(root)
    path = f"{folder}/{manifest.first().path}"
    with store.open_input_file(path) as data:
        raw = bytearray(data.read())
    # Any reader of this public framing finds the length and both checksums.
    n = int.from_bytes(raw[:8], "little")
    assert masked(raw[:8]) == int.from_bytes(raw[8:12], "little")
    assert masked(raw[12 : 12 + n]) == int.from_bytes(raw[12 + n : 16 + n], "little")
    raw[-6] ^= 1
    with store.open_output_stream(path) as out:
        out.write(bytes(raw))
    with pytest.raises(Exception, match="1 of 2 records are damaged"):
        records.read_records(spark, manifest, root).collect()
