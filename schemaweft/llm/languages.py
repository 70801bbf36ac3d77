"""Language ID by compression.

Each language has a dictionary of its own text, used as zstandard raw content. A text, as its
lower-cased words, is compressed against every dictionary, piece by piece, and belongs to the
language that makes it smallest; a narrow margin to the second is a rejection. Short texts are
compressed behind a primer of the language's own text and charged with what they add to it, so
that single matches count.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import retained, tidy

UNKNOWN = "und"
#: Sampled documents and dictionary bytes of each language, and bytes of all dictionaries together.
SAMPLE_DOCS, DICTIONARY_BYTES, TOTAL_BYTES = 64, 48_000, 256 * 48_000
PIECE, LEVEL = 4000, 12
SHORT, PRIMER, FINE_LEVEL = 100, 3000, 19
#: Least relative lead over the second best that is no rejection.
MARGIN = 0.005
LETTERS = re.compile(r"[^\W\d_]+")


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language -> dictionary, from ``labelled`` (doc_id, text, lang).

    A bounded sample is fitted: for each language and each of ``sample_docs`` classes of
    the id's hash, the document with the least hash; its text enters cut to its share of
    the language's bytes: ``dictionary_bytes``, or with many languages an even share of
    TOTAL_BYTES. Rows without a language or a text teach nothing.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)))
    chosen = known.groupBy("lang", F.pmod(hashed, F.lit(sample_docs)).alias("slot")).agg(F.min(hashed).alias("h")).collect()
    if not chosen:
        return {}
    languages = sorted({r.lang for r in chosen})
    room = max(4 * sample_docs, min(dictionary_bytes, TOTAL_BYTES // len(languages)))
    wanted = labelled.sparkSession.createDataFrame([(r.lang, r.h) for r in chosen], "lang string, h bigint")
    share = dictionary_bytes // sample_docs * 2
    rows = known.withColumn("h", hashed).join(F.broadcast(wanted), ["lang", "h"], "left_semi")
    # An id that repeats gives its first text alone.
    texts = rows.groupBy("lang", "h").agg(F.min(F.substring(F.lower("text"), 1, share)).alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: r.h):
        samples.setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    out = {language: b"\n".join(_shared(samples.get(language, []), room)) for language in languages}
    return {k: v for k, v in out.items() if v}


def _shared(texts: list[bytes], room: int) -> list[bytes]:
    """``texts`` cut, at whole characters, so that with a byte between they fit in ``room``.

    Each has an even share; what short texts leave goes to the longer ones.
    """
    left, cut = room - len(texts) + 1, [b""] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        cut[i] = texts[i][: left // (len(texts) - done)].decode("utf-8", "ignore").encode()
        left -= len(cut[i])
    return cut


@functools.lru_cache(maxsize=4)
def _coarse(items: tuple) -> list:
    made = []
    for _, content in items:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))
    return made


@functools.lru_cache(maxsize=4)
def _fine(items: tuple) -> list:
    """(compressor, primer, size of the primer alone) of each language."""
    made = []
    for _, content in items:
        primer, rest = content[:PRIMER], content[PRIMER:]
        d = zstandard.ZstdCompressionDict(rest or content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(FINE_LEVEL, source_size=PIECE, dict_size=len(content), min_match=3)
        d.precompute_compress(compression_params=how)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        made.append((c, primer, len(c.compress(primer))))
    return made


def classify(text: str | None, items: tuple) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text; score is the relative lead over the second best.

    A text without letters, or nothing to choose from, is ``und`` with score 0 and rejected.
    Equal sizes go to the first language by name.
    """
    words = LETTERS.findall(text.lower()) if text and items else None
    if not words:
        return UNKNOWN, 0.0, True
    data = f" {' '.join(words)} ".encode("utf-8", "replace")
    if len(data) < SHORT:
        sizes = np.array([len(c.compress(primer + data)) - alone for c, primer, alone in _fine(items)], np.float64)
    else:
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in _coarse(items)], np.float64)
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return items[best][0], 1.0, False
    lead = float(np.delete(sizes, best).min() - sizes[best])
    score = min(1.0, lead / max(1.0, float(sizes[best]) + lead))
    return items[best][0], score, score < MARGIN


def identify(docs: DataFrame, trained: dict[str, bytes], keep_text: bool = True) -> DataFrame:
    """``docs`` (with text) plus lang_pred, score (0 to 1) and rejected.

    Only the text is looked at. NULL, empty and letterless texts are ``und``; repeated rows get
    the same answer; other columns pass through. Columns of the three names are replaced.
    """
    items = tuple(sorted(trained.items()))
    docs = docs.drop("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        retained(__name__)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [classify(t.as_py(), items) for t in texts]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns], names=[*names, "lang_pred", "score", "rejected"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.mapInArrow(lambda it: tidy(predict(it)), ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))
