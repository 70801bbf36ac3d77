"""Document fingerprints: a threshold-scaled sketch.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so its size
follows the document's, sketches of parts merge into the sketch of the whole, and containment
between very unequal documents is estimated without bias. The smallest hash is kept in any case,
so that no text with a word has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import lower_ascii, words

SHINGLE = 5
FRACTION = 1 / 2
LOWEST = -(2**63)


def _ceiling(fraction: float) -> int:
    return LOWEST + int(2**64 * fraction) - 1


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of ``n`` lower-cased words; of all words where there are fewer.

    Words are hashed once; a shingle is the hash of its words' hashes.
    """
    return F.transform(F.array(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))), lambda h: _runs(h, n))[0]


def _runs(hashes: Column, n: int) -> Column:
    many = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]),
    )
    few = F.array(F.xxhash64(hashes))
    return F.when(F.size(hashes) >= n, many).when(F.size(hashes) > 0, few).otherwise(F.array().cast("array<bigint>"))


def _kept(hashes: Column, fraction: float) -> Column:
    below = F.filter(hashes, lambda h: h <= F.lit(_ceiling(fraction)))
    return F.when(F.size(hashes) > 0, F.array_sort(F.array_distinct(F.array_append(below, F.array_min(hashes))))).otherwise(hashes)


def sketch(text: Column, n: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes kept of a text: array<bigint>; empty for NULL or no words."""
    return F.transform(F.array(shingle_hashes(text, n)), lambda h: _kept(h, fraction))[0]


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the union of two shingle sets."""
    return _kept(F.array_union(a, b), fraction)


def _comparable(a: Column, fraction: float) -> Column:
    return F.filter(a, lambda h: h <= F.lit(_ceiling(fraction)))


def jaccard(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are equal.

    Counted over the hashes below the fraction; where neither has any, the smallest hashes
    (a min-hash of one) decide.
    """

    def count(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        union = F.size(p["a"]) + F.size(p["b"]) - both
        return F.when(union > 0, both / union).otherwise((a == b).cast("double"))

    pair = F.struct(_comparable(a, fraction).alias("a"), _comparable(b, fraction).alias("b"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.transform(F.array(pair), count)[0])


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1; 1 for an empty ``a``."""

    def count(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        return F.when(F.size(p["a"]) > 0, both / F.size(p["a"])).otherwise(
            F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.arrays_overlap(a, b).cast("double"))
        )

    pair = F.struct(_comparable(a, fraction).alias("a"), _comparable(b, fraction).alias("b"))
    return F.transform(F.array(pair), count)[0]


def fingerprint(a: Column) -> Column:
    """A sketch as text: the upper 40 bits of each hash, in base 64 (about 6.7 characters a hash)."""
    digits = F.transform(a, lambda h: F.substring(F.lpad(F.hex(h), 16, "0"), 1, 10))
    return F.base64(F.unhex(F.array_join(digits, "")))


def with_sketch(docs: DataFrame, text_column: str = "text", out: str = "sketch", n: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """``docs`` with their sketches; a NULL text is an empty one."""
    return docs.withColumn(out, sketch(F.col(text_column), n, fraction))
