"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of bytes.

Suffixes are of type L or S as they are larger or smaller than their right neighbour;
leftmost-S (LMS) substrings are sorted by induction, named, and their order is completed by
doubling the names; from the sorted LMS suffixes all others are induced, L left to right
and S right to left. On bytes, induction goes bucket by bucket in numpy: what a bucket's
entries induce is placed at once, as often as the bucket itself grows. Names have too many
buckets for that: suffixes of one name are sorted by the rank of what follows 1, 2, 4, ... names on.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S; ``s`` ends in a sentinel below all else."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _place(sa: np.ndarray, chars: np.ndarray, entries: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Append entries to the open edges of their buckets, in order."""
    order = np.argsort(chars, kind="stable")
    chars, entries = chars[order], entries[order]
    counts = np.bincount(chars, minlength=len(edge))
    first = np.cumsum(counts) - counts
    rank = np.arange(len(chars)) - first[chars]
    if down:
        sa[edge[chars] - 1 - rank] = entries
        edge -= counts
    else:
        sa[edge[chars] + rank] = entries
        edge += counts


def _induce_bytes(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes in the order that the order of ``lms`` induces."""
    sa = np.full(len(s), -1, np.int64)
    ends = np.cumsum(sizes)
    heads, tails = ends - sizes, ends.copy()
    _place(sa, s[lms][::-1], lms[::-1], tails, True)
    grown, used = heads.copy(), np.flatnonzero(sizes)

    def preceding(batch: np.ndarray, of_s: bool) -> np.ndarray:
        before = batch[batch > 0] - 1
        return before[stype[before] == of_s]

    for c in used:
        done = heads[c]
        while done < grown[c]:
            batch, done = sa[done : grown[c]], grown[c]
            found = preceding(batch, False)
            _place(sa, s[found], found, grown, False)
        found = preceding(sa[tails[c] : ends[c]], False)
        _place(sa, s[found], found, grown, False)
    shrunk = ends.copy()
    for c in used[::-1]:
        done = ends[c]
        while done > shrunk[c]:
            batch, done = sa[shrunk[c] : done][::-1], shrunk[c]
            found = preceding(batch, True)
            _place(sa, s[found], found, shrunk, True)
        found = preceding(sa[heads[c] : grown[c]][::-1], True)
        _place(sa, s[found], found, shrunk, True)
    sa[0] = len(s) - 1
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of names in order; only groups that are still equal are sorted on."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    group, open_ = names[order], np.arange(n)
    # The rank of a suffix is the place of the first of its group; past the end it is below all.
    rank = np.full(n + 1, -1, np.int64)
    ahead = 1
    while True:
        new = np.append(True, group[1:] != group[:-1])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        if not len(open_):
            return order
        at = order[open_]
        group = rank[at] * (n + 1) + rank[np.minimum(at + ahead, n)] + 1
        by = np.argsort(group, kind="stable")
        order[open_], group = at[by], group[by]
        ahead *= 2


def _names(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings that begin at ``order`` (sorted): equal ones share a name."""
    a, b = order[:-1], order[1:]
    new = length[a] != length[b]
    open_ = np.flatnonzero(~new)
    offset = 0
    while len(open_):
        open_ = open_[length[a[open_]] > offset]
        differ = s[a[open_] + offset] != s[b[open_] + offset]
        new[open_[differ]] = True
        open_ = open_[~differ]
        offset += 1
    return np.append(0, np.cumsum(new))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of a byte array (below 255, as UTF-8 is), in order; a shorter one comes first."""
    s = np.append(data.astype(np.int64) + 1, 0)
    stype = _types(s)
    sizes = np.bincount(s, minlength=257)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    sa = _induce_bytes(s, stype, lms, sizes)
    if len(lms) < 2:
        return sa[1:]
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    length = np.zeros(len(s), np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    named = _names(s, order, length)
    if named[-1] + 1 < len(lms):
        name = np.zeros(len(s), np.int64)
        name[order] = named
        order = lms[_doubled(name[lms])]
    return _induce_bytes(s, stype, order, sizes)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``sa`` with the one before it.

    Permuted: in text order a value is one less than its left neighbour's, unless the letters
    before the two suffixes differ. Only there are letters compared, eight at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(16, np.uint64)])
    eight = np.zeros(n + 8, np.uint64)
    for k in range(8):
        eight |= padded[k : k + n + 8] << np.uint64(8 * k)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = (place == 0) | (before <= 0)
    fresh[1:] |= data[place[1:] - 1] != data[before[1:] - 1]
    starts = np.flatnonzero(fresh)
    a = starts[before[starts] >= 0]
    value = np.zeros(n, np.int64)
    open_, length = a, 0
    while len(open_):
        x, y = eight[np.minimum(open_ + length, n)], eight[np.minimum(before[open_] + length, n)]
        other = x ^ y
        ended = other != 0
        low = other[ended]
        same = (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        value[open_[ended]] = length + same
        open_ = open_[~ended]
        length += 8
    owner = starts[np.cumsum(fresh) - 1]
    permuted = np.maximum(value[owner] - (place - owner), 0)
    return permuted[sa]
