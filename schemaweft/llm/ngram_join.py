"""N-gram Jaccard join: universe partition with one-deletion neighbourhoods.

Sets r, s with Jaccard similarity t or more differ in at most H = (1 - t) / (1 + t) * (|r| + |s|)
elements. The hash universe is cut into segments, more of them for larger sets (a segmentation
for each size band). The longer set spends H + 1 units on its segments: one unit asks for a
partner with the very same segment, two for one that differs there by at most one element. If
every segment differed by at least its units, the sets would differ in more than H elements, so
partners always meet. Units go where they are cheapest: keys of many elements are rare.

Keys travel packed, in blocks by bucket; only keys that several sets share come back, as lists.
Lists are never paired out: sets are first checked against one hub of each list, the set that is
in most lists, and only lists that still span several components are looked at again, across
components. There the sets of long lists with the same hub meet in cells of bounded size, so that
a pair is met once and not once for each list it shares. All links are checked on whole shingle
sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import join_small, retained, settle, tidy
from schemaweft.llm.components import components
from schemaweft.llm.shingles import SHINGLE, mix, set_class, shingle_set

PERCENT = 75
#: Elements of a segment at the upper end of a size band; keys of a bucket, about.
SEGMENT, KEYS_PER_BUCKET = 2.3, 400_000
#: Keys of a batch that so many of its sets share are met there.
HOT = 24
#: Sets of a center's lists that make one chunk; of c times as many, the root of c chunks. A cell holds two.
CHUNK = 4096
#: Classes whose membership is tested map-side before their sets travel.
MAX_BROADCAST = 1_000_000
IS, WANTS, WANTS_LONGER, IS_SHORTENED = 1, 2, 4, 8
#: Estimated number of sets with the same c elements falls so with c.
RARITY = 0.3
SEEDS = 4


class Unallocated(ValueError):
    """The elements of a set fall into too few segments: another seed is needed."""


def differ(a: int, b: int, percent: int = PERCENT) -> int:
    """Most elements in which sets of these sizes can differ and still be similar."""
    return (100 - percent) * (a + b) // (100 + percent)


def segments(upper: int) -> int:
    """Segments of the band of sizes below ``upper``: small sets get segments of their own."""
    return 256 if upper <= 8 else 4 * upper if upper <= 64 else math.ceil(upper / SEGMENT)


def allocate(counts: np.ndarray, rare: np.ndarray, units: int) -> np.ndarray:
    """Units (0, 1, 2) by segment, ``units`` in all, at least cost.

    ``rare`` is how many elements of a segment are not known to be common: keys of common
    elements alone are met by many.
    """
    able = np.flatnonzero(counts >= 3)
    if len(counts) + len(able) < units:
        raise Unallocated(f"{units} units for {len(counts)} segments")
    first = RARITY**rare
    second = (rare[able] + 1) * RARITY ** (rare[able] - 1)
    cheap = np.argsort(np.concatenate([first, second]), kind="stable")[:units]
    given = np.zeros(len(counts), np.int64)
    given[cheap[cheap < len(counts)]] += 1
    given[able[cheap[cheap >= len(counts)] - len(counts)]] += 1
    return given


def band_keys(elements: np.ndarray, common: np.ndarray, upper: int, units: int, own: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of a set in the segmentation of a band.

    In its own band a set shows all its segments; in the one below it only asks. Segments are
    ranges of the sorted elements. A key is the sum of hashed elements, so that leaving one
    out is a subtraction.
    """
    place = ((elements >> np.uint64(32)) * np.uint64(segments(upper))) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.append(starts, len(elements)))
    rare = np.add.reduceat((~common).astype(np.float64), starts)
    given = allocate(counts, rare, units)
    salted = mix(elements + np.uint64(seed * 2 + 1))
    sums = np.add.reduceat(salted, starts)
    at = mix(place[starts] * np.uint64(0x9E3779B1) + np.uint64(upper))
    flags = np.where(given >= 1, WANTS, 0) | np.where(given == 2, WANTS_LONGER, 0) | (IS if own else 0)
    segment = np.repeat(np.arange(len(starts)), counts)
    shorter = np.where(given == 2, WANTS, 0) | np.where(counts >= 4, IS_SHORTENED if own else 0, 0)
    left = np.flatnonzero(shorter[segment])
    shown = flags > 0
    keys = np.concatenate([mix(sums + at)[shown], mix(sums[segment[left]] - salted[left] + at[segment[left]])])
    return keys, np.concatenate([flags[shown], shorter[segment[left]]]).astype(np.uint8)


def set_keys(elements: np.ndarray, common: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and flags of a set in all bands where a partner no longer than it may be."""
    n = len(elements)
    if seed:
        elements = mix(elements ^ mix(np.full(1, seed, np.uint64)))
        order = np.argsort(elements)
        elements, common = elements[order], common[order]
    upper = 1 << n.bit_length()
    found = [band_keys(elements, common, upper, differ(n, n, percent) + 1, True, seed)]
    while (upper := upper // 2) > 1 and 100 * (upper - 1) >= percent * n:
        found.append(band_keys(elements, common, upper, differ(n, upper - 1, percent) + 1, False, seed))
    return np.concatenate([k for k, _ in found]), np.concatenate([f for _, f in found])


BLOCK = "bucket int, keys binary, flags binary, classes binary, counts binary, hub bigint"
#: Elements of the sets among which common ones are told, and in how many sets those are.
HELD, COMMON = 2_500_000, 3


def _blocks(rows: Iterator[pa.RecordBatch], percent: int, seed: int, buckets: int, n: int) -> Iterator[pa.RecordBatch]:
    """Packed keys by bucket; in negative buckets the rows themselves, packed, and lists of sets
    that meet at a hot key (with their hub)."""
    retained(__name__)
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in rows:
        names, sizes, bits = [], [], []
        for text in batch.column(2):
            elements = shingle_set(text.as_py(), n)
            name = set_class(elements)
            names.append(name)
            sizes.append(len(elements))
            bits.append(parity(elements))
            if name is not None and name not in sets:
                sets[name] = elements
                held += len(elements)
        if names:
            yield _rows_packed(batch.column(0), batch.column(1), names, sizes, bits, buckets)
        if held >= HELD:
            yield from _keyed(sets, percent, seed, buckets)
            sets, held = {}, 0
    yield from _keyed(sets, percent, seed, buckets)


def _keyed(sets: dict[int, np.ndarray], percent: int, seed: int, buckets: int, flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    if not sets:
        return
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    common = np.append(values[counts >= COMMON], np.iinfo(np.uint64).max)
    del values, counts
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0
    for name, elements in sets.items():
        made[name] = set_keys(elements, common[np.searchsorted(common, elements)] == elements, percent, seed)
        held += len(made[name][0])
        if held >= flush:
            yield _packed(made, buckets)
            made, held = {}, 0
    if made:
        yield _packed(made, buckets)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "flags", "classes", "counts", "hub"])


def _rows_packed(ids: pa.Array, hashes: pa.Array, names: list, sizes: list, bits: list, buckets: int) -> pa.RecordBatch:
    """The rows of a batch as one: ids, text hashes, parities, classes, sizes; NULLs are kept in a bit each."""
    no_id = np.array(ids.is_null())
    raw = [ids.fill_null(0).to_numpy(), hashes.to_numpy(), np.array([x or 0 for x in names], np.int64)]
    state = no_id.astype(np.uint8) | (np.array([x is None for x in names], bool).astype(np.uint8) << 1)
    counts = np.array(sizes, "<u4")
    bucket = -1 - int(raw[1].view(np.uint64).sum() % np.uint64(buckets))
    return _block([(bucket, np.concatenate([*raw[:2], *bits]).tobytes(), state.tobytes(), raw[2].tobytes(), counts.tobytes(), None)])


def _packed(seen: dict, buckets: int) -> pa.RecordBatch:
    classes = np.array(list(seen), np.int64)
    keys = np.concatenate([k for k, _ in seen.values()])
    flags = np.concatenate([f for _, f in seen.values()])
    owner = np.repeat(np.arange(len(classes)), [len(k) for k, _ in seen.values()])
    rows = []
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.diff(keys[order])) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(keys))
    keep = np.ones(len(keys), bool)
    met = set()
    for a, b in zip(*(x[ends - starts >= HOT] for x in (starts, ends))):
        here = order[a:b]
        members = np.unique(classes[owner[here]])
        hub = here[classes[owner[here]].argmin()]
        keep[here] = False
        keep[hub] = True
        flags[hub] = np.bitwise_or.reduce(flags[here])
        raw = members.tobytes()
        if raw not in met:
            met.add(raw)
            rows.append((-1 - len(met) % buckets, None, None, raw, None, int(members[0])))
    keys, flags, owner = keys[keep], flags[keep], owner[keep]
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        low = keys[here].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        first = np.flatnonzero(np.append(True, np.diff(owner[here]) != 0))
        counts = np.diff(np.append(first, len(here))).astype("<u4")
        rows.append((int(bucket[here[0]]), low.tobytes(), flags[here].tobytes(), classes[owner[here[first]]].tobytes(), counts.tobytes(), None))
    return _block(rows)


ENTRY = "list bigint, class bigint, asks boolean, hub bigint, doc_id bigint, text_hash bigint, n bigint, bits array<bigint>"


def _entries(lists: list, members: np.ndarray, asks: np.ndarray, hubs: np.ndarray | None = None) -> pa.Table:
    """Rows of lists: who is in which, and whether it asks for partners no longer than it."""
    none = pa.nulls(len(members), pa.int64())
    hub = none if hubs is None else pa.array(hubs, pa.int64())
    whole = {"list": pa.array(lists, pa.int64()), "class": pa.array(members, pa.int64()), "asks": pa.array(asks, pa.bool_()), "hub": hub}
    return pa.table(whole | {k: none for k in ("doc_id", "text_hash", "n")} | {"bits": pa.nulls(len(members), pa.list_(pa.int64()))})


def _documents(table: pa.Table) -> pa.Table:
    """The rows that came along, packed, as rows without a list."""
    parts = []
    for keys, state, classes, counts in zip(*(table.column(n).to_pylist() for n in ("keys", "flags", "classes", "counts"))):
        state = np.frombuffer(state, np.uint8)
        ids, hashes, bits = np.split(np.frombuffer(keys, np.int64), [len(state), 2 * len(state)])
        parts.append((ids, state & 1, hashes, np.frombuffer(classes, np.int64), state & 2, np.frombuffer(counts, "<u4"), bits))
    ids, no_id, hashes, names, no_name, sizes, bits = (np.concatenate(x) for x in zip(*parts))
    ends = np.cumsum([parity_bits(n) // 64 for n in sizes.tolist()])
    bits = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(bits, pa.int64()))
    none = pa.nulls(len(ids), pa.int64())
    name, doc = pa.array(names, pa.int64(), mask=no_name > 0), pa.array(ids, pa.int64(), mask=no_id > 0)
    return pa.table({"list": none, "class": name, "asks": pa.nulls(len(ids), pa.bool_()), "hub": none, "doc_id": doc, "text_hash": pa.array(hashes), "n": pa.array(sizes, pa.int64()), "bits": bits})


def _list_names(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(members.view(np.uint64)), starts)).view(np.int64)


def _met(table: pa.Table) -> pa.Table:
    """Lists of sets that met at a hot key inside a batch."""
    members = [np.frombuffer(x, np.int64) for x in table.column("classes").to_pylist()]
    sizes = list(map(len, members))
    every = np.concatenate(members)
    names = _list_names(every, np.cumsum(sizes) - sizes)
    return _entries(np.repeat(names, sizes), every, np.ones(len(every), bool), np.repeat(table.column("hub").to_numpy(), sizes))


def _shared(table: pa.Table) -> pa.Table:
    """The distinct lists of sets that share a key of a bucket, or that met at a hot key; rows."""
    column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    if table.column("bucket")[0].as_py() < 0:
        of_rows = table.column("hub").is_null()
        parts = [f(t) for f, t in ((_documents, table.filter(of_rows)), (_met, table.filter(pc.invert(of_rows)))) if len(t)]
        return pa.concat_tables(parts)
    low = column("keys", np.uint8).reshape(-1, 5)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :5] = low
    keys = keys.view("<u8").ravel()
    member = np.repeat(column("classes", np.int64), column("counts", "<u4"))
    flags = column("flags", np.uint8)
    order = np.lexsort((member, keys))
    keys, member, flags = keys[order], member[order], flags[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    every = np.bitwise_or.reduceat(flags, starts)
    several = np.minimum.reduceat(member, starts) < np.maximum.reduceat(member, starts)
    asked = ((every & IS > 0) & (every & WANTS > 0)) | ((every & IS_SHORTENED > 0) & (every & WANTS_LONGER > 0))
    kept = np.repeat(several & asked, np.diff(np.append(starts, len(keys))))
    keys, member, flags = keys[kept], member[kept], flags[kept]
    if not len(keys):
        return _entries([], np.zeros(0, np.int64), np.zeros(0, bool))
    once = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (member[1:] != member[:-1])))
    asks = np.bitwise_or.reduceat(flags, once) & (WANTS | WANTS_LONGER) > 0
    keys, member = keys[once], member[once]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    names = _list_names(np.where(asks, ~member, member), starts)
    sizes = np.diff(np.append(starts, len(keys)))
    first = np.zeros(len(starts), bool)
    first[np.unique(names, return_index=True)[1]] = True
    kept = np.repeat(first, sizes)
    return _entries(np.repeat(names, sizes)[kept], member[kept], asks[kept])


def classes_and_lists(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Two settled tables, from one pass over the texts.

    doc_id, text_hash, class (NULL without words), n_shingles, bits: a row per row of ``docs``.
    list, class, asks, hub: sets that share a key they may be similar by; one that asks, and
    others no longer than it, may be partners. ``hub`` is set in lists met
    inside a batch: outside it, the hub alone stood for them.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    # About a key for each seven characters.
    buckets = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / 7 / KEYS_PER_BUCKET))
    for seed in range(SEEDS):
        blocks = rows.mapInArrow(lambda it, s=seed: tidy(_blocks(it, percent, s, buckets, n)), BLOCK)
        try:
            found = settle(blocks.groupBy("bucket").applyInArrow(_shared, ENTRY))
            break
        except PythonException as error:
            if Unallocated.__name__ not in str(error) or seed == SEEDS - 1:
                raise
    named = found.filter("list is null").select("doc_id", "text_hash", "class", F.col("n").alias("n_shingles"), "bits")
    return named, settle(found.filter("list is not null").select("list", "class", "asks", "hub").distinct())


def parity_bits(n: int) -> int:
    return max(64, 1 << max(0, n - 1).bit_length())


def parity(elements: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least one an element: whether an odd number of elements falls on each.

    Sets that differ in d elements differ in at most d bits. Folding the halves on each other
    gives the bits of half the number.
    """
    width = parity_bits(len(elements))
    odd = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bits_apart(a: str, b: str) -> Column:
    """Number of differing bits of two parities, the longer one folded once."""
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)

    def folded(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return apart(F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q)), F.col(y))

    return F.when(F.size(a) == F.size(b), apart(F.col(a), F.col(b))).when(F.size(a) == 2 * F.size(b), folded(a, b)).when(F.size(b) == 2 * F.size(a), folded(b, a)).otherwise(0)


def element_sets(docs: DataFrame, named: DataFrame, wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """class, elements (array<bigint>) of the sets named in ``wanted`` (class), settled.

    One text of each class is read again, found by its hash.
    """
    texts = named.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("text_hash").alias("h")).select("h").distinct()
    texts = settle(texts)
    few = texts.count() <= MAX_BROADCAST
    hashes = np.sort(np.array([r[0] for r in texts.collect()], np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if known is not None and batch.num_rows:
                h = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                batch = batch.filter(pa.array(known[at] == h if len(known) else np.zeros(len(h), bool)))
            out: dict[int, np.ndarray] = {}
            for text in batch.column(1):
                elements = shingle_set(text.as_py(), n)
                name = set_class(elements)
                if name is not None:
                    out[name] = elements
            whole = pa.array([e.view(np.int64) for e in out.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), whole], names=["class", "elements"])

    rows = docs.select(F.xxhash64("text").alias("h"), "text")
    rows = rows if few else rows.join(texts, "h", "left_semi")
    sets = rows.mapInArrow(lambda it: tidy(made(it)), "class bigint, elements array<bigint>")
    return settle(sets.groupBy("class").agg(F.first("elements").alias("elements")))


def verified(docs: DataFrame, named: DataFrame, pairs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of classes that are similar, checked on their whole sets, settled."""
    ends = settle(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct())
    sets = element_sets(docs, named, ends, n)
    one = sets.select(F.col("class").alias("v"), F.col("elements").alias("b"))
    other = sets.select(F.col("class").alias("u"), F.col("elements").alias("a"))
    both = F.size(F.array_intersect("a", "b"))
    met = pairs.join(one, "v").join(other, "u").select("u", "v", both.alias("both"), (F.size("a") + F.size("b") - both).alias("either"))
    return settle(met.filter(100 * F.col("both") >= percent * F.col("either")).select("u", "v"))


def _of_classes(named: DataFrame) -> DataFrame:
    """class, n, bits, settled."""
    known = named.filter(F.col("class").isNotNull())
    return settle(known.groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits")))


def _may_be(percent: int) -> Column:
    """Whether sizes (n_u, n_v) and parities (bits_u, bits_v) allow similarity."""
    fits = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    most = F.floor((100 - percent) * (F.col("n_u") + F.col("n_v")) / (100 + percent))
    return fits & (_bits_apart("bits_u", "bits_v") <= most)


def _fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be similar."""
    of = lambda end: sizes.select(*(F.col(c).alias(a) for c, a in (("class", end), ("n", f"n_{end}"), ("bits", f"bits_{end}"))))
    return pairs.join(of("u"), "u").join(of("v"), "v").filter(_may_be(percent)).select("u", "v")


def _asked(every: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """u, v of ``every`` (list, class, asks, component) that may be similar: an asker, and an
    answer no longer than it of another component. What tells them apart is in the join's own
    condition, so that only pairs worth a check come out of it."""
    known = every.join(sizes, "class")
    end = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("class", "component", "n", "bits")]
    ask, answer = known.filter("asks").select(F.col("list").alias("l"), *end("u")), known.select("list", *end("v"))
    apart = (F.col("component_u") != F.col("component_v")) & (F.col("n_v") <= F.col("n_u"))
    met = ask.join(answer, (F.col("l") == F.col("list")) & apart & _may_be(percent))
    return settle(met.select(*_pair("class_u", "class_v")).distinct())


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _apart(u: np.ndarray, v: np.ndarray, bits: list[np.ndarray], words: int = 2_000_000) -> np.ndarray:
    """Number of differing bits of the parities of u[i] and v[i]: ``_bits_apart`` for cells."""
    width = np.array([len(b) for b in bits])
    out = np.zeros(len(u), np.int64)
    # Row of a set among those of its width, and these rows as one matrix.
    row, stacked = np.zeros(len(bits), np.int64), {}
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        row[same] = np.arange(len(same))
        stacked[w] = np.stack([bits[i] for i in same]).view(np.uint64)
    for wide, narrow in {(a, b) for a in stacked for b in stacked if a in (b, 2 * b)}:
        x, y = np.where(width[u] >= width[v], u, v), np.where(width[u] >= width[v], v, u)
        here = np.flatnonzero((width[x] == wide) & (width[y] == narrow))
        of_wide = stacked[wide] if wide == narrow else stacked[wide][:, :narrow] ^ stacked[wide][:, narrow:]
        step = max(1, words // int(narrow))
        for part in (here[i : i + step] for i in range(0, len(here), step)):
            out[part] = np.bitwise_count(of_wide[row[x[part]]] ^ stacked[narrow][row[y[part]]]).sum(axis=1)
    return out


def _asked_before(u: np.ndarray, v: np.ndarray, owner: np.ndarray, lists: np.ndarray, asks: np.ndarray, step: int = 2_000_000) -> np.ndarray:
    """Whether u[i] asks in one of the given entries (lists numbered) of a list that v[i] is in."""
    width = int(lists.max(initial=0)) + 1
    known = np.append(np.sort(owner * width + lists), -1)
    by_owner = np.argsort(owner[asks], kind="stable")
    asked, of = lists[asks][by_owner], owner[asks][by_owner]
    first, last = (np.searchsorted(of, u, side) for side in ("left", "right"))
    out = np.zeros(len(u), bool)
    cuts = np.searchsorted(np.cumsum(last - first), np.arange(step, (last - first).sum(), step))
    for part in np.split(np.arange(len(u)), np.unique(cuts)):
        many = last[part] - first[part]
        pair = np.repeat(part, many)
        at = np.arange(len(pair)) + np.repeat(first[part] - np.cumsum(many) + many, many)
        wanted = v[pair] * width + asked[at]
        out[pair[known[np.searchsorted(known[:-1], wanted)] == wanted]] = True
    return out


def _cell(table: pa.Table, percent: int, area: int = 4_000_000) -> pa.Table:
    """u, v: pairs of a cell that share a list, are of different components and may be similar.

    Between two chunks only pairs across them count, and only those that share no list of a
    lower center, so that every pair is met in one cell. Askers come in blocks of at most
    ``area`` pairs.
    """
    column = lambda name: table.column(name).to_numpy()
    names, component, n, chunk = column("class"), column("component"), column("n"), column("chunk")
    lists = table.column("lists").combine_chunks()
    owner = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
    lists = lists.flatten().to_numpy()
    order = np.argsort(lists, kind="stable")
    lists, owner = lists[order], owner[order]
    asks, here = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)[order] for c in ("asked", "here"))
    place = np.cumsum(np.append(True, lists[1:] != lists[:-1])) - 1
    before = (owner[~here], place[~here], asks[~here])
    owner, place, asks = owner[here], place[here], asks[here]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    ends = np.append(starts[1:], len(place))
    place = np.repeat(np.arange(len(starts)), ends - starts)
    bits = [np.array(b, np.int64) for b in table.column("bits").to_pylist()]
    out = [(np.zeros(0, np.int64),) * 2]
    step = max(1, area // len(names))
    for low in range(0, len(names), step):
        high = min(low + step, len(names))
        askers = np.flatnonzero(asks & (owner >= low) & (owner < high) & ((ends - starts)[place] > 1))
        share = np.zeros((high - low, len(names)), bool)
        for part in np.split(askers, np.flatnonzero(np.diff(place[askers])) + 1) if len(askers) else []:
            a, b = starts[place[part[0]]], ends[place[part[0]]]
            share[np.ix_(owner[part] - low, owner[a:b])] = True
        mine = slice(low, high)
        share &= (component[mine, None] != component) & (n[mine, None] >= n) & (100 * n >= percent * n[mine, None])
        if chunk.min() < chunk.max():
            share &= chunk[mine, None] != chunk
        u, v = np.nonzero(share)
        u += low
        fits = _apart(u, v, bits) <= (100 - percent) * (n[u] + n[v]) // (100 + percent)
        u, v = u[fits], v[fits]
        new = ~_asked_before(u, v, *before)
        out.append((names[u[new]], names[v[new]]))
    u, v = (np.concatenate(x) for x in zip(*out))
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def _asked_in_cells(every: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """As ``_asked``, of ``every`` (center, list, class, asks, component), for long lists.

    Sets of lists with one center are dealt into chunks by hash, and every two chunks meet in
    a cell; a set brings its lists along once, however many they are. Chunks grow with the root
    of their number of sets, so that rows do with its power of 1.5.
    """
    held = every.groupBy("class", "component").agg(*(F.collect_list(c).alias(a) for c, a in (("list", "lists"), ("asks", "asked"), ("center", "centers"))))
    held = settle(held.join(sizes, "class"))
    seats = held.select("class", F.explode(F.array_distinct("centers")).alias("center"))
    many = seats.groupBy("center").agg(F.ceil(F.sqrt(F.count("*") / CHUNK)).cast("int").alias("k"))
    dealt = seats.join(many, "center").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    placed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("center", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "class")
    # Lists of this center and, to tell what was met there, of lower ones.
    known = F.filter(F.arrays_zip("centers", "lists", "asked"), lambda x: x.centers <= F.col("center"))
    cells = placed.join(held, "class").withColumn("known", known)
    cells = cells.select(
        "center", "a", "b", "chunk", "class", "component", "n", "bits", "known.lists", "known.asked",
        F.transform("known.centers", lambda c: c == F.col("center")).alias("here"),
    )
    return cells.groupBy("center", "a", "b").applyInArrow(lambda t: _cell(t, percent), "u bigint, v bigint")


def _centers(lists: DataFrame) -> DataFrame:
    """list, center: its set that is in most lists, by the least class of several such.

    An original is in the lists of all its copies, a copy only where it was left alone.
    """
    often = lists.groupBy("class").agg(F.count("*").alias("often"))
    first = F.struct("often", -F.col("class"))
    return settle(lists.join(often, "class").groupBy("list").agg(F.max_by("class", first).alias("center")))


def link_components(docs: DataFrame, named: DataFrame, lists: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """class, component (the least class reachable): the classes with a link, settled.

    First every set of a list is checked against the list's center. Then, in lists that
    span several components, sets of different components are; no other pair can add a link.
    """
    sizes = _of_classes(named)
    centers = _centers(lists)
    stars = lists.join(centers, "list").filter("class <> center").select(*_pair("class", "center")).distinct()
    stars = settle(_fitting(stars, sizes, percent))
    links = verified(docs, named, stars, percent, n)
    first = settle(components(links))
    at = F.coalesce("component", "class").alias("component")
    placed = lists.join(first.withColumnRenamed("node", "class"), "class", "left").select("list", "class", "asks", "hub", at)
    placed = settle(placed)
    # A hub stands for all sets that it met in a batch, in whatever lists it is.
    stood = placed.filter("hub is not null").select(F.col("hub").alias("seat"), F.col("class").alias("member"), F.col("component").alias("c")).distinct()
    stood = settle(stood)
    reach = stood.groupBy("seat").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.count("*").alias("c_n"))
    seats = placed.select("list", F.col("class").alias("seat"), "asks", "component").distinct().join(reach, "seat", "left")
    low, high = F.least(F.min("component"), F.min("c_low")), F.greatest(F.max("component"), F.max("c_high"))
    met = F.sum(F.coalesce("c_n", F.lit(0)) + 1)
    spans = seats.groupBy("list").agg(low.alias("low"), high.alias("high"), (met >= HOT).alias("long"))
    spans = settle(spans.filter("low < high").join(centers, "list").select("list", "center", "long"))
    split = seats.join(spans, "list")
    guests = split.filter("c_low is not null").select("list", "center", "long", "seat").join(stood, "seat")
    guests = guests.select("list", "center", "long", F.col("member").alias("class"), F.lit(True).alias("asks"), F.col("c").alias("component"))
    across = split.select("list", "center", "long", F.col("seat").alias("class"), "asks", "component").unionByName(guests)
    across = settle(across.groupBy("list", "center", "long", "class", "component").agg(F.max("asks").alias("asks")))
    crossing = _asked(across.filter("not long").drop("center", "long"), sizes, percent)
    crossing = crossing.unionByName(_asked_in_cells(across.filter("long"), sizes, percent)).distinct()
    crossing = settle(settle(crossing).join(stars, ["u", "v"], "left_anti"))
    more = verified(docs, named, crossing, percent, n)
    return settle(components(links.unionByName(more)).withColumnRenamed("node", "class"))


def similar_documents(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, component, component_id for every row of ``docs`` (doc_id, text).

    Rows of equal shingle sets are of one class, a signed 64-bit hash of the set; component_id
    is the least doc_id reachable by links. Rows without words (NULL, empty, white space) have
    an empty set and stand alone under their own id, NULL or not. A component of NULL ids only
    has the id NULL. Repeated rows come out repeated; other columns are ignored.
    """
    named, lists = classes_and_lists(docs, percent, n)
    linked = link_components(docs, named, lists, percent, n)
    ids = named.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    joined = settle(ids.join(linked, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component")))
    of_component = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = joined.join(of_component, "component").select(F.col("class").alias("c"), "component", "component_id")
    return named.join(by_class, F.col("class") == F.col("c"), "left").select(
        "doc_id", "text_hash", "n_shingles", "class", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def similar_pairs(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """u, v: all links between classes, whatever their number, for those who want the join itself.

    Pairs of a list are paired out here, so the result of a group of mutually similar sets
    grows with its square; ``similar_documents`` needs no such thing.
    """
    named, lists = classes_and_lists(docs, percent, n)
    sizes = _of_classes(named)
    stood = lists.filter("hub is not null").select("hub", F.col("class").alias("member"))
    seats = lists.select("list", F.col("class").alias("seat"))
    guests = seats.join(stood, F.col("seat") == F.col("hub")).select("list", F.col("member").alias("class"), F.lit(True).alias("asks"))
    every = lists.select("list", "class", "asks").unionByName(guests).distinct().withColumn("component", F.col("class"))
    return verified(docs, named, _asked(settle(every), sizes, percent), percent, n)


def one_of_each(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """``docs`` without all but one document of every component: the one of the least doc_id.

    Without ids, and of several texts under one id, the least text hash stays; of repeated
    rows one does. Documents without words all stay. Texts are not shuffled while the list of
    what goes is small.
    """
    found = settle(similar_documents(docs, percent, n).filter("class is not null"))
    ids = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stays = found.groupBy("component").agg(F.min(ids).alias("first"))
    counted = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    marked = counted.join(stays, "component").select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        "copies",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("first"),
    )
    goes = settle(marked.filter("not first").select("_id", "_hash"))
    twice = settle(marked.filter("first and copies > 1").select("_id", "_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = join_small(docs, goes, same, "left_anti")
    once = join_small(kept, twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return join_small(kept, twice, same, "left_anti").unionByName(once)
