"""Fuzzy line deduplication by MinHash, exact verification and distributed union-find.

A line's signature has the least hashes of its character shingles; signatures are cut into bands, and lines
that share a band's values meet in a bucket. There each line is paired with the bucket's least line and with
the one before it first; buckets whose lines are not in one component by then are walked, so that no pair of a
bucket is left out. Pairs whose exact Jaccard similarity over shingles reaches the threshold are
links; of each component, and of each set of equal lines, the first line in document order stays.

Texts go to Python as a whole and are cut into lines there: once for keys and signatures, which are written to
the shared folder, and once more for the lines that a bucket pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import bind, fresh, staged
from kinloom.llm.components import components

SHINGLE, SIMILAR = 8, 0.8
#: 9 bands of 4 hashes: two lines that are 0.8 alike share a band with a chance of 0.992, at 0.9 of 0.9999.
BANDS, HASHES = 9, 4
SEED = 42
#: Bits of the filter that keeps texts which no bucket pairs out of the join: eight for each key, between these. With
#: more keys than the largest has bits, it keeps nothing out, and nothing is lost either.
FILTER_BITS = (1 << 15, 1 << 27)
#: Characters whose shingles are hashed at once.
CHUNK = 1 << 16
#: Lines that a task remembers, so that equal ones are hashed once; it forgets all of them when they are more.
SEEN = 200_000
#: Lines whose places a task holds before it tells firsts from repeats; the longs of a packed value; those that a task deals out at once.
HELD, PACKED, DEALT = 1 << 16, 1 << 17, 1 << 21
#: Rows of a slot that packed rows are dealt to, and slots: more rows a slot before there are more slots than these,
#: up to the most rows that a slot has.
SLOT_ROWS, SLOTS = (1 << 12, 1 << 19), (256, 4096)
#: Lines and characters of a block; a bucket of more is walked by pairs of blocks.
BLOCK, BLOCK_CHARS = 2_000, 1 << 19
#: Bits of the table of lines and shingles that a block is walked with; words of it, all in all, for each two lines that
#: meet by a shingle; and words up to which all lines are compared with all at once.
DENSE, DENSER, SQUARE = 1 << 25, 6, 1 << 16
#: Shingles are counted by 64-bit hashes; a similarity this near the threshold, in shingles, is counted by the
#: shingles themselves.
MARGIN = 4
_BLANKS = re.compile("[\x00-\x09\x0b-\x20]+")
#: What stands for a blank line's digest.
BLANK = bytes(16)


def normal(text: str) -> list[str]:
    """The lines of a text as they are compared: lower case, blanks collapsed."""
    text = text.lower()
    if "  " in text or not text.replace("\n", "").isprintable():
        text = _BLANKS.sub(" ", text)
    return [x.strip(" ") for x in text.split("\n")]


def keyed(text: str) -> tuple[list[bytes], list[str]]:
    """128-bit digests of the lines, and the lines as compared; a blank line has the digest BLANK and no text."""
    import xxhash

    digest, rows = xxhash.xxh3_128_digest, normal(text)
    return [digest(x.encode(), SEED) if x else BLANK for x in rows], rows


def halves(digests: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each digest, its first 64 bits, and the other 64, as int64."""
    wide = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return wide[:, 0].copy(), wide[:, 1].copy()


def document_key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart: the id, null as the largest number, and a hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)), F.xxhash64(docs["text"])


def shingle_set(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 32, BANDS * HASHES, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, BANDS * HASHES, dtype=np.uint32) | 1
#: A multiplier for each doubling of a shingle's length, which is a power of two.
_DOUBLINGS = _RANDOM.integers(0, 1 << 63, SHINGLE.bit_length() - 1, dtype=np.uint64) | np.uint64(1)


def _windows(lines: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of lines (first, end) with 64-bit hashes of their shingles, repeats included, and where each line's
    start. Lines are not empty."""
    start = 0
    while start < len(lines):
        stop, total = start, 0
        while stop < len(lines) and (stop == start or total + len(lines[stop]) <= CHUNK):
            total += max(len(lines[stop]), SHINGLE)
            stop += 1
        # short lines are filled up to one shingle
        part = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines[start:stop]]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, h = len(codes) - SHINGLE + 1, codes
        for k, times in enumerate(_DOUBLINGS):
            first = h[: -(1 << k)] * times
            first += h[1 << k :]
            h = first
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        ends = np.cumsum(sizes)
        # shingles that reach into the next line are taken out
        keep = np.ones(len(codes), bool)
        for k in range(1, SHINGLE):
            keep[ends - k] = False
        yield start, stop, h[keep[:n]], ends - sizes - np.arange(len(part)) * (SHINGLE - 1)
        start = stop


def signatures(lines: list[str]) -> np.ndarray:
    """The bucket numbers of each line's bands, (lines, BANDS), as int64. Lines are not empty."""
    out = np.empty((BANDS * HASHES, len(lines)), np.uint32)
    for start, stop, h, firsts in _windows(lines):
        h = (h >> np.uint64(32)).astype(np.uint32)
        one = np.empty_like(h)
        for k in range(BANDS * HASHES):
            np.bitwise_xor(h, _FLIP[k], out=one)
            np.multiply(one, _TIMES[k], out=one)
            out[k, start:stop] = np.minimum.reduceat(one, firsts)
    return banded(np.ascontiguousarray(out.T))


def shingle_numbers(lines: list[str]) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each line's shingles, ascending."""
    out: list[np.ndarray] = []
    for _, _, h, firsts in _windows(lines):
        bounds = [*firsts.tolist(), len(h)]
        out += [ascending(h[a:b]) for a, b in zip(bounds, bounds[1:])]
    return out


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, which is put in order, ascending; np.unique hashes them first, which takes longer."""
    x.sort()
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def banded(least: np.ndarray) -> np.ndarray:
    """The bucket numbers of each row's bands. least: (rows, BANDS * HASHES), the least values of a row's hashes."""
    wide = least.reshape(len(least), BANDS, HASHES).astype(np.uint64)
    bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), wide.shape[:2]).copy()
    for k in range(HASHES):
        bucket = (bucket ^ wide[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        bucket ^= bucket >> np.uint64(29)
    return bucket.view(np.int64)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least values, BANDS * HASHES of them, of 32-bit hashes, of which there is one at least."""
    return np.array([((hashes ^ f) * t).min() for f, t in zip(_FLIP, _TIMES)], np.uint32)


def told_apart(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """places: rows of key, check, doc, tie, line_no. The first place of each key and check, and the places after it."""
    order = np.argsort(places[:, 0], kind="stable")
    key = places[order, 0]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    many = same | np.concatenate([same[1:], [False]])
    rows = places[order[many]]
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    # a repeated document has its places twice: those are one
    first = rows[new][np.cumsum(new) - 1]
    return np.concatenate([places[order[~many]], rows[new]]), rows[(rows != first).any(axis=1)]


def _listed(gone: np.ndarray) -> list[pa.Array]:
    """doc, tie, lines: the lines of each document among places."""
    gone = gone[np.lexsort((gone[:, 4], gone[:, 3], gone[:, 2]))]
    new = np.flatnonzero(np.concatenate([[True], (gone[1:, 2:4] != gone[:-1, 2:4]).any(axis=1)]))
    return [pa.array(gone[new, 2]), pa.array(gone[new, 3]), pa.ListArray.from_arrays(pa.array([*new.tolist(), len(gone)], pa.int32()), pa.array(gone[:, 4].astype(np.int32)))]


def packed(rows: np.ndarray) -> list[bytes]:
    step = PACKED // rows.shape[1]
    return [rows[k : k + step].tobytes() for k in range(0, len(rows), step)]


def unpacked(values: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(-1, width)


def scanned(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Rows of three kinds: doc, tie, lines for documents with lines that a task met before, at an
    earlier place; places, packed rows of key, check, doc, tie, line_no, those that are left, blank lines left out (checks
    are second hashes); and bands, packed rows of bucket, key for each line that a task meets first. n counts packed rows."""
    long = pa.int64()
    types = {"doc": long, "tie": long, "lines": pa.list_(pa.int32()), "places": pa.binary(), "bands": pa.binary(), "n": long}

    def batch(**columns: object) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], list(types))

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, gone = told_apart(np.concatenate(held))
        if len(gone):
            yield batch(**dict(zip(("doc", "tie", "lines"), _listed(gone))))
        values = packed(first)
        yield batch(places=values, n=[len(x) // 40 for x in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        bands: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                digests, sizes, new = [], [], {}
                for text in part.column(2).to_pylist():
                    own, rows = keyed(text)
                    digests += own
                    sizes.append(len(own))
                    new |= {d: line for d, line in zip(own, rows) if d not in seen}
                new.pop(BLANK, None)
                keys, checks = halves(digests)
                ends = np.cumsum(sizes)
                doc, tie = (np.repeat(part.column(c).to_numpy(), sizes) for c in (0, 1))
                places = np.stack([keys, checks, doc, tie, np.arange(len(keys)) - np.repeat(ends - sizes, sizes)], axis=1)
                held.append(places[(keys != 0) | (checks != 0)])
                if sum(map(len, held)) >= HELD:
                    yield from told(held)
                    held = []
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(new)
                if new:
                    found = signatures(list(new.values()))
                    bands.append(np.stack([found.ravel(), np.repeat(halves(new)[0], BANDS)], axis=1))
                if sum(map(len, bands)) * 2 >= PACKED:
                    values = packed(np.concatenate(bands))
                    yield batch(bands=values, n=[len(x) // 16 for x in values])
                    bands = []
        if held:
            yield from told(held)
        if bands:
            values = packed(np.concatenate(bands))
            yield batch(bands=values, n=[len(x) // 16 for x in values])

    doc, tie = document_key(docs)
    rows = docs.select(doc.alias("doc"), F.coalesce(tie, F.lit(0)).alias("tie"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc long, tie long, lines array<int>, places binary, bands binary, n long")


def dealt(values: DataFrame, width: int) -> DataFrame:
    """values: (value, n), packed rows of ``width`` longs, and their number. (slot, value): the same rows, those of one
    first long in one slot; a task's rows of a slot follow each other."""
    slots, total = SLOTS[0], values.agg(F.sum("n")).first()[0] or 0
    while (slots * SLOT_ROWS[0] < total and slots < SLOTS[1]) or slots * SLOT_ROWS[1] < total:
        slots *= 2

    def deal(held: list[bytes]) -> pa.RecordBatch:
        rows = unpacked(held, width)
        slot = ((rows[:, 0] >> 24) & (slots - 1)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        slot, rows = slot[order], rows[order]
        bounds = [*np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])).tolist(), len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(slot[bounds[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["slot", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for whole in batches:
            for value in whole.column(0):
                held.append(value.as_py())
                if sum(map(len, held)) >= DEALT * 8:
                    yield deal(held)
                    held = []
        if held:
            yield deal(held)

    return values.select("value").mapInArrow(run, "slot int, value binary").repartition("slot").sortWithinPartitions("slot")


def banded_meetings(rows: DataFrame) -> DataFrame:
    """rows: as scanned. What ``meetings`` gives for their buckets and keys. A slot's rows are in memory at once: with
    them all distinct lines of a bucket, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            rows = unpacked(group.column(1).to_pylist(), 2)
            order = np.argsort(rows[:, 0])
            b = rows[order, 0]
            same = np.concatenate([[False], b[1:] == b[:-1]])
            rows = rows[order[same | np.concatenate([same[1:], [False]])]]
            if not len(rows):
                continue
            b, k = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T
            new = np.concatenate([[True], b[1:] != b[:-1]])
            least = k[np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))]
            before = np.concatenate([k[:1], k[:-1]])
            keep = ~new & (before < k)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (b, k, least, before)], ["bucket", "key", "least", "before"])

    values = rows.filter("bands is not null").select(F.col("bands").alias("value"), "n")
    return dealt(values, 2).mapInArrow(run, "bucket long, key long, least long, before long")


def firsts(rows: DataFrame, bits: bytes) -> DataFrame:
    """rows: as scanned. Rows of two kinds: doc, tie, lines for lines that come after an equal one; and key, check, doc,
    tie, line_no, the first place of each line whose key the filter may have."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    long = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "check", "doc", "tie", "line_no", "lines"]
        table = np.frombuffer(shared.value, np.uint8)
        for group in _groups(batches, 1):
            first, gone = told_apart(unpacked(group.column(1).to_pylist(), 5))
            first = first[has_bit(table, first[:, 0].copy().view(np.uint64))]
            if len(first):
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in first.T), pa.nulls(len(first), pa.list_(pa.int32()))], names)
            if len(gone):
                doc, tie, lines = _listed(gone)
                none = pa.nulls(len(doc), long)
                yield pa.RecordBatch.from_arrays([none, none, doc, tie, none, lines], names)

    values = rows.filter("places is not null").select(F.col("places").alias("value"), "n")
    return dealt(values, 5).mapInArrow(run, "key long, check long, doc long, tie long, line_no long, lines array<int>")


def line_texts(docs: DataFrame, bits: bytes) -> DataFrame:
    """docs: (text). (key, line) for each key that the filter may have; of repeats that a task meets, one."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            table = np.frombuffer(shared.value, np.uint8)
            for at in range(0, whole.num_rows, 256):
                digests, rows = [], []
                for text in whole.column(0).slice(at, 256).to_pylist():
                    own, lines = keyed(text)
                    digests += own
                    rows += lines
                there = has_bit(table, halves(digests)[0].view(np.uint64))
                if len(seen) > SEEN:
                    seen.clear()
                new = {digests[k]: rows[k] for k in np.flatnonzero(there).tolist() if rows[k] and digests[k] not in seen}
                seen.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(halves(new)[0]), pa.array(list(new.values()), pa.string())], ["key", "line"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key long, line string")


def meetings(found: DataFrame) -> DataFrame:
    """found: (bucket, key), repeats allowed. (bucket, key, least, before) for each key but the least of a bucket:
    the bucket's least key and the key before. One shuffle by bucket serves both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of the batch before, and its bucket's least key
        bucket = key = low = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, k = (batch.column(c).to_numpy() for c in (0, 1))
            new = np.concatenate([[bucket is None or b[0] != bucket], b[1:] != b[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            least = np.where(start >= 0, k[start], 0 if low is None else low)
            before = np.concatenate([[k[0] if key is None else key], k[:-1]])
            keep = ~new & (before < k)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (b, k, least, before)], ["bucket", "key", "least", "before"])
            bucket, key, low = b[-1], k[-1], least[-1]

    rows = found.select("bucket", "key").repartition("bucket").sortWithinPartitions("bucket", "key")
    return rows.mapInArrow(run, "bucket long, key long, least long, before long")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs a < b of what meets: of each bucket's least key with every other, and of neighbours by key."""
    pair = F.explode(F.array_distinct(F.array("least", "before"))).alias("a")
    return met.select(pair, F.col("key").alias("b")).distinct()


def _filter(keys: DataFrame) -> bytes:
    """A bit for each of the distinct keys, modulo the number of bits, which is bounded however many keys there are."""
    size = FILTER_BITS[0]
    count = keys.count()
    while size < min(8 * count, FILTER_BITS[1]):
        size *= 2
    # counted from one: the bitmap functions count bit zero to a bucket of its own
    bit = F.pmod("key", F.lit(size)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = bytearray(size // 8)
    for n, bits in rows:
        out[(n - 1) * 4096 : n * 4096] = bits
    return bytes(out)


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter, as bytes, has the bits of keys (uint64)."""
    at = keys & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe(key: Column, bits: bytes, spark) -> Column:
    """Whether the filter has the key's bit."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def has(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(has_bit(np.frombuffer(shared.value, np.uint8), x.to_numpy(np.int64).view(np.uint64)))

    return has(key)


def alike(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], similarity: float, shingles: Callable[[str], set]) -> bool:
    """Whether two texts, given with their shingles' hashes, have a Jaccard similarity of ``similarity`` or more."""
    x, y = (a[1], b[1]) if len(a[1]) >= len(b[1]) else (b[1], a[1])
    if len(y) + MARGIN < similarity * len(x):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    over = both - similarity * (len(x) + len(y) - both)
    return over > 0 if abs(over) > MARGIN else alike_exactly(a[0], b[0], similarity, shingles)


def alike_exactly(a: str, b: str, similarity: float, shingles: Callable[[str], set]) -> bool:
    x, y = shingles(a), shingles(b)
    return len(x & y) >= similarity * len(x | y)


Numbers = Callable[[list[str]], list[np.ndarray]]


def similar(pairs: DataFrame, similarity: float = SIMILAR, shingles: Callable[[str], set] = shingle_set, numbers: Numbers = shingle_numbers) -> DataFrame:
    """pairs: (a, b, line_a, line_b). The (a, b) whose exact Jaccard similarity over shingles is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                texts = list(dict.fromkeys([*one, *two]))
                known = dict(zip(texts, numbers(texts)))
                keep = [alike((x, known[x]), (y, known[y]), similarity, shingles) for x, y in zip(one, two)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def _walk(keys: np.ndarray, parts: np.ndarray, lines: list[str], similarity: float, shingles: Callable[[str], set], numbers: Numbers) -> list[tuple[int, int]]:
    """Links between lines of different parts that connect all parts with a pair alike. Small parts are walked
    first, each line against those not reached yet, whose shared shingles are counted at once."""
    hashes = numbers(lines)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    n = len(hashes)
    # shingles of two lines or more, numbered, with their lines
    flat, owners = np.concatenate(hashes), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat)
    flat, owners = flat[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(starts, len(flat)))
    owners, counts = owners[np.repeat(counts > 1, counts)], counts[counts > 1]
    every, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    # what shares too few with all others together is like none of them
    left = np.bincount(owners, minlength=n) + MARGIN >= similarity * sizes
    _, part, members = np.unique(parts, return_inverse=True, return_counts=True)
    if not left.any() or (part[left] == part[left][0]).all():
        return []
    likely, wide = left.copy(), -(-len(counts) // 64)
    dense = n * wide * 64 <= DENSE and n * n * wide <= DENSER * int((counts * counts).sum())
    square = dense and n * n * wide <= SQUARE
    if dense:  # a bit for each line and shingle; no products, which would keep other cores busy
        table = np.zeros((n, wide * 64), bool)
        table[owners, every] = True
        table = np.packbits(table, axis=1).view(np.uint64)
        if square:
            table = np.bitwise_count(table[:, None] & table).sum(axis=2, dtype=np.int64)
            likely &= ((table - similarity * (sizes + sizes[:, None] - table) >= -MARGIN) & (part != part[:, None])).any(axis=1)
            if not likely.any():
                return []
    else:
        order = np.argsort(owners, kind="stable")
        sets = np.split(every[order], np.cumsum(np.bincount(owners, minlength=n))[:-1])

    def shared(at: int) -> np.ndarray:
        if square:
            return table[at]
        if dense:
            return np.bitwise_count(table & table[at]).sum(axis=1, dtype=np.int64)
        own = sets[at]
        many = counts[own]
        ends = np.cumsum(many)
        return np.bincount(owners[np.repeat(starts[own] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)], minlength=n)

    of = [[] for _ in members]
    for k, p in enumerate(part.tolist()):
        of[p].append(k)
    reached = np.zeros(len(members), bool)
    links: list[tuple[int, int]] = []
    for start in np.argsort(members, kind="stable").tolist():
        if reached[start]:
            continue
        reached[start], queue = True, list(of[start])
        left[of[start]] = False
        while queue and left.any():
            at = queue.pop()
            if not likely[at]:
                continue
            both = shared(at)
            over = both - similarity * (sizes + sizes[at] - both)
            for k in np.flatnonzero(left & (over >= -MARGIN)).tolist():
                if not reached[part[k]] and (over[k] > MARGIN or alike_exactly(lines[at], lines[k], similarity, shingles)):
                    reached[part[k]] = True
                    left[of[part[k]]] = False
                    queue += of[part[k]]
                    links.append((int(keys[at]), int(keys[k])))
    return links


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows that are equal in the first ``by`` columns, which follow each other, as tables."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        change = np.zeros(max(0, len(now) - 1), bool)
        for k in range(by):
            change |= np.diff(now.column(k).to_numpy()) != 0
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield now.slice(a, b - a)
        rest = now.slice(bounds[-1]).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def missed_links(met: DataFrame, found: DataFrame, texts: DataFrame, similarity: float = SIMILAR, shingles: Callable[[str], set] = shingle_set, numbers: Numbers = shingle_numbers) -> DataFrame:
    """met: what meets; found: (node, component) so far; texts: (key, line). Links (a, b) between components whose
    lines share a bucket, as many as connect them. Buckets of one component or of one pair have nothing left to
    find, and of buckets with the same keys one counts."""
    rows = met.select("bucket", "key").union(met.select("bucket", "least").distinct())
    chars = texts.select(F.col("key").alias("node"), F.char_length("line").alias("chars")).join(found, "node", "left").select("node", "chars", F.coalesce("component", "node").alias("part"))
    rows = rows.join(chars, rows["key"] == chars["node"]).select("bucket", "key", "part", "chars")
    same = [F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("low"), F.max("key").alias("high")]
    open_ = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), (F.min("part") < F.max("part")).alias("open"), *same).filter("open and n > 2")
    open_ = open_.groupBy("n", "x", "low", "high").agg(F.min(F.struct("bucket", "chars")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("b.chars") / BLOCK_CHARS)).cast("int")
    open_ = staged(open_.select("b.bucket", blocks.alias("blocks")), "line-open")
    rows = rows.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("blocks")).cast("int"))
    # a block meets each of the others, or itself if it is the only one
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("block")) | (F.col("blocks") == 1))
    rows = rows.select("bucket", "key", "part", "block", F.explode(others).alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "part").join(texts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            parts = group.column(4).to_numpy()
            if (parts != parts[0]).any():
                found = _walk(group.column(3).to_numpy(), parts, group.column(5).to_pylist(), similarity, shingles, numbers)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    rows = rows.select("bucket", "i", "j", "key", "part", "line")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def families(found: DataFrame, texts_of: Callable[[bytes], DataFrame], similarity: float = SIMILAR, shingles: Callable[[str], set] = shingle_set, numbers: Numbers = shingle_numbers) -> DataFrame:
    """found: (bucket, key), repeats allowed; texts_of: gives the (key, line), repeats allowed, of all keys that a filter
    may have. (node, component) for each key that has a link: keys of lines that share a bucket and are alike."""
    return met_families(meetings(found), texts_of, similarity, shingles, numbers)


def met_families(met: DataFrame, texts_of: Callable[[bytes], DataFrame], similarity: float = SIMILAR, shingles: Callable[[str], set] = shingle_set, numbers: Numbers = shingle_numbers) -> DataFrame:
    """met: what meets; otherwise as families."""
    met = staged(met, "line-buckets")
    pairs = staged(candidate_pairs(met), "line-pairs")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = staged(texts_of(_filter(keys)).join(keys, "key", "left_semi").groupBy("key").agg(F.max("line").alias("line")), "line-texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("line").alias("line_b")), "b")
    found = staged(components(similar(both, similarity, shingles, numbers)), "line-components")
    more = staged(missed_links(met, found, texts, similarity, shingles, numbers), "line-missed")
    if not more.head(1):
        return found
    # links between components are few: they are joined as components, not line by line
    to = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    over = more.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    over = staged(components(over), "line-families").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    joined = found.join(over, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return joined.union(over.select("component", "whole")).distinct()


def decisions(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """docs: (doc_id, text). doc, tie, lines: the numbers of lines that go, each in one row or more."""
    rows = staged(scanned(docs), "line-scan")
    found = staged(met_families(banded_meetings(rows), lambda bits: line_texts(docs, bits), similarity), "line-families")
    # lines without alike ones are done with where equal ones are told apart; the others' first places meet by component
    told = staged(firsts(rows, _filter(found.select(F.col("node").alias("key")))), "line-firsts")
    places = told.filter("key is not null").join(found, F.col("key") == F.col("node")).select("key", "check", F.struct("doc", "tie", "line_no").alias("place"), "component")
    # a second hash tells lines apart that share a key: those never go in the other's favour
    first = places.groupBy("key").agg(F.min(F.struct("place", "check")).alias("first"), F.first("component").alias("component"))
    best = first.groupBy("component").agg(F.min("first.place").alias("best"))
    ends = first.join(best, "component").filter(F.col("first.place") != F.col("best")).select("first.place.doc", "first.place.tie", F.array(F.col("first.place.line_no").cast("int")).alias("lines"))
    return ends.union(told.filter("key is null").select("doc", "tie", "lines")).union(rows.filter("lines is not null").select("doc", "tie", "lines"))


def _cut(docs: DataFrame, name: str, similarity: float = SIMILAR) -> DataFrame:
    """docs with a column of what is left: text, n (lines before) and kept (lines of the text); null if no line goes."""
    doc, tie = document_key(docs)
    of, at, gone = (fresh(docs, n) for n in ("doc", "tie", "gone"))
    found = decisions(docs, similarity).groupBy(F.col("doc").alias(of), F.col("tie").alias(at)).agg(F.flatten(F.collect_list("lines")).alias(gone))
    rows = docs.join(found, (doc == F.col(of)) & (tie == F.col(at)), "left")
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda k: F.get(x, k))
    made = bind(F.split("text", "\n"), lambda x: bind(left(x), lambda y: F.struct(F.array_join(y, "\n").alias("text"), F.size(x).alias("n"), F.size(y).alias("kept"))))
    return rows.withColumn(name, F.when(F.col(gone).isNotNull(), made)).select(*docs.columns, name)


def deduplicated(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """docs: (doc_id, text) and other columns, which stay. Texts lose the lines that go; n_chars, if there, is
    the new length. Every row stays, be its text empty.

    Null and empty texts stay as they are, and so do blank lines. The first of equal or alike lines is that of
    the smallest doc_id (null last), then of the smallest hash of the text, then the smallest line number.
    Repeated rows are one document and come out alike. An empty table gives an empty result.
    """
    cut = fresh(docs, "cut")
    rows = _cut(docs, cut, similarity)
    out = rows.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.col(f"{cut}.text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_lines, kept_lines and text_sha256, of its text as it comes
    out of deduplicated."""
    rows = _cut(docs.select("doc_id", "text"), "cut")
    text = F.coalesce(F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.col("cut.text")), F.lit(""))
    whole = F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    n_lines = F.when(F.col("cut").isNull(), whole).otherwise(F.col("cut.n"))
    kept = F.when(F.col("cut").isNull(), whole).when(text == "", 0).otherwise(F.col("cut.kept"))
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), kept.cast("long").alias("kept_lines"), F.sha2(text, 256).alias("text_sha256"))
