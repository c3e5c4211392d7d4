"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit for each majority among the hashes of a document's word shingles. Distinct
fingerprints within LIMIT bits are linked, exactly: cut into LIMIT + SPARE runs of bits, two such fingerprints
agree in SPARE runs at least, so a fingerprint goes to a bucket for each choice of SPARE runs. In a bucket, a
table holds each fingerprint's Hamming distances to many reference fingerprints; two fingerprints are at least
as far apart as any of their coordinates differ, which discards most pairs, and the survivors are verified.

A bucket gives a spanning forest of its links, not all of them: a group of near copies is walked from one
fingerprint to those not reached yet, so its links number no more than its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.llm import lines
from kinloom.llm.common import fresh, staged
from kinloom.llm.components import components

SHINGLE, SEED, LIMIT, SPARE, PIVOTS = 4, 42, 4, 2, 16
#: Words of a shingle and similarity of documents that one_of_each takes for near copies besides.
NEAR_SHINGLE, NEAR = 5, 0.8
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: random, but the same always."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of size words, A-Z lower-cased; fewer words make one shingle, none make none."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    last = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)), np.uint64, len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def longer(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a word more than those whose hashes are given, in order: each is made of two
    neighbours. A sole shingle stands for itself."""
    two = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) if len(hashes) > 1 else hashes
    two = (two ^ (two >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return two ^ (two >> np.uint64(32))


def _fingerprinted(docs: DataFrame, *more: str, near: bool = False) -> DataFrame:
    """docs: (doc_id, text) and more, which are longs. (doc_id, more, fp), and if near bands: the numbers of the MinHash
    buckets of the text's shingles of NEAR_SHINGLE words, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                fps, bands = [], []
                for text in batch.column(0).to_pylist():
                    hashes = shingle_hashes(text)
                    fps.append(fingerprint(hashes))
                    if near:
                        bands.append(lines.banded(lines.least_hashes(_short(longer(hashes)))[None])[0] if len(hashes) else None)
                columns = [*batch.columns[1:], pa.array(np.array(fps, np.uint64).view(np.int64))]
                if near:
                    columns.append(pa.array(bands, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *more, "fp", *["bands"] * near])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *more)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *more, "fp")) + ", bands array<long>" * near)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text); other columns are ignored. (doc_id, fp), fp as a signed 64-bit integer. Null text
    counts as empty, and texts without words have 0."""
    return _fingerprinted(docs)


def _forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bucket, one for each fingerprint that is reached from another. fps: distinct; table: their
    distances to the pivots, a row each."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))  # not reached yet, by the first coordinate
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            first = table[left, 0]
            low, high = np.searchsorted(first, table[at, 0] - LIMIT), np.searchsorted(first, table[at, 0] + LIMIT, side="right")
            near = left[low:high]
            near = near[(np.abs(table[near] - table[at]) <= LIMIT).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= LIMIT]
            if len(near):
                links += [(int(fps[at]), int(fps[k])) for k in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return links


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct (fp). Pairs (a, b) of them within LIMIT bits that connect all such pairs."""
    cuts = np.linspace(0, 64, LIMIT + SPARE + 1).round().astype(int)
    masks = [sum(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in (cuts[k : k + 2] for k in c)) for c in combinations(range(LIMIT + SPARE), SPARE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(signed)]))
    rows = fps.select("fp", key.alias("key")).select("key.choice", "key.bits", "fp")
    references = pivots()

    def bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.zeros((0, 3), np.int64)
        for batch in _with_end(batches):
            end = batch is None
            if not end:
                rest = np.concatenate([rest, batch.to_numpy(np.int64)])
            if not len(rest):
                continue
            new = np.flatnonzero((np.diff(rest[:, 0]) != 0) | (np.diff(rest[:, 1]) != 0)) + 1
            bounds = np.concatenate([[0], new, [len(rest)]] if end else [[0], new])
            sizes = np.diff(bounds)
            many = np.flatnonzero(sizes > 1)
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds[many].tolist(), bounds[many + 1].tolist()):
                own = np.ascontiguousarray(rest[a:b, 2]).view(np.uint64)
                table = np.bitwise_count(own[:, None] ^ references[None, :]).astype(np.int16)
                found += _forest(own, table)
            if found:
                yield pd.DataFrame(np.array(found, np.uint64).view(np.int64), columns=["a", "b"])
            rest = rest[bounds[-1] :]

    dealt = rows.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    return dealt.mapInPandas(bucketed, "a long, b long")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). (doc_id, fingerprint as 16 hexadecimal digits, component_id) for each row:
    documents whose fingerprints differ in LIMIT bits or fewer are linked, and component_id is the smallest
    doc_id that links lead to.

    Empty and null texts have fingerprint zero, linked like any other; a null doc_id is never the smallest
    unless all of its component are null; repeated rows each give a row; an empty table gives an empty result.
    Texts with one fingerprint are one node, so a group of copies makes no links.
    """
    rows = staged(fingerprints(docs), "simhash")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp")))
    linked = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "component").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_shingles(text: str) -> set[bytes]:
    """Runs of NEAR_SHINGLE words, A-Z lower-cased; fewer words make one."""
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + NEAR_SHINGLE]) for k in range(max(1, len(words) - NEAR_SHINGLE + 1))}


def word_numbers(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashes of each text's runs of NEAR_SHINGLE words, ascending."""
    return [lines.ascending(longer(shingle_hashes(t, NEAR_SHINGLE - 1))) for t in texts]


def near_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs: (text); rows: (tie, fp, bands), tie the text's xxhash64. Links (a, b) of fingerprints whose texts have an
    exact Jaccard similarity of NEAR or more over shingles and share a MinHash band, as many as connect them."""
    of = rows.select("tie", "fp").distinct()
    signed = rows.filter("bands is not null").select(F.explode("bands").alias("bucket"), F.col("tie").alias("key")).distinct()
    texts = lambda bits: docs.select(F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("line")).filter(lines.maybe(F.col("key"), bits, docs.sparkSession))
    found = lines.families(signed, texts, NEAR, word_shingles, word_numbers)
    to = lambda c: of.select(F.col("tie").alias(c), F.col("fp").alias(f"{c}_fp"))
    return found.join(to("node"), "node").join(to("component"), "component").select(F.col("node_fp").alias("a"), F.col("component_fp").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each component: that with the smallest doc_id (null after all
    others), and among rows with one id that with the smallest hash of its text; of repeated rows, one. Different
    texts that share an id, or have none, are documents of their own: each counts in its text's component. Null and
    empty texts are one component; an empty table gives an empty result; other columns stay as they are.

    Linked are documents whose fingerprints differ in LIMIT bits or fewer, as in near_duplicates, and those whose
    shingles of NEAR_SHINGLE words are alike."""
    tie = F.xxhash64("text")
    rows = staged(_fingerprinted(docs.select("doc_id", "text", tie.alias("tie")), "tie", near=True), "simhash")
    found = components(links(rows.select("fp").distinct()).union(near_links(docs, rows)))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"))
    named = first.join(found, first["fp"] == found["node"], "left").select("first", F.coalesce("component", "fp").alias("component"))
    of, at, nth = (fresh(docs, n) for n in ("kept", "tie", "nth"))
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(of), F.col("first.tie").alias(at))
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (tie == F.col(at)))
    return out.withColumn(nth, F.row_number().over(W.partitionBy(of, at).orderBy(at))).filter(F.col(nth) == 1).select(*docs.columns)
