"""Token ids in raw binary shards with a minimal perfect hash index from document keys to offsets.

Shard file: records in ascending document id, each of a 16-byte header - document id (int64), occurrence
among rows with that id (uint32, its top bit marks a null id) and number of ids (uint32) - and the ids,
little-endian, of two bytes where the vocabulary allows it. The last id of each document is 0. Spark's
text writer writes the records' bytes, and its line separator is that last id, so files can be on any
storage that Spark writes to and a retried task leaves no half file. A file is cut by bytes: it is one row of
the written table, so that neither a writer nor a reader holds more than a file, or a single longer document.

Index: keys (id, occurrence) are hashed to buckets of about BUCKET keys. A bucket's row holds its perfect
hash, and, in the order of its slots, each key's fingerprint, shard, byte offset, count and the number of
ids before it in the shard. A look-up reads one bucket row, one slot and one range of one shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.llm import perfect_hash
from kinloom.llm.common import staged, work_dir

BUCKET = 4096
#: Bytes of a file's records, from which on the next file begins.
FILE_BYTES = 4 << 20
#: Entries of a generation of a worker's cache.
CACHE = 400_000
#: Files of a partition are numbered below its number.
SHARD_BITS = 32
_NULL = 1 << 31
_HEAD = "<qII"
_HEAD_BYTES = struct.calcsize(_HEAD)
#: Blanks in a row: there, words don't surely begin at each space.
_BLANKS = re.compile("[\\s\u180e\u200b\u2060\ufeff]{2}")
ENTRY = "doc_id long, occurrence long, shard long, offset long, n long, before long"


class _Pieces(dict):
    """The ids of pieces of text as bytes, in the two latest generations. A new piece gets an empty array, to be filled
    when all texts of a batch have been cut."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.new[piece] = bytearray()
        self[piece] = ids
        return ids


class Encoder:
    """Texts to the bytes of their ids by the tokenizers library.

    A byte-level tokenizer splits a text into words before it merges, and a space after a non-blank always
    begins a word. So a text is cut there and around lines' ends, a piece that is new is split by the tokenizer's
    own pattern unless it is a word, or one with a mark after it, and the library's model merges each word that is
    new. Texts with blanks in a row are split by that pattern as a whole; texts with a special token's string, and
    tokenizers of another kind, go through the library whole.
    """

    _kept: dict[tuple[str, str], Encoder] = {}
    #: The pattern of byte-level pre-tokenizers, and the bytes that stand for themselves.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
    SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}

    def __init__(self, path: str, width: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        self.split = regex.compile(self.PATTERN).findall
        hidden = (b for b in range(256) if b not in self.SHOWN)
        self.shown = {b: chr(b) for b in self.SHOWN} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.pieces = _Pieces()

    @classmethod
    def of(cls, path: str, width: str) -> Encoder:
        if (path, width) not in cls._kept:
            cls._kept[path, width] = cls(path, width)
        return cls._kept[path, width]

    def _whole(self, text: str) -> bytes:
        (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(e.ids, self.width).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.pieces.get(word)
        if not ids:
            mapped = word.encode().decode("latin-1").translate(self.shown)
            found = [t.id for t in self.model.tokenize(mapped)]
            ids = self.pieces[word] = struct.pack(f"<{len(found)}{'H' if self.width == '<u2' else 'I'}", *found)
        return ids

    def _learn(self) -> None:
        """Fills the arrays of the new pieces."""
        new, self.pieces.new = self.pieces.new, {}
        word = self._word
        for piece, ids in new.items():
            body = piece[1:] if piece.startswith(" ") else piece
            if body.isalpha():
                ids += word(piece)
            elif body[:-1].isalpha() and body[-1] in ".,;:!?":
                ids += word(piece[:-1]) + word(body[-1])
            else:
                ids += b"".join(map(word, self.split(piece)))
            self.pieces[piece] = bytes(ids)
        if len(self.pieces) > CACHE:
            self.pieces.old = dict(self.pieces)
            self.pieces.clear()

    def _cuts(self, text: str) -> list[str]:
        odd = not text.replace("\n", "").isprintable()  # other blanks than spaces, perhaps
        if odd and ("\0" in text or _BLANKS.search(text)):
            return self.split(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return self.split(text) if "\0\0" in cut or "\0 \0" in cut else cut.split("\0")

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self.pieces.__getitem__
        rows = [self._whole(t) if not self.cuttable or any(s in t for s in self.special) else list(map(get, self._cuts(t))) for t in texts]
        self._learn()
        return [r if isinstance(r, bytes) else b"".join(r) for r in rows]


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write_shards(docs: DataFrame, tokenizer: str, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Writes (doc_id, text) as shards below path; returns the ids' NumPy type. Null text counts as empty,
    null ids come first, and rows with one id follow each other by the hash of their text."""
    width = _width(tokenizer)
    end = b"\0" * int(width[2])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, last, nth = Encoder.of(tokenizer, width), object(), 0
        file, held = [], 0
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                for doc, null, ids in zip(part["doc_id"], part["null"], encoder(part["text"].tolist())):
                    nth = nth + 1 if last == (doc, null) else 0
                    last = (doc, null)
                    file += [struct.pack(_HEAD, doc, nth | (_NULL if null else 0), len(ids) // int(width[2]) + 1), ids, end]
                    held += _HEAD_BYTES + len(ids) + len(end)
                    if held >= file_bytes:
                        yield pd.DataFrame({"records": [b"".join(file[:-1])]})
                        file, held = [], 0
        if file:
            yield pd.DataFrame({"records": [b"".join(file[:-1])]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("null"))
    rows = rows.repartitionByRange(F.col("null").desc(), "doc_id").sortWithinPartitions(F.col("null").desc(), "doc_id", F.xxhash64("text"))
    files = rows.mapInPandas(encode, "records binary").select(F.col("records").cast("string").alias("value"))
    files.write.option("lineSep", end.decode()).option("maxRecordsPerFile", 1).text(path)
    return width


def shards(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """(shard, path) of the shard files and other columns of theirs. Shards ascend as their documents do: by the
    writer's partition, then by its files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda k: F.regexp_extract("path", r"part-(\d+)-[^/]*?c(\d+)\.[^/]*$", k).cast("long")
    return files.select((number(1) * (1 << SHARD_BITS) + number(2)).alias("shard"), "path", *columns)


def entries(spark: SparkSession, path: str, width: str) -> DataFrame:
    """A row for each record of the shards: doc_id (null as it was), occurrence, shard, offset of the ids in
    bytes, n ids, and the ids before it in the shard."""
    size = int(width[2])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                at, before, out = 0, 0, []
                while at < len(content):
                    doc, nth, n = struct.unpack_from(_HEAD, content, at)
                    out.append((None if nth & _NULL else doc, nth & ~_NULL, shard, at + _HEAD_BYTES, n, before))
                    at, before = at + _HEAD_BYTES + n * size, before + n
                yield pd.DataFrame(out, columns=["doc_id", "occurrence", "shard", "offset", "n", "before"]).astype({"doc_id": "Int64"})

    return shards(spark, path, "content").select("shard", "content").mapInPandas(parse, ENTRY)


def _key(df: DataFrame) -> DataFrame:
    """df with the 64-bit key of (doc_id, occurrence): a bijection of the id under the occurrence's hash would
    do; a hash of both that meets another's fails the build, loudly."""
    return df.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "occurrence"))


def build_index(found: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """found: as entries gives them. Returns the index, a row for each bucket, and the number of buckets."""
    buckets = max(1, -(-found.count() // bucket))
    columns = "bucket long, n long, sizes array<long>, bits binary, fingerprint binary, shard binary, offset binary, count binary, before binary"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError(f"two document keys of bucket {key[0]} have one hash")
        sizes, bits = perfect_hash.build(keys)
        order = np.argsort(perfect_hash.slots(keys, sizes, bits))
        column = lambda values, kind: np.ascontiguousarray(values[order]).astype(kind).tobytes()
        out = [key[0], len(keys), sizes, bits, column(perfect_hash.fingerprints(keys), "<u4")]
        out += [column(rows[c].to_numpy(), t) for c, t in (("shard", "<i8"), ("offset", "<i8"), ("n", "<u4"), ("before", "<i8"))]
        return pd.DataFrame([out], columns=["bucket", "n", "sizes", "bits", "fingerprint", "shard", "offset", "count", "before"])

    keyed = _key(found).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return keyed.select("bucket", "key", "shard", "offset", "n", "before").groupBy("bucket").applyInPandas(one, columns), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """keys: (doc_id, occurrence). Those that the index has, with shard, offset, n and before."""

    def one(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("doc_id", "Int64"), ("occurrence", "int64"), ("shard", "int64"), ("offset", "int64"), ("n", "int64"), ("before", "int64"))})
        row, hashes = rows.iloc[0], asked["key"].to_numpy().astype(np.int64).view(np.uint64)
        at = perfect_hash.slots(hashes, list(row["sizes"]), row["bits"])
        there = at >= 0
        there &= np.frombuffer(row["fingerprint"], "<u4")[np.maximum(at, 0)] == perfect_hash.fingerprints(hashes)
        at, out = at[there], asked.loc[there, ["doc_id", "occurrence"]].reset_index(drop=True)
        for name, column, kind in (("shard", "shard", "<i8"), ("offset", "offset", "<i8"), ("n", "count", "<u4"), ("before", "before", "<i8")):
            out[name] = np.frombuffer(row[column], kind)[at].astype("int64")
        return out

    asked = _key(keys.select("doc_id", "occurrence")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(one, ENTRY)


def fetch(places: DataFrame, path: str, width: str) -> DataFrame:
    """places: as look_up gives them. Adds ids_crc32, of the ids as little-endian uint32.

    Workers read the asked ranges of the shards through pyarrow's file systems, a file at a time.
    """
    from pyarrow import fs

    size = int(width[2])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, source = None, None
        for batch in batches:
            sums = []
            for name, offset, n in zip(batch["path"], batch["offset"], batch["n"]):
                if held != name:
                    if source:
                        source.close()
                    store, inner = fs.FileSystem.from_uri(name)
                    held, source = name, store.open_input_file(inner)
                ids = np.frombuffer(source.read_at(int(n) * size, int(offset)), width)
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield batch.drop(columns="path").assign(ids_crc32=np.array(sums, np.int64))

    named = places.join(shards(places.sparkSession, path), "shard").select(*places.columns, "path")
    dealt = named.repartition("shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInPandas(read, ENTRY + ", ids_crc32 long")


def bases(found: DataFrame) -> DataFrame:
    """found: as entries gives them. (shard, base): the ids of all shards before. Sums in a writer's partition, then
    over the partitions, of which there is a row each."""
    part = F.shiftright("shard", SHARD_BITS)
    up_to = lambda c, w: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(c)
    by_shard = staged(found.groupBy("shard").agg(F.sum("n").alias("ids")).withColumn("part", part), "token-shard-sums")
    inside = by_shard.withColumn("inside", up_to("ids", W.partitionBy("part").orderBy("shard")))
    outside = by_shard.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", up_to("ids", W.orderBy("part")).alias("outside"))
    return inside.join(outside, "part").select("shard", (F.col("inside") + F.col("outside")).alias("base"))


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs (doc_id, text) as shards, indexes them, and returns what keyed reads of all documents give:
    doc_id, occurrence, start (ids of all documents before), n_tokens, ids_crc32, shard, offset.

    Rows with one doc_id are told apart by their occurrence; a null doc_id is a key like others, the first;
    null or empty texts have the end id alone; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "token-shards")
    width = write_shards(docs, tokenizer, path)
    found = staged(entries(spark, path, width), "token-entries")
    index, buckets = build_index(found)
    index = staged(index, "token-index")
    keys = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))
    read = fetch(look_up(keys, index, buckets), path, width)
    out = read.join(bases(found), "shard")
    return out.select("doc_id", "occurrence", (F.col("base") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", "shard", "offset")
