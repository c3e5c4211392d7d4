"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

The encoding of a word is the one sequence of pieces in which each neighbouring pair, merged anew from its
characters, comes out as that very pair. An Aho-Corasick pass finds all pieces in the word; the search takes
the longest at each place, steps to shorter ones while the neighbours do not fit, and marks a place from which
nothing fits in a bitfield so that it is never tried again.

No piece of the model goes on after a word has begun a new one with the blank mark, so words are encoded on
their own and kept; this is checked when the model is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries of a generation of a worker's cache of words, and of its cache of compared neighbours.
WORDS, PAIRS = 250_000, 500_000
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder:
    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for k in range(lib.get_piece_size()):
            piece = lib.id_to_piece(k)
            if lib.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
            elif not (lib.is_control(k) or lib.is_unknown(k) or lib.is_unused(k)):
                self.score[piece], self.id[piece] = lib.get_score(k), k
        if any(MARK in p.lstrip(MARK) for p in self.id) or any("\n" in p or "\0" in p for p in self.id) or any(p.startswith(2 * MARK) and p.strip(MARK) for p in self.id):
            raise ValueError("a piece of this model goes beyond a word")
        probe = "a  B\u212b \ufb01\t\x01"
        if lib.decode(lib.encode(probe)) != probe or not all(self.byte) or not lib.id_to_piece(lib.encode("a")[0]).startswith(MARK):
            raise ValueError("this model normalises texts or lacks byte pieces")
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: list[dict[str, bytes]] = [{}, {}]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def merged(self, text: str) -> list[str]:
        """text, merged from its characters: always the pair with the best score, the leftmost among equals."""
        parts, score = list(text), self.score.get
        joined = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, s in enumerate(joined):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score(parts[at - 1] + parts[at])
            if at + 1 < len(parts):
                joined[at] = score(parts[at] + parts[at + 1])

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b, merged anew together, stay as they are."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = a + b not in self.score and self.merged(a + b) == [a, b]
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of a word; characters that no piece holds stand alone."""
        starts: list[list[int]] = [[] for _ in word]
        for end, size in self.automaton.iter(word):
            starts[end - size + 1].append(size)  # ends ascend, and so do the sizes of a start
        for sizes, char in zip(starts, word):
            if not sizes or sizes[0] != 1:
                sizes.insert(0, 1)
        out: list[str] = []
        tried: list[int] = []  # for each piece of out, which of its start's sizes it has
        failed, at, n = 0, 0, len(word)
        choice = len(starts[0]) - 1 if n else -1
        while at < n:
            sizes = starts[at]
            while choice >= 0:
                size = sizes[choice]
                piece = word[at : at + size]
                if not failed >> (at + size) & 1 and (not out or self.fits(out[-1], piece)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(piece)
                tried.append(choice)
                at += size
                choice = len(starts[at]) - 1 if at < n else -1
            else:
                failed |= 1 << at
                if not out:
                    raise ValueError(f"no pieces for {word!r}")
                at -= len(out.pop())
                choice = tried.pop() - 1
        return out

    def _new(self, word: str) -> bytes:
        young, old = self.words
        if (ids := old.get(word)) is None:
            out: list[int] = []
            for piece in self.split(word):
                known = self.id.get(piece)
                out += [known] if known is not None else [self.byte[b] for b in piece.encode()]
            ids = np.array(out, "<i4").tobytes()
        if len(young) >= WORDS:
            self.words[:] = [{}, young]
            young = self.words[0]
        young[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        if not text:
            return b""
        if "\0" in text or "  " in text or MARK in text or text[0] == " ":
            words = [w for line in re.split("(\n)", MARK + text.replace(" ", MARK)) for w in _RUNS.findall(line)]
        else:
            words = (MARK + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).split("\0")
        get = self.words[0].get
        return b"".join([get(w) or (self._new(w) if w else b"") for w in words])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """docs: (doc_id, text); other columns are ignored. Returns doc_id, ids array<int> and decoded, what the
    library's decode makes of the ids.

    Null text counts as empty and has no ids; a null doc_id stays null; repeated rows each give a row; an empty
    table gives an empty result. Each row is worked on alone, so there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                ids = [np.frombuffer(encoder.encode(t), "<i4") for t in part.column(1).to_pylist()]
                decoded = encoder.library.decode([x.tolist() for x in ids], num_threads=1) if len(ids) else []
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """rows: as encoded gives them. doc_id, n_tokens and digests of the ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
