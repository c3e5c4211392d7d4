"""Media columns: motion-JPEG in AVI files, held in a binary column.

A frame is a lossless JPEG (process 14: 8-bit samples, left-neighbour prediction, Huffman-coded differences)
of 64 columns; each row of samples is a restart interval, so all rows of all frames in a batch are coded and
decoded side by side with NumPy. Samples are indexes into the palette in the file's stream format, which lists
the file's values by how often they occur, so that differences are small. The reader goes by the file's RIFF index, decodes each intra frame, and cuts
shots where the histogram difference of neighbouring frames rises above what the frames before it showed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import staged

COLUMNS, ROWS, FPS = 64, 32, 25
#: Code lengths of the difference categories 0 to 8 (fixed values of this encoder; files carry their table).
LENGTHS = (4, 4, 2, 2, 2, 4, 5, 6, 7)
BINS, WINDOW, FACTOR, LEAST = 16, 8, 1.5, 0.1
#: Samples that are coded side by side at most, but for a single longer text.
SAMPLES = 1 << 20
CLIP = "array<struct<start_ms:long,end_ms:long,frames:int,difference:double,level:double>>"
_BITS = 15


def _canonical(lengths: tuple[int, ...]) -> tuple[bytes, bytes, list[int]]:
    """A JPEG table's counts and symbols, and each symbol's code."""
    symbols = sorted(range(len(lengths)), key=lambda s: (lengths[s], s))
    codes, code, last = [0] * len(lengths), 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        codes[s], last = code, lengths[s]
        code += 1
    return bytes(sum(n == k for n in lengths) for k in range(1, 17)), bytes(symbols), codes


_COUNTS, _SYMBOLS, _CODES = _canonical(LENGTHS)


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits and how many."""
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value[d + 255], size[d + 255] = _CODES[s] << s | (d if d > 0 else d + (1 << s) - 1), LENGTHS[s] + s
    return value, size


def _decode_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 15 bits: difference * 16 + the bits that it takes."""
    out, code, at = np.zeros(1 << _BITS, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            s = symbols[at]
            if n + s > _BITS:
                raise ValueError("a code of this table is too long")
            for extra in range(1 << s):
                d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
                first = (code << s | extra) << (_BITS - n - s)
                out[first : first + (1 << (_BITS - n - s))] = d * 16 + n + s
            code, at = code + 1, at + 1
        code <<= 1
    return out


_VALUE, _SIZE = _encode_table()


def _scans(samples: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """samples: (rows, 64); ends: for each frame the row after its last. The frames' entropy-coded data, one
    after another, with restart markers and stuffing, and where each frame's ends."""
    d = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)).astype(np.int64) + 255
    size, value = _SIZE[d], _VALUE[d]
    after = np.cumsum(size, axis=1)
    length = (after[:, -1] + 7) >> 3
    base = np.cumsum(length) - length
    at = after - size
    byte = (base[:, None] + (at >> 3)).ravel()
    value = (value << (24 - size - (at & 7))).ravel()
    total = int(length.sum())
    out = sum(np.bincount(byte + k, weights=value >> (16 - 8 * k) & 255, minlength=total + 2)[: total + 2] for k in range(3))
    out = out[:total].astype(np.uint8)
    out[base + length - 1] |= ((1 << (length * 8 - after[:, -1])) - 1).astype(np.uint8)
    # a zero after each 0xFF, and a restart marker after each row but a frame's last
    row = np.repeat(np.arange(len(length)), length)
    stuffed = np.cumsum(out == 255) - (out == 255)
    last = np.zeros(len(length), bool)
    last[ends - 1] = True
    markers = np.cumsum(~last) - ~last
    place = np.arange(total) + stuffed + 2 * markers[row]
    full = np.zeros(total + int((out == 255).sum()) + 2 * int((~last).sum()), np.uint8)
    full[place] = out
    row_end = place[base + length - 1] + 1 + (out[base + length - 1] == 255)
    frame_of = np.searchsorted(ends, np.arange(len(length)), side="right")
    first = np.concatenate([[0], ends[:-1]])[frame_of]
    inner = ~last
    full[row_end[inner]] = 255
    full[row_end[inner] + 1] = 0xD0 + (np.arange(len(length)) - first)[inner] % 8
    return full.tobytes(), row_end[ends - 1]


def _jpeg(rows: int, scan: bytes) -> bytes:
    table = struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(_SYMBOLS), 0) + _COUNTS + _SYMBOLS
    frame = struct.pack(">BBHBHHBBBB", 0xFF, 0xC3, 11, 8, rows, COLUMNS, 1, 1, 0x11, 0)
    restart = struct.pack(">BBHH", 0xFF, 0xDD, 4, COLUMNS)
    start = struct.pack(">BBHBBBBBB", 0xFF, 0xDA, 8, 1, 1, 0, 1, 0, 0)
    return b"".join((b"\xff\xd8", table, frame, restart, start, scan, b"\xff\xd9"))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _avi(frames: list[bytes], palette: bytes) -> bytes:
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, COLUMNS, ROWS, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, COLUMNS, ROWS)
    image = struct.pack("<IiiHH4sIiiII", 40, COLUMNS, ROWS, 1, 8, b"MJPG", COLUMNS * ROWS, 0, 0, len(palette), 0)
    image += b"".join(bytes((v, v, v, 0)) for v in palette)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        body.append(chunk)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """payloads, each a positive multiple of 64 bytes, as AVI files."""
    if not payloads:
        return []
    rows = [len(p) // COLUMNS for p in payloads]
    values = np.frombuffer(b"".join(payloads), np.uint8)
    file = np.repeat(np.arange(len(rows)), np.array(rows) * COLUMNS)
    counts = np.bincount(file * 256 + values, minlength=256 * len(rows)).reshape(-1, 256)
    order = np.argsort(-counts, axis=1, kind="stable").astype(np.uint8)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order.astype(np.int64), np.arange(256, dtype=np.uint8)[None, :], axis=1)
    palettes = [o[:n].tobytes() for o, n in zip(order, (counts > 0).sum(axis=1))]
    heights = [[min(ROWS, n - k) for k in range(0, n, ROWS)] for n in rows]
    flat = [h for hs in heights for h in hs]
    scans, ends = _scans(rank[file, values].reshape(-1, COLUMNS), np.cumsum(flat))
    starts = [0, *ends[:-1].tolist()]
    frames = [_jpeg(h, scans[a:b]) for h, a, b in zip(flat, starts, ends.tolist())]
    out, at = [], 0
    for hs, palette in zip(heights, palettes):
        out.append(_avi(frames[at : at + len(hs)], palette))
        at += len(hs)
    return out


def _riff_frames(media: bytes) -> tuple[list[tuple[int, int]], bytes]:
    """The places of the video frames in an AVI file, by its index, and its palette."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, palette = 12, None, None, bytes(range(256))
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] in (b"hdrl", b"strl"):
            n = 4  # goes into the list
        elif name == b"strf":
            used = struct.unpack_from("<I", media, at + 8 + 32)[0]
            palette = media[at + 48 : at + 48 + 4 * used : 4] if used else palette
        elif name == b"idx1":
            index = struct.iter_unpack("<4sIII", media[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    return [(movi + place + 8, n) for name, _, place, n in index if name[2:] == b"dc"], palette


def _parse_jpeg(media: bytes, at: int, n: int) -> tuple[int, tuple[bytes, bytes], int, int]:
    """Rows, Huffman table, and where the entropy-coded data starts and ends."""
    end, rows, table = at + n - 2, 0, (b"", b"")
    at += 2
    while True:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        if marker == 0xC4:
            table = media[at + 5 : at + 21], media[at + 21 : at + 2 + size]
        elif marker == 0xC3:
            rows, columns = struct.unpack_from(">HH", media, at + 5)
            if columns != COLUMNS:
                raise ValueError("not 64 columns")
        elif marker == 0xDA:
            return rows, table, at + 2 + size, end
        at += 2 + size


def decode(files: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """Of each AVI file the samples of all frames, and the frames' rows."""
    heights, parts, tables, palettes = [], [], set(), []
    for media in files:
        heights.append([])
        places, palette = _riff_frames(media)
        palettes.append(palette)
        for at, n in places:
            rows, table, start, end = _parse_jpeg(media, at, n)
            heights[-1].append(rows)
            tables.add(table)
            parts.append(media[start:end])
            parts.append(b"\xff\xd0")  # ends the frame's last row, as a restart marker does the others
    if not parts:
        return [(b"", h) for h in heights]
    if len(tables) > 1:
        raise ValueError("more than one Huffman table")
    lut = _decode_table(*tables.pop())
    data = np.frombuffer(b"".join(parts), np.uint8)
    ff = np.flatnonzero(data == 255)
    after = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after >= 0xD0]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    begins = np.concatenate([[0], place[marks[:-1]]]).astype(np.int64)
    clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
    words = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    bit, value = begins * 8, np.full(len(begins), 128, np.int32)
    out = np.empty((len(begins), COLUMNS), np.uint8)
    for j in range(COLUMNS):
        code = lut[words[bit >> 3] >> (32 - _BITS - (bit & 7)).astype(np.uint32) & ((1 << _BITS) - 1)]
        value += code >> 4
        bit += code & 15
        out[:, j] = value
    flat, result, at = out.tobytes(), [], 0
    for h, palette in zip(heights, palettes):
        n = sum(h) * COLUMNS
        result.append((flat[at : at + n].translate(palette.ljust(256, b"\0")), h))
        at += n
    return result


def shots(samples: bytes, heights: list[int]) -> list[tuple[int, int, int, float, float]]:
    """Clips as (start_ms, end_ms, frames, difference at its start, mean level). A frame starts a clip if half
    the distance between its histogram and the one before is over LEAST and over FACTOR times the mean of the
    WINDOW differences before it in the clip."""
    values = np.frombuffer(samples, np.uint8)
    sizes = np.array(heights) * COLUMNS
    frame = np.repeat(np.arange(len(heights)), sizes)
    h = np.bincount(frame * BINS + (values >> 4), minlength=len(heights) * BINS).reshape(-1, BINS) / sizes[:, None]
    level = np.bincount(frame, weights=values, minlength=len(heights)) / sizes
    differences = [0.0, *(np.abs(np.diff(h, axis=0)).sum(axis=1) / 2).tolist()]
    starts, recent = [0], []
    for k in range(1, len(heights)):
        d = differences[k]
        if d > max(LEAST, FACTOR * sum(recent) / len(recent) if recent else LEAST):
            starts.append(k)
            recent = []
        else:
            recent = [*recent, d][-WINDOW:]
    ms = lambda k: k * 1000 // FPS
    return [(ms(a), ms(b), b - a, round(differences[a], 6), round(float(level[a:b].mean()), 4)) for a, b in zip(starts, [*starts[1:], len(heights)])]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of about SAMPLES samples."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > SAMPLES:
            yield start, k
            start, total = k, 0
        total += n
    if sizes:
        yield start, len(sizes)


def store(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text); other columns are ignored. doc_id, n_bytes and media, the AVI file of the text's
    UTF-8 bytes and zero bytes up to a positive multiple of 64. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _groups([len(x) for x in lengths]):
                texts = lengths[a:b]
                files = encode([t + b"\0" * (-len(t) % COLUMNS if t else COLUMNS) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def analysed(media: DataFrame) -> DataFrame:
    """media: (doc_id, n_bytes, media) as store gives them. What the stored files hold: payload digests and clips."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIP}"
    clip = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32()), ("difference", pa.float64()), ("level", pa.float64())]))
    names = [f.name for f in clip.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            for a, b in _groups([len(x) for x in files]):
                found = decode(files[a:b])
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(p) for p, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p, _ in found]), pa.array([zlib.crc32(p[-64:]) for p, _ in found], pa.int64()),
                    pa.array([len(f) for f in files[a:b]], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files[a:b]]),
                    pa.array([[dict(zip(names, c)) for c in shots(p, h)] for p, h in found], clip),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clips(rows: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, start_ms, end_ms, frames, difference, level."""
    return rows.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def document_media(docs: DataFrame) -> DataFrame:
    """Stores each text as an AVI file in the shared folder, reads the files back, and returns digests and the
    feature string: its clips as START-END:LEVEL, joined by blanks.

    Each row is worked on alone: repeated rows each give a row, a null doc_id stays null, an empty table gives
    an empty result.
    """
    rows = analysed(staged(store(docs), "media"))
    said = F.transform("clips", lambda c: F.format_string("%d-%d:%.4f", c["start_ms"], c["end_ms"], c["level"]))
    return rows.withColumn("feature", F.array_join(said, " ")).drop("clips")
