"""AVI motion-JPEG media columns.

Frames are lossless JPEG (process 14, left neighbour prediction) of one
component with 8-bit samples. The Huffman table gives difference class c a code
of 9 - c bits, so every sample takes nine bits with its magnitude bits: a legal
table whose streams can be packed and unpacked as arrays. The container is RIFF
AVI with one MJPG stream and an idx1 index, by which frames are found.

Shots: histograms of neighbouring frames are compared; a cut is a difference
above mean plus ``SPREAD`` deviations of those around it.

Frames of other writers are decoded, too, where they are baseline or lossless JPEG
of one or more components; a row that can't be read has no features and no clips.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

from . import jpeg

UNIT, WIDTH, ROWS, FPS = 192, 192, 16, 25
BINS, AROUND, SPREAD, LEAST = 16, 8, 1.5, 0.08
#: Text that holds the payload's length, which the last frame may exceed.
LENGTH = b"payload bytes "


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit words by difference (from -255) and differences by word."""
    d = np.arange(-255, 256)
    c = np.ceil(np.log2(np.abs(d) + 1)).astype(int)
    prefix = (1 << (9 - c)) - 2  # class 8: 0, class 7: 10, class 6: 110, ...
    word = prefix << c | np.where(d >= 0, d, d + (1 << c) - 1)
    back = np.zeros(512, np.int16)
    back[word] = d
    return word.astype(np.uint16), back


_WORD, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int, width: int) -> bytes:
    table = b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    frame = struct.pack(">BHHB", 8, rows, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + _segment(0xC4, table) + _segment(0xC3, frame) + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")


def _pack(words: np.ndarray) -> np.ndarray:
    """Nine-bit words, a multiple of eight, as bytes."""
    w = words.reshape(-1, 8)
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (w[:, i - 1] << (8 - i) | w[:, i] >> (i + 1)) & 0xFF
    out[:, 8] = w[:, 7] & 0xFF
    return out.reshape(-1)


def _unpack(data: np.ndarray) -> np.ndarray:
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        out[:, i] = (b[:, i] << (i + 1) | b[:, i + 1] >> (7 - i)) & 0x1FF
    return out.reshape(-1)


def encode(payload: bytes, width: int = WIDTH, fps: int = FPS) -> bytes:
    """AVI file of a payload whose length is a positive multiple of 192.

    All frames have as many rows; the last is filled with spaces, and a comment
    tells the payload's length. The file is an eighth longer than the payload, so
    a payload near 2 GB passes what a cell of a table holds.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload of {len(payload)} bytes")
    rows = ROWS
    x = np.frombuffer(payload.ljust(-(-len(payload) // (rows * width)) * rows * width), np.uint8).reshape(-1, rows, width).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    coded = _pack(_WORD[d.reshape(-1) + 255]).tobytes()
    size, head, chunks, index, at = rows * width * 9 // 8, _head(rows, width), [], [], 4
    for k in range(len(x)):
        frame = head + coded[k * size : (k + 1) * size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        chunks.append(struct.pack("<4sI", b"00dc", len(frame)) + frame + b"\0" * (len(frame) % 2))
        at += len(chunks[-1])
    main = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(x), 0, 1, 0, width, rows, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(x), 0, 0xFFFFFFFF, 0, 0, 0, width, rows)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, rows, 1, 8, b"MJPG", rows * width, 0, 0, 0, 0)

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + strl)
    movi = chunk(b"LIST", b"movi" + b"".join(chunks))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", LENGTH + b"%d\0" % len(payload)))
    return chunk(b"RIFF", b"AVI " + hdrl + info + movi + chunk(b"idx1", b"".join(index)))


class Movie(NamedTuple):
    period: int  # microseconds a frame
    frames: list[bytes]
    length: int | None  # of the payload, if the file tells it


def parse(media: bytes) -> Movie:
    """A RIFF AVI file by its index; only chunks of the first video stream are frames."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, period, length, stream, seen = 12, None, None, 1_000_000 // FPS, None, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl":
            period = struct.unpack_from("<I", media, at + 20)[0] or period
            body = media[at + 8 : at + 8 + size]
            kinds = [body[k + 8 : k + 12] for k in range(len(body)) if body.startswith(b"strh", k)]
            stream = kinds.index(b"vids") if b"vids" in kinds else 0
        elif name == b"LIST" and kind == b"INFO" and (found := re.search(LENGTH + rb"(\d+)", media[at : at + 8 + size])):
            length = int(found[1])
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", media, k) for k in range(at + 8, min(at + 8 + size, len(media)) - 15, 16)]
        at += 8 + size + size % 2
        seen += 1
    if movi is None or index is None:
        raise ValueError("no index")
    chosen = [(a, n) for name, _, a, n in index if name in (b"%02ddc" % stream, b"%02ddb" % stream)]
    # places count from the list's name, or in some files from the start
    base = movi if not chosen or media[movi + chosen[0][0] : movi + chosen[0][0] + 4] in (b"%02ddc" % stream, b"%02ddb" % stream) else 0
    return Movie(period, [media[base + a + 8 : base + a + 8 + n] for a, n in chosen], length)


def _coded(data: bytes) -> tuple[int, int, bytes] | None:
    """Rows, width and unstuffed data of a frame as ``encode`` writes it; None for any other."""
    if len(data) < len(_OWN) or data[:_AT] != _OWN[:_AT] or data[_AT + 4 : len(_OWN)] != _OWN[_AT + 4 :]:
        return None
    rows, width = struct.unpack_from(">HH", data, _AT)
    return rows, width, data[len(_OWN) : -2].replace(b"\xff\x00", b"\xff")


_OWN = _head(0, 0)
_AT = _OWN.index(b"\xff\xc3") + 5


def decode(frames: list[bytes]) -> np.ndarray:
    """Samples of equally sized frames: (frame, row, column) of unsigned bytes, the first component of each."""
    parts = [_coded(f) for f in frames]
    if any(p is None for p in parts):
        return np.stack([jpeg.first_component(f) for f in frames])
    rows, width = parts[0][:2]
    d = _BACK[_unpack(np.frombuffer(b"".join(p[2] for p in parts), np.uint8))].reshape(-1, rows, width)
    first = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16) + 128
    x = np.cumsum(d[:, :, 1:], axis=2, dtype=np.int16)
    return np.concatenate([first[:, :, None], x + first[:, :, None]], axis=2).astype(np.uint8)


def payload_of(movie: Movie, samples: np.ndarray) -> bytes:
    return samples.tobytes()[: movie.length]


def shots(samples: np.ndarray) -> list[int]:
    """First frames of the shots, beginning with 0."""
    n, pixels = len(samples), samples[0].size
    levels = (samples.reshape(n, -1) >> 4) + BINS * np.arange(n)[:, None]
    counts = np.bincount(levels.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    far = np.abs(np.diff(counts, axis=0)).sum(1) / (2 * pixels)
    if not len(far):
        return [0]
    sums = np.concatenate([[[0.0, 0.0]], np.cumsum(np.stack([far, far**2], 1), axis=0)])
    lo, hi = np.maximum(np.arange(len(far)) - AROUND, 0), np.minimum(np.arange(len(far)) + AROUND + 1, len(far))
    mean, square = ((sums[hi] - sums[lo]) / (hi - lo)[:, None]).T
    cut = far > np.maximum(LEAST, mean + SPREAD * np.sqrt(np.maximum(0, square - mean**2)))
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text, padded with spaces, as an AVI file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or b"" for x in part.column(1).to_pylist()]
                media = [encode(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kept = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return map_batches(kept, write, f"{id_col} long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: What reading a damaged or foreign file may raise.
UNREADABLE = (ValueError, IndexError, KeyError, struct.error, OverflowError, ZeroDivisionError)


def read_media(media: bytes | None) -> tuple:
    """What the stored bytes hold; nulls but for their length and sum where they can't be read."""
    if media is None:
        return (None,) * 6
    stored = len(media), hashlib.sha256(media).hexdigest()
    try:
        movie = parse(media)
        samples = decode(movie.frames)
        payload, cuts = payload_of(movie, samples), shots(samples)
    except UNREADABLE:
        return None, None, None, *stored, None
    feature = f"{samples.shape[2]}x{samples.shape[1]} frames={len(samples)} us={movie.period} mean={np.frombuffer(payload, np.uint8).mean():.3f} shots={','.join(map(str, cuts))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: one row per media row; see ``read_media`` for those that can't be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            found = list(zip(*map(read_media, batch.column(2).to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], [id_col, "n_bytes", *names])

    return map_batches(media.select(id_col, "n_bytes", "media"), read, f"{id_col} long, n_bytes long, {FEATURES}")


def clips(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shot: id, clip, first and past-last frame, start and end in microseconds. Media that can't be read have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    movie = parse(data or b"")
                    cuts = [*shots(decode(movie.frames)), len(movie.frames)]
                except UNREADABLE:
                    continue
                rows += [(key, k, a, b, a * movie.period, b * movie.period) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [id_col, "clip", "first_frame", "end_frame", "start_us", "end_us"])

    return map_batches(media.select(F.col(id_col).cast("long"), "media"), read, f"{id_col} long, clip long, first_frame long, end_frame long, start_us long, end_us long")


def op4(docs: DataFrame) -> DataFrame:
    """Round trip of whole texts through the media column.

    Null texts count as empty; very long ones are read whole; repeated rows
    repeat; null ids are carried along; other columns are not read; an empty
    table gives an empty result.
    """
    return features(media_column(docs))
