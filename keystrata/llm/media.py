"""Media columns: texts as grey PNG images in a binary column, and perceptual hashes of what is read back.

The encoder and decoder are written against the PNG specification: zlib-compressed scan lines in
chunks with CRC-32 checks. Each scan line gets the filter of the least absolute sum; the filters of many images
are undone together with numpy, a diagonal at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy, whole_text, written

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Compressed data are cut into IDAT chunks of this many bytes, so that a checksum guards each.
CHUNK = 1 << 16
SLICE = 128


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Scan lines of 8-bit grey samples under one of the five filters."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return rows - paeth(left, up, corner)


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def encode_png(payload: bytes, filter_kind: int | None = None, level: int = 1) -> bytes:
    """filter_kind: the filter of all scan lines; None gives each line the one whose samples, taken as signed, have the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    if filter_kind is None:
        all_ = np.stack([filtered(rows, kind) for kind in range(5)])
        lines[:, 0] = np.minimum(all_, -all_).sum(2, dtype=np.int64).argmin(0)
        lines[:, 1:] = all_[lines[:, 0], np.arange(len(rows))]
    else:
        lines[:, 0], lines[:, 1:] = filter_kind, filtered(rows, filter_kind)
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """8-bit grey samples by row; ValueError if a signature, checksum or size is wrong."""
    return unfiltered(scan_lines(media))


def scan_lines(media: bytes) -> np.ndarray:
    """Filtered scan lines, each after the number of its filter; ValueError as in decode_png()."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while True:
        if at + 12 > len(media):
            raise ValueError("PNG ends early")
        n, kind = struct.unpack_from(">I4s", media, at)
        if at + 12 + n > len(media):
            raise ValueError("PNG ends early")
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} is wrong")
        at += n + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey images without interlacing are read")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("size differs from the header")
    return lines.reshape(height, width + 1)


def unfiltered(lines: np.ndarray) -> np.ndarray:
    return unfiltered_all([lines])[0]


def unfiltered_all(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of many images: what lies on the same diagonal of any of them depends only on the two diagonals before."""
    if len({x.shape[1] for x in images}) > 1:
        return [unfiltered(x) for x in images]
    heights = [len(x) for x in images]
    lines = np.concatenate(images)
    kinds, n, width = lines[:, 0], len(lines), lines.shape[1] - 1
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    y = np.concatenate([np.arange(h) for h in heights])
    rows = np.zeros((n + 1, width + 1), np.uint8)  # nought to the left, and a line of it above
    if kinds.any():
        order = np.argsort(y, kind="stable")
        depth, up = y[order], np.where(y[order] > 0, order - 1, n)
        ends = np.searchsorted(depth, np.arange(width + max(heights)), "right")
        flat, raw = rows.reshape(-1), lines.reshape(-1)
        at, above, kind = order * (width + 1), up * (width + 1), kinds[order]
        for s in range(width + max(heights) - 1):
            part = slice(ends[s - width] if s >= width else 0, ends[s])
            x = s - depth[part]
            here, over, k = at[part] + x, above[part] + x, kind[part]
            a, b, c = (v.astype(np.int16) for v in (flat[here], flat[over + 1], flat[over]))
            p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.choose(k, (np.int16(0), a, b, a + b >> 1, np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))))
            flat[here + 1] = raw[here + 1] + guess.astype(np.uint8)
    else:
        rows[:n, 1:] = lines[:, 1:]
    return np.split(rows[:n, 1:], np.cumsum(heights)[:-1])


_N, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_N) + 1) * np.arange(_LOW)[:, None] / (2 * _N))


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits: which low-frequency cosine coefficients of the 32 x 32 mean image are above their median."""
    h, w = pixels.shape
    cols = pixels.reshape(h, _N, w // _N).sum(2, dtype=np.float64)
    sums = np.vstack([np.zeros(_N), np.cumsum(cols, 0)])
    at = np.arange(_N + 1) * h / _N
    low = np.minimum(at.astype(int), h - 1)
    edge = sums[low] + (at - low)[:, None] * cols[low]
    small = np.diff(edge, axis=0) / (h / _N * (w // _N))
    coef = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(coef > np.median(coef[1:])).tobytes().hex()


def text_to_media(docs: DataFrame, level: int = 1, filter_kind: int | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a PNG in a binary column.

    The payload is the UTF-8 text (null: empty) filled with blanks to a positive multiple of 192.
    Repeated rows and null ids pass through; other columns are ignored; no rows give no rows. A very long text is one tall image.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = [payload_of(t) for t in batch.column(1).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p, filter_kind, level) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read each stored image back: digests of its payload and of its stored form, and its cosine hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                stored = batch.column(2).slice(at, SLICE).to_pylist()
                rows = unfiltered_all([scan_lines(m) for m in stored])
                loads = [r.tobytes() for r in rows]
                cols = [
                    pa.array([len(p) for p in loads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in loads]), pa.array([zlib.crc32(p[-16:]) for p in loads], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([cosine_hash(r) for r in rows]),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, SLICE), batch.column(1).slice(at, SLICE), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def stored_media(docs: DataFrame) -> DataFrame:
    """text_to_media() as a table in the shared folder."""
    return written(text_to_media(docs), "media", "none")
