"""PNG columns: exact round trips, damaged files, features."""

import hashlib
import zlib

import numpy as np
import pytest

from keystrata.llm import media


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("rows", [1, 2, 41])
def test_filters_round_trip(kind, rows):
    payload = np.random.default_rng(rows).integers(0, 256, rows * media.WIDTH, dtype=np.uint8).tobytes()
    assert media.decode_png(media.encode_png(payload, kind)).tobytes() == payload


def test_mixed_filters():
    rows = np.random.default_rng(1).integers(0, 256, (10, media.WIDTH), dtype=np.uint8)
    lines = np.empty((10, media.WIDTH + 1), np.uint8)
    for y in range(10):
        lines[y, 0], lines[y, 1:] = y % 5, media.filtered(rows, y % 5)[y]
    assert (media.unfiltered(lines) == rows).all()


def test_damage_is_found():
    good = media.encode_png(b"x" * 192 * 50)
    for at in (0, 20, len(good) // 2, len(good) - 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(good[:-13])


def test_many_chunks():
    payload = np.random.default_rng(2).integers(0, 256, 192 * 2000, dtype=np.uint8).tobytes()
    stored = media.encode_png(payload)
    assert stored.count(b"IDAT") > 3 and media.decode_png(stored).tobytes() == payload


def plain_png(media_bytes):
    """A decoder of its own, byte by byte as the PNG specification says: width, rows of samples, filters met."""
    at, data, width, height = 8, b"", 0, 0
    assert media_bytes[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    while at < len(media_bytes):
        n = int.from_bytes(media_bytes[at : at + 4], "big")
        kind, body = media_bytes[at + 4 : at + 8], media_bytes[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(media_bytes[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    raw, above, rows, met = zlib.decompress(data), [0] * width, [], set()
    for y in range(height):
        kind, line = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        met.add(kind)
        row = []
        for x, v in enumerate(line):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        above = row
        rows.append(row)
    return width, rows, met


def test_another_decoder_reads_the_same():
    rng = np.random.default_rng(5)
    words = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400))
    ramp = bytes((x * y // 7) % 256 for y in range(40) for x in range(media.WIDTH))
    met = set()
    for payload in (media.payload_of(words)[0], ramp, rng.integers(0, 256, 192 * 9, dtype=np.uint8).tobytes(), media.payload_of("")[0]):
        stored = media.encode_png(payload)
        width, rows, kinds = plain_png(stored)
        met |= kinds
        assert width == media.WIDTH and bytes(v for row in rows for v in row) == payload == media.decode_png(stored).tobytes()
    assert len(met) >= 4


def test_hash_against_plain_sums():
    """The mean image of 32 x 32 and its 8 x 8 lowest cosine sums, term by term."""
    rng = np.random.default_rng(9)
    for height in (1, 7, 32, 50):
        pixels = rng.integers(0, 256, (height, media.WIDTH), dtype=np.uint8)
        small = np.zeros((32, 32))
        for i in range(32):
            lo, hi = i * height / 32, (i + 1) * height / 32
            for y in range(height):
                share = max(0.0, min(hi, y + 1) - max(lo, y))
                for j in range(32):
                    small[i, j] += share * pixels[y, 6 * j : 6 * j + 6].mean() / (hi - lo)
        wave = lambda k, x: np.cos(np.pi * (2 * x + 1) * k / 64)
        coef = [round(sum(small[y, x] * wave(v, y) * wave(u, x) for y in range(32) for x in range(32)), 6) for v in range(8) for u in range(8)]
        middle = np.median(coef[1:])
        bits = "".join("1" if c > middle else "0" for c in coef)
        assert media.cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_hash_keeps_low_frequencies():
    rng = np.random.default_rng(3)

    def picture():
        """All low frequencies, and nothing else."""
        wave = np.cos(np.pi * (2 * np.arange(192) + 1) * np.arange(8)[:, None] / 384)
        raw = wave.T @ rng.normal(size=(8, 8)) @ wave
        return np.interp(raw, (raw.min(), raw.max()), (20, 235)).astype(np.uint8)

    smooth, other = picture(), picture()
    noisy = np.clip(smooth.astype(int) + rng.integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    h = media.cosine_hash(smooth)
    assert bits(h, media.cosine_hash(noisy)) <= 10 < bits(h, media.cosine_hash(other))


def test_stored_lines_are_filtered(messy):
    rows = media.text_to_media(messy).collect()
    lines = [media.scan_lines(r["media"]) for r in rows]
    assert len(set(np.concatenate([x[:, 0] for x in lines]).tolist())) >= 3
    for got, x, r in zip(media.unfiltered_all(lines), lines, rows):
        assert (got == media.unfiltered(x)).all() and got.tobytes() == media.decode_png(r["media"]).tobytes()
        least = [np.abs(media.filtered(got, kind).view(np.int8).astype(int)).sum(1) for kind in range(5)]
        assert (np.min(least, 0) == np.abs(x[:, 1:].view(np.int8).astype(int)).sum(1)).all()


def test_rows(messy, nothing):
    got = media.media_features(media.stored_media(messy)).collect()
    expected = []
    for r in messy.collect():
        payload, n = media.payload_of(r["text"])
        stored = media.encode_png(payload)
        assert len(payload) % 192 == 0 < len(payload) and payload[:n] == (r["text"] or "").encode() and not payload[n:].strip(b" ")
        expected.append((r["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(expected, key=str)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert media.media_features(media.stored_media(nothing)).count() == 0
