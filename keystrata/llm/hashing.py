"""64-bit hashes of words and of word windows, with numpy, and a finder of hashes that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B, _C, _D = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: The first n of 8 bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one at a time.
LONG = 256
#: Bytes of short texts that are hashed together.
TOGETHER = 1 << 17


def word_hashes(text: str, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A hash for each word (run without the bytes 20 and 09-0D)."""
    return next(hashes_of_texts([text], lower, (seed,)))[0]


def hashes_of_texts(texts: list[str], lower: bool = False, seeds: tuple[int, ...] = (0,)) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text its words' hashes, once for each seed. Different seeds give independent hashes.

    8 bytes of a word at a time go through a multiplication and a turn, for all words of many texts side by side.
    """
    raws = [t.encode() for t in texts]
    at = 0
    while at < len(raws):
        end, used = at, 0
        while end < len(raws) and (end == at or used + len(raws[end]) <= TOGETHER):
            used += len(raws[end])
            end += 1
        part, at = raws[at:end], end
        raw = b"\n".join(part)
        if lower:
            raw = raw.translate(LOWER)
        start, size, hashes = hashed_words(raw, seeds)
        edge = np.searchsorted(start, np.cumsum([len(r) + 1 for r in part])).tolist()
        for i, j in zip([0, *edge], edge):
            yield tuple(h[i:j] for h in hashes)


def hashed_words(raw: bytes, seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, sizes and hashes of the words."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.take(_WORD, np.frombuffer(raw, np.uint8), out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    hashes = [np.uint64(seed * 0xD1342543DE82EF95 % 2**64) + size.astype(np.uint64) * _D for seed in seeds]
    if len(start):
        k = _stirred(eight[start] & _FIRST[np.minimum(size, 8)])
        hashes = [_turned(h, k) for h in hashes]
    some = np.flatnonzero(size > 8)
    for done in range(8, LONG, 8):
        if not len(some):
            break
        k = _stirred(eight[start[some] + done] & _FIRST[np.minimum(size[some] - done, 8)])
        for h in hashes:
            h[some] = _turned(h[some], k)
        some = some[size[some] > done + 8]
    for i in some.tolist():
        for h, seed in zip(hashes, seeds):
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]], seed=seed)
    return start, size, [mix(h, h) for h in hashes]


def _stirred(k: np.ndarray) -> np.ndarray:
    k = k * _B
    return (k << np.uint64(31) | k >> np.uint64(33)) * _A


def _turned(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = h ^ k
    return (h << np.uint64(27) | h >> np.uint64(37)) * _C + _D


def span_names(hashes: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span of items, from two independent hashes of them: runs of powers of two are joined as the bits of the span's size say."""
    out = []
    for h in hashes:
        size, power, run, at = end - start, h, 1, start.copy()
        name = np.full(len(start), _D)
        while len(size) and run <= size.max():
            has = np.flatnonzero(size & run)
            name[has] = mix(name[has], power[at[has]])
            at[has] += run
            if 2 * run <= size.max():
                power = mix(power[: len(power) - run], power[run:])
            run *= 2
        out.append(mix(name, size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ (b * _B)
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k items: windows of powers of two are joined as the bits of k say."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, at, size, power = None, 0, 1, h
    while size <= k:
        if k & size:
            part = power[at : at + n]
            out, at = (part if out is None else mix(out, part)), at + size
        if 2 * size <= k:
            power = mix(power[: len(power) - size], power[size:])
        size *= 2
    return mix(out, np.full(n, k, np.uint64))


#: A chunk of documents is settled together: this many hashes, or as many documents as 16 bits can number.
CHUNK_HASHES, CHUNK_DOCS, DONE = 1_000_000, 60_000, 0xFFFF
#: Bits that are sent below those of the bucket: one byte, of which sorted hashes have long runs, and four.
REST = 40


def repeated_hashes(docs: DataFrame, hashes_of, buckets: int, values: bool = False) -> DataFrame:
    """For documents' sets of hashes: how many of a set occur in another set too (an upper bound).

    docs: doc_id BIGINT and text. hashes_of() makes, in a worker, a function from texts to pairs
    (sorted distinct uint64 hashes, 16-byte signature). Returns doc_id, n, sig, n_repeated. A
    chunk of documents settles hashes that repeat in it and sends each of the others once, as REST bits
    below those of its bucket; a bucket tells the chunks which of theirs others have too. A hash
    that is everywhere is sent once a chunk, so no bucket grows with a hot hash. Two hashes that
    agree in all bits sent count as repeated, so n_repeated may be too high, never too low.

    With values, hashes_of()'s second item is instead a mask of hashes that repeat in the document
    itself, and the result is doc_id, bits and repeated: the leading REST + bits bits of each repeated hash.
    """
    bits = max(1, (buckets - 1).bit_length())
    low = np.uint64(64 - REST - bits)

    def spread(batches):
        from pyspark import TaskContext

        make, part, seq = hashes_of(), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def settle():
            chunk = part << 24 | seq
            ids, sets, sigs = zip(*held)
            n = np.array([len(s) for s in sets], np.uint32)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.ones(len(flat), bool)
            first[1:] = flat[1:] != flat[:-1]
            alone = first.copy()
            alone[:-1] &= first[1:]
            if values:
                alone &= ~np.concatenate(sigs)[order]
            own = np.bincount(owner[~alone], minlength=len(sets)).astype("<u4")
            known = np.array([i is not None for i in ids])
            head = np.array([i or 0 for i in ids], "<i8").tobytes() + n.astype("<u4").tobytes() + own.tobytes() + (bytes(16 * len(n)) if values else b"".join(sigs)) + known.astype(np.uint8).tobytes()
            if values:
                head = np.array([len(n)], "<u8").tobytes() + head + pack(owner[~alone], flat[~alone] >> low)
            rows = [(chunk, -1 - chunk, head)]
            flat, owner = flat[first], np.where(alone, owner, DONE)[first].astype(np.uint16)
            bucket = flat >> np.uint64(64 - bits)
            rest = (flat << np.uint64(bits)) >> np.uint64(64 - REST)
            edges = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
            for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if j > i:
                    r = rest[i:j]
                    rows.append((chunk, b, (r >> np.uint64(32)).astype(np.uint8).tobytes() + r.astype("<u4").tobytes() + owner[i:j].astype("<u2").tobytes()))
            c, b, p = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.binary())], names=["chunk", "bucket", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, (s, sig) in zip(batch.column(0).slice(at, 256).to_pylist(), make(batch.column(1).slice(at, 256).to_pylist())):
                    held.append((i, s, sig))
                    size += len(s)
                if size >= CHUNK_HASHES or len(held) >= CHUNK_DOCS - 256:
                    yield settle()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield settle()

    def compare(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["chunk", "payload"]).append_column("head", pa.array([True] * len(table)))
        found, owners, chunks, names = [], [], [], []
        for k, (chunk, payload) in enumerate(zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist())):
            n = len(payload) // 7
            found.append(np.frombuffer(payload, np.uint8, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(payload, "<u4", n, n))
            owners.append(np.frombuffer(payload, "<u2", n, 5 * n))
            chunks.append(np.full(n, k, np.uint32))
            names.append(chunk)
        v, o, c = np.concatenate(found), np.concatenate(owners), np.concatenate(chunks)
        order = np.argsort(v, kind="stable")
        v, o, c = v[order], o[order], c[order]
        same = v[1:] == v[:-1]
        twice = np.zeros(len(v), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = twice & (o != DONE)
        o, c, v = o[hit], c[hit], v[hit]
        order = np.argsort(c, kind="stable")
        o, c, v = o[order], c[order], v[order]
        edges = np.searchsorted(c, np.arange(len(names) + 1))
        out = []
        top = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(REST)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if values:
                out.append(pack(o[i:j], v[i:j] | top))
                continue
            docs_, times = np.unique(o[i:j], return_counts=True)
            out.append(docs_.astype("<u2").tobytes() + times.astype("<u4").tobytes())
        return pa.table({"chunk": pa.array(names, pa.int64()), "payload": pa.array(out, pa.binary()), "head": pa.array([False] * len(names))})

    def pack(owner: np.ndarray, hashes: np.ndarray) -> bytes:
        return owner.astype("<u2").tobytes() + hashes.astype("<u8").tobytes()

    def settle_values(table: pa.Table) -> pa.Table:
        heads, payloads = table.column("head").to_pylist(), table.column("payload").to_pylist()
        head = payloads[heads.index(True)]
        n = int(np.frombuffer(head, "<u8", 1)[0])
        ids, known = np.frombuffer(head, "<i8", n, 8), np.frombuffer(head, np.uint8, n, 8 + 32 * n).astype(bool)
        parts = [head[8 + 33 * n :], *(p for is_head, p in zip(heads, payloads) if not is_head)]
        owner = np.concatenate([np.frombuffer(p, "<u2", len(p) // 10) for p in parts])
        value = np.concatenate([np.frombuffer(p, "<u8", len(p) // 10, len(p) // 10 * 2) for p in parts])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order].astype(np.int64)
        edges = np.searchsorted(owner, np.arange(n + 1))
        found = [value[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        some = [k for k, x in enumerate(found) if len(x)]
        return pa.table({"doc_id": pa.array(ids[some], mask=~known[some]), "bits": pa.array([bits] * len(some), pa.int32()), "repeated": pa.array([found[k] for k in some], pa.list_(pa.int64()))})

    def settle_chunk(table: pa.Table) -> pa.Table:
        heads, payloads = table.column("head").to_pylist(), table.column("payload").to_pylist()
        head = payloads[heads.index(True)]
        n = len(head) // 33
        ids, sizes, own = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<u4", n, 8 * n), np.frombuffer(head, "<u4", n, 12 * n).astype(np.int64)
        sigs, known = head[16 * n : 32 * n], np.frombuffer(head, np.uint8, n, 32 * n).astype(bool)
        for is_head, payload in zip(heads, payloads):
            if not is_head:
                m = len(payload) // 6
                own[np.frombuffer(payload, "<u2", m)] += np.frombuffer(payload, "<u4", m, 2 * m)
        return pa.table({"doc_id": pa.array(ids, mask=~known), "n": pa.array(sizes.astype(np.int64)), "sig": pa.array([sigs[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), "n_repeated": pa.array(own)})

    sent = docs.select("doc_id", "text").mapInArrow(tidy(spread), "chunk bigint, bucket bigint, payload binary")
    told = sent.groupBy("bucket").applyInArrow(compare, "chunk bigint, payload binary, head boolean")
    if values:
        return told.groupBy("chunk").applyInArrow(settle_values, "doc_id bigint, bits int, repeated array<bigint>")
    return told.groupBy("chunk").applyInArrow(settle_chunk, "doc_id bigint, n bigint, sig binary, n_repeated bigint")


def bucket_count(docs: DataFrame) -> int:
    """About four buckets for each input partition, so that a bucket has a fraction of what a partition has, at any size (2^24 buckets are as many as REST leaves bits for)."""
    return min(1 << 24, max(16, 4 * docs.rdd.getNumPartitions()))


def as_long(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
