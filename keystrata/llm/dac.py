"""Token files of directly addressable codes.

An id is split into 8-bit chunks. Level 0 has the low chunk of every id; a bitmap beside it tells
which ids go on, and level 1 has the next chunk of just those, in order, and so forth. A rank
directory beside each bitmap has the number of ones before every block of 512 bits, so the place of
any id's next chunk is one directory entry plus the ones of part of a block: random access without
decoding anything else.

File: magic, counts, document ids and offsets, then by level its chunks, bitmap and directory.
All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import names_in, qualified, remove, shared_path, tidy, whole_text, written
from .stretches import portions

MAGIC = b"DACT0001"
BLOCK = 512
#: Documents that are encoded together, at most.
SLICE = 4096


def pack_tokens(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """ids: uint32 of all documents, one after another; lengths: how many each has."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(((left & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        if not more.any():
            break
        left = left[more] >> 8
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), doc_ids.astype("<i8").tobytes(), offsets.tobytes()]
    for level in levels:
        for part in level:
            parts += [struct.pack("<Q", len(part)), part]
    return b"".join(parts)


class TokenFile:
    """A packed file in memory (or a memory map)."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        n, self.n_tokens, levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n)
        at += 16 * n + 8
        self.levels = []
        for _ in range(levels):
            level = []
            for kind in (np.uint8, np.uint8, np.dtype("<u8")):
                (size,) = struct.unpack_from("<Q", data, at)
                level.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
                at += 8 + size
            self.levels.append(level)

    def _ones(self, level: int, i: int) -> int:
        """How many of the first i bits of a level are set: one directory entry, and the bits of part of a block."""
        _, bits, rank = self.levels[level]
        first = i // BLOCK * BLOCK // 8
        out = int(rank[i // BLOCK]) + int(np.bitwise_count(bits[first : i >> 3]).sum())
        return out + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else out

    def token(self, i: int) -> int:
        """The i-th id, by rank steps alone."""
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._ones(k, i)
        return value

    def span(self, i: int, j: int) -> np.ndarray:
        """Ids i..j-1: at each level the chunks of just these, which stand side by side."""
        out, at = np.zeros(j - i, np.uint32), np.arange(j - i)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if i == j:
                break
            out[at] |= chunks[i:j].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[i >> 3 : (j + 7) >> 3], bitorder="little")[i & 7 : (i & 7) + j - i].view(bool)
            at = at[more]
            if len(at):
                i = self._ones(k, i)
            j = i + len(at) if len(at) else i
        return out

    def all(self) -> np.ndarray:
        """All ids at once."""
        return self.span(0, self.n_tokens)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; nothing else is decoded."""
        return self.span(int(self.offsets[k]), int(self.offsets[k + 1]))


def _store(path: str):
    """path must have a scheme, as qualified() gives it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 1, file_tokens: int = 8_000_000) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; returns the written list of files: part, seq, path, n_docs, n_tokens.

    Documents are range-partitioned by (doc_id, text hash); each task writes one file after another
    of about file_tokens ids. A file is written under a name of its attempt, then renamed, so a
    task that is run again leaves the same files, and what dead attempts left is deleted at the end. A null
    doc_id comes first and is stored as a flag. A folder without scheme is in the default file system;
    pyarrow must be able to open it.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def run(batches):
        import os
        import uuid

        from pyspark import TaskContext

        from .tokens import encoder

        e, number, seq, held, n = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0, [], 0
        files, base = _store(folder)
        files.create_dir(base, recursive=True)
        end = end_id.to_bytes(4, "little")

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            known = np.array([i is not None for i, _ in held], bool)
            data = pack_tokens(np.array([i or 0 for i, _ in held], np.int64), np.array([len(x) // 4 for _, x in held], np.int64), ids)
            data += np.packbits(known).tobytes()
            path = f"{base}/part-{number:06d}-{seq:04d}.dac"
            with files.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as f:
                f.write(data)
            files.move(tmp, path)
            return number, seq, os.path.basename(path), len(held), len(ids)

        for batch in batches:
            for part in portions(batch, 1, SLICE):
                for i, ids in zip(part.column(0).to_pylist(), e.encode_batch(part.column(1))):
                    held.append((i, ids + end))
                    n += len(ids) // 4 + 1
                if n >= file_tokens:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, flush()))], schema=kinds)
                    seq, held, n = seq + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, flush()))], schema=kinds)

    names = ["part", "seq", "path", "n_docs", "n_tokens"]
    kinds = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ordered = docs.select("doc_id", whole_text().alias("text")).withColumn("t", F.xxhash64("text")).repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t").select("doc_id", "text")
    listing = written(ordered.mapInArrow(tidy(run), "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint"), "token-files")
    for name in names_in(spark, folder):
        if ".dac." in name:
            remove(spark, f"{folder}/{name}")
    return listing


def read_tokens(listing: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, with keep_ids, ids."""
    # one row per file, of about file_tokens ids each: a window over the list of files, not over documents
    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    folder = qualified(listing.sparkSession, folder)
    files = listing.withColumn("start", first).select("path", "start").repartition(max(1, listing.count()), "path")

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                t = TokenFile(data)
                n, off = len(t.doc_ids), t.offsets.astype(np.int64)
                known = np.unpackbits(np.frombuffer(data, np.uint8)[-(-(-n // 8)) :], count=n).astype(bool)
                ids = [t.document(k) for k in range(n)] if keep_ids else None
                sums = [zlib.crc32((ids[k] if keep_ids else t.document(k)).astype("<u4", copy=False)) for k in range(n)]
                cols = [pa.array(t.doc_ids, mask=~known), pa.array(off[:-1] + start), pa.array(np.diff(off)), pa.array(sums, pa.int64())]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    return files.mapInArrow(tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def token_files(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Write docs' token files to folder (default: a new one in the shared folder) and read them back.

    A null or empty text is its end id alone; a very long one stays whole in one file. Rows that repeat a doc_id are stored each, side by
    side; a null doc_id precedes all others; other columns are ignored; no rows give no files.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, kind, end_id), folder, keep_ids)
