"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tidy, whole_text, written
from .stretches import portions

#: Documents that are encoded together, at most.
SLICE = 4096
#: A plan of at most this many rows is broadcast (40 bytes each); a longer one is joined by shuffling.
PLAN_ROWS = 200_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first bin, pieces a bin, offset in the bin).

    Bins of the same free space are held as intervals, so the work depends on the number of
    distinct lengths and intervals, not on the number of pieces. Ranks lo..hi-1 of a length go to
    bins b, b + 1, ..., k pieces in each, one after another from the offset on.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, space = counts[length], 0, length
        while left:
            while space < capacity and not free[space]:
                space += 1
            if free[space]:
                first, many = free[space].pop()
            else:
                space, first, many = capacity, bins, -(-left // (capacity // length))
                bins += many
            each = space // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - space))
                free[space - each * length].append((first, full))
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if left and many:
                plan.append((length, rank, rank + left, first, left, capacity - space))
                free[space - left * length].append((first, 1))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                free[space].append((first, many))
    return plan


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only a longer one is cut, and its first piece is the shorter."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Encode every text (null: empty), append end_id, cut: doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids as little-endian unsigned 32-bit integers."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from .tokens import encoder

        e = encoder(tokenizer, kind)
        for batch in batches:
            for part in portions(batch, 1, SLICE):
                rows: list[list] = [[], [], [], [], [], []]
                for i, ids in zip(part.column(0).to_pylist(), e.encode_batch(part.column(1))):
                    ids, start = ids + end, 0
                    for piece, n in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        for col, v in zip(rows, (i, piece, start, n, zlib.crc32(own), own)):
                            col.append(v)
                        start += n
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if keep_ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(run), schema)


def place(pieces: DataFrame, capacity: int = 1024, group: int = 100_000) -> DataFrame:
    """pieces with sequence_id and offset, by joining each piece's rank within its length to the plan.

    A length's pieces are ranked in salted groups of about `group` pieces, so a length that holds a
    third of all rows is ranked by many tasks. pieces must be a written table: its ranks are used once.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_best_fit(counts, capacity)
    salts = spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()] or [(0, 1)], "length bigint, salts bigint")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("in_group", rank).join(before, ["length", "salt"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("in_group")).drop("before", "in_group", "salt")
    slots = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "length bigint, lo bigint, hi bigint, bin bigint, each bigint, at bigint")
    slots = F.broadcast(slots) if len(plan) <= PLAN_ROWS else slots
    nth = F.col("rank") - F.col("lo")
    return (
        ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots["length"])
        .withColumn("sequence_id", (F.col("bin") + F.floor(nth / F.col("each"))).cast("long"))
        .withColumn("offset", (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long"))
        .drop("rank", "lo", "hi", "bin", "each", "at")
    )


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pack all texts into sequences of at most `capacity` tokens: one row per piece.

    A null or empty text is its end id alone, one piece of one token; a very long one is cut into pieces of `capacity`.
    Repeated rows are packed each; a null doc_id is passed through; other columns are ignored; no rows give no rows.
    """
    pieces = written(pieces_of(docs, tokenizer, kind, end_id, capacity, keep_ids), "pieces")
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return place(pieces, capacity).select(*order)
