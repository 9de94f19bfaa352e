"""Sizes, and the cuts that they imply."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codec import block_bytes, entry_bytes
from ..sources.shared import written
from .views import ordinal, spare

#: Fixed values of the store: bytes of a memory segment, of a block, of a table of level 0.
SEGMENT_BYTES = 64 << 20
BLOCK_BYTES = 128 << 10
TABLE_BYTES = 128 << 20


def mem_size(log: DataFrame, *by: str) -> DataFrame:
    """Accounted bytes of a log; every put counts, repeated ones too."""
    return log.groupBy(*by).agg(F.sum(entry_bytes("k", "rec")).cast("long").alias("mem_bytes"))


def running_size(log: DataFrame, by: str) -> DataFrame:
    """Accounted bytes after each put of a segment, in the order of seq.

    A segment may be large or few: its rows are range-partitioned and written, sums run in each
    partition, and a partition starts from the sum of those before, so no window runs over a segment in one task.
    """
    part, own, size, before = (spare(log, n) for n in ("part", "own", "size", "before"))
    ranged = written(log.withColumn(size, entry_bytes("k", "rec")).repartitionByRange(by, "seq").withColumn(part, F.spark_partition_id()), "running")
    sums = ranged.groupBy(by, part).agg(F.sum(size).alias(size))  # a row for each segment and partition
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(by), F.col(part), F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    inner = Window.partitionBy(part, by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn(own, F.sum(size).over(inner)).join(starts, [by, part])
    return out.withColumn("mem_bytes", (F.col(own) + F.col(before)).cast("long")).select(*log.columns, "mem_bytes")


def block_cuts(table: DataFrame, by: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of each table in key order: a block ends when the next row would exceed the limit.

    The sum starts afresh at each cut, so a table is folded in order by one task, which holds no more of it than a batch:
    Spark sorts keys and sizes (spilling if it must), and the fold jumps from cut to cut by running sums.
    """
    kind = table.schema[by].dataType.simpleString()
    names = [by, "block", "first_key", "n_rows", "block_bytes"]

    def cuts(batches):
        now, block, key, rows, used = None, 0, None, 0, 0
        for batch in batches:
            of, keys, sizes = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy()
            sums = np.concatenate([[0], np.cumsum(sizes)])
            out, i, n = [], 0, len(of)
            while i < n:
                if rows and (of[i] != now or used + sizes[i] > limit):
                    out.append((now, block, key, rows, used))
                    block, rows = block + 1, 0
                if not rows:
                    block, now, key, used = (block if of[i] == now else 0), of[i], keys[i].as_py(), 0
                # as far as the limit, this batch and this table reach; one row at least
                j = max(i + 1, int(np.searchsorted(sums, sums[i] + limit - used, side="right")) - 1)
                j = min(j, n)
                if of[j - 1] != now:
                    j = bisect.bisect_left(range(i, j), True, key=lambda x: of[x] != now) + i
                rows, used, i = rows + j - i, used + int(sums[j] - sums[i]), j
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, block, key, rows, used), kinds)], names=names)

    rows = table.select(by, F.hex("k").alias("key"), block_bytes("k", "rec").alias("size"))
    return rows.repartition(by).sortWithinPartitions(by, "key").mapInArrow(cuts, f"{by} {kind}, block long, first_key string, n_rows long, block_bytes long")


def segment_cuts(log: DataFrame, entry: int, limit: int = SEGMENT_BYTES) -> DataFrame:
    """log with its segment, for puts of `entry` accounted bytes each: a segment closes after the put that reaches the limit."""
    each = -(-limit // entry)
    return ordinal(log, "seq").withColumn("segment", F.floor((F.col("n") - 1) / each).cast("long")).drop("n")


def overlaps(tables: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of tables (tab, begin, end) whose key intervals overlap.

    tables is a manifest, one row per table, as the planner of levels holds it on the driver. A sweep in order of
    begin keys meets overlapping pairs only.
    """
    spark, kind = tables.sparkSession, tables.schema["tab"].dataType.simpleString()
    rows = sorted((bytes(r["begin"]), bytes(r["end"]), r["tab"]) for r in tables.select("tab", "begin", "end").collect())
    found, open_ = [], []
    for begin, end, tab in rows:
        open_ = [(e, t) for e, t in open_ if e >= begin]
        found += [(min(t, tab), max(t, tab)) for _, t in open_]
        open_.append((end, tab))
    return spark.createDataFrame(found, f"a {kind}, b {kind}")


def holders(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """For each table of a manifest (tab, begin, end): its interval, and how many of the keys lie in it.

    The manifest goes to all tasks as a literal; a key meets just the tables that hold it.
    """
    spark, kind = keys.sparkSession, tables.schema["tab"].dataType.simpleString()
    rows = [(r["tab"], bytes(r["begin"]), bytes(r["end"])) for r in tables.select("tab", "begin", "end").collect()]
    manifest = spark.createDataFrame(rows, f"tab {kind}, begin binary, end binary")
    all_ = F.array(*[F.struct(F.lit(t).cast(kind).alias("tab"), F.lit(b).alias("begin"), F.lit(e).alias("end")) for t, b, e in rows]) if rows else F.array().cast(f"array<struct<tab:{kind},begin:binary,end:binary>>")
    met = keys.select(F.explode(F.filter(all_, lambda t: (t["begin"] <= F.col("k")) & (t["end"] >= F.col("k")))["tab"]).alias("tab")).groupBy("tab").agg(F.count(F.lit(1)).alias("n_inside"))
    return manifest.join(met, "tab", "left").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))


def level_overflow(manifest: DataFrame, first: int = 10, factor: int = 10) -> DataFrame:
    """Tables per level against the level's limit."""
    limit = (F.lit(first) * F.pow(F.lit(factor), F.col("level"))).cast("long")
    return manifest.groupBy("level").agg(F.count_distinct("tab").alias("n_tables")).withColumn("max_tables", limit).withColumn("overflow", F.col("n_tables") > F.col("max_tables"))


__all__ = ["block_cuts", "holders", "level_overflow", "mem_size", "overlaps", "running_size", "segment_cuts"]
