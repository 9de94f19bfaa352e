"""Reads: the two views of a put-log (all versions, latest), lookups, scans and set operations.

Order of versions is bytewise on the encoded record: by time and then value for times from zero on;
a negative time sorts above all others, as its sign bit is set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codec import decode_time, decode_value
from ..sources.shared import written


def latest(log: DataFrame, *by: str) -> DataFrame:
    """One record per key (and per `by`): the bytewise greatest. Combined before the shuffle."""
    return log.groupBy(*by, "k").agg(F.max("rec").alias("rec"))


def latest_by_window(log: DataFrame) -> DataFrame:
    """The same as latest(), by rank in the key; Spark limits groups before the shuffle."""
    w = Window.partitionBy("k").orderBy(F.col("rec").desc())
    return log.select("k", "rec").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def pairs(log: DataFrame) -> DataFrame:
    """Distinct (key, record) pairs."""
    return log.select("k", "rec").distinct()


def versions(log: DataFrame) -> DataFrame:
    """k, versions: each key's distinct records in ascending order."""
    return log.groupBy("k").agg(F.sort_array(F.collect_set("rec")).alias("versions"))


def get(log: DataFrame, key: Column) -> DataFrame:
    """All puts of a key; the equality is pushed to the scan where k is a column of the file."""
    return log.where(F.col("k") == key)


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """All puts of many keys in one job; Spark broadcasts keys only if they are below its own size limit."""
    return log.join(keys.select("k").distinct(), "k", "left_semi")


def scan_range(log: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Puts with begin <= key <= end."""
    return log.where((F.col("k") >= begin) & (F.col("k") <= end))


def collect_sources(*sources: DataFrame) -> DataFrame:
    """Bag union of what each source has; duplicates stay."""
    return reduce(DataFrame.unionByName, sources)


def decoded(df: DataFrame) -> DataFrame:
    return df.withColumn("t", decode_time("rec")).withColumn("v", decode_value("rec"))


def key_range(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.min("k").alias("begin"), F.max("k").alias("end"))


def distinct_keys(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count_distinct("k").alias("n_keys"))


def probe(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Keys that the table has."""
    return keys.join(table.select("k"), "k", "left_semi")


def spare(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def ordinal(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with its row number from 1 in the given order, ranked by many tasks.

    Rows are range-partitioned and written, so that the partition of a row is settled; a row's
    number is its rank in its partition plus the rows of the partitions before.
    """
    part, inside, before = (spare(df, n) for n in ("part", "inside", "before"))
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordinal")
    sizes = ranged.groupBy(part).count()  # a row for each partition
    starts = sizes.select(part, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inner = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(inside, inner).join(starts, part).withColumn(name, (F.col(inside) + F.col(before)).cast("long")).drop(part, inside, before)


def floor_lookup(probes: DataFrame, index: DataFrame) -> DataFrame:
    """probes (k, ...) with floor: the greatest index key <= k, or null.

    Probes and index keys are range-partitioned together; in each partition a window carries the last
    index key on, and the greatest of the partitions before fills in for its first rows.
    """
    cols = [c for c in probes.columns if c != "k"]
    kind, part, top, before, here = (spare(probes, n) for n in ("kind", "part", "top", "before", "here"))
    both = probes.withColumn(kind, F.lit(1)).unionByName(index.select("k").distinct().withColumn(kind, F.lit(0)), allowMissingColumns=True)
    ranged = written(both.repartitionByRange("k").withColumn(part, F.spark_partition_id()), "floor")
    own = F.when(F.col(kind) == 0, F.col("k"))
    tops = ranged.groupBy(part).agg(F.max(own).alias(top))  # a row for each partition
    starts = tops.select(part, F.max(top).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(part).orderBy("k", kind).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(here, last).where(F.col(kind) == 1).join(starts, part).select("k", *cols, F.coalesce(here, before).alias("floor"))
