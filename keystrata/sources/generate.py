"""A load program: puts of pseudo-random 8-byte keys and values, times from 0 to 1023, with the time that each portion takes."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import long_key


def random_puts(spark: SparkSession, n: int, seed: int = 0, keys: int | None = None) -> DataFrame:
    """n puts (seq, k, t, v); with keys, over about so many different keys. The same seed gives the same puts."""
    number = F.xxhash64("id", F.lit(seed))
    key = number if keys is None else F.xxhash64(F.pmod(number, F.lit(keys)))
    return spark.range(n).select(F.col("id").alias("seq"), long_key(key).alias("k"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1024)).alias("t"), long_key(F.xxhash64("id", F.lit(seed + 2))).alias("v"))


def run_load(store, n: int, every: int = 100_000, seed: int = 0, keys: int | None = None) -> Iterator[tuple[int, float]]:
    """Put n random records, `every` at a time; yields how many are in and the seconds of the last portion."""
    for at in range(0, n, every):
        began, many = time.perf_counter(), min(every, n - at)
        store.put(random_puts(store.spark, many, seed + at, keys))
        yield at + many, time.perf_counter() - began
