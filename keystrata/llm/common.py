"""What several operators share: the documents table, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, names_in, qualified, remove, shared_dir, shared_path, written

#: The white space of the contracts: bytes 20 and 09 to 0D, nothing else.
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Give memory that is free back to the system: Spark reuses Python workers, and an idle one counts too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A mapInArrow function that gives its memory back when its partition is done."""

    def outer(batches):
        yield from run(batches)
        give_back()

    return outer


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more, and give free memory back."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def doc_number(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def spare(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


__all__ = ["WHITE", "WORD_GAP", "discard", "doc_number", "names_in", "qualified", "read_documents", "release", "remove", "shared_dir", "shared_path", "spare", "tidy", "whole_text", "written"]
