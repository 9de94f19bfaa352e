"""The store: segments of puts and leveled tables under one path, found through a manifest.

A generation is a file manifest/<n>.json, made under another name and given its own in a step that never replaces
one; only files that the newest one lists are live, and no file is ever written twice. So a flush or a merge that
breaks off leaves nothing to repair, and a writer that another one has overtaken harms nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.codec import decode_time, decode_value, encode, entry_bytes
from .operators import views
from .operators.layout import SEGMENT_BYTES
from .plans.levels import Levels, Limits, TableInfo
from .sources.shared import age, commit_text, names_in, read_text, remove

TABLE_SCHEMA = "k binary, t bigint, v binary"
BLOOM = {"parquet.bloom.filter.enabled#k": "true", "compression": "snappy"}
NOTHING = {"segments": [], "base": [], "runs": []}


class Store:
    """put, get, flush, compact. Writers that meet are told apart by the manifest: one commits, the others are refused; any number of readers.

    history: a flush keeps all distinct versions of a key (the versions view then never depends on when a flush
    or merge runs); without it, tables have one record per key. It is fixed when the store is made.
    """

    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None, segment_bytes: int = SEGMENT_BYTES, history: bool = False):
        self.spark, self.path, self.segment_bytes, self.history = spark, path.rstrip("/"), segment_bytes, history
        self.limits = limits or Limits()
        self.restore()

    def _state(self, generation: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{generation}.json"))

    def _generations(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names_in(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def restore(self) -> None:
        """Read the newest generation."""
        found = self._generations()
        self.generation = found[-1] if found else 0
        state = self._state(self.generation) if found else NOTHING
        if found and state.get("history", False) != self.history:
            raise ValueError(f"the store was made with history={not self.history}")
        self.segments: list[dict] = list(state["segments"])
        self.levels = Levels([TableInfo(**t) for t in state["base"]], [[TableInfo(**t) for t in run] for run in state["runs"]], self.limits)

    def _commit(self) -> None:
        state = {"segments": self.segments, "base": [asdict(t) for t in self.levels.base], "runs": [[asdict(t) for t in run] for run in self.levels.runs], "history": self.history}
        if not commit_text(self.spark, f"{self.path}/manifest/{self.generation + 1}.json", json.dumps(state)):
            raise RuntimeError("another writer has committed this generation")
        self.generation += 1

    def _new(self, kind: str) -> str:
        """A path that no other writer, attempt or generation has."""
        name = f"{kind}/{self.generation + 1:08d}-{uuid.uuid4().hex}"
        self._made.append(name)
        return name

    def _changing(self, change: Callable[[], None]) -> None:
        """Run a change and commit it. If anything fails, what it has written is removed, and the store is as the manifest says."""
        self._made: list[str] = []
        try:
            change()
            self._commit()
        except BaseException:
            self.restore()
            live = self._live()
            for name in self._made:
                if name not in live:
                    remove(self.spark, f"{self.path}/{name}")
            raise

    def _live(self) -> set[str]:
        return {t.path.rsplit("/", 1)[0] for t in self.levels.live()} | {s["path"] for s in self.segments}

    def put(self, df: DataFrame) -> None:
        """Append puts (k, t, v); flushes when the segments reach their limit. A refused writer has restored itself and may put again."""

        def change() -> None:
            seen, name = Observation(), self._new("segments")
            rows = df.select("k", "t", "v").observe(seen, F.sum(entry_bytes("k", encode("t", "v"))).alias("b"), F.count(F.lit(1)).alias("n"))
            rows.write.mode("errorifexists").option("compression", "snappy").parquet(f"{self.path}/{name}")
            self.segments.append({"path": name, "n_bytes": seen.get["b"] or 0, "n_rows": seen.get["n"] or 0})

        self._changing(change)
        if self.mem_size() >= self.segment_bytes:
            self.flush()

    def replay(self, log: DataFrame) -> None:
        """Put what an append log has (k, rec), as kvlog reads it; a record shorter than 8 bytes has time 0 and an empty value."""
        self.put(log.select("k", decode_time("rec").alias("t"), decode_value("rec").alias("v")))

    def mem_size(self) -> int:
        return sum(s["n_bytes"] for s in self.segments)

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], TABLE_SCHEMA).withColumn("rec", encode("t", "v"))
        return self.spark.read.schema(TABLE_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names]).withColumn("rec", encode("t", "v"))

    def memory(self) -> DataFrame:
        """Puts that aren't flushed."""
        return self._read([s["path"] for s in self.segments])

    def tables(self) -> DataFrame:
        return self._read([t.path for t in self.levels.live()])

    def log(self) -> DataFrame:
        return self.memory().unionByName(self.tables())

    def versions(self) -> DataFrame:
        """Every version that the store still has, by key."""
        return views.versions(self.log())

    def latest(self) -> DataFrame:
        """The latest record by key, whatever has been flushed or merged."""
        return views.decoded(views.latest(self.log()))

    def get(self, key: bytes) -> DataFrame:
        """Distinct versions of a key, ascending; reads only tables whose range holds it."""
        names = [s["path"] for s in self.segments] + [t.path for t in self.levels.candidates(key.hex().upper())]
        return views.get(self._read(names), F.lit(key)).select("t", "v", "rec").distinct().orderBy("rec").drop("rec")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Distinct versions of many keys; reads only tables whose range meets the keys' own."""
        ends = keys.agg(F.hex(F.min("k")).alias("b"), F.hex(F.max("k")).alias("e")).first()
        return views.multi_get(self._between(ends["b"] or "", ends["e"] or ""), keys).select("k", "t", "v").distinct()

    def _between(self, begin: str | None, end: str | None) -> DataFrame:
        """Puts and tables that may have keys from begin to end (hex, inclusive; None: open)."""
        tables = [t.path for t in self.levels.live() if (begin is None or t.end >= begin) and (end is None or t.begin <= end)]
        return self._read([s["path"] for s in self.segments] + tables)

    def scan(self, begin: bytes | Column | None = None, end: bytes | Column | None = None) -> DataFrame:
        """Latest records in key order, of an inclusive range; given as bytes, it also leaves out tables beyond it."""
        known = [x.hex().upper() if isinstance(x, bytes) else None for x in (begin, end)]
        log = self._between(*known)
        log = log if begin is None else log.where(F.col("k") >= (F.lit(begin) if isinstance(begin, bytes) else begin))
        log = log if end is None else log.where(F.col("k") <= (F.lit(end) if isinstance(end, bytes) else end))
        return views.decoded(views.latest(log)).orderBy("k")

    def _kept(self, log: DataFrame) -> DataFrame:
        """What a table has of a log."""
        return views.pairs(log) if self.history else views.latest(log)

    def _write_tables(self, log: DataFrame, limit: int) -> list[TableInfo]:
        """Sorted files of disjoint key ranges, about `limit` bytes each, of what tables keep of a log; one manifest row per file.

        The records are found once and held by Spark (on disk where memory is short) until they are written: their own
        size settles the number of files, and the ranges are drawn from them.
        """
        name, records = self._new("tables"), views.decoded(self._kept(log)).select("k", "t", "v", "rec").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums = records.agg(F.sum(entry_bytes("k", "rec")).alias("s"), F.count(F.lit(1)).alias("n")).first()
            parts = max(1, -(-(sums["s"] or 0) // limit))
            options = BLOOM | {"parquet.bloom.filter.expected.ndv#k": str(max(1, -(-sums["n"] // parts)))}
            records.select("k", "t", "v").repartitionByRange(parts, "k").sortWithinPartitions("k", "t", "v").write.mode("errorifexists").options(**options).parquet(f"{self.path}/{name}")
        finally:
            records.unpersist()
        made = self._read([name]).withColumn("f", F.element_at(F.split(F.input_file_name(), "/"), -1))
        rows = made.groupBy("f").agg(F.hex(F.min("k")).alias("b"), F.hex(F.max("k")).alias("e"), F.count(F.lit(1)).alias("n"), F.sum(entry_bytes("k", "rec")).alias("s")).collect()  # a row per file
        return sorted((TableInfo(f"{name}/{r['f']}", r["b"], r["e"], r["n"], r["s"]) for r in rows), key=lambda t: t.begin)

    def _merge(self, tables: list[TableInfo], limit: int) -> list[TableInfo]:
        return self._write_tables(self._read([t.path for t in tables]), limit)

    def flush(self) -> None:
        """Segments become base tables of about table_bytes; then levels are balanced; then all is committed at once."""
        if not self.segments:
            return

        def change() -> None:
            self.levels.add(self._write_tables(self.memory(), self.limits.table_bytes), self._merge)
            self.segments = []

        self._changing(change)

    def compact(self) -> None:
        """Merge all that is flushed into one run, of the first level that may have as much."""
        self.flush()

        def change() -> None:
            tables = self.levels.live()
            level = self.levels.level_for(sum(t.n_bytes for t in tables))
            self.levels.base, self.levels.runs = [], [*([] for _ in range(level)), self._merge(tables, self.limits.bytes_of(level))]

        if self.levels.live():
            self._changing(change)

    def vacuum(self, keep: int = 1, grace: float = 0.0) -> None:
        """Delete files that none of the newest `keep` generations lists and that have not changed for `grace` seconds; readers of older generations, and writers that have not committed for so long, must be gone."""
        found = self._generations()
        live: set[str] = set()
        for g in found[-keep:]:
            state = self._state(g)
            live |= {s["path"] for s in state["segments"]} | {t["path"].rsplit("/", 1)[0] for t in [*state["base"], *(t for run in state["runs"] for t in run)]}
        for kind in ("segments", "tables"):
            for n in names_in(self.spark, f"{self.path}/{kind}"):
                if f"{kind}/{n}" not in live and (not grace or age(self.spark, f"{self.path}/{kind}/{n}") >= grace):
                    remove(self.spark, f"{self.path}/{kind}/{n}")
        newest = {f"{g}.json" for g in found[-keep:]}
        for n in names_in(self.spark, f"{self.path}/manifest"):
            if n not in newest and (not grace or age(self.spark, f"{self.path}/manifest/{n}") >= grace):
                remove(self.spark, f"{self.path}/manifest/{n}")

    def close(self) -> None:
        self.flush()


def recover(logs: list[DataFrame]) -> DataFrame:
    """Any number of logs as one."""
    return reduce(DataFrame.unionByName, logs)
