"""The query catalogue of the store's operators, each with the SQL that must give the same rows.

Put-log P: events by user, timed in microseconds, the event type as value; gen = event_id % 4 stands
for four segments or tables. Coarse put-log C has day numbers as times, so that repeats and ties occur.
Keys and records are shown as hex. Every query runs over its whole table: where tables of other key ranges are
needed, dealt() shares all events out by where their key lies between the least and the greatest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codec import decode_time, decode_value, entry_bytes, long_key, record_string
from .operators import layout, merge, views
from .operators.model import put_log
from .plans.levels import Limits
from .sources import log as logs
from .sources.shared import shared_path
from .store import Store
from .streaming.latest import compact_latest, maintain_latest, read_latest


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, users: Column | None = None) -> DataFrame:
    """users: a condition on user_id for a lookup, which is pushed to the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e if users is None else e.where(users)


def fine_log(spark: SparkSession, sf_dir: str, users: Column | None = None) -> DataFrame:
    e = events(spark, sf_dir, users)
    return put_log(e, F.col("event_id"), long_key("user_id"), _micros("ts"), F.encode("event_type", "UTF-8"), F.col("user_id"), (F.col("event_id") % 4).alias("gen"))


def coarse_log(spark: SparkSession, sf_dir: str, users: Column | None = None) -> DataFrame:
    e = events(spark, sf_dir, users)
    return put_log(e, F.col("event_id"), long_key("user_id"), F.floor(_micros("ts") / 86_400_000_000), F.encode("event_type", "UTF-8"), (F.col("event_id") % 4).alias("gen"))


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return put_log(li, F.col("l_linenumber"), long_key("l_orderkey"), _micros("l_shipdate"), F.encode("l_returnflag", "UTF-8"), F.col("l_linenumber"))


def dealt(log: DataFrame, parts: int) -> DataFrame:
    """log with tab: the keys' range is cut into `parts` stretches, and every other put of a stretch goes to the table before, so that neighbours overlap."""
    ends = log.agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi")).first()  # one row
    lo, width = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    stretch = F.floor((F.col("user_id") - lo) * parts / F.lit(width)).cast("long")
    return log.withColumn("tab", F.greatest(F.lit(0).cast("long"), stretch - F.col("seq") % 2))


def shown(df: DataFrame) -> DataFrame:
    for c in ("k", "rec"):
        if c in df.columns:
            df = df.withColumn(c, F.hex(c))
    return df


USER = 17
P = "p AS (SELECT event_id AS seq, user_id, event_id % 4 AS gen, lpad(hex(user_id), 16, '0') AS k, epoch_us(ts) AS t, event_type AS v, lpad(hex(epoch_us(ts)), 16, '0') || hex(encode(event_type)) AS rec FROM events)"
C = "c AS (SELECT event_id AS seq, event_id % 4 AS gen, lpad(hex(user_id), 16, '0') AS k, lpad(hex(epoch_us(ts) // 86400000000), 16, '0') || hex(encode(event_type)) AS rec FROM events)"
L = "l AS (SELECT l_linenumber, lpad(hex(l_orderkey), 16, '0') AS k, lpad(hex(epoch_us(l_shipdate)), 16, '0') || hex(encode(l_returnflag)) AS rec FROM lineitem)"


def point_get(spark, sf_dir):
    # the key is made from user_id, so the equality is pushed to the scan as one of user_id
    return shown(views.get(fine_log(spark, sf_dir, F.col("user_id") == USER), long_key(F.lit(USER))).select("k", "rec"))


def get_versions(spark, sf_dir):
    got = views.versions(views.get(coarse_log(spark, sf_dir, F.col("user_id") == USER), long_key(F.lit(USER))))
    return shown(got.select("k", F.array_join(F.transform("versions", F.hex), ",").alias("versions")))


def multi_get(spark, sf_dir):
    keys = spark.range(0, 400, 3).select(long_key("id").alias("k"))
    return shown(views.multi_get(fine_log(spark, sf_dir), keys).select("k", "rec"))


def flush_latest(spark, sf_dir):
    return shown(views.latest(fine_log(spark, sf_dir)))


def dump_all_versions(spark, sf_dir):
    v = views.versions(coarse_log(spark, sf_dir))
    return shown(v.select("k", F.size("versions").cast("long").alias("n_versions"), F.array_join(F.transform("versions", F.hex), ",").alias("versions")))


def pair_iterator(spark, sf_dir):
    return shown(views.pairs(coarse_log(spark, sf_dir)))


def collect_sources(spark, sf_dir):
    log = coarse_log(spark, sf_dir)
    return shown(views.collect_sources(*[views.latest(log.where(F.col("gen") == g)).withColumn("gen", F.lit(g).cast("long")) for g in range(4)]))


def merge_all_memtables(spark, sf_dir):
    log = coarse_log(spark, sf_dir)
    return shown(merge.merge_versions(log.where("gen IN (0, 1)"), log.where("gen IN (2, 3)")))


def merge_dealt_tables(spark, sf_dir):
    log = dealt(fine_log(spark, sf_dir), 3)
    return shown(merge.outer_merge(views.latest(log.where("tab = 0")), views.latest(log.where("tab > 0"))))


def merge_run(spark, sf_dir):
    log = fine_log(spark, sf_dir)
    return shown(merge.merge_latest(*[views.latest(log.where(F.col("gen") == g)) for g in range(4)]))


def mem_size(spark, sf_dir):
    return layout.mem_size(fine_log(spark, sf_dir), "gen")


def mem_size_running(spark, sf_dir):
    return layout.running_size(fine_log(spark, sf_dir), "gen").select("gen", "seq", "mem_bytes")


def codec_roundtrip(spark, sf_dir):
    log = fine_log(spark, sf_dir)
    return shown(log.select("seq", "rec", decode_time("rec").alias("t"), F.decode(decode_value("rec"), "UTF-8").alias("v")))


def string_of_record(spark, sf_dir):
    return fine_log(spark, sf_dir).select("seq", record_string("t", "v").alias("shown"))


def ordered_scan(spark, sf_dir):
    return shown(views.ordinal(views.latest(fine_log(spark, sf_dir)), "k"))


def scan_range(spark, sf_dir):
    log = fine_log(spark, sf_dir, F.col("user_id").between(20, 60))
    return shown(views.latest(views.scan_range(log, long_key(F.lit(20)), long_key(F.lit(60)))))


def key_ranges(spark, sf_dir):
    log = dealt(fine_log(spark, sf_dir), 8)
    found = layout.holders(log.select("k").distinct(), views.key_range(log, "tab"))
    return found.select("tab", F.hex("begin").alias("begin_key"), F.hex("end").alias("end_key"), "n_inside")


def filter_probe(spark, sf_dir):
    return shown(views.probe(spark.range(0, 400, 3).select(long_key("id").alias("k")), fine_log(spark, sf_dir)))


def index_floors(spark, sf_dir):
    keys = fine_log(spark, sf_dir).select("k").distinct()
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(long_key("c_custkey").alias("k"))
    return views.floor_lookup(probes, keys).select(F.hex("k").alias("k"), F.hex("floor").alias("floor_key"))


def overlapping_ranges(spark, sf_dir):
    return layout.overlaps(views.key_range(dealt(fine_log(spark, sf_dir), 8), "tab"))


def distinct_keys(spark, sf_dir):
    return views.distinct_keys(fine_log(spark, sf_dir), "gen")


def level_overflow(spark, sf_dir):
    tab = F.col("seq") % 40
    return layout.level_overflow(fine_log(spark, sf_dir).select(tab.alias("tab"), F.when(tab < 12, 0).otherwise(1).cast("long").alias("level")))


def latest_window(spark, sf_dir):
    return shown(views.latest_by_window(fine_log(spark, sf_dir)))


def block_cut(spark, sf_dir):
    return layout.block_cuts(views.latest(fine_log(spark, sf_dir), "gen"), "gen", 2000)


def segment_cut(spark, sf_dir):
    log = fine_log(spark, sf_dir).select("seq")
    return layout.segment_cuts(log, 40, 40_000).groupBy("segment").agg(F.count(F.lit(1)).alias("n_puts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def streaming_latest(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = put_log(stream, F.col("event_id"), long_key("user_id"), _micros("ts"), F.encode("event_type", "UTF-8"))
    table = shared_path(spark, "latest")
    maintain_latest(log, table, shared_path(spark, "stream")).awaitTermination()
    compact_latest(spark, table)
    return shown(read_latest(spark, table))


def _filled(spark, sf_dir, log: DataFrame, history: bool = False) -> Store:
    """A store that has all puts in four portions, flushed after each but the last, with limits so low that levels fill and merge."""
    store = Store(spark, shared_path(spark, "store"), Limits(base_tables=2, level_tables=1, table_bytes=64 << 10), history=history)
    for gen in range(4):
        store.put(log.where(F.col("gen") == gen))
        if gen < 3:
            store.flush()
    return store


def store_latest(spark, sf_dir):
    """Put, flush, leveled merges; one portion is still a segment; read by a store that is opened anew."""
    store = _filled(spark, sf_dir, fine_log(spark, sf_dir))
    return shown(Store(spark, store.path, store.limits).latest().select("k", "rec"))


def store_versions(spark, sf_dir):
    """All versions after flushes, merges and a compaction of a store that keeps them."""
    store = _filled(spark, sf_dir, coarse_log(spark, sf_dir), history=True)
    store.compact()
    store.vacuum()
    v = Store(spark, store.path, store.limits, history=True).versions()
    return shown(v.select("k", F.size("versions").cast("long").alias("n_versions"), F.array_join(F.transform("versions", F.hex), ",").alias("versions")))


def store_closed(spark, sf_dir):
    """What is flushed by close(): by the manifest, the number of records of one run and its key range; no two tables overlap."""
    store = _filled(spark, sf_dir, fine_log(spark, sf_dir))
    store.compact()
    store.close()
    tables = Store(spark, store.path, store.limits).levels.live()
    apart = all(a.end < b.begin for a, b in zip(tables, tables[1:]))
    return spark.createDataFrame([(sum(t.n_rows for t in tables), min(t.begin for t in tables), max(t.end for t in tables), apart, store.mem_size())], "n_records long, begin_key string, end_key string, apart boolean, mem_bytes long")


def log_replayed(spark, sf_dir):
    """Puts written as append logs, read back and replayed into a store."""
    logs.register(spark)
    path = shared_path(spark, "log")
    fine_log(spark, sf_dir).select("k", "rec").write.format("kvlog").mode("append").save(path)
    store = Store(spark, shared_path(spark, "store"))
    store.replay(spark.read.format("kvlog").load(path))
    store.flush()
    return shown(store.latest().select("k", "rec"))


def lineitem_latest(spark, sf_dir):
    return shown(views.latest(line_log(spark, sf_dir)))


def lineitem_merge(spark, sf_dir):
    log = line_log(spark, sf_dir)
    return shown(merge.outer_merge(views.latest(log.where("l_linenumber <= 3")), views.latest(log.where("l_linenumber > 3"))))


def document_sizes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = put_log(d, F.col("doc_id"), F.encode("source", "UTF-8"), F.col("doc_id"), F.encode("text", "UTF-8"), F.col("source"))
    return log.groupBy("source").agg(F.sum(entry_bytes("k", "rec")).cast("long").alias("mem_bytes"), F.max("t").alias("last_t"))


DEALT = "e AS (SELECT min(user_id) AS lo, max(user_id) - min(user_id) + 1 AS width FROM p)"
_SQL = {
    "point_get": f"WITH {P} SELECT k, rec FROM p WHERE user_id = {USER}",
    "get_versions": f"WITH {C} SELECT k, string_agg(DISTINCT rec, ',' ORDER BY rec) AS versions FROM c WHERE k = lpad(hex({USER}), 16, '0') GROUP BY k",
    "multi_get": f"WITH {P} SELECT k, rec FROM p WHERE user_id IN (SELECT range FROM range(0, 400, 3))",
    "flush_latest": f"WITH {P} SELECT k, max(rec) AS rec FROM p GROUP BY k",
    "dump_all_versions": f"WITH {C} SELECT k, count(DISTINCT rec) AS n_versions, string_agg(DISTINCT rec, ',' ORDER BY rec) AS versions FROM c GROUP BY k",
    "pair_iterator": f"WITH {C} SELECT DISTINCT k, rec FROM c",
    "collect_sources": f"WITH {C} SELECT k, max(rec) AS rec, gen FROM c GROUP BY gen, k",
    "merge_run": f"WITH {P} SELECT k, max(rec) AS rec FROM p GROUP BY k",
    "mem_size": f"WITH {P} SELECT gen, CAST(sum(16 + length(k) // 2 + length(rec) // 2) AS BIGINT) AS mem_bytes FROM p GROUP BY gen",
    "mem_size_running": f"WITH {P} SELECT gen, seq, CAST(sum(16 + length(k) // 2 + length(rec) // 2) OVER (PARTITION BY gen ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mem_bytes FROM p",
    "codec_roundtrip": f"WITH {P} SELECT seq, rec, t, v FROM p",
    "string_of_record": f"WITH {P} SELECT seq, v || ' [' || t || ']' AS shown FROM p",
    "ordered_scan": f"WITH {P} SELECT k, max(rec) AS rec, row_number() OVER (ORDER BY k) AS n FROM p GROUP BY k",
    "scan_range": f"WITH {P} SELECT k, max(rec) AS rec FROM p WHERE user_id BETWEEN 20 AND 60 GROUP BY k",
    "filter_probe": f"WITH {P}, q AS (SELECT lpad(hex(range), 16, '0') AS k FROM range(0, 400, 3)) SELECT k FROM q WHERE k IN (SELECT k FROM p)",
    "merge_all_memtables": f"WITH {C} SELECT DISTINCT k, rec FROM c",
    "merge_dealt_tables": f"WITH {P}, {DEALT}, d AS (SELECT p.*, greatest(0, (user_id - lo) * 3 // width - seq % 2) AS tab FROM p, e), a AS (SELECT k, max(rec) AS r FROM d WHERE tab = 0 GROUP BY k), b AS (SELECT k, max(rec) AS r FROM d WHERE tab > 0 GROUP BY k) SELECT coalesce(a.k, b.k) AS k, greatest(a.r, b.r) AS rec, CASE WHEN b.r IS NULL THEN 'left' WHEN a.r IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k",
    "key_ranges": f"WITH {P}, {DEALT}, d AS (SELECT p.*, greatest(0, (user_id - lo) * 8 // width - seq % 2) AS tab FROM p, e), r AS (SELECT tab, min(k) AS b, max(k) AS e FROM d GROUP BY tab), q AS (SELECT DISTINCT k FROM p) SELECT tab, b AS begin_key, e AS end_key, count(*) AS n_inside FROM r JOIN q ON q.k BETWEEN r.b AND r.e GROUP BY tab, b, e",
    "index_floors": f"WITH {P}, i AS (SELECT DISTINCT k FROM p), q AS (SELECT lpad(hex(c_custkey), 16, '0') AS k FROM customer) SELECT q.k, (SELECT max(i.k) FROM i WHERE i.k <= q.k) AS floor_key FROM q",
    "overlapping_ranges": f"WITH {P}, {DEALT}, d AS (SELECT p.*, greatest(0, (user_id - lo) * 8 // width - seq % 2) AS tab FROM p, e), r AS (SELECT tab, min(k) AS b, max(k) AS e FROM d GROUP BY tab) SELECT x.tab AS a, y.tab AS b FROM r x JOIN r y ON x.tab < y.tab AND x.e >= y.b AND x.b <= y.e",
    "store_latest": f"WITH {P} SELECT k, max(rec) AS rec FROM p GROUP BY k",
    "store_versions": f"WITH {C} SELECT k, count(DISTINCT rec) AS n_versions, string_agg(DISTINCT rec, ',' ORDER BY rec) AS versions FROM c GROUP BY k",
    "store_closed": f"WITH {P} SELECT count(DISTINCT k) AS n_records, min(k) AS begin_key, max(k) AS end_key, true AS apart, CAST(0 AS BIGINT) AS mem_bytes FROM p",
    "log_replayed": f"WITH {P} SELECT k, max(rec) AS rec FROM p GROUP BY k",
    "distinct_keys": f"WITH {P} SELECT gen, count(DISTINCT k) AS n_keys FROM p GROUP BY gen",
    "level_overflow": "WITH m AS (SELECT event_id % 40 AS tab, CASE WHEN event_id % 40 < 12 THEN 0 ELSE 1 END AS level FROM events) SELECT CAST(level AS BIGINT) AS level, count(DISTINCT tab) AS n_tables, CAST(10 * pow(10, level) AS BIGINT) AS max_tables, count(DISTINCT tab) > 10 * pow(10, level) AS overflow FROM m GROUP BY level",
    "latest_window": f"WITH {P} SELECT k, rec FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec DESC) = 1",
    "block_cut": f"""WITH RECURSIVE {P}, t AS (SELECT gen, k, 4 + length(k) // 2 + length(max(rec)) // 2 AS size, row_number() OVER (PARTITION BY gen ORDER BY k) AS n FROM p GROUP BY gen, k),
        f AS (SELECT gen, n, k, size AS used, 0 AS block, size FROM t WHERE n = 1 UNION ALL
              SELECT t.gen, t.n, t.k, CASE WHEN f.used + t.size > 2000 THEN t.size ELSE f.used + t.size END, CASE WHEN f.used + t.size > 2000 THEN f.block + 1 ELSE f.block END, t.size FROM f JOIN t ON t.gen = f.gen AND t.n = f.n + 1)
        SELECT gen, CAST(block AS BIGINT) AS block, min(k) AS first_key, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS block_bytes FROM f GROUP BY gen, block""",
    "segment_cut": "WITH r AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT (n - 1) // 1000 AS segment, count(*) AS n_puts, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY 1",
    "streaming_latest": f"WITH {P} SELECT k, max(rec) AS rec FROM p GROUP BY k",
    "lineitem_latest": f"WITH {L} SELECT k, max(rec) AS rec FROM l GROUP BY k",
    "lineitem_merge": f"WITH {L}, a AS (SELECT k, max(rec) AS r FROM l WHERE l_linenumber <= 3 GROUP BY k), b AS (SELECT k, max(rec) AS r FROM l WHERE l_linenumber > 3 GROUP BY k) SELECT coalesce(a.k, b.k) AS k, greatest(a.r, b.r) AS rec, CASE WHEN b.r IS NULL THEN 'left' WHEN a.r IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k",
    "document_sizes": "SELECT source, CAST(sum(16 + strlen(source) + 8 + strlen(text)) AS BIGINT) AS mem_bytes, max(doc_id) AS last_t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
