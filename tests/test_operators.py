import random

from pyspark.sql import functions as F

from keystrata.functions.codec import decode_time, decode_value, encode, record_string
from keystrata.operators import layout, merge, views
from keystrata.operators.model import put_log


def log(spark, rows):
    df = spark.createDataFrame(rows, "seq long, k binary, t long, v binary")
    return put_log(df, F.col("seq"), F.col("k"), F.col("t"), F.col("v"))


def as_dict(df):
    return {bytes(r["k"]): (r["t"], bytes(r["v"])) for r in views.decoded(df).collect()}


WORDS = b"hello world this is unique".split()


def test_put_get_and_size(spark):
    df = log(spark, [(i, w, 0, w) for i, w in enumerate(WORDS)])
    assert {bytes(r["k"]): [bytes(x)[8:] for x in r["versions"]] for r in views.versions(df).collect()} == {w: [w] for w in WORDS}
    # keys and values have 44 bytes; each put counts 16 more, and each record 8 for its time
    assert layout.mem_size(df).first()["mem_bytes"] == 44 + 5 * 16 + 5 * 8


def test_merge_has_keys_of_both(spark):
    a, b = log(spark, [(i, w, 0, w) for i, w in enumerate(WORDS[:3])]), log(spark, [(i, w, 0, w) for i, w in enumerate(WORDS[3:])])
    assert {bytes(r["k"]) for r in merge.merge_versions(a, b).collect()} == set(WORDS)
    assert as_dict(merge.merge_latest(a, b)).keys() == set(WORDS)
    assert {(bytes(r["k"]), r["side"]) for r in merge.outer_merge(views.latest(a), views.latest(b)).collect()} == {(w, "left") for w in WORDS[:3]} | {(w, "right") for w in WORDS[3:]}


def test_codec_limits(spark):
    times = [0, 1, -1, 2**63 - 1, -(2**63), 1023]
    df = spark.createDataFrame([(t, bytes([i]) * i) for i, t in enumerate(times)], "t long, v binary").withColumn("rec", encode("t", "v"))
    for r in df.withColumn("t2", decode_time("rec")).withColumn("v2", decode_value("rec")).collect():
        assert bytes(r["rec"]) == r["t"].to_bytes(8, "big", signed=True) + bytes(r["v"])
        assert (r["t2"], bytes(r["v2"])) == (r["t"], bytes(r["v"]))
    short = spark.createDataFrame([(b"abc",), (b"",)], "rec binary").select(decode_time("rec").alias("t"), decode_value("rec").alias("v")).collect()
    assert [(r["t"], bytes(r["v"])) for r in short] == [(0, b""), (0, b"")]
    assert spark.createDataFrame([(7, b"x")], "t long, v binary").select(record_string("t", "v").alias("s")).first()["s"] == "x [7]"


ROWS = [
    (0, b"dup", 1, b"a"), (1, b"dup", 1, b"a"), (2, b"tie", 5, b"a"), (3, b"tie", 5, b"b"), (4, b"neg", -1, b"n"), (5, b"neg", 1, b"p"),
    (6, b"\x7f", 1, b"x"), (7, b"\x80", 1, b"y"), (8, b"", 1, b"empty key"), (9, b"a", 1, b""), (10, b"ab", 1, b"z"), (11, b"old", 9, b"new"), (12, b"old", 3, b"late"),
    (13, b"long", 1, b"v" * 70_000),
]
LATEST = {b"dup": (1, b"a"), b"tie": (5, b"b"), b"neg": (-1, b"n"), b"\x7f": (1, b"x"), b"\x80": (1, b"y"), b"": (1, b"empty key"), b"a": (1, b""), b"ab": (1, b"z"), b"old": (9, b"new"), b"long": (1, b"v" * 70_000)}


def test_latest_in_any_order_and_any_grouping(spark):
    rows = ROWS * 2
    random.Random(1).shuffle(rows)
    df = log(spark, rows)
    assert as_dict(views.latest(df)) == LATEST == as_dict(views.latest_by_window(df))
    halves = [views.latest(df.where(F.col("seq") % 2 == i)) for i in range(2)]
    assert as_dict(merge.merge_latest(*halves)) == LATEST
    assert [bytes(r["k"]) for r in views.latest(df).orderBy("k").collect()] == sorted(LATEST)


def test_sizes_count_repeats(spark):
    df = log(spark, ROWS[:2])
    assert layout.mem_size(df).first()["mem_bytes"] == 2 * (16 + 3 + 9)
    assert [len(r["versions"]) for r in views.versions(df).collect()] == [1]


def test_ordinal_and_floor_against_plain_python(spark):
    rng = random.Random(2)
    keys = sorted({rng.randrange(1000) for _ in range(120)})
    probes = [rng.randrange(1000) for _ in range(200)]
    frame = lambda xs: spark.createDataFrame([(x.to_bytes(8, "big"),) for x in xs], "k binary")
    got = views.ordinal(frame(keys), "k").collect()
    assert sorted((r["n"], int.from_bytes(r["k"], "big")) for r in got) == list(enumerate(keys, 1))
    found = views.floor_lookup(frame(probes), frame(keys)).collect()
    assert len(found) == len(probes)
    for r in found:
        below = [k for k in keys if k <= int.from_bytes(r["k"], "big")]
        assert (None if r["floor"] is None else int.from_bytes(r["floor"], "big")) == (below[-1] if below else None)


def test_empty_log(spark):
    df = log(spark, [])
    assert views.latest(df).count() == views.versions(df).count() == views.pairs(df).count() == views.ordinal(views.latest(df), "k").count() == 0


def test_segment_and_block_cuts(spark):
    df = log(spark, [(i, i.to_bytes(8, "big"), i, b"12345678") for i in range(1, 26)])
    cuts = layout.segment_cuts(df, 40, 400).groupBy("segment").count().collect()
    assert sorted((r["segment"], r["count"]) for r in cuts) == [(0, 10), (1, 10), (2, 5)]
    blocks = layout.block_cuts(views.latest(df).withColumn("tab", F.lit(1)), "tab", 100).collect()
    assert sorted((r["block"], r["n_rows"], r["block_bytes"]) for r in blocks) == [(i, 3, 84) for i in range(8)] + [(8, 1, 28)]


def test_overlaps_and_holders_against_plain_python(spark):
    rng = random.Random(7)
    tables = [(i, *sorted(rng.randrange(256) for _ in range(2))) for i in range(40)] + [(40, 10, 10), (41, 10, 10), (42, 0, 255)]
    manifest = spark.createDataFrame([(t, bytes([b]), bytes([e])) for t, b, e in tables], "tab long, begin binary, end binary")
    expected = {(x[0], y[0]) for x in tables for y in tables if x[0] < y[0] and x[2] >= y[1] and x[1] <= y[2]}
    got = [tuple(r) for r in layout.overlaps(manifest).collect()]
    assert len(got) == len(expected) and set(got) == expected
    keys = spark.createDataFrame([(bytes([i]),) for i in range(0, 256, 3)], "k binary")
    assert {r["tab"]: r["n_inside"] for r in layout.holders(keys, manifest).collect()} == {t: sum(b <= i <= e for i in range(0, 256, 3)) for t, b, e in tables}
    assert layout.overlaps(manifest.limit(0)).count() == layout.holders(keys, manifest.limit(0)).count() == 0


def test_running_size_of_one_large_segment(spark):
    rows = [(i, bytes(i % 5), i, b"v" * (i % 7)) for i in range(300)]
    random.Random(4).shuffle(rows)
    df = log(spark, rows).withColumn("gen", F.when(F.col("seq") < 290, 0).otherwise(1)).withColumn("size", F.lit("clash")).withColumn("part", F.lit(0))
    total, expected = {0: 0, 1: 0}, {}
    for seq, k, _, v in sorted(rows):
        total[seq >= 290] += 16 + len(k) + 8 + len(v)
        expected[seq] = total[seq >= 290]
    got = layout.running_size(df.repartition(4), "gen")
    assert got.columns == [*df.columns, "mem_bytes"] and {r["seq"]: r["mem_bytes"] for r in got.collect()} == expected


def test_blocks_against_plain_python(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, i.to_bytes(4, "big"), 1, b"v" * rng.choice([0, 5, 40, 300])) for i in range(2500)]
    tab = F.when(F.col("seq") < 7, 2).otherwise(F.col("seq") % 2).cast("int")
    expected = []
    for t in range(3):
        block = None
        for i, k, _, v in rows:
            if (2 if i < 7 else i % 2) != t:
                continue
            size = 4 + 4 + 8 + len(v)
            if block is None or block[4] + size > 200:
                block = [t, 0 if block is None else block[1] + 1, k.hex().upper(), 0, 0]
                expected.append(block)
            block[3] += 1
            block[4] += size
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = layout.block_cuts(log(spark, rows).withColumn("tab", tab), "tab", 200).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(list, got)) == sorted(expected)


def test_helper_columns_never_clash(spark):
    df = spark.createDataFrame([(i.to_bytes(1, "big"), i, i, i, i, i) for i in range(9)], "k binary, part int, inside int, before int, kind int, top int")
    got = views.ordinal(df, "k")
    assert got.columns == [*df.columns, "n"] and all(r["n"] == r["part"] + 1 == r["inside"] + 1 for r in got.collect())
    found = views.floor_lookup(df, df.where("kind % 2 = 0"))
    assert found.columns == [*df.columns, "floor"] and all(r["floor"][0] == r["top"] // 2 * 2 for r in found.collect())


def test_streaming_table_is_compacted(spark, tmp_path):
    from keystrata.streaming.latest import compact_latest, read_latest

    table = str(tmp_path / "latest")
    for n, rows in enumerate([[(b"a", b"1"), (b"b", b"5")], [(b"a", b"3")], [(b"c", b"2"), (b"b", b"4")]]):
        spark.createDataFrame(rows, "k binary, rec binary").write.parquet(f"{table}/batch={n}")
    for _ in range(2):
        assert sorted((bytes(r["k"]), bytes(r["rec"])) for r in read_latest(spark, table).collect()) == [(b"a", b"3"), (b"b", b"5"), (b"c", b"2")]
        compact_latest(spark, table)
    assert len([p for p in (tmp_path / "latest").iterdir() if p.name.startswith("batch=")]) == 1


def test_load_program(spark, tmp_path):
    from keystrata.sources.generate import run_load
    from keystrata.store import Store

    store = Store(spark, str(tmp_path / "s"))
    told = list(run_load(store, 250, every=100, keys=50))
    assert [n for n, _ in told] == [100, 200, 250] and all(s > 0 for _, s in told)
    assert store.mem_size() == 250 * (16 + 8 + 16)
