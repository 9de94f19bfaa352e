import pytest
from pyspark.sql import functions as F

from keystrata.plans.levels import Levels, Limits, TableInfo
from keystrata.store import Store


def puts(spark, rows):
    return spark.createDataFrame(rows, "k binary, t long, v binary")


def contents(store):
    return {bytes(r["k"]): (r["t"], bytes(r["v"])) for r in store.latest().collect()}


def test_flush_timing_never_changes_latest(spark, tmp_path):
    rows = [(bytes([i % 7]), t, bytes([t, i])) for i, t in enumerate([5, 1, 9, 2, 9, 3, 8] * 3)]
    expected = {}
    for k, t, v in rows:
        expected[k] = max(expected.get(k, (-1, b"")), (t, v))
    store = Store(spark, str(tmp_path / "s"), Limits(base_tables=2, level_tables=2, table_bytes=100))
    for i in range(0, len(rows), 4):
        store.put(puts(spark, rows[i : i + 4]))
        if i % 8 == 0:
            store.flush()
        assert contents(store).items() >= {}.items()
    assert contents(store) == expected
    store.close()
    assert store.mem_size() == 0
    again = Store(spark, str(tmp_path / "s"), store.limits)
    assert contents(again) == expected
    for run in again.levels.runs:
        assert all(a.end < b.begin for a, b in zip(run, run[1:]))
    again.compact()
    again.vacuum()
    assert contents(Store(spark, str(tmp_path / "s"))) == expected
    k = rows[0][0]
    assert [(r["t"], bytes(r["v"])) for r in again.get(k).collect()] == [expected[k]]
    assert [bytes(r["k"]) for r in again.scan(F.lit(bytes([2])), F.lit(bytes([4]))).collect()] == [bytes([i]) for i in (2, 3, 4)]
    assert {bytes(r["k"]) for r in again.multi_get(puts(spark, [(bytes([1]), 0, b""), (b"none", 0, b"")])).collect()} == {bytes([1])}


def test_versions_before_flush_one_after(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(puts(spark, [(b"k", 1, b"a"), (b"k", 2, b"b"), (b"k", 2, b"b")]))
    assert [(r["t"], bytes(r["v"])) for r in store.get(b"k").collect()] == [(1, b"a"), (2, b"b")]
    assert store.mem_size() == 3 * (16 + 1 + 9)
    store.flush()
    store.flush()
    assert [(r["t"], bytes(r["v"])) for r in store.get(b"k").collect()] == [(2, b"b")]


def test_limit_flushes_and_long_values_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), segment_bytes=1000)
    store.put(puts(spark, [(b"k", 1, b"v" * 65_536)]))
    assert store.segments == [] and len(store.levels.live()) == 1
    assert contents(store) == {b"k": (1, b"v" * 65_536)}


def test_empty_store_round_trips(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.close()
    store.put(puts(spark, []))
    store.flush()
    again = Store(spark, str(tmp_path / "s"))
    assert contents(again) == {} and again.get(b"x").count() == 0


def test_second_writer_is_refused(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.put(puts(spark, [(b"k", 1, b"a")]))
    with pytest.raises(RuntimeError):
        b.put(puts(spark, [(b"k", 1, b"b")]))


def test_refused_writers_harm_nothing(spark, tmp_path):
    a, b, c = (Store(spark, str(tmp_path / "s")) for _ in range(3))
    a.put(puts(spark, [(b"k", 1, b"first")]))
    for late in (b, c):
        with pytest.raises(RuntimeError):
            late.put(puts(spark, [(b"z", 1, b"second")]))
        assert contents(late) == contents(Store(spark, a.path)) == {b"k": (1, b"first")}
    assert len(list((tmp_path / "s/segments").iterdir())) == 1
    b.put(puts(spark, [(b"z", 2, b"again")]))  # restored by its refusal
    with pytest.raises(RuntimeError):
        a.flush()
    c.restore()
    c.flush()
    assert contents(Store(spark, a.path)) == {b"k": (1, b"first"), b"z": (2, b"again")}
    assert len(list((tmp_path / "s/tables").iterdir())) == 1


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    from keystrata import store as module

    store = Store(spark, str(tmp_path / "s"))
    store.put(puts(spark, [(b"k", 1, b"a")]))
    with monkeypatch.context() as m:
        m.setattr(module, "commit_text", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        for change in (store.flush, lambda: store.put(puts(spark, [(b"k", 9, b"never")]))):
            with pytest.raises(OSError):
                change()
    assert contents(Store(spark, store.path)) == contents(store) == {b"k": (1, b"a")}
    store.flush()
    assert contents(Store(spark, store.path)) == {b"k": (1, b"a")}


def test_commit_never_replaces(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from keystrata.sources.shared import commit_text, read_text

    path = str(tmp_path / "m/1.json")
    (tmp_path / "m").mkdir()
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: commit_text(spark, path, str(i)), range(8)))
    assert won.count(True) == 1 and read_text(spark, path) == str(won.index(True))
    assert len(list((tmp_path / "m").glob("*.json"))) == 1 and not list((tmp_path / "m").glob("*.tmp"))


def test_history_never_depends_on_flushes(spark, tmp_path):
    rows = [(bytes([i % 3]), t, bytes([t, i % 2])) for i, t in enumerate([5, 1, 9, 2, 9, 3, 8, 5] * 2)]
    expected = {}
    for k, t, v in rows:
        expected.setdefault(k, set()).add(t.to_bytes(8, "big") + v)
    expected = {k: sorted(x) for k, x in expected.items()}
    shown = lambda s: {bytes(r["k"]): [bytes(x) for x in r["versions"]] for r in s.versions().collect()}
    store = Store(spark, str(tmp_path / "s"), Limits(base_tables=2, level_tables=2, table_bytes=150), history=True)
    for i in range(0, len(rows), 3):
        store.put(puts(spark, rows[i : i + 3]))
        if i % 6 == 0:
            store.flush()
    assert shown(store) == expected
    store.flush()
    assert shown(store) == expected
    store.compact()
    assert shown(Store(spark, store.path, store.limits, history=True)) == expected
    assert contents(store) == {k: (int.from_bytes(x[-1][:8], "big"), x[-1][8:]) for k, x in expected.items()}
    with pytest.raises(ValueError):
        Store(spark, store.path)


def test_flush_is_split_by_size_and_reads_are_pruned(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Limits(base_tables=99, table_bytes=4000))
    rows = [(i.to_bytes(2, "big"), i, b"x" * 30) for i in range(1000)]
    store.put(puts(spark, rows))
    store.flush()
    tables = store.levels.live()
    assert len(tables) >= 11 and max(t.n_bytes for t in tables) < 3 * 4000
    assert [t.begin for t in tables] == sorted(t.begin for t in tables)
    assert all(a.end < b.begin for a, b in zip(tables, tables[1:]))
    assert contents(store) == {k: (t, v) for k, t, v in rows}
    files = lambda df: len(df.inputFiles())
    assert files(store.get(rows[500][0])) == 1
    assert files(store.multi_get(puts(spark, rows[500:502]))) <= 2
    scanned = store.scan(rows[100][0], rows[140][0])
    assert files(scanned) < 5 and [bytes(r["k"]) for r in scanned.collect()] == [k for k, _, _ in rows[100:141]]
    assert store.multi_get(puts(spark, [])).count() == 0


def test_tables_have_bloom_filters_of_their_size(spark, tmp_path):
    sizes = []
    for n in (100, 10_000):
        store = Store(spark, str(tmp_path / f"s{n}"))
        # random keys: runs of like ones would be stored in a dictionary, which makes a filter needless
        from keystrata.sources.generate import random_puts

        store.put(random_puts(spark, n, seed=3))
        store.flush()
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{store.path}/{store.levels.live()[0].path}")
        parquet = jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, spark.sparkContext._jsc.hadoopConfiguration()))
        sizes.append(reader.getFooter().getBlocks().get(0).getColumns().get(0).getBloomFilterLength())
        reader.close()
    assert 0 < sizes[0] < sizes[1]


def test_vacuum_keeps_what_readers_may_use(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(3):
        store.put(puts(spark, [(b"k", i, b"a")]))
        store.flush()
    old = store.latest()
    store.compact()
    store.vacuum(keep=2)
    assert old.count() == 1
    store.vacuum(grace=3600)
    assert old.count() == 1
    store.vacuum()
    assert contents(Store(spark, store.path)) == {b"k": (2, b"a")}
    assert len(list((tmp_path / "s/tables").iterdir())) == 1 and not list((tmp_path / "s/segments").iterdir())


def test_logs_are_replayed_into_a_store(spark, tmp_path):
    from keystrata.sources.log import frame, register
    from keystrata.store import recover

    register(spark)
    for name, keys in (("a", b"xy"), ("b", b"yz")):
        (tmp_path / f"{name}.log").write_bytes(b"".join(frame(bytes([k]), (5).to_bytes(8, "big") + name.encode()) for k in keys) + frame(b"q", b"torn")[:-2])
    logs = [spark.read.format("kvlog").load(str(tmp_path / f"{n}.log")).select("k", "rec") for n in "ab"]
    assert recover(logs).count() == 4
    store = Store(spark, str(tmp_path / "s"))
    store.replay(recover(logs))
    store.flush()
    assert contents(Store(spark, store.path)) == {b"x": (5, b"a"), b"y": (5, b"b"), b"z": (5, b"b")}


def test_what_no_manifest_lists_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(puts(spark, [(b"k", 1, b"a")]))
    puts(spark, [(b"z", 1, b"a")]).write.parquet(str(tmp_path / "s/tables/00000009"))
    assert contents(Store(spark, str(tmp_path / "s"))) == {b"k": (1, b"a")}


def info(begin, end, path="t"):
    return TableInfo(path, begin, end, 1, 1)


def merge(tables, limit):
    return [TableInfo("m", min(t.begin for t in tables), max(t.end for t in tables), sum(t.n_rows for t in tables), sum(t.n_bytes for t in tables))]


def test_levels_push_and_overlap():
    levels = Levels(runs=[[info("10", "20"), info("30", "40")]])
    assert not levels.push(0, info("15", "16")) and not levels.push(0, info("20", "25")) and not levels.push(0, info("05", "50"))
    assert levels.push(0, info("21", "29"))
    assert [t.begin for t in levels.runs[0]] == ["10", "21", "30"]
    assert [t.begin for t in levels.candidates("35")] == ["30"]


def test_levels_cascade():
    limits = Limits(base_tables=5, level_tables=2, factor=2)
    levels, rows = Levels(limits=limits), 0
    for i in range(40):
        levels.add(info(f"{i:02d}", f"{i:02d}", f"t{i}"), merge)
        rows += 1
        assert len(levels.base) < 5
        assert all(not levels.overflows(n) for n in range(len(levels.runs) - 1))
        assert sum(t.n_rows for t in levels.live()) == rows
        for run in levels.runs:
            assert all(a.end < b.begin for a, b in zip(run, run[1:]))
    assert len(levels.runs) > 2


def test_many_tables_go_down_together():
    """A flush of many tables takes a merge or a few for each level, not for each table; nothing is lost, and each level keeps its limit."""
    limits, calls = Limits(base_tables=2, level_tables=1, table_bytes=1, factor=10), []

    def cut(tables, limit):
        calls.append(len(tables))
        first, last = min(t.begin for t in tables), max(t.end for t in tables)
        parts = max(1, sum(t.n_bytes for t in tables) // limit)
        ends = [int(first) + (int(last) - int(first) + 1) * i // parts for i in range(parts + 1)]
        return [TableInfo(f"m{len(calls)}", f"{a:05d}", f"{b - 1:05d}", 1, limit) for a, b in zip(ends, ends[1:])]

    levels = Levels(limits=limits)
    for n in range(3):
        levels.add([TableInfo(f"{n}-{i}", f"{10 * i:05d}", f"{10 * i + 9:05d}", 1, 1) for i in range(500)], cut)
        assert len(levels.base) < limits.base_tables and not any(levels.overflows(i) for i in range(len(levels.runs)))
        for run in levels.runs:
            assert all(a.end < b.begin for a, b in zip(run, run[1:]))
        covered = sorted((t.begin, t.end) for t in levels.live())
        assert covered[0][0] == "00000" and max(e for _, e in covered) == "04999"
    assert 0 < len(calls) <= 12 and max(calls) >= 100


def test_merges_leave_far_tables_alone():
    levels, calls = Levels(runs=[[TableInfo("a", "10", "20", 1, 1), TableInfo("big", "30", "40", 1, 1000), TableInfo("z", "50", "60", 1, 1)]]), []
    levels.merge_into(0, [info("15", "16"), info("55", "57"), info("70", "80")], lambda x, limit: calls.append(sorted(t.path for t in x)) or merge(x, limit))
    assert calls == [["a", "t"], ["t", "z"]]
    assert [(t.begin, t.end) for t in levels.runs[0]] == [("10", "20"), ("30", "40"), ("50", "60"), ("70", "80")]


def test_tables_are_as_many_as_what_is_kept_needs(spark, tmp_path):
    """10,000 puts of 10 keys make one small table, and a compaction goes to the level that holds it."""
    store = Store(spark, str(tmp_path / "s"), Limits(base_tables=2, level_tables=1, table_bytes=1000))
    rows = spark.range(10_000).selectExpr("unhex(lpad(hex(id % 10), 4, '0')) AS k", "id AS t", "unhex('61') AS v")
    store.put(rows)
    store.flush()
    assert len(store.levels.live()) == 1
    kept = Store(spark, str(tmp_path / "h"), Limits(base_tables=2, level_tables=1, table_bytes=1000, factor=2), history=True)
    kept.put(rows.selectExpr("unhex(lpad(hex(t % 1000), 4, '0')) AS k", "t", "v"))
    kept.compact()
    assert not any(kept.levels.overflows(i) for i in range(len(kept.levels.runs)))
    assert kept.versions().selectExpr("sum(size(versions)) AS n").first()["n"] == 10_000


def test_levels_merge_overlapping():
    levels = Levels(runs=[[info("10", "20"), info("30", "40"), info("50", "60")]])
    levels.merge_into(0, info("15", "35"), merge)
    assert [(t.begin, t.end, t.n_rows) for t in levels.runs[0]] == [("10", "40", 3), ("50", "60", 1)]


def test_random_load(spark, tmp_path):
    from keystrata.sources.generate import random_puts

    load = random_puts(spark, 3000, seed=5, keys=200)
    rows = [(bytes(r["k"]), r["t"], bytes(r["v"])) for r in load.collect()]
    assert all(len(k) == len(v) == 8 and 0 <= t < 1024 for k, t, v in rows) and len({k for k, _, _ in rows}) <= 200
    assert rows == [(bytes(r["k"]), r["t"], bytes(r["v"])) for r in random_puts(spark, 3000, seed=5, keys=200).collect()]
    store = Store(spark, str(tmp_path / "s"), segment_bytes=40 * 1000)
    for i in range(3):
        store.put(load.where(F.col("seq") % 3 == i))
    assert store.mem_size() == 0 and len(store.levels.base) == 3
    assert contents(store) == {k: max((t, v) for x, t, v in rows if x == k) for k in {r[0] for r in rows}}
