import pytest
from comparing import same_rows

from keystrata import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", list(core.queries()))
def test_query_equals_sql(spark, oracle, name):
    folder, con = oracle
    same_rows(core.queries()[name](spark, folder), con.sql(SQL[name]).df())


def test_entry_imports_and_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_lookup_is_pushed_to_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from keystrata.operators import views

    spark.range(100).selectExpr("unhex(lpad(hex(id), 16, '0')) AS k", "id AS t", "unhex('61') AS v").write.parquet(str(tmp_path / "t"))
    plan = views.get(spark.read.parquet(str(tmp_path / "t")), F.lit(bytes(7) + b"\x05"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k" in plan


def test_registered_lookups_are_pushed_to_the_scan(spark, oracle):
    for name in ("point_get", "get_versions", "scan_range"):
        plan = core.queries()[name](spark, oracle[0])._jdf.queryExecution().toString()
        pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
        assert "(user_id," in pushed.split("PushedFilters")[1], name


def test_every_event_is_in_a_dealt_table(spark, oracle):
    folder, con = oracle
    n = con.sql("SELECT count(*) FROM events").fetchall()[0][0]
    for parts in (3, 8):
        dealt = core.dealt(core.fine_log(spark, folder), parts)
        assert dealt.count() == n and 0 <= dealt.selectExpr("min(tab)").first()[0] <= dealt.selectExpr("max(tab)").first()[0] < parts


@pytest.mark.parametrize("history", [False, True])
def test_filling_takes_few_merges(spark, monkeypatch, history):
    """Four portions of nine tables each: at most a merge or two for each level and flush."""
    from keystrata.store import Store

    calls, merge = [], Store._merge
    monkeypatch.setattr(Store, "_merge", lambda self, tables, limit: (calls.append(len(tables)), merge(self, tables, limit))[1])
    log = spark.range(48_000).selectExpr("id % 4 AS gen", "unhex(lpad(hex(floor(id / 4)), 16, '0')) AS k", "id AS t", "encode(cast(id AS string), 'UTF-8') AS v")
    store = core._filled(spark, None, log, history=history)
    assert len(store.levels.live()) > 1 and 0 < len(calls) <= 6
    assert store.latest().count() == 12_000
    if history:
        store.compact()
        assert not any(store.levels.overflows(i) for i in range(len(store.levels.runs)))
        assert store.versions().selectExpr("sum(size(versions)) AS n").first()["n"] == 48_000
