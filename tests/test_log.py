import io

import pytest

from keystrata.functions.codec import decode_time
from keystrata.sources.log import frame, frames, register


def test_log_source(spark, tmp_path):
    register(spark)
    rows = [(b"k%d" % i, i.to_bytes(8, "big") + b"v" * i) for i in range(50)]
    (tmp_path / "a.log").write_bytes(b"".join(frame(*r) for r in rows[:30]))
    (tmp_path / "b.log").write_bytes(b"".join(frame(*r) for r in rows[30:]) + frame(b"torn", b"x" * 20)[:-5])
    df = spark.read.format("kvlog").load(f"{tmp_path}/*.log")
    assert sorted((bytes(r["k"]), bytes(r["rec"])) for r in df.collect()) == sorted(rows)
    assert sorted(r["t"] for r in df.select(decode_time("rec").alias("t")).collect()) == list(range(50))


def test_frames_cross_pieces(monkeypatch):
    monkeypatch.setattr("keystrata.sources.log.PIECE", 7)
    rows = [(b"", b""), (b"a" * 30, b"b" * 3), (b"k", b"")]
    data = b"".join(frame(*r) for r in rows)
    for cut in range(len(data) + 1):
        got = list(frames(io.BytesIO(data[:cut])))
        assert got == rows[: len(got)]
    assert got == rows


def test_negative_length_is_an_error():
    with pytest.raises(ValueError):
        list(frames(io.BytesIO(b"\xff" * 40)))
