from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from catalens.operators import annotations as an
from catalens.streaming import logs


def document(**tables):
    return json.dumps({"tables": {k: {"annotations": v} for k, v in tables.items()}})


def note(identity, content="text", kind="note", author="a"):
    return {"id": identity, "type": kind, "content": content, "author": author, "created_at": "2026-01-01T00:00:00Z"}


def test_merge_files_dedupes_and_skips_corrupt(spark, tmp_path):
    (tmp_path / "a.json").write_text(document(**{"Orders.dbo.Order": [note("1", "first"), note("2")]}))
    (tmp_path / "b.json").write_text(document(**{"Orders.dbo.Order": [note("1", "again")], "X.dbo.Y": [note("3"), note("2")]}))
    (tmp_path / "c.json").write_text('{"tables": {"Broken')
    merged = an.merge(an.read_documents(spark, str(tmp_path)))
    assert {r.id: (r.target, r.content) for r in merged.collect()} == {
        "1": ("Orders.dbo.Order", "first"), "2": ("Orders.dbo.Order", "text"), "3": ("X.dbo.Y", "text"),
    }
    assert an.for_target(merged, "X.dbo.Y").count() == 1
    assert an.for_target(merged, "unknown").count() == 0
    assert an.merge(an.read_documents(spark, str(tmp_path / "absent"))).count() == 0


@pytest.mark.parametrize(
    ("target", "kind", "content", "error"),
    [
        ("a.b.c", "note", "fine", None),
        ("a.b", "note", "x", "invalid target"),
        ("a.b.c.d", "note", "x", "invalid target"),
        (None, "note", "x", "invalid target"),
        ("a.b.c", "remark", "x", "invalid type"),
        ("a.b.c", None, "x", "invalid type"),
        ("a.b.c", "quality_flag", "TRUSTED", None),
        ("a.b.c", "quality_flag", "GOOD", "invalid quality flag"),
        ("a.b.c", "note", "x" * 10_000, None),
        ("a.b.c", "note", "x" * 10_001, "content too long"),
    ],
)
def test_validation(spark, target, kind, content, error):
    df = spark.createDataFrame([(target, kind, content)], "target string, type string, content string")
    assert an.validate(df).first().error == error


@pytest.mark.parametrize(
    ("name", "want"),
    [("user@domain.com", "user_domain_com"), ("a" * 100, "a" * 64), ("", "anonymous"), (None, "anonymous"), ("   ", "___"), ("Zoë-1_x", "Zoë-1_x")],
)
def test_sanitize(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(an.sanitize_author(F.col("n")).alias("n")).first().n == want


def test_append_gives_ids_and_drops_invalid(spark, tmp_path):
    new = spark.createDataFrame(
        [("a.b.c", "note", "x", "me@x"), ("a.b.c", "note", "x", "me@x"), ("bad", "note", "x", "me")],
        "target string, type string, content string, author string",
    )
    path = str(tmp_path / "notes")
    an.append(new, path)
    an.append(new, path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4 and len({r.id for r in rows}) == 4 and {r.author for r in rows} == {"me_x"}
    assert all(r.created_at.endswith("Z") for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    spec = "target string, id string, type string, content string, author string, at timestamp"
    rows = [("a.b.c", str(i % 5), "note", "x", "me", f"2026-01-01 00:0{i}:00") for i in range(8)] + [("bad", "9", "note", "x", "me", "2026-01-01 00:09:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, spec.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spec).parquet(source)
    unique = logs.unique_annotations(stream, at="at", delay="1 hour")
    logs.write_available(unique, str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = an.first_by_id(an.accepted(an.validate(spark.read.parquet(source))), ["at"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in batch.collect()) == ["0", "1", "2", "3", "4"]
    logs.write_available(logs.rejected_annotations(stream), str(tmp_path / "bad"), str(tmp_path / "cp2")).awaitTermination(120)
    assert [r.error for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["invalid target"]


def test_daily_stream_drops_late_rows(spark, tmp_path):
    spec = "name string, at timestamp, ms double"
    source = str(tmp_path / "in")

    def add(day, rows):
        df = spark.createDataFrame(rows, "name string, at string, ms double").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spec).parquet(source)
        daily = logs.daily_executions(stream, name="name", at="at", duration="ms", delay="1 day")
        logs.write_available(daily, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    add(1, [("a", "2026-01-01 10:00:00", 2.0), ("a", "2026-01-01 11:00:00", 4.0)])
    add(2, [("a", "2026-01-09 10:00:00", 1.0)])
    add(3, [("a", "2026-01-01 12:00:00", 99.0), ("a", "2026-01-20 00:00:00", 1.0)])
    rows = {str(r.day)[:10]: (r.execution_count, r.avg_duration) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["2026-01-01"] == (2, 3.0) and rows["2026-01-09"] == (1, 1.0)
