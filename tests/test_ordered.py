"""Ordered plans against plain Python, over several blocks and with hot keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.plans import grouped, ordered


@pytest.fixture()
def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        out.append((i, key, rng.choice([1.0, 1.0, 1.0, 2.5, 4.0, 7.25]), rng.choice([None, i, i * 2])))
    rng.shuffle(out)
    return out


SPEC = "id long, key string, score double, payload long"


def test_global_rank_with_ties_and_hot_value(spark, many_blocks, rows):
    df = spark.createDataFrame(rows, SPEC).repartition(5)
    got = {r.id: r["rank"] for r in ordered.global_rank(df, [F.col("score").desc(), F.col("id")]).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    assert got == want


def test_range_blocks_really_split_a_hot_key(spark, many_blocks, rows):
    df = spark.createDataFrame(rows, SPEC).repartition(5)
    blocks = ordered.range_blocks(df, ["key", "id"])
    assert blocks.where("key = 'hot'").select(ordered.BLOCK).distinct().count() > 1


@pytest.mark.parametrize("prior", [False, True])
def test_running_values_per_hot_partition(spark, many_blocks, rows, prior):
    df = spark.createDataFrame(rows, SPEC).repartition(5)
    out = ordered.running(
        df, ["id"], partition=["key"], sums={"n": F.lit(1), "s": "score"}, maxima={"m": "payload"},
        last={"l": "payload"}, prior=prior,
    )
    got = {r.id: (r.n, r.s, r.m, r.l) for r in out.collect()}
    seen: dict[str, list] = {}
    for i, key, score, payload in sorted(rows):
        before = seen.setdefault(key, [])
        scope = before if prior else [*before, (score, payload)]
        known = [p for _, p in scope if p is not None]
        want = (len(scope), sum(s for s, _ in scope), max(known, default=None), known[-1] if known else None)
        assert got[i] == pytest.approx(want), (i, key)
        before.append((score, payload))


def test_running_without_partition(spark, many_blocks, rows):
    df = spark.createDataFrame(rows, SPEC).repartition(5)
    got = {r.id: r.n for r in ordered.running(df, [F.col("id").desc()], sums={"n": F.lit(1)}).collect()}
    assert got == {i: 600 - i for i in range(600)}


@pytest.mark.parametrize("small", [True, False])
def test_exact_percentiles_match_numpy(spark, many_blocks, rows, small):
    ordered.SMALL_ROWS = 10_000 if small else 0
    df = spark.createDataFrame(rows, SPEC)
    probabilities = [0.0, 0.1, 0.33, 0.5, 0.95, 1.0]
    for column, index in (("score", 2), ("payload", 3)):
        values = [r[index] for r in rows if r[index] is not None]
        got = ordered.percentile_values(df, column, probabilities)
        assert got == pytest.approx(list(np.percentile(values, [100 * p for p in probabilities])))


def test_percentiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "id int, v double")
    assert ordered.percentile_values(df, "v", [0.5]) == [None]


def test_first_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    top = grouped.first_per_group(df, ["k"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {r["_nth"] for r in top.collect()} == {1, 2}


def test_first_per_group_of_many_rows(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") % 10 == 9).cast("int"))
    top = grouped.first_per_group(df, ["k"], [F.col("id").desc()], 2000)
    assert len({r["_nth"] for r in top.where("k = 0").collect()}) == 2000 and top.where("k = 1").count() == 500
    assert top.where("k = 0 and _nth = 2000").first().id == 2777


def test_nested_parts_split_every_group_alike(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, "big").otherwise(F.nullif(F.concat(F.lit("g"), F.col("id") % 5), F.lit("g0"))).alias("k"), "id")
    for parts in (1, 6):
        found = grouped.nested_parts(df, ["k"], F.col("id"), F.col("id"), parts).collect()
        assert sorted(i for p in found for i in p["items"]) == list(range(900))
        assert {p.k: len([q for q in found if q.k == p.k]) for p in found} == dict.fromkeys(["big", "g1", "g2", "g3", "g4", None], parts)
        assert all(p["items"] == sorted(p["items"]) for p in found)
