"""Regions of the Jaccard join: shared passages that make no link join nothing, and no text is shuffled."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalens.llm import jaccard_join
from catalens.llm.common import among
from catalens.llm.embedding_dedup import _labels


def shingles(text, words):
    parts = text.split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def corpus(seed=5):
    """Clusters of near copies, some larger than small regions, all with passages that many other texts have too."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(18)] for _ in range(6)]
    texts = []
    for size in (30, 25, 1, 1, 3, 2, 40, 1) + (1,) * 60:
        base = [word() for _ in range(r.randint(60, 120))]
        for passage in r.sample(passages, 2):
            at = r.randrange(len(base))
            base[at:at] = passage
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[r.randrange(6) :]))
    r.shuffle(texts)
    return texts


def regions_of(spark, texts, words, percent):
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    rows = jaccard_join.sketches(docs, words, percent, np.zeros(0, np.uint64))
    met = jaccard_join.shared_regions(rows.select(F.col("key").alias("point"), "n", "first"), percent, 3, 4)
    return jaccard_join.possible_regions(met, percent)


def test_passages_make_no_regions(spark):
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [" ".join([passage, *(f"w{r.randrange(10**9)}" for _ in range(150))]) for _ in range(40)]
    assert regions_of(spark, texts, 4, 85).count() == 0


@pytest.mark.parametrize("widest", [10_000, 8])
def test_every_link_lies_in_a_region(spark, monkeypatch, widest):
    keep = jaccard_join.refined
    monkeypatch.setattr(jaccard_join, "refined", lambda a, b, p, _: keep(a, b, p, widest, 500))
    texts = corpus()
    sets = [shingles(x, 4) for x in texts]
    members = {}
    for region, point, n in regions_of(spark, texts, 4, 85).collect():
        assert n == len(sets[point])
        members.setdefault(region, set()).add(point)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 200
    for pair in links:
        if sets[pair[0]] != sets[pair[1]]:
            assert any(set(pair) <= m for m in members.values())


def test_components_with_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 10)  # ids of needed texts go as bits
    texts = corpus(9)
    sets = [shingles(x, 4) for x in texts]
    wanted = _labels(np.array([[100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]))
    least = {}
    for i, k in enumerate(wanted):
        least.setdefault(k, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs, paired=4).collect()
    assert sorted((i, c) for i, _, c in found) == [(i, least[k]) for i, k in enumerate(wanted)]


def test_rows_among_numbers(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (1 << 33) - 1, 1 << 33, (5 << 33) + 100_000]
    kept = numbers[1::2]
    rows = spark.createDataFrame([(i, str(i)) for i in numbers], "row long, text string")
    some = spark.createDataFrame([(i,) for i in [*kept, 3, 9, 40_000, kept[0]]], "n long")
    assert sorted(x.row for x in among(rows, F.col("row"), F.col("n"), some).collect()) == kept


def test_distinct_documents_move_no_text(spark):
    rows = [(i, f"alpha beta gamma delta epsilon zeta {'eta' if i % 2 else 'theta'} iota kappa lamda mu {i % 4}") for i in range(9)]
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.distinct_documents(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "text" in plan and not any("Exchange" in x and "text" in x for x in plan.splitlines())
        assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
        assert sorted((x.doc_id for x in out.collect())) == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
