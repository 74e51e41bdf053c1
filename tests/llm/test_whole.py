"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import math
import operator
import random

import numpy as np
import pytest

from catalens.llm import jaccard_join, topk
from catalens.llm.blocks import six_bytes
from catalens.llm.components import components
from catalens.llm.embedding_dedup import _labels
from catalens.llm.html_text import visible_text
from catalens.llm.topk import top_k


def linked(sets, percent):
    return np.array([[100 * len(a & b) >= percent * len(a | b) for b in sets] for a in sets])


def test_links_between_two_balls_of_a_round(spark):
    r = random.Random(1)
    names = r.sample(range(1, 10_000), 90)
    chains = [(0, 30), (1000, 30), (2000, 15), (3000, 15)]  # neighbours have J = 24 / 28, the next ones 22 / 30
    sets = [frozenset(range(at + 2 * i, at + 2 * i + 26)) for at, n in chains for i in range(n)]
    wanted = {}
    for k, name in zip(_labels(linked(sets, 85)), names):
        wanted.setdefault(k, []).append(name)
    assert sorted(map(len, wanted.values())) == [15, 15, 30, 30]
    regions = spark.createDataFrame([(1, p, 26) for p in names], "region long, point long, n long")
    blobs = [(p, bytearray(six_bytes(np.array(sorted(s), np.uint64)))) for p, s in zip(names, sets)]
    links = jaccard_join.joined_regions(regions, spark.createDataFrame(blobs, "point long, shingles binary"), 85)
    found = {}
    for point, component in components(links).collect():
        found.setdefault(component, []).append(point)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def best_rows(rows, every, k=5, scale=256):
    """As the registered SQL: every row of a query meets every row with another id."""
    use = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and None not in v]
    out = []
    for i in sorted({i for i, _ in use if i % every == 0}):
        asks = [v for j, v in use if j == i]
        met = [(-sum(map(operator.mul, v, w)), j) for v in asks for j, w in use if j != i and len(w) == len(v)]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(met)[:k])]
    return out


def test_top_k_keeps_large_components_and_repeated_rows(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-40, 40)) / 8 for _ in range(4)]) for i in range(200)]
    rows += [(200 + i, [float(r.randint(-5, 5)) * 70_000 + r.randint(0, 3) for _ in range(4)]) for i in range(60)]
    rows += [(300, [3e6, 2.5, -1.0, 0.0]), (301, [-(2.0**24), 1.0, 0.0, 0.0]), (302, [2.0**24, 2.0**23, 1.0, 1.0])]
    rows += [(303, [1e6 + i, 1.0, 1.0, 1.0]) for i in range(3)] + [rows[205]] * 3 + [rows[50]] * 2 + [rows[7]] * 7
    rows += [(100, [1.0, 0.5, 0.25, 0.0]), (350, [1.0]), (351, [90_000.0]), (None, rows[0][1]), (352, None), (400, rows[205][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, top_k(frame, 50, sample_rows=50, block_rows=16).collect()))
    assert found == best_rows(rows, 50)


def test_scores_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k(frame, 50).collect()


def test_bounds_hold_where_floats_round():
    r = np.random.default_rng(4)
    asks = np.floor(r.standard_normal((20, 33)) * 2.0 ** r.integers(1, 60, (20, 33)))
    exact = np.floor(r.standard_normal((30, 33)) * 2.0 ** r.integers(1, 60, (30, 33)))
    least, most = topk.bounds_of(asks, exact, exact)
    for i, a in enumerate(asks):
        for j, b in enumerate(exact):
            assert least[i, j] <= sum(int(x) * int(y) for x, y in zip(a, b)) <= most[i, j]
    huge = np.array([[1e300, -1e300, 1.0]])
    least, most = topk.bounds_of(huge, huge[:, [1, 0, 2]], huge[:, [1, 0, 2]])
    assert least[0, 0] == -np.inf and most[0, 0] > -np.inf


def test_html_shows_all_visible_text():
    svg = "<p>a</p><svg><title>t</title><style/><text x=1>Q<tspan>1</tspan></text><text><![CDATA[b > a]]></text>lost<desc>d</desc></svg><p>z"
    assert visible_text(svg) == "a\n\nQ1 b > a\n\nz"
    math = "<p>so <math><mi>x</mi> <mo>=</mo>\n<mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> holds"
    assert visible_text(math) == "so x= 1 2 holds"
    assert visible_text("<svg><text>in<div>out</div>, <desc>seen</desc>") == "in\nout\n, seen"
    form = "<p>Pick<select><option>One<option selected>Two<optgroup label=More><option label=Three>3</select>now"
    assert visible_text(form) == "Pick\nOne\nTwo\nMore\nThree\nnow"
    hidden = "<div style='visibility:hidden'>no<ul><li>no<b style='visibility: visible'>yes</b></ul><img alt=no></div>end"
    assert visible_text(hidden).split() == ["yes", "end"]
    row = "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>x</table>"
    assert visible_text(row).split() == ["x"]


def test_html_aligns_cells_of_tables_at_any_depth():
    inner = "<tr><td>long name<td>1<tr><td>b<td>22"
    for depth in (1, 7, 8, 40, 1500):
        page = "<table><tr><td>" * (depth - 1) + "<table>" + inner + "</table>" * depth + "end"
        assert visible_text(page) == "long name  1\nb          22\n\nend"
        page = "<table><tr><td>long name<td>1<tr><td>b<td>" + "<table><tr><td>" * depth + "22" + "</table>" * (depth + 1) + "end"
        assert visible_text(page) == "long name  1\nb          22\n\nend"


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(6)
    text = [" ".join(r.choice("abcdefghijkl") for _ in range(60)) for _ in range(6)]
    near = text[0] + " z"
    docs = [(1, text[0]), (1, text[0]), (1, text[1]), (3, near), (2, text[2]), (2, text[3]), (4, text[3]), (9, "")]
    docs += [(None, text[4]), (None, text[4] + " z"), (None, text[5]), (5, text[5]), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.distinct_documents(spark, frame, "").collect()
    assert len(found) == 8
    ids = {i: sorted((x or "") for j, x in map(tuple, found) if j == i) for i in (1, 2, 3, 4, 5, 9, None)}
    assert ids[1] == sorted(text[:2]) and ids[2] == sorted(text[2:4]) and ids[3] == ids[4] == []
    assert ids[5] == [text[5]] and ids[9] == [""] and ids[None][0] == "" and ids[None][1] in (text[4], text[4] + " z")
