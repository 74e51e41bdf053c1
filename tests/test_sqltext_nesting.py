"""Expressions of any depth: expected rows are written by hand, no pattern is taken from the operators."""

from __future__ import annotations

import pytest

from catalens.operators import sqltext as st


def found(spark, kind, text):
    df = st.prepare(spark.createDataFrame([(1, text)], "id int, definition string"))
    return [tuple(r)[2:] for r in st.exploded(df, kind, ["id"]).orderBy("position").collect()]


def deep(inner: str, levels: int) -> str:
    for i in range(levels):
        inner = f"f{i}({inner}, (1))"
    return inner


@pytest.mark.parametrize("levels", [0, 1, 5, 20])
def test_aggregates_of_any_depth(spark, levels):
    text = f"SELECT SUM({deep('x', levels)}) AS total, 1 + MAX(z) AS more FROM t"
    assert found(spark, "aggregations", text) == [("SUM", deep("x", levels), "total", None), ("MAX", "z", "more", None)]


def test_aggregates_inside_each_other_and_behind_over(spark):
    text = "SELECT SUM(SUM(t.x)) OVER (PARTITION BY f(y), (z)) AS z, COUNT(DISTINCT a.b) OVER w AS n, AVG(q) FILTER (WHERE q > 1) m FROM t"
    assert found(spark, "aggregations", text) == [
        ("SUM", "SUM(t.x)", "z", None), ("SUM", "t.x", None, "t"), ("COUNT", "a.b", "n", "a"), ("AVG", "q", "m", None),
    ]


@pytest.mark.parametrize(
    ("item", "want"),
    [
        ("SUM(x)*100.0 / COUNT(*) AS pct", [("pct", "SUM(x)*100.0 / COUNT(*)", ["x"])]),
        ("(a.x + a.y) / a.z", [(None, "(a.x + a.y) / a.z", ["a.x", "a.y", "a.z"])]),
        ("a / b / c AS r", [(None, "a / b", ["a", "b"]), ("r", "a / b / c", ["a", "b", "c"])]),
        ("a / b * 100 AS r", [(None, "a / b", ["a", "b"])]),
        ("k + a / b AS r", [(None, "a / b", ["a", "b"])]),
        ("f(g(a / b), c) / 2 h", [("h", "f(g(a / b), c) / 2", ["a", "b", "c"]), (None, "a / b", ["a", "b"])]),
        ("a / -b AS r", [("r", "a / -b", ["a", "b"])]),
        ("CASE WHEN a > 1 THEN 1 ELSE b / c END / d AS r", [
            ("r", "CASE WHEN a > 1 THEN 1 ELSE b / c END / d", ["a", "b", "c", "d"]), (None, "b / c", ["b", "c"]),
        ]),
        ("SUM(x) OVER (PARTITION BY y) / @n AS r", [("r", "SUM(x) OVER (PARTITION BY y) / @n", None)]),
        ("SUM (x) / y AS r", [("r", "SUM (x) / y", ["x", "y"])]),
        ("CASE WHEN (a) / b > 1 THEN 2 END", [(None, "(a) / b", ["a", "b"])]),
        ("COUNT(*) AS n, SUM(i.x) / SUM(i.y) AS r", [("r", "SUM(i.x) / SUM(i.y)", ["i.x", "i.y"])]),
        ("'a/b' AS s, 4", []),
    ],
)
def test_divisions(spark, item, want):
    rows = found(spark, "ratio_metrics", f"SELECT TOP 5 {item} FROM t -- 1 / 2\n WHERE u = 3")
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    for row, (_, _, columns) in zip(rows, want):
        assert columns is None or row[2] == columns


def test_divisions_of_any_depth(spark):
    text = f"SELECT {deep('a / b', 20)} / ({deep('c', 20)}) AS r FROM t"
    rows = found(spark, "ratio_metrics", text)
    assert [r[0] for r in rows] == ["r", None] and rows[1][1] == "a / b"
    assert rows[0][1] == text[len("SELECT ") : -len(" AS r FROM t")]


def test_cases_of_any_depth(spark):
    inner, want = "SUM(x)", []
    for i in range(20):
        inner = f"CASE WHEN NOT k = {i} THEN {inner} ELSE 0 END"
        want.insert(0, inner)
    rows = found(spark, "case_metrics", f"BEGIN SELECT {inner} AS v FROM t END")
    assert [r[1] for r in rows] == [x[:500] for x in want]  # formulas are cut at 500
    assert [r[0] for r in rows] == ["v"] + [None] * 19
    many = found(spark, "metrics", "SELECT " + "(" * 30 + "a / b" + ")" * 30 + " AS v FROM t")
    assert [r[:2] for r in many] == [(None, "a / b")]


def test_comma_joins(spark):
    rows = found(spark, "joins", "SELECT 1 FROM dbo.a x, [b] AS y , c JOIN d ON c.i = d.i WHERE x.k = y.k")
    assert [(r[0], r[1], r[2], len(r[3])) for r in rows] == [
        ("dbo.a", "b", "INNER", 0), ("dbo.a", "c", "INNER", 0), ("dbo.a", "d", "INNER", 1),
    ]
    assert found(spark, "joins", "SELECT a, b FROM t ORDER BY a, b") == []


def test_open_brackets_and_nulls(spark):
    assert found(spark, "aggregations", "SELECT SUM(x FROM t") == []
    assert found(spark, "metrics", None) == [] and found(spark, "aggregations", "") == []
    assert [r[1] for r in found(spark, "aggregations", "x) SELECT SUM(f(y))")] == ["f(y)"]
