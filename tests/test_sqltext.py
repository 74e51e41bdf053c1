from __future__ import annotations

import pytest

from catalens.operators import sqltext as st


def found(spark, kind, text):
    df = st.prepare(spark.createDataFrame([(1, text)], "id int, definition string"))
    return [tuple(r)[2:] for r in st.exploded(df, kind, ["id"]).orderBy("position").collect()]


def test_joins(spark):
    text = """SELECT * FROM dbo.Orders o -- it's FROM x JOIN y
      INNER JOIN dbo.Customer c ON o.A = c.A AND o.B=c.B left outer join [dbo].[Line Item] t ON t.X = o.X
      CROSS JOIN r JOIN (SELECT 1) d WHERE 'JOIN z' = o.k"""
    rows = found(spark, "joins", text)
    assert [r[:3] for r in rows] == [
        ("dbo.Orders", "dbo.Customer", "INNER"), ("dbo.Orders", "dbo.Line Item", "LEFT"), ("dbo.Orders", "r", "CROSS"),
    ]
    assert [tuple(p) for p in rows[0][3]] == [("o.A", "c.A"), ("o.B", "c.B")]
    assert found(spark, "joins", "SELECT 1 FROM (SELECT 2) q JOIN b ON 1 = 1")[0][:2] == ("UNKNOWN", "b")


def test_aggregations(spark):
    text = "SELECT COUNT(*) AS n, sum( i.Amount ), AVG(ISNULL(x, 0)) AS a, MAX(DISTINCT y) AS [top] FROM t"
    assert found(spark, "aggregations", text) == [
        ("COUNT", "*", "n", None), ("SUM", "i.Amount", None, "i"), ("AVG", "ISNULL(x, 0)", "a", None), ("MAX", "y", "top", None),
    ]


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("a.x = 5", ("a.x", "=", "5")),
        ("[a].[x] <> 'b'", ("a.x", "!=", "b")),
        ("x >= @p", ("x", ">=", "@p")),
        ("x < -2.5", ("x", "<", "-2.5")),
        ("x = ?", ("x", "=", "?")),
        ("x = NULL", ("x", "=", "NULL")),
        ("x = (SELECT MAX(y) FROM z)", ("x", "=", "(subquery)")),
        ("x LIKE 'A AND B%'", ("x", "LIKE", "A AND B%")),
        ("x NOT LIKE '%'", ("x", "NOT LIKE", "%")),
        ("x IN (1, 2)", ("x", "IN", "(1, 2)")),
        ("x NOT IN ('a','b','c','d','e','f')", ("x", "NOT IN", "(a, b, c, d, e, ...)")),
        ("x IN (SELECT y FROM z)", ("x", "IN", "(subquery)")),
        ("x BETWEEN @a AND 'z'", ("x", "BETWEEN", "@a AND z")),
        ("x NOT BETWEEN 1 AND 2", ("x", "NOT BETWEEN", "1 AND 2")),
        ("x IS NULL", ("x", "IS NULL", "NULL")),
        ("x IS NOT NULL", ("x", "IS NOT NULL", "NULL")),
        ("NOT x = 1", ("x", "NOT =", "1")),
        ("((x = 'O''Neil'))", ("x", "=", "O'Neil")),
        ("x = '" + "q" * 80 + "'", ("x", "=", "q" * 50)),
    ],
)
def test_filters(spark, condition, want):
    assert found(spark, "filters", f"SELECT 1 FROM t WHERE {condition} GROUP BY g")[0] == want


def test_filters_walk_and_or_and_stop_at_clause_end(spark):
    rows = found(spark, "filters", "SELECT 1 FROM t WHERE a = 1 AND (b = 2 OR c > 'x WHERE y = 1') ORDER BY d; SELECT 1 FROM u WHERE e = 3")
    assert [r[0] for r in rows] == ["a", "b", "c", "e"]


def test_metrics(spark):
    text = "SELECT SUM(a.x) / NULLIF(SUM(a.y), 0) AS rate, CASE WHEN COUNT(q.id) > 0 THEN 'END' ELSE 'b' END AS has, CASE WHEN z = 1 THEN 2 END FROM t"
    rows = found(spark, "metrics", text)
    assert rows[0] == ("rate", "SUM(a.x) / NULLIF(SUM(a.y), 0)", ["a.x", "a.y"], True)
    assert rows[1] == ("has", "CASE WHEN COUNT(q.id) > 0 THEN 'END' ELSE 'b' END", ["q.id"], False)
    assert len(rows) == 2


def test_long_texts_and_comments_are_read_whole(spark):
    filler = "/* " + "x * y\n" * 20_000 + " */" + "SELECT 'a' ; " * 5_000
    rows = found(spark, "filters", f"{filler} SELECT 1 FROM t WHERE last_one = 7")
    assert rows == [("last_one", "=", "7")]


def test_references_and_errors(spark):
    df = spark.createDataFrame(
        [(1, "UPDATE dbo.T SET x = 1 FROM dbo.T t JOIN s.U u ON t.a = u.b"), (2, "  "), (3, None), (4, "SELECT 'open")],
        "id int, definition string",
    )
    row = st.prepare(df).where("id = 1").select(st.tables_referenced().alias("t"), st.columns_referenced().alias("c")).first()
    assert row.t == ["dbo.T", "s.U"] and row.c == ["t.a", "u.b"]
    errors = {r.id: r.error for r in st.parse_errors(df, ["id"]).collect()}
    assert errors == {2: "Empty SQL", 3: "Empty SQL", 4: "Unbalanced quotes"}
    assert st.pattern_totals(st.prepare(df)).first().joins == 1


def test_tables_named_like_clauses(spark):
    text = "SELECT 1 FROM dbo.[Order] JOIN Customer c ON Order.CustomerID = c.CustomerID WHERE Order.Status = 'CNCL' AND c.Region = 3 GROUP BY x"
    pairs = found(spark, "joins", text)[0][3]
    assert [tuple(p) for p in pairs] == [("Order.CustomerID", "c.CustomerID")]
    assert len(found(spark, "filters", text)) == 2


def test_nested_arguments(spark):
    text = "SELECT SUM(ISNULL(CAST(x AS DECIMAL(10,2)),0)) AS total FROM t"
    assert found(spark, "aggregations", text) == [("SUM", "ISNULL(CAST(x AS DECIMAL(10,2)),0)", "total", None)]


def test_aliases_without_as(spark):
    text = "SELECT SUM(x) total, a.b / c.d share, COUNT(*) FROM t GROUP BY y HAVING MAX(z) > 1 ORDER BY MIN(q) DESC"
    assert [(r[0], r[2]) for r in found(spark, "aggregations", text)] == [
        ("SUM", "total"), ("COUNT", None), ("MAX", None), ("MIN", None),
    ]
    assert found(spark, "ratio_metrics", text)[0][0] == "share"


def test_case_inside_case(spark):
    text = "SELECT CASE WHEN CASE WHEN a = 1 THEN 2 ELSE 3 END = 2 THEN SUM(b) ELSE CASE WHEN c = 1 THEN AVG(d) END END nested FROM t"
    rows = found(spark, "case_metrics", text)
    whole = text[len("SELECT ") : -len(" nested FROM t")]
    assert [(r[0], r[1]) for r in rows] == [("nested", whole), (None, "CASE WHEN c = 1 THEN AVG(d) END")]


def test_long_case_does_not_overflow(spark):
    text = "SELECT CASE " + "WHEN a = 1 THEN SUM(b) " * 20_000 + "END AS long_one FROM t"
    assert found(spark, "case_metrics", text)[0][0] == "long_one"
