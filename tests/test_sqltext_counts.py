"""Counts of patterns: as many as the arrays have entries, without making them, and masking that skips what is not there."""

from __future__ import annotations

import re
import random

from pyspark.sql import functions as F

from catalens.operators import sqltext as st

TEXTS = [
    None, "", "  ", "SELECT 1", "select count(*) from t",
    "SELECT a,\tSUM (b) / 2 AS x FROM [dbo].[T] t, u JOIN v ON t.a = v.a WHERE a IN ('SUM(x)', 'it''s') -- JOIN w",
    "SELECT SUM\x01(b), \x02COUNT(DISTINCT c) FROM a\x01b JOIN c WHERE x = 1",
    "SELECT CASE WHEN SUM(a) > 1 THEN MAX(b) / COUNT(c) * 2 / 3 ELSE CASE WHEN x = 1 THEN 2 END END AS y FROM t INNER JOIN",
    "SELECT CASE WHEN a > 1 THEN 1 END [SUM(], case when avg(b)=1 then 2 end FROM \"[]\" JOIN \"[]\" ON a = b",
    "/* CASE WHEN SUM(a) */ SELECT a/b/c%d FROM x CROSS JOIN y LEFT OUTER JOIN (SELECT MIN(q) FROM z WHERE q NOT IN (SELECT 1)) k",
    "BEGIN SELECT (SUM(a) / (b + MAX(c))) / d END; SELECT 'open WHERE a = 1", "UPDATE t SET a = b/2 WHERE a LIKE 'x%' AND b IS NOT NULL",
    "SELECT a FROM t;SELECT b FROM u, (SELECT 1) v WHERE a BETWEEN 1 AND 2 GROUP BY a HAVING SUM(b) > 1",
]


def some_texts():
    r = random.Random(4)
    words = [w for t in TEXTS if t for w in re.findall(r"\w+|[^\w\s]|\s+", t)]
    return TEXTS + ["".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randint(1, 60))) for _ in range(100)]


def test_counts_are_sizes_of_arrays(spark):
    rows = st.prepare(spark.createDataFrame(list(enumerate(some_texts())), "id int, definition string"))
    sizes = [F.size(make()).alias(k) for k, make in st.KINDS.items()]
    wanted = sorted(map(tuple, rows.select("id", F.size(st.tables_referenced()).alias("tables"), *sizes).collect()))
    assert sorted(map(tuple, st.complexity(rows, ["id"]).collect())) == wanted
    assert tuple(st.pattern_totals(rows).first()) == tuple(sum(x[i] for x in wanted) for i in range(2, 6))


def test_masked_as_before(spark):
    rows = spark.createDataFrame([(t,) for t in some_texts()], "definition string")
    clean = F.regexp_replace(F.coalesce("definition", F.lit("")), st.COMMENT, "$1")
    coded = F.transform(F.split(clean, "'"), lambda p, i: F.when(i % 2 == 1, F.hex(p)).otherwise(p))
    whole = F.trim(F.regexp_replace(F.array_join(coded, "'"), r"\s+", " "))
    assert rows.where(st.masked() != whole).count() == 0


def test_counting_tags_once_and_makes_no_fields(spark):
    rows = st.prepare(spark.createDataFrame([(1, "SELECT 1")], "id int, definition string"))
    for df in (st.complexity(rows, ["id"]), st.pattern_totals(rows)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(st.BRACKET) == 1 and "value_pattern" not in plan and "columns_used" not in plan
