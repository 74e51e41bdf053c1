"""Unqualified columns, snapshots and targets by folder, and rows without a usable number."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalens.operators import evaluation as ev
from catalens.operators import sqltext as st
from catalens.operators import survival
from catalens.sources import catalog_io as io

COLUMNS = [
    ("shop", "dbo", "Product", "Name"), ("shop", "dbo", "Product", "Price"), ("shop", "old", "Product", "Name"),
    ("shop", "dbo", "Order", "Price"), ("shop", "dbo", "Order", "Order Date"), ("other", "dbo", "Product", "Weight"),
    ("shop", None, "Loose", "Size"),
]


def resolve(spark, *texts, columns=COLUMNS):
    df = spark.createDataFrame([(i, "Shop", x) for i, x in enumerate(texts)], "id int, database string, definition string")
    known = spark.createDataFrame(columns, "database string, schema string, table_name string, column_name string")
    rows = st.resolved_columns(st.prepare(df), known, ["id"]).collect()
    return {(r.id, r.name): (r.state, r.table) for r in rows}


def test_unqualified_columns_find_their_table(spark):
    assert resolve(spark, "SELECT Name FROM dbo.Product WHERE Price > 3") == {
        (0, "Name"): ("resolved", "dbo.Product"), (0, "Price"): ("resolved", "dbo.Product")
    }


@pytest.mark.parametrize("text, expected", [
    ("SELECT Name FROM Product", {"Name": ("ambiguous", None)}),
    ("SELECT price FROM dbo.Product p, dbo.[Order] AS o", {"price": ("ambiguous", None)}),
    ("SELECT p.Name, [Order Date] d FROM dbo.Product p JOIN dbo.[Order] o ON p.x = o.x ORDER BY d",
     {"Order Date": ("resolved", "dbo.Order"), "d": ("unknown", None)}),
    ("SELECT Weight FROM other.dbo.Product -- Price\n WHERE Weight = @Price AND 1 = 'Name'", {"Weight": ("resolved", "dbo.Product")}),
    ("SELECT Weight FROM dbo.Product", {"Weight": ("unknown", None)}),
    ("SELECT CAST(Price AS INT) AS Name FROM dbo.Product", {"Price": ("resolved", "dbo.Product")}),
    ("SELECT Size FROM Loose", {"Size": ("resolved", "Loose")}),
    ("SELECT Price FROM (SELECT Price FROM dbo.Product) x", {"Price": ("resolved", "dbo.Product")}),
    ("SELECT Name FROM dbo.Product UNION ALL SELECT Name FROM [dbo].[product]", {"Name": ("resolved", "dbo.Product")}),
    ("SELECT lonely", {"lonely": ("unknown", None)}),
    (None, {}), ("", {}),
])
def test_states_of_names(spark, text, expected):
    assert {name: state for (_, name), state in resolve(spark, text).items()} == expected


def test_names_in_long_texts_and_without_a_catalog(spark):
    text = "SELECT a " + ", a" * 20_000 + " FROM dbo.Product WHERE Price = 1"
    assert resolve(spark, text)[(0, "Price")] == ("resolved", "dbo.Product")
    assert resolve(spark, "SELECT Name FROM dbo.Product", columns=[]) == {(0, "Name"): ("unknown", None)}


def test_newest_snapshot_reads_one_folder_and_scans_come_back(spark, happy, tmp_path):
    root = str(tmp_path / "s")
    assert io.read_snapshot_scans(spark, root).count() == 0
    scans = spark.sql("SELECT 'test' AS target, timestamp_ntz'2024-01-02 03:04:05' AS scanned_at, 5L AS rows")
    io.write_snapshot(io.conform(happy), root, "2024-01-01")
    io.write_snapshot(io.conform(happy.limit(2)), root, "2024-01-02", scans)
    snaps = io.read_snapshots(spark, root)
    assert io.snapshot_ids(snaps) == ["2024-01-01", "2024-01-02"]
    newest = io.latest_snapshot(snaps)
    assert newest.count() == 2 and "PartitionFilters: [isnotnull(snapshot_id" in newest._jdf.queryExecution().toString()
    assert snaps.count() == 7  # the scans are no snapshot
    assert [(r.snapshot_id, r.target, r.rows) for r in io.read_snapshot_scans(spark, root).collect()] == [("2024-01-02", "test", 5)]


def test_targets_are_replaced_by_folder(spark, happy, tmp_path):
    path, odd = str(tmp_path / "c"), "a/b=c%d"
    named = [happy.withColumn("target", F.lit(x)) for x in ("one", "two", odd)]
    io.write_catalog(io.conform(named[0].unionByName(named[1]).unionByName(named[2])), path)
    fresh = named[0].limit(2).unionByName(named[1].withColumn("target", F.lit("not named")))
    io.replace_targets(fresh, path, ["one", odd, "never seen"])
    counts = {r.target: r["count"] for r in io.load_catalog(spark, path).groupBy("target").count().collect()}
    assert counts == {"one": 2, "two": 5}
    io.replace_targets(fresh.limit(0), path, ["one", "two"])
    assert io.load_catalog(spark, path).count() == 0


@pytest.fixture()
def risks(spark):
    rows = [(i, i / 10, i % 2, float(i)) for i in range(1, 11)] + [(20, None, 1, None), (21, float("nan"), 1, float("nan"))]
    return spark.createDataFrame(rows, "id int, risk double, event int, duration double")


def test_rows_without_a_risk_are_in_no_table(risks):
    assert sum(r.n for r in ev.risk_tiers(risks, "risk", "event", "id").collect()) == 10
    assert sum(r.n for r in ev.lift_table(risks, "risk", "event", "id").collect()) == 10
    clean = risks.where("id < 20")
    for one in (
        lambda df: ev.decision_curve(df, "risk", "event", [0.2, 0.5]), lambda df: ev.capacity_coverage(df, "risk", "event", "id", [3, 6]),
        lambda df: survival.followup_bands(df, "duration", "event", [3, 6]),
    ):
        assert sorted(map(tuple, one(risks).collect())) == sorted(map(tuple, one(clean).collect()))
