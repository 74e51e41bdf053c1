from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from catalens.operators import assemble, profile, review, usage
from catalens.plans.schemas import CATALOG
from catalens.sources import catalog_io as io
from catalens.sources import system_views as sv


def test_system_databases_and_include(spark):
    df = spark.createDataFrame([("master", 0), ("Orders", 0), ("Old", 1), ("Crm", 0)], "name string, state int")
    assert {r.name for r in sv.accessible_databases(df, ["*"]).collect()} == {"Orders", "Crm"}
    assert [r.name for r in sv.accessible_databases(df, ["Crm", "Old"]).collect()] == ["Crm"]
    assert sv.accessible_databases(df).count() == 2


def test_columns_of_a_frame(spark):
    df = spark.createDataFrame([(1, "a")], "id int not null, name string")
    rows = sv.columns_of_frame(df, "db", "dbo", "T").collect()
    assert [(r.column_name, r.data_type, r.ordinal_position) for r in rows] == [("id", "int", 1), ("name", "string", 2)]


def test_stats_divide_like_integers(spark):
    spec = "database string, schema string, object_name string, execution_count long, last_execution_time string, total_worker_time long, total_elapsed_time long, total_logical_reads long, total_logical_writes long"
    df = spark.createDataFrame([("d", "s", "p", 3, None, 1999, 10_000, 0, 0), ("d", "s", "q", 0, None, 5, 5, 0, 0), ("d", None, "r", 1, None, 1, 1, 0, 0)], spec)
    assert [(r.object_name, r.total_cpu_ms, r.avg_duration_ms) for r in sv.procedure_stats(df).collect()] == [("p", 1, 3), ("q", 0, 0)]


def test_query_store_can_be_off(spark):
    q = spark.createDataFrame([("d", 1, 7)], "database string, query_id int, object_id int")
    p = spark.createDataFrame([("d", 2, 1)], "database string, plan_id int, query_id int")
    r = spark.createDataFrame([("d", 2, 4, 1000.0, 10.0, None)], "database string, plan_id int, count_executions long, avg_duration double, avg_cpu_time double, last_execution_time string")
    o = spark.createDataFrame([("d", 7, "s", "obj")], "database string, object_id int, schema string, object_name string")
    assert sv.query_store_stats(q, p, r, o).first().execution_count == 4
    off = sv.query_store_stats(q, p, r, o, enabled=False)
    assert off.count() == 0 and "avg_duration_ms" in off.columns


def test_dependencies_of_both_views_share_a_schema(spark):
    objects = spark.createDataFrame([("d", 1, "VIEW")], "database string, referencing_id int, referencing_type string")
    new = spark.createDataFrame([("d", 1, "dbo", "v", "dbo", "T")], "database string, referencing_id int, referencing_schema string, referencing_object string, referenced_schema string, referenced_table string")
    old = new.withColumn("referenced_column", F.lit("c"))
    both = sv.dependencies(new, objects).unionByName(sv.dependencies(old, objects))
    assert {r.referenced_column for r in both.collect()} == {None, "c"}


def test_column_in_two_keys_appears_twice(spark):
    key = "database string, schema string, table_name string"
    columns = spark.createDataFrame([("d", "s", "t", "c", "int", True)], key + ", column_name string, data_type string, is_nullable boolean")
    counts = spark.createDataFrame([], key + ", row_count_estimate long")
    pk = spark.createDataFrame([], key + ", column_name string, key_name string")
    fk = spark.createDataFrame([("d", "s", "t", "c", "f1", "s", "a", "x"), ("d", "s", "t", "c", "f2", "s", "b", "y")], key + ", column_name string, fk_name string, ref_schema string, ref_table string, ref_column string")
    use = spark.createDataFrame([], key + ", last_user_seek timestamp_ntz, last_user_scan timestamp_ntz, last_user_lookup timestamp_ntz, last_user_update timestamp_ntz")
    out = assemble.assemble_catalog(columns, counts, pk, fk, use, scanned_at=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert {r.fk_references for r in out.collect()} == {"s.a.x", "s.b.y"}
    assert out.first().row_count_estimate == 0 and out.first().is_primary_key is False
    assert out.schema.names == CATALOG.names


def test_unreadable_part_is_skipped(spark, happy):
    def broken():
        raise OSError("gone")

    with pytest.warns(UserWarning, match="b skipped"):
        parts = assemble.readable_parts({"a": lambda: happy, "b": broken})
    assert assemble.union_databases(parts, target="t", server="s").count() == 5


def test_replace_by_target_keeps_others_and_can_delete(spark, happy):
    other = happy.withColumn("target", F.lit("other"))
    both = happy.unionByName(other)
    new = happy.where("database = 'Orders'").withColumn("null_rate", F.lit(0.5))
    assert assemble.replace_by_target(both, new, ["test"]).groupBy("target").count().count() == 2
    assert assemble.replace_by_target(both, new.limit(0), ["test"]).select("target").distinct().collect()[0].target == "other"


def test_write_catalog_overwrites_one_target_only(spark, happy, tmp_path):
    path = str(tmp_path / "catalog")
    io.write_catalog(happy.unionByName(happy.withColumn("target", F.lit("other"))), path)
    io.write_catalog(happy.limit(1), path)
    counts = {r.target: r["count"] for r in io.load_catalog(spark, path).groupBy("target").count().collect()}
    assert counts == {"test": 1, "other": 5}
    assert io.load_catalog(spark, path).where("null_rate is not null").count() == 0


def test_snapshots(spark, happy, tmp_path):
    names = [io.snapshot_name([], "2024-01-01", "100000")]
    names.append(io.snapshot_name(names, "2024-01-01", "110000"))
    assert names == ["2024-01-01", "2024-01-01_110000"]
    for n, rows in zip(names, (happy, happy.limit(2))):
        io.write_snapshot(io.conform(rows), str(tmp_path / "s"), n)
    snaps = io.read_snapshots(spark, str(tmp_path / "s"))
    assert io.latest_snapshot(snaps).count() == 2
    assert {r.snapshot_id: r["columns"] for r in io.snapshot_list(snaps).collect()} == {names[0]: 5, names[1]: 2}


def test_load_data_by_suffix(spark, happy, tmp_path):
    happy.write.parquet(str(tmp_path / "x.parquet"))
    io.export(happy, str(tmp_path / "x.csv"), "csv")
    assert io.load_data(spark, str(tmp_path / "x.parquet")).count() == io.load_data(spark, str(tmp_path / "x.csv")).count() == 5
    with pytest.raises(ValueError):
        io.load_data(spark, "x.txt")
    with pytest.raises(ValueError):
        io.export(happy, str(tmp_path / "y"), "xml")


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, [1]), (1, "x", [2]), (None, "y", None)], "a int, b string, c array<int>")
    got = {r.column_name: tuple(r)[1:] for r in profile.column_profiles(df).collect()}
    assert got == {"a": (3, 1, 1, 0.3333), "b": (3, 1, 2, 0.3333)}
    near = {r.column_name: (r.profiled_rows, r.null_count, r.distinct_count) for r in profile.column_profiles(df, approximate=True).collect()}
    assert near == {"a": (3, 1, 1), "b": (3, 1, 2)}
    empty = profile.column_profiles(df.limit(0), extremes=True).where("column_name = 'a'").first()
    assert (empty.profiled_rows, empty.null_rate, empty.min_value) == (0, 0.0, None)
    assert {r.profiled_rows for r in profile.column_profiles(df, sample_size=2).collect()} == {2}


def test_importance(spark):
    def score(n, last):
        df = spark.createDataFrame([(n, last)], "n long, last string").withColumn("last", F.col("last").cast("timestamp"))
        return df.select(usage.importance(F.col("n"), F.col("last"), F.lit("2024-01-31 12:00:00").cast("timestamp"))).first()[0]

    assert score(0, None) == pytest.approx(0.04)
    assert score(9, "2024-01-31 11:00:00") == pytest.approx(0.6 * math.log(10) + 0.4)
    assert score(9, "2024-01-16 13:00:00") == pytest.approx(0.6 * math.log(10) + 0.4 * (1 - 14 / 30 * 0.9))
    assert score(9, "2020-01-01 00:00:00") == pytest.approx(0.6 * math.log(10) + 0.04)
    assert score(0, "2024-02-01 13:00:00") == pytest.approx(0.4 * (1 + 2 / 30 * 0.9))


def test_usage_of_later_target_wins(spark):
    a = spark.createDataFrame([("T", 1, 1), ("U", 2, 2)], "referenced_table string, reference_count long, unique_referrers long")
    b = spark.createDataFrame([("T", 9, 8)], a.schema)
    got = {r.referenced_table: r.reference_count for r in usage.usage_merge([a, b], ["referenced_table"]).collect()}
    assert got == {"T": 9, "U": 2}


def test_exec_stats_without_cpu_and_mean_of_means(spark):
    df = spark.createDataFrame([("d", "p", 10, "2024-01-01", 2.0), ("d", "p", 1, "2024-01-02", 4.0)], "database string, object_name string, execution_count long, last_execution_time string, avg_duration_ms double")
    row = usage.exec_stats(df).first()
    assert (row.execution_count, row.last_execution_time, row.avg_duration_ms, row.total_cpu_ms) == (11, "2024-01-02", 3.0, 0.0)


@pytest.mark.parametrize(
    ("name", "formula", "columns", "ratio", "want"),
    [
        ("net_revenue", "a/b", [], True, "Net revenue calculation (after discounts/adjustments)"),
        (None, "SUM(price)/2", [], True, "Financial ratio (e.g., margin, discount rate)"),
        ("n", "COUNT(cancelled)", [], False, "Count of cancelled items - potential churn metric"),
        ("order_n", "COUNT(x)", [], False, "Order volume count"),
        ("x", "a / b", ["Status"], True, "Status-based rate (e.g., churn rate, fulfillment rate)"),
        ("win_rate", "a / b", [], True, "Percentage or rate calculation"),
        ("x", "a + b", ["Created"], False, "Time-based calculation (duration, aging, etc.)"),
        ("days_open", "a + b", [], False, "Business metric: Days Open"),
        (None, "a + b", None, False, "Calculated business metric"),
    ],
)
def test_interpret_metric(spark, name, formula, columns, ratio, want):
    df = spark.createDataFrame([(name, formula, columns, ratio)], "name string, formula string, columns_used array<string>, is_ratio boolean")
    assert df.select(review.interpret_metric().alias("x")).first().x == want


@pytest.mark.parametrize(
    ("column", "operator", "value", "want"),
    [
        ("o.StatusCode", "=", "PEND", "Filtering to PENDING items - in-progress orders"),
        ("Status", "IN", "(A)", "Filtering by specific status codes"),
        ("x.CreatedDate", "=", "1", "Date-based filter"),
        ("CustomerIDSeq", "=", "@p", "Parameter-driven lookup by ID"),
        ("OrderId", "=", "5", "Filtering by specific entity ID"),
        ("is_open", "=", "1", "Boolean/flag filter"),
        ("ProductCode", "=", "1", "Filtering by type/category code"),
        ("a.end_point", "IS NOT NULL", "NULL", "Finding records where end point exists"),
        (None, "=", None, "Filter on "),
    ],
)
def test_interpret_filter(spark, column, operator, value, want):
    df = spark.createDataFrame([(column, operator, value)], "column string, operator string, value_pattern string")
    assert df.select(review.interpret_filter().alias("x")).first().x == want


def test_review_filters_name_at_most_three(spark):
    rows = [("d", f"p{i}", i, "c", "=", "1", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "database string, object_name string, position int, column string, operator string, value_pattern string, importance_score double")
    row = review.review_filters(df).first()
    assert (row.frequency, row.importance, row.used_in) == (5, 4.0, "p4, p3, p2")


def test_formula_names(spark):
    df = spark.createDataFrame([("SUM(t.Net) / NULLIF(COUNT(Id2), 100) AND x",), (None,)], "f string")
    assert [r.n for r in df.select(review.formula_names(F.col("f")).alias("n")).collect()] == [["Net", "Id2", "x"], None]


def test_apply_feedback_last_answer_wins_and_counts(spark):
    columns = spark.createDataFrame([("Net", ["old"]), ("Status", None), ("Other", ["b"])], "column_name string, business_terms array<string>")
    metrics = spark.createDataFrame([("SUM(Net)", "a", 1), ("AVG(Net)", "b", 2), ("SUM(Other)", "b", 3), ("SUM(Net)", None, 9)], "formula string, corrected_name string, position int")
    filters = spark.createDataFrame([("o.Status", "first", 1), ("Status", "second", 2)], "column string, business_meaning string, position int")
    got = {r.column_name: (r.business_terms, r.business_meaning, r.changes) for r in review.apply_feedback(columns, metrics, filters).collect()}
    assert got == {"Net": (["old", "b"], None, 1), "Status": ([], "second", 1), "Other": (["b"], None, 0)}


def test_answers(spark):
    df = spark.createDataFrame([(" YES ",), ("no",), ("unsure",), (None,)], "a string")
    assert [r.x for r in df.select(review.yes_no(F.col("a")).alias("x")).collect()] == [True, False, None, None]
