from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalens.operators import rollup, search
from catalens.sources import catalog_io


def tables(df):
    return [r.table_name for r in df.collect()]


def test_search_finds_tables_and_ranks_by_relevance_then_rows(happy):
    rows = search.search_catalog(happy, "order").collect()
    # table 3 + column 2 + database 1, then the key bonus
    assert [(r.table_name, r.relevance) for r in rows] == [("Order", 8), ("OrderItem", 7)]


def test_keys_alone_are_no_match(happy):
    assert search.search_catalog(happy, "nothing").count() == 0


def test_keywords_are_literal_unless_regex(happy):
    assert search.search_catalog(happy, "order.").count() == 0
    assert search.search_catalog(happy, "order.", regex=True).count() == 2


def test_blank_keywords_give_nothing_and_top_n_limits(happy):
    assert search.search_catalog(happy, "").count() == 0
    assert search.search_catalog(happy, ["", "  "]).count() == 0
    assert search.search_catalog(happy, "id", top_n=2).count() == 2


def test_case_is_ignored(happy):
    assert set(tables(search.search_catalog(happy, "ORDER"))) == {"Order", "OrderItem"}


@pytest.mark.parametrize("parts", [1, 3])
def test_batch_equals_single_searches(spark, happy, parts):
    texts = [(1, "order"), (2, " Product id "), (3, "x"), (4, "id id"), (5, "")]
    queries = spark.createDataFrame(texts, "query_id int, text string")
    batch = search.search_batch(
        happy, queries, row_key=search.COLUMN_KEY, weights=search.NAME_WEIGHTS, bonuses=search.KEY_BONUSES, top_n=3, parts=parts
    ).collect()
    for number, text in texts:
        got = [(r.table_name, r.relevance) for r in sorted(batch, key=lambda r: r.position) if r.query_id == number]
        want = [(r.table_name, r.relevance) for r in search.search_catalog(happy, text, top_n=3).collect()]
        assert got == want, text


def test_batch_scores_rows_without_grouping_them(spark, happy):
    queries = spark.createDataFrame([(1, "order"), (2, None)], "query_id int, text string")
    twice = happy.unionByName(happy)
    run = lambda df: search.search_batch(
        df, queries, row_key=search.COLUMN_KEY, weights=search.NAME_WEIGHTS, bonuses=search.KEY_BONUSES
    )
    once, both = run(happy), run(twice)
    plan = once._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("query_id" in k and "column_name" in k for k in keys)
    assert sorted(r.relevance for r in both.collect()) == sorted(2 * [r.relevance for r in once.collect()])


def test_details_and_missing_table(happy):
    assert search.table_details(happy, "Orders", "dbo", "OrderItem").first().fk_references == "Order.OrderId"
    assert search.table_details(happy, "Orders", "dbo", "Nope").count() == 0


def test_join_paths(happy):
    assert tables(search.join_paths_outbound(happy, "OrderItem")) == ["OrderItem"]
    assert tables(search.join_paths_inbound(happy, "Order")) == ["OrderItem"]
    assert tables(search.join_paths_inbound(happy, "rder")) == []
    assert tables(search.join_paths_inbound(happy, "rder", mode="substring")) == ["OrderItem"]
    with pytest.raises(ValueError):
        search.join_paths_inbound(happy, "Order", mode="other")


@pytest.mark.parametrize(
    ("scanned", "status", "age"),
    [("2026-01-26 10:00:00", "OK", 0), ("2026-01-20 00:00:00", "STALE", 7), ("2026-01-20 00:00:01", "OK", 6), (None, "UNKNOWN", None)],
)
def test_status(happy, scanned, status, age):
    last = F.lit(scanned).cast("timestamp")
    row = search.catalog_status(happy, last, F.lit("2026-01-27 00:00:00").cast("timestamp")).first()
    assert (row.status, row.age_days, row.databases, row.tables, row.columns) == (status, age, 3, 5, 5)


def test_status_without_catalog(spark):
    row = search.catalog_status(None, None, None, spark=spark).first()
    assert (row.status, row.tables) == ("NOT_BUILT", 0)


def test_missing_catalog_is_a_clear_error(spark, tmp_path):
    with pytest.raises(catalog_io.CatalogNotFound):
        catalog_io.load_catalog(spark, str(tmp_path / "none"))


def test_display_truncates(spark, happy):
    long = happy.where("is_foreign_key").withColumns(
        {"fk_references": F.lit("dbo.AVeryLongTableNameIndeed.AColumn"), "relevance": F.lit(3), "column_name": F.lit("c" * 25)}
    )
    row = search.display(long).first()
    assert row.fk_reference == "dbo.AVeryLongTableNameIndee..." and len(row.column) == 20
    assert (row.keys, row.rows, row.table) == ("FK", "500,000", "Orders.OrderItem")


def test_target_filter_rejects_unknown(happy):
    assert rollup.target_filter(happy, "test").count() == 5
    with pytest.raises(ValueError):
        rollup.target_filter(happy, "other")


def test_sum_per_table_does_not_overcount(spark, happy):
    twice = happy.unionByName(happy.withColumn("column_name", F.lit("Extra")))
    by_column = {r.database: r.total_rows for r in rollup.db_summary_sum(twice).collect()}
    by_table = {r.database: r.total_rows for r in rollup.db_summary_sum(twice, per_column=False).collect()}
    assert by_column["Orders"] == 1_200_000 and by_table["Orders"] == 600_000


def test_fk_by_table_counts_the_rest(spark, happy):
    fk = happy.where("is_foreign_key")
    many = fk.select(*[c for c in fk.columns if c != "column_name"], F.explode(F.split(F.lit("a b c d e"), " ")).alias("column_name"))
    row = rollup.fk_by_table(many).first()
    assert row.fk_count == 5
    assert row.references_text == "a -> Order.OrderId, b -> Order.OrderId, c -> Order.OrderId (+2 more)"
