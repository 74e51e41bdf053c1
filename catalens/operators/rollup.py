"""Catalog counts and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grouped import first_per_group
from ..plans.schemas import TABLE_KEY

LARGE_TABLE_ROWS = 1_000_000  # fixed value


def overview_counts(catalog: DataFrame) -> DataFrame:
    """Distinct targets, databases and tables, and the number of columns.

    Rows are counted per table first: several distinct counts in one aggregate expand every input row, and
    so they expand only one row per table.
    """
    per_table = catalog.groupBy("target", *TABLE_KEY).agg(F.count("*").alias("_columns"))
    return per_table.agg(
        F.count_distinct("target").alias("targets"),
        F.count_distinct("database").alias("databases"),
        F.count_distinct(F.struct(*TABLE_KEY)).alias("tables"),
        F.coalesce(F.sum("_columns"), F.lit(0)).alias("columns"),
    )


def _tables_and_columns():
    return [
        F.count_distinct("schema", "table_name").alias("tables"),
        F.count("*").alias("columns"),
    ]


def db_summary_max(catalog: DataFrame) -> DataFrame:
    """Tables, columns and largest row estimate per target and database."""
    return (
        catalog.groupBy("target", "database")
        .agg(*_tables_and_columns(), F.max("row_count_estimate").alias("max_rows"))
        .orderBy("target", "database")
    )


def db_summary_sum(catalog: DataFrame, *, per_column: bool = True) -> DataFrame:
    """Tables, columns and summed row estimates per target and database.

    ``per_column`` adds a table's estimate once per column row; without it each table counts once.
    """
    if per_column:
        out = catalog.groupBy("target", "database").agg(
            *_tables_and_columns(), F.sum("row_count_estimate").alias("total_rows")
        )
    else:
        per_table = catalog.groupBy("target", *TABLE_KEY).agg(
            F.count("*").alias("_columns"), F.max("row_count_estimate").alias("_rows")
        )
        out = per_table.groupBy("target", "database").agg(
            F.count("*").alias("tables"), F.sum("_columns").alias("columns"), F.sum("_rows").alias("total_rows")
        )
    return out.orderBy("target", "database")


def top_tables(catalog: DataFrame, *, n: int = 20, above: int | None = None) -> DataFrame:
    """Largest tables by estimate, optionally only those above a threshold."""
    rows = catalog.select(*TABLE_KEY, "row_count_estimate")
    if above is not None:
        rows = rows.where(F.col("row_count_estimate") > above)
    return rows.distinct().orderBy(F.col("row_count_estimate").desc_nulls_last(), *TABLE_KEY).limit(n)


def key_relationships(catalog: DataFrame, *, n: int = 30) -> DataFrame:
    """First ``n`` distinct foreign-key rows in name order."""
    columns = ["database", "table_name", "column_name", "fk_references"]
    return (
        catalog.where(F.col("is_foreign_key") & (F.col("fk_references") != ""))
        .select(*columns)
        .distinct()
        .orderBy(*columns)
        .limit(n)
    )


def fk_by_table(catalog: DataFrame, *, show: int = 3, n: int = 30) -> DataFrame:
    """Per table: number of references and the first few as text, ``(+k more)`` for the rest.

    Only the first ``show`` references of a table are ever gathered.
    """
    refs = catalog.where(F.col("is_foreign_key") & (F.col("fk_references") != "")).select(
        "database", "table_name", F.concat("column_name", F.lit(" -> "), "fk_references").alias("ref")
    )
    keys = ["database", "table_name"]
    counts = refs.groupBy(*keys).agg(F.count("*").alias("fk_count")).orderBy(*keys).limit(n)
    heads = (
        first_per_group(refs.join(counts.select(*keys), keys, "left_semi"), keys, [F.col("ref")], show)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("ref")).alias("head"))
    )
    more = F.when(
        F.col("fk_count") > show, F.concat(F.lit(" (+"), (F.col("fk_count") - show).cast("string"), F.lit(" more)"))
    ).otherwise("")
    return counts.join(heads, keys).select(
        *keys, "fk_count", F.concat(F.concat_ws(", ", "head"), more).alias("references_text")
    )


def target_filter(catalog: DataFrame, target: str) -> DataFrame:
    """Rows of one target; an unknown target is an error."""
    rows = catalog.where(F.col("target") == target)
    if rows.isEmpty():
        raise ValueError(f"no catalog rows for target {target!r}")
    return rows
