"""Input views over the test tables and the query registry.

A view is one SQL text in the dialect that Spark and DuckDB share; ``{name}`` is a test table or another
view. It shapes the given tables like the inputs an operator expects (a catalog, system views, SQL texts).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import materialize

Query = Callable[[SparkSession, str], DataFrame]

VIEWS: dict[str, str] = {
    "catalog_keyed": """
        SELECT o_orderkey, l_linenumber,
          CONCAT('t', CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) % 3 AS STRING)) AS target,
          'srv' AS server,
          CONCAT('db', CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) AS STRING)) AS database,
          'dbo' AS schema,
          CASE o_orderkey % 10 WHEN 0 THEN 'Order' WHEN 1 THEN 'OrderItem' WHEN 2 THEN 'Customer'
            WHEN 3 THEN 'OrderHistory' WHEN 4 THEN 'ProductType' WHEN 5 THEN 'AuditTrail'
            WHEN 6 THEN 'QuoteStatus' WHEN 7 THEN 'ErrorLog' WHEN 8 THEN 'Property' ELSE 'Misc' END AS table_name,
          CASE l_linenumber WHEN 1 THEN 'OrderID' WHEN 2 THEN 'CustomerID' WHEN 3 THEN 'CreatedDate'
            WHEN 4 THEN 'TotalAmount' WHEN 5 THEN 'ItemCount' WHEN 6 THEN 'IsActive' ELSE 'Zzz' END AS column_name,
          CASE l_linenumber WHEN 1 THEN 'int' WHEN 2 THEN 'int' WHEN 3 THEN 'datetime'
            WHEN 4 THEN 'decimal' WHEN 5 THEN 'int' WHEN 6 THEN 'bit' ELSE 'xml' END AS data_type,
          l_linenumber > 2 AS is_nullable,
          l_linenumber = 1 AS is_primary_key,
          l_linenumber = 2 AS is_foreign_key,
          CASE WHEN l_linenumber = 2 THEN 'dbo.Customer.CustomerID' ELSE '' END AS fk_references,
          CAST(FLOOR(o_totalprice * 5) AS BIGINT) AS row_count_estimate,
          sd AS last_modified, sd AS scanned_at,
          qty * 10 AS profiled_rows,
          CAST(FLOOR(qty * 10 * (pk % 100) / 100) AS BIGINT) AS null_count,
          CAST(pk % 100 AS DOUBLE) / 100 AS null_rate,
          CAST(pk % 60 AS BIGINT) AS distinct_count
        FROM (
          SELECT o_orderkey, o_totalprice, l_linenumber,
            MAX(l_partkey) AS pk, MIN(l_shipdate) AS sd, CAST(SUM(l_quantity) AS BIGINT) AS qty
          FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
          GROUP BY o_orderkey, o_totalprice, l_linenumber) col""",
    "catalog_columns": """
        SELECT target, server, database, schema, table_name, column_name, data_type, is_nullable, is_primary_key,
          is_foreign_key, fk_references, row_count_estimate, last_modified, scanned_at, null_count,
          distinct_count, profiled_rows, null_rate
        FROM {catalog_keyed}""",
    # --- system views ---
    "sys_databases": """
        SELECT DISTINCT CASE database WHEN 'db0' THEN 'master' WHEN 'db1' THEN 'tempdb' ELSE database END AS name,
          CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) % 7 = 6 AS INT) AS state
        FROM {catalog_keyed}""",
    "sys_schemas": """
        SELECT DISTINCT database, CASE WHEN o_orderkey % 11 = 0 THEN 4 ELSE 1 END AS schema_id,
          CASE WHEN o_orderkey % 11 = 0 THEN 'sys' ELSE 'dbo' END AS schema_name
        FROM {catalog_keyed}""",
    "sys_tables": """
        SELECT DISTINCT database, o_orderkey AS object_id, CASE WHEN o_orderkey % 11 = 0 THEN 4 ELSE 1 END AS schema_id,
          table_name, CASE WHEN o_orderkey % 13 = 0 THEN 'V' ELSE 'U' END AS type
        FROM {catalog_keyed}""",
    "sys_partitions": """
        SELECT database, o_orderkey AS object_id, l_linenumber % 3 AS index_id, row_count_estimate AS rows
        FROM {catalog_keyed}""",
    "info_columns": """
        SELECT database, CASE WHEN o_orderkey % 11 = 0 THEN 'sys' ELSE 'dbo' END AS schema, table_name, column_name,
          data_type, CASE WHEN is_nullable THEN 'YES' ELSE 'NO' END AS is_nullable, l_linenumber AS ordinal_position,
          CASE WHEN data_type = 'xml' THEN -1 END AS max_length,
          CASE WHEN data_type = 'decimal' THEN 18 END AS numeric_precision,
          CASE WHEN data_type = 'decimal' THEN 2 END AS numeric_scale
        FROM {catalog_keyed}""",
    "info_tables": """
        SELECT DISTINCT database, CASE WHEN o_orderkey % 11 = 0 THEN 'sys' ELSE 'dbo' END AS schema, table_name,
          CASE WHEN o_orderkey % 13 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
        FROM {catalog_keyed}""",
    "sys_columns": """
        SELECT database, o_orderkey AS object_id, l_linenumber AS column_id, column_name FROM {catalog_keyed}""",
    "sys_indexes": """
        SELECT DISTINCT database, o_orderkey AS object_id, l_linenumber AS index_id,
          CONCAT('IX_', table_name, CAST(l_linenumber AS STRING)) AS index_name, l_linenumber = 1 AS is_primary_key
        FROM {catalog_keyed}""",
    "sys_index_columns": """
        SELECT DISTINCT database, o_orderkey AS object_id, l_linenumber AS index_id, l_linenumber AS column_id
        FROM {catalog_keyed}""",
    "sys_foreign_keys": """
        SELECT database, o_orderkey AS constraint_object_id, CONCAT('FK_', CAST(o_orderkey AS STRING)) AS fk_name
        FROM {catalog_keyed} WHERE is_foreign_key""",
    "sys_foreign_key_columns": """
        SELECT database, o_orderkey AS constraint_object_id, o_orderkey AS parent_object_id, 2 AS parent_column_id,
          CAST(FLOOR(o_orderkey / 10) AS BIGINT) * 10 + 2 AS referenced_object_id, 2 AS referenced_column_id
        FROM {catalog_keyed} WHERE is_foreign_key""",
    "sys_index_usage": """
        SELECT CONCAT('db', CAST(CAST(FLOOR(l_orderkey / 10) AS BIGINT) AS STRING)) AS database,
          l_orderkey AS object_id,
          CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS last_user_seek,
          CASE WHEN l_returnflag = 'N' THEN l_shipdate END AS last_user_scan,
          CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS last_user_lookup,
          CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN l_shipdate END AS last_user_update
        FROM {lineitem}""",
    # --- programmable objects and workload ---
    "sql_objects": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database,
          CONCAT('usp_', CAST(o_orderkey AS STRING)) AS object_name,
          CASE o_orderkey % 6 WHEN 0 THEN 'PROCEDURE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'SCALAR_FUNCTION'
            WHEN 3 THEN 'INLINE_FUNCTION' WHEN 4 THEN 'TABLE_FUNCTION' ELSE 'TRIGGER' END AS object_type,
          CASE o_orderkey % 5
            WHEN 0 THEN CONCAT('SELECT o.Status, COUNT(*) AS order_count FROM dbo.Orders o INNER JOIN dbo.Customer c ON o.CustomerID = c.CustomerID WHERE o.Status IN (''CNCL'', ''FULF'') AND c.Region = ', CAST(o_custkey % 7 AS STRING), ' GROUP BY o.Status')
            WHEN 1 THEN CONCAT('SELECT SUM(i.NetAmount) AS revenue, SUM(i.Discount) / SUM(i.Amount) AS discount_rate FROM dbo.Invoice i LEFT JOIN dbo.InvoiceItem t ON i.InvoiceID = t.InvoiceID WHERE i.CreatedDate >= @p', CAST(o_orderkey % 3 AS STRING))
            WHEN 2 THEN 'SELECT CASE WHEN COUNT(q.QuoteID) > 0 THEN 1 ELSE 0 END AS has_quote FROM dbo.Quote q WHERE q.ExpiryDate BETWEEN 1 AND 30 AND q.Notes IS NULL'
            WHEN 3 THEN 'SELECT p.Name, AVG(p.Price) AS avg_price FROM dbo.Product p CROSS JOIN dbo.Region r WHERE p.Name LIKE ''A%'' OR p.Price > 10 GROUP BY p.Name'
            ELSE '' END AS definition
        FROM {orders}""",
    "sys_objects": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database, o_orderkey AS object_id,
          CASE WHEN o_custkey % 19 = 0 THEN 4 ELSE 1 END AS schema_id,
          CONCAT('usp_', CAST(o_orderkey AS STRING)) AS object_name,
          CASE o_orderkey % 7 WHEN 0 THEN 'P' WHEN 1 THEN 'V' WHEN 2 THEN 'FN' WHEN 3 THEN 'IF' WHEN 4 THEN 'TF'
            WHEN 5 THEN 'TR' ELSE 'U' END AS type,
          o_orderdate AS created_date, o_orderdate AS modified_date
        FROM {orders}""",
    "object_schemas": """
        SELECT DISTINCT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database,
          CASE WHEN o_custkey % 19 = 0 THEN 4 ELSE 1 END AS schema_id,
          CASE WHEN o_custkey % 19 = 0 THEN 'sys' ELSE 'dbo' END AS schema_name
        FROM {orders}""",
    "sys_modules": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database, o_orderkey AS object_id,
          CONCAT('SELECT ', CAST(o_custkey AS STRING)) AS definition
        FROM {orders} WHERE o_orderstatus <> 'P'""",
    "raw_proc_stats": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE 'dbo' END AS schema,
          CONCAT('usp_', CAST(o_orderkey AS STRING)) AS object_name,
          CAST(l_quantity AS BIGINT) - 1 AS execution_count, l_shipdate AS last_execution_time,
          l_partkey * 1000 + l_linenumber AS total_worker_time,
          CAST(FLOOR(l_extendedprice * 1000) AS BIGINT) AS total_elapsed_time,
          l_partkey AS total_logical_reads, l_suppkey AS total_logical_writes
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "proc_stats": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database,
          CONCAT('usp_', CAST(o_orderkey AS STRING)) AS object_name,
          CAST(l_quantity AS BIGINT) AS execution_count, l_shipdate AS last_execution_time,
          l_extendedprice AS avg_duration_ms, CAST(l_partkey AS DOUBLE) AS total_cpu_ms
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "report_stats": """
        SELECT 'ReportServer' AS database, event_type AS object_name, CAST(1 AS BIGINT) AS execution_count,
          ts AS last_execution_time, value AS avg_duration_ms, user_id AS unique_users
        FROM {events}""",
    "qs_queries": """
        SELECT 'main' AS database, o_orderkey AS query_id, o_custkey AS object_id FROM {orders}""",
    "qs_plans": """
        SELECT 'main' AS database, o_orderkey * 2 + 1 AS plan_id, o_orderkey AS query_id FROM {orders}""",
    "qs_runtime": """
        SELECT 'main' AS database, l_orderkey * 2 + 1 AS plan_id, CAST(l_quantity AS BIGINT) AS count_executions,
          l_extendedprice AS avg_duration, CAST(l_linenumber AS DOUBLE) AS avg_cpu_time,
          l_shipdate AS last_execution_time
        FROM {lineitem}""",
    "qs_objects": """
        SELECT 'main' AS database, c_custkey AS object_id,
          CASE WHEN c_nationkey = 3 THEN NULL ELSE 'dbo' END AS schema, c_name AS object_name
        FROM {customer}""",
    "dep_references": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database, o_orderkey AS referencing_id,
          CASE WHEN o_orderkey % 17 = 0 THEN 'sys' ELSE 'dbo' END AS referencing_schema,
          CONCAT('usp_', CAST(o_orderkey AS STRING)) AS referencing_object, 'dbo' AS referenced_schema,
          CASE l_partkey % 9 WHEN 0 THEN 'Order' WHEN 1 THEN 'OrderItem' WHEN 2 THEN 'Customer' WHEN 3 THEN 'ErrorLog'
            WHEN 4 THEN NULL ELSE 'Property' END AS referenced_table,
          CASE l_linenumber WHEN 1 THEN 'OrderID' WHEN 2 THEN 'CustomerID' WHEN 3 THEN 'CreatedDate' END AS referenced_column
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "dep_objects": """
        SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database, o_orderkey AS referencing_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'SQL_STORED_PROCEDURE' ELSE 'VIEW' END AS referencing_type
        FROM {orders}""",
    "dependencies": """
        SELECT r.database, referencing_schema, referencing_object, referenced_schema, referenced_table,
          referenced_column, referencing_type
        FROM {dep_references} r JOIN {dep_objects} o ON r.database = o.database AND r.referencing_id = o.referencing_id
        WHERE referenced_table IS NOT NULL AND referencing_schema NOT IN ('sys', 'INFORMATION_SCHEMA')""",
    # --- people's input ---
    "annotations_base": """
        SELECT CONCAT('Orders.dbo.T', CAST(conv_id % 50 AS STRING)) AS target,
          CONCAT(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id,
          CASE turn % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'quality_flag' ELSE 'deprecation' END AS type,
          CASE WHEN turn % 3 = 1 THEN CASE conv_id % 5 WHEN 0 THEN 'TRUSTED' WHEN 1 THEN 'STALE'
            WHEN 2 THEN 'INCOMPLETE' WHEN 3 THEN 'EXPERIMENTAL' ELSE 'BOGUS' END ELSE text END AS content,
          role AS author, conv_id, turn
        FROM {conversations}""",
    # --- survival ---
    "first_last": """
        SELECT o_custkey, MIN(o_orderdate) AS first_dt, MAX(o_orderdate) AS last_dt FROM {orders} GROUP BY o_custkey""",
}


def tables_in(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def table(spark: SparkSession, folder: str, name: str, staged: dict[str, DataFrame] | None = None) -> DataFrame:
    """A test table or a view; views in ``staged`` are taken from there."""
    staged = staged or {}
    if name in staged:
        return staged[name]
    if name == "survival_base":
        return survival_base(spark, folder)
    if name in VIEWS:
        return spark.sql(VIEWS[name], **{t: table(spark, folder, t, staged) for t in tables_in(VIEWS[name])})
    return spark.read.parquet(f"{folder}/{name}.parquet")


EVENT_CUTOFF = "2001-02-02 00:00:00"


def survival_base(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with duration, event and a risk scaled to [0, 1]."""
    from ..operators.survival import survival_fields

    fields = survival_fields(
        table(spark, folder, "orders"), entity="o_custkey", time="o_orderdate",
        cutoff=F.lit(EVENT_CUTOFF).cast("timestamp_ntz"),
    )
    rows = fields.join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    low, high = rows.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return rows.select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", "first_dt", "last_dt", "event", "duration",
        ((F.col("c_acctbal") - low) / (high - low)).alias("risk"),
    )


SURVIVAL_SQL = f"""
    SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, first_dt, last_dt,
      CASE WHEN last_dt < TIMESTAMP '{EVENT_CUTOFF}' THEN 1 ELSE 0 END AS event,
      date_diff('day', first_dt, last_dt) AS duration,
      (c_acctbal - MIN(c_acctbal) OVER ()) / (MAX(c_acctbal) OVER () - MIN(c_acctbal) OVER ()) AS risk
    FROM {{first_last}} o JOIN {{customer}} ON c_custkey = o_custkey"""


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """SQL with the views that ``body`` names in braces as common table expressions, inputs first."""
    texts = {**VIEWS, "survival_base": SURVIVAL_SQL, **(extra or {})}
    ordered: list[str] = []

    def add(sql: str) -> None:
        for name in tables_in(sql):
            if name in texts and name not in ordered:
                add(texts[name])
                ordered.append(name)

    def plain(sql: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", sql)

    add(body)
    head = ", ".join(f"{n} AS ({plain(texts[n])})" for n in ordered)
    return (f"WITH {head} " if head else "") + plain(body)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, as the SQL texts do."""
    return df.select(
        *[
            F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


class Registry:
    """Queries by name with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, extra: dict[str, str] | None = None, stage: tuple[str, ...] = ()):
        """Register a query; the views in ``stage`` are written once because it reads them several times."""

        def register(make):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                staged: dict[str, DataFrame] = {}
                for view in stage:
                    staged[view] = materialize(table(spark, folder, view, staged), view)
                return make(lambda t: table(spark, folder, t, staged))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = oracle(sql, extra)
            return make

        return register
