"""Catalog parts and workload tables from dumps of a database server's system views.

Every dump carries a ``database`` column, so that all databases of a server are handled by one plan
instead of one query per database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import DEPENDENCIES
from .catalog_io import conform

# fixed values: names the server keeps for itself, and its object type codes
SYSTEM_DATABASES = ["master", "tempdb", "model", "msdb"]
SYSTEM_SCHEMAS = ["sys", "INFORMATION_SCHEMA"]
OBJECT_TYPES = {
    "P": "PROCEDURE",
    "V": "VIEW",
    "FN": "SCALAR_FUNCTION",
    "IF": "INLINE_FUNCTION",
    "TF": "TABLE_FUNCTION",
    "TR": "TRIGGER",
}


def _user_schema(name: str) -> Column:
    return ~F.col(name).isin(SYSTEM_SCHEMAS)


def accessible_databases(databases: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Online databases (``name``, ``state``) without the system ones; ``include`` holds exact names or ``*``."""
    out = databases.where((F.col("state") == 0) & ~F.col("name").isin(SYSTEM_DATABASES))
    if include is not None and "*" not in include:
        out = out.where(F.col("name").isin(include))
    return out.select("name")


def _named_tables(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables with their schema's name: ``database, object_id, schema, table_name, type``."""
    return tables.join(schemas, ["database", "schema_id"]).select(
        "database", "object_id", F.col("schema_name").alias("schema"), "table_name", "type"
    )


def table_row_counts(tables: DataFrame, schemas: DataFrame, partitions: DataFrame) -> DataFrame:
    """User tables with the row total of their heap or clustered index, 0 where none is recorded."""
    rows = (
        partitions.where(F.col("index_id").isin(0, 1))
        .groupBy("database", "object_id")
        .agg(F.sum("rows").alias("rows"))
    )
    return (
        _named_tables(tables.where(F.col("type") == "U"), schemas)
        .where(_user_schema("schema"))
        .join(rows, ["database", "object_id"], "left")
        .groupBy("database", "schema", "table_name")
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("row_count_estimate"))
    )


def base_table_columns(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of base tables with typed attributes; the view's YES/NO becomes a boolean."""
    base = tables.where(F.col("table_type") == "BASE TABLE").select("database", "schema", "table_name")
    return (
        columns.where(_user_schema("schema"))
        .join(base, ["database", "schema", "table_name"])
        .select(
            "database", "schema", "table_name", "column_name", "data_type",
            (F.col("is_nullable") == "YES").alias("is_nullable"),
            F.col("ordinal_position").cast("int").alias("ordinal_position"),
            F.col("max_length").cast("long").alias("max_length"),
            F.col("numeric_precision").cast("int").alias("numeric_precision"),
            F.col("numeric_scale").cast("int").alias("numeric_scale"),
        )
    )


def columns_of_frame(df: DataFrame, database: str, schema: str, table_name: str) -> DataFrame:
    """The same column rows harvested from a DataFrame's own schema."""
    rows = [
        (database, schema, table_name, f.name, f.dataType.simpleString(), f.nullable, i + 1)
        for i, f in enumerate(df.schema.fields)
    ]
    spec = (
        "database string, schema string, table_name string, column_name string, data_type string, "
        "is_nullable boolean, ordinal_position int"
    )
    return df.sparkSession.createDataFrame(rows, spec)


def primary_key_columns(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame, schemas: DataFrame
) -> DataFrame:
    """Columns of primary-key indexes with the key's name."""
    named = _named_tables(tables, schemas).where(_user_schema("schema"))
    return (
        indexes.where("is_primary_key")
        .join(index_columns, ["database", "object_id", "index_id"])
        .join(columns, ["database", "object_id", "column_id"])
        .join(named, ["database", "object_id"])
        .select("database", "schema", "table_name", "column_name", F.col("index_name").alias("key_name"))
    )


def foreign_key_columns(
    fk_columns: DataFrame, foreign_keys: DataFrame, columns: DataFrame, tables: DataFrame, schemas: DataFrame
) -> DataFrame:
    """Referencing column and referenced column of every foreign key."""
    named = _named_tables(tables, schemas).select("database", "object_id", "schema", "table_name")
    located = columns.join(named, ["database", "object_id"]).select(
        "database", "object_id", "column_id", "schema", "table_name", "column_name"
    )
    child = located.where(_user_schema("schema")).withColumnsRenamed(
        {"object_id": "parent_object_id", "column_id": "parent_column_id"}
    )
    parent = located.withColumnsRenamed(
        {
            "object_id": "referenced_object_id", "column_id": "referenced_column_id",
            "schema": "ref_schema", "table_name": "ref_table", "column_name": "ref_column",
        }
    )
    return (
        fk_columns.join(foreign_keys, ["database", "constraint_object_id"])
        .join(child, ["database", "parent_object_id", "parent_column_id"])
        .join(parent, ["database", "referenced_object_id", "referenced_column_id"])
        .select(
            "database", "schema", "table_name", "column_name", "fk_name", "ref_schema", "ref_table", "ref_column"
        )
    )


USAGE_TIMES = ["last_user_seek", "last_user_scan", "last_user_lookup", "last_user_update"]


def index_usage(tables: DataFrame, schemas: DataFrame, usage: DataFrame) -> DataFrame:
    """Latest access of each kind per table, null where the table was never touched."""
    per_object = usage.groupBy("database", "object_id").agg(*[F.max(c).alias(c) for c in USAGE_TIMES])
    return (
        _named_tables(tables, schemas)
        .where(_user_schema("schema"))
        .join(per_object, ["database", "object_id"], "left")
        .groupBy("database", "schema", "table_name")
        .agg(*[F.max(c).alias(c) for c in USAGE_TIMES])
    )


def programmable_objects(objects: DataFrame, schemas: DataFrame, modules: DataFrame) -> DataFrame:
    """Procedures, views, functions and triggers with their SQL text where it can be read."""
    codes = F.create_map(*[F.lit(x) for pair in OBJECT_TYPES.items() for x in pair])
    return (
        objects.where(F.col("type").isin(list(OBJECT_TYPES)))
        .join(schemas.where(_user_schema("schema_name")), ["database", "schema_id"])
        .join(modules, ["database", "object_id"], "left")
        .select(
            "database", F.col("schema_name").alias("schema"), "object_name",
            codes[F.col("type")].alias("object_type"), "definition", "created_date", "modified_date",
        )
    )


def procedure_stats(stats: DataFrame) -> DataFrame:
    """Execution counters in milliseconds; the divisions truncate like the server's integer division."""
    return stats.where(F.col("schema").isNotNull()).select(
        "database", "schema", "object_name", "execution_count", "last_execution_time",
        F.expr("total_worker_time div 1000").alias("total_cpu_ms"),
        F.expr("total_elapsed_time div 1000").alias("total_elapsed_ms"),
        "total_logical_reads", "total_logical_writes",
        F.expr(
            "case when execution_count > 0 then total_elapsed_time div execution_count div 1000 else 0 end"
        ).alias("avg_duration_ms"),
    )


def query_store_stats(
    queries: DataFrame, plans: DataFrame, runtime: DataFrame, objects: DataFrame, *, enabled: bool = True
) -> DataFrame:
    """Runtime statistics per object; no rows when the store is switched off.

    Runtime rows are summed per plan before the joins, which keeps a hot plan or query out of the shuffle.
    """
    per_plan = runtime.groupBy("database", "plan_id").agg(
        F.sum("count_executions").alias("executions"),
        F.max("last_execution_time").alias("last_execution_time"),
        F.sum("avg_duration").alias("duration"),
        F.count("avg_duration").alias("measured"),
        F.sum(F.col("avg_cpu_time") * F.col("count_executions")).alias("cpu"),
    )
    out = (
        queries.where(F.col("object_id") > 0)
        .join(plans, ["database", "query_id"])
        .join(per_plan, ["database", "plan_id"])
        .groupBy("database", "object_id")
        .agg(
            F.sum("executions").alias("execution_count"),
            F.max("last_execution_time").alias("last_execution_time"),
            (F.sum("duration") / F.sum("measured") / 1000).alias("avg_duration_ms"),
            (F.sum("cpu") / 1000).alias("total_cpu_ms"),
        )
        .join(objects.select("database", "object_id", "schema", "object_name"), ["database", "object_id"])
        .where(F.col("schema").isNotNull())
        .select(
            "database", "schema", "object_name", "execution_count", "last_execution_time",
            "avg_duration_ms", "total_cpu_ms",
        )
    )
    return out if enabled else out.where(F.lit(False))


def log_rollup(
    log: DataFrame, *, name: str, at: str, user: str, durations: list[str], reference: Column, days: int = 90
) -> DataFrame:
    """Executions, last run, mean total duration and distinct users per report over the last ``days``."""
    total = sum((F.col(c) for c in durations[1:]), F.col(durations[0]))
    start = reference - F.expr(f"interval {days} days")
    return (
        log.where(F.col(at) > start)
        .groupBy(F.col(name).alias("object_name"))
        .agg(
            F.count("*").alias("execution_count"),
            F.max(at).alias("last_execution_time"),
            F.avg(total).alias("avg_duration_ms"),
            F.count_distinct(user).alias("unique_users"),
        )
    )


def dependencies(references: DataFrame, objects: DataFrame) -> DataFrame:
    """Object-to-table edges in one schema for both forms of the view.

    The newer view has no ``referenced_column`` (null here); the older one gives it.
    """
    out = (
        references.where(F.col("referenced_table").isNotNull() & _user_schema("referencing_schema"))
        .join(objects.select("database", "referencing_id", "referencing_type"), ["database", "referencing_id"])
    )
    return conform(out, DEPENDENCIES)
