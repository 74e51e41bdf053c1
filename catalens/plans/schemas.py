"""Declared table schemas."""

from pyspark.sql import types as T

CATALOG = (
    T.StructType()
    .add("target", "string")
    .add("server", "string")
    .add("database", "string")
    .add("schema", "string")
    .add("table_name", "string")
    .add("column_name", "string")
    .add("data_type", "string")
    .add("is_nullable", "boolean")
    .add("is_primary_key", "boolean")
    .add("is_foreign_key", "boolean")
    .add("fk_references", "string")
    .add("row_count_estimate", "long")
    .add("last_modified", "timestamp_ntz")
    .add("scanned_at", "timestamp_ntz")
    .add("null_count", "long")
    .add("distinct_count", "long")
    .add("profiled_rows", "long")
    .add("null_rate", "double")
)

SCAN_LOG = T.StructType().add("target", "string").add("scanned_at", "timestamp_ntz").add("rows", "long")

COLUMN_KEY = ["database", "schema", "table_name", "column_name"]
TABLE_KEY = ["database", "schema", "table_name"]

DEPENDENCIES = (
    T.StructType()
    .add("database", "string")
    .add("referencing_schema", "string")
    .add("referencing_object", "string")
    .add("referenced_schema", "string")
    .add("referenced_table", "string")
    .add("referenced_column", "string")
    .add("referencing_type", "string")
)
