"""Workload and usage statistics of programmable objects, tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import TABLE_KEY

# fixed values: importance weights, decay time in days and the floor of the recency part
COUNT_WEIGHT, RECENCY_WEIGHT = 0.6, 0.4
DECAY_DAYS, DECAY_SHARE, RECENCY_FLOOR = 30, 0.9, 0.1
FUNCTION_KINDS = ["SCALAR_FUNCTION", "INLINE_FUNCTION", "TABLE_FUNCTION"]


def object_type_counts(objects: DataFrame) -> DataFrame:
    """Objects per kind; the three function kinds count as one, unknown kinds not at all."""
    kind = (
        F.when(F.col("object_type") == "PROCEDURE", "procedures")
        .when(F.col("object_type") == "VIEW", "views")
        .when(F.col("object_type").isin(FUNCTION_KINDS), "functions")
        .when(F.col("object_type") == "TRIGGER", "triggers")
    )
    return objects.groupBy(kind.alias("kind")).agg(F.count("*").alias("objects")).where("kind is not null")


def stats_union(sources: dict[str, DataFrame]) -> DataFrame:
    """Statistics of several sources with different columns, tagged with their ``source``."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def exec_stats(stats: DataFrame) -> DataFrame:
    """Per (database, object): executions, last run, plain mean of the averages, CPU (0 if not recorded)."""
    cpu = F.sum("total_cpu_ms") if "total_cpu_ms" in stats.columns else F.lit(0.0)
    return stats.groupBy("database", "object_name").agg(
        F.sum("execution_count").alias("execution_count"),
        F.max("last_execution_time").alias("last_execution_time"),
        F.avg("avg_duration_ms").alias("avg_duration_ms"),
        F.coalesce(cpu, F.lit(0.0)).alias("total_cpu_ms"),
    )


def importance(executions: Column, last_run: Column, reference: Column) -> Column:
    """Weighted sum of the log of the execution count and a 30-day recency.

    Never run counts as the recency floor; a future date is above 1. Not rounded.
    """
    seconds = F.unix_timestamp(reference.cast("timestamp")) - F.unix_timestamp(last_run.cast("timestamp"))
    days = F.floor(seconds / 86400)
    recency = F.when(last_run.isNull(), RECENCY_FLOOR).otherwise(
        F.greatest(F.lit(RECENCY_FLOOR), 1 - days / DECAY_DAYS * DECAY_SHARE)
    )
    return F.log1p(executions.cast("double")) * COUNT_WEIGHT + recency * RECENCY_WEIGHT


def ranked_objects(
    objects: DataFrame, stats: DataFrame, reference: Column, *, keep: tuple[str, ...] = ("definition",)
) -> DataFrame:
    """All objects with their statistics (defaults where there are none) and importance score.

    ``keep`` names further object columns to carry along, such as mined patterns.
    """
    per_object = exec_stats(stats)
    joined = objects.join(per_object, ["database", "object_name"], "left")
    executions = F.coalesce("execution_count", F.lit(0))
    return joined.select(
        "database", "object_name", "object_type",
        executions.alias("execution_count"),
        F.col("last_execution_time").alias("last_executed"),
        F.bround(F.coalesce("avg_duration_ms", F.lit(0.0)), 2).alias("avg_duration_ms"),
        F.bround(importance(executions, F.col("last_execution_time"), reference), 2).alias("importance_score"),
        (F.coalesce("definition", F.lit("")) != "").alias("has_definition"),
        *keep,
    )


def top_objects(ranked: DataFrame, n: int = 100) -> DataFrame:
    """Most important objects; names settle ties."""
    return (
        ranked.orderBy(F.col("importance_score").desc(), "object_name", "database").limit(n).drop("definition")
    )


def _references() -> list[Column]:
    return [
        F.count("*").alias("reference_count"),
        F.count_distinct("referencing_object").alias("unique_referrers"),
    ]


def column_usage(deps: DataFrame) -> DataFrame:
    """References and distinct referrers per (table, column)."""
    known = deps.where(F.col("referenced_column").isNotNull())
    return known.groupBy("referenced_table", "referenced_column").agg(*_references())


def table_usage(deps: DataFrame) -> DataFrame:
    """References and distinct referrers per table."""
    return deps.groupBy("referenced_table").agg(*_references())


def enrich_usage(catalog: DataFrame, table_use: DataFrame, column_use: DataFrame) -> DataFrame:
    """Catalog columns with the usage of their table and of themselves, matched by bare names."""
    by_table = table_use.select(
        F.col("referenced_table").alias("table_name"),
        F.col("reference_count").alias("table_references"),
        F.col("unique_referrers").alias("table_referrers"),
    )
    by_column = column_use.select(
        F.col("referenced_table").alias("table_name"),
        F.col("referenced_column").alias("column_name"),
        F.col("reference_count").alias("column_references"),
        F.col("unique_referrers").alias("column_referrers"),
    )
    return catalog.join(by_table, "table_name", "left").join(by_column, ["table_name", "column_name"], "left")


def usage_merge(usages: list[DataFrame], keys: list[str]) -> DataFrame:
    """Usage of several targets; for a key in more than one the last target in the list wins."""
    numbered = [df.withColumn("_order", F.lit(i)) for i, df in enumerate(usages)]
    union = reduce(lambda a, b: a.unionByName(b), numbered)
    values = [c for c in usages[0].columns if c not in keys]
    picked = union.groupBy(*keys).agg(F.max_by(F.struct(*values), "_order").alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def most_executed(ranked: DataFrame, n: int = 20) -> DataFrame:
    return (
        ranked.where(F.col("execution_count") > 0)
        .select("database", "object_name", "execution_count")
        .orderBy(F.col("execution_count").desc(), "database", "object_name")
        .limit(n)
    )


def most_referenced(table_use: DataFrame, n: int = 20) -> DataFrame:
    return table_use.orderBy(F.col("reference_count").desc(), "referenced_table").limit(n)


def unused_tables(catalog: DataFrame, deps: DataFrame) -> DataFrame:
    """Catalog tables that no object refers to by name."""
    tables = catalog.select(*TABLE_KEY).distinct()
    used = deps.select(F.col("referenced_table").alias("table_name")).distinct()
    return tables.join(used, "table_name", "left_anti").select(*TABLE_KEY)


def unused_columns(catalog: DataFrame, deps: DataFrame) -> DataFrame:
    """Catalog columns that no object refers to by table and column name."""
    used = deps.where(F.col("referenced_column").isNotNull()).select(
        F.col("referenced_table").alias("table_name"), F.col("referenced_column").alias("column_name")
    ).distinct()
    return catalog.select(*TABLE_KEY, "column_name").join(used, ["table_name", "column_name"], "left_anti")
