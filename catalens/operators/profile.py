"""Column profiles over the data itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import materialize
from ..plans.schemas import COLUMN_KEY

_UNPROFILED = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def profiled_columns(df: DataFrame) -> list[str]:
    """Columns whose type can be counted and compared; nested and binary ones are skipped."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _UNPROFILED)]


def sample_rows(df: DataFrame, n: int, *, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (any ``n`` without ``order``); 0 means all rows."""
    if n <= 0:
        return df
    return (df.orderBy(*order) if order else df).limit(n)


def column_profiles(
    df: DataFrame,
    *,
    sample_size: int = 0,
    order: list[str] | None = None,
    approximate: bool = False,
    extremes: bool = False,
) -> DataFrame:
    """``column_name, profiled_rows, null_count, distinct_count, null_rate`` per profiled column.

    The exact form groups each column by its own values: a columnar scan reads just that column, the
    partial aggregation collapses repeated values before the shuffle, and only (value, count) pairs
    travel. Counting all columns distinctly in one aggregate would instead expand every row once per
    column. The approximate form is one pass with a fixed-size sketch per column.
    """
    rows = df
    if sample_size > 0:
        # every column must see the same rows, so the sample is drawn once
        rows = materialize(sample_rows(df, sample_size, order=order), "sample")
    names = profiled_columns(df)
    if approximate:
        return _sketched(rows, names, extremes)
    return reduce(DataFrame.unionByName, [_exact(rows, n, extremes) for n in names])


def _exact(rows: DataFrame, name: str, extremes: bool) -> DataFrame:
    value = F.col(f"`{name}`")
    per_value = rows.groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0))
    aggregates = [total.alias("profiled_rows"), nulls.alias("null_count"), F.count("_v").alias("distinct_count")]
    if extremes:
        aggregates += [F.min("_v").cast("string").alias("min_value"), F.max("_v").cast("string").alias("max_value")]
    out = per_value.agg(*aggregates)
    return out.select(F.lit(name).alias("column_name"), *out.columns, _rate().alias("null_rate"))


def _sketched(rows: DataFrame, names: list[str], extremes: bool) -> DataFrame:
    def entry(name: str) -> Column:
        value = F.col(f"`{name}`")
        fields = [
            F.lit(name).alias("column_name"),
            F.count("*").alias("profiled_rows"),
            F.count_if(value.isNull()).alias("null_count"),
            F.approx_count_distinct(value).alias("distinct_count"),
        ]
        if extremes:
            fields += [F.min(value).cast("string").alias("min_value"), F.max(value).cast("string").alias("max_value")]
        return F.struct(*fields)

    wide = rows.agg(F.array(*[entry(n) for n in names]).alias("p")).select(F.inline("p"))
    return wide.withColumn("null_rate", _rate())


def _rate() -> Column:
    return F.when(
        F.col("profiled_rows") > 0, F.bround(F.col("null_count") / F.col("profiled_rows"), 4)
    ).otherwise(F.lit(0.0))


def located_profile(profile: DataFrame, database: str, schema: str, table_name: str) -> DataFrame:
    """Profile rows keyed like the catalog."""
    keys = {"database": database, "schema": schema, "table_name": table_name}
    return profile.withColumns({k: F.lit(v) for k, v in keys.items()}).select(
        *COLUMN_KEY, "null_count", "null_rate", "distinct_count", "profiled_rows"
    )


def profile_by_database(catalog: DataFrame) -> DataFrame:
    """Mean null rate and number of tables per database."""
    return catalog.groupBy("database").agg(
        F.avg("null_rate").alias("avg_null_rate"),
        F.count_distinct(F.struct("schema", "table_name")).alias("tables"),
    )


def missingness(df: DataFrame, columns: list[str], fills: dict[str, object] | None = None):
    """Share of missing values per column, and the table with gaps filled and flagged.

    Returns ``(report, filled)``; each filled column gets an indicator ``<name>_missing``.
    """
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.count("*").alias("rows"),
        )
        for c in columns
    ]
    report = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    report = report.withColumn(
        "missing_pct", F.when(F.col("rows") > 0, 100.0 * F.col("missing") / F.col("rows")).otherwise(F.lit(0.0))
    )
    filled = df
    for name, value in (fills or {}).items():
        filled = filled.withColumn(f"{name}_missing", F.col(name).isNull().cast("int")).withColumn(
            name, F.coalesce(F.col(name), F.lit(value))
        )
    return report, filled
