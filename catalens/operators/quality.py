"""Join validation across tables and declared data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_validation(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys, orphans, match rate and fan-out of a join, from per-key counts only (rows are never joined)."""
    l = left.groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("l"))
    r = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("r"))
    null_rows = F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("l"))), F.lit(0))
    l_n, r_n = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    both = l.join(r, "k", "full")
    matched = F.sum(F.when((l_n > 0) & (r_n > 0), F.col("l")).otherwise(0))
    return both.agg(
        F.sum(l_n).alias("left_rows"), F.sum(r_n).alias("right_rows"),
        matched.alias("matched_left_rows"),
        F.sum(F.when(r_n == 0, l_n).otherwise(0)).alias("orphan_left_rows"),
        F.count_if((l_n == 0) & (r_n > 0)).alias("unused_right_keys"),
        null_rows.alias("null_left_keys"),
        F.max(F.when(l_n > 0, r_n)).alias("max_fan_out"),
        F.sum(l_n.cast("double") * r_n).alias("joined_rows"),
    ).withColumn("match_rate", F.when(F.col("left_rows") > 0, F.col("matched_left_rows") / F.col("left_rows")))


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key the right table lacks."""
    known = right.select(F.col(right_key).alias(left_key)).distinct()
    return left.where(F.col(left_key).isNotNull()).join(known, left_key, "left_anti")


def not_null(column: str) -> tuple[str, Column]:
    return f"{column} not null", F.col(column).isNotNull()


def in_range(column: str, low: float, high: float) -> tuple[str, Column]:
    return f"{column} in [{low}, {high}]", F.col(column).isNull() | F.col(column).between(low, high)


def one_of(column: str, values: list) -> tuple[str, Column]:
    return f"{column} in list", F.col(column).isNull() | F.col(column).isin(values)


def row_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break each rule; all rules in one pass."""
    entries = [
        F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"))
        for name, ok in rules
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def unique_rule(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    repeated = df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return repeated.agg(F.count("*").alias("violations")).select(
        F.lit(f"{', '.join(columns)} unique").alias("rule"), "violations"
    )


def reference_rule(df: DataFrame, other: DataFrame, column: str, other_column: str) -> DataFrame:
    """Rows that refer to a missing key."""
    return orphans(df.select(column), other, column, other_column).agg(F.count("*").alias("violations")).select(
        F.lit(f"{column} references {other_column}").alias("rule"), "violations"
    )


def quality_report(parts: list[DataFrame]) -> DataFrame:
    """Rule results with a verdict."""
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)
