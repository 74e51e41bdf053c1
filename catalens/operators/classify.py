"""Rule-based classification of tables, columns and relationships.

Rules are compiled on the driver into one ordered ``when`` chain, so classifying is a projection: no join,
no shuffle, and the chain stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_match, column_pattern, fnmatch_pattern, table_pattern
from ..functions.rules import DEFAULT_RELATIONSHIP, FALLBACK_DOMAIN, FALLBACK_ROLE, in_order
from ..plans.schemas import TABLE_KEY


def first_match(branches: list[tuple[Column, object]], default: object) -> Column:
    """Value of the first true condition."""
    if not branches:
        return F.lit(default)
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def _split_fallback(rules: list[dict], default: str) -> tuple[list[dict], str]:
    ordered = in_order(rules)
    fallbacks = [r["id"] for r in ordered if r.get("is_fallback")]
    return [r for r in ordered if not r.get("is_fallback")], (fallbacks[-1] if fallbacks else default)


def domain_of(rules: list[dict], database: str = "database", table_name: str = "table_name") -> Column:
    """Business domain. A rule with a database list owns every table of those databases; one without
    decides by table name."""
    active, fallback = _split_fallback(rules, FALLBACK_DOMAIN)
    branches = []
    for rule in active:
        owned = rule.get("database_affinity") or []
        if owned:
            condition = F.col(database).isin(owned)
        else:
            condition = any_match(F.col(table_name), [table_pattern(p) for p in rule.get("table_patterns", [])])
        branches.append((condition, rule["id"]))
    return first_match(branches, fallback)


def role_of(
    rules: list[dict],
    column_name: str = "column_name",
    data_type: str = "data_type",
    primary: str = "is_primary_key",
    foreign: str = "is_foreign_key",
    *,
    anchored: bool = False,
) -> Column:
    """Semantic role from name pattern, data type and key conditions."""
    active, fallback = _split_fallback(rules, FALLBACK_ROLE)
    gates = {"is_primary_key": F.coalesce(F.col(primary), F.lit(False)),
             "is_foreign_key": F.coalesce(F.col(foreign), F.lit(False))}
    branches = []
    for rule in active:
        condition = any_match(
            F.col(column_name), [column_pattern(p, anchored=anchored) for p in rule.get("patterns", [])]
        )
        for name, gate in gates.items():
            if rule.get("conditions", {}).get(name):
                condition = condition & gate
        if rule.get("data_types"):
            condition = condition & F.lower(F.col(data_type)).isin([t.lower() for t in rule["data_types"]])
        branches.append((condition, rule["id"]))
    return first_match(branches, fallback)


def relationship_of(rules: list[dict], column_name: str = "column_name") -> tuple[Column, Column]:
    """Relationship type and its inverse from the foreign-key column's name (case-sensitive glob)."""
    name = F.col(column_name)
    matches = [(name.rlike(fnmatch_pattern(r.get("pattern", ""))), r) for r in rules]
    forward, backward = DEFAULT_RELATIONSHIP
    return (
        first_match([(c, r.get("type", forward)) for c, r in matches], forward),
        first_match([(c, r.get("inverse", backward)) for c, r in matches], backward),
    )


def classify_tables(catalog: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per table with its domain."""
    return catalog.select(*TABLE_KEY).distinct().withColumn("domain", domain_of(rules))


def domain_counts(catalog: DataFrame, rules: list[dict]) -> DataFrame:
    """Tables per configured domain, 0 included; tables are (database, name) pairs, schema ignored."""
    counted = (
        catalog.select("database", "table_name")
        .distinct()
        .groupBy(domain_of(rules).alias("domain"))
        .agg(F.count("*").alias("_n"))
    )
    spec = "domain string, label string, description string"
    listed = catalog.sparkSession.createDataFrame(
        [(r["id"], r.get("label", r["id"]), r.get("description", "")) for r in rules], spec
    )
    return listed.join(counted, "domain", "left").select(
        "domain", "label", "description", F.coalesce("_n", F.lit(0)).alias("table_count")
    )


def source_stats(catalog: DataFrame) -> DataFrame:
    """Columns, tables, databases and foreign-key columns."""
    per_table = catalog.groupBy(*TABLE_KEY).agg(
        F.count("*").alias("_columns"), F.count_if("is_foreign_key").alias("_foreign_keys")
    )
    return per_table.agg(
        F.coalesce(F.sum("_columns"), F.lit(0)).alias("total_columns"),
        F.count("*").alias("total_tables"),
        F.count_distinct("database").alias("total_databases"),
        F.coalesce(F.sum("_foreign_keys"), F.lit(0)).alias("total_foreign_keys"),
    )
