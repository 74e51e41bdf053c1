"""Assembly of the one-row-per-column catalog and its per-target upkeep."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import CATALOG, COLUMN_KEY, TABLE_KEY
from ..sources.catalog_io import conform
from ..sources.system_views import USAGE_TIMES


def mark_primary_keys(primary_keys: DataFrame) -> DataFrame:
    """Key columns with a true flag, one row per column however many keys name it."""
    return primary_keys.select(*COLUMN_KEY).distinct().withColumn("is_primary_key", F.lit(True))


def fk_reference(foreign_keys: DataFrame) -> DataFrame:
    """``ref_schema.ref_table.ref_column`` per referencing column, one row per foreign key."""
    return foreign_keys.select(
        *COLUMN_KEY,
        (F.concat(F.col("ref_schema"), F.lit("."), F.col("ref_table"), F.lit("."), F.col("ref_column"))).alias(
            "fk_references"
        ),
        F.lit(True).alias("is_foreign_key"),
    )


def last_modified(usage: DataFrame) -> DataFrame:
    """Latest access of any kind per table; ``greatest`` skips nulls."""
    return usage.select(*TABLE_KEY, F.greatest(*USAGE_TIMES).alias("last_modified"))


def assemble_catalog(
    columns: DataFrame,
    row_counts: DataFrame,
    primary_keys: DataFrame,
    foreign_keys: DataFrame,
    usage: DataFrame,
    *,
    scanned_at: Column,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Left-join every part onto the columns and fill the defaults.

    A column that belongs to two foreign keys appears once per key. Table-level parts are joined into one
    table first, so the wide column side is shuffled once per key shape.
    """
    per_table = row_counts.select(*TABLE_KEY, "row_count_estimate").join(
        last_modified(usage), TABLE_KEY, "full"
    )
    out = (
        columns.join(mark_primary_keys(primary_keys), COLUMN_KEY, "left")
        .join(fk_reference(foreign_keys), COLUMN_KEY, "left")
        .join(per_table, TABLE_KEY, "left")
        .withColumn("scanned_at", scanned_at)
        .fillna({"is_primary_key": False, "is_foreign_key": False, "fk_references": "", "row_count_estimate": 0})
    )
    if profile is not None:
        out = attach_profile(out, profile)
    return conform(out)


PROFILE_DEFAULTS = {"null_count": 0, "null_rate": 0.0, "distinct_count": 0, "profiled_rows": 0}


def attach_profile(columns: DataFrame, profile: DataFrame) -> DataFrame:
    """Profile values per column, 0 where a column was not profiled."""
    kept = columns.drop(*PROFILE_DEFAULTS)
    return kept.join(profile.select(*COLUMN_KEY, *PROFILE_DEFAULTS), COLUMN_KEY, "left").fillna(PROFILE_DEFAULTS)


def readable_parts(readers: dict[str, Callable[[], DataFrame]]) -> list[DataFrame]:
    """Parts of the databases that can be read; one that cannot is left out with a warning."""
    parts = []
    for name, read in readers.items():
        try:
            part = read()
            part.schema  # analysis errors surface here
        except Exception as error:
            warnings.warn(f"{name} skipped: {error}", stacklevel=2)
        else:
            parts.append(part)
    return parts


def union_databases(parts: list[DataFrame], *, target: str, server: str) -> DataFrame:
    """One catalog from the parts of several databases, types made equal and stamped with their origin."""
    stamped = [
        conform(p.withColumns({"target": F.lit(target), "server": F.lit(server)})) for p in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), stamped)


def replace_by_target(catalog: DataFrame, scanned: DataFrame, targets: DataFrame | list[str]) -> DataFrame:
    """Drop the catalog rows of the rescanned targets and add the new rows.

    A rescanned target with no new rows disappears. Columns that only one side has are kept.
    """
    if isinstance(targets, DataFrame):
        kept = catalog.join(targets.select("target").distinct(), "target", "left_anti")
    else:
        kept = catalog.where(~F.col("target").isin(targets))
    return kept.unionByName(scanned, allowMissingColumns=True)


def catalog_of(df: DataFrame) -> DataFrame:
    """Cast any catalog-shaped table to the declared schema."""
    return conform(df, CATALOG)
