"""Catalog, snapshot and scan-log tables in files (parquet, CSV, JSON)."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schemas import CATALOG, SCAN_LOG


class CatalogNotFound(FileNotFoundError):
    """No catalog has been written at the given path."""


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog table with the declared schema; columns a file lacks (profiles) read as null."""
    try:
        return spark.read.schema(CATALOG).parquet(path)
    except AnalysisException as error:
        raise CatalogNotFound(f"no catalog at {path}; write one with write_catalog first") from error


def conform(df: DataFrame, schema=CATALOG) -> DataFrame:
    """Project to ``schema``: missing columns become null, the others are cast once."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_catalog(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ("target",)) -> None:
    """Overwrite only the partitions present in ``df``; other targets stay untouched."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def folder_value(value: str | None) -> str:
    """A partition value as Spark writes it in a folder name."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def replace_targets(scanned: DataFrame, path: str, targets: list[str]) -> None:
    """Rewrite the folders of the rescanned ``targets`` in a catalog that is partitioned by target.

    Other targets are neither read nor shuffled, so one that holds most of the catalog costs nothing. A target without
    new rows becomes empty; rows of targets that are not named are left out. The new rows are written before an old
    folder is emptied.
    """
    new = conform(scanned.where(F.col("target").isin(targets)))
    write_catalog(new, path)
    written = {r.target for r in new.select("target").distinct().collect()}  # at most the targets named
    nothing = new.limit(0).drop("target").coalesce(1)
    for target in sorted(set(targets) - written):
        nothing.write.mode("overwrite").parquet(f"{path}/target={folder_value(target)}")


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV, chosen by suffix."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        return spark.read.parquet(path)
    if lowered.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported file type: {path}")


def read_relational(spark: SparkSession, url: str, query: str, *, options: dict[str, str] | None = None,
                    partition_column: str | None = None, bounds: tuple[int, int] | None = None,
                    partitions: int = 1) -> DataFrame:
    """Query result over JDBC; with a partition column the rows are fetched in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if partition_column is None:
        return reader.option("query", query).load()
    low, high = bounds
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )


def as_json_rows(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object per row, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write a result as JSON lines or as CSV with a header."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported export kind: {kind}")


# --- scan log ---------------------------------------------------------------------------------------


def scan_log_entries(catalog: DataFrame, scanned_at: str | Column = "scanned_at") -> DataFrame:
    """One log row per target: rows scanned and the time of the scan."""
    when = F.col(scanned_at) if isinstance(scanned_at, str) else scanned_at
    return catalog.groupBy("target").agg(F.max(when).alias("scanned_at"), F.count("*").alias("rows"))


def append_scan_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def scan_log_latest(log: DataFrame) -> DataFrame:
    """Latest entry per target and the time of the last update over all targets."""
    latest = log.groupBy("target").agg(
        F.max("scanned_at").alias("last_scan"), F.max_by("rows", "scanned_at").alias("rows")
    )
    last_updated = latest.agg(F.max("last_scan")).first()[0]
    return latest.withColumn("last_updated", F.lit(last_updated).cast(log.schema["scanned_at"].dataType))


# --- snapshots --------------------------------------------------------------------------------------


def snapshot_name(existing: list[str], day: str, time: str) -> str:
    """``day`` for the first snapshot of a day, ``day_time`` for a later one."""
    return day if day not in existing else f"{day}_{time}"


def write_snapshot(catalog: DataFrame, root: str, snapshot_id: str, scans: DataFrame | None = None) -> None:
    """Write a copy of the catalog, and next to it what is known about its scans (one row per target).

    Scans are written first: a snapshot that can be seen has them.
    """
    if scans is not None:
        conform(scans, SCAN_LOG).write.mode("overwrite").parquet(f"{root}/_scans/snapshot_id={snapshot_id}")
    catalog.write.mode("errorifexists").parquet(f"{root}/snapshot_id={snapshot_id}")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots, told apart by the partition column ``snapshot_id`` (kept as text)."""
    schema = T.StructType([*CATALOG.fields, T.StructField("snapshot_id", T.StringType())])
    return spark.read.schema(schema).option("basePath", root).parquet(root)


def read_snapshot_scans(spark: SparkSession, root: str) -> DataFrame:
    """Scan information of all snapshots that have any, with their ``snapshot_id``."""
    schema = T.StructType([*SCAN_LOG.fields, T.StructField("snapshot_id", T.StringType())])
    folder = f"{root}/_scans"
    try:
        return spark.read.schema(schema).option("basePath", folder).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def snapshot_ids(snapshots: DataFrame) -> list[str]:
    """Ids by the names of the table's folders; no file is opened."""
    folders = (re.search(r"/snapshot_id=([^/]+)/", name) for name in snapshots.inputFiles())
    return sorted({unquote(unquote(m[1])) for m in folders if m})


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """Tables and columns per snapshot."""
    return snapshots.groupBy("snapshot_id").agg(
        F.count_distinct(F.struct("database", "schema", "table_name")).alias("tables"),
        F.count("*").alias("columns"),
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot, found by folder names, so that only its files are read."""
    ids = snapshot_ids(snapshots)
    return snapshots.where(F.col("snapshot_id") == F.lit(ids[-1] if ids else None).cast("string"))
