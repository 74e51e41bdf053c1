"""Annotations on the test tables: conversation turns as notes, one JSON document each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import search
from ..plans.materialize import new_path
from .base import Registry
from .catalog import ts

R = Registry()


def documents(t):
    """One document per note; every fourth turn is repeated by a second author, every seventh is cut short."""
    notes = t("annotations_base")
    entry = F.struct("id", "type", "content", "author", F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    tables = F.create_map(F.col("target"), F.struct(F.array(entry).alias("annotations")))
    text = F.to_json(F.struct(tables.alias("tables")))
    repeated = notes.where(F.col("turn") % 4 == 0).withColumns(
        {"author": F.lit("zed"), "content": F.lit("copy"), "target": F.concat("target", F.lit("x"))}
    )
    both = notes.unionByName(repeated)
    broken = F.when((F.col("turn") % 7 == 0) & (F.col("author") != "zed"), F.expr("left(text, length(text) - 5)"))
    return both.select(F.concat_ws("/", "author", "id").alias("file"), text.alias("text"), "turn", "author").select(
        "file", F.coalesce(broken, F.col("text")).alias("text")
    )


MERGED = """SELECT CASE WHEN turn % 7 = 0 THEN target || 'x' ELSE target END AS target, id, type,
      CASE WHEN turn % 7 = 0 THEN 'copy' ELSE content END AS content, CASE WHEN turn % 7 = 0 THEN 'zed' ELSE author END AS author
    FROM {annotations_base} WHERE turn % 7 <> 0 OR turn % 4 = 0"""


def merged(t):
    return an.merge(documents(t)).select("target", "id", "type", "content", "author")


R.add("annotations_merged", MERGED)(merged)


@R.add("annotations_target", f"SELECT * FROM ({MERGED}) m WHERE target = 'Orders.dbo.T7'")
def _(t):
    return an.for_target(merged(t), "Orders.dbo.T7")


BAD_TARGET = "CASE conv_id % 11 WHEN 0 THEN 'Orders.T1' WHEN 1 THEN 'a.b.c.d' ELSE target END"
BAD_TYPE = "CASE WHEN conv_id % 13 = 0 THEN 'remark' ELSE type END"
ERROR = f"""CASE WHEN length({BAD_TARGET}) - length(replace({BAD_TARGET}, '.', '')) <> 2 THEN 'invalid target'
    WHEN {BAD_TYPE} NOT IN ('note', 'quality_flag', 'deprecation') THEN 'invalid type'
    WHEN {BAD_TYPE} = 'quality_flag' AND content NOT IN ('TRUSTED', 'STALE', 'INCOMPLETE', 'EXPERIMENTAL') THEN 'invalid quality flag'
    WHEN length(content) > 10000 THEN 'content too long' END"""


def raw(t):
    """Notes with some invalid targets and types, and some contents beyond the limit."""
    return t("annotations_base").withColumns({"target": F.expr(BAD_TARGET), "type": F.expr(BAD_TYPE)})


@R.add("annotations_validate", f"SELECT id, {BAD_TARGET} AS target, {BAD_TYPE} AS type, {ERROR} AS error FROM {{annotations_base}}")
def _(t):
    return an.validate(raw(t)).select("id", "target", "type", "error")


@R.add(
    "annotations_append",
    f"""SELECT {BAD_TARGET} AS target, {BAD_TYPE} AS type, content, author FROM {{annotations_base}} WHERE ({ERROR}) IS NULL""",
)
def _(t):
    notes = raw(t).select("target", "type", "content", "author")
    path = new_path(notes.sparkSession, "annotations")
    an.append(notes, path)
    stored = notes.sparkSession.read.schema(
        "target string, id string, type string, content string, created_at string, author string"
    ).parquet(path)
    return stored.where(F.length("id") == 36).select("target", "type", "content", "author")


@R.add(
    "sanitize_author",
    r"""SELECT c_custkey, substr(regexp_replace(c_name || ' @' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN repeat('é', 70) ELSE '' END, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 64) AS author
    FROM customer""",
)
def _(t):
    accents = F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("é"), 70)).otherwise("")
    name = F.concat("c_name", F.lit(" @"), "c_mktsegment", accents)
    return t("customer").select("c_custkey", an.sanitize_author(name).alias("author"))


@R.add(
    "search_annotated",
    """SELECT r.database, r.table_name, r.column_name, r.relevance, a.id AS annotation_id, a.type AS annotation_type, a.content, a.author
    FROM (SELECT database, table_name, column_name, relevance FROM (
        SELECT *, s + CASE WHEN is_primary_key THEN 2 ELSE 0 END + CASE WHEN is_foreign_key THEN 1 ELSE 0 END AS relevance
        FROM (SELECT *, 3 * CAST(contains(lower(table_name), 'order') AS INT) + 2 * CAST(contains(lower(column_name), 'order') AS INT) AS s
          FROM {catalog_columns}) x WHERE s > 0) y
      ORDER BY relevance DESC, row_count_estimate DESC, database, schema, table_name, column_name LIMIT 500) r
    LEFT JOIN {annotations_base} a ON r.database = 'db' || a.conv_id AND r.table_name = 'Order'""",
)
def _(t):
    found = search.search_catalog(t("catalog_columns"), "order", top_n=500)
    notes = t("annotations_base").withColumn("target", F.concat(F.lit("db"), F.col("conv_id").cast("string"), F.lit(".dbo.Order")))
    return an.attach(found, notes).select(
        "database", "table_name", "column_name", "relevance", "annotation_id", "annotation_type", "content", "author"
    )


def log(t):
    return t("events").select(
        F.concat(F.lit("Orders.dbo.U"), F.col("user_id").cast("string")).alias("target"),
        F.col("event_type").alias("author"), F.col("ts").alias("created_at"),
    )


@R.add(
    "annotations_stale",
    """SELECT 'Orders.dbo.U' || user_id AS target, MAX(ts) AS newest, COUNT(*) AS annotations,
      CAST(date_diff('day', MAX(ts), TIMESTAMP '2024-03-01 00:00:00') AS INT) AS age_days FROM events GROUP BY user_id HAVING age_days > 30""",
)
def _(t):
    return an.stale(log(t), ts("2024-03-01 00:00:00"), days=30)


@R.add(
    "annotations_activity",
    "SELECT event_type AS author, CAST(ts AS DATE) AS day, COUNT(*) AS annotations FROM events GROUP BY 1, 2",
)
def _(t):
    return an.activity(log(t))
