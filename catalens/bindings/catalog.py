"""Sources, assembly, profiles, search and roll-ups on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, profile, rollup, search
from ..plans.materialize import new_path
from ..plans.schemas import COLUMN_KEY
from ..sources import catalog_io as io
from ..sources import system_views as sv
from .base import Registry, rounded

R = Registry()
DAY = "2024-01-31 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- sources ----------------------------------------------------------------------------------------

CATALOG_COLUMNS = (
    "target, database, schema, table_name, column_name, data_type, is_nullable, is_primary_key, is_foreign_key, "
    "fk_references, row_count_estimate"
)


def written(df, label="catalog"):
    path = new_path(df.sparkSession, label)
    io.write_catalog(df, path)
    return path


@R.add("scan_catalog", f"SELECT {CATALOG_COLUMNS} FROM {{catalog_columns}} WHERE target = 't1'")
def _(t):
    cat = t("catalog_columns")
    read = io.load_catalog(cat.sparkSession, written(cat))
    return read.where("target = 't1'").select(*CATALOG_COLUMNS.split(", "))


@R.add(
    "src_databases",
    "SELECT name FROM {sys_databases} WHERE state = 0 AND name NOT IN ('master', 'tempdb', 'model', 'msdb')",
)
def _(t):
    return sv.accessible_databases(t("sys_databases"), ["*"])


@R.add(
    "src_tables",
    """SELECT t.database, s.schema_name AS schema, t.table_name, CAST(COALESCE(SUM(p.rows), 0) AS BIGINT) AS row_count_estimate
    FROM {sys_tables} t JOIN {sys_schemas} s ON t.database = s.database AND t.schema_id = s.schema_id
    LEFT JOIN {sys_partitions} p ON t.database = p.database AND t.object_id = p.object_id AND p.index_id IN (0, 1)
    WHERE t.type = 'U' AND s.schema_name NOT IN ('sys', 'INFORMATION_SCHEMA')
    GROUP BY t.database, s.schema_name, t.table_name""",
)
def _(t):
    return sv.table_row_counts(t("sys_tables"), t("sys_schemas"), t("sys_partitions"))


@R.add(
    "src_columns",
    """SELECT c.database, c.schema, c.table_name, c.column_name, c.data_type, c.is_nullable = 'YES' AS is_nullable,
      CAST(ordinal_position AS INT) AS ordinal_position, CAST(max_length AS BIGINT) AS max_length,
      CAST(numeric_precision AS INT) AS numeric_precision, CAST(numeric_scale AS INT) AS numeric_scale
    FROM {info_columns} c JOIN {info_tables} t ON c.database = t.database AND c.schema = t.schema AND c.table_name = t.table_name
    WHERE t.table_type = 'BASE TABLE' AND c.schema NOT IN ('sys', 'INFORMATION_SCHEMA')""",
)
def _(t):
    return sv.base_table_columns(t("info_columns"), t("info_tables"))


PK_SQL = """SELECT t.database, s.schema_name AS schema, t.table_name, c.column_name, i.index_name AS key_name
    FROM {sys_indexes} i
    JOIN {sys_index_columns} ic ON i.database = ic.database AND i.object_id = ic.object_id AND i.index_id = ic.index_id
    JOIN {sys_columns} c ON ic.database = c.database AND ic.object_id = c.object_id AND ic.column_id = c.column_id
    JOIN {sys_tables} t ON i.database = t.database AND i.object_id = t.object_id
    JOIN {sys_schemas} s ON t.database = s.database AND t.schema_id = s.schema_id
    WHERE i.is_primary_key AND s.schema_name NOT IN ('sys', 'INFORMATION_SCHEMA')"""


def primary_keys(t):
    return sv.primary_key_columns(
        t("sys_indexes"), t("sys_index_columns"), t("sys_columns"), t("sys_tables"), t("sys_schemas")
    )


R.add("src_primary_keys", PK_SQL, stage=("catalog_keyed",))(primary_keys)

FK_SQL = """SELECT t.database, s.schema_name AS schema, t.table_name, c.column_name, fk.fk_name,
      rs.schema_name AS ref_schema, rt.table_name AS ref_table, rc.column_name AS ref_column
    FROM {sys_foreign_key_columns} k
    JOIN {sys_foreign_keys} fk ON k.database = fk.database AND k.constraint_object_id = fk.constraint_object_id
    JOIN {sys_tables} t ON k.database = t.database AND k.parent_object_id = t.object_id
    JOIN {sys_schemas} s ON t.database = s.database AND t.schema_id = s.schema_id
    JOIN {sys_columns} c ON k.database = c.database AND k.parent_object_id = c.object_id AND k.parent_column_id = c.column_id
    JOIN {sys_tables} rt ON k.database = rt.database AND k.referenced_object_id = rt.object_id
    JOIN {sys_schemas} rs ON rt.database = rs.database AND rt.schema_id = rs.schema_id
    JOIN {sys_columns} rc ON k.database = rc.database AND k.referenced_object_id = rc.object_id AND k.referenced_column_id = rc.column_id
    WHERE s.schema_name NOT IN ('sys', 'INFORMATION_SCHEMA')"""


def foreign_keys(t):
    return sv.foreign_key_columns(
        t("sys_foreign_key_columns"), t("sys_foreign_keys"), t("sys_columns"), t("sys_tables"), t("sys_schemas")
    )


R.add("src_foreign_keys", FK_SQL, stage=("catalog_keyed",))(foreign_keys)

USAGE_SQL = """SELECT t.database, s.schema_name AS schema, t.table_name, MAX(last_user_seek) AS last_user_seek,
      MAX(last_user_scan) AS last_user_scan, MAX(last_user_lookup) AS last_user_lookup, MAX(last_user_update) AS last_user_update
    FROM {sys_tables} t JOIN {sys_schemas} s ON t.database = s.database AND t.schema_id = s.schema_id
    LEFT JOIN {sys_index_usage} u ON t.database = u.database AND t.object_id = u.object_id
    WHERE s.schema_name NOT IN ('sys', 'INFORMATION_SCHEMA')
    GROUP BY t.database, s.schema_name, t.table_name"""


def usage(t):
    return sv.index_usage(t("sys_tables"), t("sys_schemas"), t("sys_index_usage"))


R.add("src_index_usage", USAGE_SQL)(usage)


@R.add(
    "src_objects",
    """SELECT o.database, s.schema_name AS schema, o.object_name,
      CASE o.type WHEN 'P' THEN 'PROCEDURE' WHEN 'V' THEN 'VIEW' WHEN 'FN' THEN 'SCALAR_FUNCTION'
        WHEN 'IF' THEN 'INLINE_FUNCTION' WHEN 'TF' THEN 'TABLE_FUNCTION' WHEN 'TR' THEN 'TRIGGER' END AS object_type,
      m.definition, o.created_date, o.modified_date
    FROM {sys_objects} o JOIN {object_schemas} s ON o.database = s.database AND o.schema_id = s.schema_id
    LEFT JOIN {sys_modules} m ON o.database = m.database AND o.object_id = m.object_id
    WHERE o.type IN ('P', 'V', 'FN', 'IF', 'TF', 'TR') AND s.schema_name NOT IN ('sys', 'INFORMATION_SCHEMA')""",
)
def _(t):
    return sv.programmable_objects(t("sys_objects"), t("object_schemas"), t("sys_modules"))


@R.add(
    "src_proc_stats",
    """SELECT database, schema, object_name, execution_count, last_execution_time,
      total_worker_time // 1000 AS total_cpu_ms, total_elapsed_time // 1000 AS total_elapsed_ms,
      total_logical_reads, total_logical_writes,
      CASE WHEN execution_count > 0 THEN total_elapsed_time // execution_count // 1000 ELSE 0 END AS avg_duration_ms
    FROM {raw_proc_stats} WHERE schema IS NOT NULL""",
)
def _(t):
    return sv.procedure_stats(t("raw_proc_stats"))


@R.add(
    "src_query_store",
    """SELECT 'main' AS database, o.schema, o.object_name, CAST(SUM(r.count_executions) AS BIGINT) AS execution_count,
      MAX(r.last_execution_time) AS last_execution_time, ROUND(AVG(r.avg_duration) / 1000, 11) AS avg_duration_ms,
      ROUND(SUM(r.avg_cpu_time * r.count_executions) / 1000, 11) AS total_cpu_ms
    FROM {qs_queries} q JOIN {qs_plans} p ON q.query_id = p.query_id JOIN {qs_runtime} r ON p.plan_id = r.plan_id
    JOIN {qs_objects} o ON q.object_id = o.object_id
    WHERE q.object_id > 0 AND o.schema IS NOT NULL GROUP BY o.schema, o.object_name, q.object_id""",
)
def _(t):
    return rounded(sv.query_store_stats(t("qs_queries"), t("qs_plans"), t("qs_runtime"), t("qs_objects")), 11)


@R.add(
    "log_rollup_90d",
    f"""SELECT event_type AS object_name, COUNT(*) AS execution_count, MAX(ts) AS last_execution_time,
      ROUND(AVG(value + user_id + event_id % 10), 6) AS avg_duration_ms, COUNT(DISTINCT user_id) AS unique_users
    FROM events WHERE ts > TIMESTAMP '{DAY}' - INTERVAL 90 DAY GROUP BY event_type""",
)
def _(t):
    log = t("events").withColumn("rest", F.col("event_id") % 10)
    return rounded(
        sv.log_rollup(
            log, name="event_type", at="ts", user="user_id", durations=["value", "user_id", "rest"], reference=ts(DAY)
        )
    )


@R.add("src_dependencies", "SELECT * FROM {dependencies}")
def _(t):
    return sv.dependencies(t("dep_references"), t("dep_objects"))


@R.add("sink_roundtrip", f"SELECT {CATALOG_COLUMNS} FROM {{catalog_columns}}")
def _(t):
    cat = t("catalog_columns")
    return io.load_catalog(cat.sparkSession, written(cat)).select(*CATALOG_COLUMNS.split(", "))


@R.add(
    "scan_log_latest",
    """SELECT target, MAX(scanned_at) AS last_scan, COUNT(*) AS rows,
      (SELECT MAX(scanned_at) FROM {catalog_columns}) AS last_updated FROM {catalog_columns} GROUP BY target""",
    stage=("catalog_columns",),
)
def _(t):
    cat = t("catalog_columns")
    path = new_path(cat.sparkSession, "scan-log")
    early = cat.where(F.col("is_primary_key"))
    io.append_scan_log(io.scan_log_entries(early, F.col("scanned_at") - F.expr("interval 4000 days")), path)
    io.append_scan_log(io.scan_log_entries(cat), path)
    return io.scan_log_latest(cat.sparkSession.read.parquet(path))


@R.add(
    "export_json",
    """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","orders":' || n || '}' AS value
    FROM (SELECT r_regionkey, r_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name) x""",
)
def _(t):
    per_region = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_regionkey", "r_name").agg(F.count("*").alias("orders"))
    )
    path = new_path(per_region.sparkSession, "export")
    io.export(per_region, path, "json")
    return per_region.sparkSession.read.text(path)


def snapshots(t):
    cat = t("catalog_columns")
    root = new_path(cat.sparkSession, "snapshots")
    names: list[str] = []
    for rows, day, time in (
        (cat.where("target = 't0'"), "2024-01-30", "080000"), (cat.where("target <> 't2'"), "2024-01-31", "080000"),
        (cat, "2024-01-31", "093000"),
    ):
        names.append(io.snapshot_name(names, day, time))
        io.write_snapshot(rows, root, names[-1])
    return io.read_snapshots(cat.sparkSession, root)


@R.add(
    "snapshot_latest",
    f"SELECT '2024-01-31_093000' AS snapshot_id, {CATALOG_COLUMNS} FROM {{catalog_columns}}",
    stage=("catalog_columns",),
)
def _(t):
    return io.latest_snapshot(snapshots(t)).select("snapshot_id", *CATALOG_COLUMNS.split(", "))


@R.add(
    "snapshot_scans",
    """SELECT '2024-01-31' AS snapshot_id, target, MAX(row_count_estimate) AS "rows" FROM {catalog_columns} WHERE target <> 't2' GROUP BY target
    UNION ALL SELECT '2024-01-31_093000', target, MAX(row_count_estimate) FROM {catalog_columns} GROUP BY target""",
)
def _(t):
    cat = t("catalog_columns")
    scans = cat.groupBy("target").agg(F.lit("2024-01-31").cast("timestamp").alias("scanned_at"), F.max("row_count_estimate").alias("rows"))
    root = new_path(cat.sparkSession, "snapshots")
    io.write_snapshot(cat.where("target = 't0'"), root, "2024-01-30")
    io.write_snapshot(cat.where("target <> 't2'"), root, "2024-01-31", scans.where("target <> 't2'"))
    io.write_snapshot(cat, root, "2024-01-31_093000", scans)
    return io.read_snapshot_scans(cat.sparkSession, root).select("snapshot_id", "target", "rows")


@R.add(
    "snapshot_list",
    """SELECT id AS snapshot_id, COUNT(DISTINCT database || '.' || table_name) AS tables, COUNT(*) AS columns FROM (
      SELECT '2024-01-30' AS id, * FROM {catalog_columns} WHERE target = 't0' UNION ALL
      SELECT '2024-01-31' AS id, * FROM {catalog_columns} WHERE target <> 't2' UNION ALL
      SELECT '2024-01-31_093000' AS id, * FROM {catalog_columns}) s GROUP BY id""",
    stage=("catalog_columns",),
)
def _(t):
    return io.snapshot_list(snapshots(t))


@R.add("load_data", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    customers = t("customer")
    path = new_path(customers.sparkSession, "data") + ".csv"
    io.export(customers, path, "csv")
    # CSV types are inferred: small keys come back as int
    return io.load_data(customers.sparkSession, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


# --- assembly ---------------------------------------------------------------------------------------


@R.add(
    "fk_reference",
    f"""SELECT database, schema, table_name, column_name, ref_schema || '.' || ref_table || '.' || ref_column AS fk_references,
      true AS is_foreign_key FROM ({FK_SQL}) f""",
)
def _(t):
    return assemble.fk_reference(foreign_keys(t))


LAST_SQL = """GREATEST(last_user_seek, last_user_scan, last_user_lookup, last_user_update)"""


@R.add("last_modified", f"SELECT database, schema, table_name, {LAST_SQL} AS last_modified FROM ({USAGE_SQL}) u")
def _(t):
    return assemble.last_modified(usage(t))


ASSEMBLED = [
    "database", "schema", "table_name", "column_name", "data_type", "is_nullable", "is_primary_key",
    "is_foreign_key", "fk_references", "row_count_estimate", "last_modified", "scanned_at",
]


def assembled(t):
    cat = assemble.assemble_catalog(
        sv.base_table_columns(t("info_columns"), t("info_tables")),
        sv.table_row_counts(t("sys_tables"), t("sys_schemas"), t("sys_partitions")),
        primary_keys(t), foreign_keys(t), usage(t), scanned_at=ts(DAY),
    )
    return cat.select(*ASSEMBLED)


@R.add(
    "assemble_catalog",
    f"""SELECT c.database, c.schema, c.table_name, c.column_name, c.data_type, c.is_nullable = 'YES' AS is_nullable,
      pk.key_name IS NOT NULL AS is_primary_key, fk.fk_name IS NOT NULL AS is_foreign_key,
      COALESCE(fk.ref_schema || '.' || fk.ref_table || '.' || fk.ref_column, '') AS fk_references,
      COALESCE(r.n, 0) AS row_count_estimate, {LAST_SQL} AS last_modified, TIMESTAMP '{DAY}' AS scanned_at
    FROM {{info_columns}} c
    JOIN {{info_tables}} b ON c.database = b.database AND c.schema = b.schema AND c.table_name = b.table_name AND b.table_type = 'BASE TABLE'
    LEFT JOIN (SELECT t.database, t.table_name, CAST(SUM(p.rows) AS BIGINT) AS n FROM {{sys_tables}} t
      JOIN {{sys_partitions}} p ON t.database = p.database AND t.object_id = p.object_id AND p.index_id IN (0, 1)
      WHERE t.type = 'U' AND t.schema_id = 1 GROUP BY t.database, t.table_name) r
      ON c.database = r.database AND c.table_name = r.table_name
    LEFT JOIN ({PK_SQL}) pk ON c.database = pk.database AND c.schema = pk.schema AND c.table_name = pk.table_name AND c.column_name = pk.column_name
    LEFT JOIN ({FK_SQL}) fk ON c.database = fk.database AND c.schema = fk.schema AND c.table_name = fk.table_name AND c.column_name = fk.column_name
    LEFT JOIN ({USAGE_SQL}) u ON c.database = u.database AND c.schema = u.schema AND c.table_name = u.table_name
    WHERE c.schema NOT IN ('sys', 'INFORMATION_SCHEMA')""",
    stage=("catalog_keyed",),
)
def _(t):
    return assembled(t)


@R.add(
    "union_databases",
    """SELECT 'prod' AS target, 's1' AS server, database, table_name, column_name, is_nullable, row_count_estimate, null_rate
      FROM {catalog_columns} WHERE target = 't0'
    UNION ALL SELECT 'prod', 's1', database, table_name, column_name, is_nullable, row_count_estimate, NULL
      FROM {catalog_columns} WHERE target <> 't0'""",
)
def _(t):
    cat = t("catalog_columns")
    profiled = cat.where("target = 't0'")
    plain = cat.where("target <> 't0'").drop("null_rate", "null_count", "distinct_count", "profiled_rows")
    plain = plain.withColumn("is_nullable", F.col("is_nullable").cast("int"))
    out = assemble.union_databases([profiled, plain], target="prod", server="s1")
    return out.select(
        "target", "server", "database", "table_name", "column_name", "is_nullable", "row_count_estimate", "null_rate"
    )


@R.add(
    "replace_by_target",
    """SELECT target, database, table_name, column_name, row_count_estimate FROM {catalog_columns} WHERE target NOT IN ('t1', 't2')
    UNION ALL SELECT target, database, table_name, column_name, row_count_estimate + 1 FROM {catalog_columns}
      WHERE target = 't1' AND is_primary_key""",
)
def _(t):
    cat = t("catalog_columns")
    new = cat.where("target = 't1' and is_primary_key").withColumn("row_count_estimate", F.col("row_count_estimate") + 1)
    scanned = cat.where("target in ('t1', 't2')").select("target")
    return assemble.replace_by_target(cat, new, scanned).select(
        "target", "database", "table_name", "column_name", "row_count_estimate"
    )


@R.add(
    "replace_targets",
    f"""SELECT {CATALOG_COLUMNS} FROM {{catalog_columns}} WHERE target NOT IN ('t1', 't2')
    UNION ALL SELECT {CATALOG_COLUMNS} FROM {{catalog_columns}} WHERE target = 't1' AND is_primary_key""",
    stage=("catalog_columns",),
)
def _(t):
    cat = t("catalog_columns")
    path = new_path(cat.sparkSession, "catalog")
    io.write_catalog(cat, path)
    io.replace_targets(cat.where("target = 't1' and is_primary_key"), path, ["t1", "t2"])
    return io.load_catalog(cat.sparkSession, path).select(*CATALOG_COLUMNS.split(", "))


# --- profiles ---------------------------------------------------------------------------------------


def profile_sql(table: str, columns: list[str], expressions: dict[str, str] | None = None) -> str:
    parts = []
    for c in columns:
        x = (expressions or {}).get(c, c)
        parts.append(
            f"""SELECT '{c}' AS column_name, COUNT(*) AS profiled_rows, COUNT(*) - COUNT({x}) AS null_count,
            COUNT(DISTINCT {x}) AS distinct_count, ROUND((COUNT(*) - COUNT({x})) / COUNT(*), 4) AS null_rate FROM {table}"""
        )
    return " UNION ALL ".join(parts)


LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@R.add("profile_full", profile_sql("lineitem", LINEITEM, {"l_linenumber": "NULLIF(l_linenumber, 7)"}))
def _(t):
    rows = t("lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(7)))
    return rounded(profile.column_profiles(rows), 4)


@R.add(
    "profile_approx",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS profiled_rows, true AS near_exact FROM lineitem" for c in LINEITEM),
)
def _(t):
    """The sketched counts, told apart only by lying within a tenth of the exact ones."""
    lines = t("lineitem")
    exact = profile.column_profiles(lines).select("column_name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.1
    sketched = profile.column_profiles(lines, approximate=True, extremes=True)
    return sketched.join(exact, "column_name").select("column_name", "profiled_rows", near.alias("near_exact"))


@R.add(
    "profile_sampled",
    profile_sql(
        "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) s",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ),
)
def _(t):
    return rounded(profile.column_profiles(t("orders"), sample_size=1000, order=["o_orderkey"]), 4)


@R.add(
    "profile_join",
    """SELECT database, schema, table_name, column_name,
      CASE WHEN profiled_rows > 1000 THEN null_count ELSE 0 END AS null_count,
      CASE WHEN profiled_rows > 1000 THEN null_rate ELSE 0.0 END AS null_rate,
      CASE WHEN profiled_rows > 1000 THEN distinct_count ELSE 0 END AS distinct_count,
      CASE WHEN profiled_rows > 1000 THEN profiled_rows ELSE 0 END AS profiled_rows
    FROM {catalog_columns}""",
)
def _(t):
    cat = t("catalog_columns")
    known = cat.where("profiled_rows > 1000")
    return assemble.attach_profile(cat.select(*COLUMN_KEY), known)


@R.add(
    "profile_db_rollup",
    """SELECT database, ROUND(AVG(null_rate), 9) AS avg_null_rate, COUNT(DISTINCT table_name) AS tables
    FROM {catalog_columns} GROUP BY database""",
)
def _(t):
    return rounded(profile.profile_by_database(t("catalog_columns")), 9)


# --- search -----------------------------------------------------------------------------------------

RESULT = ", ".join(search.RESULT_COLUMNS)


@R.add(
    "search_catalog",
    f"""SELECT {RESULT} FROM (SELECT *, s + CASE WHEN is_primary_key THEN 2 ELSE 0 END + CASE WHEN is_foreign_key THEN 1 ELSE 0 END AS relevance
      FROM (SELECT *, 3 * CAST(contains(lower(table_name), 'order') AS INT) + 2 * CAST(contains(lower(column_name), 'order') AS INT)
        + CAST(contains(lower(database), 'order') AS INT) + 3 * CAST(contains(lower(table_name), 'db1') AS INT)
        + 2 * CAST(contains(lower(column_name), 'db1') AS INT) + CAST(contains(lower(database), 'db1') AS INT) AS s
        FROM {{catalog_columns}}) x WHERE s > 0) y
    ORDER BY relevance DESC, row_count_estimate DESC, database, schema, table_name, column_name LIMIT 20""",
)
def _(t):
    return search.search_catalog(t("catalog_columns"), " Order db1 ")


@R.add(
    "search_documents",
    """SELECT doc_id, relevance FROM (SELECT doc_id, 3 * CAST(contains(lower(text), 'the') AS INT) + 3 * CAST(contains(lower(text), 'web') AS INT)
      + 2 * CAST(contains(lower(source), 'the') AS INT) + 2 * CAST(contains(lower(source), 'web') AS INT)
      + CAST(contains(lower(lang), 'the') AS INT) + CAST(contains(lower(lang), 'web') AS INT) AS relevance FROM documents) x
    WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 50""",
)
def _(t):
    found = search.ranked_search(
        t("documents"), ["the", "web", ""], weights={"text": 3, "source": 2, "lang": 1},
        tie_break=[F.col("doc_id")], top_n=50,
    )
    return found.select("doc_id", "relevance")


@R.add(
    "search_batch",
    """SELECT query_id, database, schema, table_name, column_name, row_count_estimate, CAST(relevance AS BIGINT) AS relevance,
      CAST(position AS INT) AS position FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY relevance DESC, row_count_estimate DESC, database, schema, table_name, column_name) AS position
      FROM (SELECT query_id, c.*, s + CASE WHEN is_primary_key THEN 2 ELSE 0 END + CASE WHEN is_foreign_key THEN 1 ELSE 0 END AS relevance
        FROM (SELECT query_id, database, schema, table_name, column_name, SUM(3 * CAST(contains(lower(table_name), w) AS INT)
            + 2 * CAST(contains(lower(column_name), w) AS INT) + CAST(contains(lower(database), w) AS INT)) AS s
          FROM {catalog_columns} JOIN {words} ON contains(lower(table_name), w) OR contains(lower(column_name), w) OR contains(lower(database), w)
          GROUP BY ALL) h JOIN {catalog_columns} c USING (database, schema, table_name, column_name)) r) p
    WHERE position <= 20""",
    {"words": """SELECT n_nationkey AS query_id, unnest(string_split(lower(CASE n_regionkey WHEN 0 THEN 'Order type' WHEN 1 THEN 'customer ID'
        WHEN 2 THEN 'db77 Log' WHEN 3 THEN 'Amount' ELSE n_name END), ' ')) AS w FROM nation"""},
)
def _(t):
    text = (
        F.when(F.col("n_regionkey") == 0, "Order type").when(F.col("n_regionkey") == 1, "customer  ID ")
        .when(F.col("n_regionkey") == 2, "db77 Log").when(F.col("n_regionkey") == 3, "Amount").otherwise(F.col("n_name"))
    )
    queries = t("nation").select(F.col("n_nationkey").alias("query_id"), text.alias("text"))
    return search.search_batch(
        t("catalog_columns"), queries, row_key=COLUMN_KEY, weights=search.NAME_WEIGHTS, bonuses=search.KEY_BONUSES
    )


@R.add(
    "table_details",
    """SELECT database, schema, table_name, row_count_estimate, column_name, data_type, is_nullable, is_primary_key,
      is_foreign_key, fk_references FROM {catalog_columns} WHERE database = 'db7' AND schema = 'dbo' AND table_name = 'Customer'""",
)
def _(t):
    return search.table_details(t("catalog_columns"), "db7", "dbo", "Customer")


@R.add(
    "table_summary",
    """SELECT database || '.' || schema || '.' || table_name AS full_name, format('{:,}', row_count_estimate) AS rows, column_name, data_type,
      CASE WHEN is_primary_key THEN 'yes' ELSE '' END AS pk, CASE WHEN is_foreign_key THEN 'yes' ELSE '' END AS fk,
      fk_references AS references FROM {catalog_columns} WHERE database = 'db9' AND table_name = 'OrderItem'""".replace(
        "AS references", 'AS "references"'
    ),
)
def _(t):
    return search.table_summary(t("catalog_columns"), "db9", "OrderItem")


@R.add(
    "join_paths_outbound",
    """SELECT DISTINCT database, table_name, column_name, fk_references FROM {catalog_columns}
    WHERE table_name = 'OrderItem' AND is_foreign_key""",
)
def _(t):
    return search.join_paths_outbound(t("catalog_columns"), "OrderItem")


@R.add(
    "join_paths_inbound",
    """SELECT DISTINCT database, table_name, column_name, fk_references FROM {catalog_columns}
    WHERE string_split(fk_references, '.')[-2] = 'Customer'""",
)
def _(t):
    return search.join_paths_inbound(t("catalog_columns"), "Customer")


@R.add(
    "join_paths_inbound_substring",
    """SELECT DISTINCT database, table_name, column_name, fk_references FROM {catalog_columns}
    WHERE contains(fk_references, 'ustomer')""",
)
def _(t):
    return search.join_paths_inbound(t("catalog_columns"), "ustomer", mode="substring")


@R.add(
    "catalog_status",
    """SELECT CASE WHEN a < 7 THEN 'OK' ELSE 'STALE' END AS status, a AS age_days, targets, databases, tables, columns FROM (
      SELECT CAST(FLOOR(date_diff('second', MAX(scanned_at), TIMESTAMP '2003-01-01 00:00:00') / 86400) AS BIGINT) AS a,
        COUNT(DISTINCT target) AS targets, COUNT(DISTINCT database) AS databases,
        COUNT(DISTINCT database || '.' || schema || '.' || table_name) AS tables, COUNT(*) AS columns FROM {catalog_columns}) x""",
)
def _(t):
    cat = t("catalog_columns")
    last = cat.agg(F.max("scanned_at")).first()[0]
    return search.catalog_status(cat, F.lit(last), ts("2003-01-01 00:00:00"))


@R.add(
    "search_display",
    """SELECT substr(database || '.' || table_name, 1, 30) AS "table", substr(column_name, 1, 20) AS "column", substr(data_type, 1, 10) AS type,
      CASE WHEN is_primary_key AND is_foreign_key THEN 'PK,FK' WHEN is_primary_key THEN 'PK' WHEN is_foreign_key THEN 'FK' ELSE '-' END AS keys,
      CASE WHEN fk_references = '' THEN '-' WHEN length(fk_references) > 30 THEN substr(fk_references, 1, 27) || '...' ELSE fk_references END AS fk_reference,
      CASE WHEN row_count_estimate <> 0 THEN format('{:,}', row_count_estimate) ELSE '-' END AS rows, 7 AS score
    FROM {catalog_columns}""",
)
def _(t):
    return search.display(t("catalog_columns").withColumn("relevance", F.lit(7)))


# --- roll-ups ---------------------------------------------------------------------------------------


@R.add(
    "overview_counts",
    """SELECT COUNT(DISTINCT target) AS targets, COUNT(DISTINCT database) AS databases,
      COUNT(DISTINCT database || '.' || schema || '.' || table_name) AS tables, COUNT(*) AS columns FROM {catalog_columns}""",
)
def _(t):
    return rollup.overview_counts(t("catalog_columns"))


@R.add(
    "db_summary_max",
    """SELECT target, database, COUNT(DISTINCT schema || '.' || table_name) AS tables, COUNT(*) AS columns,
      MAX(row_count_estimate) AS max_rows FROM {catalog_columns} GROUP BY target, database""",
)
def _(t):
    return rollup.db_summary_max(t("catalog_columns"))


@R.add(
    "db_summary_sum",
    """SELECT target, database, COUNT(DISTINCT schema || '.' || table_name) AS tables, COUNT(*) AS columns,
      CAST(SUM(row_count_estimate) AS BIGINT) AS total_rows FROM {catalog_columns} GROUP BY target, database""",
)
def _(t):
    return rollup.db_summary_sum(t("catalog_columns"))


@R.add(
    "db_summary_sum_tables",
    """SELECT target, database, COUNT(*) AS tables, CAST(SUM(c) AS BIGINT) AS columns, CAST(SUM(r) AS BIGINT) AS total_rows FROM (
      SELECT target, database, schema, table_name, COUNT(*) AS c, MAX(row_count_estimate) AS r FROM {catalog_columns}
      GROUP BY target, database, schema, table_name) x GROUP BY target, database""",
)
def _(t):
    return rollup.db_summary_sum(t("catalog_columns"), per_column=False)


TOP_SQL = """SELECT DISTINCT database, schema, table_name, row_count_estimate FROM {catalog_columns}%s
    ORDER BY row_count_estimate DESC, database, schema, table_name LIMIT 20"""


@R.add("large_tables", TOP_SQL % " WHERE row_count_estimate > 1000000")
def _(t):
    return rollup.top_tables(t("catalog_columns"), above=rollup.LARGE_TABLE_ROWS)


@R.add("top_tables", TOP_SQL % "")
def _(t):
    return rollup.top_tables(t("catalog_columns"))


@R.add(
    "key_relationships",
    """SELECT DISTINCT database, table_name, column_name, fk_references FROM {catalog_columns} WHERE is_foreign_key AND fk_references <> ''
    ORDER BY database, table_name, column_name, fk_references LIMIT 30""",
)
def _(t):
    return rollup.key_relationships(t("catalog_columns"))


@R.add(
    "fk_by_table",
    """SELECT database, table_name, COUNT(*) AS fk_count, array_to_string(list_sort(list(r))[1:3], ', ')
      || CASE WHEN COUNT(*) > 3 THEN ' (+' || (COUNT(*) - 3) || ' more)' ELSE '' END AS references_text
    FROM (SELECT target AS database, table_name, column_name || ' -> ' || database || '.' || fk_references AS r
      FROM {catalog_columns} WHERE is_foreign_key) x GROUP BY database, table_name ORDER BY database, table_name LIMIT 30""",
)
def _(t):
    cat = t("catalog_columns").withColumn("fk_references", F.concat_ws(".", "database", "fk_references"))
    return rollup.fk_by_table(cat.withColumn("database", F.col("target")))


@R.add("target_filter", "SELECT target, database, table_name, column_name FROM {catalog_columns} WHERE target = 't2'")
def _(t):
    return rollup.target_filter(t("catalog_columns"), "t2").select("target", "database", "table_name", "column_name")
