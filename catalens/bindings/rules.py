"""Classification, knowledge graph and workload statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import default_rules
from ..operators import classify, graph
from ..operators import usage as use
from ..plans.materialize import new_path
from ..plans.schemas import TABLE_KEY
from .base import Registry, rounded

R = Registry()
REFERENCE = "2002-06-01 00:00:00"

RULES = default_rules()
RULES["domains"] = [
    {"id": "SalesDomain", "label": "Sales Domain", "priority": 3, "database_affinity": ["db5", "db12", "db77"],
     "description": "Every table of the sales databases, whatever its name, beyond audit and reference tables",
     "table_patterns": ["Order"]},
    {"id": "EmptyDomain", "label": "Empty Domain", "priority": 4, "description": "No table", "table_patterns": ["*Nothing*"]},
    *RULES["domains"],
]
RULES["metrics"] = [
    {"id": "order_value", "label": "Order value", "formula": "SUM(TotalAmount)", "observation_window_days": 365,
     "source_columns": ["db3.dbo.Order.TotalAmount", "db3.dbo.Order.NoSuchColumn", "db8.dbo.OrderItem.ItemCount"],
     "conditions": [{"field": "IsActive", "operator": "==", "value": "1"}]},
]
RULES["core_entities"] = [
    {"table": "db3.dbo.Customer", "label": "Customer", "is_aggregate_root": True, "key_column": "OrderID"},
    {"table": "db3.dbo.Order", "label": "Order", "key_column": "Missing", "belongs_to": "db3.dbo.Customer"},
    {"table": "db3.dbo.Nowhere", "label": "Nowhere", "key_column": "ID"},
]

# the same rules written out for the SQL side
DOMAIN_SQL = """CASE
    WHEN regexp_matches(table_name, '(?i)(History$|Log$|^Audit|^Error|Archive$)') THEN 'AuditDomain'
    WHEN regexp_matches(table_name, '(?i)(Type$|Status$|Code$|Config$|Lookup$)') THEN 'ReferenceDomain'
    WHEN database IN ('db5', 'db12', 'db77') THEN 'SalesDomain'
    WHEN contains(lower(table_name), 'nothing') THEN 'EmptyDomain'
    ELSE 'UncategorizedDomain' END"""
ROLE_SQL = """CASE
    WHEN regexp_matches(column_name, '(?i)(ID|IDSeq|Id|Code|Key|Guid|UUID)') THEN 'Identifier'
    WHEN regexp_matches(column_name, '(?i)(Date|Time|At|On|Created|Updated|Modified)') AND lower(data_type) IN ('datetime', 'datetime2', 'date', 'timestamp') THEN 'Timestamp'
    WHEN regexp_matches(column_name, '(?i)(Amount|Price|Cost|Fee|Charge|Total|Revenue)') AND lower(data_type) IN ('money', 'decimal', 'numeric') THEN 'Monetary'
    WHEN regexp_matches(column_name, '(?i)(Count|Qty|Quantity|Number|Units)') AND lower(data_type) IN ('int', 'bigint', 'smallint') THEN 'Quantity'
    WHEN regexp_matches(column_name, '(?i)(Is|Has|Flag|Enabled|Active)') AND lower(data_type) IN ('bit', 'boolean', 'tinyint') THEN 'BooleanFlag'
    WHEN regexp_matches(column_name, '(?i)(Status|State|Stage)') THEN 'StatusIndicator'
    WHEN regexp_matches(column_name, '(?i)(Percent|Pct|Rate|Ratio)') THEN 'Percentage'
    WHEN regexp_matches(column_name, '(?i)(Name|Desc|Description|Title|Label|Comment|Notes)') AND lower(data_type) IN ('varchar', 'nvarchar', 'text', 'ntext') THEN 'Description'
    ELSE 'Unclassified' END"""
NODES = {
    "nodes": f"""SELECT *, 'app:' || database || '.' || table_name || '.' || column_name AS id, {ROLE_SQL} AS semantic_role,
      profiled_rows > 0 AS p FROM {{catalog_columns}}""",
    "reviewed": """SELECT *, concat_ws(',', CASE WHEN semantic_role = 'Unclassified' THEN 'unclassified_role' END,
        CASE WHEN null_rate > 0.5 THEN 'high_null_rate' END) AS reasons FROM {nodes}""",
    "facts": f"""SELECT database, schema, table_name, {DOMAIN_SQL} AS domain, MAX(row_count_estimate) AS row_count, COUNT(*) AS column_count,
        COUNT(*) FILTER (WHERE reasons <> '') AS columns_needing_review FROM {{reviewed}} GROUP BY database, schema, table_name""",
}


def nodes(t):
    return graph.column_nodes(t("catalog_columns"), RULES)


def facts(t):
    return graph.entity_facts(nodes(t), RULES)


# --- classification ---------------------------------------------------------------------------------


@R.add("domain_classify", f"SELECT DISTINCT database, schema, table_name, {DOMAIN_SQL} AS domain FROM {{catalog_columns}}")
def _(t):
    return classify.classify_tables(t("catalog_columns"), RULES["domains"])


@R.add("role_classify", f"SELECT database, table_name, column_name, data_type, {ROLE_SQL} AS semantic_role FROM {{catalog_columns}}")
def _(t):
    return t("catalog_columns").select(
        "database", "table_name", "column_name", "data_type",
        classify.role_of(RULES["semantic_roles"]).alias("semantic_role"),
    )


@R.add(
    "relationship_type",
    """SELECT database, table_name, column_name,
      CASE WHEN column_name GLOB '*CustomerID*' THEN 'belongsToCustomer' WHEN column_name GLOB '*OrderID*' THEN 'partOfOrder' ELSE 'references' END AS relationship_type,
      CASE WHEN column_name GLOB '*CustomerID*' THEN 'hasCustomer' WHEN column_name GLOB '*OrderID*' THEN 'hasOrderItem' ELSE 'referencedBy' END AS inverse_type
    FROM {catalog_columns}""",
)
def _(t):
    forward, backward = classify.relationship_of(RULES["relationship_types"])
    return t("catalog_columns").select(
        "database", "table_name", "column_name", forward.alias("relationship_type"), backward.alias("inverse_type")
    )


LISTED = " UNION ALL ".join(
    f"SELECT '{d['id']}' AS domain, '{d['label']}' AS label, '{d['description']}' AS description" for d in RULES["domains"]
)


@R.add(
    "domain_counts",
    f"""SELECT l.domain, label, description, COALESCE(n, 0) AS table_count FROM ({LISTED}) l LEFT JOIN (
      SELECT domain, COUNT(*) AS n FROM (SELECT DISTINCT database, table_name, {DOMAIN_SQL} AS domain FROM {{catalog_columns}}) x
      GROUP BY domain) c ON l.domain = c.domain""",
)
def _(t):
    return classify.domain_counts(t("catalog_columns"), RULES["domains"])


@R.add(
    "source_stats",
    """SELECT COUNT(*) AS total_columns, COUNT(DISTINCT database || '.' || schema || '.' || table_name) AS total_tables,
      COUNT(DISTINCT database) AS total_databases, COUNT(*) FILTER (WHERE is_foreign_key) AS total_foreign_keys FROM {catalog_columns}""",
)
def _(t):
    return classify.source_stats(t("catalog_columns"))


# --- graph ------------------------------------------------------------------------------------------


@R.add(
    "column_nodes",
    """SELECT id, data_type, semantic_role, is_nullable, CASE WHEN is_primary_key THEN true END AS is_primary_key,
      CASE WHEN is_foreign_key THEN true END AS is_foreign_key, CASE WHEN is_foreign_key THEN NULLIF(fk_references, '') END AS "references",
      CASE WHEN p THEN null_rate END AS null_rate, CASE WHEN p THEN null_count END AS null_count,
      CASE WHEN p THEN distinct_count END AS distinct_count, CASE WHEN p THEN profiled_rows END AS profiled_rows FROM {nodes}""",
    NODES,
)
def _(t):
    return nodes(t).select(
        "id", "data_type", "semantic_role", "is_nullable", "is_primary_key", "is_foreign_key", "references",
        "null_rate", "null_count", "distinct_count", "profiled_rows",
    )


@R.add(
    "column_review_status",
    """SELECT id, reasons, CASE WHEN reasons <> '' THEN 'needs_review' ELSE 'auto_classified' END AS review_status FROM {reviewed}""",
    NODES,
)
def _(t):
    return nodes(t).select("id", F.concat_ws(",", "review_reasons").alias("reasons"), "review_status")


@R.add(
    "entities",
    """SELECT 'app:' || f.database || '.' || f.table_name AS id, f.database, f.schema, f.table_name, 'app:' || domain AS belongs_to_domain,
      'Table,' || replace(domain, 'Domain', '') || 'Entity' AS types, row_count, column_count, columns_needing_review, 0 AS part,
      string_agg(column_name || ':' || semantic_role, ',' ORDER BY column_name) AS columns
    FROM {facts} f JOIN {reviewed} r ON f.database = r.database AND f.schema = r.schema AND f.table_name = r.table_name
    GROUP BY ALL""",
    NODES,
)
def _(t):
    listed = F.transform("has_column", lambda c: F.concat(c["column_name"], F.lit(":"), c["semantic_role"]))
    return graph.entities(nodes(t), RULES).select(
        "id", *TABLE_KEY, "belongs_to_domain", F.concat_ws(",", "types").alias("types"), "row_count", "column_count",
        "columns_needing_review", "part", F.array_join(listed, ",").alias("columns"),
    )


@R.add(
    "entities_in_parts",
    """SELECT 'app:' || f.database || '.' || f.table_name AS id, f.schema, row_count, column_count, column_name, semantic_role
    FROM {facts} f JOIN {reviewed} r ON f.database = r.database AND f.schema = r.schema AND f.table_name = r.table_name""",
    NODES,
)
def _(t):
    # every table's columns over up to 16 rows, so that no task holds a wide table; nothing is lost between the parts
    parts = graph.entities(nodes(t), RULES, parts=16)
    listed = parts.select("id", "schema", "row_count", "column_count", F.explode("has_column").alias("c"))
    return listed.select(
        "id", "schema", "row_count", "column_count", F.col("c.column_name").alias("column_name"),
        F.col("c.semantic_role").alias("semantic_role"),
    )


@R.add(
    "entity_review_status",
    """SELECT database, schema, table_name, concat_ws(',', CASE WHEN domain = 'UncategorizedDomain' THEN 'unclassified_domain' END,
        CASE WHEN columns_needing_review > column_count * 0.3 THEN 'many_unclassified_columns' END) AS reasons,
      CASE WHEN domain = 'UncategorizedDomain' OR columns_needing_review > column_count * 0.3 THEN 'needs_review' ELSE 'auto_classified' END AS review_status
    FROM {facts}""",
    NODES,
)
def _(t):
    return facts(t).select(*TABLE_KEY, F.concat_ws(",", "review_reasons").alias("reasons"), "review_status")


EDGES_SQL = """SELECT 'app:rel_' || database || '_' || table_name || '_' || column_name AS id,
      CASE WHEN column_name GLOB '*CustomerID*' THEN 'belongsToCustomer' WHEN column_name GLOB '*OrderID*' THEN 'partOfOrder' ELSE 'references' END AS relationship_type,
      CASE WHEN column_name GLOB '*CustomerID*' THEN 'hasCustomer' WHEN column_name GLOB '*OrderID*' THEN 'hasOrderItem' ELSE 'referencedBy' END AS inverse_type,
      'app:' || database || '.' || table_name || '.' || column_name AS "from", 'app:' || fk_references AS "to",
      'app:' || database || '.' || string_split(fk_references, '.')[-2] || '.' || string_split(fk_references, '.')[-1] AS to_resolved,
      'app:' || database || '.' || table_name AS from_table, fk_references AS to_reference
    FROM {catalog_columns} WHERE is_foreign_key AND fk_references <> ''"""


@R.add("relationships", EDGES_SQL)
def _(t):
    return graph.relationships(t("catalog_columns"), RULES)


REVIEW_DOMAIN = """SELECT 'app:' || database || '.' || table_name AS id, database || '.' || table_name AS "table", row_count,
      'Table not classified into any business domain' AS reason, 'Review table purpose and assign to appropriate domain' AS suggested_action
    FROM {facts} WHERE domain = 'UncategorizedDomain'"""
REVIEW_UNCLASSIFIED = """SELECT id, column_name AS "column", table_name AS "table", data_type, 'No semantic role pattern matched' AS reason,
      'Add a pattern to the rule file or classify manually' AS suggested_action FROM {nodes} WHERE semantic_role = 'Unclassified'"""
REVIEW_NULL = """SELECT id, column_name AS "column", table_name AS "table", null_rate, 'Column is ' || CAST(round_even(null_rate * 100, 0) AS INT) || '% null' AS reason,
      'Verify if column is deprecated or has data quality issues' AS suggested_action FROM {nodes} WHERE p AND null_rate > 0.5"""
REVIEW_LOW = """SELECT id, column_name AS "column", table_name AS "table", distinct_count, semantic_role AS current_role,
      'Only ' || distinct_count || ' distinct values - may be a code/status field' AS reason,
      'Consider reclassifying as Code or StatusIndicator' AS suggested_action
    FROM {nodes} WHERE profiled_rows > 100 AND distinct_count > 0 AND distinct_count < 20
      AND semantic_role NOT IN ('BooleanFlag', 'StatusIndicator', 'Code')"""


@R.add("review_domain", REVIEW_DOMAIN, NODES)
def _(t):
    return graph.review_domain(facts(t))


@R.add("review_unclassified", REVIEW_UNCLASSIFIED, NODES)
def _(t):
    return graph.review_unclassified(nodes(t))


@R.add("review_high_null", REVIEW_NULL, NODES)
def _(t):
    return graph.review_high_null(nodes(t))


@R.add("review_low_cardinality", REVIEW_LOW, NODES)
def _(t):
    return graph.review_low_cardinality(nodes(t))


@R.add(
    "review_summary",
    f"""SELECT COALESCE(category, 'total') AS category, CAST(SUM(items) AS BIGINT) AS items FROM (
      SELECT 'domainReview' AS category, COUNT(*) AS items FROM ({REVIEW_DOMAIN}) a
      UNION ALL SELECT 'unclassifiedColumns', COUNT(*) FROM ({REVIEW_UNCLASSIFIED}) b
      UNION ALL SELECT 'highNullRateColumns', COUNT(*) FROM ({REVIEW_NULL}) c
      UNION ALL SELECT 'lowCardinalityColumns', COUNT(*) FROM ({REVIEW_LOW}) d) x GROUP BY ROLLUP (category)""",
    NODES,
)
def _(t):
    return graph.review_summary(nodes(t), facts(t))


@R.add(
    "metric_nodes",
    """SELECT 'app:metric:order_value' AS id, 'Order value' AS label, '' AS description, 'SUM(TotalAmount)' AS formula, s AS source_column,
      data_type, data_type IS NOT NULL AS resolved, 'IsActive == 1' AS conditions, 365 AS observation_window_days, CAST(NULL AS VARCHAR) AS notes
    FROM (SELECT unnest(['db3.dbo.Order.TotalAmount', 'db3.dbo.Order.NoSuchColumn', 'db8.dbo.OrderItem.ItemCount']) AS s) m
    LEFT JOIN {catalog_columns} c ON s = database || '.' || schema || '.' || table_name || '.' || column_name""",
)
def _(t):
    return graph.metric_nodes(t("catalog_columns"), RULES)


@R.add(
    "core_entities",
    f"""SELECT 'app:core:' || w.name AS id, label, '' AS description, w.name AS "table", key_column, root AS is_aggregate_root, belongs_to,
      row_count, domain, COALESCE(key_found, false) AS key_found
    FROM (VALUES ('db3.dbo.Customer', 'Customer', 'OrderID', true, NULL), ('db3.dbo.Order', 'Order', 'Missing', false, 'app:core:db3.dbo.Customer'),
      ('db3.dbo.Nowhere', 'Nowhere', 'ID', false, NULL)) w(name, label, key_column, root, belongs_to)
    LEFT JOIN (SELECT database || '.' || schema || '.' || table_name AS name, {DOMAIN_SQL} AS domain, MAX(row_count_estimate) AS row_count,
        bool_or(column_name = CASE table_name WHEN 'Customer' THEN 'OrderID' ELSE 'Missing' END) AS key_found
      FROM {{catalog_columns}} WHERE database = 'db3' GROUP BY database, schema, table_name) f ON w.name = f.name""",
)
def _(t):
    return graph.core_entities(t("catalog_columns"), RULES)


@R.add(
    "ontology_json",
    """SELECT 'Entity' AS type, COUNT(*) AS documents FROM {facts}
    UNION ALL SELECT 'Column', COUNT(*) FROM {nodes}
    UNION ALL SELECT 'Relationship', COUNT(*) FROM {catalog_columns} WHERE is_foreign_key""",
    NODES,
    stage=("catalog_columns",),
)
def _(t):
    cat = t("catalog_columns")
    path = new_path(cat.sparkSession, "graph")
    graph.write_graph(cat, RULES, path)
    back = cat.sparkSession.read.option("basePath", path).text(path)
    readable = back.where(F.get_json_object("value", "$['@id']").isNotNull())
    return readable.groupBy("type").agg(F.count("*").alias("documents"))


@R.add(
    "ontology_documents",
    """SELECT 'Column' AS type, id, id AS doc_id, semantic_role AS role, CAST(CASE WHEN p THEN distinct_count END AS VARCHAR) AS distinct_count FROM {nodes}
    UNION ALL SELECT 'Entity', 'app:' || database || '.' || table_name, 'app:' || database || '.' || table_name, NULL, NULL FROM {facts}
    UNION ALL SELECT 'Relationship', 'app:rel_' || database || '_' || table_name || '_' || column_name,
      'app:rel_' || database || '_' || table_name || '_' || column_name, NULL, NULL FROM {catalog_columns} WHERE is_foreign_key""",
    NODES,
)
def _(t):
    field = lambda name: F.get_json_object("document", f"$['{name}']")
    return graph.graph_documents(t("catalog_columns"), RULES).select(
        "type", "id", field("@id").alias("doc_id"), field("semanticRole").alias("role"),
        field("distinctCount").alias("distinct_count"),
    )


@R.add("columns_by_role", "SELECT id, database, schema, table_name, column_name, data_type FROM {nodes} WHERE semantic_role = 'Monetary'", NODES)
def _(t):
    return graph.columns_by_role(nodes(t), "Monetary")


@R.add(
    "ontology_sections",
    f"""SELECT 'Root' AS section, 'app:root' AS id, concat_ws(':', COUNT(*), COUNT(DISTINCT database || '.' || schema || '.' || table_name),
        COUNT(DISTINCT database), COUNT(*) FILTER (WHERE is_foreign_key), '2002-06-01T00:00:00', 'urn:catalog#', '@set') AS detail FROM {{catalog_columns}}
    UNION ALL SELECT 'Domain', 'app:' || l.domain, label || ':' || COALESCE(n, 0) FROM ({LISTED}) l LEFT JOIN (
      SELECT domain, COUNT(*) AS n FROM (SELECT DISTINCT database, table_name, {DOMAIN_SQL} AS domain FROM {{catalog_columns}}) x
      GROUP BY domain) c ON l.domain = c.domain
    UNION ALL SELECT 'Entity', 'app:' || database || '.' || table_name, row_count || ':' || column_count || ':' || columns_needing_review FROM {{facts}}
    UNION ALL SELECT 'Column', id, semantic_role FROM {{nodes}}
    UNION ALL SELECT 'Relationship', id, relationship_type || ':' || "from" || ':' || "to" FROM ({EDGES_SQL}) e
    UNION ALL SELECT 'Metric', 'app:metric:order_value', string_agg(name || ':' || (kind IS NOT NULL), ',' ORDER BY name) FROM (
      SELECT w.name, MIN(data_type) AS kind FROM (VALUES ('db3.dbo.Order.TotalAmount'), ('db3.dbo.Order.NoSuchColumn'), ('db8.dbo.OrderItem.ItemCount')) w(name)
      LEFT JOIN {{catalog_columns}} ON w.name = concat_ws('.', database, schema, table_name, column_name) GROUP BY w.name) m
    UNION ALL SELECT 'CoreEntity', 'app:core:' || w.name, w.name || ':' || COALESCE(CAST(MAX(row_count_estimate) AS VARCHAR), '') || ':' ||
        COALESCE(bool_or(column_name = k), false)
      FROM (VALUES ('db3.dbo.Customer', 'OrderID'), ('db3.dbo.Order', 'Missing'), ('db3.dbo.Nowhere', 'ID')) w(name, k)
      LEFT JOIN {{catalog_columns}} ON w.name = concat_ws('.', database, schema, table_name) GROUP BY w.name
    UNION ALL SELECT 'ReviewItem', id, 'domainReview:' || reason FROM ({REVIEW_DOMAIN}) a
    UNION ALL SELECT 'ReviewItem', id, 'unclassifiedColumns:' || reason FROM ({REVIEW_UNCLASSIFIED}) b
    UNION ALL SELECT 'ReviewItem', id, 'highNullRateColumns:' || reason FROM ({REVIEW_NULL}) c
    UNION ALL SELECT 'ReviewItem', id, 'lowCardinalityColumns:' || reason FROM ({REVIEW_LOW}) d
    UNION ALL SELECT 'ReviewSummary', 'app:review:' || COALESCE(category, 'total'), CAST(CAST(SUM(items) AS BIGINT) AS VARCHAR) FROM (
      SELECT 'domainReview' AS category, COUNT(*) AS items FROM ({REVIEW_DOMAIN}) a
      UNION ALL SELECT 'unclassifiedColumns', COUNT(*) FROM ({REVIEW_UNCLASSIFIED}) b
      UNION ALL SELECT 'highNullRateColumns', COUNT(*) FROM ({REVIEW_NULL}) c
      UNION ALL SELECT 'lowCardinalityColumns', COUNT(*) FROM ({REVIEW_LOW}) d) x GROUP BY ROLLUP (category)""",
    NODES,
    stage=("catalog_columns",),
)
def _(t):
    cat = t("catalog_columns")
    path = new_path(cat.sparkSession, "ontology")
    graph.write_ontology(cat, RULES, path, base_uri="urn:catalog#", generated_at=F.lit(REFERENCE).cast("timestamp_ntz"))
    back = graph.read_ontology(cat.sparkSession, path)
    field = lambda name: F.get_json_object("document", f"$.{name}")
    joined = lambda *names: F.concat_ws(":", *[F.coalesce(field(n), F.lit("")) for n in names])
    sources = F.from_json(field("sourceColumns"), "array<struct<column:string,resolved:string>>")
    context = F.concat_ws(":", F.get_json_object("document", "$['@context']['@vocab']"), F.get_json_object("document", "$['@context']['hasColumn']['@container']"))
    stats = [f"sourceStats.{k}" for k in ("totalColumns", "totalTables", "totalDatabases", "totalForeignKeys")]
    forms = {
        "Root": F.concat_ws(":", joined(*stats, "generatedAt"), context), "Domain": joined("label", "tableCount"),
        "Entity": joined("rowCount", "columnCount", "columnsNeedingReview"), "Column": field("semanticRole"),
        "Relationship": joined("relationshipType", "from", "to"), "CoreEntity": joined("table", "rowCount", "keyFound"),
        "Metric": F.array_join(F.transform(sources, lambda c: F.concat(c["column"], F.lit(":"), c["resolved"])), ","),
        "ReviewItem": joined("category", "reason"), "ReviewSummary": field("items"),
    }
    detail = F.coalesce(*[F.when(F.col("section") == k, v) for k, v in forms.items()])
    return back.select("section", "id", detail.alias("detail"))


@R.add(
    "entities_in_domain",
    """SELECT 'app:' || database || '.' || table_name AS id, database, schema, table_name, row_count, column_count FROM {facts}
    WHERE domain = 'SalesDomain'""",
    NODES,
)
def _(t):
    return graph.entities_in_domain(facts(t), "SalesDomain")


@R.add("edges_from_table", f"SELECT * FROM ({EDGES_SQL}) e WHERE from_table = 'app:db9.Customer'")
def _(t):
    return graph.edges_from_table(graph.relationships(t("catalog_columns"), RULES), "app:db9.Customer")


@R.add(
    "large_entities",
    """SELECT database, schema, table_name, row_count, domain FROM {facts} WHERE row_count > 1000000
    ORDER BY row_count DESC, database, schema, table_name LIMIT 15""",
    NODES,
)
def _(t):
    return graph.large_entities(facts(t))


ROLES_LISTED = " UNION ALL ".join(
    f"SELECT '{r['id']}' AS role, '{', '.join(r['patterns'][:3])}' AS patterns" for r in RULES["semantic_roles"]
)


@R.add(
    "summary_tables",
    f"""SELECT 'domain' AS section, l.domain AS name, COALESCE(n, 0) AS items,
      CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS comment
    FROM ({LISTED}) l LEFT JOIN (SELECT domain, COUNT(*) AS n FROM {{facts}} GROUP BY domain) c ON l.domain = c.domain
    UNION ALL SELECT 'role', r.role, COALESCE(n, 0), patterns FROM ({ROLES_LISTED}) r
    LEFT JOIN (SELECT semantic_role, COUNT(*) AS n FROM {{nodes}} GROUP BY semantic_role) c ON r.role = c.semantic_role
    UNION ALL SELECT 'review', id, (SELECT COUNT(*) - 10 FROM {{facts}} WHERE domain = 'UncategorizedDomain'), "table" FROM (
      {REVIEW_DOMAIN} ORDER BY row_count DESC, id LIMIT 10) q""",
    NODES,
    stage=("catalog_columns",),
)
def _(t):
    cat = t("catalog_columns")
    domains = graph.domain_section(classify.domain_counts(cat, RULES["domains"]))
    roles = graph.role_section(cat, RULES["semantic_roles"])
    todo = graph.review_section(graph.review_domain(facts(t)), [F.col("row_count").desc(), F.col("id")], 10)
    return (
        domains.select(F.lit("domain").alias("section"), F.col("domain").alias("name"), F.col("table_count").alias("items"), "comment")
        .unionByName(roles.select(F.lit("role").alias("section"), F.col("role").alias("name"), F.col("columns").alias("items"), F.col("patterns").alias("comment")))
        .unionByName(todo.select(F.lit("review").alias("section"), F.col("id").alias("name"), F.col("more").alias("items"), F.col("table").alias("comment")))
    )


# --- workload ---------------------------------------------------------------------------------------

DAYS = f"FLOOR(date_diff('second', last_execution_time, TIMESTAMP '{REFERENCE}') / 86400)"
SCORE = f"""ln(COALESCE(execution_count, 0) + 1) * 0.6 + 0.4 * CASE WHEN last_execution_time IS NULL THEN 0.1
    ELSE GREATEST(CAST(0.1 AS DOUBLE), 1 - {DAYS} / 30.0 * 0.9) END"""
USAGE = {
    "all_stats": """SELECT 'procedures' AS source, database, object_name, execution_count, last_execution_time, avg_duration_ms, total_cpu_ms, CAST(NULL AS BIGINT) AS unique_users FROM {proc_stats}
      UNION ALL SELECT 'reports', database, object_name, execution_count, last_execution_time, avg_duration_ms, NULL, unique_users FROM {report_stats}""",
    "per_object": """SELECT database, object_name, CAST(SUM(execution_count) AS BIGINT) AS execution_count, MAX(last_execution_time) AS last_execution_time,
      AVG(avg_duration_ms) AS avg_duration_ms, COALESCE(SUM(total_cpu_ms), 0) AS total_cpu_ms FROM {all_stats} GROUP BY database, object_name""",
    "ranked": f"""SELECT o.database, o.object_name, object_type, COALESCE(execution_count, 0) AS execution_count,
      last_execution_time AS last_executed, COALESCE(avg_duration_ms, 0) AS avg_duration_ms, round_even({SCORE}, 2) AS importance_score,
      definition <> '' AS has_definition, definition
      FROM {{sql_objects}} o LEFT JOIN {{per_object}} s ON o.database = s.database AND o.object_name = s.object_name""",
}


def all_stats(t):
    return use.stats_union({"procedures": t("proc_stats"), "reports": t("report_stats")})


def ranked(t):
    return use.ranked_objects(t("sql_objects"), all_stats(t), F.lit(REFERENCE).cast("timestamp_ntz"))


@R.add(
    "object_type_counts",
    """SELECT CASE object_type WHEN 'PROCEDURE' THEN 'procedures' WHEN 'VIEW' THEN 'views' WHEN 'TRIGGER' THEN 'triggers' ELSE 'functions' END AS kind,
      COUNT(*) AS objects FROM {sql_objects} GROUP BY kind""",
)
def _(t):
    return use.object_type_counts(t("sql_objects"))


@R.add("stats_union", "SELECT * FROM {all_stats}", USAGE)
def _(t):
    return all_stats(t)


@R.add(
    "exec_stats",
    """SELECT database, object_name, execution_count, last_execution_time, ROUND(avg_duration_ms, 7) AS avg_duration_ms, total_cpu_ms FROM {per_object}""",
    USAGE,
)
def _(t):
    return use.exec_stats(all_stats(t)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 7))


@R.add(
    "importance_score",
    f"SELECT database, object_name, ROUND({SCORE}, 6) AS importance FROM {{per_object}}",
    USAGE,
)
def _(t):
    score = use.importance(F.col("execution_count"), F.col("last_execution_time"), F.lit(REFERENCE).cast("timestamp_ntz"))
    return use.exec_stats(all_stats(t)).select("database", "object_name", F.round(score, 6).alias("importance"))


@R.add(
    "top_objects",
    """SELECT database, object_name, object_type, execution_count, last_executed, importance_score, has_definition FROM {ranked}
    ORDER BY importance_score DESC, object_name, database LIMIT 100""",
    USAGE,
)
def _(t):
    return use.top_objects(ranked(t)).drop("avg_duration_ms")


@R.add(
    "column_usage",
    """SELECT referenced_table, referenced_column, COUNT(*) AS reference_count, COUNT(DISTINCT referencing_object) AS unique_referrers
    FROM {dependencies} WHERE referenced_column IS NOT NULL GROUP BY referenced_table, referenced_column""",
)
def _(t):
    return use.column_usage(t("dependencies"))


@R.add(
    "table_usage",
    """SELECT referenced_table, COUNT(*) AS reference_count, COUNT(DISTINCT referencing_object) AS unique_referrers
    FROM {dependencies} GROUP BY referenced_table""",
)
def _(t):
    return use.table_usage(t("dependencies"))


@R.add(
    "enrich_usage",
    """SELECT database, c.table_name, c.column_name, tn AS table_references, tu AS table_referrers, cn AS column_references, cu AS column_referrers
    FROM {catalog_columns} c
    LEFT JOIN (SELECT referenced_table AS t, COUNT(*) AS tn, COUNT(DISTINCT referencing_object) AS tu FROM {dependencies} GROUP BY 1) x ON c.table_name = x.t
    LEFT JOIN (SELECT referenced_table AS t, referenced_column AS col, COUNT(*) AS cn, COUNT(DISTINCT referencing_object) AS cu
      FROM {dependencies} WHERE referenced_column IS NOT NULL GROUP BY 1, 2) y ON c.table_name = y.t AND c.column_name = y.col""",
)
def _(t):
    deps = t("dependencies")
    out = use.enrich_usage(t("catalog_columns"), use.table_usage(deps), use.column_usage(deps))
    return out.select(
        "database", "table_name", "column_name", "table_references", "table_referrers", "column_references", "column_referrers"
    )


@R.add(
    "usage_merge",
    """SELECT COALESCE(b.referenced_table, a.referenced_table) AS referenced_table, COALESCE(b.n, a.n) AS reference_count, COALESCE(b.u, a.u) AS unique_referrers
    FROM (SELECT referenced_table, COUNT(*) AS n, COUNT(DISTINCT referencing_object) AS u FROM {dependencies} WHERE referencing_type = 'VIEW' GROUP BY 1) a
    FULL JOIN (SELECT referenced_table, COUNT(*) AS n, COUNT(DISTINCT referencing_object) AS u FROM {dependencies} WHERE database IN ('db1', 'db2') AND referenced_table <> 'ErrorLog' GROUP BY 1) b
    ON a.referenced_table = b.referenced_table""",
)
def _(t):
    deps = t("dependencies")
    first = use.table_usage(deps.where("referencing_type = 'VIEW'"))
    second = use.table_usage(deps.where("database in ('db1', 'db2') and referenced_table <> 'ErrorLog'"))
    return use.usage_merge([first, second], ["referenced_table"])


@R.add(
    "most_executed",
    """SELECT database, object_name, execution_count FROM {ranked} WHERE execution_count > 0
    ORDER BY execution_count DESC, database, object_name LIMIT 20""",
    USAGE,
)
def _(t):
    return use.most_executed(ranked(t))


@R.add(
    "most_used",
    """SELECT referenced_table, COUNT(*) AS reference_count, COUNT(DISTINCT referencing_object) AS unique_referrers
    FROM {dependencies} GROUP BY referenced_table ORDER BY reference_count DESC, referenced_table LIMIT 20""",
)
def _(t):
    return use.most_referenced(use.table_usage(t("dependencies")))


@R.add(
    "unused_tables",
    """SELECT DISTINCT database, schema, table_name FROM {catalog_columns}
    WHERE table_name NOT IN (SELECT referenced_table FROM {dependencies})""",
)
def _(t):
    return use.unused_tables(t("catalog_columns"), t("dependencies"))


@R.add(
    "unused_columns",
    """SELECT database, schema, table_name, column_name FROM {catalog_columns} c WHERE NOT EXISTS (
      SELECT 1 FROM {dependencies} d WHERE d.referenced_table = c.table_name AND d.referenced_column = c.column_name)""",
)
def _(t):
    return use.unused_columns(t("catalog_columns"), t("dependencies")).select(*TABLE_KEY, "column_name")
