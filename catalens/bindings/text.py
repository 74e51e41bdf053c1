"""SQL-text mining and the review loop on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, review
from ..operators import sqltext as st
from ..operators import usage as use
from ..plans.materialize import materialize, spread
from .base import Registry
from .rules import REFERENCE, RULES, USAGE, all_stats

R = Registry()
KEEP = ["database", "object_name"]


def prepared(t):
    return st.prepare(spread(t("sql_objects")))


def plain(name: str) -> str:
    """SQL that drops identifier quotes, as the operators do."""
    return f"""regexp_replace({name}, '[\\[\\]"]', '', 'g')"""


def re_(pattern: str) -> str:
    return "'" + pattern.replace("*+", "*").replace("'", "''") + "'"


# The SQL side reads the raw texts: those of the test tables hold no comments, so only blanks collapse,
# and literals are matched as '[^']*' instead of their coded form.
LITERAL = "'[^']*'"
VALUE = st.VALUE.replace(st.LITERAL, LITERAL)
# DuckDB reads at most nine groups, and the texts hold no NOT
COND = st.CONDITION.replace(st.VALUE, VALUE).replace("(NOT)", "NOT")
# patterns of the SQL side, for expressions as deep as the test tables hold them
ARGUMENT = r"[^()]*"
for _level in range(4):
    ARGUMENT = rf"[^()]*(?:\({ARGUMENT}\)[^()]*)*"
AGGREGATE = rf"(?i)\b(SUM|COUNT|AVG|MIN|MAX)\s*\(\s*(?:DISTINCT\s+)?({ARGUMENT})\){st.ALIAS}"
OPERAND = rf"(?:{st.IDENT}\s*)?\({ARGUMENT}\)|{st.NAME}|[0-9]+(?:\.[0-9]+)?"
RATIO = rf"(?i)((?:{OPERAND})\s*/\s*(?:{OPERAND})){st.ALIAS}"
# the texts hold no CASE inside CASE
CASE = rf"(?is)(\bCASE\b.*?\bEND\b)(?:\s+(?:AS\s+)?({st.IDENT}))?"


def alias_(text: str) -> str:
    """SQL for an alias, null where the word begins the next clause."""
    return f"CASE WHEN upper({text}) NOT IN ('FROM', 'WHERE', 'AND', 'OR', 'AS', 'THEN', 'ELSE', 'END', 'DESC', 'GROUP', 'ORDER') THEN NULLIF({text}, '') END"


TEXT = {
    "texts": r"SELECT database, object_name, trim(regexp_replace(definition, '\s+', ' ', 'g')) AS s FROM {sql_objects}",
    "froms": f"""SELECT database, object_name, i AS fi, seg FROM (
        SELECT database, object_name, unnest(parts) AS seg, generate_subscripts(parts, 1) AS i FROM (
          SELECT database, object_name, regexp_split_to_array(s, {re_(st.FROM_SPLIT)}) AS parts FROM {{texts}}) p) q WHERE i > 1""",
    "pieces": f"""SELECT database, object_name, fi, ji, piece, regexp_extract(seg, {re_('^(' + st.NAME + ')')}, 1) AS l FROM (
        SELECT database, object_name, fi, seg, unnest(parts) AS piece, generate_subscripts(parts, 1) AS ji FROM (
          SELECT *, string_split(regexp_replace(seg, {re_(st.JOIN_MARK)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM {{froms}}) p) q WHERE ji > 1""",
    "joins": f"""SELECT database, object_name, CAST(ROW_NUMBER() OVER (PARTITION BY database, object_name ORDER BY fi, ji) - 1 AS INT) AS position,
        CASE WHEN l = '' THEN 'UNKNOWN' ELSE {plain('l')} END AS left_table,
        {plain(f"regexp_extract(string_split(piece, chr(2))[2], {re_('^(' + st.NAME + ')')}, 1)")} AS right_table,
        CASE WHEN string_split(piece, chr(2))[1] = '' THEN 'INNER' ELSE upper(string_split(piece, chr(2))[1]) END AS join_type,
        regexp_split_to_array(regexp_extract(string_split(piece, chr(2))[2], {re_(st.ON_PART)}, 1), {re_(st.ON_END)})[1] AS on_text
      FROM {{pieces}}""",
    "on_pairs": f"""SELECT database, object_name, position, m, i FROM (SELECT database, object_name, position, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT database, object_name, position, regexp_extract_all(on_text, {re_(st.ON_PAIR)}) AS ms FROM {{joins}}) p) q""",
    "join_rows": f"""SELECT j.database, j.object_name, j.position, left_table, right_table, join_type,
        COALESCE(string_agg({plain(f"regexp_extract(m, {re_(st.ON_PAIR)}, 1)")} || ' = ' || {plain(f"regexp_extract(m, {re_(st.ON_PAIR)}, 2)")}, ' AND ' ORDER BY i), '') AS join_columns
      FROM {{joins}} j LEFT JOIN {{on_pairs}} p ON j.database = p.database AND j.object_name = p.object_name AND j.position = p.position GROUP BY ALL""",
    "aggs": f"""SELECT database, object_name, CAST(i - 1 AS INT) AS position, upper(regexp_extract(m, {re_(AGGREGATE)}, 1)) AS function,
        trim(regexp_extract(m, {re_(AGGREGATE)}, 2)) AS "column", {alias_('regexp_extract(m, ' + re_(AGGREGATE) + ', 3)')} AS alias,
        NULLIF(regexp_extract(trim(regexp_extract(m, {re_(AGGREGATE)}, 2)), '^([A-Za-z_]+)\\.', 1), '') AS context
      FROM (SELECT database, object_name, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT database, object_name, regexp_extract_all(s, {re_(AGGREGATE)}) AS ms FROM {{texts}}) p) q""",
    "wheres": f"""SELECT database, object_name, i AS wi, regexp_split_to_array(part, {re_(st.WHERE_END)})[1] AS clause FROM (
        SELECT database, object_name, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
          SELECT database, object_name, regexp_split_to_array(s, {re_(st.WHERE_SPLIT)}) AS parts FROM {{texts}}) p) q WHERE i > 1""",
    "conds": f"""SELECT database, object_name, wi, i, {', '.join(f"regexp_extract(m, {re_(COND)}, {g}) AS g{g}" for g in range(1, 8))} FROM (
        SELECT database, object_name, wi, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
          SELECT database, object_name, wi, regexp_extract_all(clause, {re_(COND)}) AS ms FROM {{wheres}}) p) q""",
    "filters": """SELECT database, object_name, CAST(ROW_NUMBER() OVER (PARTITION BY database, object_name ORDER BY wi, i) - 1 AS INT) AS position,
        g1 AS "column", CASE WHEN g2 <> '' THEN g2 WHEN g4 <> '' THEN 'LIKE' WHEN g5 <> '' THEN 'IN' WHEN g6 <> '' THEN 'BETWEEN' ELSE 'IS NULL' END AS operator,
        CASE WHEN g2 <> '' THEN substr(replace(g3, '''', ''), 1, 50) WHEN g4 <> '' THEN substr(replace(g4, '''', ''), 1, 50)
          WHEN g5 <> '' THEN replace(g5, '''', '') WHEN g6 <> '' THEN g6 || ' AND ' || g7 ELSE 'NULL' END AS value_pattern
      FROM {conds}""",
    "ratios": f"""SELECT database, object_name, i, true AS is_ratio, regexp_extract(m, {re_(RATIO)}, 1) AS formula, {alias_('regexp_extract(m, ' + re_(RATIO) + ', 2)')} AS name
      FROM (SELECT database, object_name, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT database, object_name, regexp_extract_all(s, {re_(RATIO)}) AS ms FROM {{texts}}) p) q""",
    "cases": f"""SELECT database, object_name, i, false AS is_ratio, regexp_extract(m, {re_(CASE)}, 1) AS formula, {alias_('regexp_extract(m, ' + re_(CASE) + ', 2)')} AS name
      FROM (SELECT database, object_name, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
        SELECT database, object_name, regexp_extract_all(s, {re_(CASE)}) AS ms FROM {{texts}}) p) q
      WHERE regexp_matches(m, {re_(st.HAS_AGGREGATE)})""",
    "metrics": """SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY database, object_name ORDER BY is_ratio DESC, i) - 1 AS INT) AS position,
        array_to_string(regexp_extract_all(formula, '[a-z]\\.[A-Za-z]+'), ', ') AS columns_used
      FROM (SELECT * FROM {ratios} UNION ALL SELECT * FROM {cases}) u""",
}
ALL = {**TEXT, **USAGE}


@R.add("sql_joins", "SELECT database, object_name, position, left_table, right_table, join_type FROM {joins}", TEXT)
def _(t):
    return st.exploded(prepared(t), "joins", KEEP).drop("on_columns")


@R.add(
    "sql_join_columns",
    f"""SELECT database, object_name, position, {plain(f"regexp_extract(m, {re_(st.ON_PAIR)}, 1)")} AS left_column,
      {plain(f"regexp_extract(m, {re_(st.ON_PAIR)}, 2)")} AS right_column FROM {{on_pairs}}""",
    TEXT,
)
def _(t):
    return st.exploded(prepared(t), "joins", KEEP).select(*KEEP, "position", F.inline("on_columns"))


@R.add("sql_aggregations", 'SELECT database, object_name, position, function, "column", alias, context FROM {aggs}', TEXT)
def _(t):
    return st.exploded(prepared(t), "aggregations", KEEP)


FILTERS_SQL = 'SELECT database, object_name, position, "column", operator, value_pattern FROM {filters}'


@R.add("sql_filters", FILTERS_SQL, TEXT)
def _(t):
    return st.exploded(prepared(t), "filters", KEEP)


@R.add("sql_in_filters", FILTERS_SQL + " WHERE operator = 'IN'", TEXT)
def _(t):
    return st.exploded(prepared(t), "filters", KEEP).where("operator in ('IN', 'NOT IN')")


@R.add("sql_between_filters", FILTERS_SQL + " WHERE operator = 'BETWEEN'", TEXT)
def _(t):
    return st.exploded(prepared(t), "filters", KEEP).where("operator in ('BETWEEN', 'NOT BETWEEN')")


@R.add("sql_null_filters", FILTERS_SQL + " WHERE operator = 'IS NULL'", TEXT)
def _(t):
    return st.exploded(prepared(t), "filters", KEEP).where("operator in ('IS NULL', 'IS NOT NULL')")


METRIC_COLUMNS = "database, object_name, position, name, formula, columns_used, is_ratio"


def flat(metrics):
    return metrics.withColumn("columns_used", F.array_join("columns_used", ", "))


@R.add("sql_ratio_metrics", f"SELECT {METRIC_COLUMNS} FROM {{metrics}} WHERE is_ratio", TEXT)
def _(t):
    return flat(st.exploded(prepared(t), "ratio_metrics", KEEP))


@R.add("sql_case_metrics", f"SELECT {METRIC_COLUMNS} FROM {{metrics}} WHERE NOT is_ratio", TEXT)
def _(t):
    return flat(st.exploded(prepared(t), "case_metrics", KEEP))


REFS = f"""list_sort(list_distinct(regexp_extract_all(s, {re_(st.TABLE_REF)}, 1)))"""


@R.add(
    "sql_references",
    f"""SELECT database, object_name, array_to_string({REFS}, ',') AS tables,
      array_to_string(list_sort(list_distinct(regexp_extract_all(s, '\\b[a-z]\\.[A-Za-z]+'))), ',') AS columns FROM {{texts}}""",
    TEXT,
)
def _(t):
    return prepared(t).select(
        *KEEP, F.array_join(st.tables_referenced(), ",").alias("tables"), F.array_join(st.columns_referenced(), ",").alias("columns")
    )


# texts with unqualified names, the tables they name, and the expected rows written out by hand
PLAIN_TEXTS = [
    "SELECT Name, Price * 2 AS doubled FROM dbo.Product WHERE Price > 3",
    "SELECT Status, SUM(Total) AS total_sum FROM dbo.Orders o, dbo.Customer c WHERE o.CustomerID = c.CustomerID AND Region = 4 GROUP BY Status",
    "UPDATE [dbo].[Product] SET [Price] = 1 WHERE Missing IS NULL AND name = 'Region'",
    "INSERT INTO dbo.Archive (Name, Price) SELECT Name, COALESCE(Price, 0) FROM db1.dbo.Product",
]
PLAIN_TABLES = {
    "Product": ["Name", "Price"], "Orders": ["Status", "Total", "CustomerID"], "Customer": ["Status", "Region", "CustomerID"],
    "Archive": ["Name"],
}


@R.add(
    "sql_columns_resolved",
    """SELECT CONCAT('db', CAST(o_custkey % 20 AS STRING)) AS database, CONCAT('usp_', CAST(o_orderkey AS STRING)) AS object_name, name, state,
      CASE WHEN state = 'resolved' THEN COALESCE(home, CONCAT('db', CAST(o_custkey % 20 AS STRING))) END AS table_database, "table"
    FROM {orders} JOIN (VALUES
      (0, 'Name', 'resolved', NULL, 'dbo.Product'), (0, 'Price', 'resolved', NULL, 'dbo.Product'),
      (1, 'Status', 'ambiguous', NULL, NULL), (1, 'Total', 'resolved', NULL, 'dbo.Orders'), (1, 'Region', 'resolved', NULL, 'dbo.Customer'),
      (2, 'Price', 'resolved', NULL, 'dbo.Product'), (2, 'Missing', 'unknown', NULL, NULL), (2, 'name', 'resolved', NULL, 'dbo.Product'),
      (3, 'Name', 'ambiguous', NULL, NULL), (3, 'Price', 'resolved', 'db1', 'dbo.Product')
    ) e(kind, name, state, home, "table") ON o_orderkey % 4 = kind""",
)
def _(t):
    texts = t("orders").select(
        F.concat(F.lit("db"), (F.col("o_custkey") % 20).cast("string")).alias("database"),
        F.concat(F.lit("usp_"), F.col("o_orderkey").cast("string")).alias("object_name"),
        F.get(F.array(*[F.lit(x) for x in PLAIN_TEXTS]), (F.col("o_orderkey") % 4).cast("int")).alias("definition"),
    )
    columns = F.array(*[
        F.struct(F.lit("dbo").alias("schema"), F.lit(table).alias("table_name"), F.lit(c).alias("column_name"))
        for table, names in PLAIN_TABLES.items() for c in names
    ])
    known = texts.select(F.explode(F.array("database", F.lit("db1"))).alias("database")).distinct()
    return st.resolved_columns(st.prepare(texts), known.select("database", F.inline(columns)), KEEP)


@R.add(
    "sql_complexity",
    f"""SELECT t.database, t.object_name, CAST(len({REFS}) AS INT) AS tables, CAST(COALESCE(j, 0) AS INT) AS joins,
      CAST(COALESCE(a, 0) AS INT) AS aggregations, CAST(COALESCE(f, 0) AS INT) AS filters, CAST(COALESCE(m, 0) AS INT) AS metrics
    FROM {{texts}} t LEFT JOIN (SELECT database, object_name, COUNT(*) AS j FROM {{joins}} GROUP BY ALL) USING (database, object_name)
    LEFT JOIN (SELECT database, object_name, COUNT(*) AS a FROM {{aggs}} GROUP BY ALL) USING (database, object_name)
    LEFT JOIN (SELECT database, object_name, COUNT(*) AS f FROM {{filters}} GROUP BY ALL) USING (database, object_name)
    LEFT JOIN (SELECT database, object_name, COUNT(*) AS m FROM {{metrics}} GROUP BY ALL) USING (database, object_name)""",
    TEXT,
)
def _(t):
    return st.complexity(prepared(t), KEEP)


@R.add("sql_parse_errors", "SELECT database, object_name, 'Empty SQL' AS error FROM {texts} WHERE s = ''", TEXT)
def _(t):
    return st.parse_errors(t("sql_objects"), KEEP)


@R.add(
    "top_joined_tables",
    """SELECT "table", COUNT(*) AS count FROM (SELECT left_table AS "table" FROM {joins} UNION ALL SELECT right_table FROM {joins}) x
    WHERE "table" <> 'UNKNOWN' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    TEXT,
)
def _(t):
    return st.top_joined_tables(st.exploded(prepared(t), "joins", KEEP))


@R.add(
    "top_agg_columns",
    """SELECT "column", COUNT(*) AS count FROM {aggs} WHERE "column" <> '*' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    TEXT,
)
def _(t):
    return st.top_aggregated_columns(st.exploded(prepared(t), "aggregations", KEEP))


@R.add(
    "top_filter_columns",
    """SELECT string_split("column", '.')[-1] AS "column", COUNT(*) AS count FROM {filters} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    TEXT,
)
def _(t):
    return st.top_filtered_columns(st.exploded(prepared(t), "filters", KEEP))


@R.add(
    "top_filter_patterns",
    """SELECT "column" || ' ' || operator AS pattern, COUNT(*) AS count FROM {filters} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    TEXT,
)
def _(t):
    return st.top_filter_patterns(st.exploded(prepared(t), "filters", KEEP))


@R.add(
    "pattern_totals",
    """SELECT (SELECT COUNT(*) FROM {joins}) AS joins, (SELECT COUNT(*) FROM {aggs}) AS aggregations,
      (SELECT COUNT(*) FROM {filters}) AS filters, (SELECT COUNT(*) FROM {metrics}) AS metrics""",
    TEXT,
)
def _(t):
    return st.pattern_totals(prepared(t))


@R.add("first_metrics", f"SELECT {METRIC_COLUMNS} FROM {{metrics}} ORDER BY database, object_name, position LIMIT 50", TEXT)
def _(t):
    return flat(st.first_metrics(prepared(t), KEEP))


# --- review tables ----------------------------------------------------------------------------------


def scored(t, kind):
    """Patterns of all objects with the importance of their object.

    The texts are mined where they are scanned; the patterns, not the texts, go through the join.
    """
    objects = prepared(t).withColumn("found", st.mined(kind))
    rows = use.ranked_objects(objects, all_stats(t), F.lit(REFERENCE).cast("timestamp_ntz"), keep=("found",))
    kept = [*KEEP, "importance_score", "execution_count", "last_executed", "found"]
    return st.unnested(rows.select(*kept), "found")


METRIC_TEXT = """CASE WHEN formula LIKE '%Discount%' THEN 'Discount amount or rate calculation' ELSE 'Volume/count metric' END"""


@R.add(
    "review_metrics",
    f"""SELECT importance_score, execution_count, last_executed, m.database || '.' || m.object_name AS procedure, name AS metric_name, formula, columns_used,
      CASE WHEN is_ratio THEN 'Yes' ELSE 'No' END AS is_ratio, {METRIC_TEXT} AS plain_english, '' AS correct_name, '' AS notes
    FROM {{metrics}} m JOIN {{ranked}} r ON m.database = r.database AND m.object_name = r.object_name WHERE is_ratio
    UNION ALL SELECT 0.0, 0, NULL, (SELECT database || '.' || object_name FROM {{metrics}} WHERE NOT is_ratio ORDER BY database, object_name LIMIT 1), name, formula, columns_used, 'No', {METRIC_TEXT}, '', ''
    FROM (SELECT DISTINCT name, formula, columns_used FROM {{metrics}} WHERE NOT is_ratio) g""",
    ALL,
)
def _(t):
    found = materialize(scored(t, "ratio_metrics"), "metrics")  # read twice, mined once
    return review.review_metrics(found, st.exploded(prepared(t), "metrics", KEEP))


@R.add(
    "review_joins",
    """SELECT importance_score, j.database || '.' || j.object_name AS procedure, left_table, right_table, join_type, join_columns,
      CASE WHEN right_table = 'dbo.InvoiceItem' THEN 'Invoice to line items - billing details' WHEN right_table = 'dbo.Customer' THEN 'Links to customer/account information'
        ELSE 'Table relationship' END AS business_meaning, '' AS is_correct, '' AS notes
    FROM {join_rows} j JOIN {ranked} r ON j.database = r.database AND j.object_name = r.object_name""",
    ALL,
)
def _(t):
    return review.review_joins(scored(t, "joins"))


@R.add(
    "review_aggregations",
    """SELECT importance_score, a.database || '.' || a.object_name AS procedure, function, "column", COALESCE(alias, '') AS alias, COALESCE(context, '') AS context,
      CASE WHEN function = 'COUNT' AND "column" = '*' THEN 'Total order count' WHEN function = 'COUNT' THEN 'Distinct entity count'
        WHEN "column" = 'i.NetAmount' THEN 'Total net revenue (after adjustments)' WHEN "column" = 'i.Discount' THEN 'Sum of i.discount'
        WHEN "column" = 'i.Amount' THEN 'Total monetary value - financial metric' ELSE 'Average transaction value' END AS business_meaning
    FROM {aggs} a JOIN {ranked} r ON a.database = r.database AND a.object_name = r.object_name""",
    ALL,
)
def _(t):
    return review.review_aggregations(scored(t, "aggregations"))


FILTER_TEXT = """CASE "column" WHEN 'o.Status' THEN 'Filtering to CANCELLED items - churn/cancellation analysis'
    WHEN 'i.CreatedDate' THEN 'Date range filter - time-bounded query' WHEN 'q.ExpiryDate' THEN 'Date range filter - time-bounded query'
    WHEN 'q.Notes' THEN 'Finding records where notes is missing' WHEN 'c.Region' THEN 'Filter on region' WHEN 'p.Name' THEN 'Filter on name' ELSE 'Filter on price' END"""


@R.add(
    "review_filters",
    f"""SELECT COUNT(*) AS frequency, MAX(importance_score) AS importance, "column", operator, substr(value_pattern, 1, 100) AS typical_values,
      array_to_string(list(object_name ORDER BY importance_score DESC, object_name, database, position)[1:3], ', ') AS used_in, {FILTER_TEXT} AS business_meaning
    FROM (SELECT f.*, importance_score FROM {{filters}} f JOIN {{ranked}} r ON f.database = r.database AND f.object_name = r.object_name) x
    GROUP BY "column", operator, value_pattern""",
    ALL,
)
def _(t):
    return review.review_filters(materialize(scored(t, "filters"), "filters"))  # read twice, mined once


@R.add(
    "interpret_metric",
    f"SELECT database, object_name, position, {METRIC_TEXT} AS meaning FROM {{metrics}}",
    TEXT,
)
def _(t):
    found = st.exploded(prepared(t), "metrics", KEEP)
    return found.select(*KEEP, "position", review.interpret_metric().alias("meaning"))


PAIRS_SQL = """CASE
    WHEN (contains(l, 'order') AND contains(r, 'orderitem')) OR (contains(r, 'order') AND contains(l, 'orderitem')) THEN 'Order to line items - order details breakdown'
    WHEN (contains(l, 'order') AND contains(r, 'property')) OR (contains(r, 'order') AND contains(l, 'property')) THEN 'Orders to property location'
    WHEN (contains(l, 'orderitem') AND contains(r, 'product')) OR (contains(r, 'orderitem') AND contains(l, 'product')) THEN 'Line items to product catalog'
    WHEN contains(r, 'item') THEN 'Parent to child items relationship' WHEN contains(l, 'item') THEN 'Child items to parent relationship'
    WHEN contains(r, 'customer') THEN 'Links to customer/account information'
    WHEN contains(r, 'product') THEN 'Links to product/pricing information'
    WHEN contains(r, 'property') THEN 'Links to property/location information' ELSE 'Table relationship' END"""
NEIGHBOURS = """SELECT database, table_name AS a, CASE table_name WHEN 'Order' THEN 'OrderItem' WHEN 'OrderItem' THEN 'ProductType' WHEN 'Customer' THEN 'Property'
      WHEN 'Misc' THEN 'Customer' WHEN 'ErrorLog' THEN 'OrderItem' WHEN 'Property' THEN 'OrderHistory' WHEN 'AuditTrail' THEN 'ProductType' ELSE 'Misc' END AS b
    FROM (SELECT DISTINCT database, table_name FROM {catalog_columns}) d"""


@R.add(
    "interpret_join",
    f"SELECT database, a AS left_table, b AS right_table, {PAIRS_SQL} AS meaning FROM (SELECT *, lower(a) AS l, lower(b) AS r FROM ({NEIGHBOURS}) n) x",
)
def _(t):
    pair = (
        F.when(F.col("a") == "Order", "OrderItem").when(F.col("a") == "OrderItem", "ProductType")
        .when(F.col("a") == "Customer", "Property").when(F.col("a") == "Misc", "Customer")
        .when(F.col("a") == "ErrorLog", "OrderItem").when(F.col("a") == "Property", "OrderHistory")
        .when(F.col("a") == "AuditTrail", "ProductType").otherwise("Misc")
    )
    tables = t("catalog_columns").select("database", F.col("table_name").alias("a")).distinct().withColumn("b", pair)
    return tables.select(
        "database", F.col("a").alias("left_table"), F.col("b").alias("right_table"), review.interpret_join("a", "b").alias("meaning")
    )


@R.add(
    "interpret_aggregation",
    """SELECT database, table_name, column_name, f AS function, CASE f
      WHEN 'COUNT' THEN CASE WHEN contains(c, 'id') THEN 'Distinct entity count' ELSE 'Count of ' || c END
      WHEN 'SUM' THEN CASE WHEN contains(c, 'amount') THEN 'Total monetary value - financial metric' ELSE 'Sum of ' || c END
      WHEN 'AVG' THEN CASE WHEN contains(c, 'amount') THEN 'Average transaction value' ELSE 'Average ' || c END
      ELSE CASE WHEN contains(c, 'date') THEN CASE f WHEN 'MIN' THEN 'Earliest date/time' ELSE 'Latest date/time' END
        WHEN contains(c, 'amount') THEN CASE f WHEN 'MIN' THEN 'Minimum value' ELSE 'Maximum value' END ELSE f || ' of ' || c END END AS meaning
    FROM (SELECT database, table_name, column_name, lower(column_name) AS c, unnest(['COUNT', 'SUM', 'AVG', 'MIN', 'MAX']) AS f FROM {catalog_columns}) x""",
)
def _(t):
    functions = F.explode(F.array(*[F.lit(x) for x in ("COUNT", "SUM", "AVG", "MIN", "MAX")]))
    rows = t("catalog_columns").select("database", "table_name", "column_name", functions.alias("function"))
    rows = rows.withColumn("alias", F.lit(None).cast("string"))
    return rows.select(
        "database", "table_name", "column_name", "function",
        review.interpret_aggregation("function", "column_name", "alias").alias("meaning"),
    )


@R.add("interpret_filter", f'SELECT database, object_name, position, {FILTER_TEXT} AS meaning FROM {{filters}}', TEXT)
def _(t):
    found = st.exploded(prepared(t), "filters", KEEP)
    return found.select(*KEEP, "position", review.interpret_filter().alias("meaning"))


# --- feedback ---------------------------------------------------------------------------------------
# Answers as reviewers would give them, derived from the order behind each object.

ANSWERS = {
    "metric_answers": """SELECT m.database || '.' || m.object_name AS procedure, name AS found_name,
        CASE WHEN k % 3 = 0 THEN 'term ' || k % 5 END AS corrected_name, CASE WHEN k % 3 = 1 THEN 'check' END AS notes, formula, k AS position
      FROM (SELECT *, CAST(string_split(object_name, '_')[2] AS BIGINT) AS k FROM {metrics}) m WHERE k % 3 < 2""",
    "join_answers": """SELECT procedure, left_table, right_table, join_type, CASE lower(trim(a)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS is_correct, notes
      FROM (SELECT database || '.' || object_name AS procedure, left_table, right_table, join_type,
        CASE k % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'unsure' ELSE '' END AS a, CASE WHEN k % 5 = 3 THEN 'look' END AS notes
        FROM (SELECT *, CAST(string_split(object_name, '_')[2] AS BIGINT) AS k FROM {joins}) j) x WHERE a <> '' OR notes IS NOT NULL""",
    "filter_answers": """SELECT "column", operator, value_pattern AS "values", 'meaning ' || k % 4 AS business_meaning, k AS position
      FROM (SELECT *, CAST(string_split(object_name, '_')[2] AS BIGINT) AS k FROM {filters}) f WHERE k % 2 = 0""",
}
FEEDBACK = {**TEXT, **ANSWERS}


def _number():
    return F.substring_index("object_name", "_", -1).cast("long")


def metric_answers(t):
    k = F.col("k")
    reviewed = st.exploded(prepared(t), "metrics", KEEP).withColumn("k", _number()).select(
        F.concat_ws(".", "database", "object_name").alias("procedure"), F.col("name").alias("metric_name"), "formula",
        F.when(k % 3 == 0, F.concat(F.lit("term "), (k % 5).cast("string"))).otherwise("").alias("correct_name"),
        F.when(k % 3 == 1, "check").alias("notes"), "k",
    )
    return reviewed


def filter_answers(t):
    k = F.col("k")
    return st.exploded(prepared(t), "filters", KEEP).withColumn("k", _number()).select(
        "column", "operator", F.col("value_pattern").alias("typical_values"), "k",
        F.when(k % 2 == 0, F.concat(F.lit("meaning "), (k % 4).cast("string"))).alias("correction"),
    )


def join_answers(t):
    k = F.col("k")
    return st.exploded(prepared(t), "joins", KEEP).withColumn("k", _number()).select(
        F.concat_ws(".", "database", "object_name").alias("procedure"), "left_table", "right_table", "join_type",
        F.when(k % 5 == 0, " Yes ").when(k % 5 == 1, "no").when(k % 5 == 2, "unsure").otherwise("").alias("is_correct"),
        F.when(k % 5 == 3, "look").alias("notes"),
    )


@R.add("feedback_rows", "SELECT * FROM {join_answers}", FEEDBACK)
def _(t):
    return review.join_feedback(join_answers(t))


@R.add("feedback_metrics", "SELECT procedure, found_name, corrected_name, notes, formula FROM {metric_answers}", FEEDBACK)
def _(t):
    return review.metric_feedback(metric_answers(t))


@R.add("feedback_filters", 'SELECT "column", operator, "values", business_meaning FROM {filter_answers}', FEEDBACK)
def _(t):
    return review.filter_feedback(filter_answers(t))


@R.add(
    "formula_columns",
    """SELECT database, object_name, position, CASE WHEN is_ratio THEN 'Discount,Amount' ELSE 'QuoteID' END AS names FROM {metrics}""",
    TEXT,
)
def _(t):
    found = st.exploded(prepared(t), "metrics", KEEP)
    return found.select(*KEEP, "position", F.array_join(review.formula_names(F.col("formula")), ",").alias("names"))


APPLIED = {
    **FEEDBACK,
    "terms": """SELECT column_name, arg_max(corrected_name, position) AS term FROM (
        SELECT 'TotalAmount' AS column_name, corrected_name, position FROM {metric_answers} WHERE corrected_name IS NOT NULL AND contains(formula, 'Amount')
        UNION ALL SELECT 'OrderID', corrected_name, position FROM {metric_answers} WHERE corrected_name IS NOT NULL AND contains(formula, 'QuoteID')) x GROUP BY 1""",
    "meanings": """SELECT string_split("column", '.')[-1] AS column_name, arg_max(business_meaning, position) AS meaning FROM {filter_answers} GROUP BY 1""",
}


@R.add(
    "apply_feedback",
    """SELECT c.database, c.table_name, c.column_name, COALESCE(term, '') AS business_terms, meaning AS business_meaning,
      CAST(term IS NOT NULL AS INT) + CAST(meaning IS NOT NULL AS INT) AS changes
    FROM {catalog_columns} c LEFT JOIN {terms} t ON c.column_name = t.column_name LEFT JOIN {meanings} m ON c.column_name = m.column_name""",
    APPLIED,
)
def _(t):
    # formulas of the texts name Amount and QuoteID; the catalog's columns are TotalAmount and OrderID
    answers = metric_answers(t).where(F.coalesce("correct_name", F.lit("")) != "").select(
        F.col("correct_name").alias("corrected_name"),
        F.replace(
            F.regexp_replace("formula", r"\.Amount\b", ".TotalAmount"), F.lit("QuoteID"), F.lit("OrderID")
        ).alias("formula"),
        F.col("k").alias("position"),
    )
    meanings = filter_answers(t).where(F.col("correction").isNotNull()).select(
        "column", F.col("correction").alias("business_meaning"), F.col("k").alias("position")
    )
    nodes = graph.column_nodes(t("catalog_columns"), RULES)
    out = review.apply_feedback(nodes, answers, meanings)
    return out.select(
        "database", "table_name", "column_name", F.array_join("business_terms", ",").alias("business_terms"),
        "business_meaning", "changes",
    )


def log(t):
    return review.feedback_log(
        review.metric_feedback(metric_answers(t)), review.join_feedback(join_answers(t)),
        review.filter_feedback(filter_answers(t)), reviewer="pat",
        reviewed_at=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), source="review.csv",
    )


LOG_SQL = """SELECT 'metricCorrections' AS kind, found_name AS subject FROM {metric_answers}
    UNION ALL SELECT 'relationshipFlags', right_table FROM {join_answers} UNION ALL SELECT 'filterMeanings', "column" FROM {filter_answers}"""


@R.add(
    "feedback_log",
    f"""SELECT kind, subject, 'pat' AS reviewed_by, TIMESTAMP '2024-01-31 00:00:00' AS reviewed_at, 'review.csv' AS source_file FROM ({LOG_SQL}) x""",
    FEEDBACK,
)
def _(t):
    return log(t).drop("record")


@R.add(
    "feedback_summary",
    f"""SELECT kind, COUNT(*) AS answers, array_to_string(list_sort(list(subject))[1:5], ', ') AS samples FROM ({LOG_SQL}) x GROUP BY kind""",
    FEEDBACK,
)
def _(t):
    return review.feedback_summary(log(t))
