"""Knowledge graph of a catalog: column and table nodes, edges, review queue, and export as JSON lines."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grouped import matched, nested_parts
from ..plans.materialize import materialize
from ..plans.schemas import TABLE_KEY
from .classify import domain_counts, domain_of, relationship_of, role_of, source_stats

# fixed values: review thresholds and the roles that explain a low cardinality
HIGH_NULL_RATE = 0.5
FLAGGED_SHARE = 0.3
LOW_CARDINALITY = 20
MIN_PROFILED = 100
CODED_ROLES = ["BooleanFlag", "StatusIndicator", "Code"]
# fixed values: files of the written document; there are nine sections
SECTION_ROWS = 200_000
OPEN_SECTIONS = 16


def _path(namespace: str, *parts: str | Column) -> Column:
    return F.concat(F.lit(f"{namespace}:"), F.concat_ws(".", *parts))


def column_nodes(catalog: DataFrame, rules: dict) -> DataFrame:
    """One node per column with role, key facts and, when profiled, its profile.

    Facts that do not hold are null, so that ``to_json`` leaves them out.
    """
    ns = rules["namespace"]
    profiled = F.coalesce(F.col("profiled_rows"), F.lit(0)) > 0

    def when_profiled(name: str) -> Column:
        return F.when(profiled, F.col(name)).alias(name)

    nodes = catalog.select(
        _path(ns, "database", "table_name", "column_name").alias("id"),
        *TABLE_KEY, "column_name", "data_type", "row_count_estimate",
        role_of(rules["semantic_roles"]).alias("semantic_role"),
        F.coalesce("is_nullable", F.lit(True)).alias("is_nullable"),
        F.when(F.col("is_primary_key"), True).alias("is_primary_key"),
        F.when(F.col("is_foreign_key"), True).alias("is_foreign_key"),
        F.when(F.col("is_foreign_key"), F.nullif("fk_references", F.lit(""))).alias("references"),
        when_profiled("null_rate"), when_profiled("null_count"), when_profiled("distinct_count"),
        when_profiled("profiled_rows"),
        F.coalesce("null_rate", F.lit(0.0)).alias("_null_rate"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("semantic_role") == "Unclassified", "unclassified_role"),
            F.when(F.col("_null_rate") > HIGH_NULL_RATE, "high_null_rate"),
        )
    )
    return nodes.withColumn("review_reasons", reasons).withColumn("review_status", _status()).drop("_null_rate")


def _status() -> Column:
    return F.when(F.size("review_reasons") > 0, "needs_review").otherwise("auto_classified")


def entity_facts(nodes: DataFrame, rules: dict) -> DataFrame:
    """One node per (database, schema, table): counts, domain, type labels and review status."""
    ns = rules["namespace"]
    per_table = nodes.groupBy(*TABLE_KEY).agg(
        F.coalesce(F.max("row_count_estimate"), F.lit(0)).alias("row_count"),
        F.count("*").alias("column_count"),
        F.count_if(F.col("review_status") == "needs_review").alias("columns_needing_review"),
    )
    flagged = F.col("columns_needing_review") > F.col("column_count") * FLAGGED_SHARE
    reasons = F.array_compact(
        F.array(
            F.when(F.col("domain") == "UncategorizedDomain", "unclassified_domain"),
            F.when(flagged, "many_unclassified_columns"),
        )
    )
    return (
        per_table.withColumn("domain", domain_of(rules["domains"]))
        .withColumn("id", _path(ns, "database", "table_name"))
        .withColumn("belongs_to_domain", F.concat(F.lit(f"{ns}:"), "domain"))
        .withColumn(
            "types", F.array(F.lit("Table"), F.concat(F.replace("domain", F.lit("Domain"), F.lit("")), F.lit("Entity")))
        )
        .withColumn("review_reasons", reasons)
        .withColumn("review_status", _status())
    )


NODE_FIELDS = [
    "column_name", "id", "data_type", "semantic_role", "is_nullable", "is_primary_key", "is_foreign_key",
    "references", "null_rate", "null_count", "distinct_count", "profiled_rows", "review_status", "review_reasons",
]


def entities(nodes: DataFrame, rules: dict, *, parts: int = 1) -> DataFrame:
    """Table nodes with their columns nested, sorted by column name.

    Every table gives ``parts`` rows at most, each with a share of its columns, and one row (``part`` 0) by
    default. The form for tables of any width is ``entity_facts`` next to the column nodes, which nests nothing.
    """
    nested = nested_parts(nodes, TABLE_KEY, F.struct(*NODE_FIELDS), F.col("column_name"), parts)
    return matched(entity_facts(nodes, rules), nested.withColumnRenamed("items", "has_column"), TABLE_KEY)


def relationships(catalog: DataFrame, rules: dict) -> DataFrame:
    """One edge per foreign-key reference.

    ``to`` is the reference as recorded; ``to_resolved`` adds the database and drops the schema, which
    makes it the id of a column node.
    """
    ns = rules["namespace"]
    forward, backward = relationship_of(rules["relationship_types"])
    parts = F.split("fk_references", r"\.")
    own = F.concat(F.lit(f"{ns}:"), F.col("database"), F.lit("."))
    to = F.when(F.contains("fk_references", F.lit(".")), F.concat(F.lit(f"{ns}:"), "fk_references")).otherwise(
        F.concat(own, "fk_references")
    )
    resolved = F.when(
        F.size(parts) >= 2, F.concat(own, F.get(parts, F.size(parts) - 2), F.lit("."), F.get(parts, F.size(parts) - 1))
    ).otherwise(F.concat(own, "fk_references"))
    return catalog.where(F.col("is_foreign_key") & (F.col("fk_references") != "")).select(
        F.concat(F.lit(f"{ns}:rel_"), F.concat_ws("_", "database", "table_name", "column_name")).alias("id"),
        forward.alias("relationship_type"),
        backward.alias("inverse_type"),
        _path(ns, "database", "table_name", "column_name").alias("from"),
        to.alias("to"),
        resolved.alias("to_resolved"),
        _path(ns, "database", "table_name").alias("from_table"),
        F.col("fk_references").alias("to_reference"),
    )


# --- review queue -----------------------------------------------------------------------------------


def review_domain(facts: DataFrame) -> DataFrame:
    """Tables without a business domain."""
    return facts.where(F.contains("belongs_to_domain", F.lit("UncategorizedDomain"))).select(
        "id", F.concat_ws(".", "database", "table_name").alias("table"), "row_count",
        F.lit("Table not classified into any business domain").alias("reason"),
        F.lit("Review table purpose and assign to appropriate domain").alias("suggested_action"),
    )


def review_unclassified(nodes: DataFrame) -> DataFrame:
    """Columns that no role rule matched."""
    return nodes.where(F.col("semantic_role") == "Unclassified").select(
        "id", F.col("column_name").alias("column"), F.col("table_name").alias("table"), "data_type",
        F.lit("No semantic role pattern matched").alias("reason"),
        F.lit("Add a pattern to the rule file or classify manually").alias("suggested_action"),
    )


def review_high_null(nodes: DataFrame) -> DataFrame:
    """Profiled columns that are mostly null; the percentage in the text rounds half to even."""
    percent = F.bround(F.col("null_rate") * 100, 0).cast("int").cast("string")
    return nodes.where(F.col("null_rate") > HIGH_NULL_RATE).select(
        "id", F.col("column_name").alias("column"), F.col("table_name").alias("table"), "null_rate",
        F.concat(F.lit("Column is "), percent, F.lit("% null")).alias("reason"),
        F.lit("Verify if column is deprecated or has data quality issues").alias("suggested_action"),
    )


def review_low_cardinality(nodes: DataFrame) -> DataFrame:
    """Profiled columns with few values whose role does not explain it."""
    few = (F.col("distinct_count") > 0) & (F.col("distinct_count") < LOW_CARDINALITY)
    rows = nodes.where((F.col("profiled_rows") > MIN_PROFILED) & few & ~F.col("semantic_role").isin(CODED_ROLES))
    reason = F.concat(
        F.lit("Only "), F.col("distinct_count").cast("string"),
        F.lit(" distinct values - may be a code/status field"),
    )
    return rows.select(
        "id", F.col("column_name").alias("column"), F.col("table_name").alias("table"), "distinct_count",
        F.col("semantic_role").alias("current_role"), reason.alias("reason"),
        F.lit("Consider reclassifying as Code or StatusIndicator").alias("suggested_action"),
    )


def review_summary(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Items per category and in total (category ``total``); one pass over the nodes, one over the tables."""
    few = (F.col("distinct_count") > 0) & (F.col("distinct_count") < LOW_CARDINALITY)
    low = (F.col("profiled_rows") > MIN_PROFILED) & few & ~F.col("semantic_role").isin(CODED_ROLES)

    def entry(name: str, condition: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), F.count_if(condition).alias("items"))

    columns = nodes.agg(
        F.array(
            entry("unclassifiedColumns", F.col("semantic_role") == "Unclassified"),
            entry("highNullRateColumns", F.col("null_rate") > HIGH_NULL_RATE),
            entry("lowCardinalityColumns", low),
        ).alias("e")
    )
    tables = facts.agg(
        F.array(entry("domainReview", F.contains("belongs_to_domain", F.lit("UncategorizedDomain")))).alias("e")
    )
    counts = columns.unionByName(tables).select(F.inline("e"))
    return counts.rollup("category").agg(F.sum("items").alias("items")).select(
        F.coalesce("category", F.lit("total")).alias("category"), "items"
    )


# --- configured nodes -------------------------------------------------------------------------------


def metric_nodes(catalog: DataFrame, rules: dict) -> DataFrame:
    """One row per metric and source column, with the catalog column it resolves to.

    Sources are written ``database.schema.table.column``; ``resolved`` is false for an unknown one.
    """
    ns = rules["namespace"]
    rows = [
        (
            f"{ns}:metric:{m['id']}", m.get("label", m["id"]), m.get("description", ""), m.get("formula", ""),
            list(m.get("source_columns", [])),
            [f"{c.get('field', '')} {c.get('operator', '')} {c.get('value', '')}" for c in m.get("conditions", [])],
            m.get("observation_window_days"), m.get("notes"),
        )
        for m in rules.get("metrics", [])
    ]
    spec = (
        "id string, label string, description string, formula string, source_columns array<string>, "
        "conditions array<string>, observation_window_days int, notes string"
    )
    metrics = catalog.sparkSession.createDataFrame(rows, spec).withColumn(
        "source_column", F.explode_outer("source_columns")
    )
    known = catalog.select(
        F.concat_ws(".", *TABLE_KEY, "column_name").alias("source_column"), F.col("data_type")
    ).join(F.broadcast(metrics.select("source_column").distinct()), "source_column", "left_semi").groupBy(
        "source_column"
    ).agg(F.min("data_type").alias("data_type"))
    return metrics.join(known, "source_column", "left").select(
        "id", "label", "description", "formula", "source_column", "data_type",
        F.col("data_type").isNotNull().alias("resolved"), F.concat_ws("; ", "conditions").alias("conditions"),
        "observation_window_days", "notes",
    )


def core_entities(catalog: DataFrame, rules: dict) -> DataFrame:
    """Configured core entities with the catalog's row count, domain and whether the key column exists."""
    ns = rules["namespace"]
    rows = [
        (
            f"{ns}:core:{e['table']}", e.get("label", e["table"]), e.get("description", ""), e["table"],
            e.get("key_column", ""), bool(e.get("is_aggregate_root", False)),
            f"{ns}:core:{e['belongs_to']}" if "belongs_to" in e else None,
        )
        for e in rules.get("core_entities", [])
    ]
    spec = (
        "id string, label string, description string, table string, key_column string, "
        "is_aggregate_root boolean, belongs_to string"
    )
    wanted = catalog.sparkSession.createDataFrame(rows, spec)
    # configured rows: their number is that of the rule file
    found = (
        catalog.withColumn("table", F.concat_ws(".", *TABLE_KEY))
        .join(F.broadcast(wanted.select("table", "key_column")), "table")
        .groupBy("table", "database", "table_name")
        .agg(
            F.max("row_count_estimate").alias("row_count"),
            F.max(F.col("column_name") == F.col("key_column")).alias("key_found"),
        )
        .select("table", "row_count", "key_found", domain_of(rules["domains"]).alias("domain"))
    )
    return wanted.join(found, "table", "left").select(
        "id", "label", "description", "table", "key_column", "is_aggregate_root", "belongs_to", "row_count",
        "domain", F.coalesce("key_found", F.lit(False)).alias("key_found"),
    )


# --- whole document and queries over it -------------------------------------------------------------


def graph_documents(
    catalog: DataFrame, rules: dict, *, nodes: DataFrame | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Every node and edge as one JSON object per row, told apart by ``type``; from given nodes where there are any."""
    nodes = column_nodes(catalog, rules) if nodes is None else nodes
    facts = entity_facts(nodes, rules) if facts is None else facts
    tables = facts.select(
        F.lit("Entity").alias("type"), "id",
        F.to_json(
            F.struct(
                F.col("id").alias("@id"), F.col("types").alias("@type"), F.col("table_name").alias("rdfs:label"),
                "database", "schema", F.col("belongs_to_domain").alias("belongsToDomain"),
                F.col("row_count").alias("rowCount"), F.col("column_count").alias("columnCount"),
                F.col("columns_needing_review").alias("columnsNeedingReview"),
                F.col("review_status").alias("reviewStatus"), F.col("review_reasons").alias("reviewReasons"),
            )
        ).alias("document"),
    )
    columns = nodes.select(
        F.lit("Column").alias("type"), "id",
        F.to_json(
            F.struct(
                F.col("id").alias("@id"), F.lit("Column").alias("@type"), F.col("column_name").alias("rdfs:label"),
                F.col("data_type").alias("dataType"), F.col("semantic_role").alias("semanticRole"),
                F.col("is_nullable").alias("isNullable"), F.col("is_primary_key").alias("isPrimaryKey"),
                F.col("is_foreign_key").alias("isForeignKey"), "references", F.col("null_count").alias("nullCount"),
                F.col("distinct_count").alias("distinctCount"), F.col("profiled_rows").alias("profiledRows"),
                F.col("null_rate").alias("nullRate"), F.col("review_status").alias("reviewStatus"),
                F.when(F.size("review_reasons") > 0, F.col("review_reasons")).alias("reviewReasons"),
            )
        ).alias("document"),
    )
    edges = relationships(catalog, rules).select(
        F.lit("Relationship").alias("type"), "id",
        F.to_json(
            F.struct(
                F.col("id").alias("@id"), F.lit("Relationship").alias("@type"),
                F.col("relationship_type").alias("relationshipType"), F.col("inverse_type").alias("inverseType"),
                "from", "to", F.col("from_table").alias("fromTable"), F.col("to_reference").alias("toReference"),
            )
        ).alias("document"),
    )
    return reduce(DataFrame.unionByName, [tables, columns, edges])


def graph_context(rules: dict, base_uri: str, extra: dict | None = None) -> dict:
    """JSON-LD context of the documents (fixed values plus the configured prefixes)."""
    return {
        **(extra or {}),
        "@vocab": base_uri,
        "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
        "xsd": "http://www.w3.org/2001/XMLSchema#",
        rules["namespace"]: base_uri,
        "generatedAt": {"@type": "xsd:dateTime"},
        "rowCount": {"@type": "xsd:integer"},
        "belongsToDomain": {"@type": "@id"},
        "hasColumn": {"@container": "@set"},
        "sourceColumns": {"@container": "@list"},
        "conditions": {"@container": "@list"},
    }


def write_graph(catalog: DataFrame, rules: dict, path: str) -> None:
    """JSON lines, one folder per node type."""
    graph_documents(catalog, rules).select("type", F.col("document").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("type").text(path)


def ontology_sections(
    catalog: DataFrame, rules: dict, *, base_uri: str, generated_at: Column, label: str = "Data catalog",
    comment: str = "Tables, columns and references of the catalog",
) -> DataFrame:
    """The whole document as one JSON object per row, told apart by ``section``.

    ``Root`` holds the context, the time and the source statistics; then come ``Domain``, ``Entity``, ``Column``,
    ``Relationship``, ``Metric``, ``CoreEntity``, ``ReviewItem`` and ``ReviewSummary``. No section is collected, so
    each may be as long as the catalog; metrics and core entities are as many as the rule file has.
    """
    ns = rules["namespace"]
    nodes = materialize(column_nodes(catalog, rules), "nodes")  # read by seven sections
    facts = materialize(entity_facts(nodes, rules), "facts")

    def section(name: str, rows: DataFrame, key: Column, **fields: Column | str) -> DataFrame:
        columns = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
        body = F.struct(key.alias("@id"), F.lit(name).alias("@type"), *columns)
        return rows.select(F.lit(name).alias("section"), key.alias("id"), F.to_json(body).alias("document"))

    stats = {camel(c): F.col(c) for c in ("total_columns", "total_tables", "total_databases", "total_foreign_keys")}
    root = section(
        "Root", source_stats(catalog), F.lit(f"{ns}:root"), label=F.lit(label), comment=F.lit(comment),
        generatedAt=F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"),
        sourceStats=F.struct(*[c.alias(k) for k, c in stats.items()]),
    )
    context = json.dumps({"@context": graph_context(rules, base_uri, rules.get("context"))})
    root = root.withColumn("document", F.concat(F.lit(context[:-1] + ","), F.substr("document", F.lit(2))))
    graph = graph_documents(catalog, rules, nodes=nodes, facts=facts).select(
        F.col("type").alias("section"), "id", "document"
    )
    domains = section(
        "Domain", domain_counts(catalog, rules["domains"]), F.concat(F.lit(f"{ns}:"), "domain"),
        label="label", comment="description", tableCount="table_count",
    )
    source = F.when(
        F.col("source_column").isNotNull(),
        F.struct(F.col("source_column").alias("column"), F.col("data_type").alias("dataType"), F.col("resolved")),
    )
    told = ["id", "label", "description", "formula", "conditions", "observation_window_days", "notes"]
    per_metric = metric_nodes(catalog, rules).groupBy(*told).agg(F.sort_array(F.collect_list(source)).alias("sources"))
    metrics = section(
        "Metric", per_metric, F.col("id"), label="label", comment="description", formula="formula",
        sourceColumns="sources", conditions="conditions", observationWindowDays="observation_window_days", notes="notes",
    )
    core = section(
        "CoreEntity", core_entities(catalog, rules), F.col("id"), label="label", comment="description", table="table",
        keyColumn="key_column", keyFound="key_found", isAggregateRoot="is_aggregate_root", belongsTo="belongs_to",
        rowCount="row_count", domain="domain",
    )
    queue = {
        "domainReview": review_domain(facts), "unclassifiedColumns": review_unclassified(nodes),
        "highNullRateColumns": review_high_null(nodes), "lowCardinalityColumns": review_low_cardinality(nodes),
    }
    items = [
        section(
            "ReviewItem", rows, F.col("id"), category=F.lit(category),
            **{camel(c): c for c in rows.columns if c != "id"},
        )
        for category, rows in queue.items()
    ]
    summary = section(
        "ReviewSummary", review_summary(nodes, facts), F.concat(F.lit(f"{ns}:review:"), "category"), items="items"
    )
    return reduce(DataFrame.unionByName, [root, domains, graph, metrics, core, *items, summary])


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def write_ontology(catalog: DataFrame, rules: dict, path: str, **options) -> None:
    """All sections as gzipped JSON lines, one folder per section; ``options`` as in ``ontology_sections``.

    The documents repeat their field names and prefixes in every row: as plain text they take many times the disk of the
    catalog. A task keeps a file of each of its sections open, so that nothing is sorted, and spilled, by section first.
    """
    sections = ontology_sections(catalog, rules, **options).select("section", F.col("document").alias("value"))
    conf, setting = catalog.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(setting)
    conf.set(setting, str(max(int(before), OPEN_SECTIONS)))
    try:
        rows = sections.write.mode("overwrite").partitionBy("section").option("maxRecordsPerFile", SECTION_ROWS)
        rows.text(path, compression="gzip")
    finally:
        conf.set(setting, before)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """``section, id, document`` of a written document."""
    found = spark.read.option("basePath", path).text(path)
    return found.select("section", F.get_json_object("value", "$['@id']").alias("id"), F.col("value").alias("document"))


def entities_in_domain(facts: DataFrame, domain: str) -> DataFrame:
    return facts.where(F.col("domain") == domain).select("id", *TABLE_KEY, "row_count", "column_count")


def columns_by_role(nodes: DataFrame, role: str) -> DataFrame:
    return nodes.where(F.col("semantic_role") == role).select("id", *TABLE_KEY, "column_name", "data_type")


def edges_from_table(edges: DataFrame, table_id: str) -> DataFrame:
    return edges.where(F.col("from_table") == table_id)


def large_entities(facts: DataFrame, *, above: int = 1_000_000, n: int = 15) -> DataFrame:
    """Largest tables of the graph with their domain."""
    return (
        facts.where(F.col("row_count") > above)
        .select(*TABLE_KEY, "row_count", "domain")
        .orderBy(F.col("row_count").desc(), *TABLE_KEY)
        .limit(n)
    )


def domain_section(counts: DataFrame, *, width: int = 50) -> DataFrame:
    """Domain table of the summary; a long description is cut."""
    cut = F.when(
        F.length("description") > width, F.concat(F.substring("description", 1, width), F.lit("..."))
    ).otherwise(F.col("description"))
    return counts.select("domain", "label", "table_count", cut.alias("comment"))


def role_section(catalog: DataFrame, rules: list[dict], *, shown: int = 3) -> DataFrame:
    """Role list of the summary with its first patterns and the number of columns it received."""
    spec = "role string, patterns string"
    listed = catalog.sparkSession.createDataFrame(
        [(r["id"], ", ".join(r.get("patterns", [])[:shown])) for r in rules], spec
    )
    counted = catalog.groupBy(role_of(rules).alias("role")).agg(F.count("*").alias("_n"))
    return listed.join(counted, "role", "left").select("role", "patterns", F.coalesce("_n", F.lit(0)).alias("columns"))


def review_section(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` review items, each with how many more there are."""
    more = items.count() - n
    return items.orderBy(*order).limit(n).withColumn("more", F.lit(max(more, 0)).cast("long"))
