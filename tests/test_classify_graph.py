from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from catalens.functions.patterns import column_pattern, fnmatch_pattern, table_pattern
from catalens.functions.rules import default_rules, read_rules
from catalens.operators import classify, graph
from catalens.plans.schemas import CATALOG
from catalens.sources.catalog_io import conform


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [
        ("*Log", ["ErrorLog", "log"], ["LogEntry"]),
        ("Audit*", ["AuditTrail"], ["MyAudit"]),
        ("Or*Item", ["OrderItem"], ["OrderItems", "MyOrderItem"]),
        ("Order", ["MyOrders"], ["Quote"]),
        ("*Mid*", ["aMidb", "Mid"], ["none"]),
        ("A.B", ["xA.By"], ["AxB"]),
        ("*", ["anything"], []),
    ],
)
def test_table_patterns(pattern, hits, misses):
    regex = re.compile(table_pattern(pattern), re.I)
    assert all(regex.search(h) for h in hits) and not any(regex.search(m) for m in misses)


def test_column_patterns_are_unanchored_unless_asked():
    assert re.search(column_pattern("Is*"), "Discount", re.I)
    assert not re.search(column_pattern("Is*", anchored=True), "Discount", re.I)
    assert column_pattern("^Id$") == "^Id$"


def test_fnmatch_is_for_the_whole_name():
    assert re.search(fnmatch_pattern("*ID?"), "xIDs") and not re.search(fnmatch_pattern("ID"), "xID")
    assert re.search(fnmatch_pattern("[!a]b"), "cb") and not re.search(fnmatch_pattern("[!a]b"), "ab")


def names(spark, rows):
    return spark.createDataFrame(rows, "database string, table_name string")


def test_domain_order_affinity_and_fallback(spark):
    rules = [
        {"id": "Late", "table_patterns": ["Order"], "priority": 60},
        {"id": "Default", "table_patterns": ["Order"]},
        {"id": "Owned", "database_affinity": ["Crm"], "table_patterns": ["Nope"], "priority": 1},
        {"id": "Rest", "is_fallback": True, "table_patterns": ["*"], "priority": 0},
    ]
    df = names(spark, [("Crm", "Order"), ("x", "MyOrder"), ("x", "Quote"), ("x", None)])
    got = [r.d for r in df.select(classify.domain_of(rules).alias("d")).collect()]
    assert got == ["Owned", "Default", "Rest", "Rest"]
    assert names(spark, [("a", "b")]).select(classify.domain_of([]).alias("d")).first().d == "UncategorizedDomain"


def test_role_checks_types_and_keys(spark):
    rules = [
        {"id": "Key", "patterns": ["*Id"], "conditions": {"is_primary_key": True}, "priority": 1},
        {"id": "Money", "patterns": ["*Amount"], "data_types": ["MONEY"], "priority": 2},
        {"id": "Text", "patterns": ["*Amount"], "priority": 3},
    ]
    df = spark.createDataFrame(
        [("OrderId", "int", True, None), ("OrderId", "int", None, None), ("Amount", "money", False, False), ("Amount", "int", False, False)],
        "column_name string, data_type string, is_primary_key boolean, is_foreign_key boolean",
    )
    assert [r.r for r in df.select(classify.role_of(rules).alias("r")).collect()] == ["Key", "Unclassified", "Money", "Text"]


def test_rules_file(tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text('[ontology]\nnamespace = "x"\n[[domains]]\nid = "D"\ntable_patterns = ["*"]\n')
    rules = read_rules(str(path))
    assert rules["namespace"] == "x" and rules["domains"][0]["id"] == "D" and rules["metrics"] == []


@pytest.fixture()
def profiled(spark, happy):
    return conform(happy, CATALOG).withColumns(
        {"profiled_rows": F.lit(200).cast("long"), "null_rate": F.when(F.col("database") == "Products", 0.625).otherwise(0.0),
         "null_count": F.lit(5).cast("long"), "distinct_count": F.when(F.col("database") == "Orders", 5).otherwise(50).cast("long")}
    )


def test_nodes_facts_and_review(spark, profiled):
    rules = default_rules()
    nodes = graph.column_nodes(profiled, rules)
    node = nodes.where("table_name = 'Product'").first()
    assert node.id == "app:Products.Product.ProductId" and node.review_reasons == ["high_null_rate"]
    facts = {r.table_name: r for r in graph.entity_facts(nodes, rules).collect()}
    assert facts["Product"].review_reasons == ["unclassified_domain", "many_unclassified_columns"]
    assert facts["Order"].types == ["Table", "UncategorizedEntity"]
    assert {r.reason for r in graph.review_high_null(nodes).collect()} == {"Column is 62% null"}
    assert graph.review_low_cardinality(nodes).count() == 2
    summary = {r.category: r["items"] for r in graph.review_summary(nodes, graph.entity_facts(nodes, rules)).collect()}
    assert summary == {
        "domainReview": 5, "unclassifiedColumns": 0, "highNullRateColumns": 2, "lowCardinalityColumns": 2, "total": 9
    }


def test_unprofiled_columns_carry_no_profile(happy):
    nodes = graph.column_nodes(conform(happy, CATALOG), default_rules())
    documents = graph.graph_documents(conform(happy, CATALOG), default_rules())
    assert nodes.where("null_rate is not null").count() == 0
    column = json.loads(documents.where("type = 'Column' and id = 'app:Orders.Order.OrderId'").first().document)
    assert "nullRate" not in column and "isForeignKey" not in column and column["isPrimaryKey"] is True


def test_entities_nest_and_split(spark, happy):
    wide = conform(happy, CATALOG).where("table_name = 'Order'").select(
        *[c for c in CATALOG.names if c != "column_name"],
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.format_string("c%02d", i))).alias("column_name"),
    )
    nodes = graph.column_nodes(wide, default_rules())
    whole = graph.entities(nodes, default_rules()).collect()
    assert len(whole) == 1 and [c.column_name for c in whole[0].has_column] == [f"c{i:02d}" for i in range(1, 51)]
    parts = graph.entities(nodes, default_rules(), parts=5).collect()
    assert len(parts) == 5 and sum(len(p.has_column) for p in parts) == 50
    assert {p.column_count for p in parts} == {50}
    bare = graph.column_nodes(wide.withColumn("schema", F.lit(None).cast("string")), default_rules())
    assert graph.entities(bare, default_rules()).count() == 1


def test_edges_resolve_to_column_ids(happy):
    edge = graph.relationships(happy, default_rules()).first()
    assert edge.to == "app:Order.OrderId" and edge.to_resolved == "app:Orders.Order.OrderId"
    assert edge.relationship_type == "references" and edge.id == "app:rel_Orders_OrderItem_OrderId"


def test_same_named_tables_of_two_schemas_stay_apart(happy):
    both = conform(happy.unionByName(happy.withColumn("schema", F.lit("sales"))), CATALOG)
    facts = graph.entity_facts(graph.column_nodes(both, default_rules()), default_rules())
    assert facts.count() == 10


def test_ontology_sections_round_trip(spark, tmp_path):
    spec = (
        "target string, server string, database string, schema string, table_name string, column_name string, data_type string, "
        "is_nullable boolean, is_primary_key boolean, is_foreign_key boolean, fk_references string, row_count_estimate long, "
        "null_count long, null_rate double, distinct_count long, profiled_rows long"
    )
    rows = [
        ("t", "s", "d", "dbo", "Order", "OrderID", "int", False, True, False, "", 5, 0, 0.0, 5, 5),
        ("t", "s", "d", "dbo", "Item", "OrderID", "int", False, False, True, "dbo.Order.OrderID", 9, 8, 0.9, 1, 9),
    ]
    rules = {**default_rules(), "context": {"dc": "urn:dc#"}}
    options = {"base_uri": "urn:x#", "generated_at": F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), "label": "Mine"}
    for n, data in enumerate([rows, []]):
        catalog, path = spark.createDataFrame(data, spec), str(tmp_path / str(n))
        graph.write_ontology(catalog, rules, path, **options)
        found = [(r.section, r.id, json.loads(r.document)) for r in graph.read_ontology(spark, path).collect()]
        root = next(d for s, _, d in found if s == "Root")
        assert root["@context"]["dc"] == "urn:dc#" and root["@context"]["@vocab"] == "urn:x#" and root["label"] == "Mine"
        assert root["generatedAt"] == "2024-05-06T07:08:09" and root["@type"] == "Root"
        assert root["sourceStats"]["totalColumns"] == len(data) and root["sourceStats"]["totalForeignKeys"] == len(data) // 2
        names = {s for s, _, _ in found}
        assert {"Root", "Domain"} <= names and (not data or {"Entity", "Column", "Relationship", "ReviewItem", "ReviewSummary"} <= names)
        high = [d for s, _, d in found if s == "ReviewItem" and d["category"] == "highNullRateColumns"]
        assert [d["reason"] for d in high] == (["Column is 90% null"] if data else [])
        assert all(d["@id"] == i for _, i, d in found)
