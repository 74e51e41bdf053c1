"""Default rule tables (fixed values) and a reader for rule files."""

from __future__ import annotations

import tomllib

# fixed values: the rule sets a catalog starts with
DOMAINS = [
    {"id": "AuditDomain", "label": "Audit Domain", "priority": 1,
     "description": "Audit trails, history tables, and logs",
     "table_patterns": ["*History", "*Log", "Audit*", "Error*", "*Archive"]},
    {"id": "ReferenceDomain", "label": "Reference Domain", "priority": 2,
     "description": "Reference data, lookups, and configuration tables",
     "table_patterns": ["*Type", "*Status", "*Code", "*Config", "*Lookup"]},
    {"id": "UncategorizedDomain", "label": "Uncategorized", "priority": 99, "is_fallback": True,
     "description": "Tables not matching other domain rules - requires human review",
     "table_patterns": ["*"]},
]

SEMANTIC_ROLES = [
    {"id": "Identifier", "priority": 1,
     "patterns": ["*ID", "*IDSeq", "*Id", "*Code", "*Key", "*Guid", "*UUID"]},
    {"id": "Timestamp", "priority": 2,
     "patterns": ["*Date", "*Time", "*At", "*On", "Created*", "Updated*", "Modified*"],
     "data_types": ["datetime", "datetime2", "date", "timestamp"]},
    {"id": "Monetary", "priority": 3,
     "patterns": ["*Amount", "*Price", "*Cost", "*Fee", "*Charge", "*Total", "*Revenue"],
     "data_types": ["money", "decimal", "numeric"]},
    {"id": "Quantity", "priority": 4,
     "patterns": ["*Count", "*Qty", "*Quantity", "*Number", "*Units"],
     "data_types": ["int", "bigint", "smallint"]},
    {"id": "BooleanFlag", "priority": 5,
     "patterns": ["Is*", "Has*", "*Flag", "*Enabled", "*Active"],
     "data_types": ["bit", "boolean", "tinyint"]},
    {"id": "StatusIndicator", "priority": 6, "patterns": ["*Status", "*State", "*Stage"]},
    {"id": "Percentage", "priority": 7, "patterns": ["*Percent", "*Pct", "*Rate", "*Ratio"]},
    {"id": "Description", "priority": 8,
     "patterns": ["*Name", "*Desc", "*Description", "*Title", "*Label", "*Comment", "*Notes"],
     "data_types": ["varchar", "nvarchar", "text", "ntext"]},
    {"id": "Unclassified", "priority": 99, "is_fallback": True, "patterns": ["*"]},
]

RELATIONSHIP_TYPES = [
    {"pattern": "*CustomerID*", "type": "belongsToCustomer", "inverse": "hasCustomer"},
    {"pattern": "*OrderID*", "type": "partOfOrder", "inverse": "hasOrderItem"},
    {"pattern": "*ID*", "type": "references", "inverse": "referencedBy"},
]

DEFAULT_PRIORITY = 50
FALLBACK_DOMAIN = "UncategorizedDomain"
FALLBACK_ROLE = "Unclassified"
DEFAULT_RELATIONSHIP = ("references", "referencedBy")


def default_rules() -> dict:
    return {
        "namespace": "app",
        "domains": DOMAINS,
        "semantic_roles": SEMANTIC_ROLES,
        "relationship_types": RELATIONSHIP_TYPES,
        "metrics": [],
        "core_entities": [],
    }


def read_rules(path: str) -> dict:
    """Rules from a TOML file on the driver; sections it lacks are empty."""
    with open(path, "rb") as handle:
        given = tomllib.load(handle)
    sections = {k: given.get(k, []) for k in ("domains", "semantic_roles", "relationship_types", "metrics", "core_entities")}
    return {"namespace": given.get("ontology", {}).get("namespace", "app"), **sections}


def in_order(rules: list[dict]) -> list[dict]:
    """Rules by priority; at equal priority a fallback comes last."""
    return sorted(rules, key=lambda r: (r.get("priority", DEFAULT_PRIORITY), bool(r.get("is_fallback"))))
