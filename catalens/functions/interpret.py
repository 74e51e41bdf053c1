"""Plain-language readings of metrics, joins, aggregations and filters.

Each reading is an ordered list of (condition, text); the first that holds wins. Conditions are built from
keyword tests on lower-cased columns, so the whole interpreter is one ``when`` chain.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.classify import first_match


def _has(text: Column, *words: str) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def _member(items: Column, *words: str) -> Column:
    return F.exists(items, lambda c: F.lower(c).isin(list(words)))


def _spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def _titled(text: Column) -> Column:
    """Every letter after a non-letter in upper case, all others in lower case."""
    parts = F.split(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})")
    raised = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.array_join(raised, "")


def interpret_metric(name: str = "name", formula: str = "formula", columns: str = "columns_used",
                     is_ratio: str = "is_ratio") -> Column:
    name_ = F.lower(F.coalesce(F.col(name), F.lit("")))
    formula_ = F.lower(F.coalesce(F.col(formula), F.lit("")))
    cols, ratio = F.coalesce(F.col(columns), F.array().cast("array<string>")), F.coalesce(F.col(is_ratio), F.lit(False))

    def either(*words: str) -> Column:
        return _has(name_, *words) | _has(formula_, *words)

    money = either("revenue", "charge", "amount", "price", "cost")
    counting = formula_.contains("count")
    status = _member(cols, "statuscode", "status")
    # fixed values: keywords and texts
    return first_match(
        [
            (money & either("net"), "Net revenue calculation (after discounts/adjustments)"),
            (money & either("discount"), "Discount amount or rate calculation"),
            (money & ratio, "Financial ratio (e.g., margin, discount rate)"),
            (money, "Revenue or monetary calculation"),
            (counting & _has(formula_, "cncl", "cancel"), "Count of cancelled items - potential churn metric"),
            (counting & _has(formula_, "fulf", "fulfill", "complete"), "Count of fulfilled/completed items"),
            (counting & either("order"), "Order volume count"),
            (counting & formula_.contains("invoice"), "Invoice count"),
            (counting, "Volume/count metric"),
            (ratio & status, "Status-based rate (e.g., churn rate, fulfillment rate)"),
            (ratio & _has(name_, "rate", "percent", "pct", "ratio"), "Percentage or rate calculation"),
            (ratio, "Ratio calculation - likely a KPI"),
            (status, "Status-based metric (tracks order/item states)"),
            (_member(cols, "date", "time", "created", "modified"), "Time-based calculation (duration, aging, etc.)"),
            ((name_ != "") & (name_ != "(unnamed)"), F.concat(F.lit("Business metric: "), _titled(_spaced(name_)))),
        ],
        "Calculated business metric",
    )


# fixed values: table pairs and their meaning
KNOWN_PAIRS = [
    ("order", "orderitem", "Order to line items - order details breakdown"),
    ("orderitem", "order", "Line items to parent order"),
    ("order", "company", "Orders to customer company"),
    ("order", "account", "Orders to customer account"),
    ("order", "property", "Orders to property location"),
    ("orderitem", "product", "Line items to product catalog"),
    ("invoice", "invoiceitem", "Invoice to line items - billing details"),
    ("invoiceitem", "invoice", "Invoice items to parent invoice"),
    ("quote", "quoteitem", "Quote to line items - proposal details"),
    ("quoteitem", "quote", "Quote items to parent quote"),
    ("company", "property", "Company to managed properties"),
    ("property", "company", "Properties to owning company"),
    ("product", "family", "Product to product family/category"),
    ("product", "charge", "Product to pricing/charges"),
]


def interpret_join(left_table: str = "left_table", right_table: str = "right_table") -> Column:
    left = F.lower(F.substring_index(F.coalesce(F.col(left_table), F.lit("")), ".", -1))
    right = F.lower(F.substring_index(F.coalesce(F.col(right_table), F.lit("")), ".", -1))
    known = [
        ((left.contains(a) & right.contains(b)) | (right.contains(a) & left.contains(b)), text)
        for a, b, text in KNOWN_PAIRS
    ]
    # fixed values: keywords and texts
    hints = [
        (right.contains("item"), "Parent to child items relationship"),
        (left.contains("item"), "Child items to parent relationship"),
        (_has(right, "company", "customer", "account"), "Links to customer/account information"),
        (_has(right, "product", "charge", "price"), "Links to product/pricing information"),
        (_has(right, "property", "location", "site"), "Links to property/location information"),
    ]
    return first_match(known + hints, "Table relationship")


def interpret_aggregation(function: str = "function", column: str = "column", alias: str = "alias") -> Column:
    func = F.upper(F.coalesce(F.col(function), F.lit("")))
    col = F.lower(F.coalesce(F.col(column), F.lit("")))
    name = F.lower(F.coalesce(F.col(alias), F.lit("")))

    def within(kind: str, *more: Column) -> Column:
        return reduce(and_, more, func == kind)

    money = _has(col, "amount", "charge", "price", "cost", "revenue")
    price = _has(col, "amount", "charge", "price")
    extreme = func.isin("MIN", "MAX")
    star = col == "*"
    low = func == "MIN"
    # fixed values: keywords and texts
    return first_match(
        [
            (within("COUNT", star, name.contains("order")), "Total order count"),
            (within("COUNT", star, name.contains("invoice")), "Total invoice count"),
            (within("COUNT", star, name.contains("item")), "Total line item count"),
            (within("COUNT", star), "Record count - volume metric"),
            (within("COUNT", col.contains("status")), "Count by status - for status distribution analysis"),
            (within("COUNT", col.contains("id")), "Distinct entity count"),
            (within("COUNT"), F.concat(F.lit("Count of "), _spaced(col))),
            (within("SUM", money, col.contains("net")), "Total net revenue (after adjustments)"),
            (within("SUM", money, col.contains("discount")), "Total discounts applied"),
            (within("SUM", money), "Total monetary value - financial metric"),
            (within("SUM", _has(col, "quantity", "qty", "units")), "Total quantity/units"),
            (within("SUM"), F.concat(F.lit("Sum of "), _spaced(col))),
            (within("AVG", price), "Average transaction value"),
            (within("AVG", col.contains("discount")), "Average discount rate"),
            (within("AVG", _has(col, "duration", "days")), "Average time duration"),
            (within("AVG"), F.concat(F.lit("Average "), _spaced(col))),
            (extreme & _has(col, "date", "time"), F.when(low, "Earliest date/time").otherwise("Latest date/time")),
            (extreme & price, F.when(low, "Minimum value").otherwise("Maximum value")),
            (extreme, F.concat(func, F.lit(" of "), _spaced(col))),
        ],
        F.concat(func, F.lit("("), F.coalesce(F.col(column), F.lit("")), F.lit(")")),
    )


def interpret_filter(column: str = "column", operator: str = "operator", values: str = "value_pattern") -> Column:
    col = F.substring_index(F.lower(F.coalesce(F.col(column), F.lit(""))), ".", -1)
    op = F.upper(F.coalesce(F.col(operator), F.lit("")))
    vals = F.upper(F.coalesce(F.col(values), F.lit("")))
    status = col.contains("status")
    dated = _has(col, "date", "time", "created", "modified")
    keyed = col.endswith("id") | col.endswith("idseq")
    # fixed values: keywords and texts
    return first_match(
        [
            (status & vals.contains("CNCL"), "Filtering to CANCELLED items - churn/cancellation analysis"),
            (status & vals.contains("FULF"), "Filtering to FULFILLED items - completed orders"),
            (status & vals.contains("PEND"), "Filtering to PENDING items - in-progress orders"),
            (status & vals.contains("EXPD"), "Filtering to EXPIRED items"),
            (status & (op == "IN"), "Filtering by specific status codes"),
            (status, "Status-based filter"),
            (dated & op.isin(">", ">=", "BETWEEN"), "Date range filter - time-bounded query"),
            (dated, "Date-based filter"),
            (keyed & vals.contains("@"), "Parameter-driven lookup by ID"),
            (keyed, "Filtering by specific entity ID"),
            (_has(col, "flag", "is_", "has_"), "Boolean/flag filter"),
            (_has(col, "type", "code"), "Filtering by type/category code"),
            (op == "IS NULL", F.concat(F.lit("Finding records where "), _spaced(col), F.lit(" is missing"))),
            (op == "IS NOT NULL", F.concat(F.lit("Finding records where "), _spaced(col), F.lit(" exists"))),
        ],
        F.concat(F.lit("Filter on "), _spaced(col)),
    )
