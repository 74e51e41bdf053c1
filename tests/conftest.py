from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

from catalens.session import local_session  # noqa: E402

CATALOG_SPEC = (
    "target string, server string, database string, schema string, table_name string, column_name string, "
    "data_type string, is_nullable boolean, is_primary_key boolean, is_foreign_key boolean, fk_references string, "
    "row_count_estimate bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


def catalog_rows(*rows):
    out = []
    for database, table, column, kind, pk, fk, reference, count in rows:
        out.append(("test", "test-server", database, "dbo", table, column, kind, False, pk, fk, reference, count))
    return out


@pytest.fixture()
def happy(spark):
    """Five columns in four databases; one foreign key."""
    rows = catalog_rows(
        ("Orders", "Order", "OrderId", "int", True, False, None, 100000),
        ("Orders", "OrderItem", "OrderId", "int", False, True, "Order.OrderId", 500000),
        ("Customers", "Customer", "CustomerId", "int", True, False, None, 10000),
        ("Products", "Product", "ProductId", "int", True, False, None, 5000),
        ("Products", "Category", "CategoryId", "int", True, False, None, 100),
    )
    return spark.createDataFrame(rows, CATALOG_SPEC)


@pytest.fixture()
def many_blocks(spark):
    """Keep several range blocks even for small data, and never take the one-task path."""
    from catalens.operators import modeling
    from catalens.plans import ordered

    before = ordered.SMALL_ROWS, modeling.SMALL_ROWS
    ordered.SMALL_ROWS = modeling.SMALL_ROWS = 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    ordered.SMALL_ROWS, modeling.SMALL_ROWS = before
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
