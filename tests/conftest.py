"""One local session and hand-made transaction lines for all tests."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketlake.session import build_session  # noqa: E402
from basketlake.sources.contracts import CANONICAL_SCHEMA  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

NULLABLE = T.StructType([T.StructField(f.name, f.dataType, True) for f in CANONICAL_SCHEMA.fields])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_lines(spark):
    """Rows (invoice, code, description, quantity, date, price, customer, country) as lines."""
    def make(rows):
        return spark.createDataFrame(
            [(i, s, d, q, t if isinstance(t, datetime) else datetime.fromisoformat(t),
              Decimal(str(p)), c, k) for i, s, d, q, t, p, c, k in rows], NULLABLE)
    return make


def sample_rows():
    """Eight customers with six orders 25 days apart, a return, a postage line and an odd line."""
    rows, start = [], datetime(2021, 1, 5, 10)
    for c in range(8):
        for o in range(6):
            when = start + timedelta(days=25 * o + c)
            for p in range(3):
                code = f"P{(c + o + p) % 12:02d}"
                rows.append((f"5{c}{o}", code, f" product   {code} item ", 2 + p + c, when,
                             1.5 + ((c + o + p) % 12) / 4, f"CUST{c}", "France" if c % 2 else "Spain"))
    rows.append(("C900", "P01", "PRODUCT P01 ITEM", -2, datetime(2021, 4, 1), 1.75, "CUST0", "Spain"))
    rows.append(("901", "POST", "postage", 1, datetime(2021, 4, 2), 9.0, "CUST1", "France"))
    rows.append(("902", "P02", None, 1, datetime(2021, 5, 30), 0, None, "Spain"))
    return rows


@pytest.fixture(scope="session")
def sample(make_lines):
    return make_lines(sample_rows())
