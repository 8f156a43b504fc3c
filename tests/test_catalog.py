"""Every registered query against its SQL counterpart, over the whole smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))

import check_results  # noqa: E402

import __spark_entry__  # noqa: E402

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="benchmark tables are absent")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in check_results.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, _, _, note = check_results.compare(spark, str(SF), name, QUERIES[name], ORACLES.get(name), con)
    assert state in ("ok", "rows-only"), note


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["txn_id", "account_id", "fraud_score", "decision"]
