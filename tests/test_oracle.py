"""Every catalogue query against its DuckDB oracle."""

import os

import pytest

import __spark_entry__ as E
from pnlbook.plans.catalog import QUERIES
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_util import duck, same

SQL = E.oracle_sql()
NAMES = sorted(QUERIES)           # the llm queries have their own tests


# sf0.01 always; the smaller scale too if PNLBOOK_ORACLE_SMALL is set
SCALES = [SF_MID] + ([SF_SMALL] if os.environ.get("PNLBOOK_ORACLE_SMALL") else [])


@pytest.fixture(scope="module")
def cons():
    return {d: duck(d) for d in SCALES}


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(SQL)


@pytest.mark.parametrize("sf_dir", SCALES, ids=lambda d: d.rsplit("/", 1)[-1])
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, cons, name, sf_dir):
    same(E.queries()[name](spark, sf_dir), cons[sf_dir], SQL[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "month", "trade_count", "net_pnl", "wins", "losses",
                          "win_rate_pct", "profit_factor"]
