"""Exact half-up ratios against Python's Decimal arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import functions as F

from pnlbook.functions.money import pnl_of, ratio_half_up


def _expect(n, d, k):
    if d == 0:
        return None
    return (D(n) / D(d)).quantize(D(1).scaleb(-k), rounding=ROUND_HALF_UP)


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_ratio_half_up_matches_decimal(spark, k):
    rnd = random.Random(k)
    rows = []
    for _ in range(400):
        d = D(rnd.randrange(0, 10 ** rnd.randrange(1, 14))) / 10000
        n = D(rnd.randrange(0, 10 ** rnd.randrange(1, 14))) / 10000
        rows.append((n, d))
    # exact ties and near ties
    rows += [(D("0.2875"), D("1")), (D("23"), D("80") / 100), (D("1"), D("8")), (D("5"), D("2")),
             (D("28.749999"), D("1")), (D("0"), D("3")), (D("7"), D("0"))]
    df = spark.createDataFrame(rows, "n DECIMAL(28,4), d DECIMAL(28,4)")
    got = df.select("n", "d", ratio_half_up(F.col("n"), F.col("d"), k, "decimal(38,6)").alias("r")).collect()
    for r in got:
        want = _expect(r.n, r.d, k)
        assert (r.r is None and want is None) or r.r == want, (r.n, r.d, r.r, want)


def test_pnl_rounds_half_away_from_zero(spark):
    rows = [("LONG", D("100"), D("100.005"), D("1")), ("SHORT", D("100"), D("100.005"), D("1")),
            ("LONG", D("10"), D("10.0049"), D("1")), ("SHORT", D("1"), D("2"), D("3.3333"))]
    df = spark.createDataFrame(rows, "t STRING, e DECIMAL(18,4), x DECIMAL(18,4), s DECIMAL(18,4)")
    got = [r[0] for r in df.select(pnl_of(F.col("t"), F.col("e"), F.col("x"), F.col("s"))).collect()]
    assert got == [D("0.0100"), D("-0.0100"), D("0.0000"), D("-3.3300")]
