"""Exact decimal arithmetic on Columns.

All money is DECIMAL; every rounding is half up (away from zero), as a
database NUMERIC does, never through doubles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from pnlbook.schemas import MONEY

# Working type for sums and ratio inputs: 28 integer digits, 4 places.
WIDE = "decimal(32,4)"


def dec(value) -> Column:
    """A decimal literal typed by its own digits (no float step)."""
    return F.lit(Decimal(str(value)))


def pnl_of(side: Column, entry: Column, exit_: Column, size: Column) -> Column:
    """PnL of one trade: LONG gains exit - entry, any other side entry - exit.

    Multiplied by the size and rounded half up to cents, stored with four
    places. NULL if the result does not fit DECIMAL(18,4).
    """
    move = F.when(side == "LONG", exit_ - entry).otherwise(entry - exit_)
    return F.round(move * size, 2).try_cast(MONEY)


def ratio_half_up(num: Column, den: Column, scale: int, out_type: str) -> Column:
    """round(num / den, scale), half up, computed exactly.

    For num >= 0 and den > 0. The quotient q = floor((2*num*10^s + den) /
    (2*den)) is found as (a - pmod(a, b)) / b, which divides exactly, so no
    division result is ever cut to a finite scale. NULL when den is 0 or NULL.
    """
    n = num.cast(WIDE)
    d = F.nullif(den.cast(WIDE), dec(0))
    a = n * dec(2 * 10 ** scale) + d
    b = d * dec(2)
    q = (a - F.pmod(a, b)) / b
    return (q.cast("decimal(38,0)") * dec(Decimal(1).scaleb(-scale))).cast(out_type)


def money(c: Column) -> Column:
    return c.cast(MONEY)
