"""Display text as Columns (H1-H10). All are built-in expressions, so they
stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display values.
DASH = "—"
INFINITY_TEXT = "∞"
PROP_LABEL = "🏆 Prop Firm"
LIVE_LABEL = "💼 Live"
LABEL_SEPARATOR = " · $"


def month_key(d: Column) -> Column:
    """H3: 'yyyy-MM'."""
    return F.date_format(d, "yyyy-MM")


def month_label(d: Column) -> Column:
    """H2: 'June 2024'."""
    return F.date_format(d, "MMMM yyyy")


def month_step(d: Column, months: int) -> Column:
    """H8: first day of the month ``months`` away (year carries)."""
    return F.add_months(F.trunc(d, "month"), months)


def currency(n: Column) -> Column:
    """H1: '+$1,234.50', '-$45.00', '+$0.00' (half up to cents)."""
    sign = F.when(n >= 0, F.lit("+$")).otherwise(F.lit("-$"))
    return F.concat(sign, F.format_number(F.round(F.abs(n), 2), 2))


def number_text(x: Column) -> Column:
    """A decimal with places as a plain number would print: trailing zeros
    dropped ('1.50' -> '1.5', '2.00' -> '2')."""
    return F.rtrim(F.rtrim(x.cast("string"), F.lit("0")), F.lit("."))


def trade_count_text(n: Column) -> Column:
    """H4: '1 trade', '3 trades'."""
    return F.concat(n.cast("string"), F.lit(" trade"),
                    F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def dash_if_empty(x: Column) -> Column:
    """H5: NULL or '' -> '—'."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(DASH))


def factor_text(pf: Column, unbounded: Column) -> Column:
    """H6: profit factor, '∞' when unbounded."""
    return F.when(unbounded, F.lit(INFINITY_TEXT)).otherwise(number_text(pf))


def rr_text(rr: Column) -> Column:
    """H6: '1.5R', or '—' without a ratio."""
    return F.when(rr.isNull(), F.lit(DASH)).otherwise(F.concat(number_text(rr), F.lit("R")))


def positive_money_text(x: Column, negate: bool = False) -> Column:
    """H6: an average as currency, or '—' when it is 0."""
    return F.when(x > 0, currency(-x if negate else x)).otherwise(F.lit(DASH))


def account_label(kind: Column, size: Column) -> Column:
    """H7: '🏆 Prop Firm · $50,000' / '💼 Live · $25,000'."""
    head = F.when(kind == "prop", F.lit(PROP_LABEL)).otherwise(F.lit(LIVE_LABEL))
    return F.concat(head, F.lit(LABEL_SEPARATOR), F.call_function("format_number", size, F.lit("#,##0.###")))


def pnl_sign(x: Column) -> Column:
    return F.when(x >= 0, F.lit("pos")).otherwise(F.lit("neg"))
