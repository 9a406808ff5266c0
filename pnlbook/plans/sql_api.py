"""The journal in SQL: its tables and two views, and the reads with parameters.

``register`` makes temporary views ``users``, ``accounts``, ``trades``,
``daily_summary`` (E1) and ``monthly_summary`` (E2), and table functions whose parameters
may be NULL for "any". They are inlined into the query, so literal arguments become the
same pushed-down filters as in the DataFrame form:

    SELECT * FROM user_trades(7, DATE'1997-01-01', NULL, NULL) ORDER BY date DESC
"""

from __future__ import annotations

from pnlbook.operators.summaries import daily_summary, monthly_summary
from pnlbook.plans.context import Journal

# name -> parameters, the table it returns rows of, and the condition
FUNCTIONS = {
    "user_trades": ("of_user INT, date_from DATE, date_to DATE, in_account INT", "trades",
                    "user_id = of_user AND (date_from IS NULL OR date >= date_from) AND (date_to IS NULL OR date <= date_to) "
                    "AND (in_account IS NULL OR array_contains(account_ids, in_account))"),
    "user_trade": ("of_user INT, trade_id BIGINT", "trades", "user_id = of_user AND id = trade_id"),
    "user_accounts": ("of_user INT", "accounts", "user_id = of_user"),
}


def register(journal: Journal) -> None:
    """Views and table functions over ``journal`` in its session (they replace earlier ones)."""
    spark = journal.spark
    views = {"users": journal.users, "accounts": journal.accounts, "trades": journal.trades,
             "daily_summary": daily_summary(journal.trades), "monthly_summary": monthly_summary(journal.trades)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, table, condition) in FUNCTIONS.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in views[table].schema)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) "
                  f"RETURN SELECT * FROM {table} WHERE {condition}")
