"""DuckDB SQL oracles, one per catalogue query.

DuckDB sees only the raw tables, so every oracle starts with the journal
views as CTEs. Rounding here is done with whole numbers (half up as
(2*n*10^k + d) // (2*d)), independent of the decimal ``round`` the Spark
side uses.
"""

# The journal views over the raw tables.
PRELUDE = """
WITH users AS (SELECT n_nationkey AS id, n_name AS username FROM nation UNION ALL SELECT 25, 'NO_TRADES'),
accounts AS (
  SELECT CAST(u.id*3+k AS INT) AS id, u.id AS user_id,
         concat(username,'-',CAST(k AS VARCHAR)) AS name,
         CASE WHEN k = 2 THEN 'prop' ELSE 'live' END AS type,
         CAST(25000*(k+1) AS DECIMAL(18,4)) AS size,
         CAST(DATE '2020-01-01' + CAST((u.id*5 + k*4) % 7 AS INT) AS TIMESTAMP) AS created_at
  FROM users u CROSS JOIN (VALUES (0),(1),(2)) v(k)),
rb AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 97 = 0 THEN 99 ELSE c_nationkey END AS user_id,
    CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderkey % 89 = 0 THEN 'FLAT'
         WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'LONG' ELSE 'SHORT' END AS type,
    CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(100 + o_custkey % 50 AS DECIMAL(18,4)) END AS entry_price,
    CAST(100 + o_custkey % 50 AS DECIMAL(18,4))
      + CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 201 - 100 AS DECIMAL(10,4)) * CAST(0.25 AS DECIMAL(3,2)) AS exit_raw,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         ELSE CAST(CAST(o_orderkey % 5 AS DECIMAL(10,4)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,4)) END AS position_size,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'A+' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'B'
         WHEN '4-NOT SPECIFIED' THEN 'C' ELSE '' END AS grade,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'angry' WHEN 'BUILDING' THEN 'frustrated'
         WHEN 'FURNITURE' THEN 'neutral' WHEN 'HOUSEHOLD' THEN 'sad' ELSE 'happy' END AS mental,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS DECIMAL(18,4)) END AS initial_risk,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL
         ELSE concat('  note "', o_orderpriority, '", seg ', c_mktsegment, ' ') END AS notes,
    CAST(o_orderkey % 8 AS INT) AS acct_mask,
    o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey),
raw_trades AS (
  SELECT id, CAST(user_id AS INT) AS user_id, date, type, entry_price,
    CAST(exit_raw AS DECIMAL(18,4)) AS exit_price, position_size, grade, mental, initial_risk, notes,
    list_filter([CASE WHEN acct_mask & 1 <> 0 THEN user_id*3 END,
                 CASE WHEN acct_mask & 2 <> 0 THEN user_id*3+1 END,
                 CASE WHEN acct_mask & 4 <> 0 THEN user_id*3+2 END], lambda x: x IS NOT NULL) AS account_ids,
    created_at
  FROM rb),
trades AS (
  SELECT r.id, r.user_id, r.date, r.type, r.entry_price, r.exit_price,
    CAST(COALESCE(NULLIF(r.position_size, 0), 1) AS DECIMAL(18,4)) AS position_size,
    CAST(ROUND(CASE WHEN r.type = 'LONG' THEN r.exit_price - r.entry_price ELSE r.entry_price - r.exit_price END
      * CAST(COALESCE(NULLIF(r.position_size, 0), 1) AS DECIMAL(18,4)), 2) AS DECIMAL(18,4)) AS pnl,
    NULLIF(r.grade, '') AS grade, COALESCE(r.notes, '') AS notes, NULLIF(r.mental, '') AS mental,
    NULLIF(r.initial_risk, 0) AS initial_risk, r.account_ids, r.created_at
  FROM raw_trades r
  WHERE r.date IS NOT NULL AND r.type IN ('LONG','SHORT') AND r.entry_price IS NOT NULL
    AND r.exit_price IS NOT NULL AND EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id)),
trade_changes AS (
  SELECT event_id AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
    CAST(user_id % 27 AS INT) AS user_id, user_id*10 + event_id % 10 AS id, CAST(ts AS DATE) AS date,
    CASE WHEN event_id % 41 = 0 THEN 'FLAT' WHEN event_type IN ('click','signup') THEN 'LONG' ELSE 'SHORT' END AS type,
    CASE WHEN event_id % 3 = 0 THEN CAST(100 + user_id % 50 AS DECIMAL(18,4)) END AS entry_price,
    CASE WHEN event_id % 3 = 0 THEN CAST(100 + user_id % 50 + CAST(value AS DECIMAL(12,4)) AS DECIMAL(18,4)) END AS exit_price,
    CASE WHEN event_id % 3 = 0 THEN CAST((event_id % 4) * 0.5 AS DECIMAL(18,4)) END AS position_size,
    CASE WHEN event_id % 3 <> 0 AND event_id % 53 <> 0
         THEN CAST(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS DECIMAL(18,4)) END AS pnl_input,
    CASE WHEN event_id % 59 = 0 THEN 'AAAA' WHEN event_id % 5 = 0 THEN '' ELSE 'A' END AS grade,
    CASE WHEN event_id % 6 = 0 THEN 'happy' END AS mental,
    CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 30 AS DECIMAL(18,4)) END AS initial_risk,
    CASE WHEN event_id % 2 = 0 THEN ' n' || CAST(event_id AS VARCHAR) END AS notes,
    CASE WHEN event_id % 5 <> 0 THEN [CAST(user_id % 27 AS INT) * 3] ELSE CAST([] AS INT[]) END AS account_ids
  FROM events),
priced AS (
  SELECT * EXCLUDE (entry_price, exit_price, position_size),
    CASE WHEN pnl_input IS NOT NULL THEN CAST(100 AS DECIMAL(18,4)) ELSE entry_price END AS entry_price,
    CASE WHEN pnl_input IS NULL THEN exit_price WHEN type = 'LONG' THEN CAST(100 + pnl_input AS DECIMAL(18,4))
         ELSE CAST(100 - pnl_input AS DECIMAL(18,4)) END AS exit_price,
    CASE WHEN entry_price IS NULL OR position_size = 0 THEN CAST(1 AS DECIMAL(18,4)) ELSE position_size END AS position_size
  FROM trade_changes),
checked AS (
  SELECT * EXCLUDE (grade, notes, initial_risk, pnl_input),
    CAST(ROUND((CASE type WHEN 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END) * position_size, 2) AS DECIMAL(18,4)) AS pnl,
    NULLIF(grade, '') AS grade, COALESCE(notes, '') AS notes, NULLIF(initial_risk, 0) AS initial_risk,
    op = 'D' OR (type IN ('LONG','SHORT') AND entry_price IS NOT NULL AND exit_price IS NOT NULL AND date IS NOT NULL
                 AND length(grade) <= 3 AND EXISTS (SELECT 1 FROM users u WHERE u.id = user_id)) AS ok
  FROM priced)
"""

QUERIES: dict[str, str] = {}


def oracle(name: str):
    def reg(sql: str) -> str:
        QUERIES[name] = PRELUDE + sql
        return sql
    return reg


# Half-up ratio to k places in whole numbers: num, den scaled to integers.
def hu(num: str, den: str, k: int, typ: str) -> str:
    return (f"CAST(CAST((2*({num})*{10 ** k} + ({den})) // NULLIF(2*({den}), 0) AS DECIMAL(38,0))"
            f" * CAST({1 / 10 ** k:.{k}f} AS DECIMAL({k + 1},{k})) AS {typ})")


oracle("ingest_trades")("""
SELECT id, user_id, date, type, entry_price, exit_price, position_size, pnl, grade, mental,
       notes, initial_risk FROM trades""")

oracle("monthly_summary")(f"""
, m AS (
  SELECT user_id, strftime(date, '%Y-%m') AS month, COUNT(*) AS trade_count, SUM(pnl) AS net_pnl,
    SUM(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS losses,
    CAST(SUM(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) * 10000 AS HUGEINT) AS gw,
    CAST(-SUM(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) * 10000 AS HUGEINT) AS gl
  FROM trades GROUP BY user_id, strftime(date, '%Y-%m'))
SELECT user_id, month, CAST(trade_count AS BIGINT) AS trade_count, CAST(net_pnl AS DECIMAL(28,4)) AS net_pnl,
  CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses,
  {hu('wins*100', 'trade_count', 1, 'DECIMAL(6,1)')} AS win_rate_pct,
  {hu('gw', 'gl', 2, 'DECIMAL(30,2)')} AS profit_factor
FROM m""")

_MONEY, _TOTAL = "DECIMAL(18,4)", "DECIMAL(28,4)"


def _money_text(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN '+$' ELSE '-$' END || format('{{:,.2f}}', abs({x})))"


def _dash(x: str) -> str:
    return f"COALESCE(NULLIF({x}, ''), '—')"


def _num_text(x: str) -> str:
    return (f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\\.[0-9]*[1-9])0+$', '\\1'),"
            f" '\\.0+$', '')")


# Base aggregates over a trades-like relation; gw / gl in ten-thousandths.
def _base(src: str, keys: str) -> str:
    return f"""SELECT {keys}, COUNT(*) AS total,
    SUM(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS losses,
    SUM(pnl) AS net, CAST(SUM(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) * 10000 AS HUGEINT) AS gw,
    CAST(-SUM(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) * 10000 AS HUGEINT) AS gl,
    SUM(CASE WHEN type = 'LONG' THEN 1 ELSE 0 END) AS longs,
    SUM(CASE WHEN type = 'SHORT' THEN 1 ELSE 0 END) AS shorts
  FROM {src} GROUP BY {keys}"""


# The stat card over a relation b(keys, total, wins, losses, net, gw, gl, longs, shorts),
# NULLs (no trades) read as 0.
def _card(b: str, keys: str, nested: bool = False) -> str:
    lead = "WITH" if nested else "\n,"
    return f"""{lead} z AS (SELECT {keys}, CAST(COALESCE(total,0) AS BIGINT) AS total, CAST(COALESCE(wins,0) AS BIGINT) AS wins,
    CAST(COALESCE(losses,0) AS BIGINT) AS losses, CAST(COALESCE(net,0) AS {_TOTAL}) AS net,
    COALESCE(gw,0) AS gw, COALESCE(gl,0) AS gl, CAST(COALESCE(longs,0) AS BIGINT) AS longs,
    CAST(COALESCE(shorts,0) AS BIGINT) AS shorts FROM {b}),
ca AS (SELECT *, CASE WHEN wins > 0 THEN (2*gw + 100*wins) // (200*wins) ELSE 0 END AS aw_c,
    CASE WHEN losses > 0 THEN (2*gl + 100*losses) // (200*losses) ELSE 0 END AS al_c FROM z)
SELECT {keys}, total, wins, losses, net AS net_pnl,
  CAST(CAST(gw AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS {_TOTAL}) AS gross_win,
  CAST(CAST(gl AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS {_TOTAL}) AS gross_loss,
  COALESCE({hu('wins*100', 'total', 1, 'DECIMAL(6,1)')}, CAST(0 AS DECIMAL(6,1))) AS win_rate,
  CASE WHEN gl > 0 THEN {hu('gw', 'gl', 2, 'DECIMAL(30,2)')}
       WHEN gw > 0 THEN NULL ELSE CAST(0 AS DECIMAL(30,2)) END AS profit_factor,
  (gl = 0 AND gw > 0) AS pf_unbounded,
  CAST(CAST(aw_c AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(30,2)) AS avg_win,
  CAST(CAST(al_c AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(30,2)) AS avg_loss,
  CASE WHEN aw_c > 0 AND al_c > 0 THEN {hu('aw_c', 'al_c', 2, 'DECIMAL(30,2)')} END AS avg_rr,
  longs, shorts
FROM ca"""


def _stat_card(nested: bool = False) -> str:
    lead = "WITH" if nested else "\n,"
    return f"""{lead} b AS ({_base('trades', 'user_id')}),
j AS (SELECT u.id AS user_id, b.* EXCLUDE (user_id) FROM users u LEFT JOIN b ON b.user_id = u.id)
{_card('j', 'user_id')}"""


_TRAIL = "CAST(date AS TIMESTAMP) >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL {n} DAY"

oracle("ingest_rejects")("""
, k AS (SELECT r.*, CAST(ROUND(CASE WHEN r.type = 'LONG' THEN r.exit_price - r.entry_price
      ELSE r.entry_price - r.exit_price END * CAST(COALESCE(NULLIF(r.position_size, 0), 1) AS DECIMAL(18,4)), 2)
      AS DECIMAL(38,8)) AS p, EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id) AS known
  FROM raw_trades r),
x AS (SELECT id, concat_ws(',',
    CASE WHEN date IS NULL THEN 'missing_date' END,
    CASE WHEN type IS NULL OR type = '' THEN 'missing_type' END,
    CASE WHEN entry_price IS NULL THEN 'missing_entry_price' END,
    CASE WHEN exit_price IS NULL THEN 'missing_exit_price' END,
    CASE WHEN type <> '' AND type NOT IN ('LONG','SHORT') THEN 'bad_type' END,
    CASE WHEN length(grade) > 3 THEN 'bad_grade' END,
    CASE WHEN type IN ('LONG','SHORT') AND entry_price IS NOT NULL AND exit_price IS NOT NULL
         AND abs(p) >= 100000000000000 THEN 'out_of_range' END,
    CASE WHEN NOT known THEN 'unknown_user' END) AS reasons FROM k)
SELECT id, reasons FROM x WHERE reasons <> ''""")

oracle("orphan_trades")("""
SELECT id, user_id FROM raw_trades r WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id)""")

oracle("pnl_only_entries")("""
, e AS (SELECT seq, type, CAST(100 AS DECIMAL(18,4)) AS entry_price,
    CAST(CASE WHEN type = 'LONG' THEN 100 + pnl_input ELSE 100 - pnl_input END AS DECIMAL(18,4)) AS exit_price
  FROM trade_changes WHERE date IS NOT NULL AND pnl_input IS NOT NULL)
SELECT seq, type, entry_price, exit_price,
  CAST(ROUND(CASE WHEN type = 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END, 2)
    AS DECIMAL(18,4)) AS pnl FROM e""")

_RANK = "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date {d}, created_at DESC, id DESC) AS position"
oracle("user_trades")(f"""
SELECT {_RANK.format(d='DESC')}, id, date, type, pnl FROM trades WHERE user_id = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")

oracle("account_trades")("""
SELECT id, date, pnl FROM trades WHERE user_id = 7 AND list_contains(account_ids, 22)""")

oracle("month_trades")("""
SELECT id, user_id, date, pnl FROM trades WHERE year(date) = 1998 AND month(date) = 6""")

oracle("trailing_trades")(f"""
SELECT id, user_id, date, pnl FROM trades WHERE {_TRAIL.format(n=30)}""")

oracle("day_trades")(f"""
SELECT id, user_id, type, {_money_text('pnl')} AS pnl_text, {_dash('grade')} AS grade, {_dash('notes')} AS notes
FROM trades WHERE date = DATE '1998-06-15'""")

oracle("daily_summary")("""
SELECT user_id, date, CAST(COUNT(*) AS BIGINT) AS trade_count, CAST(SUM(pnl) AS DECIMAL(28,4)) AS daily_pnl,
  CAST(SUM(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(SUM(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  CAST(SUM(CASE WHEN type = 'LONG' THEN 1 ELSE 0 END) AS BIGINT) AS longs,
  CAST(SUM(CASE WHEN type = 'SHORT' THEN 1 ELSE 0 END) AS BIGINT) AS shorts
FROM trades GROUP BY user_id, date""")

oracle("api_stats")(f"""
, b AS ({_base("(SELECT * FROM trades WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')", 'user_id')}),
j AS (SELECT u.id AS user_id, b.* EXCLUDE (user_id) FROM users u LEFT JOIN b ON b.user_id = u.id),
api AS ({_card('j', 'user_id', nested=True)})
SELECT user_id, total, wins, losses, win_rate,
  CASE WHEN gross_loss > 0 THEN profit_factor END AS profit_factor, net_pnl, longs, shorts FROM api""")

oracle("stat_card")(_stat_card())

oracle("account_stats")(f"""
, pairs AS (SELECT user_id, type, pnl, unnest(list_distinct(account_ids)) AS account_id FROM trades),
pa AS ({_base('pairs', 'user_id, account_id')}),
ja AS (SELECT a.user_id, a.id AS account_id, pa.* EXCLUDE (user_id, account_id)
  FROM accounts a LEFT JOIN pa ON pa.user_id = a.user_id AND pa.account_id = a.id),
pu AS ({_base('trades', 'user_id')}),
ju AS (SELECT u.id AS user_id, CAST(NULL AS INT) AS account_id, pu.* EXCLUDE (user_id)
  FROM users u LEFT JOIN pu ON pu.user_id = u.id),
jj AS (SELECT * FROM ja UNION ALL SELECT * FROM ju)
{_card('jj', 'user_id, account_id')}""")

oracle("month_stats")(f"""
, m AS (SELECT user_id, strftime(date, '%Y-%m') AS month, pnl, type FROM trades),
b AS ({_base('m', 'user_id, month')})
{_card('b', 'user_id, month')}""")

oracle("best_day")("""
, d AS (SELECT user_id, date, SUM(pnl) AS s FROM trades GROUP BY user_id, date),
m AS (SELECT user_id, MAX(s) AS mx FROM d GROUP BY user_id)
SELECT u.id AS user_id, CAST(greatest(COALESCE(m.mx, 0), 0) AS DECIMAL(28,4)) AS best_day
FROM users u LEFT JOIN m ON m.user_id = u.id""")

oracle("side_split")("""
, s AS (SELECT user_id, SUM(CASE WHEN type='LONG' THEN 1 ELSE 0 END) AS l,
    SUM(CASE WHEN type='SHORT' THEN 1 ELSE 0 END) AS s FROM trades GROUP BY user_id)
SELECT u.id AS user_id, CAST(COALESCE(l, 0) AS BIGINT) AS longs, CAST(COALESCE(s.s, 0) AS BIGINT) AS shorts
FROM users u LEFT JOIN s ON s.user_id = u.id""")

oracle("account_counts")("""
, c AS (SELECT user_id, COUNT(*) AS n FROM accounts GROUP BY user_id)
SELECT u.id AS user_id, CAST(COALESCE(n, 0) AS BIGINT) AS accounts FROM users u LEFT JOIN c ON c.user_id = u.id""")

_CURVE = """
, d AS (SELECT user_id, date, CAST(SUM(pnl) AS DECIMAL(28,4)) AS daily_pnl FROM trades {where} GROUP BY user_id, date)
SELECT user_id, date, daily_pnl,
  CAST(SUM(daily_pnl) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS DECIMAL(28,4)) AS cum_pnl
FROM d"""

oracle("equity_curve")(_CURVE.format(where=""))
oracle("equity_curve_90d")(_CURVE.format(where="WHERE " + _TRAIL.format(n=90)))

oracle("curve_end")(f"""
, f AS (SELECT user_id, CAST(SUM(pnl) AS DECIMAL(28,4)) AS final_pnl FROM trades
  WHERE {_TRAIL.format(n=365)} GROUP BY user_id)
SELECT user_id, final_pnl, CASE WHEN final_pnl >= 0 THEN 'up' ELSE 'down' END AS trend FROM f""")

_GRID = """
, um AS (SELECT u.id AS user_id, m.first FROM users u CROSS JOIN
    (VALUES (DATE '1998-06-01'), (DATE '1998-07-01')) m(first)),
gm AS (SELECT user_id, first, dayofweek(first) AS lead, day(last_day(first)) AS ndays FROM um),
cells AS (SELECT user_id, first, lead, ndays, unnest(range(0, CAST(ceil((lead + ndays) / 7.0) * 7 AS BIGINT))) AS cell
  FROM gm),
g AS (SELECT user_id, strftime(first, '%Y-%m') AS month, CAST(cell // 7 AS INT) AS week_index,
    CAST(cell % 7 AS INT) AS dow,
    CASE WHEN cell - lead >= 0 AND cell - lead < ndays THEN CAST(first + CAST(cell - lead AS INT) AS DATE) END AS date,
    strftime(first, '%B %Y') AS month_label FROM cells),
d AS (SELECT user_id, date, COUNT(*) AS n, SUM(pnl) AS p FROM trades
  WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-07-31' GROUP BY user_id, date),
grid AS (
SELECT g.user_id, g.month, g.week_index, g.dow, g.date, CAST(COALESCE(d.n, 0) AS BIGINT) AS trade_count,
  CAST(d.p AS DECIMAL(28,4)) AS pnl,
  CASE WHEN COALESCE(d.n, 0) = 0 THEN 'empty' WHEN d.p > 0 THEN 'profit' ELSE 'loss' END AS day_class,
  CASE WHEN d.n > 0 THEN CASE WHEN d.p >= 0 THEN 'pos' ELSE 'neg' END END AS pnl_sign,
  g.month_label,
  CASE WHEN d.n > 0 THEN CAST(d.n AS VARCHAR) || ' trade' || CASE WHEN d.n > 1 THEN 's' ELSE '' END END AS count_text
FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.date = g.date)"""

oracle("calendar_grid")(_GRID + "\nSELECT * FROM grid")

oracle("calendar_weeks")(_GRID + """
SELECT user_id, month, week_index, CAST(COALESCE(SUM(pnl), 0) AS DECIMAL(28,4)) AS week_pnl,
  CASE WHEN COALESCE(SUM(pnl), 0) >= 0 THEN 'pos' ELSE 'neg' END AS week_sign
FROM grid GROUP BY user_id, month, week_index""")

_CONSISTENCY = f"""
, d AS (SELECT user_id, date, SUM(pnl) AS s FROM trades {{where}} GROUP BY user_id, date),
m AS (SELECT user_id, SUM(s) AS net, MAX(s) AS mx FROM d GROUP BY user_id),
share AS (SELECT u.id AS user_id, CAST(COALESCE(net, 0) AS DECIMAL(28,4)) AS net,
    CAST(greatest(COALESCE(mx, 0), 0) AS DECIMAL(28,4)) AS best_day FROM users u LEFT JOIN m ON m.user_id = u.id)
SELECT user_id, net, best_day,
  CASE WHEN net > 0 THEN {hu('CAST(best_day * 10000 AS HUGEINT) * 100', 'CAST(net * 10000 AS HUGEINT)', 1, 'DECIMAL(32,1)')} END
    AS consistency_pct,
  CASE WHEN net <= 0 THEN 'none' WHEN best_day * 100 < net * 30 THEN 'good'
       WHEN best_day * 100 > net * 50 THEN 'poor' ELSE 'fair' END AS band
FROM share"""
oracle("consistency")(_CONSISTENCY.format(where="WHERE " + _TRAIL.format(n=365)))

oracle("edge_scores")(f"""
, card AS ({_stat_card(nested=True)}),
k AS (SELECT user_id, win_rate, pf_unbounded, CAST(profit_factor * 100 AS HUGEINT) AS pf_c,
    CAST(avg_rr * 100 AS HUGEINT) AS rr_c FROM card)
SELECT user_id, CAST(win_rate AS DECIMAL(10,4)) AS win_score,
  CASE WHEN pf_unbounded THEN CAST(100 AS DECIMAL(10,4))
       ELSE COALESCE({hu('CASE WHEN pf_c >= 300 THEN 300 ELSE pf_c END', '3', 4, 'DECIMAL(10,4)')}, CAST(0 AS DECIMAL(10,4))) END
    AS pf_score,
  COALESCE({hu('CASE WHEN rr_c >= 300 THEN 300 ELSE rr_c END', '3', 4, 'DECIMAL(10,4)')}, CAST(0 AS DECIMAL(10,4))) AS rr_score
FROM k""")

oracle("card_labels")(f"""
, card AS ({_stat_card(nested=True)})
SELECT user_id, {_money_text('net_pnl')} AS net_text, {_num_text('win_rate')} || '%' AS wr_text,
  CASE WHEN pf_unbounded THEN '∞' ELSE {_num_text('profit_factor')} END AS pf_text,
  CASE WHEN avg_rr IS NULL THEN '—' ELSE {_num_text('avg_rr')} || 'R' END AS rr_text,
  CASE WHEN avg_win > 0 THEN {_money_text('avg_win')} ELSE '—' END AS avg_win_text,
  CASE WHEN avg_loss > 0 THEN {_money_text('-avg_loss')} ELSE '—' END AS avg_loss_text,
  CASE WHEN net_pnl > 0 THEN 'green' WHEN net_pnl < 0 THEN 'red' ELSE 'neutral' END AS net_class,
  CASE WHEN win_rate >= 50 THEN 'green' ELSE 'red' END AS wr_class,
  CASE WHEN pf_unbounded OR profit_factor >= 1 THEN 'green' ELSE 'red' END AS pf_class,
  CASE WHEN avg_rr IS NULL THEN 'neutral' WHEN avg_rr >= 1 THEN 'green' ELSE 'red' END AS rr_class
FROM card""")

# The same figures with the account in the user's place.
def _account(name: str) -> str:
    sql = QUERIES[name]
    assert sql.startswith(PRELUDE)
    scoped = """
, dealt AS (SELECT user_id, date, type, pnl, unnest(list_distinct(account_ids)) AS aid FROM trades),
owned AS (SELECT a.id AS user_id, d.date, d.type, d.pnl FROM dealt d JOIN accounts a ON a.id = d.aid AND a.user_id = d.user_id)"""
    body = sql[len(PRELUDE):].replace("FROM trades", "FROM owned").replace("FROM users u", "FROM accounts u")
    return f"SELECT * EXCLUDE (user_id), user_id AS account_id FROM ({PRELUDE}{scoped}{body})"


for _new, _old in (("account_curve", "equity_curve"), ("account_calendar", "calendar_grid"), ("account_consistency", "consistency"),
                   ("account_edge_scores", "edge_scores"), ("account_labels", "card_labels")):
    QUERIES[_new] = _account(_old)

oracle("month_steps")("""
, m AS (SELECT DISTINCT user_id, CAST(date_trunc('month', date) AS DATE) AS first FROM trades)
SELECT user_id, first, CAST(first - INTERVAL 1 MONTH AS DATE) AS before, CAST(first + INTERVAL 1 MONTH AS DATE) AS after FROM m""")

oracle("chart_order")(f"""
SELECT user_id, {_RANK.format(d='ASC')}, id, date, pnl FROM trades""")

oracle("trade_by_id")("""
SELECT id, user_id, date, type, pnl FROM trades WHERE user_id = 7 AND id = (SELECT MAX(id) FROM trades WHERE user_id = 7)""")

oracle("ledger_range")("""
SELECT id, date, type, pnl FROM trades WHERE user_id = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")

oracle("user_accounts")("""
SELECT ROW_NUMBER() OVER (ORDER BY created_at, id) AS position, id, name, created_at FROM accounts WHERE user_id = 7""")

oracle("trade_table")(f"""
SELECT user_id, {_RANK.format(d='DESC')}, id, date, type, {_money_text('pnl')} AS pnl_text, {_dash('grade')} AS grade, {_dash('notes')} AS notes
FROM trades""")

oracle("account_list")("""
SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at, id) AS position, id, name,
  CASE WHEN type = 'prop' THEN '🏆 Prop Firm' ELSE '💼 Live' END || ' · $' || format('{:,}', CAST(size AS BIGINT)) AS label
FROM accounts""")

oracle("change_outcomes")("""
, c AS (SELECT *, MAX(CASE WHEN op='I' AND ok THEN seq END) OVER w AS li, MAX(CASE WHEN op='D' THEN seq END) OVER w AS ld
  FROM checked
  WINDOW w AS (PARTITION BY user_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, COALESCE(li,-1) > COALESCE(ld,-1) AS present FROM c)
SELECT seq, op, CASE WHEN NOT ok THEN 'rejected' ELSE CASE op WHEN 'I' THEN CASE WHEN present THEN 'duplicate' ELSE 'created' END
                        WHEN 'U' THEN CASE WHEN present THEN 'updated' ELSE 'not_found' END
                        ELSE CASE WHEN present THEN 'deleted' ELSE 'not_found' END END END AS outcome
FROM o""")

_LIVE = """
, c AS (SELECT *, MAX(CASE WHEN op='D' THEN seq END) OVER (PARTITION BY user_id,id) AS last_d FROM {src}),
a AS (SELECT *, MIN(CASE WHEN op='I' THEN seq END) OVER (PARTITION BY user_id,id) AS born FROM c
  WHERE seq > COALESCE(last_d,-1)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id,id ORDER BY seq DESC) AS rn FROM a
  WHERE born IS NOT NULL AND (seq = born OR (op='U' AND seq > born)))"""

_LIVE_LEDGER = _LIVE.format(src="(SELECT * FROM checked WHERE ok)") + """,
live AS (SELECT r.user_id, r.id, r.date, r.type, r.entry_price, r.exit_price, r.position_size, r.pnl, r.grade, r.notes, r.mental,
    r.initial_risk, r.account_ids, r.born, r.seq, i.ts AS created_at
  FROM r JOIN checked i ON i.seq = r.born WHERE rn = 1)"""
oracle("live_ledger")(_LIVE_LEDGER + "\nSELECT * FROM live")

_ACC = """
, f AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
    user_id, user_id*3 + event_id % 3 AS id,
    CASE WHEN event_id % 13 = 0 THEN NULL
         ELSE '  ' || event_type || '-' || CAST(event_id % 7 AS VARCHAR) || ' ' END AS raw_name,
    trim(raw_name) AS name,
    CASE event_type WHEN 'purchase' THEN 'prop' WHEN 'click' THEN 'live' ELSE 'live' END AS type,
    COALESCE(TRY_CAST(regexp_extract(CASE WHEN event_type = 'view' THEN 'n/a'
        ELSE CAST(CAST(ROUND(value * 1000, 2) AS DECIMAL(18,2)) AS VARCHAR) END,
        '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0) AS DECIMAL(18,4)),
      CAST(0 AS DECIMAL(18,4))) AS size
  FROM events),
acc AS (SELECT * FROM f WHERE op = 'D' OR COALESCE(raw_name <> '', false))"""

oracle("account_outcomes")(_ACC + """,
c AS (SELECT *, op = 'D' OR COALESCE(raw_name <> '', false) AS ok FROM f),
w AS (SELECT *, MAX(CASE WHEN op='I' AND ok THEN seq END) OVER v AS li, MAX(CASE WHEN op='D' THEN seq END) OVER v AS ld FROM c
  WINDOW v AS (PARTITION BY user_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, COALESCE(li,-1) > COALESCE(ld,-1) AS present FROM w)
SELECT seq, op, CASE WHEN NOT ok THEN 'rejected' WHEN op = 'I' THEN CASE WHEN present THEN 'duplicate' ELSE 'created' END
  WHEN op = 'U' THEN CASE WHEN present THEN 'updated' ELSE 'not_found' END
  ELSE CASE WHEN present THEN 'deleted' ELSE 'not_found' END END AS outcome FROM o""")

oracle("account_changes")(_ACC + _LIVE.format(src="acc") + """
SELECT user_id, id, name, type, size FROM r WHERE rn = 1""")

oracle("user_purge")("""
SELECT id, user_id FROM trades t WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = t.user_id AND u.id % 5 = 0)""")

# entries sent as JSON: those with a planted fault (see fixtures.entries_json) are refused
oracle("json_ingest")("""
SELECT id, user_id, date, type, entry_price, exit_price, position_size, pnl, grade, mental, notes, initial_risk
FROM trades WHERE id % 101 <> 0 AND id % 103 <> 0 AND id % 107 <> 0 AND id % 109 <> 0
  AND id % 113 <> 0 AND id % 127 <> 0 AND id % 131 <> 0 AND id % 137 <> 0 AND id % 139 <> 0 AND id % 149 <> 0""")
QUERIES["json_file_ingest"] = QUERIES["json_ingest"]

oracle("json_rejects")("""
, x AS (SELECT id, id % 101 = 0 AS broken, concat_ws(',',
    CASE WHEN entry_price IS NULL THEN 'missing_entry_price' END,
    CASE WHEN type NOT IN ('LONG','SHORT') THEN 'bad_type' END,
    CASE WHEN (id % 109 = 0 AND id % 107 <> 0) OR (id % 139 = 0 AND id % 137 <> 0) THEN 'out_of_range' END,
    CASE WHEN id % 127 <> 0 AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id) THEN 'unknown_user' END,
    CASE WHEN id % 103 = 0 THEN 'bad_date' END,
    CASE WHEN id % 107 = 0 OR id % 137 = 0 THEN 'bad_number' END,
    CASE WHEN id % 113 = 0 THEN 'bad_id' END, CASE WHEN id % 127 = 0 THEN 'bad_user_id' END,
    CASE WHEN id % 131 = 0 THEN 'bad_accounts' END, CASE WHEN id % 149 = 0 THEN 'bad_created_at' END) AS reasons FROM raw_trades r)
SELECT CASE WHEN NOT broken AND id % 113 <> 0 THEN id END AS id, CASE WHEN broken THEN 'bad_json' ELSE reasons END AS reasons,
  CASE WHEN broken THEN '{"id":' || CAST(id AS VARCHAR) || ',"user_id":' END AS raw
FROM x WHERE broken OR reasons <> ''""")

oracle("ledger_roundtrip")("""
SELECT user_id, strftime(date, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS trade_count
FROM trades GROUP BY user_id, strftime(date, '%Y-%m')""")

oracle("ledger_append")("""
SELECT user_id, strftime(date, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS trade_count, CAST(SUM(pnl) AS DECIMAL(28,4)) AS net_pnl
FROM trades GROUP BY user_id, strftime(date, '%Y-%m')""")


def _q(x: str) -> str:
    return f"""'"' || replace(COALESCE({x}, ''), '"', '""') || '"'"""


oracle("csv_lines")("""
SELECT id, """ + " || ',' || ".join([
    _q("CAST(id AS VARCHAR)"), _q("strftime(date, '%Y-%m-%d')"), _q("type"),
    _q("CAST(entry_price AS VARCHAR)"), _q("CAST(exit_price AS VARCHAR)"),
    _q("CAST(position_size AS VARCHAR)"), _q(_num_text("pnl")), _q("notes"),
    _q("strftime(created_at, '%Y-%m-%d %H:%M:%S')")]) + """ AS line
FROM trades""")

oracle("csv_file")(f"""
SELECT CAST(id AS VARCHAR) AS id, strftime(date, '%Y-%m-%d') AS date, type, {_num_text('pnl')} AS pnl, notes FROM trades""")

oracle("accounts_normalised")("""
, d AS (SELECT id, user_id,
    CASE WHEN id % 7 = 0 THEN '   ' ELSE '  ' || name || ' ' END AS name,
    CASE WHEN id % 4 = 1 THEN upper(type) WHEN id % 4 = 2 THEN NULL ELSE type END AS type,
    CASE WHEN id % 5 = 0 THEN 'abc' ELSE CAST(size AS VARCHAR) END AS size FROM accounts)
SELECT id, user_id, trim(name) AS name,
  CASE WHEN type IN ('live', 'prop') THEN type ELSE 'live' END AS type,
  COALESCE(TRY_CAST(regexp_extract(ltrim(size), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0)
    AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4))) AS size
FROM d WHERE name <> ''""")

oracle("default_accounts")("""
, e AS (SELECT id, user_id, CASE WHEN id % 13 = 0 THEN NULL ELSE account_ids END AS account_ids FROM trades)
SELECT id, CAST(unnest(list_distinct(account_ids)) AS INT) AS account_id FROM e WHERE account_ids IS NOT NULL
UNION ALL
SELECT e.id, a.id AS account_id FROM e JOIN accounts a ON a.user_id = e.user_id WHERE e.account_ids IS NULL""")

oracle("new_users")("""
, c AS (SELECT 'NATION_' || CAST(c_custkey % 40 AS VARCHAR) AS username, c_custkey AS seq FROM customer)
SELECT username, MIN(seq) AS seq FROM c
WHERE username <> '' AND username NOT IN (SELECT username FROM users) GROUP BY username""")

oracle("stream_ingest")("""
SELECT seq, type, entry_price, exit_price, pnl FROM checked WHERE ok AND op <> 'D'""")

# E1 over the live ledger
oracle("stream_daily_summary")(_LIVE_LEDGER + """
SELECT user_id, date, CAST(COUNT(*) AS BIGINT) AS trade_count, CAST(SUM(pnl) AS DECIMAL(28,4)) AS daily_pnl,
  CAST(SUM(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(SUM(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses,
  CAST(SUM(CASE WHEN type = 'LONG' THEN 1 ELSE 0 END) AS BIGINT) AS longs, CAST(SUM(CASE WHEN type = 'SHORT' THEN 1 ELSE 0 END) AS BIGINT) AS shorts
FROM live GROUP BY user_id, date""")

QUERIES["stream_ledger"] = QUERIES["live_ledger"]


# the live dashboard: the batch figures with the live ledger in the place of the trades
def _over_live(body: str) -> str:
    return PRELUDE + _LIVE_LEDGER + body.removeprefix(PRELUDE).replace("FROM trades", "FROM live")


QUERIES["stream_outcomes"] = QUERIES["change_outcomes"]
QUERIES["stream_stat_card"] = _over_live(QUERIES["stat_card"])
QUERIES["stream_account_stats"] = _over_live(QUERIES["account_stats"])
QUERIES["stream_month_stats"] = _over_live(QUERIES["month_stats"])
QUERIES["stream_consistency"] = _over_live(_CONSISTENCY.format(where=""))
QUERIES["stream_curve"] = _over_live(QUERIES["equity_curve"])
oracle("stream_closed_days")(_LIVE_LEDGER + f""",
b AS ({_base('live', 'user_id, date')})
SELECT user_id, date, CAST(total AS BIGINT) AS total, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(longs AS BIGINT) AS longs,
  CAST(shorts AS BIGINT) AS shorts, CAST(net AS {_TOTAL}) AS net_pnl, CAST(CAST(gw AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS {_TOTAL}) AS gross_win,
  CAST(CAST(gl AS DECIMAL(38,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS {_TOTAL}) AS gross_loss,
  date < (SELECT CAST(MAX(ts) AS DATE) - 7 FROM checked WHERE ok) AS closed
FROM b""")
oracle("stream_user_purge")(_LIVE_LEDGER + """
SELECT user_id, id, date, pnl, CAST(SUM(pnl) OVER (PARTITION BY user_id, date) AS DECIMAL(28,4)) AS day_pnl FROM live
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = live.user_id AND u.id % 5 = 0)""")

QUERIES["stream_api_stats"] = _over_live(QUERIES["api_stats"]).replace("1996-01-01", "2024-02-01").replace("2000-12-31", "2024-12-31")
QUERIES["stream_accounts"] = QUERIES["account_changes"]
QUERIES["stream_account_outcomes"] = QUERIES["account_outcomes"]

oracle("sql_user_trades")("""
SELECT id, date, type, pnl FROM trades WHERE user_id = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND list_contains(account_ids, 22)""")

oracle("sql_views")("""
, d AS (SELECT user_id, date, SUM(pnl) AS p FROM trades GROUP BY user_id, date),
best AS (SELECT user_id, strftime(date, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS days, CAST(MAX(p) AS DECIMAL(28,4)) AS best_day FROM d GROUP BY ALL)
SELECT m.user_id, m.month, net_pnl, profit_factor, days, best_day
FROM (""" + QUERIES["monthly_summary"] + """) m JOIN best USING (user_id, month)""")
