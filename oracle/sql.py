"""DuckDB SQL equivalents of the reports, written independently of the Spark
code path.  Only the fixture derivation text is shared (it defines the data,
not the operator under test).  Views ``orders``, ``customer``, ``lineitem``
... are pre-registered by the caller."""

from __future__ import annotations

from dunning.functions import labels as L
from dunning.sources import tpch_fixture as fx

P, FILTERED = fx.PARAMS, fx.FILTERED
AS_OF = f"DATE '{P.as_of.isoformat()}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def mtotal(x: str) -> str:
    return f"COALESCE({msum(x)}, CAST(0 AS DOUBLE))"


def mmean(x: str) -> str:
    return f"({msum(x)} / NULLIF(COUNT({x}), 0))"


def pmean(x: str) -> str:
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def avg_int(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def status_case(days: str) -> str:
    return (
        f"CASE WHEN {days} > 120 THEN {q(L.STATUS_SEVERE)} WHEN {days} > 90 THEN {q(L.STATUS_HIGH)} "
        f"WHEN {days} > 60 THEN {q(L.STATUS_MODERATE)} WHEN {days} > 30 THEN {q(L.STATUS_EARLY)} "
        f"ELSE {q(L.STATUS_CURRENT)} END"
    )


def status_rank_case(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} = {q(lab)} THEN {i}" for i, lab in enumerate(L.STATUSES)) + " END"


def segment_rank_case(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} = {q(lab)} THEN {i}" for i, lab in enumerate(L.SEGMENTS)) + " END"


def rule_p(days: str) -> str:
    return (
        f"CASE WHEN {days} > 60 THEN CAST(0.85 AS DOUBLE) WHEN {days} > 30 THEN CAST(0.5 AS DOUBLE) "
        f"WHEN {days} > 15 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END"
    )


def segment_case(p: str, include_lowest: bool = False) -> str:
    low = f"{p} >= 0 AND {p} <= 0.3" if include_lowest else f"{p} > 0 AND {p} <= 0.3"
    return (
        f"CASE WHEN {low} THEN {q(L.SEGMENT_LOW)} WHEN {p} > 0.3 AND {p} <= 0.6 THEN {q(L.SEGMENT_MODERATE)} "
        f"WHEN {p} > 0.6 AND {p} <= 0.8 THEN {q(L.SEGMENT_HIGH)} WHEN {p} > 0.8 AND {p} <= 1.0 "
        f"THEN {q(L.SEGMENT_EXTREME)} END"
    )


def segment_values() -> str:
    rows = ", ".join(f"({i}, {q(s)}, {q(a)}, {q(f)})" for i, (s, a, f) in enumerate(L.SEGMENT_ACTIONS))
    return f"seg_dim(segment_rank, risk_segment, actions, follow_up) AS (VALUES {rows})"


AGING = ",\n    ".join(
    f"CASE WHEN aging_status = {q(label)} THEN balance ELSE CAST(0 AS DOUBLE) END AS {col}"
    for (col, _), label in zip(L.AGING_BUCKETS, L.STATUSES)
)

BASE = f"""
statement_base AS (
  SELECT {", ".join(fx.statement_columns(fx.duckdb_days))}
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus IN ('O', 'P')
),
st_days AS (
  SELECT *, CAST(datediff('day', due_date, {AS_OF}) AS INTEGER) AS days_past_due FROM statement_base
),
st_status AS (SELECT *, {status_case("days_past_due")} AS aging_status FROM st_days),
st_scored AS (
  SELECT *,
    {AGING},
    {rule_p("days_past_due")} AS default_probability
  FROM st_status
),
statement AS (SELECT *, {segment_case("default_probability")} AS risk_segment FROM st_scored),
payments AS (
  SELECT {", ".join(fx.payments_columns(fx.duckdb_days))}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
payments_filled AS (
  SELECT customer_code, customer_name, document_no, line_no, payment_date,
    COALESCE(paid_amount, CAST(0 AS DOUBLE)) AS paid_amount,
    COALESCE(cash, CAST(0 AS DOUBLE)) AS cash, COALESCE(cheque, CAST(0 AS DOUBLE)) AS cheque,
    COALESCE(card, CAST(0 AS DOUBLE)) AS card, COALESCE(transfer, CAST(0 AS DOUBLE)) AS transfer
  FROM payments
)"""


def with_base(body: str, *extra_ctes: str) -> str:
    ctes = BASE + "".join(",\n" + c for c in extra_ctes)
    return f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, *extra_ctes: str) -> None:
    ORACLE[name] = with_base(body, *extra_ctes)


# --- executive summary / aging analysis -------------------------------

oracle(
    "portfolio_kpis",
    f"""
SELECT total_balance, overdue_balance, overdue_customers,
  CASE WHEN total_balance > 0 THEN overdue_balance / total_balance ELSE CAST(0 AS DOUBLE) END AS overdue_ratio,
  CASE WHEN total_balance > 0 THEN wdays / total_balance ELSE CAST(0 AS DOUBLE) END AS dso_days
FROM (
  SELECT {mtotal("balance")} AS total_balance,
    {mtotal("CASE WHEN days_past_due > 30 THEN balance END")} AS overdue_balance,
    COUNT(DISTINCT CASE WHEN days_past_due > 30 THEN customer_code END) AS overdue_customers,
    COALESCE(CAST(SUM(CAST(balance AS DECIMAL(18,2)) * days_past_due) AS DOUBLE), CAST(0 AS DOUBLE)) AS wdays
  FROM statement
)""",
)

oracle(
    "monthly_balance",
    f"""
SELECT COALESCE(strftime(invoice_date, '%Y-%m'), 'NaT') AS invoice_month, {mtotal("balance")} AS balance
FROM statement GROUP BY 1""",
)

oracle(
    "balance_by_status",
    f"""
SELECT aging_status, {mtotal("balance")} AS balance
FROM statement WHERE aging_status IS NOT NULL GROUP BY 1""",
)

oracle(
    "aging_totals",
    "\nUNION ALL\n".join(
        f"SELECT {q(label)} AS aging_range, {mtotal(col)} AS amount FROM statement" for col, label in L.AGING_BUCKETS
    ),
)

oracle(
    "balance_by_due_weekday",
    f"""
SELECT CAST(isodow(due_date) - 1 AS INTEGER) AS weekday_index, dayname(due_date) AS due_weekday,
  {mtotal("balance")} AS balance
FROM statement WHERE due_date IS NOT NULL GROUP BY 1, 2""",
)

oracle(
    "balance_by_due_month",
    f"""
SELECT CAST(month(due_date) AS INTEGER) AS month_index, monthname(due_date) AS due_month,
  {mtotal("balance")} AS balance
FROM statement WHERE due_date IS NOT NULL GROUP BY 1, 2""",
)

_STATUS_COLS = (
    ("current", L.STATUS_CURRENT),
    ("early_warning", L.STATUS_EARLY),
    ("moderate", L.STATUS_MODERATE),
    ("high", L.STATUS_HIGH),
    ("severe", L.STATUS_SEVERE),
)
oracle(
    "monthly_status_matrix",
    "SELECT COALESCE(strftime(invoice_date, '%Y-%m'), 'NaT') AS invoice_month, "
    + ", ".join(
        f"{mtotal(f'CASE WHEN aging_status = {q(lab)} THEN balance END')} AS {name}" for name, lab in _STATUS_COLS
    )
    + " FROM statement GROUP BY 1",
)

oracle(
    "risk_profiles",
    f"""
SELECT d.segment_rank, d.risk_segment, p.avg_days, COALESCE(p.bal, CAST(0 AS DOUBLE)) AS balance,
  COALESCE(p.customers, 0) AS customers, p.avg_probability
FROM seg_dim d LEFT JOIN (
  SELECT risk_segment, {avg_int("days_past_due")} AS avg_days, {msum("balance")} AS bal,
    COUNT(DISTINCT customer_code) AS customers, {pmean("default_probability")} AS avg_probability
  FROM statement WHERE risk_segment IS NOT NULL GROUP BY 1
) p ON d.risk_segment = p.risk_segment""",
    segment_values(),
)


def _top(where: str) -> str:
    return f"""
SELECT customer_name, {mtotal("balance")} AS balance, {avg_int("days_past_due")} AS avg_days
FROM statement WHERE customer_name IS NOT NULL {where}
GROUP BY 1 ORDER BY balance DESC, customer_name ASC LIMIT 10"""


oracle("top_customers", _top(""))
oracle("top_overdue", _top("AND days_past_due > 60"))


def _box(by: str | None) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"s.{by} = r.{by} AND " if by else ""
    return f"""
SELECT s.*, (SELECT COUNT(*) FROM statement r
             WHERE {join}r.days_past_due IS NOT NULL
               AND (r.days_past_due < s.lower_fence OR r.days_past_due > s.upper_fence)) AS outliers
FROM (
  SELECT {key}min_value, q1, median, q3, max_value, n,
    q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
  FROM (
    SELECT {key}CAST(MIN(days_past_due) AS DOUBLE) AS min_value,
      quantile_cont(days_past_due, 0.25) AS q1, quantile_cont(days_past_due, 0.5) AS median,
      quantile_cont(days_past_due, 0.75) AS q3, CAST(MAX(days_past_due) AS DOUBLE) AS max_value,
      COUNT(days_past_due) AS n
    FROM statement WHERE days_past_due IS NOT NULL {group}
  )
) s"""


oracle("days_box_overall", _box(None))
oracle("days_box_by_status", _box("aging_status"))
oracle("days_box_by_segment", _box("risk_segment"))

oracle(
    "filtered_statement",
    f"""
SELECT * FROM statement
WHERE invoice_date BETWEEN DATE '{FILTERED.filter_start}' AND DATE '{FILTERED.filter_end}'
  AND aging_status IN ({", ".join(q(s) for s in FILTERED.filter_statuses)})""",
)

oracle(
    "filter_domain",
    """
SELECT MIN(invoice_date) AS min_invoice_date, MAX(invoice_date) AS max_invoice_date,
  array_to_string(list_sort(list_distinct(list(aging_status))), '|') AS statuses
FROM statement""",
)

oracle(
    "segment_action_plan",
    """
SELECT s.document_no, s.customer_code, s.risk_segment, d.segment_rank, d.actions, d.follow_up
FROM statement s LEFT JOIN seg_dim d ON s.risk_segment = d.risk_segment""",
    segment_values(),
)


def fmt_currency_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' WHEN {x} % 1 = 0 THEN '$' || format('{{:,.0f}}', {x}) "
        f"ELSE '$' || format('{{:,.2f}}', {x}) END"
    )


def fmt_percent_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE format('{{:.1f}}', {x} * 100.0) || '%' END"


oracle(
    "fmt_currency",
    f"""
SELECT document_no, balance, {fmt_currency_sql("balance")} AS balance_text,
  {fmt_currency_sql("initial_amount")} AS initial_text,
  {fmt_percent_sql("default_probability")} AS probability_text
FROM statement""",
)


_CELL = "CASE WHEN days_past_due > 30 THEN aging_status ELSE CAST(default_probability AS VARCHAR) END"


def _passing(x: str, shown) -> str:
    number = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {x} IS NOT NULL AND {number} IS NULL THEN {x} ELSE {shown(number)} END"


oracle(
    "fmt_percent",
    f"""
SELECT document_no, {fmt_percent_sql("default_probability")} AS probability_text,
  {_passing("cell", fmt_percent_sql)} AS cell_percent, {_passing("cell", fmt_currency_sql)} AS cell_currency
FROM (SELECT *, {_CELL} AS cell FROM statement)""",
)


# --- payment methods ---------------------------------------------------------

METHODS = L.PAYMENT_METHODS

oracle(
    "payment_method_totals",
    "\nUNION ALL\n".join(f"SELECT {q(label)} AS method, {mtotal(c)} AS amount FROM payments_filled" for c, label in METHODS),
)

oracle(
    "customer_method_totals",
    "\nUNION ALL\n".join(
        f"SELECT customer_code, {q(label)} AS method, {mtotal(c)} AS amount FROM payments_filled "
        "WHERE customer_code IS NOT NULL GROUP BY customer_code"
        for c, label in METHODS
    ),
)

oracle(
    "payment_method_summary",
    """
SELECT method, COALESCE(CAST(t AS DOUBLE), CAST(0 AS DOUBLE)) AS total_paid, n AS transactions,
  COALESCE(CAST(t AS DOUBLE), CAST(0 AS DOUBLE)) / NULLIF((SELECT CAST(SUM(COALESCE(t, 0)) AS DOUBLE) FROM m), 0) AS share
FROM m""",
    "m AS ("
    + "\nUNION ALL\n".join(
        f"SELECT {q(label)} AS method, SUM(CASE WHEN {c} > 0 THEN CAST(paid_amount AS DECIMAL(18,2)) END) AS t, "
        f"COUNT(CASE WHEN {c} > 0 THEN 1 END) AS n FROM payments_filled"
        for c, label in METHODS
    )
    + ")",
)

oracle(
    "payment_stats",
    f"""
SELECT {mtotal("paid_amount")} AS total_paid, {mmean("paid_amount")} AS avg_paid,
  COUNT(*) AS transactions, COUNT(DISTINCT customer_code) AS customers
FROM payments""",
)

oracle(
    "payment_method_by_status",
    """
SELECT method, aging_status, CAST(t AS DOUBLE) AS total_paid, CAST(transactions AS BIGINT) AS transactions,
  customers, CAST(t AS DOUBLE) / NULLIF((SELECT CAST(SUM(t) AS DOUBLE) FROM g), 0) AS share
FROM g""",
    "per AS ("
    + "\nUNION ALL\n".join(
        f"SELECT customer_code, paid_amount, {q(label)} AS method FROM payments_filled WHERE {c} > 0"
        for c, label in METHODS
    )
    + ")",
    "pre AS (SELECT customer_code, method, SUM(CAST(paid_amount AS DECIMAL(18,2))) AS paid_dec, COUNT(*) AS n "
    "FROM per GROUP BY customer_code, method)",
    "stat AS (SELECT DISTINCT customer_code, aging_status FROM statement)",
    f"j AS (SELECT pre.*, COALESCE(stat.aging_status, {q(L.NO_DATA)}) AS aging_status FROM pre "
    "LEFT JOIN stat ON pre.customer_code IS NOT DISTINCT FROM stat.customer_code)",
    "g AS (SELECT method, aging_status, SUM(paid_dec) AS t, COUNT(customer_code) AS customers, "
    "SUM(n) AS transactions FROM j GROUP BY method, aging_status)",
)

# --- customers ---------------------------------------------------------------

ALL_CUSTOMERS = """all_cust AS (
  SELECT COALESCE(a.customer_code, b.customer_code) AS customer_code,
    CASE WHEN a.customer_code IS NOT NULL THEN a.sn ELSE b.pn END AS customer_name,
    a.customer_code IS NOT NULL AS in_statement, b.customer_code IS NOT NULL AS in_payments
  FROM (SELECT customer_code, MIN(customer_name) AS sn FROM statement WHERE customer_code IS NOT NULL GROUP BY 1) a
  FULL OUTER JOIN (SELECT customer_code, MIN(customer_name) AS pn FROM payments WHERE customer_code IS NOT NULL GROUP BY 1) b
  ON a.customer_code = b.customer_code
)"""

oracle(
    "all_customers",
    """
SELECT customer_code, customer_name, concat_ws(' - ', CAST(customer_code AS VARCHAR), customer_name) AS label,
  in_statement, in_payments
FROM all_cust""",
    ALL_CUSTOMERS,
)

oracle(
    "customer_profiles",
    f"""
SELECT u.customer_code, u.customer_name, u.in_statement AS has_invoices, s.invoice_count, s.total_balance, s.avg_days,
  CASE WHEN u.in_statement THEN CASE WHEN s.total_balance > 0 THEN s.late / s.total_balance * 100.0
       ELSE CAST(0 AS DOUBLE) END END AS overdue_pct,
  s.avg_probability, s.avg_initial * 0.8 AS recommended_limit
FROM all_cust u LEFT JOIN (
  SELECT customer_code, COUNT(*) AS invoice_count, {mtotal("balance")} AS total_balance,
    {avg_int("days_past_due")} AS avg_days, {mtotal("CASE WHEN days_past_due > 60 THEN balance END")} AS late,
    {pmean("default_probability")} AS avg_probability, {mmean("initial_amount")} AS avg_initial
  FROM statement WHERE customer_code IS NOT NULL GROUP BY 1
) s ON u.customer_code = s.customer_code""",
    ALL_CUSTOMERS,
)

oracle(
    "payments_only_customers",
    f"""
SELECT customer_code, MIN(customer_name) AS customer_name, COUNT(*) AS payment_count, {mmean("paid_amount")} AS avg_paid,
  MAX(payment_date) AS last_payment, {mtotal("paid_amount")} AS total_paid,
  COALESCE(strftime(MAX(payment_date), '%d/%m/%Y'), 'N/A') AS last_payment_text
FROM payments_filled p
WHERE customer_code IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM statement s WHERE s.customer_code = p.customer_code)
GROUP BY customer_code""",
)

PAYMENT_ORDER_SQL = (
    "payment_date DESC NULLS LAST, document_no ASC NULLS LAST, line_no ASC NULLS LAST, paid_amount DESC NULLS LAST, "
    "cash DESC NULLS LAST, cheque DESC NULLS LAST, card DESC NULLS LAST, transfer DESC NULLS LAST"
)

oracle(
    "last_payments",
    f"""
SELECT customer_code, payment_rank, payment_date, document_no, line_no, paid_amount, cash, cheque, card, transfer
FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_code ORDER BY {PAYMENT_ORDER_SQL}) AS INTEGER) AS payment_rank
  FROM payments_filled WHERE customer_code IS NOT NULL
) WHERE payment_rank <= 5""",
)

oracle(
    "payment_timeline",
    """
SELECT customer_code, payment_date, document_no, line_no, paid_amount FROM payments_filled
WHERE customer_code IS NOT NULL ORDER BY customer_code, payment_date, document_no, line_no, paid_amount""",
)

MODAL_STATUS = f"""modal AS (
  SELECT customer_code, aging_status AS modal_status FROM (
    SELECT customer_code, aging_status,
      ROW_NUMBER() OVER (PARTITION BY customer_code ORDER BY COUNT(*) DESC, {status_rank_case("aging_status")} ASC) AS rn
    FROM statement WHERE customer_code IS NOT NULL AND aging_status IS NOT NULL
    GROUP BY customer_code, aging_status
  ) WHERE rn = 1
)"""

oracle("customer_modal_status", "SELECT customer_code, modal_status FROM modal", MODAL_STATUS)

ROLLUP = f"""rollup AS (
  SELECT s.customer_code, s.customer_name, s.avg_days, s.balance, s.avg_probability,
    COALESCE(m.modal_status, {q(L.NO_DATA)}) AS modal_status
  FROM (
    SELECT customer_code, MIN(customer_name) AS customer_name, {avg_int("days_past_due")} AS avg_days,
      {mtotal("balance")} AS balance, {pmean("default_probability")} AS avg_probability
    FROM statement WHERE customer_code IS NOT NULL GROUP BY 1
  ) s LEFT JOIN modal m ON s.customer_code = m.customer_code
)"""

oracle("customer_rollup", "SELECT * FROM rollup", MODAL_STATUS, ROLLUP)

HISTORY = f"""history AS (
  SELECT customer_code, {mtotal("paid_amount")} AS total_paid, {mmean("paid_amount")} AS avg_paid,
    COUNT(paid_amount) AS payment_count, MIN(payment_date) AS first_payment, MAX(payment_date) AS last_payment,
    CAST(datediff('day', MAX(payment_date), {AS_OF}) AS INTEGER) AS days_since_last_payment
  FROM payments_filled WHERE customer_code IS NOT NULL GROUP BY 1
)"""

oracle("payment_history", "SELECT * FROM history", HISTORY)


def D(x) -> str:
    """A DOUBLE literal (DuckDB reads 0.3 as DECIMAL)."""
    return f"CAST({x} AS DOUBLE)"


# --- concentration -------------------------------------------------------------

_PARETO_ORDER = "ORDER BY COALESCE(CAST(bal AS DOUBLE), CAST(0 AS DOUBLE)) DESC, customer_name ASC"
oracle(
    "pareto",
    f"""
SELECT position, customer_name, balance, cum_balance,
  cum_balance / NULLIF((SELECT CAST(SUM(bal) AS DOUBLE) FROM per), 0) * {D(100)} AS cum_pct,
  cum_balance / NULLIF((SELECT CAST(SUM(bal) AS DOUBLE) FROM per), 0) * {D(100)} <= {D(80)} AS is_top_share
FROM (
  SELECT customer_name, COALESCE(CAST(bal AS DOUBLE), CAST(0 AS DOUBLE)) AS balance,
    ROW_NUMBER() OVER ({_PARETO_ORDER}) AS position,
    CAST(SUM(COALESCE(bal, 0)) OVER ({_PARETO_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_balance
  FROM per
)""",
    "per AS (SELECT customer_name, SUM(CAST(balance AS DECIMAL(18,2))) AS bal FROM statement "
    "WHERE customer_name IS NOT NULL GROUP BY customer_name)",
)

# --- collection plan -----------------------------------------------------------

WS = f"DATE '{P.week_start}'"
WE = f"DATE '{P.week_end}'"


def plan_ctes(week_start: str, week_end: str, prefix: str = "") -> list[str]:
    s = prefix
    return [
        f"{s}scope AS (SELECT * FROM statement WHERE invoice_date <= {week_end})",
        f"{s}hist AS (SELECT customer_code, {mmean('paid_amount')} AS avg_paid FROM payments_filled "
        "WHERE customer_code IS NOT NULL GROUP BY customer_code)",
        f"{s}histn AS (SELECT customer_code, avg_paid / (SELECT CASE WHEN MAX(avg_paid) = 0 THEN {D(1)} "
        f"ELSE MAX(avg_paid) END FROM {s}hist) AS history_norm FROM {s}hist)",
        f"{s}plan1 AS (SELECT customer_code, customer_name, SUM(CAST(balance AS DECIMAL(18,2))) AS bal, "
        f"COALESCE(CAST(SUM(CAST(balance AS DECIMAL(18,2))) AS DOUBLE), {D(0)}) AS balance, "
        f"{pmean('default_probability')} AS avg_probability FROM {s}scope "
        "WHERE customer_code IS NOT NULL AND customer_name IS NOT NULL GROUP BY customer_code, customer_name)",
        f"{s}plan2 AS (SELECT p.*, p.balance / (SELECT CASE WHEN MAX(balance) = 0 THEN {D(1)} ELSE MAX(balance) END "
        f"FROM {s}plan1) AS balance_norm, COALESCE(h.history_norm, {D(0.5)}) AS history_norm "
        f"FROM {s}plan1 p LEFT JOIN {s}histn h ON p.customer_code = h.customer_code)",
        f"{s}plan3 AS (SELECT *, {D(0.5)} * ({D(1)} - avg_probability) + {D(0.3)} * history_norm + "
        f"{D(0.2)} * balance_norm AS collection_score FROM {s}plan2)",
        f"{s}ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY collection_score DESC NULLS LAST, customer_code, "
        "customer_name) AS position, CAST(SUM(COALESCE(bal, 0)) OVER (ORDER BY collection_score DESC NULLS LAST, "
        "customer_code, customer_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_balance "
        f"FROM {s}plan3)",
        f"{s}selected AS (SELECT customer_code, customer_name, balance, avg_probability, balance_norm, history_norm, "
        f"collection_score, position, cum_balance FROM {s}ranked WHERE position <= COALESCE((SELECT MIN(position) "
        f"FROM {s}ranked WHERE cum_balance >= {D(P.weekly_goal)}), 4611686018427387904))",
    ]


PLAN = plan_ctes(WS, WE)
FUTURE_WS = "DATE '2001-08-06'"
FUTURE_WE = "DATE '2001-08-12'"
WEEK_PAID = (
    f"wk AS (SELECT customer_code, {mtotal('paid_amount')} AS week_paid FROM payments_filled "
    f"WHERE payment_date BETWEEN {WS} AND {WE} AND customer_code IS NOT NULL GROUP BY customer_code)"
)

oracle(
    "week_calendar",
    f"""
SELECT week_start, week_start + 6 AS week_end, CAST(year(week_start) AS INTEGER) AS year,
  CAST(weekofyear(week_start) AS INTEGER) AS iso_week,
  'Week ' || CAST(weekofyear(week_start) AS VARCHAR) || ' (' || strftime(week_start, '%d/%m/%Y') || ' - '
    || strftime(week_start + 6, '%d/%m/%Y') || ')' AS label,
  week_start > as_of AS is_future
FROM (
  SELECT as_of, CAST(unnest(generate_series(CAST(as_of - 21 + CAST((8 - isodow(as_of - 21)) % 7 AS INTEGER) AS TIMESTAMP),
    CAST(as_of + 42 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM (SELECT MAX(invoice_date) + 1 AS as_of FROM statement)
)""",
)

oracle("plan_scope_all", f"SELECT * FROM statement WHERE invoice_date <= {WE}")
oracle("plan_scope_week", f"SELECT * FROM statement WHERE invoice_date BETWEEN {WS} AND {WE}")
oracle("normalized_history", "SELECT customer_code, h.avg_paid, n.history_norm FROM hist h JOIN histn n USING (customer_code)", *PLAN[:3])
oracle(
    "collection_score",
    "SELECT customer_code, customer_name, avg_probability, balance, balance_norm, history_norm, collection_score FROM plan3",
    *PLAN[:6],
)
oracle("collection_plan", "SELECT * FROM selected", *PLAN)
oracle("week_payments", "SELECT customer_code, week_paid FROM wk", WEEK_PAID)
oracle(
    "plan_compliance",
    f"""
SELECT s.*, COALESCE(w.week_paid, {D(0)}) AS paid_in_week,
  CASE WHEN COALESCE(w.week_paid, 0) > 0 THEN {q(L.PLAN_PAID)} ELSE {q(L.PLAN_NOT_FULFILLED)} END AS compliance
FROM selected s LEFT JOIN wk w ON s.customer_code = w.customer_code""",
    *PLAN,
    WEEK_PAID,
)
oracle(
    "plan_compliance_future",
    f"SELECT s.*, {D(0)} AS paid_in_week, {q(L.PLAN_FUTURE)} AS compliance FROM f_selected s",
    *plan_ctes(FUTURE_WS, FUTURE_WE, "f_"),
)
oracle(
    "weekly_kpis",
    f"""
SELECT {D(P.weekly_goal)} AS weekly_goal, (SELECT {mtotal("balance")} FROM selected) AS planned_balance,
  c.collected AS collected, c.collected / {D(P.weekly_goal)} AS compliance_ratio
FROM (SELECT {mtotal("paid_amount")} AS collected FROM payments_filled
      WHERE payment_date BETWEEN {WS} AND {WE} AND customer_code IS NOT NULL) c""",
    *PLAN,
)
oracle(
    "monthly_kpis",
    f"""
SELECT {D(P.weekly_goal * 4)} AS monthly_goal, {mtotal("paid_amount")} AS collected,
  {mtotal("paid_amount")} / {D(P.weekly_goal * 4)} AS compliance_ratio
FROM payments_filled WHERE month(payment_date) = {P.week_start.month} AND year(payment_date) = {P.week_start.year}""",
)
oracle(
    "payments_outside_plan",
    """
SELECT w.customer_code, w.week_paid AS paid, f.customer_name, f.default_probability
FROM wk w LEFT JOIN (SELECT DISTINCT customer_code, customer_name, default_probability FROM statement) f
  ON w.customer_code = f.customer_code
WHERE w.customer_code NOT IN (SELECT customer_code FROM selected)""",
    *PLAN,
    WEEK_PAID,
)

# --- credit limits ---------------------------------------------------------------


def _modal(col: str, rank_case: str, name: str) -> str:
    return f"""{name} AS (
  SELECT customer_code, customer_name, {col} FROM (
    SELECT customer_code, customer_name, {col},
      ROW_NUMBER() OVER (PARTITION BY customer_code, customer_name ORDER BY COUNT(*) DESC, {rank_case} ASC) AS rn
    FROM statement WHERE customer_code IS NOT NULL AND customer_name IS NOT NULL AND {col} IS NOT NULL
    GROUP BY customer_code, customer_name, {col}
  ) WHERE rn = 1
)"""


def _fix(x: str, scale: int) -> str:
    return f"CAST(round({x} * {D(10**scale)}) AS HUGEINT)"


def _x(part: str) -> str:
    return q(L.EXPLANATION[part])


def _seg_words(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} = {q(a)} THEN {q(b)}" for a, b in L.SEGMENT_WORDS) + " ELSE 'unknown risk' END"


LIMIT_CTES = [
    HISTORY,
    f"kb AS (SELECT customer_code, customer_name, {mtotal('balance')} AS balance, {avg_int('days_past_due')} AS avg_days, "
    f"{pmean('default_probability')} AS avg_probability FROM statement "
    "WHERE customer_code IS NOT NULL AND customer_name IS NOT NULL GROUP BY customer_code, customer_name)",
    _modal("risk_segment", segment_rank_case("risk_segment"), "mseg"),
    _modal("aging_status", status_rank_case("aging_status"), "mst"),
    "lj AS (SELECT kb.*, mseg.risk_segment, mst.aging_status, h.total_paid, h.avg_paid, h.payment_count, "
    "h.days_since_last_payment FROM kb "
    "LEFT JOIN mseg ON kb.customer_code = mseg.customer_code AND kb.customer_name = mseg.customer_name "
    "LEFT JOIN mst ON kb.customer_code = mst.customer_code AND kb.customer_name = mst.customer_name "
    "LEFT JOIN history h ON kb.customer_code = h.customer_code)",
    f"sc AS (SELECT MAX(payment_count) AS max_n, MAX(days_since_last_payment) AS max_ds, COUNT(avg_paid) AS n, "
    f"SUM({_fix('avg_paid', 4)}) AS s1, SUM({_fix('avg_paid', 4)} * {_fix('avg_paid', 4)}) AS s2 FROM lj)",
    f"sc2 AS (SELECT max_n, max_ds, CASE WHEN n >= 2 THEN sqrt(greatest(CAST(n * s2 - s1 * s1 AS DOUBLE) / "
    f"CAST(n * (n - 1) AS DOUBLE), {D(0)})) / {D(10000)} END AS spread, CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) / {D(10000)} AS centre FROM sc)",
    f"""fa AS (SELECT lj.*,
    {D(1)} - avg_probability AS risk_f,
    CASE WHEN (h0) IS NOT NULL THEN least(greatest(h0, {D(0)}), {D(1)}) END AS history_f,
    CASE WHEN (r0) IS NOT NULL THEN least(greatest(r0, {D(0)}), {D(1)}) END AS recency_f,
    CASE WHEN avg_days > 90 THEN {D(0.1)} WHEN avg_days > 60 THEN {D(0.3)} WHEN avg_days > 30 THEN {D(0.6)}
         WHEN avg_days > 15 THEN {D(0.8)} ELSE {D(1)} END AS behaviour_f,
    CASE WHEN avg_paid > 0 THEN avg_paid ELSE balance END AS base_amount
  FROM (SELECT lj.*,
          {D(0.5)} * (CAST(payment_count AS DOUBLE) / sc2.max_n) + {D(0.5)} * ({D(1)} - sc2.spread / sc2.centre) AS h0,
          CAST(days_since_last_payment AS DOUBLE) / (CASE WHEN sc2.max_ds = 0 THEN 1 ELSE sc2.max_ds END) AS r0
        FROM lj, sc2) lj)""",
    f"""fb AS (SELECT *, {D(0.4)} * risk_f + {D(0.3)} * history_f + {D(0.2)} * recency_f + {D(0.1)} * behaviour_f AS weight
  FROM fa)""",
    f"""limits AS (SELECT customer_code, customer_name, risk_segment, aging_status, avg_probability, balance, total_paid,
    payment_count,
    CASE WHEN l1 IS NOT NULL THEN greatest(l1, {D(1000)}) END AS credit_limit,
    CASE WHEN avg_days > 60 THEN CAST(trunc(d0 * {D(0.5)}) AS INTEGER) ELSE d0 END AS max_days,
    {_x("customer")} || {_seg_words("risk_segment")} || {_x("risk")}
      || COALESCE(format('{{:.1f}}', avg_probability * {D(100)}), 'nan') || '%, '
      || CASE WHEN payment_count > 0 THEN {_x("history")} || CAST(payment_count AS VARCHAR)
              || {_x("payments")} || format('{{:,.2f}}', avg_paid) ELSE {_x("no_history")} END || ', '
      || CASE WHEN days_since_last_payment > 0 THEN {_x("seniority")} || CAST(days_since_last_payment AS VARCHAR)
              || {_x("days")} ELSE {_x("new")} END || ', '
      || {_x("behavior")} || COALESCE(aging_status, 'nan') || {_x("average")}
      || COALESCE(format('{{:.0f}}', avg_days), 'nan') || {_x("overdue")} || {_x("advice")}
      || CASE WHEN weight < 0.5 THEN {_x("reduce")} ELSE {_x("keep")} END || {_x("limit")} AS explanation
  FROM (SELECT *,
          CASE WHEN risk_segment IN ({q(L.SEGMENT_HIGH)}, {q(L.SEGMENT_EXTREME)}) THEN base_amount * ({D(1)} + weight) * {D(0.5)}
               ELSE base_amount * ({D(1)} + weight) END AS l1,
          CASE WHEN risk_segment = {q(L.SEGMENT_EXTREME)} THEN 7 WHEN risk_segment = {q(L.SEGMENT_HIGH)} THEN 15
               WHEN risk_segment = {q(L.SEGMENT_MODERATE)} THEN 30 ELSE 60 END AS d0
        FROM fb))""",
    f"lf AS (SELECT * FROM limits WHERE risk_segment IN ({', '.join(q(s) for s in FILTERED.limit_segments)}) "
    f"AND credit_limit BETWEEN {D(FILTERED.limit_low)} AND {D(FILTERED.limit_high)})",
]

oracle("credit_limits", "SELECT * FROM limits", *LIMIT_CTES)
oracle("limit_explanation", "SELECT customer_code, customer_name, explanation FROM limits", *LIMIT_CTES)
oracle("limits_filtered", "SELECT * FROM lf", *LIMIT_CTES)
oracle(
    "limits_domain",
    """
SELECT array_to_string(list_sort(list_distinct(list(risk_segment))), '|') AS segments,
  MIN(credit_limit) AS min_limit, MAX(credit_limit) AS max_limit FROM limits""",
    *LIMIT_CTES,
)
oracle(
    "limits_summary",
    f"""
SELECT COUNT(*) AS customers,
  CAST(SUM({_fix("credit_limit", 6)}) AS DOUBLE) / NULLIF(COUNT(credit_limit), 0) / {D(1000000)} AS avg_limit,
  {avg_int("max_days")} AS avg_max_days
FROM limits""",
    *LIMIT_CTES,
)
oracle(
    "limit_histogram",
    f"""
SELECT e.bin, e.bin_start, e.bin_end, COALESCE(c.cnt, 0) AS count
FROM (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / {D(20)}) AS bin_start,
             lo + (i + 1) * ((hi - lo) / {D(20)}) AS bin_end
      FROM hs, range(0, 20) t(i)) e
LEFT JOIN (
  SELECT CASE WHEN hs.hi = hs.lo THEN 0 ELSE least(CAST(floor((credit_limit - hs.lo) / ((hs.hi - hs.lo) / {D(20)})) AS INTEGER), 19) END AS bin,
    COUNT(*) AS cnt
  FROM limits, hs WHERE credit_limit IS NOT NULL GROUP BY 1
) c ON e.bin = c.bin""",
    *LIMIT_CTES,
    "hs AS (SELECT CAST(MIN(credit_limit) AS DOUBLE) AS lo, CAST(MAX(credit_limit) AS DOUBLE) AS hi FROM limits WHERE credit_limit IS NOT NULL)",
)
oracle(
    "limit_points",
    "SELECT customer_code, customer_name, risk_segment, max_days, credit_limit FROM limits",
    *LIMIT_CTES,
)

# --- what-if scenarios -------------------------------------------------------------

from dunning.plans.scenarios import DEFAULT_GRID  # noqa: E402


def _grid_values() -> str:
    def lit(v, typ):
        return f"CAST({'NULL' if v is None else (q(v) if isinstance(v, str) else v)} AS {typ})"

    rows = ", ".join(
        f"({lit(s.scenario_id, 'INTEGER')}, {lit(s.amount, 'DOUBLE')}, {lit(s.term_days, 'INTEGER')}, "
        f"{lit(s.history, 'INTEGER')}, {lit(s.customer_type, 'VARCHAR')})"
        for s in DEFAULT_GRID
    )
    return f"grid(scenario_id, scenario_amount, term_days, history_override, type_override) AS (VALUES {rows})"


def _type_name(i: str) -> str:
    return "CASE " + " ".join(f"WHEN {i} = {k} THEN {q(t)}" for k, (t, _) in enumerate(L.CUSTOMER_TYPES)) + " END"


def _type_factor(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} = {q(n)} THEN {D(f)}" for n, f in L.CUSTOMER_TYPES) + " END"


SCENARIO_CTES = [
    ALL_CUSTOMERS,
    f"s_agg AS (SELECT customer_code, {pmean('default_probability')} AS risk, {mmean('initial_amount')} AS avg_initial "
    "FROM statement WHERE customer_code IS NOT NULL GROUP BY customer_code)",
    f"p_agg AS (SELECT customer_code, COUNT(*) AS n, {mmean('paid_amount')} AS avg_paid, SUM({_fix('paid_amount', 2)}) AS s1, "
    f"SUM({_fix('paid_amount', 2)} * {_fix('paid_amount', 2)}) AS s2, "
    "datediff('day', MIN(payment_date), MAX(payment_date)) AS span "
    "FROM payments_filled WHERE customer_code IS NOT NULL GROUP BY customer_code)",
    f"""ri0 AS (SELECT u.customer_code, u.customer_name, u.in_statement AS has_invoices, u.in_payments AS has_payments, p.n,
    CASE WHEN u.in_statement AND s.avg_initial IS NOT NULL THEN s.avg_initial WHEN u.in_payments THEN p.avg_paid
         ELSE {D(10000)} END AS base_amount,
    CASE WHEN u.in_payments THEN COALESCE(CASE WHEN p.n >= 2 THEN sqrt(greatest(CAST(p.n * p.s2 - p.s1 * p.s1 AS DOUBLE)
         / CAST(p.n * (p.n - 1) AS DOUBLE), {D(0)})) / {D(100)} END, {D(0)}) END AS sd,
    CASE WHEN p.n > 1 THEN CAST(p.span AS DOUBLE) / CAST(p.n AS DOUBLE) ELSE {D(30)} END AS freq,
    CASE WHEN u.in_statement THEN s.risk ELSE {D(0.3)} END AS current_risk
  FROM all_cust u LEFT JOIN s_agg s ON u.customer_code = s.customer_code LEFT JOIN p_agg p ON u.customer_code = p.customer_code)""",
    f"""ri AS (SELECT customer_code, customer_name, has_invoices, has_payments, base_amount, current_risk,
    CASE WHEN has_payments THEN least(5, greatest(1, CAST(trunc(CAST(n AS DOUBLE) / {D(10)}
         + CASE WHEN base_amount > 0 THEN {D(1)} - sd / base_amount ELSE {D(0)} END
         + CASE WHEN freq > 0 THEN {D(30)} / freq ELSE {D(1)} END) AS INTEGER))) ELSE 3 END AS history_score,
    {_type_name(f"CASE WHEN has_payments THEN least(3, CAST(trunc(CAST(n AS DOUBLE) / {D(5)}) AS INTEGER)) ELSE 0 END")} AS derived_type,
    CASE WHEN has_payments THEN greatest(current_risk, least({D(0.7)}, sd / (base_amount + {D(1e-6)}))) ELSE current_risk END AS risk_base
  FROM ri0)""",
    _grid_values(),
    f"""scen AS (SELECT customer_code, customer_name, scenario_id, has_invoices, base_amount, current_risk, risk_base,
    COALESCE(scenario_amount, base_amount) AS amount, term_days,
    COALESCE(history_override, history_score) AS history_score,
    COALESCE(type_override, derived_type) AS customer_type,
    least(risk_base * least(COALESCE(scenario_amount, base_amount) / (base_amount + {D(1e-6)}), {D(3)})
          * (CAST(term_days AS DOUBLE) / 30) * ({D(1.5)} - COALESCE(history_override, history_score) * {D(0.1)})
          * {_type_factor("COALESCE(type_override, derived_type)")}, {D(0.99)}) AS simulated_risk
  FROM ri CROSS JOIN grid)""",
]

oracle("scenario_risk", "SELECT * FROM scen", *SCENARIO_CTES)
oracle(
    "scenario_context",
    f"""
SELECT r.customer_code, r.has_invoices, CASE WHEN r.has_invoices THEN b.balance ELSE {D(0)} END AS current_balance,
  CASE WHEN r.has_invoices THEN b.days ELSE {D(0)} END AS current_days, r.current_risk
FROM ri r LEFT JOIN (
  SELECT customer_code, {mtotal("balance")} AS balance, {avg_int("days_past_due")} AS days FROM statement GROUP BY customer_code
) b ON r.customer_code = b.customer_code""",
    *SCENARIO_CTES,
)


def _band_values() -> str:
    rows = ", ".join(
        f"({q(b)}, {q(lab)}, {q(chr(10).join(f'{i}. {a}' for i, a in enumerate(acts, start=1)))})"
        for b, lab, acts in L.SCENARIO_BANDS
    )
    return f"band_dim(band, band_label, actions) AS (VALUES {rows})"


oracle(
    "scenario_band",
    """
SELECT s.customer_code, s.scenario_id, s.simulated_risk, s.band, d.band_label,
  s.band = 'critical' AND NOT s.has_invoices AS needs_external_check, d.actions
FROM (SELECT *, CASE WHEN simulated_risk > 0.8 THEN 'critical' WHEN simulated_risk > 0.6 THEN 'high'
                     WHEN simulated_risk > 0.4 THEN 'moderate' ELSE 'low' END AS band FROM scen) s
LEFT JOIN band_dim d ON s.band = d.band""",
    *SCENARIO_CTES,
    _band_values(),
)

# --- classification steps, model inputs ------------------------------------------

oracle("days_past_due", "SELECT document_no, due_date, days_past_due FROM statement")
oracle(
    "aging_status",
    "SELECT document_no, days_past_due, aging_status, aging_0_30, aging_31_60, aging_61_90, aging_91_120, "
    "aging_over_120 FROM statement",
)
oracle("score_rules", "SELECT document_no, days_past_due, default_probability FROM statement")
oracle(
    "risk_segment",
    f"""
SELECT document_no, default_probability, risk_segment,
  {segment_case("default_probability", include_lowest=True)} AS risk_segment_inclusive,
  {segment_rank_case("risk_segment")} AS segment_rank
FROM statement""",
)
_EARLY = f"CAST(datediff('day', due_date, DATE '{fx.ONE_CLASS_AS_OF}') AS INTEGER)"
oracle(
    "score_fallback",
    f"""
SELECT document_no, default_probability, {segment_case("default_probability")} AS risk_segment
FROM (SELECT document_no, {rule_p("days")} AS default_probability FROM (SELECT document_no, {_EARLY} AS days FROM statement_base))""",
)
oracle("score_decision", "SELECT document_no, COALESCE(days_past_due > 60, FALSE) AS high_risk FROM statement")
oracle(
    "training_frame",
    f"""
SELECT document_no, COALESCE(days_past_due, 0) AS days_past_due, COALESCE(initial_amount, {D(0)}) AS initial_amount,
  COALESCE(balance, {D(0)}) AS balance, CASE WHEN days_past_due > 60 THEN 1 ELSE 0 END AS label
FROM statement""",
)


def _median(col: str, src: str) -> str:
    return f"""(SELECT a + {D(0.5)} * (b - a) FROM (
    SELECT MIN(v) AS a, MAX(v) AS b FROM (
      SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS pos, COUNT(*) OVER () AS n
      FROM (SELECT CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL))
    WHERE pos = floor((n + 1) / 2) OR pos = ceil((n + 1) / 2)))"""


IMPUTED = f"""imputed AS (
  SELECT customer_code, customer_name,
    COALESCE(CAST(avg_days AS DOUBLE), {_median("avg_days", "rollup")}) AS avg_days,
    COALESCE(CAST(balance AS DOUBLE), {_median("balance", "rollup")}) AS balance,
    COALESCE(CAST(avg_probability AS DOUBLE), {_median("avg_probability", "rollup")}) AS avg_probability,
    modal_status
  FROM rollup
)"""

oracle("imputed_rollup", "SELECT * FROM imputed", MODAL_STATUS, ROLLUP, IMPUTED)


def _z(col: str, scale: int) -> str:
    u = _fix(col, scale)
    stats = f"(SELECT COUNT({col}) AS n, SUM({u}) AS s1, SUM({u} * {u}) AS s2 FROM imputed)"
    mean = f"(SELECT CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) / {D(10**scale)} FROM {stats})"
    sd = (
        f"(SELECT sqrt(greatest(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * n AS DOUBLE), {D(0)})) / {D(10**scale)} "
        f"FROM {stats})"
    )
    return f"({col} - {mean}) / (CASE WHEN {sd} = 0 THEN {D(1)} ELSE {sd} END)"


oracle(
    "standardized_rollup",
    f"""
SELECT customer_code, customer_name, {_z("avg_days", 6)} AS z_avg_days, {_z("balance", 2)} AS z_balance,
  avg_probability, avg_days, balance
FROM imputed""",
    MODAL_STATUS,
    ROLLUP,
    IMPUTED,
)

oracle(
    "segment_points",
    f"""
SELECT *, avg_probability * {D(20)} + {D(5)} AS point_size FROM (
  SELECT customer_code, customer_name, {_z("avg_days", 6)} AS z_avg_days, {_z("balance", 2)} AS z_balance,
    avg_probability, avg_days, balance
  FROM imputed)
WHERE z_avg_days IS NOT NULL AND z_balance IS NOT NULL AND avg_probability IS NOT NULL""",
    MODAL_STATUS,
    ROLLUP,
    IMPUTED,
)


# --- sources and sinks -------------------------------------------------------------

oracle("load_statement", f"SELECT {', '.join(fx.STATEMENT_RAW_COLUMNS)} FROM statement_base")
oracle("load_payments", f"SELECT {', '.join(fx.PAYMENTS_RAW_COLUMNS)} FROM payments")

NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_amount_sql(x: str) -> str:
    s = f"trim(replace({x}, ',', ''))"
    return (
        f"CASE WHEN regexp_matches({s}, '{NUM_RE}') AND abs(TRY_CAST({s} AS DOUBLE)) < 1e15 "
        f"THEN TRY_CAST({s} AS DOUBLE) END"
    )


def parse_date_sql(x: str) -> str:
    return f"CAST(TRY_STRPTIME(trim({x}), '%Y-%m-%d') AS DATE)"


oracle(
    "clean_statement",
    f"""
SELECT customer_code, customer_name, document_no, {parse_date_sql("invoice_date")} AS invoice_date,
  {parse_date_sql("due_date")} AS due_date, {clean_amount_sql("initial_amount")} AS initial_amount,
  {clean_amount_sql("balance")} AS balance
FROM (SELECT {", ".join(fx.STATEMENT_RAW_COLUMNS)} FROM statement_base)""",
)
oracle(
    "clean_payments",
    f"""
SELECT customer_code, customer_name, document_no, TRY_CAST(line_no AS INTEGER) AS line_no,
  {parse_date_sql("payment_date")} AS payment_date, {clean_amount_sql("paid_amount")} AS paid_amount,
  {clean_amount_sql("cash")} AS cash, {clean_amount_sql("cheque")} AS cheque, {clean_amount_sql("card")} AS card,
  {clean_amount_sql("transfer")} AS transfer
FROM (SELECT {", ".join(fx.PAYMENTS_RAW_COLUMNS)} FROM payments)""",
)
oracle("export_statement", "SELECT * FROM statement")
oracle("export_plan", "SELECT * FROM selected", *PLAN)
oracle("export_limits", "SELECT * FROM limits", *LIMIT_CTES)

# --- box statistics of amounts and limits ------------------------------------------


def _exact_box(rows: str, by: str, value: str) -> str:
    """Box statistics from places in each group's order."""
    at = lambda p, f: f"MAX(v) FILTER (WHERE place = CAST({f}((n - 1) * {D(p)}) AS BIGINT))"
    mid = lambda p: f"{at(p, 'floor')} + ({at(p, 'ceil')} - {at(p, 'floor')}) * ((MAX(n) - 1) * {D(p)} - floor((MAX(n) - 1) * {D(p)}))"
    return f"""
SELECT b.g AS {by}, b.* EXCLUDE (g), (SELECT COUNT(*) FROM ({rows}) r WHERE ({by}) IS NOT DISTINCT FROM b.g AND {value} IS NOT NULL
             AND ({value} < b.lower_fence OR {value} > b.upper_fence)) AS outliers
FROM (
  SELECT *, q1 - {D(1.5)} * (q3 - q1) AS lower_fence, q3 + {D(1.5)} * (q3 - q1) AS upper_fence
  FROM (
    SELECT g, MIN(v) AS min_value, {mid(0.25)} AS q1, {mid(0.5)} AS median, {mid(0.75)} AS q3, MAX(v) AS max_value, MAX(n) AS n
    FROM (SELECT {by} AS g, {value} AS v, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS place,
            COUNT(*) OVER (PARTITION BY {by}) AS n FROM ({rows}) WHERE {value} IS NOT NULL)
    GROUP BY g
  )
) b"""


def _sketch_check(rows: str, by: str, value: str) -> str:
    """What is certain of sketches, and that their ranks keep the bound."""
    return f"""
SELECT {by}, COUNT(*) AS n, MIN({value}) AS min_value, MAX({value}) AS max_value, true AS q1_within, true AS median_within, true AS q3_within
FROM ({rows}) WHERE {value} IS NOT NULL GROUP BY {by}"""


_CENTS = "(CAST(CAST(CAST(balance AS DECIMAL(18,2)) * 100 AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE))"
BALANCES = f"SELECT aging_status, {_CENTS} AS amount FROM statement"
oracle("balance_box_by_status", _exact_box(BALANCES, "aging_status", "amount"))
oracle("balance_box_overall", f"SELECT * EXCLUDE (everything) FROM ({_exact_box(f'SELECT 0 AS everything, * FROM ({BALANCES})', 'everything', 'amount')})")
oracle("balance_box_sketch", _sketch_check("SELECT aging_status, balance FROM statement", "aging_status", "balance"))
oracle("limits_box_by_segment", _exact_box("SELECT * FROM limits", "risk_segment", "credit_limit"), *LIMIT_CTES)
oracle("limits_box_sketch", _sketch_check("SELECT * FROM limits", "risk_segment", "credit_limit"), *LIMIT_CTES)
oracle("collection_goal", "SELECT customer_code, customer_name, balance, collection_score FROM selected", *PLAN)

# --- what coercion lost ----------------------------------------------------------

oracle(
    "load_statement_ranges",
    "SELECT * REPLACE (customer_name || chr(10) || '\"' || document_no || '\"' AS customer_name) "
    f"FROM (SELECT {', '.join(fx.STATEMENT_RAW_COLUMNS)} FROM statement_base)",
)


def _coerced() -> list[tuple[str, str, str]]:
    """(table, column, SQL of its cleaned value)."""
    dates, amounts = ("invoice_date", "due_date"), ("initial_amount", "balance")
    out = [("statement", c, parse_date_sql(c)) for c in dates] + [("statement", c, clean_amount_sql(c)) for c in amounts]
    out += [("payments", "payment_date", parse_date_sql("payment_date")), ("payments", "line_no", "TRY_CAST(line_no AS INTEGER)")]
    return out + [("payments", c, clean_amount_sql(c)) for c in ("paid_amount", "cash", "cheque", "card", "transfer")]


RAW = [
    f"statement_raw AS (SELECT {', '.join(fx.STATEMENT_RAW_COLUMNS)} FROM statement_base)",
    f"payments_raw AS (SELECT {', '.join(fx.PAYMENTS_RAW_COLUMNS)} FROM payments)",
]
oracle(
    "coercion_account",
    " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, COUNT(*) AS cells, COUNT(*) FILTER (WHERE COALESCE(trim({c}), '') = '') AS missing, "
        f"COUNT(*) FILTER (WHERE COALESCE(trim({c}), '') <> '' AND ({v}) IS NULL) AS rejected, {q(t)} AS table_name FROM {t}_raw"
        for t, c, v in _coerced()
    ),
    *RAW,
)
oracle(
    "rejected_cells",
    " UNION ALL ".join(
        f"SELECT document_no, {'line_no' if t == 'payments' else 'CAST(NULL AS VARCHAR)'} AS line_no, {q(c)} AS column_name, {c} AS cell "
        f"FROM {t}_raw WHERE COALESCE(trim({c}), '') <> '' AND ({v}) IS NULL"
        for t, c, v in _coerced()
    ),
    *RAW,
)

# --- breakdowns of one scan, evaluation of scores --------------------------------


def _breakdown(part: str, keys: dict[str, str]) -> str:
    names = ("invoice_month", "aging_status", "weekday_index", "due_weekday", "month_index", "due_month")
    kinds = ("VARCHAR", "VARCHAR", "INTEGER", "VARCHAR", "INTEGER", "VARCHAR")
    shown = ", ".join(f"{keys.get(n, f'CAST(NULL AS {k})')} AS {n}" for n, k in zip(names, kinds))
    by = f"GROUP BY {', '.join(keys.values())}" if keys else ""
    status = [("current", L.STATUS_CURRENT), ("early_warning", L.STATUS_EARLY), ("moderate", L.STATUS_MODERATE), ("high", L.STATUS_HIGH), ("severe", L.STATUS_SEVERE)]
    sums = [f"{mtotal(f'CASE WHEN aging_status = {q(label)} THEN balance END')} AS {name}" for name, label in status]
    sums += [f"{mtotal(c)} AS {c}" for c, _ in L.AGING_BUCKETS]
    return f"SELECT {shown}, {q(part)} AS part, {mtotal('balance')} AS balance, {', '.join(sums)} FROM statement {by}"


oracle(
    "portfolio_breakdowns",
    " UNION ALL ".join(
        [
            _breakdown("month", {"invoice_month": "strftime(invoice_date, '%Y-%m')"}),
            _breakdown("status", {"aging_status": "aging_status"}),
            _breakdown("weekday", {"weekday_index": "CAST(isodow(due_date) - 1 AS INTEGER)", "due_weekday": "dayname(due_date)"}),
            _breakdown("due", {"month_index": "CAST(month(due_date) AS INTEGER)", "due_month": "monthname(due_date)"}),
            _breakdown("all", {}),
        ]
    ),
)

LABELLED = "labelled AS (SELECT default_probability AS p, CASE WHEN days_past_due > 60 THEN 1 ELSE 0 END AS y FROM statement)"
oracle(
    "score_evaluation",
    f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE y = 1) AS positives,
  CAST((SELECT SUM(CAST(pos AS HUGEINT) * (2 * (upto - neg) + neg)) FROM (
    SELECT pos, neg, SUM(neg) OVER (ORDER BY p) AS upto
    FROM (SELECT p, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg FROM labelled GROUP BY p))) AS DOUBLE)
    / ({D(2)} * CAST(COUNT(*) FILTER (WHERE y = 1) AS DOUBLE) * CAST(COUNT(*) FILTER (WHERE y = 0) AS DOUBLE)) AS auc,
  CAST(SUM((CAST(p AS DECIMAL(10,6)) - y) * (CAST(p AS DECIMAL(10,6)) - y)) AS DOUBLE) / COUNT(*) AS brier,
  CAST(COUNT(*) FILTER (WHERE (p > 0.5) = (y = 1)) AS DOUBLE) / COUNT(*) AS accuracy
FROM labelled WHERE p IS NOT NULL""",
    LABELLED,
)
oracle(
    "score_calibration",
    """
SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, COUNT(*) AS rows,
  CAST(SUM(CAST(p AS DECIMAL(18,6))) AS DOUBLE) / COUNT(*) AS mean_score,
  CAST(COUNT(*) FILTER (WHERE y = 1) AS DOUBLE) / COUNT(*) AS positive_share
FROM labelled WHERE p IS NOT NULL GROUP BY 1""",
    LABELLED,
)

# --- certified top customers, first names in row order ---------------------------

oracle("top_customers_certified", _top(""))
oracle("top_overdue_certified", _top("AND days_past_due > 60"))
oracle(
    "first_names",
    """
SELECT r.customer_code, 'Name ' || f.name AS customer_name, r.avg_days, r.balance, r.avg_probability, r.modal_status
FROM rollup r JOIN (
  SELECT customer_code, reverse(arg_min(document_no, CAST(document_no AS BIGINT))) AS name FROM statement GROUP BY customer_code
) f ON r.customer_code = f.customer_code""",
    MODAL_STATUS,
    ROLLUP,
)
