"""Queries of the receivables reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.names import AGING, BRACKETS
from ledgerlight.operators import clean, features as feat, reporting as rep
from ledgerlight.plans.inputs import AS_OF, aging_rows, enrolled, feature_rows, invoice_rows, ledger
from ledgerlight.plans.ledger_queries import KEYS
from ledgerlight.plans.registry import part, query, staged

LATE = " + ".join(f'"{b}"' for b in AGING[1:])
part(
    "debts",
    """SELECT due_date + 180 AS entry_date, due_date + 180 AS due_date, school_year, student_id_pseudonimized,
  'Bad Debts Expense' AS category_name, -owed AS amount_due, -owed AS receivables
FROM (SELECT school_year, due_date, student_id_pseudonimized, sum(net_receivables) AS owed FROM aging GROUP BY ALL)
WHERE school_year <> (SELECT max(school_year) FROM aging) AND owed > 0""",
)
part(
    "transactions",
    """SELECT * FROM (SELECT entry_date, due_date, school_year, student_id_pseudonimized, category_name, amount_due,
  receivables FROM ledger UNION ALL SELECT * FROM debts)
JOIN (SELECT school_year, student_id_pseudonimized, plan_type FROM enrolled) USING (school_year, student_id_pseudonimized)""",
)


def _debts(spark, sf):
    return rep.bad_debts(aging_rows(spark, sf))


def _transactions(spark, sf):
    return staged(
        spark,
        sf,
        "transactions",
        lambda: clean.all_transactions(ledger(spark, sf), _debts(spark, sf), enrolled(spark, sf)),
    )


@query(
    "bad_debts",
    f"entry_date:d;due_date:d;{KEYS};amount_due:m;receivables:m",
    "SELECT * FROM debts",
)
def _(spark, sf):
    return _debts(spark, sf)


@query(
    "bad_debts_by_year",
    "school_year:i;bad_debts_expense:m",
    "SELECT school_year, sum(amount_due) AS bad_debts_expense FROM debts GROUP BY ALL",
)
def _(spark, sf):
    return rep.bad_debts_by_year(_debts(spark, sf))


part(
    "debts_tenure",
    """SELECT * FROM (SELECT school_year, student_id_pseudonimized, sum(amount_due) AS bad_debts_expense
FROM debts GROUP BY ALL) LEFT JOIN (SELECT school_year, student_id_pseudonimized, consecutive_years FROM tenure)
USING (school_year, student_id_pseudonimized)""",
)


def _debts_tenure(spark, sf):
    tenure = feat.consecutive_years(enrolled(spark, sf))
    return rep.bad_debts_tenure(_debts(spark, sf), tenure)


@query(
    "bad_debts_tenure",
    "school_year:i;student_id_pseudonimized:s;bad_debts_expense:m;consecutive_years:i",
    "SELECT * FROM debts_tenure",
)
def _(spark, sf):
    return _debts_tenure(spark, sf)


@query(
    "mean_tenure",
    "school_year:i;mean_consecutive_years:f",
    """SELECT school_year, avg(consecutive_years) AS mean_consecutive_years FROM debts_tenure
GROUP BY ROLLUP (school_year)""",
)
def _(spark, sf):
    return rep.mean_tenure(_debts_tenure(spark, sf))


@query(
    "all_transactions",
    f"entry_date:d;due_date:d;{KEYS};amount_due:m;receivables:m;plan_type:s",
    "SELECT * FROM transactions",
)
def _(spark, sf):
    return clean.all_transactions(ledger(spark, sf), _debts(spark, sf), enrolled(spark, sf))


@query(
    "month_end_spine",
    "date:d",
    "SELECT DISTINCT last_day(due_date) AS date FROM transactions WHERE due_date IS NOT NULL",
)
def _(spark, sf):
    return rep.month_end_spine(_transactions(spark, sf))


def dso_sql(source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"""WITH m AS (SELECT {comma}last_day(due_date) AS date, sum(receivables) AS r FROM {source} GROUP BY ALL),
c AS (SELECT last_day(due_date) AS date, sum(adjusted_credit_amount) AS s FROM aging GROUP BY ALL),
b AS (SELECT m.*, sum(r) OVER ({over}ORDER BY m.date) AS running_receivable, coalesce(s, 0) AS credit_sale
  FROM m LEFT JOIN c ON m.date = c.date),
d AS (SELECT *, date_diff('day', lag(date) OVER w, date) AS days_interval,
  CAST(running_receivable + lag(running_receivable) OVER w AS DOUBLE) / 2 AS avg_receivable,
  year(date) * 12 + month(date) AS mm FROM b WINDOW w AS ({over}ORDER BY date)),
e AS (SELECT *, avg_receivable / nullif(CAST(credit_sale AS DOUBLE), 0) * days_interval AS dso_component,
  CAST(first(running_receivable) OVER r + last(running_receivable) OVER r AS DOUBLE) / 2
    / nullif(CAST(sum(credit_sale) OVER r AS DOUBLE), 0) * coalesce(sum(days_interval) OVER r, 0) AS rolling_12m_dso
  FROM d WINDOW r AS ({over}ORDER BY mm RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, last_value(rolling_12m_dso IGNORE NULLS) OVER ({over}ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled FROM e)
SELECT *, (filled / nullif(lag(filled) OVER ({over}ORDER BY date), 0) - 1) * 100 AS rolling_12m_dso_pct_change FROM f"""


part("dso", dso_sql("transactions"))
DSO = (
    "date:d;running_receivable:m;credit_sale:m;avg_receivable:f;days_interval:i;dso_component:f;"
    "rolling_12m_dso:f;rolling_12m_dso_pct_change:f"
)


def _dso(spark, sf):
    return rep.days_sales_outstanding(_transactions(spark, sf), aging_rows(spark, sf))


@query("running_receivable", "date:d;running_receivable:m", "SELECT * FROM dso")
def _(spark, sf):
    return rep.running_receivable(_transactions(spark, sf))


@query("monthly_credit_sales", "date:d;credit_sale:m", "SELECT * FROM dso")
def _(spark, sf):
    return rep.monthly_credit_sales(
        rep.month_end_spine(_transactions(spark, sf)), aging_rows(spark, sf)
    )


@query("dso_component", "date:d;avg_receivable:f;days_interval:i;dso_component:f", "SELECT * FROM dso")
def _(spark, sf):
    balances = rep.running_receivable(_transactions(spark, sf))
    return rep.dso_component(rep.monthly_credit_sales(balances, aging_rows(spark, sf)))


@query("dso_rolling_12m", "date:d;rolling_12m_dso:f", "SELECT * FROM dso")
def _(spark, sf):
    return _dso(spark, sf)


@query("dso_pct_change", DSO, "SELECT * FROM dso")
def _(spark, sf):
    return _dso(spark, sf)


@query(
    "dso_june_snapshot",
    "year:i;school_year:i;rolling_12m_dso:f",
    "SELECT year(date) AS year, year(date) - 1 AS school_year, rolling_12m_dso FROM dso WHERE month(date) = 6",
)
def _(spark, sf):
    return rep.dso_june_snapshot(_dso(spark, sf))


GRID = ";".join(f"{m}:f" for m in range(1, 13))


def _grid_sql(value: str) -> str:
    cells = ", ".join(f'avg(CASE WHEN month = {m} THEN v END) AS "{m}"' for m in range(1, 13))
    return f"SELECT year, {cells} FROM (SELECT year, month, {value} AS v FROM dso_months) GROUP BY year"


part(
    "dso_months",
    "SELECT *, year(date) AS year, month(date) AS month FROM dso WHERE year(date) BETWEEN 1996 AND 2001",
)


@query(
    "dso_year_relative",
    f"year:i;{GRID}",
    _grid_sql("rolling_12m_dso / nullif(avg(rolling_12m_dso) OVER (PARTITION BY year), 0) * 100"),
)
def _(spark, sf):
    return rep.dso_year_relative(_dso(spark, sf), 1996, 2001)


@query("dso_change_grid", f"year:i;{GRID}", _grid_sql("rolling_12m_dso_pct_change"))
def _(spark, sf):
    return rep.dso_change_grid(_dso(spark, sf), 1996, 2001)


@query(
    "dso_latest_in_year",
    "year:i;date:d;rolling_12m_dso:f",
    "SELECT year(date) AS year, max(date) AS date, arg_max(rolling_12m_dso, date) AS rolling_12m_dso FROM dso GROUP BY ALL",
)
def _(spark, sf):
    return rep.dso_latest_in_year(_dso(spark, sf))


part(
    "plan_lines",
    """SELECT *, 'Plan ' || right(plan_type, 1) AS source FROM transactions
WHERE plan_type IN ('Plan - A', 'Plan - B', 'Plan - C')""",
)


@query("dso_by_plan", f"source:s;{DSO}", dso_sql("plan_lines", "source"))
def _(spark, sf):
    return rep.dso_by_plan(_transactions(spark, sf), aging_rows(spark, sf))


part("dso_students", dso_sql("ledger", "student_id_pseudonimized"))


@query(
    "negative_balance_students",
    f"student_id_pseudonimized:s;{DSO}",
    "SELECT * FROM dso_students WHERE running_receivable < 0",
)
def _(spark, sf):
    return rep.negative_balance_students(ledger(spark, sf), aging_rows(spark, sf))


part(
    "statused",
    f"""SELECT *, CASE WHEN net_receivables > 0 THEN 'Not Fully Paid Yet'
  WHEN prepayments > 0 AND {LATE} = 0 THEN 'On Time' ELSE 'Late' END AS payment_status,
  CASE {" ".join(f'WHEN "{b}" > 0 THEN ' + f"'{b}'" for b in reversed(AGING[1:]))} ELSE 'On-Time' END AS worst_bucket
FROM aging""",
)
STATUS = f"{KEYS};due_date:d;net_receivables:m"


@query("payment_status", f"{STATUS};payment_status:s", "SELECT * FROM statused")
def _(spark, sf):
    return rep.payment_status(aging_rows(spark, sf))


@query("worst_aging_bucket", f"{STATUS};worst_bucket:s", "SELECT * FROM statused")
def _(spark, sf):
    return rep.worst_aging_bucket(aging_rows(spark, sf))


@query(
    "status_share",
    "school_year:i;payment_status:s;count:i;percent:f;position:i",
    f"""SELECT *, list_position(['On Time', 'Late', 'Not Fully Paid Yet'], payment_status) AS position FROM (
SELECT school_year, payment_status, count(*) AS count,
  count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY school_year) AS percent
FROM statused WHERE due_date <= DATE '{AS_OF}' GROUP BY school_year, payment_status
UNION ALL
SELECT NULL, payment_status, count(*), count(*) * 100.0 / sum(count(*)) OVER ()
FROM statused WHERE due_date <= DATE '{AS_OF}' GROUP BY payment_status)""",
)
def _(spark, sf):
    rows = rep.payment_status(aging_rows(spark, sf))
    yearly = rep.status_share(rows, "payment_status", AS_OF, ["school_year"])
    overall = rep.status_share(rows, "payment_status", AS_OF)
    return yearly.unionByName(overall, allowMissingColumns=True)


YEARS = range(1, 8)


@query(
    "enrollment_statistics",
    "mode:s;school_year:i;total_enrolled:i;new:f;" + ";".join(f"y{n}:f" for n in YEARS),
    """WITH k AS (SELECT * FROM tenure WHERE has_refunded <> 'Has Refund'),
c AS (SELECT school_year, count(DISTINCT student_id_pseudonimized) AS total_enrolled,
  count(DISTINCT CASE WHEN school_year = f THEN student_id_pseudonimized END) AS new, {}
  FROM k JOIN (SELECT student_id_pseudonimized, min(school_year) AS f FROM k GROUP BY ALL) USING (student_id_pseudonimized)
  GROUP BY school_year)
SELECT 'count' AS mode, * FROM c
UNION ALL SELECT 'percent', school_year, total_enrolled, new * 100.0 / total_enrolled, {} FROM c""".format(
        ", ".join(
            f"count(DISTINCT CASE WHEN consecutive_years = {n} THEN student_id_pseudonimized END) AS y{n}"
            for n in YEARS
        ),
        ", ".join(f"y{n} * 100.0 / total_enrolled" for n in YEARS),
    ),
)
def _(spark, sf):
    tenure = feat.consecutive_years(enrolled(spark, sf))
    tables = []
    for mode, suffix in (("count", "count"), ("percent", "%")):
        found = rep.enrollment_statistics(tenure, mode == "percent", list(YEARS))
        tables.append(
            found.select(
                F.lit(mode).alias("mode"),
                "school_year",
                "total_enrolled",
                F.col(f"`new_enrollees_{suffix}`").cast("double").alias("new"),
                *[F.col(f"`{n}_year_{suffix}`").cast("double").alias(f"y{n}") for n in YEARS],
            )
        )
    return tables[0].unionByName(tables[1])


CASES = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BRACKETS))


@query(
    "overdue_kpis",
    "invoices:i;" + ";".join(f"n_{b}:i" for b in BRACKETS) + ";accuracy:f",
    "SELECT count(*) AS invoices, {}, count(*) FILTER (WHERE dtp_bracket = p) * 1.0 / count(dtp_bracket) AS accuracy "
    "FROM (SELECT *, CASE coalesce(prev_bracket, 0) {} END AS p FROM features)".format(
        ", ".join(f"count(*) FILTER (WHERE dtp_bracket = '{b}') AS \"n_{b}\"" for b in BRACKETS), CASES
    ),
)
def _(spark, sf):
    guess = F.element_at(
        F.array(*[F.lit(b) for b in BRACKETS]), F.coalesce("prev_bracket", F.lit(0)) + 1
    )
    return rep.overdue_kpis(feature_rows(spark, sf).withColumn("predicted", guess))


@query(
    "late_invoice_list",
    "student_id_pseudonimized:s;grade_level:s;amount:m;due_date:d;predicted_delay:f",
    """SELECT f.student_id_pseudonimized, grade_level, net_receivables AS amount, due_date, dtp_avg AS predicted_delay
FROM features f LEFT JOIN (SELECT school_year, student_id_pseudonimized, min(grade_level) AS grade_level FROM enrolled
  GROUP BY ALL) e ON e.school_year = f.school_year AND e.student_id_pseudonimized = f.student_id_pseudonimized
WHERE date_fully_paid IS NULL AND dtp_avg > 0""",
)
def _(spark, sf):
    return rep.late_invoice_list(feature_rows(spark, sf), enrolled(spark, sf), "dtp_avg")
