"""Queries of the payment-history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.names import LAGS, PLANS, STUDENT, YEAR
from ledgerlight.operators import features as feat, invoices as inv
from ledgerlight.plans.inputs import (
    OBSERVATION_END,
    buckets,
    enrolled,
    feature_rows,
    invoice_rows,
    ledger,
)
from ledgerlight.plans.ledger_queries import AMOUNTS, INVOICE, KEYS, MONEY
from ledgerlight.plans.registry import part, query

BASE = f"{KEYS};due_date:d;credit_sale_amount:m"
LATE = "days_elapsed_until_fully_paid:i"
LAG = ";".join(f"{c}:i" for c in LAGS)
PLAN_COLUMNS = ";".join(f"plan_type_{p}:i" for p in [*PLANS, "nan"])
ORDER = (
    "PARTITION BY student_id_pseudonimized ORDER BY due_date, school_year, category_name, "
    "credit_sale_amount, gross_receivables, date_fully_paid"
)

part(
    "lagged",
    f"""SELECT *, CASE dtp_bracket WHEN 'on_time' THEN 0 WHEN '30_days' THEN 1 WHEN '60_days' THEN 2
    WHEN '90_days' THEN 3 END AS code,
  {", ".join(f"lag(days_elapsed_until_fully_paid, {k}) OVER h AS dtp_{k}" for k in range(1, 5))},
  lag(due_date, 1) OVER h AS due_date_prev_1, lag(due_date, 2) OVER h AS due_date_prev_2
FROM (SELECT *, CASE WHEN days_elapsed_until_fully_paid <= 0 THEN 'on_time'
    WHEN days_elapsed_until_fully_paid <= 30 THEN '30_days' WHEN days_elapsed_until_fully_paid <= 60 THEN '60_days'
    WHEN days_elapsed_until_fully_paid > 60 THEN '90_days' END AS dtp_bracket
  FROM (SELECT *, date_diff('day', due_date, date_fully_paid) AS days_elapsed_until_fully_paid FROM invoices))
WINDOW h AS ({ORDER})""",
)
part(
    "averaged",
    """SELECT *, list_avg([dtp_1, dtp_2, dtp_3, dtp_4]) AS dtp_avg,
  0.4::DOUBLE * coalesce(dtp_1, 0) + 0.3::DOUBLE * coalesce(dtp_2, 0) + 0.2::DOUBLE * coalesce(dtp_3, 0)
    + 0.1::DOUBLE * coalesce(dtp_4, 0) AS dtp_wavg,
  coalesce((dtp_2 - dtp_1) / nullif(date_diff('day', due_date_prev_1, due_date), 0), 0) AS dtp_2_trend,
  coalesce((dtp_3 - dtp_1) / nullif(date_diff('day', due_date_prev_2, due_date), 0), 0) AS dtp_3_trend,
  list_stddev_samp([dtp_1, dtp_2, dtp_3, dtp_4]) AS dtp_rolling_std,
  greatest(dtp_1, dtp_2, dtp_3, dtp_4) AS dtp_max
FROM lagged""",
)
part(
    "last_pay",
    """SELECT i.student_id_pseudonimized, i.due_date, max(p.entry_date) AS last_payment_date
FROM invoices i JOIN ledger p ON p.student_id_pseudonimized = i.student_id_pseudonimized
  AND p.amount_paid <> 0 AND p.category_name <> i.category_name AND p.entry_date < i.due_date GROUP BY ALL""",
)
for amount, date in (("amount_due", "due_date"), ("amount_paid", "entry_date")):
    part(
        f"{amount}_top",
        f"""SELECT i.student_id_pseudonimized, i.due_date, max(r.run) AS {amount}_cumsum
FROM (SELECT DISTINCT student_id_pseudonimized, due_date FROM invoices) i
JOIN (SELECT student_id_pseudonimized, {date} AS day, sum({amount}) OVER (PARTITION BY student_id_pseudonimized
    ORDER BY {date}, category_name, amount_due, amount_paid, entry_number ROWS UNBOUNDED PRECEDING) AS run
  FROM ledger) r ON r.student_id_pseudonimized = i.student_id_pseudonimized AND r.day <= i.due_date GROUP BY ALL""",
    )
part(
    "dated",
    """SELECT a.*, last_payment_date,
  coalesce(date_diff('day', last_payment_date, due_date), -1) AS days_since_last_payment,
  amount_due_cumsum, amount_paid_cumsum,
  CASE WHEN amount_due_cumsum IS NOT NULL AND amount_paid_cumsum IS NOT NULL
    THEN greatest(amount_due_cumsum - amount_paid_cumsum, 0) END AS opening_balance
FROM averaged a LEFT JOIN last_pay USING (student_id_pseudonimized, due_date)
LEFT JOIN amount_due_top USING (student_id_pseudonimized, due_date)
LEFT JOIN amount_paid_top USING (student_id_pseudonimized, due_date)""",
)
part(
    "streaked",
    f"""SELECT *, coalesce(lag(run) OVER h, 0) AS on_time_streak, lag(code) OVER h AS prev_bracket
FROM (SELECT *, sum(CASE WHEN dtp_bracket = 'on_time' THEN 1 ELSE 0 END) OVER (PARTITION BY brk, {ORDER[13:]}
    ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, sum(CASE WHEN dtp_bracket = 'on_time' THEN 0 ELSE 1 END) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS brk
    FROM dated)) WINDOW h AS ({ORDER})""",
)
part(
    "planned",
    """SELECT s.*, plan_type, {} , CASE WHEN plan_type IS NULL THEN 1 ELSE 0 END AS plan_type_nan
FROM streaked s LEFT JOIN (SELECT school_year, student_id_pseudonimized, plan_type FROM enrolled)
  USING (school_year, student_id_pseudonimized)""".format(
        ", ".join(
            f"CASE WHEN plan_type = '{p}' THEN 1 ELSE 0 END AS \"plan_type_{p}\"" for p in PLANS
        )
    ),
)
part(
    "flagged",
    """SELECT *, CASE WHEN date_fully_paid <= (SELECT max(due_date) FROM planned) THEN 1 ELSE 0 END AS censor
FROM planned""",
)
part(
    "censored",
    f"""SELECT * REPLACE (coalesce(CASE WHEN censor = 0 THEN date_diff('day', due_date, DATE '{OBSERVATION_END}')
  ELSE days_elapsed_until_fully_paid END, 0) AS days_elapsed_until_fully_paid)
FROM flagged WHERE due_date <= DATE '{OBSERVATION_END}' OR date_fully_paid IS NOT NULL""",
)
part(
    "plan_rates",
    """SELECT CASE WHEN plan_type IN ('Plan - A', 'Plan - B', 'Plan - C', 'Plan - D', 'Plan - E')
    THEN plan_type ELSE 'nan' END AS plan, avg(CASE WHEN dtp_bracket = '90_days' THEN 1.0 ELSE 0.0 END) AS rate
FROM censored WHERE dtp_bracket IS NOT NULL GROUP BY ALL""",
)
part(
    "plan_scores",
    """SELECT plan, rate, CASE WHEN n >= 5 THEN (SELECT count(*) FROM (SELECT DISTINCT unnest(e) AS x)
    WHERE x < rate AND x > list_min(e))
  ELSE dense_rank() OVER (ORDER BY rate) - 1 END AS score
FROM plan_rates, (SELECT count(*) AS n, quantile_cont(rate, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM plan_rates)""",
)
part(
    "features",
    """SELECT c.*, month(due_date) AS due_month, quarter(due_date) AS due_quarter,
  CASE WHEN opening_balance > 0 THEN 1 ELSE 0 END AS opening_balance_flag,
  CAST(amount_paid_cumsum AS DOUBLE) / nullif(CAST(amount_due_cumsum AS DOUBLE), 0) AS payment_ratio,
  CASE WHEN dtp_1 < 0 THEN 1 WHEN dtp_1 >= 0 THEN 0 END AS early_payer_flag,
  coalesce(score, 2) AS plan_type_risk_score
FROM censored c LEFT JOIN plan_scores ON plan = CASE WHEN plan_type IN
  ('Plan - A', 'Plan - B', 'Plan - C', 'Plan - D', 'Plan - E') THEN plan_type ELSE 'nan' END""",
)


@query("dtp_lags", f"{BASE};{LATE};{LAG}", "SELECT * FROM lagged")
def _(spark, sf):
    return feat.dtp_lags(invoice_rows(spark, sf))


@query("dtp_avg_wavg", f"{BASE};{LAG};dtp_avg:f;dtp_wavg:f", "SELECT * FROM averaged")
def _(spark, sf):
    return feat.dtp_avg_wavg(feat.dtp_lags(invoice_rows(spark, sf)))


@query(
    "due_date_prev", f"{BASE};due_date_prev_1:d;due_date_prev_2:d", "SELECT * FROM lagged"
)
def _(spark, sf):
    return feat.due_date_prev(invoice_rows(spark, sf))


def _history(spark, sf):
    past = {f"dtp_{k}": (feat.DAYS_LATE, k) for k in range(1, 5)}
    past |= {f"due_date_prev_{k}": ("due_date", k) for k in (1, 2)}
    rows = feat.dtp_bracket(feat.days_late(invoice_rows(spark, sf)))
    return feat.payment_history(rows, past, 4)


@query("dtp_trend", f"{BASE};dtp_2_trend:f;dtp_3_trend:f", "SELECT * FROM averaged")
def _(spark, sf):
    return feat.dtp_trend(_history(spark, sf))


@query(
    "last_payment_date", f"{BASE};last_payment_date:d;days_since_last_payment:i", "SELECT * FROM dated"
)
def _(spark, sf):
    return feat.last_payment_date(
        invoice_rows(spark, sf), inv.payments_to_all(ledger(spark, sf))
    )


@query("amount_due_cumsum", f"{BASE};amount_due_cumsum:m", "SELECT * FROM dated")
def _(spark, sf):
    return feat.amount_due_cumsum(invoice_rows(spark, sf), ledger(spark, sf))


@query("amount_paid_cumsum", f"{BASE};amount_paid_cumsum:m", "SELECT * FROM dated")
def _(spark, sf):
    return feat.amount_paid_cumsum(invoice_rows(spark, sf), ledger(spark, sf))


def _balances(spark, sf):
    base = ledger(spark, sf)
    due = feat.amount_due_cumsum(invoice_rows(spark, sf), base)
    return feat.opening_balance(feat.amount_paid_cumsum(due, base))


@query("opening_balance", f"{BASE};opening_balance:m", "SELECT * FROM dated")
def _(spark, sf):
    return _balances(spark, sf)


@query("plan_join", f"{BASE};plan_type:s", "SELECT * FROM planned")
def _(spark, sf):
    return feat.plan_join(invoice_rows(spark, sf), enrolled(spark, sf))


@query("plan_one_hot", f"{BASE};{PLAN_COLUMNS}", "SELECT * FROM planned")
def _(spark, sf):
    return feat.plan_one_hot(feat.plan_join(invoice_rows(spark, sf), enrolled(spark, sf)))


@query("dtp_bracket", f"{BASE};{LATE};dtp_bracket:s", "SELECT * FROM lagged")
def _(spark, sf):
    return feat.dtp_bracket(feat.days_late(invoice_rows(spark, sf)))


@query(
    "event_flag",
    f"{BASE};censor:i",
    """SELECT *, CASE WHEN date_fully_paid <= (SELECT max(due_date) FROM invoices) THEN 1 ELSE 0 END AS censor
FROM invoices""",
)
def _(spark, sf):
    return feat.event_flag(invoice_rows(spark, sf))


@query("censored_duration", f"{BASE};{LATE};censor:i;plan_type:s", "SELECT * FROM censored")
def _(spark, sf):
    rows = feat.plan_join(feat.days_late(invoice_rows(spark, sf)), enrolled(spark, sf))
    return feat.censored_duration(feat.event_flag(rows), OBSERVATION_END)


CLIP = ["dtp_1", "dtp_2", "dtp_3", "dtp_4", "dtp_avg", "dtp_wavg"]


@query(
    "winsorize",
    f"{BASE};{LAG};dtp_avg:f;dtp_wavg:f",
    "SELECT a.* REPLACE ({}) FROM averaged a, (SELECT {} FROM averaged)".format(
        ", ".join(
            (
                f"round_even(CAST(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS DOUBLE), 0) AS {c}"
                if c in LAGS
                else f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}"
            )
            for c in CLIP
        ),
        ", ".join(
            f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi_{c}"
            for c in CLIP
        ),
    ),
)
def _(spark, sf):
    return feat.winsorize(feat.dtp_avg_wavg(feat.dtp_lags(invoice_rows(spark, sf))))


@query(
    "calendar_features",
    f"{BASE};due_month:i;due_quarter:i",
    "SELECT *, month(due_date) AS due_month, quarter(due_date) AS due_quarter FROM invoices",
)
def _(spark, sf):
    return feat.calendar_features(invoice_rows(spark, sf))


@query(
    "payment_behaviour",
    f"{BASE};opening_balance_flag:i;payment_ratio:f;early_payer_flag:i",
    """SELECT *, CASE WHEN opening_balance > 0 THEN 1 ELSE 0 END AS opening_balance_flag,
  CAST(amount_paid_cumsum AS DOUBLE) / nullif(CAST(amount_due_cumsum AS DOUBLE), 0) AS payment_ratio,
  CASE WHEN dtp_1 < 0 THEN 1 WHEN dtp_1 >= 0 THEN 0 END AS early_payer_flag FROM dated""",
)
def _(spark, sf):
    base = ledger(spark, sf)
    rows = feat.amount_due_cumsum(_history(spark, sf), base)
    return feat.payment_behaviour(feat.opening_balance(feat.amount_paid_cumsum(rows, base)))


@query("on_time_streak", f"{BASE};dtp_bracket:s;on_time_streak:i", "SELECT * FROM streaked")
def _(spark, sf):
    return feat.on_time_streak(feat.dtp_bracket(feat.days_late(invoice_rows(spark, sf))))


@query("prev_bracket", f"{BASE};dtp_bracket:s;prev_bracket:i", "SELECT * FROM streaked")
def _(spark, sf):
    return feat.prev_bracket(feat.dtp_bracket(feat.days_late(invoice_rows(spark, sf))))


@query("dtp_summary", f"{BASE};dtp_rolling_std:f;dtp_max:i", "SELECT * FROM averaged")
def _(spark, sf):
    return feat.dtp_summary(feat.dtp_lags(invoice_rows(spark, sf)))


def _planned(spark, sf):
    rows = feat.dtp_bracket(feat.days_late(invoice_rows(spark, sf)))
    rows = feat.plan_one_hot(feat.plan_join(rows, enrolled(spark, sf)))
    return feat.censored_duration(feat.event_flag(rows), OBSERVATION_END)


@query("plan_risk_fit", "plan:s;rate:f;score:i", "SELECT * FROM plan_scores")
def _(spark, sf):
    return feat.plan_risk_fit(_planned(spark, sf))


@query("plan_risk_apply", f"{BASE};plan_type_risk_score:i", "SELECT * FROM features")
def _(spark, sf):
    rows = _planned(spark, sf)
    return feat.plan_risk_apply(rows, feat.plan_risk_fit(rows))


@query(
    "invoice_filters",
    f"{BASE};{LAG}",
    """SELECT * FROM lagged WHERE school_year NOT IN (1995, 1996) AND date_fully_paid IS NULL
  AND dtp_1 IS NOT NULL AND dtp_2 IS NOT NULL AND dtp_3 IS NOT NULL AND dtp_4 IS NOT NULL""",
)
def _(spark, sf):
    return feat.invoice_filters(
        feat.dtp_lags(invoice_rows(spark, sf)), [1995, 1996], True, True, True
    )


KEPT = (
    "due_date:d;credit_sale_amount:m;dtp_bracket:s;dtp_1:i;dtp_avg:f;opening_balance:m;due_month:i;"
    "plan_type_risk_score:i"
)


@query("column_groups", KEPT, "SELECT * FROM features")
def _(spark, sf):
    groups = ["helper", "demographic", "survival", "plan_type"]
    return feat.column_groups(feature_rows(spark, sf), groups)


@query(
    "consecutive_years",
    "school_year:i;student_id_pseudonimized:s;plan_type:s;consecutive_years:i",
    "SELECT * FROM tenure",
)
def _(spark, sf):
    return feat.consecutive_years(enrolled(spark, sf))


part(
    "tenure",
    """WITH k AS (SELECT student_id_pseudonimized, school_year, row_number() OVER w AS pos,
    CASE WHEN school_year - lag(school_year) OVER w = 1 THEN 0 ELSE 1 END AS fresh
  FROM enrolled WHERE has_refunded <> 'Has Refund'
  WINDOW w AS (PARTITION BY student_id_pseudonimized ORDER BY school_year)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY student_id_pseudonimized ORDER BY pos) AS run FROM k),
n AS (SELECT student_id_pseudonimized, school_year,
  row_number() OVER (PARTITION BY student_id_pseudonimized, run ORDER BY pos) AS consecutive_years FROM s)
SELECT e.*, consecutive_years FROM enrolled e LEFT JOIN n USING (student_id_pseudonimized, school_year)""",
)


@query(
    "model_survival_split",
    "part:s;rows:i;labelled:i;late_days:i",
    """SELECT 'model' AS part, count(*) AS rows, count(dtp_bracket) AS labelled, NULL AS late_days
FROM features WHERE censor = 1
UNION ALL SELECT 'survival', count(*), NULL, sum(days_elapsed_until_fully_paid) FROM features""",
)
def _(spark, sf):
    model, survival = feat.model_survival_split(feature_rows(spark, sf))
    one = model.agg(
        F.lit("model").alias("part"),
        F.count("*").alias("rows"),
        F.count("dtp_bracket").alias("labelled"),
        F.lit(None).cast("bigint").alias("late_days"),
    )
    other = survival.agg(
        F.lit("survival").alias("part"),
        F.count("*").alias("rows"),
        F.lit(None).cast("bigint").alias("labelled"),
        F.sum(feat.DAYS_LATE).alias("late_days"),
    )
    return one.unionByName(other)


FEATURES = (
    f"{INVOICE};{AMOUNTS};{LATE};dtp_bracket:s;censor:i;{LAG};dtp_avg:f;dtp_wavg:f;due_date_prev_1:d;"
    "due_date_prev_2:d;dtp_2_trend:f;dtp_3_trend:f;last_payment_date:d;days_since_last_payment:i;"
    "amount_due_cumsum:m;amount_paid_cumsum:m;opening_balance:m;due_month:i;due_quarter:i;"
    "opening_balance_flag:i;payment_ratio:f;early_payer_flag:i;on_time_streak:i;prev_bracket:i;"
    f"dtp_rolling_std:f;dtp_max:i;plan_type_risk_score:i;{PLAN_COLUMNS}"
)


@query("invoice_features", FEATURES, "SELECT * FROM features")
def _(spark, sf):
    return feat.invoice_features(
        ledger(spark, sf), enrolled(spark, sf), OBSERVATION_END, with_amounts=True, buckets=buckets(spark, sf)
    )
