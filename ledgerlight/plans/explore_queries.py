"""Queries of the exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.names import BRACKETS, LAGS
from ledgerlight.operators import explore as ex
from ledgerlight.operators.features import bracket_code
from ledgerlight.plans.inputs import feature_rows
from ledgerlight.plans.ledger_queries import KEYS
from ledgerlight.plans.registry import part, query

NUMBERS = ["dtp_1", "dtp_2", "dtp_avg", "dtp_wavg", "opening_balance", "days_since_last_payment"]
SHARES = ";".join(f"{b}:f" for b in BRACKETS)


def union_sql(template: str, names: list[str]) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", name) for name in names)


def share_sql(by: str, name: str, where: str = "TRUE") -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE dtp_bracket = '{b}') * 1.0 / count(*) AS \"{b}\"" for b in BRACKETS
    )
    return (
        f"SELECT {by} AS {name}, {cells} FROM features WHERE dtp_bracket IS NOT NULL AND {where} GROUP BY 1"
    )


@query(
    "profile",
    "feature:s;count:i;nulls:i;mean:f;std:f;min:f;median:f;max:f",
    union_sql(
        """SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS nulls,
  avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, CAST(max({c}) AS DOUBLE) AS max FROM features""",
        NUMBERS,
    ),
)
def _(spark, sf):
    return ex.profile(feature_rows(spark, sf), NUMBERS)


@query(
    "class_balance",
    "dtp_bracket:s;count:i;share:f;imbalance:f",
    """SELECT dtp_bracket, count(*) AS count, count(*) * 1.0 / sum(count(*)) OVER () AS share,
  max(count(*)) OVER () * 1.0 / count(*) AS imbalance
FROM features WHERE dtp_bracket IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return ex.class_balance(feature_rows(spark, sf))


@query("class_share_by", f"year:i;{SHARES}", share_sql("year(due_date)", "year"))
def _(spark, sf):
    return ex.class_share_by(feature_rows(spark, sf), F.year("due_date"), "year")


@query("class_share_by_month", f"month:i;{SHARES}", share_sql("due_month", "month"))
def _(spark, sf):
    return ex.class_share_by(feature_rows(spark, sf), F.col("due_month"), "month")


@query("class_share_by_missing", f"missing:i;{SHARES}", share_sql("CAST(dtp_1 IS NULL AS INT)", "missing"))
def _(spark, sf):
    return ex.class_share_by(
        feature_rows(spark, sf), F.col("dtp_1").isNull().cast("int"), "missing"
    )


AUDITED = [*LAGS, "dtp_avg", "last_payment_date", "payment_ratio", "prev_bracket", "due_month"]


@query(
    "missing_audit",
    "column:s;missing:i;percent:f",
    'SELECT * FROM ({}) WHERE missing > 0'.format(
        union_sql(
            """SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  (count(*) - count({c})) * 100.0 / count(*) AS percent FROM features""",
            AUDITED,
        )
    ),
)
def _(spark, sf):
    return ex.missing_audit(feature_rows(spark, sf), AUDITED)


@query(
    "conditional_share",
    f"previous:s;{SHARES}",
    share_sql("CASE WHEN dtp_1 < 0 THEN 'early' ELSE 'late' END", "previous", "dtp_1 <> 0"),
)
def _(spark, sf):
    return ex.conditional_share(feature_rows(spark, sf))


@query(
    "flag_crosstab", f"opening_balance_flag:i;{SHARES}", share_sql("opening_balance_flag", "opening_balance_flag")
)
def _(spark, sf):
    return ex.flag_crosstab(feature_rows(spark, sf), "opening_balance_flag")


def histogram_sql(source: str, column: str, by: str, low: str, high: str, bins: int) -> str:
    return f"""SELECT {by}, bin, count(*) AS count, any_value(lo + bin * w) AS bin_start,
  count(*) / (sum(count(*)) OVER (PARTITION BY {by}) * any_value(w)) AS density
FROM (SELECT {by}, lo, w, least(floor((least(greatest(v, lo), hi) - lo) / w), {bins - 1}) AS bin
  FROM (SELECT {by}, CAST({column} AS DOUBLE) AS v, lo, hi, (hi - lo) / {bins} AS w
    FROM {source}, (SELECT {low} AS lo, {high} AS hi)) WHERE v IS NOT NULL AND {by} IS NOT NULL)
GROUP BY {by}, bin"""


def limit_sql(column: str, p: float) -> str:
    return f"(SELECT quantile_cont(CAST({column} AS DOUBLE), {p}) FROM features)"


@query(
    "clipped_histogram",
    "dtp_bracket:s;bin:i;count:i;bin_start:f;density:f",
    histogram_sql(
        "features", "opening_balance", "dtp_bracket",
        limit_sql("opening_balance", 0.01), limit_sql("opening_balance", 0.99), 20,
    ),
)
def _(spark, sf):
    return ex.clipped_histogram(feature_rows(spark, sf), "opening_balance", "dtp_bracket", 20)


@query(
    "quantile_trim",
    f"{KEYS};due_date:d;dtp_bracket:s;opening_balance:m",
    """SELECT f.* FROM features f JOIN (SELECT dtp_bracket, quantile_cont(CAST(opening_balance AS DOUBLE), 0.99) AS q
FROM features GROUP BY ALL) t ON f.dtp_bracket = t.dtp_bracket WHERE CAST(opening_balance AS DOUBLE) <= q""",
)
def _(spark, sf):
    return ex.quantile_trim(feature_rows(spark, sf), "opening_balance")


@query(
    "box_stats",
    "dtp_bracket:s;q1:f;median:f;q3:f",
    """SELECT dtp_bracket, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
FROM (SELECT dtp_bracket, CAST(least(greatest(dtp_1, -60), 200) AS DOUBLE) AS v FROM features WHERE dtp_1 IS NOT NULL
  AND dtp_bracket IS NOT NULL) GROUP BY ALL""",
)
def _(spark, sf):
    return ex.box_stats(feature_rows(spark, sf), "dtp_1", -60.0, 200.0)


@query(
    "mean_by_bracket",
    "dtp_bracket:s;mean_dtp_1:f;mean_dtp_2:f;mean_dtp_3:f;mean_dtp_4:f;improving:f;mean_streak:f",
    """SELECT dtp_bracket, avg(dtp_1) AS mean_dtp_1, avg(dtp_2) AS mean_dtp_2, avg(dtp_3) AS mean_dtp_3,
  avg(dtp_4) AS mean_dtp_4, avg(CASE WHEN dtp_1 < dtp_2 THEN 1.0 ELSE 0.0 END) AS improving,
  avg(on_time_streak) AS mean_streak FROM features WHERE dtp_bracket IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return ex.mean_by_bracket(feature_rows(spark, sf))


@query(
    "grouped_describe",
    "dtp_bracket:s;count:i;mean:f;std:f;min:f;q1:f;median:f;q3:f;max:f",
    """SELECT dtp_bracket, count(dtp_avg) AS count, avg(dtp_avg) AS mean, stddev_samp(dtp_avg) AS std,
  min(dtp_avg) AS min, quantile_cont(dtp_avg, 0.25) AS q1, quantile_cont(dtp_avg, 0.5) AS median,
  quantile_cont(dtp_avg, 0.75) AS q3, max(dtp_avg) AS max FROM features WHERE dtp_bracket IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return ex.grouped_describe(feature_rows(spark, sf), "dtp_avg")


part(
    "coded",
    """SELECT *, CASE dtp_bracket WHEN 'on_time' THEN 0 WHEN '30_days' THEN 1 WHEN '60_days' THEN 2
  WHEN '90_days' THEN 3 END AS y FROM features""",
)


def rank_corr_sql(x: str, y: str, source: str) -> str:
    return f"""(SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}
    WHERE {x} IS NOT NULL AND {y} IS NOT NULL)))"""


@query(
    "spearman_vs_target",
    "feature:s;n:i;rho:f",
    union_sql(
        f"""SELECT '{{c}}' AS feature, count(*) FILTER (WHERE {{c}} IS NOT NULL AND code IS NOT NULL) AS n,
  {rank_corr_sql("{c}", "code", "features")} AS rho FROM features""",
        NUMBERS,
    ),
)
def _(spark, sf):
    return ex.spearman_vs_target(
        feature_rows(spark, sf), NUMBERS, bracket_code(F.col("dtp_bracket")), 100
    )


PAIRS = ex._pairs(NUMBERS)
PEARSON_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM features"
    for a, b in PAIRS
)
SPEARMAN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rank_corr_sql(a, b, 'features')} AS r" for a, b in PAIRS
)


@query("corr_matrix", "a:s;b:s;r:f", PEARSON_SQL)
def _(spark, sf):
    return ex.corr_matrix(feature_rows(spark, sf), NUMBERS)


@query("corr_matrix_spearman", "a:s;b:s;r:f", SPEARMAN_SQL)
def _(spark, sf):
    return ex.corr_matrix(feature_rows(spark, sf), NUMBERS, "spearman")


@query("collinear_pairs", "a:s;b:s;r:f", f"SELECT * FROM ({PEARSON_SQL}) WHERE abs(r) > 0.5")
def _(spark, sf):
    return ex.collinear_pairs(ex.corr_matrix(feature_rows(spark, sf), NUMBERS), 0.5)


@query(
    "volume_by_month",
    "month:i;invoices:i",
    "SELECT month(due_date) AS month, count(*) AS invoices FROM features GROUP BY ALL",
)
def _(spark, sf):
    return ex.volume_by_month(feature_rows(spark, sf))


@query(
    "yearly_late_rate",
    "year:i;late_rate:f",
    """SELECT year(due_date) AS year, avg(CASE WHEN dtp_bracket = '90_days' THEN 1.0 ELSE 0.0 END) AS late_rate
FROM features WHERE dtp_bracket IS NOT NULL AND year(due_date) >= 1997 GROUP BY ALL""",
)
def _(spark, sf):
    return ex.yearly_late_rate(feature_rows(spark, sf), 1997)


@query(
    "invoices_per_student_cdf",
    "invoices:i;students:i;cdf:f;share_over_4:f;share_over_8:f",
    """WITH n AS (SELECT student_id_pseudonimized, count(*) AS invoices FROM features GROUP BY ALL)
SELECT invoices, count(*) AS students, sum(count(*)) OVER (ORDER BY invoices) / (SELECT count(*) FROM n) AS cdf,
  (SELECT avg(CASE WHEN invoices > 4 THEN 1.0 ELSE 0.0 END) FROM n) AS share_over_4,
  (SELECT avg(CASE WHEN invoices > 8 THEN 1.0 ELSE 0.0 END) FROM n) AS share_over_8
FROM n GROUP BY invoices""",
)
def _(spark, sf):
    return ex.invoices_per_student_cdf(feature_rows(spark, sf))


@query(
    "transition_matrix",
    "previous:s;current:s;share:f",
    """WITH b AS (SELECT unnest(['on_time', '30_days', '60_days', '90_days']) AS x)
SELECT p.x AS previous, c.x AS current, coalesce((SELECT count(*) FROM coded t WHERE t.dtp_bracket = c.x
    AND t.prev_bracket = list_position(['on_time', '30_days', '60_days', '90_days'], p.x) - 1) * 1.0
  / nullif((SELECT count(*) FROM coded t WHERE t.dtp_bracket IS NOT NULL
    AND t.prev_bracket = list_position(['on_time', '30_days', '60_days', '90_days'], p.x) - 1), 0), 0) AS share
FROM b p, b c""",
)
def _(spark, sf):
    return ex.transition_matrix(feature_rows(spark, sf))


@query(
    "chronic_payers",
    "kind:s;count:i;share:f",
    """WITH k AS (SELECT student_id_pseudonimized, avg(CASE WHEN dtp_bracket = '90_days' THEN 1.0 ELSE 0.0 END) AS l,
  avg(CASE WHEN dtp_bracket = 'on_time' THEN 1.0 ELSE 0.0 END) AS o FROM features WHERE dtp_bracket IS NOT NULL GROUP BY ALL)
SELECT '90_days' AS kind, count(*) FILTER (WHERE l >= 0.75) AS count, count(*) FILTER (WHERE l >= 0.75) * 1.0 / count(*) AS share FROM k
UNION ALL SELECT 'on_time', count(*) FILTER (WHERE o >= 0.75), count(*) FILTER (WHERE o >= 0.75) * 1.0 / count(*) FROM k""",
)
def _(spark, sf):
    return ex.chronic_payers(feature_rows(spark, sf))


CHECKS = {
    "negative days": "dtp_1 < 0",
    "over 730 days": "days_elapsed_until_fully_paid > 730",
    "over 365 days": "days_elapsed_until_fully_paid > 365",
    "large balance": "opening_balance > 50000",
}


@query(
    "outlier_counts",
    "check:s;count:i",
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE {c}) AS count FROM features" for n, c in CHECKS.items()
    ),
)
def _(spark, sf):
    return ex.outlier_counts(feature_rows(spark, sf), CHECKS)


part(
    "full_history",
    """SELECT * FROM features WHERE dtp_1 IS NOT NULL AND dtp_2 IS NOT NULL AND dtp_3 IS NOT NULL AND dtp_4 IS NOT NULL
  AND days_elapsed_until_fully_paid BETWEEN -200 AND 200""",
)


@query(
    "range_filtered_density",
    "censor:i;bin:i;count:i;bin_start:f;density:f",
    histogram_sql("full_history", "days_elapsed_until_fully_paid", "censor", "-200.0", "200.0", 40),
)
def _(spark, sf):
    return ex.range_filtered_density(
        feature_rows(spark, sf), "days_elapsed_until_fully_paid", "censor"
    )
