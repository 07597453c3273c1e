"""Inputs shared by the queries, and the same inputs as SQL for the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.names import STUDENT
from ledgerlight.operators import clean, features, invoices
from ledgerlight.plans.registry import part, staged
from ledgerlight.session import settle
from ledgerlight.sources.tables import buckets_even, ledger_view, student_buckets

OBSERVATION_END = dt.date(2001, 6, 30)
AS_OF = dt.date(2001, 6, 30)
K = "school_year, student_id_pseudonimized, category_name"


_buckets: dict[tuple[str, str], int | None] = {}


def buckets(spark: SparkSession, sf_dir: str) -> int | None:
    """How many buckets by student the ledger and what follows from it come in, if any."""
    ledger(spark, sf_dir)
    return _buckets[spark.sparkContext.applicationId, sf_dir]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        found = student_buckets(spark, sf_dir)
        rows = settle(ledger_view(spark, sf_dir, found), "zstd", STUDENT, found)
        if found and not buckets_even(rows, F.col(STUDENT), found):
            rows, found = spark.read.schema(rows.schema).parquet(*rows.inputFiles()), None
        if not found:
            spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        _buckets[spark.sparkContext.applicationId, sf_dir] = found
        return rows

    return staged(spark, sf_dir, "ledger", build, write=False)


def enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = buckets(spark, sf_dir)
    return staged(spark, sf_dir, "enrolled", lambda: clean.enrollees(ledger(spark, sf_dir)), buckets=found)


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = buckets(spark, sf_dir)
    return staged(
        spark, sf_dir, "invoices", lambda: invoices.invoices(ledger(spark, sf_dir), True, found), buckets=found
    )


def aging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(
        spark, sf_dir, "aging", lambda: invoices.aging_invoice_table(ledger(spark, sf_dir))
    )


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(
        spark,
        sf_dir,
        "features",
        lambda: features.invoice_features(
            ledger(spark, sf_dir),
            enrolled(spark, sf_dir),
            OBSERVATION_END,
            invoice_rows=invoice_rows(spark, sf_dir),
            buckets=buckets(spark, sf_dir),
        ),
        write=False,
    )


part(
    "based",
    """
SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS school_year,
  CAST(o_custkey AS VARCHAR) AS student_id_pseudonimized,
  CASE WHEN o_orderpriority < '3'
    THEN 'G0' || (o_custkey % 9 + 1) || '-' || substr('ABCDE', CAST(c_nationkey % 5 + 1 AS INT), 1) || '-UE'
    ELSE 'Books - ' || substr(o_orderpriority, 1, 1) END AS cat,
  CASE o_orderkey % 5 WHEN 0 THEN 'Cash on Hand' WHEN 1 THEN 'BPI' WHEN 2 THEN 'Gcash'
    WHEN 3 THEN '' ELSE 'Metro Bank' END AS account_name
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
part(
    "moves",
    """
SELECT b.*, l.*, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,2)) AS DECIMAL(18,4)) AS off,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(6,2)) AS DECIMAL(18,4)) AS taxed
FROM lineitem l JOIN based b ON l_orderkey = o_orderkey""",
)
part(
    "ledger",
    f"""
SELECT *, amount_due - amount_paid AS receivables FROM (
SELECT o_orderkey * 10 AS entry_number, day AS entry_date, day + 30 AS due_date, school_year,
  student_id_pseudonimized, cat AS category_name, '' AS discount_refund_applied_to,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount_due,
  CAST(0 AS DECIMAL(18,4)) AS amount_paid, account_name FROM based
UNION ALL
SELECT o_orderkey * 10 + l_linenumber, day + CAST(l_partkey % 140 AS INT), day + 30, school_year,
  student_id_pseudonimized, cat, '', CAST(0 AS DECIMAL(18,4)), CAST(price AS DECIMAL(18,4)), account_name
FROM moves WHERE l_linenumber <= 5
UNION ALL
SELECT o_orderkey * 10 + l_linenumber, day, day + 30, school_year, student_id_pseudonimized,
  'Discount - Sibling', cat, -off, CAST(0 AS DECIMAL(18,4)), account_name
FROM moves WHERE l_linenumber = 6 AND l_discount > 0
UNION ALL
SELECT o_orderkey * 10 + l_linenumber, day, day + 30, school_year, student_id_pseudonimized,
  cat, '', -taxed, CAST(0 AS DECIMAL(18,4)), account_name
FROM moves WHERE l_linenumber = 7 AND l_returnflag = 'A' AND l_tax > 0
UNION ALL
SELECT o_orderkey * 10 + l_linenumber, day, day + 30, school_year, student_id_pseudonimized,
  'Refund', cat, -taxed, CAST(0 AS DECIMAL(18,4)), account_name
FROM moves WHERE l_linenumber = 7 AND l_returnflag = 'R' AND l_tax > 0)""",
)
part(
    "enrolled",
    """
SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM ledger r WHERE r.category_name = 'Refund'
    AND r.discount_refund_applied_to LIKE '%-UE%' AND r.school_year = e.school_year
    AND r.student_id_pseudonimized = e.student_id_pseudonimized)
  THEN 'Has Refund' ELSE 'No Refund' END AS has_refunded
FROM enrolled_base e""",
)
part(
    "enrolled_base",
    f"""
SELECT school_year, student_id_pseudonimized,
  CASE WHEN category_name LIKE '%-A-%' THEN 'Plan - A' WHEN category_name LIKE '%-B-%' THEN 'Plan - B'
    WHEN category_name LIKE '%-C-%' THEN 'Plan - C' WHEN category_name LIKE '%-D-%' THEN 'Plan - D'
    WHEN category_name LIKE '%-E-%' THEN 'Plan - E' ELSE category_name END AS plan_type,
  substr(category_name, 1, 3) AS grade_level, enrollment_date,
  CASE WHEN substr(category_name, 1, 3) IN ('G01','G02','G03','G04','G05','G06') THEN 'Elementary'
    WHEN substr(category_name, 1, 3) IN ('G07','G08','G09','G10') THEN 'Junior High' END AS education_level
FROM (SELECT {K}, sum(amount_due) AS s FROM ledger WHERE category_name LIKE '%-UE%' GROUP BY ALL)
JOIN (SELECT school_year, student_id_pseudonimized, min(entry_date) AS enrollment_date FROM ledger
  WHERE category_name LIKE '%-UE%' AND amount_due <> 0 GROUP BY ALL) USING (school_year, student_id_pseudonimized)
WHERE s <> 0""",
)
part(
    "disc",
    """
SELECT entry_date, school_year, student_id_pseudonimized, discount_refund_applied_to AS category_name,
  sum(amount_due) AS amount_discounted
FROM ledger WHERE category_name LIKE '%Discount%' AND discount_refund_applied_to <> '' GROUP BY ALL""",
)
part(
    "adj",
    """
SELECT school_year, student_id_pseudonimized,
  CASE WHEN discount_refund_applied_to IS NOT NULL AND discount_refund_applied_to <> ''
    THEN discount_refund_applied_to ELSE category_name END AS category_name, sum(amount_due) AS adjustments
FROM ledger WHERE amount_due < 0 AND category_name <> 'Refund' AND category_name NOT LIKE '%Discount%'
GROUP BY ALL""",
)
part(
    "pays",
    f"SELECT {K}, entry_date AS payment_date, amount_paid, receivables FROM ledger "
    "WHERE receivables < 0 AND amount_paid <> 0",
)
part(
    "due_kinds",
    f"""SELECT {K}, CASE WHEN n = 1 THEN 'single' ELSE 'multi' END AS due_type FROM (
SELECT {K}, count(DISTINCT due_date) AS n FROM ledger WHERE receivables > 0 GROUP BY ALL) WHERE n > 0""",
)
for kind in ("single", "multi"):
    part(
        f"ledger_{kind}",
        f"SELECT ledger.* FROM ledger JOIN due_kinds USING ({K}) WHERE due_type = '{kind}'",
    )
    part(
        f"charges_{kind}",
        f"""SELECT entry_number, entry_date, {K}, due_date, receivables FROM ledger_{kind}
WHERE ({K}) NOT IN (SELECT ({K}) FROM ledger_{kind} GROUP BY {K} HAVING sum(amount_due) = 0)
  AND amount_due <> 0 AND receivables > 0 AND amount_paid >= 0 AND category_name <> 'Refund'
  AND category_name <> 'Overpayment' AND category_name NOT LIKE '%Discount%'""",
    )
part(
    "credit_single",
    f"""SELECT *, gross_receivables + amount_discounted + adjustments AS credit_sale_amount FROM (
SELECT g.*, coalesce(d.s, 0) AS amount_discounted, coalesce(a.adjustments, 0) AS adjustments
FROM (SELECT {K}, sum(receivables) AS gross_receivables FROM charges_single GROUP BY ALL) g
LEFT JOIN (SELECT {K}, sum(amount_discounted) AS s FROM disc GROUP BY ALL) d USING ({K})
LEFT JOIN adj a USING ({K})) WHERE gross_receivables + amount_discounted + adjustments <> 0""",
)
part(
    "due_single",
    f"SELECT {K}, min(due_date) AS due_date FROM ledger_single "
    "WHERE amount_due <> 0 AND receivables <> 0 GROUP BY ALL",
)
part(
    "paid_single",
    f"SELECT {K}, max(payment_date) AS date_fully_paid FROM pays GROUP BY ALL",
)
part(
    "amounts_single",
    f"""SELECT {K}, sum(CASE WHEN payment_date <= due_date THEN amount_paid ELSE 0 END) AS prepayments,
  sum(amount_paid) AS total_payments FROM pays JOIN due_single USING ({K}) GROUP BY ALL""",
)
part(
    "walk",
    f"""SELECT *, sum(room) OVER w AS room_hi FROM (
SELECT *, receivables - given AS room FROM (
SELECT *, sign(td) * (least(abs(td), hi) - least(abs(td), hi - receivables)) AS given FROM (
SELECT c.*, sum(receivables) OVER w AS hi, coalesce(td, 0) AS td, coalesce(adjustments, 0) AS ta
FROM charges_multi c
LEFT JOIN (SELECT {K}, sum(amount_discounted) AS td FROM disc GROUP BY ALL) USING ({K})
LEFT JOIN adj USING ({K})
WINDOW w AS (PARTITION BY {K} ORDER BY due_date, entry_date, receivables, entry_number ROWS UNBOUNDED PRECEDING))))
WINDOW w AS (PARTITION BY {K} ORDER BY due_date, entry_date, receivables, entry_number ROWS UNBOUNDED PRECEDING)""",
)
part(
    "credit_multi",
    f"""SELECT *, gross_receivables + amount_discounted + adjustments AS credit_sale_amount FROM (
SELECT entry_number, entry_date, {K}, due_date, receivables AS gross_receivables, given AS amount_discounted,
  sign(ta) * (least(abs(ta), room_hi) - least(abs(ta), room_hi - room)) AS adjustments FROM walk)
WHERE gross_receivables + amount_discounted + adjustments <> 0""",
)
part(
    "settled",
    f"""WITH c AS (SELECT *, greatest(credit_sale_amount, 0) AS pos,
    sum(greatest(credit_sale_amount, 0)) OVER (PARTITION BY {K}
      ORDER BY due_date, entry_date, gross_receivables, entry_number ROWS UNBOUNDED PRECEDING) AS hi
  FROM credit_multi),
p AS (SELECT {K}, payment_date, paid, sum(paid) OVER (PARTITION BY {K} ORDER BY payment_date
    ROWS UNBOUNDED PRECEDING) AS phi FROM (
  SELECT {K}, payment_date, sum(amount_paid) AS paid FROM pays WHERE amount_paid > 0 GROUP BY ALL)),
a AS (SELECT entry_number,
    min(CASE WHEN phi >= hi AND pos > 0 THEN payment_date END) AS date_fully_paid,
    sum(greatest(0, least(hi, phi) - greatest(hi - pos, phi - paid))) AS total_payments,
    sum(CASE WHEN payment_date <= due_date
      THEN greatest(0, least(hi, phi) - greatest(hi - pos, phi - paid)) ELSE 0 END) AS prepayments
  FROM c JOIN p USING ({K}) GROUP BY entry_number)
SELECT credit_multi.*, date_fully_paid, coalesce(prepayments, 0) AS prepayments,
  coalesce(total_payments, 0) AS total_payments
FROM credit_multi LEFT JOIN a USING (entry_number)""",
)
part(
    "invoices",
    f"""SELECT *, credit_sale_amount - prepayments AS adjusted_credit_amount,
  credit_sale_amount - total_payments AS net_receivables FROM (
SELECT {K}, gross_receivables, amount_discounted, adjustments, credit_sale_amount, due_date, date_fully_paid,
  coalesce(prepayments, 0) AS prepayments, coalesce(total_payments, 0) AS total_payments
FROM credit_single LEFT JOIN due_single USING ({K}) LEFT JOIN paid_single USING ({K})
LEFT JOIN amounts_single USING ({K})
UNION ALL
SELECT {K}, gross_receivables, amount_discounted, adjustments, credit_sale_amount, due_date, date_fully_paid,
  prepayments, total_payments FROM settled)""",
)
