"""Queries of the cleaning and invoice operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlight.names import AGING, CATEGORY, KEY, STUDENT, YEAR
from ledgerlight.operators import clean, invoices as inv
from ledgerlight.plans.inputs import K, buckets, ledger
from ledgerlight.plans.registry import part, query
from ledgerlight.session import settle, shared_folder
from ledgerlight.sources.tables import column_prune, ledger_scan, ledger_view, table

KEYS = "school_year:i;student_id_pseudonimized:s;category_name:s"
LINE = (
    f"entry_number:i;entry_date:d;due_date:d;{KEYS};discount_refund_applied_to:s;"
    "amount_due:m;amount_paid:m;receivables:m;account_name:s"
)


@query("ledger_view", LINE, "SELECT * FROM ledger")
def _(spark, sf):
    return ledger_view(spark, sf)


def _raw(spark, sf):
    """The order tables under the names and loose types of a ledger export."""
    return table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("Due On"),
        F.when(F.col("o_orderkey") % 11 == 0, "SY")
        .otherwise(F.year("o_orderdate").cast("string"))
        .alias("S.Y."),
        F.col("o_custkey").cast("string").alias("ID No."),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("Category"),
        F.col("o_orderstatus").alias("Discount/Refund Applied To"),
        F.when(F.col("o_orderkey") % 5 == 0, "-")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("Amount Due"),
        F.lit(None).cast("string").alias("Amount Paid"),
        F.element_at(
            F.array(*[F.lit(x) for x in ["Cash on Hand", "BPI", "PNB ", "    ", "Vault"]]),
            (F.col("o_orderkey") % 5 + 1).cast("int"),
        ).alias("Account Name"),
        F.col("o_orderstatus").alias("Particulars"),
    )


part(
    "raw_lines",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS "Date",
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "Due On",
  CASE WHEN o_orderkey % 11 = 0 THEN 'SY' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS "S.Y.",
  CAST(o_custkey AS VARCHAR) AS "ID No.",
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS "Category",
  o_orderstatus AS "Discount/Refund Applied To",
  CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS "Amount Due",
  CAST(NULL AS VARCHAR) AS "Amount Paid",
  CASE o_orderkey % 5 WHEN 0 THEN 'Cash on Hand' WHEN 1 THEN 'BPI' WHEN 2 THEN 'PNB '
    WHEN 3 THEN '    ' ELSE 'Vault' END AS "Account Name" FROM orders""",
)
RAW = (
    "Date:s;Due On:s;S.Y.:s;ID No.:s;Category:s;Discount/Refund Applied To:s;"
    "Amount Due:s;Amount Paid:s;Account Name:s"
)


@query(
    "ledger_scan",
    "o_orderkey:i;o_custkey:i;o_orderstatus:s;o_totalprice:f;o_orderpriority:s",
    "SELECT * FROM orders",
)
def _(spark, sf):
    schema = table(spark, sf, "orders").schema
    return ledger_scan(spark, f"{sf}/orders.parquet", schema)


@query("column_prune", RAW, "SELECT * FROM raw_lines")
def _(spark, sf):
    return column_prune(_raw(spark, sf))


@query(
    "ledger_clean",
    "Date:d;Due On:d;S.Y.:i;ID No.:i;Category:s;Amount Due:m;Amount Paid:m",
    """SELECT TRY_CAST("Date" AS DATE) AS "Date", TRY_CAST("Due On" AS DATE) AS "Due On",
TRY_CAST("S.Y." AS INT) AS "S.Y.", TRY_CAST("ID No." AS BIGINT) AS "ID No.", "Category",
coalesce(TRY_CAST("Amount Due" AS DECIMAL(18,4)), 0) AS "Amount Due", 0 AS "Amount Paid"
FROM raw_lines WHERE "Category" IS NOT NULL""",
)
def _(spark, sf):
    return clean.ledger_clean(column_prune(_raw(spark, sf)))


@query(
    "rename_columns",
    "entry_date:s;due_date:s;school_year:s;student_id_pseudonimized:s;category_name:s;"
    "discount_refund_applied_to:s;amount_due:s;amount_paid:s;account_name:s",
    """SELECT "Date" AS entry_date, "Due On" AS due_date, "S.Y." AS school_year,
"ID No." AS student_id_pseudonimized, "Category" AS category_name,
"Discount/Refund Applied To" AS discount_refund_applied_to, "Amount Due" AS amount_due,
"Amount Paid" AS amount_paid, "Account Name" AS account_name FROM raw_lines""",
)
def _(spark, sf):
    return clean.rename_columns(column_prune(_raw(spark, sf)))


@query(
    "account_normalize",
    "ID No.:s;Account Name:s",
    """SELECT "ID No.", CASE "Account Name" WHEN 'Cash on Hand' THEN 'Cash' WHEN 'BPI' THEN 'Bank'
WHEN 'PNB ' THEN 'Bank' WHEN '    ' THEN 'Not Applicable' ELSE "Account Name" END AS "Account Name"
FROM raw_lines""",
)
def _(spark, sf):
    return clean.account_normalize(_raw(spark, sf), "Account Name")


@query("receivable_calc", LINE, "SELECT * FROM ledger")
def _(spark, sf):
    return clean.receivable_calc(ledger(spark, sf).drop("receivables"))


def _overrides(spark, sf):
    """Two overrides per year: enrolment fees, then one book list; dates from the year's orders."""
    years = (
        ledger(spark, sf).groupBy(YEAR).agg(F.max("due_date").alias("last_due"))
    )
    return years.select(
        YEAR,
        F.inline(
            F.array(
                F.struct(F.lit("-A-UE").alias("plan_type"), F.date_add("last_due", -100).alias("due_on"), F.lit(0).alias("position")),
                F.struct(F.lit("Books - 3").alias("plan_type"), F.date_add("last_due", 10).alias("due_on"), F.lit(1).alias("position")),
                F.struct(F.lit("-UE").alias("plan_type"), F.date_add("last_due", -300).alias("due_on"), F.lit(2).alias("position")),
            )
        ),
    )


part(
    "overrides",
    """SELECT school_year, plan_type, last_due + shift AS due_on, position
FROM (SELECT school_year, max(due_date) AS last_due FROM ledger GROUP BY ALL),
(VALUES ('-A-UE', -100, 0), ('Books - 3', 10, 1), ('-UE', -300, 2)) v(plan_type, shift, position)""",
)


@query(
    "due_date_override",
    f"entry_number:i;entry_date:d;{KEYS};discount_refund_applied_to:s;amount_due:m;amount_paid:m;due_date:d",
    """SELECT * REPLACE (CASE WHEN due_on IS NULL THEN due_date
  WHEN amount_paid <> 0 AND due_date < due_on THEN due_on
  WHEN amount_due <> 0 THEN due_on ELSE due_date END AS due_date)
FROM (SELECT l.*, list_filter(rules, lambda r: coalesce(contains(category_name, r.plan_type), false)
    OR coalesce(contains(discount_refund_applied_to, r.plan_type), false))[1].due_on AS due_on
  FROM ledger l LEFT JOIN (SELECT school_year, list({'plan_type': plan_type, 'due_on': due_on} ORDER BY position) AS rules
    FROM overrides GROUP BY school_year) USING (school_year))""",
)
def _(spark, sf):
    return clean.due_date_override(ledger(spark, sf), _overrides(spark, sf))


@query(
    "pseudonymize",
    "alias_length:i;clean_text:i;known:i;rows:i;ids:i",
    """SELECT 8 AS alias_length, 1 AS clean_text, CASE WHEN CAST(student_id_pseudonimized AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS known,
  count(*) AS rows, count(DISTINCT student_id_pseudonimized) AS ids FROM ledger WHERE student_id_pseudonimized IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    base = ledger(spark, sf)
    ids = base.select(F.col(STUDENT).alias("original_id"))
    known = (
        ids.distinct()
        .filter(F.col("original_id").cast("bigint") % 10 == 0)
        .withColumn("alias", F.concat(F.lit("K"), F.lpad("original_id", 7, "0")))
    )
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    known.write.parquet(path)
    # Two runs over ids that overlap; the second adds what the first lacks.
    clean.extend_pseudonyms(ids.filter(F.col("original_id").cast("bigint") % 3 > 0), path, secret="example")
    shown = clean.pseudonymize(base.filter(F.col(STUDENT).isNotNull()), clean.extend_pseudonyms(ids, path, secret="example"))
    return shown.groupBy(
        F.length(STUDENT).alias("alias_length"),
        F.col(STUDENT).rlike("^[0-9A-Z]{8}$").cast("int").alias("clean_text"),
        F.col(STUDENT).rlike("^K[0-9]{6}0$").cast("int").alias("known"),
    ).agg(F.count("*").alias("rows"), F.count_distinct(STUDENT).alias("ids"))


ENROLLED = "school_year:i;student_id_pseudonimized:s;plan_type:s;grade_level:s;enrollment_date:d;education_level:s"


@query("enrollees_build", ENROLLED, "SELECT * FROM enrolled_base")
def _(spark, sf):
    return clean.enrollees_build(ledger(spark, sf))


@query("refund_flag", ENROLLED + ";has_refunded:s", "SELECT * FROM enrolled")
def _(spark, sf):
    return clean.refund_flag(clean.enrollees_build(ledger(spark, sf)), ledger(spark, sf))


@query(
    "discounts", f"entry_date:d;{KEYS};amount_discounted:m", "SELECT * FROM disc"
)
def _(spark, sf):
    return inv.discounts(ledger(spark, sf))


@query("adjustments", f"{KEYS};adjustments:m", "SELECT * FROM adj")
def _(spark, sf):
    return inv.adjustments(ledger(spark, sf))


PAYMENT = f"{KEYS};payment_date:d;amount_paid:m;receivables:m"


@query("payments_to_receivables", PAYMENT, "SELECT * FROM pays")
def _(spark, sf):
    return inv.payments_to_receivables(ledger(spark, sf))


@query(
    "payments_to_all",
    PAYMENT,
    f"SELECT {K}, entry_date AS payment_date, amount_paid, receivables FROM ledger WHERE amount_paid <> 0",
)
def _(spark, sf):
    return inv.payments_to_all(ledger(spark, sf))


@query("due_date_cardinality", f"{KEYS};due_type:s", "SELECT * FROM due_kinds")
def _(spark, sf):
    return inv.due_date_cardinality(ledger(spark, sf))


@query("segregate_due_types", f"due_type:s;{LINE}", "SELECT 'single' AS due_type, * FROM ledger_single UNION ALL SELECT 'multi', * FROM ledger_multi")
def _(spark, sf):
    base = ledger(spark, sf)
    one = inv.segregate_due_types(base, "single").withColumn("due_type", F.lit("single"))
    several = inv.segregate_due_types(base, "multi").withColumn("due_type", F.lit("multi"))
    return one.unionByName(several)


@query(
    "charge_lines",
    f"entry_number:i;entry_date:d;{KEYS};due_date:d;receivables:m",
    "SELECT * FROM charges_single UNION ALL SELECT * FROM charges_multi",
)
def _(spark, sf):
    base = ledger(spark, sf)
    dated = base.join(inv.due_date_cardinality(base), KEY, "left_semi")
    return inv.charge_lines(dated)


MONEY = "gross_receivables:m;amount_discounted:m;adjustments:m;credit_sale_amount:m"


@query("credit_sales_single", f"{KEYS};{MONEY}", "SELECT * FROM credit_single")
def _(spark, sf):
    base = ledger(spark, sf)
    return inv.credit_sales_single(inv.segregate_due_types(base, "single"), base)


@query("due_date_single", f"{KEYS};due_date:d", "SELECT * FROM due_single")
def _(spark, sf):
    return inv.due_date_single(inv.segregate_due_types(ledger(spark, sf), "single"))


@query("paid_date_last_payment", f"{KEYS};date_fully_paid:d", "SELECT * FROM paid_single")
def _(spark, sf):
    return inv.paid_date_last_payment(ledger(spark, sf))


@query(
    "payment_amounts_single",
    f"{KEYS};prepayments:m;total_payments:m",
    "SELECT * FROM amounts_single",
)
def _(spark, sf):
    return inv.payment_amounts_single(inv.segregate_due_types(ledger(spark, sf), "single"))


@query(
    "allocate_discount_adjustment",
    f"entry_number:i;{KEYS};due_date:d;{MONEY}",
    "SELECT * FROM credit_multi",
)
def _(spark, sf):
    return inv.credit_sales_multi(ledger(spark, sf))


def _settled(spark, sf):
    base = ledger(spark, sf)
    return inv.fifo(settle(inv.credit_sales_multi(base)), inv.payments_to_receivables(base))


@query(
    "fifo_settlement_date",
    f"entry_number:i;{KEYS};due_date:d;credit_sale_amount:m;date_fully_paid:d",
    "SELECT * FROM settled",
)
def _(spark, sf):
    return _settled(spark, sf)


@query(
    "fifo_payment_amounts",
    f"entry_number:i;{KEYS};due_date:d;prepayments:m;total_payments:m",
    "SELECT * FROM settled",
)
def _(spark, sf):
    return _settled(spark, sf)


INVOICE = f"{KEYS};{MONEY};due_date:d;date_fully_paid:d"
AMOUNTS = "prepayments:m;total_payments:m;adjusted_credit_amount:m;net_receivables:m"


@query("invoice_union", f"{INVOICE};{AMOUNTS}", "SELECT * FROM invoices")
def _(spark, sf):
    return inv.invoices(ledger(spark, sf), True, buckets(spark, sf))


@query(
    "invoice_assemble_single",
    f"{INVOICE};prepayments:m;total_payments:m",
    f"""SELECT * FROM credit_single LEFT JOIN due_single USING ({K}) LEFT JOIN paid_single USING ({K})
LEFT JOIN amounts_single USING ({K})""",
)
def _(spark, sf):
    return inv.invoices_single(ledger(spark, sf), True)


BUCKETS = ";".join(f"{b}:m" for b in AGING)
BUCKET_SQL = """CASE WHEN days <= 0 THEN 'prepayments' WHEN days <= 30 THEN '30_days' WHEN days <= 60 THEN '60_days'
 WHEN days <= 90 THEN '90_days' WHEN days <= 120 THEN '120_days' WHEN days <= 150 THEN '150_days'
 WHEN days <= 180 THEN '180_days' ELSE '180_above' END"""
SPREAD = ", ".join(f"sum(CASE WHEN b = '{b}' THEN x ELSE 0 END) AS \"{b}\"" for b in AGING)
part(
    "aging_single",
    f"""SELECT {K}, {SPREAD}, sum(x) AS total_payments FROM (SELECT *, {BUCKET_SQL} AS b FROM (
SELECT {K}, amount_paid AS x, date_diff('day', due_date, payment_date) AS days
FROM pays JOIN due_single USING ({K}))) GROUP BY {K}""",
)
part(
    "aging_multi",
    f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {K}
    ORDER BY due_date, entry_date, gross_receivables, entry_number) AS i FROM credit_multi),
pool AS (SELECT {K}, sum(amount_paid) AS money, max(payment_date) AS last FROM pays GROUP BY ALL),
w AS (SELECT n.*, last, least(money, credit_sale_amount) AS x, money - least(money, credit_sale_amount) AS rest
  FROM n JOIN pool USING ({K}) WHERE i = 1
  UNION ALL
  SELECT n.*, w.last, least(rest, n.credit_sale_amount), rest - least(rest, n.credit_sale_amount)
  FROM w JOIN n ON n.school_year = w.school_year AND n.category_name = w.category_name
    AND n.student_id_pseudonimized = w.student_id_pseudonimized AND n.i = w.i + 1)
SELECT entry_number, {SPREAD}, sum(x) AS total_payments
FROM (SELECT *, {BUCKET_SQL} AS b FROM (SELECT *, date_diff('day', due_date, last) AS days FROM w))
GROUP BY entry_number""",
)
part(
    "aging",
    f"""SELECT *, credit_sale_amount - prepayments AS adjusted_credit_amount,
  credit_sale_amount - total_payments AS net_receivables FROM (
SELECT {K}, gross_receivables, amount_discounted, adjustments, credit_sale_amount, due_date,
 {", ".join(f'coalesce("{b}", 0) AS "{b}"' for b in [*AGING, "total_payments"])}
FROM credit_single LEFT JOIN due_single USING ({K}) LEFT JOIN aging_single USING ({K})
UNION ALL
SELECT {K}, gross_receivables, amount_discounted, adjustments, credit_sale_amount, due_date,
 {", ".join(f'coalesce("{b}", 0)' for b in [*AGING, "total_payments"])}
FROM credit_multi LEFT JOIN aging_multi USING (entry_number))""",
)


@query(
    "aging_buckets_single", f"{KEYS};{BUCKETS};total_payments:m", "SELECT * FROM aging_single"
)
def _(spark, sf):
    return inv.aging_buckets_single(inv.segregate_due_types(ledger(spark, sf), "single"))


@query(
    "aging_buckets_pooled",
    f"entry_number:i;{KEYS};{BUCKETS};total_payments:m",
    f"""SELECT entry_number, {K}, {", ".join(f'coalesce("{b}", 0) AS "{b}"' for b in [*AGING, "total_payments"])}
FROM credit_multi LEFT JOIN aging_multi USING (entry_number)""",
)
def _(spark, sf):
    base = ledger(spark, sf)
    return inv.aging_buckets_pooled(
        settle(inv.credit_sales_multi(base)), inv.payments_to_receivables(base)
    )


@query(
    "aging_invoice_table",
    f"{KEYS};{MONEY};due_date:d;{BUCKETS};total_payments:m;adjusted_credit_amount:m;net_receivables:m;description:s",
    """SELECT *, CASE WHEN category_name LIKE '%-UE%'
  THEN 'Tuition fee (' || substr(category_name, 1, 3) || ') - Upon enrollment'
  ELSE 'Books (' || substr(category_name, 1, 3) || ')' END AS description FROM aging""",
)
def _(spark, sf):
    return inv.aging_invoice_table(ledger(spark, sf))


MARKS = [
    "-UE", "B-1st", "C-3rd", "D-10th", "E-9th", "E-Learning", "-OF-2nd", "-OF", "Books",
    "Events - Fair", "Tutorial", "Moving Up", "Other",
]


@query(
    "category_description",
    "category_name:s;description:s;n:i",
    "SELECT category_name, d AS description, count(*) AS n FROM (SELECT 'G0' || (o_custkey % 9 + 1) || ' ' || m AS category_name, "
    "CASE m WHEN '-UE' THEN 'Tuition fee (' || g || ') - Upon enrollment' WHEN 'B-1st' THEN 'Tuition fee (' || g || ') - 1 of 2 payments' "
    "WHEN 'C-3rd' THEN 'Tuition fee (' || g || ') - 3 of 4 payments' WHEN 'D-10th' THEN 'Tuition fee (' || g || ') - 10 of 10 payments' "
    "WHEN 'E-9th' THEN 'Tuition fee (' || g || ') - 9 of 9 payments' WHEN 'E-Learning' THEN 'E-learning platform (' || g || ')' "
    "WHEN '-OF-2nd' THEN 'Miscellaneous fees - 2 of 3 payments' WHEN '-OF' THEN 'Miscellaneous fees' WHEN 'Books' THEN 'Books (' || g || ')' "
    "WHEN 'Events - Fair' THEN g || ' Fair' WHEN 'Tutorial' THEN 'Tutoring services' WHEN 'Moving Up' THEN 'Moving up fee' "
    "ELSE g || ' Other' END AS d FROM (SELECT o_custkey, 'G0' || (o_custkey % 9 + 1) AS g, list_extract(["
    + ", ".join(f"'{m}'" for m in MARKS)
    + f"], CAST(o_orderkey % {len(MARKS)} + 1 AS INT)) AS m FROM orders)) GROUP BY ALL",
)
def _(spark, sf):
    mark = F.element_at(
        F.array(*[F.lit(m) for m in MARKS]), (F.col("o_orderkey") % len(MARKS) + 1).cast("int")
    )
    grade = F.concat(F.lit("G0"), (F.col("o_custkey") % 9 + 1).cast("string"))
    named = table(spark, sf, "orders").select(F.concat(grade, F.lit(" "), mark).alias(CATEGORY))
    return inv.category_description(named).groupBy(CATEGORY, "description").agg(F.count("*").alias("n"))
