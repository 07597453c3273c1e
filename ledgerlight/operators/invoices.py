"""Invoices from a receivables ledger: charges, discounts, adjustments, settlement.

Sequential allocation is written as overlap of running totals. Invoices of a
key, laid end to end by due date, are intervals on an amount axis; so are its
payments by date. A payment pays an invoice by the length both intervals share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import day_piece, running, running_peak
from ledgerlight.functions.rules import describe
from ledgerlight.names import AGING, APPLIED, CATEGORY, KEY, STUDENT, YEAR
from ledgerlight.session import settle

MONEY = "decimal(28,4)"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _sum(value: Column | str) -> Column:
    return F.sum(value).cast(MONEY)


IS_DISCOUNT = "category_name like '%Discount%'"
IS_CHARGE = (
    "amount_due <> 0 and receivables > 0 and amount_paid >= 0 and category_name <> 'Refund' "
    f"and category_name <> 'Overpayment' and not ({IS_DISCOUNT})"
)
IS_PAYMENT = "receivables < 0 and amount_paid <> 0"
IS_ADJUSTMENT = f"amount_due < 0 and category_name <> 'Refund' and not ({IS_DISCOUNT})"
APPLIED_DISCOUNT = f"{IS_DISCOUNT} and discount_refund_applied_to <> ''"


def discounts(ledger: DataFrame) -> DataFrame:
    """Discount lines re-keyed to the category they lower, summed per posting date."""
    return (
        ledger.filter(APPLIED_DISCOUNT)
        .dropna(subset=["entry_date", YEAR, STUDENT])
        .groupBy("entry_date", YEAR, STUDENT, F.col(APPLIED).alias(CATEGORY))
        .agg(_sum("amount_due").alias("amount_discounted"))
    )


def _adjusted_category() -> Column:
    return F.when(F.col(APPLIED) != "", F.col(APPLIED)).otherwise(F.col(CATEGORY))


def adjustments(ledger: DataFrame) -> DataFrame:
    """Negative charges that are no refund or discount, summed per key."""
    return (
        ledger.filter(IS_ADJUSTMENT)
        .dropna(subset=[YEAR, STUDENT])
        .groupBy(YEAR, STUDENT, _adjusted_category().alias(CATEGORY))
        .agg(_sum("amount_due").alias("adjustments"))
    )


def _payments(ledger: DataFrame, condition: str) -> DataFrame:
    return ledger.filter(condition).select(
        YEAR, STUDENT, F.col("entry_date").alias("payment_date"), CATEGORY, "amount_paid", "receivables"
    )


def payments_to_receivables(ledger: DataFrame) -> DataFrame:
    return _payments(ledger, IS_PAYMENT)


def payments_to_all(ledger: DataFrame) -> DataFrame:
    return _payments(ledger, "amount_paid <> 0")


def due_date_cardinality(ledger: DataFrame) -> DataFrame:
    """Single or multi per key by its distinct due dates; keys without one are left out.

    First and last due date decide it, so no distinct values are gathered.
    """
    return (
        ledger.filter("receivables > 0")
        .dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(F.min("due_date").alias("__lo"), F.max("due_date").alias("__hi"))
        .filter("__lo is not null")
        .select(*KEY, F.when(F.expr("__lo = __hi"), "single").otherwise("multi").alias("due_type"))
    )


def segregate_due_types(ledger: DataFrame, due_type: str) -> DataFrame:
    keys = due_date_cardinality(ledger).filter(F.col("due_type") == due_type)
    return ledger.join(keys, KEY, "left_semi")


def charge_lines(ledger: DataFrame) -> DataFrame:
    """Open charges of keys whose charges do not cancel out."""
    cancelled = (
        ledger.dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(F.sum("amount_due").alias("net"))
        .filter("net = 0")
    )
    return (
        ledger.filter(IS_CHARGE)
        .join(cancelled, KEY, "left_anti")
        .select("entry_number", "entry_date", *KEY, "due_date", "receivables")
    )


def credit_sales_single(single_ledger: DataFrame, ledger: DataFrame) -> DataFrame:
    """Gross, discount, adjustment and credit amount per key, zero credits dropped."""
    gross = charge_lines(single_ledger).groupBy(*KEY).agg(_sum("receivables").alias("gross_receivables"))
    discount = (
        discounts(ledger).groupBy(*KEY).agg(_sum("amount_discounted").alias("amount_discounted"))
    )
    return _with_credit(gross.join(discount, KEY, "left").join(adjustments(ledger), KEY, "left"))


def _credit() -> Column:
    return F.expr("gross_receivables + amount_discounted + adjustments").cast(MONEY)


def _with_credit(df: DataFrame) -> DataFrame:
    return (
        df.withColumns(
            {
                "amount_discounted": F.coalesce("amount_discounted", _zero()),
                "adjustments": F.coalesce("adjustments", _zero()),
            }
        )
        .withColumn("credit_sale_amount", _credit())
        .filter("credit_sale_amount <> 0")
    )


def due_date_single(ledger: DataFrame) -> DataFrame:
    return (
        ledger.filter("amount_due <> 0 and receivables <> 0")
        .dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(F.min("due_date").alias("due_date"))
    )


def paid_date_last_payment(ledger: DataFrame) -> DataFrame:
    """Latest payment date per key, full settlement or not."""
    return (
        payments_to_receivables(ledger)
        .dropna(subset=KEY)
        .groupBy(*KEY)
        .agg(F.max("payment_date").alias("date_fully_paid"))
    )


def payment_amounts_single(ledger: DataFrame) -> DataFrame:
    """Paid in total, and the part paid on or before the due date, per key."""
    by_day = (
        payments_to_receivables(ledger)
        .groupBy(*KEY, "payment_date")
        .agg(_sum("amount_paid").alias("amount_paid"))
    )
    early = F.when(F.col("payment_date") <= F.col("due_date"), F.col("amount_paid")).otherwise(_zero())
    return (
        by_day.join(due_date_single(ledger), KEY)
        .groupBy(*KEY)
        .agg(_sum(early).alias("prepayments"), _sum("amount_paid").alias("total_payments"))
    )


def invoices_single(ledger: DataFrame, with_amounts: bool = False) -> DataFrame:
    """Invoices of the keys with one due date."""
    single = segregate_due_types(ledger, "single")
    result = (
        credit_sales_single(single, ledger)
        .join(due_date_single(single), KEY, "left")
        .join(paid_date_last_payment(single), KEY, "left")
    )
    if with_amounts:
        result = result.join(payment_amounts_single(single), KEY, "left")
    return result


# ---- several due dates: allocation along the amount axis ------------------------------


def _share(total: Column, before: Column, after: Column) -> Column:
    """Part of a signed total that falls on the stretch from ``before`` to ``after``."""
    size = F.abs(total)
    taken = F.least(size, after) - F.least(size, before)
    return F.when(total < 0, -taken).otherwise(taken).cast(MONEY)


def invoice_order() -> list[Column]:
    return [
        F.col("due_date").asc_nulls_last(),
        F.col("entry_date").asc_nulls_last(),
        F.col("gross_receivables"),
        F.col("entry_number").asc_nulls_last(),
    ]


def allocate_discount_adjustment(
    charges: DataFrame, discount: DataFrame, adjustment: DataFrame
) -> DataFrame:
    """Spread each key's discount and adjustment totals over its charges by due date.

    A charge takes discount up to its gross amount and adjustment up to gross
    minus discount. The room for adjustments up to a charge is its running
    gross minus its running discount, so one running total serves both.
    """
    per_key = discount.groupBy(*KEY).agg(_sum("amount_discounted").alias("__discount"))
    rows = charges.join(per_key, KEY, "left").join(
        adjustment.withColumnRenamed("adjustments", "__adjust"), KEY, "left"
    )
    return _allocate(rows)


def _allocate(rows: DataFrame) -> DataFrame:
    """Allocation for charges that carry their key's ``__discount`` and ``__adjust``."""
    ran = running(
        rows.withColumnRenamed("receivables", "gross_receivables"),
        KEY,
        invoice_order(),
        day_piece("due_date"),
        {"__hi": ("sum", F.col("gross_receivables").cast(MONEY))},
    )
    joined = ran.withColumns(
        {
            "__lo": F.expr("__hi - gross_receivables").cast(MONEY),
            "__discount": F.coalesce("__discount", _zero()),
            "__adjust": F.coalesce("__adjust", _zero()),
        }
    )
    lo, hi = F.col("__lo"), F.col("__hi")
    room = {
        f"__room_{side}": (edge - _share(F.col("__discount"), _zero(), edge)).cast(MONEY)
        for side, edge in {"lo": lo, "hi": hi}.items()
    }
    shared = joined.withColumns(room).withColumns(
        {
            "amount_discounted": _share(F.col("__discount"), lo, hi),
            "adjustments": _share(F.col("__adjust"), F.col("__room_lo"), F.col("__room_hi")),
        }
    )
    return _with_credit(shared).select(
        "entry_number",
        "entry_date",
        *KEY,
        "due_date",
        "gross_receivables",
        "amount_discounted",
        "adjustments",
        "credit_sale_amount",
    )


def credit_sales_multi(ledger: DataFrame) -> DataFrame:
    multi = segregate_due_types(ledger, "multi")
    return allocate_discount_adjustment(charge_lines(multi), discounts(ledger), adjustments(ledger))


def paid_by_day(payments: DataFrame, buckets: int | None = None) -> DataFrame:
    """Payments added up per key and date, and the positive ones of them (``paid``).

    Dealt out by key, so that what follows per key needs no second exchange;
    ``buckets`` by student are that already.
    """
    lines = payments.dropna(subset=KEY).select(*KEY, "payment_date", "amount_paid")
    return (
        (lines if buckets else lines.repartition(*KEY))
        .groupBy(*KEY, "payment_date")
        .agg(
            _sum("amount_paid").alias("amount_paid"),
            _sum(F.when(F.col("amount_paid") > 0, F.col("amount_paid"))).alias("paid"),
        )
    )


def payment_spans(payments: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per key and payment date: the stretch of the amount axis its money covers.

    Payments are added up per date first, so a key never has more rows here
    than it has dates.
    """
    by_day = paid_by_day(payments, buckets).filter("paid > 0").drop("amount_paid")
    order = Window.partitionBy(*KEY).orderBy(F.col("payment_date").asc_nulls_last())
    until = F.sum("paid").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY)
    return by_day.withColumn("pay_hi", until).select(
        *KEY, "payment_date", (F.col("pay_hi") - F.col("paid")).cast(MONEY).alias("pay_lo"), "pay_hi"
    )


def fifo(invoices: DataFrame, payments: DataFrame, buckets: int | None = None) -> DataFrame:
    """Settle invoices by due date with payments by date, first in first out.

    Adds ``date_fully_paid`` (NULL while open), ``prepayments`` and
    ``total_payments``. Credits of zero or less take nothing. ``entry_number``
    tells invoices of a key apart.

    The stretches of whole due dates meet the payment dates first; an invoice
    then meets only the payments that reach its own due date.
    """
    day = "__day"
    credit = F.greatest(F.col("credit_sale_amount"), _zero())
    ran = (
        running(invoices, KEY, invoice_order(), day_piece("due_date"), {"__hi": ("sum", credit.cast(MONEY))})
        .withColumn("__lo", (F.col("__hi") - credit).cast(MONEY))
        .withColumn(day, day_piece("due_date"))
    )
    days = (
        invoices.withColumn(day, day_piece("due_date"))
        .groupBy(*KEY, day)
        .agg(_sum(credit).alias("__credit"))
    )
    until = Window.partitionBy(*KEY).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("__day_hi", F.sum("__credit").over(until).cast(MONEY)).withColumn(
        "__day_lo", (F.col("__day_hi") - F.col("__credit")).cast(MONEY)
    )
    reach = days.join(payment_spans(payments, buckets), KEY).filter("pay_lo < __day_hi and pay_hi > __day_lo")
    spans = reach.select(
        *[F.col(c).alias(f"__pay_{c}") for c in [*KEY, day]], "payment_date", "pay_lo", "pay_hi"
    )
    meets = F.expr("credit_sale_amount > 0 and pay_lo < __hi and pay_hi > __lo")
    for c in [*KEY, day]:
        meets = meets & (F.col(c) == F.col(f"__pay_{c}"))
    applied = F.expr("least(__hi, pay_hi) - greatest(__lo, pay_lo)").cast(MONEY)
    hit = F.col("pay_hi").isNotNull()  # least and greatest skip NULL, so ask first
    early = hit & (F.col("payment_date") <= F.col("due_date"))
    return (
        ran.join(spans, meets, "left")
        .groupBy(*KEY, day, "__hi", *[c for c in invoices.columns if c not in KEY])
        .agg(
            F.max(F.when(F.expr("pay_hi >= __hi"), F.col("payment_date"))).alias("date_fully_paid"),
            _sum(F.when(early, applied).otherwise(_zero())).alias("prepayments"),
            _sum(F.when(hit, applied).otherwise(_zero())).alias("total_payments"),
        )
        .drop("__hi", day)
    )


INVOICE_COLUMNS = [
    *KEY,
    "gross_receivables",
    "amount_discounted",
    "adjustments",
    "credit_sale_amount",
    "due_date",
    "date_fully_paid",
]


def invoices_multi(ledger: DataFrame, with_amounts: bool = False) -> DataFrame:
    """Invoices of the keys with several due dates."""
    settled = fifo(credit_sales_multi(ledger), payments_to_receivables(ledger))
    extra = ["prepayments", "total_payments"] if with_amounts else []
    return settled.select(*INVOICE_COLUMNS, *extra)


def key_facts(ledger: DataFrame) -> DataFrame:
    """Everything the invoice build needs per key, from one pass over the ledger.

    A discount or adjustment line also counts for the key it is applied to, so
    it appears twice in the input of the one aggregation.
    """
    target = F.when(F.expr(APPLIED_DISCOUNT), F.col(APPLIED)).when(
        F.expr(IS_ADJUSTMENT), _adjusted_category()
    )
    flags = {
        "is_discount": F.expr(APPLIED_DISCOUNT) & F.col("entry_date").isNotNull(),
        "is_adjustment": F.expr(IS_ADJUSTMENT),
        "is_charge": F.expr(IS_CHARGE),
        "is_payment": F.expr(IS_PAYMENT),
    }
    lines = (
        ledger.withColumns(flags)
        .withColumn(
            "side",
            F.explode(
                F.when(
                    target.isNotNull(),
                    F.array(
                        F.struct(F.lit(True).alias("own"), F.col(CATEGORY).alias("cat")),
                        F.struct(F.lit(False).alias("own"), target.alias("cat")),
                    ),
                ).otherwise(F.array(F.struct(F.lit(True).alias("own"), F.col(CATEGORY).alias("cat"))))
            ),
        )
        .withColumn(CATEGORY, F.col("side.cat"))
        .dropna(subset=KEY)
    )
    own = F.col("side.own")
    open_due = F.when(own & (F.col("receivables") > 0), F.col("due_date"))
    return lines.groupBy(*KEY).agg(
        _sum(F.when(own, F.col("amount_due"))).alias("net_due"),
        F.min(open_due).alias("first_due"),
        F.max(open_due).alias("last_due"),
        F.min(
            F.when(own & F.expr("amount_due <> 0 and receivables <> 0"), F.col("due_date"))
        ).alias("due_date"),
        _sum(F.when(own & F.col("is_charge"), F.col("receivables"))).alias("gross_receivables"),
        F.max(F.when(own & F.col("is_payment"), F.col("entry_date"))).alias("date_fully_paid"),
        _sum(F.when(own & F.col("is_payment"), F.col("amount_paid"))).alias("total_payments"),
        _sum(F.when(~own & F.col("is_discount"), F.col("amount_due"))).alias("amount_discounted"),
        _sum(F.when(~own & F.col("is_adjustment"), F.col("amount_due"))).alias("adjustments"),
    )


def invoices(ledger: DataFrame, with_amounts: bool = False, buckets: int | None = None) -> DataFrame:
    """One row per receivable, both kinds of keys.

    Same result as ``invoices_single`` and ``invoices_multi`` together, planned
    around ``key_facts``: keys with one due date are finished by it, the others
    bring their charges and payments back in. ``buckets``: the number of buckets
    by student that the ledger comes in; its stage tables then keep them.
    """
    facts = settle(key_facts(ledger), "zstd", STUDENT, buckets).filter("first_due is not null and net_due <> 0")
    single = F.expr("first_due = last_due")
    if with_amounts:
        early = (
            paid_by_day(payments_to_receivables(ledger), buckets)
            .join(facts.filter(single).select(*KEY, "due_date"), KEY)
            .groupBy(*KEY)
            .agg(_sum(F.when(F.expr("payment_date <= due_date"), F.col("amount_paid"))).alias("prepayments"))
        )
    totals = facts.filter("first_due < last_due").select(
        *KEY,
        F.col("amount_discounted").alias("__discount"),
        F.col("adjustments").alias("__adjust"),
    )
    lines = ledger.filter(IS_CHARGE).select(
        "entry_number", "entry_date", *KEY, "due_date", "receivables"
    )
    several = settle(_allocate(lines.join(totals, KEY)), "zstd", STUDENT, buckets)
    settled = fifo(several, payments_to_receivables(ledger), buckets)
    extra = ["prepayments", "total_payments"] if with_amounts else []
    shown = [*(c for c in INVOICE_COLUMNS if c not in KEY), *extra]
    # A key has either its own numbers or settled invoices; a join keeps it where it is.
    rows = facts.withColumns(
        {c: F.coalesce(c, _zero()) for c in ["amount_discounted", "adjustments"]}
    ).withColumn("credit_sale_amount", F.when(single, _credit()))
    rows = rows.join(early, KEY, "left") if with_amounts else rows
    several = settled.select(*KEY, *[F.col(c).alias(f"__{c}") for c in shown])
    both = (
        rows.join(several, KEY, "left")
        .filter(F.coalesce("credit_sale_amount", "__credit_sale_amount") != 0)
        .select(*KEY, *[F.when(single, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in shown])
    )
    return _with_balances(both) if with_amounts else both


def _with_balances(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(c, _zero()) for c in ["prepayments", "total_payments"]}
    ).withColumns(
        {
            "adjusted_credit_amount": (F.col("credit_sale_amount") - F.col("prepayments")).cast(MONEY),
            "net_receivables": (F.col("credit_sale_amount") - F.col("total_payments")).cast(MONEY),
        }
    )


# ---- aging ---------------------------------------------------------------------------


def aging_bucket(days: Column) -> Column:
    """Aging bucket of a number of days late; missing counts as very late."""
    return (
        F.when(days <= 0, AGING[0])
        .when(days <= 30, AGING[1])
        .when(days <= 60, AGING[2])
        .when(days <= 90, AGING[3])
        .when(days <= 120, AGING[4])
        .when(days <= 150, AGING[5])
        .when(days <= 180, AGING[6])
        .otherwise(AGING[7])
    )


def aging_buckets_single(ledger: DataFrame) -> DataFrame:
    """Paid amount per key in each bucket of days after the due date.

    Payments without a day difference fall in no bucket.
    """
    by_day = (
        payments_to_receivables(ledger)
        .groupBy(*KEY, "payment_date")
        .agg(_sum("amount_paid").alias("amount_paid"))
    )
    days = F.datediff("payment_date", "due_date")
    bucketed = by_day.join(due_date_single(ledger), KEY).withColumn(
        "bucket", F.when(days.isNotNull(), aging_bucket(days))
    )
    columns = {
        b: _sum(F.when(F.col("bucket") == b, F.col("amount_paid")).otherwise(_zero())) for b in AGING
    }
    total = _sum(F.when(F.col("bucket").isNotNull(), F.col("amount_paid")).otherwise(_zero()))
    return bucketed.groupBy(*KEY).agg(
        *[c.alias(b) for b, c in columns.items()], total.alias("total_payments")
    )


def aging_buckets_pooled(invoice_rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Spread each key's summed payments over its invoices, all at the last payment date.

    A negative credit takes its (negative) amount in full while money is left,
    as the walk over the invoices does, so the pool left before an invoice is
    the least of the running remainders.
    """
    pool = payments.groupBy(*KEY).agg(
        _sum("amount_paid").alias("__pool"), F.max("payment_date").alias("__last")
    )
    peaks = running_peak(
        invoice_rows,
        KEY,
        invoice_order(),
        day_piece("due_date"),
        F.col("credit_sale_amount"),
        "__hi",
        "__peak",
    )
    # remaining money before a row = hi-so-far subtracted, floored where the pool ran dry
    before = (F.col("__hi") - F.col("credit_sale_amount")).cast(MONEY)
    dry = F.greatest(F.coalesce(F.col("__peak") - F.col("__pool"), _zero()), _zero())
    left = (F.col("__pool") - before + dry).cast(MONEY)
    applied = F.least(left, F.col("credit_sale_amount")).cast(MONEY)
    joined = peaks.join(pool, KEY, "left").withColumn(
        "__applied", F.when(F.col("__pool").isNotNull(), applied)
    )
    days = F.datediff("__last", "due_date")
    bucketed = joined.withColumn(
        "bucket", F.when(F.col("__pool").isNotNull(), aging_bucket(days))
    )
    return bucketed.withColumns(
        {
            b: F.when(F.col("bucket") == b, F.col("__applied")).otherwise(_zero()).cast(MONEY)
            for b in AGING
        }
    ).withColumn("total_payments", F.coalesce("__applied", _zero())).drop(
        "__hi", "__peak", "__pool", "__last", "__applied", "bucket"
    )


def aging_invoice_table(ledger: DataFrame) -> DataFrame:
    """Invoices with aging buckets, balances and a readable description."""
    single = segregate_due_types(ledger, "single")
    money = ["gross_receivables", "amount_discounted", "adjustments", "credit_sale_amount"]
    columns = [*KEY, *money, "due_date", *AGING, "total_payments"]
    one = (
        credit_sales_single(single, ledger)
        .join(due_date_single(single), KEY, "left")
        .join(aging_buckets_single(single), KEY, "left")
        .select(*columns)
    )
    several = aging_buckets_pooled(
        settle(credit_sales_multi(ledger)), payments_to_receivables(ledger)
    ).select(*columns)
    both = one.unionByName(several).withColumns(
        {c: F.coalesce(c, _zero()) for c in [*AGING, "total_payments"]}
    )
    return category_description(_with_balances(both).filter("credit_sale_amount <> 0"))


def category_description(invoice_rows: DataFrame) -> DataFrame:
    return invoice_rows.withColumn("description", describe(F.col(CATEGORY)))
