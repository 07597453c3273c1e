"""Receivables reports: bad debts, tenure, days sales outstanding, payment status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.names import AGING, BRACKETS, CATEGORY, STUDENT, YEAR

MONEY = "decimal(28,4)"
STATUSES = ["On Time", "Late", "Not Fully Paid Yet"]
LATE_BUCKETS = AGING[1:]


def bad_debts(invoice_rows: DataFrame) -> DataFrame:
    """Open balances before the latest school year, booked 180 days after they were due."""
    balance = (
        invoice_rows.dropna(subset=[YEAR, STUDENT, "due_date"])
        .groupBy(YEAR, "due_date", STUDENT)
        .agg(F.sum("net_receivables").cast(MONEY).alias("owed"))
    )
    latest = invoice_rows.filter(
        F.col("due_date").isNotNull() & F.col(STUDENT).isNotNull()
    ).agg(F.max(YEAR)).scalar()
    booked = F.date_add("due_date", 180)
    amount = (-F.col("owed")).cast(MONEY)
    return balance.filter((F.col(YEAR) != latest) & (F.col("owed") > 0)).select(
        booked.alias("entry_date"),
        booked.alias("due_date"),
        YEAR,
        STUDENT,
        F.lit("Bad Debts Expense").alias(CATEGORY),
        amount.alias("amount_due"),
        amount.alias("receivables"),
    )


def bad_debts_by_year(debts: DataFrame) -> DataFrame:
    return debts.groupBy(YEAR).agg(F.sum("amount_due").cast(MONEY).alias("bad_debts_expense"))


def bad_debts_tenure(debts: DataFrame, tenure: DataFrame) -> DataFrame:
    """Bad debts per student-year with the student's consecutive years, NULL if unmatched."""
    per_student = debts.groupBy(YEAR, STUDENT).agg(
        F.sum("amount_due").cast(MONEY).alias("bad_debts_expense")
    )
    return per_student.join(
        tenure.select(YEAR, STUDENT, "consecutive_years"), [YEAR, STUDENT], "left"
    )


def mean_tenure(debts_tenure: DataFrame) -> DataFrame:
    """Mean consecutive years per year, and overall in the row without a year."""
    return debts_tenure.rollup(YEAR).agg(F.avg("consecutive_years").alias("mean_consecutive_years"))


# ---- days sales outstanding -------------------------------------------------------------


def month_end_spine(transactions: DataFrame, date: str = "due_date") -> DataFrame:
    return transactions.filter(F.col(date).isNotNull()).select(F.last_day(date).alias("date")).distinct()


def _over(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def running_receivable(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Receivables due up to each month end; months are summed before they are added up."""
    monthly = (
        transactions.filter(F.col("due_date").isNotNull())
        .groupBy(*by, F.last_day("due_date").alias("date"))
        .agg(F.sum("receivables").cast(MONEY).alias("month_receivable"))
    )
    upto = _over(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        *by, "date", F.sum("month_receivable").over(upto).cast(MONEY).alias("running_receivable")
    )


def monthly_credit_sales(spine: DataFrame, credit_sales: DataFrame) -> DataFrame:
    """Adjusted credit amount due in each month of the spine, 0 where none.

    One row per month at most, so it is small enough to broadcast.
    """
    monthly = (
        credit_sales.filter(F.col("due_date").isNotNull())
        .groupBy(F.last_day("due_date").alias("date"))
        .agg(F.sum("adjusted_credit_amount").cast(MONEY).alias("credit_sale"))
    )
    return spine.join(F.broadcast(monthly), "date", "left").withColumn(
        "credit_sale", F.coalesce("credit_sale", F.lit(0).cast(MONEY))
    )


def dso_component(balances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average of this and the previous balance over credit sales, times the days between."""
    order = _over(by).orderBy("date")
    previous = F.lag("running_receivable").over(order)
    average = (F.col("running_receivable") + previous).cast("double") / 2
    days = F.datediff("date", F.lag("date").over(order))
    return balances.withColumns(
        {"prev_receivable": previous, "prev_date": F.lag("date").over(order)}
    ).withColumns(
        {
            "avg_receivable": average,
            "days_interval": days,
            "dso_component": F.try_divide(average, F.col("credit_sale").cast("double")) * days,
        }
    )


def dso_rolling_12m(balances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Twelve-calendar-month DSO from the first and last balance of the frame."""
    indexed = balances.withColumn("__month", F.year("date") * 12 + F.month("date"))
    frame = _over(by).orderBy("__month").rangeBetween(-11, 0)
    average = (
        F.first("running_receivable").over(frame) + F.last("running_receivable").over(frame)
    ).cast("double") / 2
    sales = F.sum("credit_sale").over(frame).cast("double")
    days = F.coalesce(F.sum("days_interval").over(frame), F.lit(0))
    return indexed.withColumn("rolling_12m_dso", F.try_divide(average, sales) * days).drop("__month")


def dso_pct_change(dso: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change in percent against the previous row; missing values carry the last one on."""
    order = _over(by).orderBy("date")
    carried = F.last("rolling_12m_dso", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = dso.withColumn("__filled", carried)
    change = F.try_divide(F.col("__filled"), F.lag("__filled").over(order)) - 1
    return filled.withColumn("rolling_12m_dso_pct_change", change * 100).drop("__filled")


def days_sales_outstanding(
    transactions: DataFrame, credit_sales: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """The whole DSO table, for everything or per group (the sales side stays whole)."""
    balances = monthly_credit_sales(running_receivable(transactions, by), credit_sales)
    return dso_pct_change(dso_rolling_12m(dso_component(balances, by), by), by)


def dso_june_snapshot(dso: DataFrame) -> DataFrame:
    return dso.filter(F.month("date") == 6).select(
        F.year("date").alias("year"), (F.year("date") - 1).alias(YEAR), "rolling_12m_dso"
    )


def dso_year_relative(dso: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Percent of the same year's mean, one row per year and one column per month."""
    picked = dso.withColumns({"year": F.year("date"), "month": F.month("date")}).filter(
        F.col("year").between(first_year, last_year)
    )
    mean = F.avg("rolling_12m_dso").over(Window.partitionBy("year"))
    relative = picked.withColumn("relative", F.try_divide("rolling_12m_dso", mean) * 100)
    return relative.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg("relative"))


def dso_change_grid(dso: DataFrame, first_year: int, last_year: int) -> DataFrame:
    picked = dso.withColumns({"year": F.year("date"), "month": F.month("date")}).filter(
        F.col("year").between(first_year, last_year)
    )
    return (
        picked.groupBy("year")
        .pivot("month", list(range(1, 13)))
        .agg(F.avg("rolling_12m_dso_pct_change"))
    )


def dso_latest_in_year(dso: DataFrame) -> DataFrame:
    return dso.groupBy(F.year("date").alias("year")).agg(
        F.max("date").alias("date"), F.max_by("rolling_12m_dso", "date").alias("rolling_12m_dso")
    )


def dso_by_plan(
    transactions: DataFrame, credit_sales: DataFrame, plans: Sequence[str] = ("Plan - A", "Plan - B", "Plan - C")
) -> DataFrame:
    """DSO of each plan's lines in one pass; ``source`` names the plan."""
    picked = transactions.filter(F.col("plan_type").isin(list(plans)))
    source = F.concat(F.lit("Plan "), F.substring("plan_type", -1, 1))
    return days_sales_outstanding(picked.withColumn("source", source), credit_sales, ["source"])


def negative_balance_students(transactions: DataFrame, credit_sales: DataFrame) -> DataFrame:
    """Student months with a balance below zero, with the student's DSO columns."""
    per_student = days_sales_outstanding(
        transactions.filter(F.col(STUDENT).isNotNull()), credit_sales, [STUDENT]
    )
    return per_student.filter("running_receivable < 0")


# ---- payment status -----------------------------------------------------------------------


def _late_total() -> Column:
    total = None
    for bucket in LATE_BUCKETS:
        total = F.col(bucket) if total is None else total + F.col(bucket)
    return total


def payment_status(aging: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("net_receivables") > 0, STATUSES[2])
        .when((F.col("prepayments") > 0) & (_late_total() == 0), STATUSES[0])
        .otherwise(STATUSES[1])
    )
    return aging.withColumn("payment_status", status)


def worst_aging_bucket(aging: DataFrame) -> DataFrame:
    """Oldest bucket that received money, On-Time when none did."""
    label = None
    for bucket in reversed(LATE_BUCKETS):
        test = F.col(bucket) > 0
        label = F.when(test, bucket) if label is None else label.when(test, bucket)
    return aging.withColumn("worst_bucket", label.otherwise("On-Time"))


def status_share(
    labelled: DataFrame, column: str, as_of: dt.date, by: Sequence[str] = (), order: Sequence[str] = STATUSES
) -> DataFrame:
    """Count and percent per status of the invoices due by ``as_of``, in report order."""
    counts = (
        labelled.filter(F.col("due_date") <= F.lit(as_of))
        .groupBy(*by, column)
        .agg(F.count("*").alias("count"))
    )
    position = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return counts.withColumns(
        {
            "percent": F.col("count") * 100.0 / F.sum("count").over(_over(by)),
            "position": position.cast("int"),
        }
    )


# ---- enrolment ------------------------------------------------------------------------------


def enrollment_statistics(
    tenure: DataFrame, percent: bool = True, streaks: Sequence[int] | None = None
) -> DataFrame:
    """Per year: students, new students and students per streak length.

    ``streaks`` is the list of streak lengths to report; by default those found,
    never more than there are school years.
    """
    kept = tenure.filter(F.coalesce(F.col("has_refunded") != "Has Refund", F.lit(True)))
    if streaks is None:
        found = kept.filter("consecutive_years is not null").select("consecutive_years").distinct()
        streaks = sorted(row[0] for row in found.collect())
    totals = kept.groupBy(YEAR).agg(F.count_distinct(STUDENT).alias("total_enrolled"))
    new = (
        kept.groupBy(STUDENT)
        .agg(F.min(YEAR).alias(YEAR))
        .groupBy(YEAR)
        .agg(F.count("*").alias("new_enrollees"))
    )
    counts = (
        kept.groupBy(YEAR)
        .pivot("consecutive_years", list(streaks))
        .agg(F.count_distinct(STUDENT))
    )
    joined = totals.join(new, YEAR, "full_outer").join(counts, YEAR, "left").fillna(0)
    suffix = "%" if percent else "count"

    def shown(column: str) -> Column:
        col = F.col(f"`{column}`")
        return F.try_divide(col, F.col("total_enrolled")) * 100 if percent else col

    return joined.select(
        YEAR,
        "total_enrolled",
        shown("new_enrollees").alias(f"new_enrollees_{suffix}"),
        *[shown(str(n)).alias(f"{n}_year_{suffix}") for n in streaks],
    )


# ---- screens ----------------------------------------------------------------------------------


def overdue_kpis(scored: DataFrame, bracket: str = "dtp_bracket", predicted: str = "predicted") -> DataFrame:
    """Invoices per lateness bucket and the share predicted right, in one row."""
    known = F.col(bracket).isNotNull()
    return scored.agg(
        F.count("*").alias("invoices"),
        *[F.count_if(F.col(bracket) == b).alias(f"n_{b}") for b in BRACKETS],
        (
            F.count_if(known & (F.col(bracket) == F.col(predicted))) / F.nullif(F.count_if(known), F.lit(0))
        ).alias("accuracy"),
    )


def late_invoice_list(
    invoice_rows: DataFrame, enrolled: DataFrame, delay: str, limit: int | None = None
) -> DataFrame:
    """Open invoices expected to be late, longest expected delay first."""
    grades = enrolled.groupBy(YEAR, STUDENT).agg(F.min("grade_level").alias("grade_level"))
    listed = (
        invoice_rows.filter(F.col("date_fully_paid").isNull() & (F.col(delay) > 0))
        .join(grades, [YEAR, STUDENT], "left")
        .select(
            STUDENT,
            "grade_level",
            F.col("net_receivables").alias("amount"),
            "due_date",
            F.col(delay).alias("predicted_delay"),
        )
        .orderBy(F.desc("predicted_delay"), STUDENT, "due_date", "amount")
    )
    return listed if limit is None else listed.limit(limit)
