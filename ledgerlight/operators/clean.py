"""Cleaning of raw ledger lines and the enrollee dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.quantiles import small
from ledgerlight.names import APPLIED, CATEGORY, PLANS, STUDENT, YEAR
from ledgerlight.session import settle

# Source column names and their canonical names.
CANONICAL = {
    "Date": "entry_date",
    "Due On": "due_date",
    "S.Y.": YEAR,
    "ID No.": STUDENT,
    "Category": CATEGORY,
    "Discount/Refund Applied To": APPLIED,
    "Amount Due": "amount_due",
    "Amount Paid": "amount_paid",
    "Account Name": "account_name",
    "Receivables": "receivables",
}

# Account labels by the kind of account they stand for.
ACCOUNTS = {
    "Cash": ["Cash on Hand", "Petty Cash Fund"],
    "Bank": [
        "China Bank",
        "BPI",
        "PS Bank",
        "Metro Bank",
        "PC Bank",
        "Union Bank",
        "cheque",
        "bank",
        "PNB",
        "China",
        "BPI cheque",
        "PNB ",
        "Bank",
        "Bank (Non-School)",
    ],
    "Not Applicable": ["    ", ""],
}
# Accounts written with their number: the number itself is not kept here.
NUMBERED_ACCOUNTS = {"Bank": r"^BDO Unibank - [0-9-]+$", "G-Cash": r"^Gcash - [0-9-]+$"}

# Education level by grade.
LEVELS = {
    "Pre-Elementary": ["Nrs", "Kn1", "Kn2"],
    "Elementary": ["G01", "G02", "G03", "G04", "G05", "G06"],
    "Junior High": ["G07", "G08", "G09", "G10"],
    "Special Education": ["SpE"],
}


def _labelled(col: Column, groups: Mapping[str, list[str]], start: Column | None = None) -> Column:
    """CASE over label groups; NULL when no group holds the value."""
    result = start
    for label, members in groups.items():
        test = col.isin(members)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result


def ledger_clean(raw: DataFrame) -> DataFrame:
    """Coerce years, ids, amounts and dates; bad amounts become 0, no-category lines go."""

    def number(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").cast("string").try_cast("double").try_cast(kind)

    def amount(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string").try_cast("decimal(28,10)")
        return F.coalesce(F.bround(value, 4), F.lit(0)).cast("decimal(18,4)")

    def date(name: str) -> Column:
        return F.substring(F.col(f"`{name}`").cast("string"), 1, 10).try_cast("date")

    return raw.filter(F.col("Category").isNotNull()).withColumns(
        {
            "S.Y.": number("S.Y.", "int"),
            "ID No.": number("ID No.", "bigint"),
            "Amount Due": amount("Amount Due"),
            "Amount Paid": amount("Amount Paid"),
            "Date": date("Date"),
            "Due On": date("Due On"),
        }
    )


def due_date_override(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace due dates by the first matching override of the line's year.

    ``overrides`` has (school_year, plan_type, due_on, position). Its rows are
    folded into one array per year, so each ledger line meets one row and
    nothing is multiplied. A repeated plan keeps its first position and its
    last date. Lines with a payment move when due earlier; lines with a charge
    always move; others stay.
    """
    per_plan = overrides.groupBy(YEAR, "plan_type").agg(
        F.min("position").alias("position"), F.max_by("due_on", "position").alias("due_on")
    )
    per_year = per_plan.groupBy(YEAR).agg(
        F.array_sort(F.collect_list(F.struct("position", "plan_type", "due_on"))).alias("rules")
    )
    joined = ledger.join(small(per_year), YEAR, "left")
    hit = F.filter(
        "rules",
        lambda r: F.coalesce(F.contains(F.col(CATEGORY), r["plan_type"]), F.lit(False))
        | F.coalesce(F.contains(F.col(APPLIED), r["plan_type"]), F.lit(False)),
    )
    new = F.try_element_at(hit, F.lit(1))
    due = (
        F.when(new.isNull(), F.col("due_date"))
        .when((F.col("amount_paid") != 0) & (F.col("due_date") < new["due_on"]), new["due_on"])
        .when(F.col("amount_due") != 0, new["due_on"])
        .otherwise(F.col("due_date"))
    )
    return joined.withColumn("due_date", due).drop("rules").select(*ledger.columns)


def receivable_calc(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn(
        "receivables", (F.col("amount_due") - F.col("amount_paid")).cast("decimal(18,4)")
    )


def rename_columns(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(CANONICAL)


def account_normalize(ledger: DataFrame, column: str = "account_name") -> DataFrame:
    """Account labels to Cash, Bank, G-Cash or Not Applicable; unknown labels stay."""
    col = F.col(column)
    start = None
    for label, pattern in NUMBERED_ACCOUNTS.items():
        test = col.rlike(pattern)
        start = F.when(test, label) if start is None else start.when(test, label)
    known = _labelled(col, ACCOUNTS, start)
    return ledger.withColumn(column, F.coalesce(known, col, F.lit("Not Applicable")))


ALIAS_LENGTH = 8


def _alias(identifier: Column, secret: str, length: int) -> Column:
    """The first ``length`` characters 0-9, A-Z of an endless text that a keyed digest gives an id."""
    pieces = []
    for turn in range(-(-length // 32)):
        digest = F.sha2(F.concat_ws("|", F.lit(secret), identifier, F.lit(str(turn))), 256)
        for at in (1, 13, 25, 37):
            number = F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")
            space = F.lit(36**8).cast("decimal(20,0)")
            pieces.append(F.lpad(F.conv((number % space).cast("string"), 10, 36), 8, "0"))
    return F.substring(F.concat(*pieces), 1, length)


def new_pseudonyms(ids: DataFrame, known: DataFrame | None, secret: str, length: int = ALIAS_LENGTH) -> DataFrame:
    """(original_id, alias) of the ids that ``known`` lacks; only they are written.

    Of ids that want one alias the least gets it, unless it is taken; the others
    try one character more, which ends as soon as their digests differ. What is
    tried depends on the ids alone, so a lost task comes to the same aliases.
    """
    pairs = ids.filter("original_id is not null").select(F.col("original_id").cast("string").alias("original_id")).distinct()
    unseen = pairs if known is None else pairs.join(known.select("original_id"), "original_id", "left_anti")
    unseen, given = settle(unseen), None
    while not unseen.isEmpty():
        drawn = unseen.withColumn("alias", _alias(F.col("original_id"), secret, length))
        winners = drawn.groupBy("alias").agg(F.min("original_id").alias("original_id"))
        free = winners if known is None else winners.join(known.select("alias"), "alias", "left_anti")
        won = settle(free.select("original_id", "alias"))
        given = won if given is None else given.unionByName(won)
        unseen = settle(unseen.join(won.select("original_id"), "original_id", "left_anti"))
        length += 1
    return unseen.withColumn("alias", F.lit("")) if given is None else given


def pseudonym_table(ids: DataFrame, known: DataFrame | None, secret: str, length: int = ALIAS_LENGTH) -> DataFrame:
    """(original_id, alias): known pairs kept, unseen ids added, aliases unique."""
    new = new_pseudonyms(ids, known, secret, length)
    return new if known is None else known.select("original_id", "alias").unionByName(new)


def extend_pseudonyms(ids: DataFrame, path: str, secret: str, length: int = ALIAS_LENGTH) -> DataFrame:
    """Append the ids that the dictionary at ``path`` lacks, and return it. One run at a time may append."""
    spark, layout = ids.sparkSession, "original_id string, alias string"
    try:
        known = spark.read.schema(layout).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    new_pseudonyms(ids, known, secret, length).write.mode("append").parquet(path)
    return spark.read.schema(layout).parquet(path)


def pseudonymize(ledger: DataFrame, aliases: DataFrame, column: str = STUDENT) -> DataFrame:
    """Swap ids for their aliases."""
    keyed = ledger.withColumn("original_id", F.col(column).cast("string"))
    return (
        keyed.join(aliases, "original_id", "left")
        .withColumn(column, F.col("alias"))
        .drop("original_id", "alias")
        .select(*ledger.columns)
    )


def plan_type(category: Column) -> Column:
    """Plan name for the first plan marker in the category, else the category."""
    result = None
    for plan in PLANS:
        test = category.contains(f"-{plan[-1]}-")
        result = F.when(test, plan) if result is None else result.when(test, plan)
    return result.otherwise(category)


def refund_flag(enrollees: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mark student-years that got an enrolment fee refunded."""
    refunded = (
        ledger.filter((F.col(CATEGORY) == "Refund") & F.col(APPLIED).contains("-UE"))
        .select(YEAR, STUDENT)
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    return (
        enrollees.join(refunded, [YEAR, STUDENT], "left")
        .withColumn(
            "has_refunded", F.when(F.col("hit") == 1, "Has Refund").otherwise("No Refund")
        )
        .drop("hit")
    )


def enrollees_build(ledger: DataFrame) -> DataFrame:
    """One row per student-year and enrolment category with a non-zero charge total.

    Sums and first dates come out of one aggregation per category; the first
    date of the student-year is then a minimum over its few categories.
    """
    per_category = (
        ledger.filter(F.col(CATEGORY).contains("-UE"))
        .dropna(subset=[YEAR, STUDENT])
        .groupBy(YEAR, STUDENT, CATEGORY)
        .agg(
            F.sum("amount_due").alias("charged"),
            F.min(F.when(F.col("amount_due") != 0, F.col("entry_date"))).alias("first_line"),
        )
    )
    dates = per_category.groupBy(YEAR, STUDENT).agg(F.min("first_line").alias("enrollment_date"))
    grade = F.substring(CATEGORY, 1, 3)
    return (
        per_category.filter("charged <> 0")
        .join(dates, [YEAR, STUDENT], "left")
        .select(
            YEAR,
            STUDENT,
            plan_type(F.col(CATEGORY)).alias("plan_type"),
            grade.alias("grade_level"),
            "enrollment_date",
            _labelled(grade, LEVELS).alias("education_level"),
        )
    )


def enrollees(ledger: DataFrame) -> DataFrame:
    return refund_flag(enrollees_build(ledger), ledger)


def all_transactions(ledger: DataFrame, bad_debts: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Ledger and bad-debt lines of enrolled student-years, with enrollee columns."""
    return ledger.unionByName(bad_debts, allowMissingColumns=True).join(
        enrolled, [YEAR, STUDENT], "inner"
    )
