"""Scans: ledger folders, and the ledger view over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.names import APPLIED, CATEGORY, STUDENT, YEAR

MONEY = "decimal(18,4)"
#: Ledger lines a bucket of students should hold, and the least that are worth another bucket.
BUCKET, SMALL = 250_000, 25_000
#: What an order or one of its lines is in the ledger.
CHARGE, PAYMENT, DISCOUNT, ADJUSTMENT, REFUND = range(5)

# Column names of the exported ledger.
RAW_LEDGER = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in [
            "Date",
            "Due On",
            "S.Y.",
            "ID No.",
            "Category",
            "Discount/Refund Applied To",
            "Amount Due",
            "Amount Paid",
            "Account Name",
        ]
    ]
)
UNUSED_COLUMNS = [
    "Level",
    "PR#",
    "Full Name",
    "Prev PR#",
    "Particulars",
    "Check No.",
    "ClaimStatus",
    "Is Correct",
    "Audit Notes",
]
LEDGER = T.StructType(
    [
        T.StructField("entry_number", T.LongType()),
        T.StructField("entry_date", T.DateType()),
        T.StructField("due_date", T.DateType()),
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(STUDENT, T.StringType()),
        T.StructField(CATEGORY, T.StringType()),
        T.StructField(APPLIED, T.StringType()),
        T.StructField("amount_due", T.DecimalType(18, 4)),
        T.StructField("amount_paid", T.DecimalType(18, 4)),
        T.StructField("receivables", T.DecimalType(18, 4)),
        T.StructField("account_name", T.StringType()),
    ]
)


def ledger_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_LEDGER,
    file_format: str = "parquet",
) -> DataFrame:
    """All ledger files below a folder as one frame; an empty folder gives no rows."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if file_format == "csv":
        return reader.option("header", "true").option("enforceSchema", "false").csv(path)
    return reader.format(file_format).load(path)


def column_prune(raw: DataFrame) -> DataFrame:
    """Drop the nine ledger columns nothing reads; absent ones are ignored."""
    return raw.drop(*UNUSED_COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(amount: Column, rate: Column | None = None) -> Column:
    value = amount.cast("decimal(18,2)")
    if rate is not None:
        value = value * rate.cast("decimal(6,2)")
    return value.cast(MONEY)


def student_buckets(spark: SparkSession, sf_dir: str) -> int | None:
    """Buckets by student for the ledger view, about ``BUCKET`` lines in each.

    None where the orders of one bucket are already more than it may hold.
    """
    orders = table(spark, sf_dir, "orders")
    rows = orders.count() + table(spark, sf_dir, "lineitem").count()
    buckets = max(rows // BUCKET, min(rows // SMALL, spark.sparkContext.defaultParallelism)) + 1
    return buckets if buckets_even(orders, F.col("o_custkey").cast("string"), buckets) else None


def buckets_even(df: DataFrame, student: Column, buckets: int) -> bool:
    """Whether no bucket has more than four times the rows it should hold.

    If one has, students in it are so large that they must be split, which dealing
    out by student and day does.
    """
    held = df.groupBy(F.pmod(F.hash(student), F.lit(buckets))).agg(F.count("*").alias("n"))
    return (held.agg(F.max("n")).first()[0] or 0) <= 4 * BUCKET


def ledger_view(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Orders and their lines read as a receivables ledger.

    Orders are charges; order lines become payments, discounts, adjustments
    and refunds by line number, so lineitem is scanned once. With ``buckets``
    the lines are dealt out by student before their columns are spelt out.
    """
    day = F.to_date("o_orderdate")
    based = (
        table(spark, sf_dir, "orders")
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select(
            "o_orderkey",
            "o_totalprice",
            day.alias("day"),
            F.col("o_custkey").cast("string").alias(STUDENT),
            F.substring("o_orderpriority", 1, 1).alias("urgency"),
            (F.col("c_nationkey") % 5 + 1).cast("int").alias("plan"),
        )
    )
    number, discount, tax = F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    kind = (
        F.when(number <= 5, PAYMENT)
        .when((number == 6) & (discount > 0), DISCOUNT)
        .when((number == 7) & (flag == "A") & (tax > 0), ADJUSTMENT)
        .when((number == 7) & (flag == "R") & (tax > 0), REFUND)
    )
    # Only what the ledger shows of a line goes through the join.
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumn("kind", kind)
        .filter("kind is not null")
        .select(
            "l_orderkey",
            number.alias("number"),
            "kind",
            F.when(F.col("kind") == PAYMENT, (F.col("l_partkey") % 140).cast("int")).alias("wait"),
            F.when(F.col("kind") == PAYMENT, _money(price))
            .when(F.col("kind") == DISCOUNT, -_money(price, discount))
            .otherwise(-_money(price, tax))
            .cast(MONEY)
            .alias("amount"),
        )
        .join(based.drop("o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
        .drop("l_orderkey")
    )
    charges = based.select(
        "*",
        F.lit(0).alias("number"),
        F.lit(CHARGE).alias("kind"),
        F.lit(None).cast("int").alias("wait"),
        _money(F.col("o_totalprice")).alias("amount"),
    ).drop("o_totalprice")
    entries = charges.unionByName(lines)
    if buckets:
        entries = entries.repartition(buckets, STUDENT)
    grade = F.concat(F.lit("G0"), (F.col(STUDENT).cast("long") % 9 + 1).cast("string"))
    plan = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), F.col("plan"))
    cat = F.when(F.col("urgency") < "3", F.concat(grade, F.lit("-"), plan, F.lit("-UE"))).otherwise(
        F.concat(F.lit("Books - "), F.col("urgency"))
    )
    account = F.array(*[F.lit(x) for x in ["Cash on Hand", "BPI", "Gcash", "", "Metro Bank"]])
    is_payment, zero = F.col("kind") == PAYMENT, F.lit(0).cast(MONEY)
    own = F.col("kind").isin(CHARGE, PAYMENT, ADJUSTMENT)
    return entries.select(
        (F.col("o_orderkey") * 10 + F.col("number")).alias("entry_number"),
        F.when(is_payment, F.date_add("day", F.col("wait"))).otherwise(F.col("day")).alias("entry_date"),
        F.date_add("day", 30).alias("due_date"),
        F.year("day").alias(YEAR),
        STUDENT,
        F.when(own, cat)
        .when(F.col("kind") == DISCOUNT, "Discount - Sibling")
        .otherwise("Refund")
        .alias(CATEGORY),
        F.when(own, F.lit("")).otherwise(cat).alias(APPLIED),
        F.when(is_payment, zero).otherwise(F.col("amount")).alias("amount_due"),
        F.when(is_payment, F.col("amount")).otherwise(zero).alias("amount_paid"),
        F.element_at(account, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("account_name"),
    ).withColumn("receivables", (F.col("amount_due") - F.col("amount_paid")).cast(MONEY))
