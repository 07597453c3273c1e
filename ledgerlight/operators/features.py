"""Payment-history features of invoices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlight.functions.ordered import PIECE, day_piece
from ledgerlight.functions.quantiles import quantiles
from ledgerlight.names import BRACKETS, CATEGORY, LAGS, PLANS, STUDENT, YEAR
from ledgerlight.operators.invoices import category_description, invoices
from ledgerlight.session import settle

DAYS_LATE = "days_elapsed_until_fully_paid"
HISTORY_ORDER = [
    "due_date",
    YEAR,
    CATEGORY,
    "credit_sale_amount",
    "gross_receivables",
    "date_fully_paid",
]
FALLBACK_RISK = 2
RISK_TIERS = 5


def history_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in HISTORY_ORDER]


def days_late(invoice_rows: DataFrame) -> DataFrame:
    return invoice_rows.withColumn(DAYS_LATE, F.datediff("date_fully_paid", "due_date"))


# ---- one pass over a student's days ---------------------------------------------------

#: The student inside the pass: a union keeps the buckets of a column only under a new name.
WHO = "__student"


def _inside(order: Sequence[Column]) -> WindowSpec:
    """Rows of one student and day."""
    return Window.partitionBy(WHO, PIECE).orderBy(*order)


def _days(until: int) -> WindowSpec:
    """All days of a student up to this one (0) or the one before (-1)."""
    return Window.partitionBy(WHO).orderBy(PIECE).rangeBetween(Window.unboundedPreceding, until)


@dataclass(frozen=True)
class Facet:
    """Something an invoice learns from its student's days; several share one pass.

    ``local`` is worked out among the invoices of one due day, ``point`` sums a due
    day up, ``facts`` brings a row per student and day of other tables. ``steps`` run
    over all those days, ``student`` adds columns per student, ``carry`` goes back to
    the invoices and ``out`` is what they show. ``local`` and ``steps`` come in levels,
    a later one uses the ones before.
    """

    out: dict[str, Column]
    carry: dict[str, Column]
    local: tuple[dict[str, Column], ...] = ()
    point: dict[str, Column] = field(default_factory=dict)
    facts: DataFrame | None = None
    steps: tuple[dict[str, Column], ...] = ()
    student: DataFrame | None = None


def _levels(df: DataFrame, parts: Iterable[tuple[dict[str, Column], ...]]) -> DataFrame:
    parts = list(parts)
    for level in range(max(map(len, parts), default=0)):
        df = df.withColumns({n: c for part in parts for n, c in (part[level] if level < len(part) else {}).items()})
    return df


def along_days(invoice_rows: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """Add the outputs of all facets: the invoices are dealt out once, by student and due day.

    Days of all kinds then meet in one table per student, which holds at most one
    row per calendar day of a kind whatever the student's share of the data.
    Invoices without a student get nothing from other days.
    """
    named = invoice_rows.withColumn(PIECE, day_piece("due_date")).withColumnRenamed(STUDENT, WHO)
    local = _levels(named, [f.local for f in facets])
    days = (
        local.filter(F.col(WHO).isNotNull())
        .groupBy(WHO, PIECE)
        .agg(F.max(F.lit(True)).alias("__point"), *[c.alias(n) for f in facets for n, c in f.point.items()])
    )
    for f in facets:
        if f.facts is not None:
            days = days.unionByName(f.facts, allowMissingColumns=True)
    days = _levels(days, [f.steps for f in facets]).filter("__point")
    for f in facets:
        if f.student is not None:
            days = days.join(f.student, WHO, "left")
    carried = days.select(WHO, PIECE, *[c.alias(n) for f in facets for n, c in f.carry.items()])
    return (
        local.join(carried, [WHO, PIECE], "left")
        .withColumnRenamed(WHO, STUDENT)
        .select(*invoice_rows.columns, *[c.alias(n) for f in facets for n, c in f.out.items()])
    )


def _dated(value: Column) -> Column:
    """Invoices without a due date have no day to look back from."""
    return F.when(F.col("due_date").isNotNull(), value)


def _lags(columns: dict[str, tuple[str, int]], depth: int) -> Facet:
    """Previous values: each due day hands over its last ``depth`` rows."""
    now = F.struct(*sorted({source for source, _ in columns.values()}))
    inside = _inside(history_order())
    near = F.array(*[F.lag(now, k).over(inside) for k in range(1, depth + 1)])
    local = {
        "__near": F.filter(near, lambda x: x.isNotNull()),
        "__at": F.row_number().over(inside),
        "__tail": F.lead(F.lit(1), depth).over(inside).isNull(),
    }
    last = F.array_sort(F.collect_list(F.when(F.col("__tail"), F.struct((-F.col("__at")).alias("o"), now.alias("i")))))
    over = f"ignore nulls over (partition by {WHO} order by {PIECE})"
    far = F.filter(
        F.array(*[F.expr(f"lag(__last, {k}) {over}") for k in range(1, depth + 1)]), lambda x: x.isNotNull()
    )
    past = F.concat("__near", "__far")
    return Facet(
        out={out: F.try_element_at(past, F.lit(k))[source] for out, (source, k) in columns.items()},
        carry={"__far": F.slice("__earlier", 1, depth)},
        local=(local,),
        point={"__last": F.transform(last, lambda x: x["i"])},
        steps=({"__earlier": F.flatten(far)},),
    )


def _streak(good: Column, out: str) -> Facet:
    """How many ``good`` rows in a row end just before each row.

    A due day hands over its row count and the position of its last break.
    """
    inside = _inside(history_order())
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    broken = F.when(~F.coalesce(good, F.lit(False)), F.col("__at"))
    rows_before = F.col("__at") - 1
    return Facet(
        out={
            out: F.when(F.col("__break").isNotNull(), rows_before - F.col("__break"))
            .otherwise(rows_before + F.coalesce("__carry", F.lit(0)))
            .cast("int")
        },
        carry={"__carry": F.col("__start") - F.coalesce("__stop", F.lit(0))},
        local=({"__at": F.row_number().over(inside)}, {"__break": F.max(broken).over(past)}),
        point={"__n": F.count("*"), "__broken": F.max(broken)},
        steps=(
            {"__start": F.coalesce(F.sum("__n").over(_days(-1)), F.lit(0))},
            {"__stop": F.max(F.col("__start") + F.col("__broken")).over(_days(-1))},
        ),
    )


def payment_history(
    invoice_rows: DataFrame, columns: dict[str, tuple[str, int]], depth: int
) -> DataFrame:
    """Previous values over all invoices of a student, ``{out: (column, distance)}``."""
    return along_days(invoice_rows, [_lags(columns, depth)])


def dtp_lags(invoice_rows: DataFrame, depth: int = 4) -> DataFrame:
    """Days late of this invoice and of the student's previous ones."""
    return payment_history(
        days_late(invoice_rows), {f"dtp_{k}": (DAYS_LATE, k) for k in range(1, depth + 1)}, depth
    )


def due_date_prev(invoice_rows: DataFrame, depth: int = 2) -> DataFrame:
    return payment_history(
        invoice_rows, {f"due_date_prev_{k}": ("due_date", k) for k in range(1, depth + 1)}, depth
    )


def _known_lags() -> Column:
    return F.filter(F.array(*[F.col(c).cast("double") for c in LAGS]), lambda x: x.isNotNull())


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values))


def dtp_avg_wavg(df: DataFrame) -> DataFrame:
    """Mean of the known lags; weighted sum where a missing lag counts 0."""
    weighted = None
    for column, weight in zip(LAGS, [0.4, 0.3, 0.2, 0.1]):
        term = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) * weight
        weighted = term if weighted is None else weighted + term
    return df.withColumns({"dtp_avg": _mean(_known_lags()), "dtp_wavg": weighted})


def dtp_trend(df: DataFrame) -> DataFrame:
    """Change of days late per day between due dates, 0 where it has no value."""

    def trend(distance: int) -> Column:
        days = F.datediff("due_date", f"due_date_prev_{distance}")
        change = F.col(f"dtp_{distance + 1}") - F.col("dtp_1")
        return F.coalesce(F.try_divide(change.cast("double"), days), F.lit(0.0))

    return df.withColumns({"dtp_2_trend": trend(1), "dtp_3_trend": trend(2)})


# ---- values as of the due date --------------------------------------------------------


def _payment_days(payments: DataFrame) -> DataFrame:
    return (
        payments.filter(F.col("payment_date").isNotNull() & F.col(STUDENT).isNotNull())
        .groupBy(F.col(STUDENT).alias(WHO), F.col("payment_date").alias("pay_day"))
        .agg(F.min(CATEGORY).alias("pay_first"), F.nullif(F.max(CATEGORY), F.min(CATEGORY)).alias("pay_last"))
        .withColumn(PIECE, day_piece("pay_day"))
    )


def _last_payment(facts: DataFrame | None = None) -> Facet:
    """Latest payment before the due date in another category than the invoice's.

    Payments are cut to one row per student and day first: two different
    categories on a day are enough to know, so the least and greatest do. Each
    day also keeps the last day on which some other category was paid, which
    answers the invoices of the day's own category. ``pay_last`` is missing where it
    is the first, too. Without ``facts``, another facet brings the days.
    """
    last = F.coalesce("pay_last", "pay_first")
    day = F.struct("pay_day", "pay_first", last.alias("pay_last"))
    paid = F.col("pay_day").isNotNull()
    prior = F.col("__prior")
    turned = (
        (prior["pay_first"] != F.col("pay_first"))
        | (prior["pay_last"] != last)
        | (F.col("pay_first") != last)
    )
    free = (
        (prior["pay_first"] != prior["pay_last"])
        | (F.col("first_cat") != F.col("last_cat"))
        | (F.col("first_cat") != prior["pay_first"])
    )
    return Facet(
        out={
            "last_payment_date": _dated(F.col("__paid_day")),
            "days_since_last_payment": F.coalesce(
                F.datediff("due_date", _dated(F.col("__paid_day"))), F.lit(-1)
            ),
        },
        carry={"__paid_day": F.when(free, prior["pay_day"]).otherwise(F.col("__other_day"))},
        point={"first_cat": F.min(CATEGORY), "last_cat": F.max(CATEGORY)},
        facts=facts,
        steps=(
            {"__prior": F.last(F.when(paid, day), ignorenulls=True).over(_days(-1))},
            {"__other_day": F.max(F.when(paid & turned, prior["pay_day"])).over(_days(-1))},
        ),
    )


def last_payment_date(invoice_rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Latest payment before the due date in another category, and the days since."""
    return along_days(invoice_rows, [_last_payment(_payment_days(payments))])


def _peak_days(
    ledger: DataFrame, amount: str, date: str, out: str, payments: bool = False, buckets: int | None = None
) -> DataFrame:
    """Per student and day: the total of ``amount`` and the peak of its running sum.

    Lines run by category, amount due and amount paid. Among equal leading columns
    ``amount`` only rises, so its running sum falls first and then grows: its first
    and last value hold the peak, and lines can be added up before they are ordered.
    With ``payments``, also the least and greatest category paid on the day. A ledger
    in ``buckets`` by student isn't dealt out again.
    """
    order = [CATEGORY] if amount == "amount_due" else [CATEGORY, "amount_due"]
    lines = ledger.filter(F.col(date).isNotNull() & F.col(STUDENT).isNotNull()).select(
        F.col(STUDENT).alias(WHO), day_piece(date).alias(PIECE), *order, amount
    )
    if not buckets:
        lines = lines.repartition(WHO, PIECE)
    by_order = _inside([F.col(c).asc_nulls_last() for c in order])
    prior = F.sum("__sum").over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    groups = lines.groupBy(WHO, PIECE, *order).agg(
        F.sum(amount).alias("__sum"), F.min(amount).alias("__first"), F.max(F.col(amount) != 0).alias("__moved")
    )
    extra = []
    if payments:
        paid = F.when(F.col("__moved"), F.col(CATEGORY))
        extra = [
            F.date_from_unix_date(F.max(F.when(F.col("__moved"), F.col(PIECE)))).alias("pay_day"),
            F.min(paid).alias("pay_first"),
            F.nullif(F.max(paid), F.min(paid)).alias("pay_last"),
        ]
    total, peak = F.sum("__sum"), F.max("__run")
    return (
        groups.withColumn("__run", F.greatest("__first", "__sum") + F.coalesce(prior, F.lit(0)))
        .groupBy(WHO, PIECE)
        # Most days peak at their total; those leave the peak out.
        .agg(total.alias(f"__total_{out}"), F.when(peak != total, peak).alias(f"__peak_{out}"), *extra)
    )


def _peak(out: str, facts: DataFrame) -> Facet:
    """Greatest running sum per student over lines dated up to the due date."""
    before = F.coalesce(F.sum(f"__total_{out}").over(_days(-1)), F.lit(0))
    return Facet(
        out={out: _dated(F.col(f"__upto_{out}")).cast("decimal(28,4)")},
        carry={f"__upto_{out}": F.col(f"__most_{out}")},
        facts=facts,
        steps=(
            {f"__level_{out}": before + F.coalesce(f"__peak_{out}", f"__total_{out}")},
            {f"__most_{out}": F.max(f"__level_{out}").over(_days(0)).cast("decimal(28,4)")},
        ),
    )


def _due_peak(ledger: DataFrame, buckets: int | None = None) -> Facet:
    out = "amount_due_cumsum"
    return _peak(out, _peak_days(ledger, "amount_due", "due_date", out, buckets=buckets))


def _paid_peak(ledger: DataFrame, payments: bool = False, buckets: int | None = None) -> Facet:
    out = "amount_paid_cumsum"
    return _peak(out, _peak_days(ledger, "amount_paid", "entry_date", out, payments, buckets))


def amount_due_cumsum(invoice_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Greatest sum due so far, over lines due up to the invoice's due date."""
    return along_days(invoice_rows, [_due_peak(ledger)])


def amount_paid_cumsum(invoice_rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Greatest sum paid so far, over lines entered up to the invoice's due date."""
    return along_days(invoice_rows, [_paid_peak(ledger)])


def opening_balance(df: DataFrame) -> DataFrame:
    owed = F.col("amount_due_cumsum") - F.col("amount_paid_cumsum")
    return df.withColumn(
        "opening_balance",
        F.when(owed.isNotNull(), F.greatest(owed, F.lit(0).cast("decimal(28,4)"))).cast("decimal(28,4)"),
    )


# ---- plan, labels, survival columns ---------------------------------------------------


def plan_join(df: DataFrame, enrolled: DataFrame, dedupe: bool = False) -> DataFrame:
    """Left join of the payment plan; a student with two plans in a year gets two rows."""
    plans = enrolled.select(YEAR, STUDENT, "plan_type")
    if dedupe:
        plans = plans.groupBy(YEAR, STUDENT).agg(F.min("plan_type").alias("plan_type"))
    return df.join(plans, [YEAR, STUDENT], "left")


def _plans(enrolled: DataFrame) -> Facet:
    """The rows of ``plan_join`` by way of a list per student: years and fee categories bound it."""
    plans = enrolled.groupBy(F.col(STUDENT).alias(WHO)).agg(F.collect_list(F.struct(YEAR, "plan_type")).alias("__plans"))
    own = F.filter("__plans", lambda x: x[YEAR] == F.col(YEAR))
    return Facet(
        out={"plan_type": F.explode_outer(F.transform(own, lambda x: x["plan_type"]))},
        carry={"__plans": F.filter("__plans", lambda x: x[YEAR].between(F.col("first_year"), F.col("last_year")))},
        point={"first_year": F.min(YEAR), "last_year": F.max(YEAR)},
        student=plans,
    )


def plan_one_hot(df: DataFrame) -> DataFrame:
    """0/1 column per plan, and one for a missing plan, instead of ``plan_type``."""
    columns = {
        f"plan_type_{p}": F.col("plan_type").eqNullSafe(p).cast("double") for p in PLANS
    }
    columns["plan_type_nan"] = F.col("plan_type").isNull().cast("double")
    return df.withColumns(columns).drop("plan_type")


def bracket_of(days: Column) -> Column:
    return (
        F.when(days <= 0, BRACKETS[0])
        .when(days <= 30, BRACKETS[1])
        .when(days <= 60, BRACKETS[2])
        .when(days > 60, BRACKETS[3])
    )


def bracket_code(bracket: Column) -> Column:
    result = None
    for code, name in enumerate(BRACKETS):
        test = bracket == name
        result = F.when(test, code) if result is None else result.when(test, code)
    return result


def dtp_bracket(df: DataFrame) -> DataFrame:
    return df.withColumn("dtp_bracket", bracket_of(F.col(DAYS_LATE)))


def event_flag(df: DataFrame) -> DataFrame:
    """1 where the invoice was paid by the last due date of the table."""
    last_due = df.agg(F.max("due_date")).scalar()
    paid = F.coalesce(F.col("date_fully_paid") <= last_due, F.lit(False))
    return df.withColumn("censor", paid.cast("int"))


def censored_duration(df: DataFrame, observation_end: dt.date) -> DataFrame:
    """Days late, counted to the end of observation while unpaid."""
    end = F.lit(observation_end).cast("date")
    kept = df.filter((F.col("due_date") <= end) | ((F.col("due_date") > end) & F.col("date_fully_paid").isNotNull()))
    open_days = F.datediff(end, F.col("due_date"))
    return kept.withColumn(
        DAYS_LATE,
        F.coalesce(F.when(F.col("censor") == 0, open_days).otherwise(F.col(DAYS_LATE)), F.lit(0)),
    )


def winsorize(df: DataFrame, tail: float = 0.01) -> DataFrame:
    """Clip the days-late columns at their tail quantiles; lags round half to even.

    Twelve numbers, two per column, come back to the driver.
    """
    columns = [*LAGS, "dtp_avg", "dtp_wavg"]
    bounds = {
        (row["feature"], row["p"]): row["quantile"]
        for row in quantiles(df, columns, [tail, 1 - tail]).collect()
    }

    def clipped(column: str) -> Column:
        value = F.col(column).cast("double")
        low, high = bounds.get((column, tail)), bounds.get((column, 1 - tail))
        if low is None:
            return value
        inside = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
        return F.bround(inside, 0).cast("int") if column in LAGS else inside

    return df.withColumns({c: clipped(c) for c in columns})


# ---- engineered features ----------------------------------------------------------------


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"due_month": F.month("due_date"), "due_quarter": F.quarter("due_date")})


def payment_behaviour(df: DataFrame) -> DataFrame:
    ratio = F.try_divide(
        F.col("amount_paid_cumsum").cast("double"), F.col("amount_due_cumsum").cast("double")
    )
    return df.withColumns(
        {
            "opening_balance_flag": F.coalesce(F.col("opening_balance") > 0, F.lit(False)).cast("int"),
            "payment_ratio": ratio,
            "early_payer_flag": (F.col("dtp_1") < 0).cast("double"),
        }
    )


def on_time_streak(df: DataFrame) -> DataFrame:
    """Number of on-time invoices in a row just before this one."""
    return along_days(df, [_streak(F.col("dtp_bracket") == "on_time", "on_time_streak")])


def prev_bracket(df: DataFrame) -> DataFrame:
    """Code 0..3 of the previous invoice's bracket."""
    seen = payment_history(df, {"__prev": ("dtp_bracket", 1)}, 1)
    return seen.withColumn("prev_bracket", bracket_code(F.col("__prev"))).drop("__prev")


def dtp_summary(df: DataFrame) -> DataFrame:
    """Sample deviation (two lags at least) and maximum of the known lags."""
    known = _known_lags()
    mean = _mean(known)
    squares = F.aggregate(
        F.transform(known, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x
    )
    deviation = F.when(F.size(known) >= 2, F.sqrt(squares / (F.size(known) - 1)))
    return df.withColumns(
        {"dtp_rolling_std": deviation, "dtp_max": F.array_max(known).cast("int")}
    )


def plan_label(df: DataFrame) -> Column:
    result = None
    for plan in PLANS:
        test = F.col(f"plan_type_{plan}") == 1
        result = F.when(test, plan) if result is None else result.when(test, plan)
    return result.otherwise("nan")


def plan_risk_fit(df: DataFrame) -> DataFrame:
    """(plan, rate, score): plans ranked by their share of 90_days invoices.

    At most six plans remain after the first aggregation.
    """
    rates = (
        df.filter("dtp_bracket is not null")
        .groupBy(plan_label(df).alias("plan"))
        .agg(F.avg((F.col("dtp_bracket") == "90_days").cast("double")).alias("rate"))
    )
    cuts = [i / RISK_TIERS for i in range(RISK_TIERS + 1)]
    everyone = Window.partitionBy(F.lit(0))
    edges = F.array_distinct(
        F.percentile("rate", F.array(*[F.lit(c) for c in cuts])).over(everyone)
    )
    ranked = rates.withColumns(
        {
            "edges": edges,
            "plans": F.count("*").over(everyone),
            "dense": F.dense_rank().over(everyone.orderBy("rate")) - 1,
        }
    )
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    tier = F.size(F.filter(inner, lambda e: e < F.col("rate")))
    return ranked.select(
        "plan",
        "rate",
        F.when(F.col("plans") >= RISK_TIERS, tier).otherwise(F.col("dense")).cast("int").alias("score"),
    )


def plan_risk_apply(df: DataFrame, risk: DataFrame) -> DataFrame:
    """Stored score per plan, 2 for plans without one. ``risk`` has at most six rows."""
    scores = F.broadcast(risk.select(F.col("plan").alias("__plan"), "score"))
    return (
        df.withColumn("__plan", plan_label(df))
        .join(scores, "__plan", "left")
        .withColumn("plan_type_risk_score", F.coalesce("score", F.lit(FALLBACK_RISK)))
        .drop("__plan", "score")
    )


# ---- filters and column groups ------------------------------------------------------------


def invoice_filters(
    df: DataFrame,
    exclude_school_years: Iterable[int] = (),
    drop_back_account: bool = False,
    drop_fully_paid: bool = False,
    drop_missing_dtp: bool = False,
) -> DataFrame:
    years = list(exclude_school_years)
    if years:
        df = df.filter(~F.coalesce(F.col(YEAR).isin(years), F.lit(False)))
    if drop_back_account:
        df = df.filter(F.coalesce(F.col(CATEGORY) != "Back Account", F.lit(True)))
    if drop_fully_paid:
        df = df.filter("date_fully_paid is null")
    return df.dropna(subset=LAGS) if drop_missing_dtp else df


# Column groups that can be left out.
COLUMN_GROUPS = {
    "helper": [
        "gross_receivables",
        "amount_discounted",
        "adjustments",
        "due_date_prev_1",
        "due_date_prev_2",
        "date_fully_paid",
        "last_payment_date",
        "on_time_streak",
        "prev_bracket",
    ],
    "demographic": [YEAR, STUDENT, CATEGORY],
    "survival": ["censor", DAYS_LATE],
    "plan_type": [*[f"plan_type_{p}" for p in PLANS], "plan_type_nan"],
}


def column_groups(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for group in drop for c in COLUMN_GROUPS[group]])


def consecutive_years(enrolled: DataFrame) -> DataFrame:
    """Running number of adjacent school years per student, refunded years left out.

    Years and fee categories bound a student's rows, so one window holds them.
    """
    kept = enrolled.filter(F.coalesce(F.col("has_refunded") != "Has Refund", F.lit(True)))
    by_year = Window.partitionBy(STUDENT).orderBy(YEAR)
    numbered = (
        kept.select(STUDENT, YEAR)
        .withColumn("__step", F.coalesce(F.col(YEAR) - F.lag(YEAR).over(by_year), F.lit(0)))
        .withColumn("__at", F.row_number().over(by_year))
        .withColumn(
            "__start",
            F.max(F.when(F.col("__step") != 1, F.col("__at"))).over(
                by_year.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(STUDENT, YEAR, (F.col("__at") - F.col("__start") + 1).alias("consecutive_years"))
    )
    return enrolled.join(numbered, [STUDENT, YEAR], "left")


def model_survival_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows without survival columns, and all rows without label and date."""
    labelled = df.filter("censor = 1").drop("censor", DAYS_LATE)
    return labelled, df.drop("dtp_bracket", "due_date")


def _layout(columns: Sequence[str]) -> list[str]:
    """Keys first, then the rest; groups of new columns in the order of the steps above."""
    head = [YEAR, STUDENT, "due_date"]
    late = ["last_payment_date", "days_since_last_payment", "amount_due_cumsum", "amount_paid_cumsum", "opening_balance"]
    plans = [c for c in columns if c.startswith("plan_type_")]
    rest = [c for c in columns if c not in [*head, *late, *plans]]
    return [*head, *rest, *late, *plans]


def invoice_features(
    ledger: DataFrame,
    enrolled: DataFrame,
    observation_end: dt.date,
    *,
    invoice_rows: DataFrame | None = None,
    with_amounts: bool = False,
    engineered: bool = True,
    calendar: bool = True,
    behaviour: bool = True,
    streaks: bool = True,
    summary: bool = True,
    plan_risk: bool = True,
    winsorize_tail: float | None = None,
    risk: DataFrame | None = None,
    exclude_school_years: Iterable[int] = (),
    drop_back_account: bool = False,
    drop_fully_paid: bool = False,
    drop_missing_dtp: bool = False,
    drop_groups: Sequence[str] = (),
    describe: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Ledger and enrollees to the feature table, options as in the single steps.

    The invoices are dealt out once for all that they learn from their student's
    days (``along_days``); the result is a view of one written table. Where ledger,
    enrollees and invoices come in ``buckets`` by student, not even that once.
    """
    df = settle(invoices(ledger, with_amounts, buckets), "zstd", STUDENT, buckets) if invoice_rows is None else invoice_rows
    df = dtp_bracket(days_late(df))
    past = {f"dtp_{k}": (DAYS_LATE, k) for k in range(1, 5)}
    past |= {f"due_date_prev_{k}": ("due_date", k) for k in (1, 2)}
    peaks = [_due_peak(ledger, buckets), _paid_peak(ledger, True, buckets)]
    facets = [_lags(past, 4), *peaks, _last_payment(), _plans(enrolled)]
    if engineered and streaks:
        facets.insert(0, _streak(F.col("dtp_bracket") == "on_time", "on_time_streak"))
    df = along_days(df, facets).withColumn("__prev", bracket_of(F.col("dtp_1")))
    df = plan_one_hot(opening_balance(dtp_trend(dtp_avg_wavg(df))))
    df = settle(df.select(*_layout(df.columns)), "zstd")
    df = censored_duration(event_flag(df), observation_end)
    if winsorize_tail is not None:
        df = winsorize(df, winsorize_tail)
    if engineered:
        if calendar:
            df = calendar_features(df)
        if behaviour:
            df = payment_behaviour(df)
        if streaks:
            df = df.withColumn("prev_bracket", bracket_code(F.col("__prev")))
        if summary:
            df = dtp_summary(df)
        if plan_risk:
            df = plan_risk_apply(df, settle(plan_risk_fit(df)) if risk is None else risk)
    df = invoice_filters(
        df.drop("__prev"), exclude_school_years, drop_back_account, drop_fully_paid, drop_missing_dtp
    )
    df = column_groups(df, drop_groups)
    return category_description(df) if describe else df
