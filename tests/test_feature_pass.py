"""The one pass over a student's days, against plain walks, and what it shuffles and writes."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.names import CATEGORY, STUDENT, YEAR
from ledgerlight.operators import features as feat, invoices as inv
from ledgerlight.sources.tables import LEDGER

DAY = dt.date(2020, 1, 1)
END = DAY + dt.timedelta(days=60)


@pytest.fixture(scope="module")
def lines():
    """One student with half of the lines; signs mixed, dates, students and categories missing."""
    rng, rows = random.Random(11), []
    for i in range(500):
        student = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        category = rng.choice(["G01-A-UE", "Books", "Discount - x", "Bus", None])
        due = Decimal(rng.choice([0, 0, 40, 60, 60, -15]))
        paid = Decimal(rng.choice([0, 20, 35, -10])) if due == 0 else Decimal(0)
        posted, owed = (None if rng.random() < 0.04 else DAY + dt.timedelta(days=rng.randrange(40)) for _ in range(2))
        applied = "Books" if category == "Discount - x" else ""
        rows.append((i, posted, owed, 2020 + rng.randrange(2), student, category, applied, due, paid, due - paid, "Cash"))
    return rows


@pytest.fixture(scope="module")
def ledger(spark, lines):
    return spark.createDataFrame(lines, LEDGER).cache()


@pytest.fixture(scope="module")
def enrolled(spark):
    rows = [(2020, "hot", "Plan - A"), (2020, "hot", "Plan - B"), (2021, "hot", None), (2021, "a", "Plan - C"), (None, "b", "Plan - D")]
    return spark.createDataFrame(rows, f"{YEAR} int, {STUDENT} string, plan_type string").cache()


@pytest.fixture(scope="module")
def invoices(spark, ledger):
    rows = [tuple(r) for r in inv.invoices(ledger, True).collect()]
    # Lines without a student, and one without a due date.
    frame = inv.invoices(ledger, True)
    extra = [("due_date", None, rows[0]), (STUDENT, None, rows[1]), (STUDENT, None, rows[2])]
    rows += [tuple(value if c == name else x for c, x in zip(frame.columns, row)) for name, value, row in extra]
    return spark.createDataFrame(rows, frame.schema).cache()


def peak(lines, student, until, amount, date):
    """Greatest running sum over the student's lines, day by day, in the documented order."""
    mine = [r for r in lines if r[4] == student and r[date] is not None and r[date] <= until]
    total = best = None
    for r in sorted(mine, key=lambda r: (r[date], r[5] is None, r[5] or "", r[7], r[8], r[0])):
        total = (total or 0) + r[amount]
        best = total if best is None else max(best, total)
    return best


def test_peaks_equal_a_walk_over_the_lines(ledger, lines, invoices):
    found = feat.amount_paid_cumsum(feat.amount_due_cumsum(invoices, ledger), ledger).collect()
    assert len(found) == invoices.count()
    for r in found:
        known = r[STUDENT] is not None and r["due_date"] is not None
        assert r["amount_due_cumsum"] == (peak(lines, r[STUDENT], r["due_date"], 7, 2) if known else None)
        assert r["amount_paid_cumsum"] == (peak(lines, r[STUDENT], r["due_date"], 8, 1) if known else None)


def test_the_feature_table_equals_its_steps(ledger, enrolled, invoices):
    fused = feat.invoice_features(ledger, enrolled, END, invoice_rows=invoices)
    past = {f"dtp_{k}": (feat.DAYS_LATE, k) for k in range(1, 5)}
    past |= {f"due_date_prev_{k}": ("due_date", k) for k in (1, 2)}
    df = feat.on_time_streak(feat.dtp_bracket(feat.days_late(invoices)))
    df = feat.prev_bracket(feat.dtp_trend(feat.dtp_avg_wavg(feat.payment_history(df, past, 4))))
    df = feat.last_payment_date(df, inv.payments_to_all(ledger))
    df = feat.opening_balance(feat.amount_paid_cumsum(feat.amount_due_cumsum(df, ledger), ledger))
    df = feat.plan_one_hot(feat.plan_join(df, enrolled))
    df = feat.censored_duration(feat.event_flag(df), END)
    steps = feat.dtp_summary(feat.payment_behaviour(feat.calendar_features(df)))
    steps = feat.plan_risk_apply(steps, feat.plan_risk_fit(steps))
    # Invoices that tie in the whole order may take each other's place.
    tie = [STUDENT, *feat.HISTORY_ORDER]
    once = invoices.groupBy(*tie).agg(F.count("*").alias("n")).filter("n = 1").drop("n").collect()
    keep = {tuple(r) for r in once if r[STUDENT] is not None}
    same = [sorted(tuple(repr(r[c]) for c in sorted(fused.columns)) for r in d.collect() if tuple(r[c] for c in tie) in keep) for d in (fused, steps)]
    assert sorted(fused.columns) == sorted(steps.columns)
    assert same[0] and same[0] == same[1]
    assert fused.count() == steps.count()


def test_the_feature_table_is_dealt_out_and_written_once(ledger, enrolled, invoices, monkeypatch):
    plans, settle = [], feat.settle

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, *args)

    monkeypatch.setattr(feat, "settle", watched)
    feat.invoice_features(ledger, enrolled, END, invoice_rows=invoices)
    assert len(plans) == 2  # the table, and the scores of the plans
    assert plans[0].count("Exchange hashpartitioning") <= 8
