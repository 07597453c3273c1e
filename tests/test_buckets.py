"""Stage tables bucketed by student: same rows, no exchange, and none for a student that must be split."""

import datetime as dt
import random

import pytest

from ledgerlight.names import STUDENT
from ledgerlight.operators import features as feat, invoices as inv
from ledgerlight.plans import inputs
from ledgerlight.session import settle
from ledgerlight.sources import tables

END = dt.date(2001, 6, 30)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of 40 customers, some twice, some ids missing."""
    path, rng = str(tmp_path_factory.mktemp("sf")), random.Random(5)
    day = dt.datetime(1996, 1, 1)
    orders = [
        (i if i % 61 else None, rng.randrange(40) if i % 37 else None, rng.choice([100.5, 20.0, None]),
         day + dt.timedelta(days=rng.randrange(900)), rng.choice(["1-URGENT", "2-HIGH", "5-LOW", "", None]))
        for i in range(600)
    ]
    orders += orders[:20]
    lines = [
        (rng.randrange(620), n, rng.randrange(400), rng.choice([10.0, 35.25]), rng.choice([0.0, 0.05]), rng.choice([0.0, 0.08]), rng.choice("ARN"))
        for _ in range(500) for n in range(1, 8)
    ]
    customers = [(k if k else None, k % 25) for k in range(40)]
    for name, rows, layout in [
        ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
        ("customer", customers, "c_custkey long, c_nationkey int"),
    ]:
        spark.createDataFrame(rows, layout).write.parquet(f"{path}/{name}.parquet")
    return path


def shown(df):
    return sorted(tuple(repr(x) for x in r) for r in df.collect())


def test_buckets_change_no_rows_and_need_no_exchange(spark, folder, monkeypatch):
    plain = settle(tables.ledger_view(spark, folder))
    ledger = settle(tables.ledger_view(spark, folder, 3), None, STUDENT, 3)
    assert shown(ledger) == shown(plain)

    plans = []

    def watched(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, *args)

    monkeypatch.setattr(inv, "settle", watched)
    monkeypatch.setattr(feat, "settle", watched)
    monkeypatch.setattr(tables, "BUCKET", 10**6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        enrolled = settle(inputs.clean.enrollees(ledger), None, STUDENT, 3)
        found = feat.invoice_features(ledger, enrolled, END, with_amounts=True, buckets=3)
        # Facts, invoices of several due dates, all invoices, the feature table; then the plans' scores.
        assert len(plans) == 5
        assert [p.count("Exchange") for p in plans[:4]] == [0, 0, 0, 0]
        assert shown(inv.invoices(ledger, True, 3)) == shown(inv.invoices(plain, True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    monkeypatch.undo()
    other = feat.invoice_features(plain, inputs.clean.enrollees(plain), END, with_amounts=True)
    assert found.columns == other.columns
    # Invoices that tie in the whole order may take each other's place, so their past isn't compared.
    own = [c for c in found.columns if c in [STUDENT, *feat.HISTORY_ORDER, "amount_due_cumsum", "amount_paid_cumsum"] or c.startswith("plan_type")]
    assert found.count() and shown(found.select(own)) == shown(other.select(own))


def test_a_student_that_fills_more_than_its_bucket_is_dealt_out_by_day(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 500)
    monkeypatch.setattr(tables, "BUCKET", 2_000)
    assert tables.student_buckets(spark, folder) > 1
    monkeypatch.setattr(tables, "BUCKET", 3)
    assert tables.student_buckets(spark, folder) is None


def test_the_queries_share_a_ledger_in_buckets(spark, folder):
    assert inputs.buckets(spark, folder) >= 1
    assert inputs.feature_rows(spark, folder).count() > 0


def test_a_ledger_whose_buckets_turn_out_uneven_is_read_without_them(spark, folder, monkeypatch):
    monkeypatch.setattr(inputs, "buckets_even", lambda *_: False)
    ledger = inputs.ledger(spark, f"{folder}/")
    assert inputs.buckets(spark, f"{folder}/") is None
    assert "Bucketed: true" not in ledger.groupBy(STUDENT).count()._jdf.queryExecution().executedPlan().toString()
    assert shown(ledger) == shown(tables.ledger_view(spark, folder))
