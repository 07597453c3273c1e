"""Settlement and allocation against plain walks over the rows, and the documented traps."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.names import CATEGORY, KEY, STUDENT, YEAR
from ledgerlight.operators import clean, features as feat, invoices as inv
from ledgerlight.sources.tables import LEDGER

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def ledger(spark, lines):
    """Lines of (student, category, applied to, due, paid, posted, due day)."""
    rows = []
    for i, (student, category, applied, due, paid, posted, due_day) in enumerate(lines):
        due, paid = Decimal(str(due)), Decimal(str(paid))
        rows.append((i, day(posted), day(due_day), 2020, student, category, applied, due, paid, due - paid, "Cash"))
    return spark.createDataFrame(rows, LEDGER)


def walk_fifo(credits, payments):
    """Pay credits (amount, due) in order with payments (date, amount) in order."""
    left = [a for a, _ in credits]
    paid = [[0, 0, None] for _ in credits]
    for date, amount in sorted(payments):
        for i, (_, due) in enumerate(credits):
            if amount > 0 and left[i] > 0:
                part = min(amount, left[i])
                left[i] -= part
                amount -= part
                paid[i][0] += part
                if date <= due:
                    paid[i][1] += part
                if left[i] == 0:
                    paid[i][2] = date
    return paid


def walk_allocation(gross, discount, adjust):
    out = []
    for g in gross:
        d = min(abs(discount), g) * (1 if discount >= 0 else -1)
        discount -= d
        a = min(abs(adjust), g - d) * (1 if adjust >= 0 else -1)
        adjust -= a
        out.append((d, a))
    return out


@pytest.fixture(scope="module")
def random_groups():
    rng = random.Random(23)
    groups = {}
    for s in range(60):
        n = 1 if s % 7 == 0 else rng.randrange(2, 6)
        size = 200 if s == 0 else n
        dues = [rng.randrange(0, 90) for _ in range(size)]
        gross = [rng.randrange(1, 60) for _ in range(size)]
        discounts = [-rng.randrange(1, 50) for _ in range(rng.randrange(0, 3))]
        adjusts = [-rng.randrange(1, 80) for _ in range(rng.randrange(0, 3))]
        pays = [(rng.randrange(0, 150), rng.randrange(1, 50)) for _ in range(rng.randrange(0, 8))]
        groups[f"s{s}"] = (sorted(zip(dues, gross)), discounts, adjusts, pays)
    return groups


@pytest.fixture(scope="module")
def lines(random_groups):
    out = []
    for student, (charges, discounts, adjusts, pays) in random_groups.items():
        for due, gross in charges:
            out.append((student, "Fee", "", gross, 0, due - 30, due))
        out += [(student, "Discount - X", "Fee", d, 0, 0, 0) for d in discounts]
        out += [(student, "Fee", "", a, 0, 0, 0) for a in adjusts]
        out += [(student, "Fee", "", 0, p, t, 0) for t, p in pays]
    return out


def expected(random_groups):
    out = {}
    for student, (charges, discounts, adjusts, pays) in random_groups.items():
        if len({d for d, _ in charges}) < 2:
            continue
        if sum(g for _, g in charges) + sum(adjusts) == 0:
            continue
        shares = walk_allocation([g for _, g in charges], sum(discounts), sum(adjusts))
        credits = [(g + d + a, due) for (due, g), (d, a) in zip(charges, shares) if g + d + a != 0]
        paid = walk_fifo(credits, pays)
        out[student] = sorted((due, c, total, early, date) for (c, due), (total, early, date) in zip(credits, paid))
    return out


def test_multi_due_dates_match_the_walk(spark, random_groups, lines):
    found = inv.invoices(ledger(spark, lines), True)
    got = {}
    for r in found.collect():
        date = r["date_fully_paid"] and (r["date_fully_paid"] - DAY).days
        got.setdefault(r[STUDENT], []).append(
            ((r["due_date"] - DAY).days, int(r["credit_sale_amount"]), int(r["total_payments"]), int(r["prepayments"]), date)
        )
    wanted = expected(random_groups)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    for student, rows in wanted.items():
        assert sorted(got.get(student, []), key=key) == sorted(rows, key=key), student


def test_fused_and_stepwise_builds_agree(spark, lines):
    base = ledger(spark, lines)
    one = inv.invoices(base, True).drop("adjusted_credit_amount", "net_receivables")
    two = inv.invoices_single(base, True).unionByName(inv.invoices_multi(base, True)).fillna(0)
    assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))


def test_money_is_conserved(spark, random_groups, lines):
    found = inv.fifo(
        inv.credit_sales_multi(ledger(spark, lines)), inv.payments_to_receivables(ledger(spark, lines))
    )
    totals = {}
    for r in found.collect():
        credit, paid = totals.get(r[STUDENT], (0, 0))
        totals[r[STUDENT]] = (credit + max(r["credit_sale_amount"], 0), paid + r["total_payments"])
    for student, (credit, paid) in totals.items():
        assert paid == min(credit, sum(p for _, p in random_groups[student][3]))


def test_single_due_date_is_paid_at_its_last_payment(spark):
    base = ledger(spark, [("a", "Fee", "", 100, 0, 0, 30), ("a", "Fee", "", 0, 10, 5, 30), ("a", "Fee", "", 0, 20, 40, 30)])
    row = inv.invoices(base, True).head()
    assert row["date_fully_paid"] == day(40)
    assert (row["prepayments"], row["total_payments"], row["net_receivables"]) == (10, 30, 70)


def test_unpaid_invoice_of_a_key_without_payments(spark):
    base = ledger(spark, [("a", "Fee", "", 100, 0, 0, 30), ("a", "Fee", "", 50, 0, 0, 60)])
    rows = inv.invoices(base, True).collect()
    assert [(r["date_fully_paid"], r["total_payments"]) for r in rows] == [(None, 0), (None, 0)]


def test_cancelled_keys_refunds_and_overpayments_make_no_invoice(spark):
    base = ledger(
        spark,
        [
            ("a", "Fee", "", 100, 0, 0, 30),
            ("a", "Fee", "", -100, 0, 1, 30),
            ("b", "Overpayment", "", 10, 0, 0, 30),
            ("c", "Refund", "Fee", 10, 0, 0, 30),
            ("d", "Fee", "", 10, 0, 0, None),
        ],
    )
    assert inv.invoices(base).count() == 0


def test_missing_due_date_inside_a_multi_key_comes_last(spark):
    base = ledger(
        spark,
        [
            ("a", "Fee", "", 10, 0, 0, 30),
            ("a", "Fee", "", 10, 0, 0, 60),
            ("a", "Fee", "", 10, 0, 0, None),
            ("a", "Fee", "", 0, 25, 10, 30),
        ],
    )
    got = {r["due_date"]: (r["total_payments"], r["prepayments"]) for r in inv.invoices(base, True).collect()}
    assert got == {day(30): (10, 10), day(60): (10, 10), None: (5, 0)}


def test_payments_of_zero_or_less_settle_nothing(spark):
    base = ledger(
        spark,
        [("a", "Fee", "", 10, 0, 0, 30), ("a", "Fee", "", 10, 0, 0, 60), ("a", "Fee", "", -20, -5, 3, 30), ("a", "Fee", "", 0, 10, 9, 30)],
    )
    rows = inv.fifo(inv.credit_sales_multi(base), inv.payments_to_receivables(base)).collect()
    assert sum(r["total_payments"] for r in rows) <= 10


def test_pooled_aging_puts_the_sum_at_the_last_payment(spark):
    base = ledger(
        spark,
        [("a", "Fee", "", 10, 0, 0, 30), ("a", "Fee", "", 10, 0, 0, 60), ("a", "Fee", "", 0, 5, 0, 30), ("a", "Fee", "", 0, 10, 100, 30)],
    )
    got = {r["due_date"]: (r["90_days"], r["60_days"], r["prepayments"]) for r in inv.aging_invoice_table(base).collect()}
    assert got == {day(30): (10, 0, 0), day(60): (0, 5, 0)}


def test_descriptions(spark):
    texts = {
        "G01-A-UE": "Tuition fee (G01) - Upon enrollment",
        "G02-D-10th": "Tuition fee (G02) - 10 of 10 payments",
        "G02-D-1st": "Tuition fee (G02) - 1 of 10 payments",
        "G03-OF-3rd": "Miscellaneous fees - 3 of 3 payments",
        "Events - Fair": "Fair",
        "Locker - Big": "Locker rental (big)",
        "Graduation - Others": "Graduation fee (Miscellaneous)",
        "Uniform - Students - P.E.": "P.E. Uniform",
        "Something": "Something",
    }
    frame = spark.createDataFrame([(t,) for t in texts], f"{CATEGORY} string")
    got = {r[CATEGORY]: r["description"] for r in inv.category_description(frame).collect()}
    assert got == texts


# ---- features ------------------------------------------------------------------------------------


def invoice(spark, rows):
    schema = (
        f"{YEAR} int, {STUDENT} string, {CATEGORY} string, due_date date, date_fully_paid date, "
        "credit_sale_amount decimal(28,4), gross_receivables decimal(28,4)"
    )
    return spark.createDataFrame(
        [(2020, s, c, day(d), day(p), Decimal(a), Decimal(a)) for s, c, d, p, a in rows], schema
    )


def test_lags_trend_and_early_payer(spark):
    rows = invoice(spark, [("a", "X", 0, 10, 1), ("a", "X", 30, 25, 1), ("a", "X", 60, None, 1), ("a", "X", 90, 90, 1)])
    past = {f"dtp_{k}": (feat.DAYS_LATE, k) for k in range(1, 5)}
    past |= {f"due_date_prev_{k}": ("due_date", k) for k in (1, 2)}
    found = feat.dtp_trend(feat.dtp_avg_wavg(feat.payment_history(feat.days_late(rows), past, 4)))
    got = {r["due_date"]: r for r in found.collect()}
    third, last = got[day(60)], got[day(90)]
    assert (third["dtp_1"], third["dtp_2"]) == (-5, 10)
    assert third["dtp_2_trend"] == pytest.approx((10 - -5) / 30)
    assert (last["dtp_1"], last["dtp_avg"]) == (None, 2.5)
    assert last["dtp_wavg"] == pytest.approx(0.3 * -5 + 0.2 * 10)
    assert last["dtp_2_trend"] == 0


def test_last_payment_ignores_the_own_category(spark):
    rows = invoice(spark, [("a", "X", 100, None, 1), ("a", "Y", 100, None, 1), ("b", "X", 100, None, 1), ("c", "X", 100, None, 1)])
    pays = spark.createDataFrame(
        [("a", "X", day(50)), ("a", "Y", day(40)), ("b", "X", day(90)), ("b", "X", day(80)), ("b", "Z", day(20)), ("c", "X", day(10)), ("b", "Z", day(100))],
        f"{STUDENT} string, {CATEGORY} string, payment_date date",
    )
    got = {(r[STUDENT], r[CATEGORY]): (r["last_payment_date"], r["days_since_last_payment"]) for r in feat.last_payment_date(rows, pays).collect()}
    assert got[("a", "X")] == got[("a", "Y")] == (day(50), 50)  # shared per student and due date
    assert got[("b", "X")] == (day(20), 80)
    assert got[("c", "X")] == (None, -1)


def test_cumulative_sums_take_the_peak(spark):
    base = ledger(spark, [("a", "A", "", 100, 0, 0, 10), ("a", "B", "", -60, 0, 0, 20), ("a", "C", "", 5, 0, 0, 90)])
    rows = invoice(spark, [("a", "A", 30, None, 1), ("a", "A", 5, None, 1)])
    got = {r["due_date"]: r["amount_due_cumsum"] for r in feat.amount_due_cumsum(rows, base).collect()}
    assert got == {day(30): 100, day(5): None}


def test_event_and_duration(spark):
    rows = invoice(spark, [("a", "X", 0, 50, 1), ("a", "X", 40, None, 1), ("a", "X", 45, 46, 1), ("a", "X", 41, None, 1)])
    found = feat.censored_duration(feat.event_flag(feat.days_late(rows)), day(40))
    got = {r["due_date"]: (r["censor"], r[feat.DAYS_LATE]) for r in found.collect()}
    assert got == {day(0): (0, 40), day(40): (0, 0), day(45): (0, -5)}


def test_consecutive_years(spark):
    rows = [("a", y, "No Refund") for y in (2018, 2019, 2021, 2022)] + [("a", 2020, "Has Refund"), ("b", 2019, "No Refund"), ("b", 2019, "No Refund")]
    frame = spark.createDataFrame(rows, f"{STUDENT} string, {YEAR} int, has_refunded string")
    got = sorted((r[STUDENT], r[YEAR], r["consecutive_years"] or 0) for r in feat.consecutive_years(frame).collect())
    assert got == [("a", 2018, 1), ("a", 2019, 2), ("a", 2020, 0), ("a", 2021, 1), ("a", 2022, 2)] + [("b", 2019, 1)] * 4


# ---- cleaning --------------------------------------------------------------------------------------


def test_accounts(spark):
    names = {"Cash on Hand": "Cash", "PNB ": "Bank", "BDO Unibank - 12-34": "Bank", "Gcash - 09": "G-Cash", "": "Not Applicable", None: "Not Applicable", "Vault": "Vault"}
    frame = spark.createDataFrame([(n,) for n in names], "account_name string").withColumn("was", __import__("pyspark.sql.functions", fromlist=["col"]).col("account_name"))
    assert {r["was"]: r["account_name"] for r in clean.account_normalize(frame).collect()} == names


def test_override_takes_the_first_match(spark):
    base = ledger(spark, [("a", "G01-A-UE", "", 10, 0, 0, 5), ("a", "G01-A-UE", "", 0, 5, 0, 50), ("a", "G01-A-UE", "", 0, 5, 0, 5), ("a", "Discount", "G01-A-UE", -1, 0, 0, 5), ("a", "Books", "", 1, 0, 0, 5)])
    rules = spark.createDataFrame([(2020, "-A-", day(20), 0), (2020, "-UE", day(99), 1)], f"{YEAR} int, plan_type string, due_on date, position int")
    got = [r["due_date"] for r in clean.due_date_override(base, rules).orderBy("entry_number").collect()]
    assert got == [day(20), day(50), day(20), day(20), day(5)]


def test_aliases_are_unique_and_stable(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(200)], "original_id string")
    known = spark.createDataFrame([("7", "KNOWN007")], "original_id string, alias string")
    one = {r[0]: r[1] for r in clean.pseudonym_table(ids, known, "s").collect()}
    two = {r[0]: r[1] for r in clean.pseudonym_table(ids, known, "s").collect()}
    assert one == two and one["7"] == "KNOWN007" and len(set(one.values())) == len(one) == 200


def test_alias_dictionary_only_grows(spark, tmp_path):
    def ids(low, high):
        return spark.createDataFrame([(str(k),) for k in range(low, high)] * 2 + [(None,)], "original_id string")

    path = str(tmp_path / "aliases")
    # One character is far too short, so most ids have to try longer ones.
    first = {r[0]: r[1] for r in clean.extend_pseudonyms(ids(0, 120), path, "s", length=1).collect()}
    assert len(first) == 120 == len(set(first.values())) and max(map(len, first.values())) > 1
    rows = clean.extend_pseudonyms(ids(100, 300), path, "s", length=1).collect()
    second = {r[0]: r[1] for r in rows}
    assert len(rows) == 300 == len(set(second.values())) and second.items() >= first.items()
    assert clean.extend_pseudonyms(ids(0, 300), path, "s", length=1).count() == 300
    assert clean.new_pseudonyms(ids(0, 0), None, "s").count() == 0
    long = ids(0, 1).filter("original_id is not null").select(clean._alias(F.col("original_id"), "s", 70).alias("a")).head()["a"]
    assert len(long) == 70 and long.startswith(second["0"])
