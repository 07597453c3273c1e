"""Time the headline queries and print one JSON line.

Inputs that other queries build on (ledger, invoices, features, ...) are timed
as queries of their own and then read back, as a deployment would keep them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlight.plans import inputs
from ledgerlight.plans.catalog import queries
from ledgerlight.session import local_session

HEADLINE = [
    "ledger_view",
    "enrollees_build",
    "due_date_override",
    "allocate_discount_adjustment",
    "fifo_settlement_date",
    "invoice_union",
    "aging_invoice_table",
    "dtp_lags",
    "last_payment_date",
    "opening_balance",
    "on_time_streak",
    "winsorize",
    "invoice_features",
    "bad_debts",
    "dso_pct_change",
    "dso_by_plan",
    "negative_balance_students",
    "status_share",
    "class_balance",
    "spearman_vs_target",
    "transition_matrix",
    "roc_auc",
    "mcnemar",
    "results_flat",
    "leaderboard_view",
    "time_split",
    "kaplan_meier",
    "concordance_index",
    "nearest",
    "random_forest",
]
STAGES = {
    "stage_ledger": inputs.ledger,
    "stage_enrolled": inputs.enrolled,
    "stage_invoices": inputs.invoice_rows,
    "stage_aging": inputs.aging_rows,
    "stage_features": inputs.feature_rows,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    registered = queries()
    seconds: dict[str, float] = {}
    for name, stage in STAGES.items():
        start = time.perf_counter()
        stage(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
