"""Column names and fixed domains shared by every module.

Fixed values: the names and labels below are the published data model, so
results line up with existing reports.
"""

YEAR = "school_year"
STUDENT = "student_id_pseudonimized"
CATEGORY = "category_name"
APPLIED = "discount_refund_applied_to"
KEY = [YEAR, STUDENT, CATEGORY]

BRACKETS = ["on_time", "30_days", "60_days", "90_days"]
PLANS = ["Plan - A", "Plan - B", "Plan - C", "Plan - D", "Plan - E"]
LAGS = ["dtp_1", "dtp_2", "dtp_3", "dtp_4"]
AGING = [
    "prepayments",
    "30_days",
    "60_days",
    "90_days",
    "120_days",
    "150_days",
    "180_days",
    "180_above",
]
METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "roc_auc_macro"]
