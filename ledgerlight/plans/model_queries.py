"""Queries of model preparation, reduction, survival and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.names import BRACKETS, METRICS
from ledgerlight.operators import cox as hazards, discriminant as dis, evaluate as ev, experiments as ex, features as feat
from ledgerlight.operators import models as mod, prepare as prep, scoring as sco, survival as sur
from ledgerlight.functions.neighbours import nearest
from ledgerlight.plans.inputs import OBSERVATION_END, buckets, enrolled, feature_rows, ledger
from ledgerlight.plans.ledger_queries import KEYS
from ledgerlight.plans.registry import part, query, staged
from ledgerlight.plans.result_queries import scratch
from ledgerlight.session import settle
from ledgerlight.sources.results import results_read
from ledgerlight.sources.tables import table

COLUMNS = [
    "dtp_1",
    "dtp_2",
    "dtp_avg",
    "dtp_wavg",
    "opening_balance",
    "payment_ratio",
    "due_month",
    "on_time_streak",
    "days_since_last_payment",
    "plan_type_risk_score",
]
SURVIVAL = ["dtp_avg", "opening_balance", "payment_ratio", "on_time_streak"]
ORDER = ["student_id_pseudonimized", "school_year", "category_name", "credit_sale_amount", "gross_receivables", "plan_type_nan", *[f"plan_type_{p}" for p in feat.PLANS]]
ORDER_SQL = ", ".join(f'"{c}"' for c in ORDER)


def rows(spark, sf):
    """Labelled rows with an id, missing numbers 0."""

    def build():
        coded = prep.encode_label(feature_rows(spark, sf)).filter("label >= 0 and censor = 1")
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COLUMNS]
        return coded.select(sco.row_id(coded).alias("id"), "due_date", "label", *numbers)

    return staged(spark, sf, "model_rows", build)


def split(spark, sf):
    """Earlier 80 % and later 20 % of the labelled rows, by date and id."""

    def one(test: bool):
        keyed = rows(spark, sf).withColumn("text_id", F.lpad(F.hex("id"), 16, "0"))
        return prep.time_split(keyed, ["text_id"])[1 if test else 0]

    return (
        staged(spark, sf, "train", lambda: one(False)),
        staged(spark, sf, "test", lambda: one(True)),
    )


def lifetimes(spark, sf):
    """Durations in days and events of all invoices, with the Cox columns."""

    def build():
        found = feature_rows(spark, sf)
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SURVIVAL]
        return found.select(
            sco.row_id(found).alias("id"),
            F.col(feat.DAYS_LATE).cast("double").alias("T"),
            F.col("censor").alias("E"),
            *numbers,
        )

    return staged(spark, sf, "lifetimes", build)


part("labelled", """SELECT *, CASE dtp_bracket WHEN 'on_time' THEN 0 WHEN '30_days' THEN 1 WHEN '60_days' THEN 2
  WHEN '90_days' THEN 3 ELSE -1 END AS label FROM features""")


@query("encode_label", f"{KEYS};due_date:d;label:i", "SELECT * FROM labelled")
def _(spark, sf):
    return prep.encode_label(feature_rows(spark, sf))


@query("decode_label", f"{KEYS};due_date:d;label:i;bracket:s", "SELECT *, dtp_bracket AS bracket FROM labelled")
def _(spark, sf):
    return prep.decode_label(prep.encode_label(feature_rows(spark, sf)), "label")


@query(
    "time_split",
    "part:s;" + KEYS + ";due_date:d",
    f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY due_date, {ORDER_SQL})
  <= floor((SELECT count(*) FROM features) * 0.8) THEN 'train' ELSE 'test' END AS part FROM features""",
)
def _(spark, sf):
    train, test = prep.time_split(feature_rows(spark, sf), ORDER)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


NUMERIC = ["dtp_1", "dtp_avg", "opening_balance", "due_month", "plan_type_nan", "censor"]


@query(
    "full_dataset",
    "due_date:d;" + ";".join(f"{c}:f" for c in NUMERIC),
    "SELECT * FROM features",
)
def _(spark, sf):
    return prep.full_dataset(feature_rows(spark, sf), ["due_date"])


SCALED = ["dtp_avg", "dtp_wavg", "payment_ratio", "due_month"]


@query(
    "standardize",
    f"{KEYS};due_date:d;" + ";".join(f"{c}:f" for c in SCALED),
    "SELECT f.* REPLACE ({}) FROM features f, (SELECT {} FROM features WHERE censor = 1)".format(
        ", ".join(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS {c}" for c in SCALED),
        ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in SCALED),
    ),
)
def _(spark, sf):
    found = feature_rows(spark, sf)
    return prep.standardize_fit(found.filter("censor = 1"), SCALED).apply(found)


@query(
    "hybrid_balance",
    "label:i;n:i;distinct_rows:i",
    """WITH c AS (SELECT label, count(*) AS n FROM labelled WHERE label >= 0 AND censor = 1 GROUP BY ALL),
t AS (SELECT CAST(floor(min(n) / 0.7) AS BIGINT) AS n FROM c)
SELECT label, t.n, least(c.n, t.n) AS distinct_rows FROM c, t""",
)
def _(spark, sf):
    made = prep.hybrid_balance(rows(spark, sf), 0.7, "id")
    return made.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_rows"))


# ---- embeddings as a numeric matrix -----------------------------------------------------------


def points(spark, sf):
    found = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.least(F.col("label"), F.lit(3)).alias("label"),
    )
    return staged(spark, sf, "points", lambda: found)


part(
    "points4",
    "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, least(label, 3) AS label FROM embeddings",
)
part(
    "near5",
    """SELECT query, id, distance, rank, label FROM (SELECT a.id AS query, b.id, b.label,
  list_distance(a.vec, b.vec) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank
FROM points4 a JOIN points4 b ON a.id <> b.id) WHERE rank <= 5""",
)


@query("nearest", "query:i;id:i;distance:f;rank:i", "SELECT * FROM near5")
def _(spark, sf):
    found = points(spark, sf)
    return nearest(found, found, 5)


@query(
    "knn_classify",
    "id:i;p0:f;p1:f;p2:f;p3:f;prediction:i",
    """SELECT *, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS prediction
FROM (SELECT query AS id, {} FROM near5 GROUP BY query)""".format(
        ", ".join(f"count(*) FILTER (WHERE label = {c}) / 5.0 AS p{c}" for c in range(4))
    ),
)
def _(spark, sf):
    found = points(spark, sf)
    scored = mod.KNearest(found, ["vec"], 5)
    near = nearest(found, found, 5)
    votes = scored.vote(near)
    return votes.select(
        "id",
        *[F.get("probability", F.lit(c)).alias(f"p{c}") for c in range(4)],
        mod.predicted(F.col("probability")).alias("prediction"),
    )


FULL = """WITH c AS (SELECT label, count(*) AS n FROM points4 GROUP BY ALL)
SELECT label, (SELECT max(n) FROM c) AS n FROM c"""


def _sizes(df):
    return df.groupBy("label").agg(F.count("*").alias("n"))


@query("smote", "label:i;n:i", FULL)
def _(spark, sf):
    return _sizes(prep.smote(points(spark, sf)))


@query("borderline_smote", "label:i;n:i")
def _(spark, sf):
    return _sizes(prep.borderline_smote(points(spark, sf)))


@query("smote_tomek", "label:i;n:i")
def _(spark, sf):
    return _sizes(prep.smote_tomek(points(spark, sf)))


@query("smote_enn", "label:i;n:i")
def _(spark, sf):
    return _sizes(prep.smote_enn(points(spark, sf)))


@query(
    "resample_dispatch",
    "strategy:s;label:i;n:i",
    """WITH c AS (SELECT label, count(*) AS n FROM points4 GROUP BY ALL)
SELECT 'none' AS strategy, label, n FROM c UNION ALL SELECT 'smote', label, (SELECT max(n) FROM c) FROM c
UNION ALL SELECT 'hybrid', label, (SELECT CAST(floor(min(n) / 0.5) AS BIGINT) FROM c) FROM c""",
)
def _(spark, sf):
    result = None
    for strategy in ("none", "smote", "hybrid"):
        one = _sizes(prep.resample(points(spark, sf), strategy)).withColumn("strategy", F.lit(strategy))
        result = one if result is None else result.unionByName(one)
    return result


# ---- discriminants -------------------------------------------------------------------------------

MONEY = ["opening_balance", "net_receivables"]


@query(
    "log1p_shift",
    f"{KEYS};due_date:d;opening_balance:f;net_receivables:f",
    """SELECT f.* REPLACE (ln(1 + CAST(opening_balance AS DOUBLE) + a) AS opening_balance,
  ln(1 + CAST(net_receivables AS DOUBLE) + b) AS net_receivables)
FROM features f, (SELECT greatest(0, -min(CAST(opening_balance AS DOUBLE))) AS a,
  greatest(0, -min(CAST(net_receivables AS DOUBLE))) AS b FROM features)""",
)
def _(spark, sf):
    found = feature_rows(spark, sf)
    return dis.log1p_shift(found, dis.log1p_fit(found, MONEY))


FISHER = ["dtp_avg", "opening_balance", "net_receivables", "due_month"]


def _fisher_sql(c: str) -> str:
    shown = f"ln(1 + CAST({c} AS DOUBLE) + (SELECT greatest(0, -min(CAST({c} AS DOUBLE))) FROM features))" if c in MONEY else f"CAST({c} AS DOUBLE)"

    def ratio(v: str) -> str:
        return f"""(SELECT (sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) * (sum(n * m) / sum(n))) / (sum(n * v) / sum(n))
FROM (SELECT count(x) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM (SELECT dtp_bracket, {v} AS x FROM features
  WHERE dtp_bracket IS NOT NULL) WHERE x IS NOT NULL GROUP BY dtp_bracket))"""

    return f"SELECT '{c}' AS feature, {ratio(f'CAST({c} AS DOUBLE)')} AS before, {ratio(shown)} AS after"


@query(
    "fisher_separation",
    "feature:s;before:f;after:f;gain_pct:f",
    "SELECT *, (after / before - 1) * 100 AS gain_pct FROM ("
    + " UNION ALL ".join(_fisher_sql(c) for c in FISHER)
    + ")",
)
def _(spark, sf):
    return dis.fisher_separation(feature_rows(spark, sf), FISHER, "dtp_bracket", MONEY)


@query("lda_fit", "discriminant:s;ratio:f")
def _(spark, sf):
    return dis.lda_fit(rows(spark, sf), COLUMNS).ratio_table(spark)


@query("lda_transform", "id:i;label:i;LD1:f;LD2:f;LD3:f")
def _(spark, sf):
    return dis.lda_fit(rows(spark, sf), COLUMNS).transform(rows(spark, sf), "replace")


@query("lda_coefficients", "feature:s;class:s;coefficient:f")
def _(spark, sf):
    return dis.lda_fit(rows(spark, sf), COLUMNS, classes=[1, 2, 3]).coefficient_table(spark)


@query("pca_reduce", "id:i;label:i;c1:f;c2:f;c3:f")
def _(spark, sf):
    reduced, _ = dis.pca_reduce(rows(spark, sf), COLUMNS, 3)
    return reduced.select("id", "label", *[F.get("components", F.lit(i)).alias(f"c{i + 1}") for i in range(3)])


@query("reduction_validation", "method:s;components:i;f1:f;train_f1:f;gap:f;keeps_95:s")
def _(spark, sf):
    return dis.reduction_validation(rows(spark, sf), COLUMNS, [3], folds=2, trees=5)


# ---- survival ------------------------------------------------------------------------------------


part("lives", "SELECT *, CAST(days_elapsed_until_fully_paid AS DOUBLE) AS T, censor AS E FROM features")


@query(
    "adjust_duration",
    f"{KEYS};T:f",
    "SELECT * REPLACE (T - (SELECT min(T) FROM lives) + 1e-6 AS T) FROM lives",
)
def _(spark, sf):
    return sur.adjust_duration(feature_rows(spark, sf).withColumn("T", F.col(feat.DAYS_LATE).cast("double")))


@query(
    "survival_clean",
    "T:f;E:i;dtp_avg:f;payment_ratio:f",
    """SELECT T, E, coalesce((dtp_avg - ma) / sa, 0) AS dtp_avg, coalesce((payment_ratio - mb) / sb, 0) AS payment_ratio
FROM lives, (SELECT avg(dtp_avg) AS ma, stddev_pop(dtp_avg) AS sa, avg(payment_ratio) AS mb,
  stddev_pop(payment_ratio) AS sb FROM features)""",
)
def _(spark, sf):
    found = feature_rows(spark, sf).withColumns({"T": F.col(feat.DAYS_LATE).cast("double"), "E": F.col("censor")})
    return sur.survival_clean(found, ["dtp_avg", "payment_ratio"])[0]


@query(
    "kaplan_meier",
    "time:f;at_risk:i;deaths:i;survival:f",
    """SELECT time, at_risk, deaths, exp(sum(ln(greatest(1 - deaths / at_risk, 1e-300))) OVER (ORDER BY time)) AS survival
FROM (SELECT time, deaths, sum(n) OVER (ORDER BY time DESC) AS at_risk
  FROM (SELECT T AS time, count(*) AS n, sum(E) AS deaths FROM lives GROUP BY T))""",
)
def _(spark, sf):
    return sur.kaplan_meier(lifetimes(spark, sf))


def _positive(spark, sf):
    """Durations made positive, whole days."""
    return lifetimes(spark, sf).withColumn("T", F.col("T") - lifetimes(spark, sf).agg(F.min("T")).scalar())


def time_points(spark, sf) -> list[int]:
    return sur.steepest_times(sur.kaplan_meier(_positive(spark, sf)))


part("positive_lives", "SELECT * REPLACE (T - (SELECT min(T) FROM lives) AS T) FROM lives")
part(
    "drops",
    """SELECT lag(time) OVER (ORDER BY time) AS time, abs(survival - lag(survival) OVER (ORDER BY time)) AS fall
FROM (SELECT time, exp(sum(ln(greatest(1 - deaths / at_risk, 1e-300))) OVER (ORDER BY time)) AS survival
  FROM (SELECT time, deaths, sum(n) OVER (ORDER BY time DESC) AS at_risk
    FROM (SELECT T AS time, count(*) AS n, sum(E) AS deaths FROM positive_lives GROUP BY T)))
QUALIFY lag(time) OVER (ORDER BY time) IS NOT NULL""",
)
for k in range(1, 7):
    far = "".join(f" AND abs(time - (SELECT time FROM steep_{j})) >= 14" for j in range(1, k))
    part(f"steep_{k}", f"SELECT time FROM drops WHERE true{far} ORDER BY fall DESC, time DESC LIMIT 1")


@query(
    "steepest_times",
    "time_point:i",
    "SELECT CASE WHEN time = 0 THEN 1 ELSE time END AS time_point FROM ("
    + " UNION ALL ".join(f"SELECT time FROM steep_{k}" for k in range(1, 7))
    + ")",
)
def _(spark, sf):
    return spark.createDataFrame([(t,) for t in time_points(spark, sf)], "time_point int")


def cox(spark, sf) -> hazards.Cox:
    scaled, scaler = sur.survival_clean(_positive(spark, sf), SURVIVAL)
    return hazards.cox_elastic_net_fit(scaled.select("T", "E", *SURVIVAL), scaler)


@query("cox_elastic_net_fit", "feature:s;beta:f")
def _(spark, sf):
    found = cox(spark, sf)
    return spark.createDataFrame(list(zip(SURVIVAL, found.beta)), "feature string, beta double")


@query("baseline_hazard", "time:f;hazard:f")
def _(spark, sf):
    return cox(spark, sf).baseline


@query("survival_features", "id:i;surv_prob_30:f;cum_hazard_30:f;partial_hazard:f;log_partial_hazard:f;expected_survival_time:f")
def _(spark, sf):
    return hazards.survival_features(lifetimes(spark, sf), cox(spark, sf), [30, 60])


@query(
    "median_impute",
    f"{KEYS};due_date:d;dtp_1:f;payment_ratio:f",
    """SELECT f.* REPLACE (coalesce(CAST(dtp_1 AS DOUBLE), a) AS dtp_1, coalesce(payment_ratio, b) AS payment_ratio)
FROM features f, (SELECT quantile_cont(CAST(dtp_1 AS DOUBLE), 0.5) AS a, quantile_cont(payment_ratio, 0.5) AS b
  FROM features WHERE censor = 1)""",
)
def _(spark, sf):
    found = feature_rows(spark, sf)
    return sur.median_impute(found, ["dtp_1", "payment_ratio"], found.filter("censor = 1"))


@query(
    "concordance_index",
    "comparable:i;concordant:i;tied:i;c_index:f",
    """SELECT comparable, concordant, tied, (concordant + tied / 2) / comparable AS c_index FROM (
SELECT count(*) AS comparable, count(*) FILTER (WHERE a.r > b.r) AS concordant, count(*) FILTER (WHERE a.r = b.r) AS tied
FROM (SELECT T AS t, E AS e, -coalesce(dtp_avg, 0) AS r FROM lives) a
JOIN (SELECT T AS t, E AS e, -coalesce(dtp_avg, 0) AS r FROM lives) b
ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0)))""",
)
def _(spark, sf):
    rated = _positive(spark, sf).withColumn("risk", -F.col("dtp_avg"))
    return sur.concordance_index(rated, "T", "E", "risk")


@query("cox_grid_search", "alpha:f;l1_ratio:f;mean_c:f;std_c:f;folds:i;failed:i;converged:i")
def _(spark, sf):
    return hazards.cox_grid_search(_positive(spark, sf), SURVIVAL, "id")


# ---- classifiers ---------------------------------------------------------------------------------

SCORES = ";".join(f"{m}:f" for m in METRICS)


def _scores(spark, sf, model):
    _, test = split(spark, sf)
    return ev.evaluation(settle(model.transform(test).select("label", "prediction", "probability")))


def _classifier(name, fit, **settings):
    @query(name, SCORES)
    def _(spark, sf):
        train, _ = split(spark, sf)
        return _scores(spark, sf, fit(train, COLUMNS, **settings))


_classifier("decision_tree", mod.decision_tree)
_classifier("random_forest", mod.random_forest, trees=10)
_classifier("adaboost", mod.adaboost, rounds=3)
_classifier("gaussian_nb", mod.gaussian_nb)
_classifier("gradient_boosting", mod.gradient_boosting, rounds=10, rows=0.8, columns=0.8, min_weight=3.0)
_classifier("ordinal_classifier", mod.ordinal_classifier, trees=5)
_classifier("two_stage_classifier", mod.two_stage_classifier, lda=(False, True))
_classifier("stacked_ensemble", mod.stacked_ensemble)

part(
    "fractions",
    """SELECT row_id, probability[1] AS a, probability[2] AS b, probability[3] AS c, probability[4] AS d FROM scored""",
)
FOUR = "row_id:i;p0:f;p1:f;p2:f;p3:f"


def _four(df):
    return df.select("row_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(4)])


@query(
    "ordinal_combine",
    FOUR,
    """SELECT row_id, (1 - a) / s AS p0, (a - x) / s AS p1, (x - y) / s AS p2, y / s AS p3
FROM (SELECT *, (((1 - a) + (a - x)) + (x - y)) + y AS s
  FROM (SELECT *, least(b, a) AS x, least(c, b, a) AS y FROM fractions))""",
)
def _(spark, sf):
    from ledgerlight.plans.result_queries import scored

    above = [F.get("probability", F.lit(i)) for i in range(3)]
    return _four(scored(spark, sf).withColumn("p", mod.ordinal_combine(above)))


@query(
    "two_stage_combine",
    FOUR,
    """SELECT row_id, (1 - a) / s AS p0, a * b / s AS p1, a * c / s AS p2, a * d / s AS p3
FROM (SELECT *, (((1 - a) + a * b) + a * c) + a * d AS s FROM (SELECT * REPLACE ((a + 1) / 3 AS a) FROM fractions))""",
)
def _(spark, sf):
    from ledgerlight.plans.result_queries import scored

    given = F.slice("probability", 2, 3)
    p = mod.two_stage_combine((F.get("probability", F.lit(0)) + 1) / 3, given)
    return _four(scored(spark, sf).withColumn("p", p))


@query("select_from_model", "stage:s;feature:s;weight:f;method:s;parameters:s")
def _(spark, sf):
    train, _ = split(spark, sf)
    weights = mod.random_forest(train, COLUMNS, trees=5).importances()
    kept = mod.select_from_model(weights, "median")
    return mod.feature_weights_table(spark, {c: weights[c] for c in kept}, "importance", "threshold='median'")


GNB = ["dtp_avg", "dtp_wavg", "payment_ratio", "due_month"]


@query(
    "gnb_influence",
    "feature:s;influence:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (max(m) - min(m)) / avg(v) AS influence FROM (
SELECT avg(CAST({c} AS DOUBLE)) AS m, var_pop(CAST({c} AS DOUBLE)) AS v FROM features WHERE dtp_bracket IS NOT NULL GROUP BY dtp_bracket)"""
        for c in GNB
    ),
)
def _(spark, sf):
    return mod.gnb_influence(feature_rows(spark, sf), GNB, "dtp_bracket")


@query("permutation_importance", "feature:s;importance:f;spread:f")
def _(spark, sf):
    train, test = split(spark, sf)
    model = mod.decision_tree(train, COLUMNS)
    return mod.permutation_importance(model, test, COLUMNS)


@query("feature_weights_table", "stage:s;feature:s;weight:f;method:s;parameters:s")
def _(spark, sf):
    train, _ = split(spark, sf)
    model = mod.two_stage_classifier(train, COLUMNS, first=mod.decision_tree, second=mod.decision_tree)
    weights = {"stage_1": model.first.importances(), "stage_2": model.second.importances()}
    return mod.feature_weights_table(spark, weights, "importance")


def _grid(spark, sf):
    from ledgerlight.plans.result_queries import tables

    finished = tables(spark, sf)["experiments"].withColumn("parameters", F.lit("{}"))
    settings = {m: [{}] for m in ("decision_tree", "gaussian_naive_bayes", "unseen_model")}
    return sco.experiment_matrix(spark, settings, ["none", "smote", "hybrid"], finished=finished)


@query(
    "experiment_matrix",
    "model:s;parameters:s;balance_strategy:s;undersample_threshold:f",
    """SELECT model, '{}' AS parameters, s AS balance_strategy, t AS undersample_threshold FROM
(SELECT unnest(['decision_tree', 'gaussian_naive_bayes', 'unseen_model']) AS model),
(VALUES ('none', NULL), ('smote', NULL), ('hybrid', 0.5), ('hybrid', 0.7), ('hybrid', 0.9)) v(s, t)
WHERE NOT EXISTS (SELECT 1 FROM experiments e WHERE e.model = model AND e.balance_strategy = s
  AND e.undersample_threshold IS NOT DISTINCT FROM t)""".replace("e.model = model", "e.model = g.model").replace(
        "AS model),\n(VALUES", "AS model) g,\n(VALUES"
    ),
)
def _(spark, sf):
    return _grid(spark, sf)


def _setup(spark, sf) -> ex.Setup:
    """Survival columns from a Cox fit on the training rows and the invoices still open."""
    train, _ = split(spark, sf)
    lives = ex.training_lives(_positive(spark, sf), train)
    scaled, scaler = sur.survival_clean(lives, SURVIVAL)
    fitted = hazards.cox_elastic_net_fit(scaled.select("T", "E", *SURVIVAL), scaler)
    return ex.Setup(COLUMNS, fitted, sur.steepest_times(sur.kaplan_meier(lives)))


part("tested", "SELECT count(*) - floor(count(*) * 0.8) AS n FROM labelled WHERE label >= 0 AND censor = 1")


@query(
    "experiment_run",
    "model:s;balance_strategy:s;undersample_threshold:f;phase:s;tested:i;charts:i;scores:i;weights:i",
    """SELECT model, s AS balance_strategy, t AS undersample_threshold, phase, (SELECT n FROM tested) AS tested,
  3 AS charts, 5 AS scores, 1 AS weights
FROM (SELECT unnest(['decision_tree', 'gaussian_naive_bayes']) AS model),
  (VALUES ('none', NULL), ('hybrid', 0.7)) v(s, t), (SELECT unnest(['baseline', 'enhanced']) AS phase)""",
)
def _(spark, sf):
    train, test = split(spark, sf)
    settings = {"decision_tree": [{"max_depth": 3}], "gaussian_naive_bayes": [{}]}
    tasks = ex.tasks_of(sco.experiment_matrix(spark, settings, ["none", "hybrid"], [0.7]))
    path, setup = scratch(spark), _setup(spark, sf)
    # Half of the tasks, then all: the second run fits what the first left.
    ex.run(spark, tasks[::2], train, test, setup, path, "run")
    ex.publish(ex.run(spark, tasks, train, test, setup, path, "run"), f"{path}/results")
    tables = results_read(spark, f"{path}/results")
    matrix = F.from_json("data", "array<array<bigint>>")
    seen = F.aggregate(F.flatten(matrix), F.lit(0).cast("bigint"), lambda a, x: a + x)
    charts = tables["charts"].groupBy("experiment_id", "phase").agg(
        F.count("*").alias("charts"), F.max(F.when(F.col("chart_type") == "confusion_matrix", seen)).alias("tested")
    )
    good = sum((F.col(m).between(0, 1).cast("int") for m in METRICS), F.lit(0)).alias("scores")
    scores = tables["metrics"].select("experiment_id", "phase", good)
    given = F.map_keys(F.from_json("weights_json", "map<string,double>"))
    kept = F.from_json("features_json", "array<string>")
    inside = (F.size(F.array_except(kept, given)) == 0) & (F.size(kept) > 0)
    weights = tables["features"].select("experiment_id", "phase", inside.cast("int").alias("weights"))
    both = ["experiment_id", "phase"]
    return tables["experiments"].withColumnRenamed("id", "experiment_id").join(
        charts.join(scores, both).join(weights, both), "experiment_id"
    )


def _final(spark, sf) -> sco.ScoringPipeline:
    risk = feat.plan_risk_fit(feature_rows(spark, sf))
    return sco.finalize_model(
        rows(spark, sf), COLUMNS, mod.decision_tree, "hybrid", 0.7, cox(spark, sf), [30, 60], True, risk
    )


P = ";".join(f"p_{b}:f" for b in BRACKETS)


@query("finalize_model", f"id:i;bracket:s;{P}")
def _(spark, sf):
    return _final(spark, sf).score_batch(rows(spark, sf))


@query("model_store", "rows:i;same:i", "SELECT count(*) AS rows, count(*) AS same FROM labelled WHERE label >= 0 AND censor = 1")
def _(spark, sf):
    path = scratch(spark)
    made = _final(spark, sf)
    sco.save_pipeline(spark, made, path)
    again = sco.load_pipeline(spark, path)
    a = made.score_batch(rows(spark, sf)).select("id", F.col("p_on_time").alias("a"), F.col("bracket").alias("x"))
    b = again.score_batch(rows(spark, sf)).select("id", F.col("p_on_time").alias("b"), F.col("bracket").alias("y"))
    return a.join(b, "id").agg(F.count("*").alias("rows"), F.count_if(F.expr("abs(a - b) < 1e-12 and x = y")).alias("same"))


@query("score_batch", f"bracket:s;n:i;worst_sum:f")
def _(spark, sf):
    scored = _final(spark, sf).score_batch(rows(spark, sf))
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("bracket").agg(F.count("*").alias("n"), F.max(F.abs(total - 1)).alias("worst_sum"))


@query("score_new_ledger", f"{KEYS};due_date:d;bracket:s;{P}")
def _(spark, sf):
    return sco.score_new_ledger(
        _final(spark, sf), ledger(spark, sf), enrolled(spark, sf), OBSERVATION_END, buckets(spark, sf)
    )
