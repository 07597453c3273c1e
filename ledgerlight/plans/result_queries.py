"""Queries of the evaluation and result operators.

Experiments are read from the part and lineitem tables: one experiment per
part, its two phases from the part's odd and even order lines. Scored rows come
from orders. Both grow with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlight.names import METRICS
from ledgerlight.operators import evaluate as ev, results as res
from ledgerlight.plans.registry import part, query, staged
from ledgerlight.session import shared_folder
from ledgerlight.sources import results as src
from ledgerlight.sources.tables import table

# ---- scored rows --------------------------------------------------------------------


def scored(spark, sf, shift: int = 0):
    label = F.least(F.floor(F.col("o_totalprice") / 125000), F.lit(3)).cast("int")
    raw = [
        1
        + (F.col("o_orderkey") * (7 + shift + 4 * j) + F.col("o_custkey") * (3 + shift + j)) % 97
        + F.when(F.col("label") == j, 60).otherwise(0)
        for j in range(4)
    ]
    total = sum(raw[1:], raw[0])
    rows = table(spark, sf, "orders").withColumn("label", label)
    rows = rows.withColumn("probability", F.array(*[r / total for r in raw]))
    return rows.select(
        F.col("o_orderkey").alias("row_id"),
        "label",
        (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("prediction"),
        "probability",
    )


for name, shift in (("scored", 0), ("scored_b", 2)):
    raws = [
        f"1 + (o_orderkey * {7 + shift + 4 * j} + o_custkey * {3 + shift + j}) % 97 + CASE WHEN label = {j} THEN 60 ELSE 0 END"
        for j in range(4)
    ]
    part(
        name,
        f"""SELECT o_orderkey AS row_id, label, list_position(p, list_max(p)) - 1 AS prediction, p AS probability
FROM (SELECT *, [CAST(r0 AS DOUBLE) / (r0 + r1 + r2 + r3), CAST(r1 AS DOUBLE) / (r0 + r1 + r2 + r3),
  CAST(r2 AS DOUBLE) / (r0 + r1 + r2 + r3), CAST(r3 AS DOUBLE) / (r0 + r1 + r2 + r3)] AS p
FROM (SELECT *, {", ".join(f"{r} AS r{j}" for j, r in enumerate(raws))}
FROM (SELECT *, CAST(least(floor(o_totalprice / 125000), 3) AS INT) AS label FROM orders)))""",
    )

part("labels4", "SELECT unnest([0, 1, 2, 3]) AS k")
part(
    "prf",
    """SELECT k, count(*) FILTER (WHERE label = k AND prediction = k) AS tp, count(*) FILTER (WHERE label = k) AS a,
  count(*) FILTER (WHERE prediction = k) AS p FROM scored, labels4 GROUP BY k HAVING a + p > 0""",
)
PRF = "accuracy:f;precision_macro:f;recall_macro:f;f1_macro:f"
PRF_SQL = """SELECT sum(tp) * 1.0 / sum(a) AS accuracy, avg(coalesce(tp * 1.0 / nullif(p, 0), 0)) AS precision_macro,
  avg(coalesce(tp * 1.0 / nullif(a, 0), 0)) AS recall_macro, avg(2.0 * tp / (a + p)) AS f1_macro FROM prf"""


@query("accuracy_macro_prf", PRF, PRF_SQL)
def _(spark, sf):
    return ev.accuracy_macro_prf(scored(spark, sf))


CELLS = ";".join([f"n_{c}:i" for c in range(4)] + [f"pct_{c}:f" for c in range(4)])


@query(
    "confusion_matrix",
    f"truth:i;{CELLS}",
    "SELECT label AS truth, {} FROM scored GROUP BY label".format(
        ", ".join(
            f"count(*) FILTER (WHERE prediction = {c}) AS n_{c}, count(*) FILTER (WHERE prediction = {c}) * 100.0 / count(*) AS pct_{c}"
            for c in range(4)
        )
    ),
)
def _(spark, sf):
    return ev.confusion_matrix(scored(spark, sf))


part(
    "points",
    """SELECT class, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
  sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N
FROM (SELECT k AS class, probability[k + 1] AS score, count(*) FILTER (WHERE label = k) AS pos,
  count(*) FILTER (WHERE label <> k) AS neg FROM scored, labels4 GROUP BY ALL)
WINDOW w AS (PARTITION BY class ORDER BY score DESC)""",
)


AUC_SQL = "SELECT class, sum(neg * (tp - pos / 2.0)) / any_value(P * N) AS auc FROM points GROUP BY class"


@query(
    "roc_curve_auc",
    "class:i;threshold:f;fpr:f;tpr:f;auc:f",
    f"""SELECT * FROM (SELECT class, score AS threshold, fp / N AS fpr, tp / P AS tpr FROM points
UNION ALL SELECT k, NULL, 0, 0 FROM labels4) JOIN ({AUC_SQL}) USING (class)""",
)
def _(spark, sf):
    scores = ev.class_scores(scored(spark, sf))
    return ev.roc_curve(scores).join(F.broadcast(ev.roc_auc(scores)), "class")  # one row per class


@query(
    "roc_curve_bends",
    "class:i;threshold:f;fpr:f;tpr:f",
    """SELECT class, score AS threshold, fp / N AS fpr, tp / P AS tpr FROM (SELECT *,
  lead(pos) OVER (PARTITION BY class ORDER BY score DESC) AS np, lead(neg) OVER (PARTITION BY class ORDER BY score DESC) AS nn
  FROM points) WHERE np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT k, NULL, 0, 0 FROM labels4""",
)
def _(spark, sf):
    return ev.roc_curve(ev.class_scores(scored(spark, sf)), drop_intermediate=True)


@query("roc_auc", "class:i;auc:f", AUC_SQL)
def _(spark, sf):
    return ev.roc_auc(ev.class_scores(scored(spark, sf)))


@query(
    "evaluation",
    f"{PRF};roc_auc_macro:f",
    f"SELECT *, (SELECT avg(auc) FROM ({AUC_SQL})) AS roc_auc_macro FROM ({PRF_SQL})",
)
def _(spark, sf):
    return ev.evaluation(scored(spark, sf))


@query(
    "pr_curve",
    "class:i;threshold:f;precision:f;recall:f",
    """SELECT class, score AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM points
UNION ALL SELECT k, NULL, 1, 0 FROM labels4""",
)
def _(spark, sf):
    return ev.pr_curve(ev.class_scores(scored(spark, sf)))


@query(
    "mcnemar",
    "n11:i;n10:i;n01:i;n00:i;chi2:f;p_value:f;significant:s",
    """WITH t AS (SELECT count(*) FILTER (WHERE x AND y) AS n11, count(*) FILTER (WHERE x AND NOT y) AS n10,
  count(*) FILTER (WHERE NOT x AND y) AS n01, count(*) FILTER (WHERE NOT x AND NOT y) AS n00
FROM (SELECT a.label = a.prediction AS x, b.label = b.prediction AS y FROM scored a JOIN scored_b b USING (row_id))),
c AS (SELECT *, CASE WHEN n10 + n01 = 0 THEN 0 ELSE pow(abs(n10 - n01) - 1, 2) / (n10 + n01) END AS chi2 FROM t),
s AS (SELECT *, sqrt(chi2 / 2) AS z FROM c),
p AS (SELECT *, 2 / sqrt(pi()) * 0.002 / 3 * list_sum(list_transform(range(0, 4001), lambda i:
  CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-1 * pow(z + i * 0.002, 2)))) AS p_value FROM s)
SELECT *, CASE WHEN p_value < 0.05 THEN 'true' ELSE 'false' END AS significant FROM p""",
)
def _(spark, sf):
    return ev.mcnemar(scored(spark, sf), scored(spark, sf, 2))


# ---- experiments ------------------------------------------------------------------------

STRATEGY = ["none", "smote", "borderline_smote", "smote_tomek", "smote_enn", "hybrid", "hybrid", "hybrid"]
RATES = {
    "accuracy": "l_returnflag = 'A'",
    "precision_macro": "l_linestatus = 'F'",
    "recall_macro": "l_discount >= 0.05",
    "f1_macro": "l_quantity > 25",
    "roc_auc_macro": "l_tax > 0.03",
}
FIELDS = (
    "run_id:s;id:i;model:s;balance_strategy:s;undersample_threshold:f;parameters:s;param_hash:s;"
    + ";".join(f"{p}_{m}:f" for p in src.PHASES for m in METRICS)
)
TEXTS = [f"{p}_{f}" for p in src.PHASES for f in [*src.CHARTS, *src.FEATURE_FIELDS]]
WIDE = FIELDS + ";" + ";".join(f"{t}:s" for t in TEXTS)


def _pick(values: list[str], expression: str) -> str:
    """CASE text that both engines read: an item of a list by position from 0."""
    return "CASE {} {} END".format(
        expression, " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    )


def _hundredths(n: str, d: str, cat) -> list[str]:
    return ["'0.'", f"lpad(CAST(CAST(floor(99 * ({n}) / ({d})) AS INT) AS {cat}), 2, '0')"]


def _exprs(text: str) -> dict[str, str]:
    """Columns of a wide row, over the per-part counts; ``text`` is the string type's name."""

    def concat(*items: str) -> str:
        return "concat(" + ", ".join(items) + ")"

    def s(column: str) -> str:
        return f"CAST({column} AS {text})"

    out = {
        "run_id": concat("'2026_01_0'", s("p_partkey % 4 + 1"), "'_01'"),
        "id": "p_partkey",
        "model": _pick(res.ALL_MODELS, "p_partkey % 15"),
        "balance_strategy": _pick(STRATEGY, "CAST(floor(p_partkey / 15) AS INT) % 8"),
        "undersample_threshold": "CAST(CASE CAST(floor(p_partkey / 15) AS INT) % 8 WHEN 5 THEN 0.5 WHEN 6 THEN 0.7 WHEN 7 THEN 0.9 END AS DOUBLE)",
        "parameters": concat("'{\"depth\": '", s("p_size % 5"), "'}'"),
        "param_hash": "substr(md5(" + concat("'{\"depth\": '", s("p_size % 5"), "'}'") + "), 1, 6)",
    }
    for p in src.PHASES:
        n = f"nullif({p}_n, 0)"
        for m in METRICS:
            out[f"{p}_{m}"] = f"CAST({p}_{m}_n AS DOUBLE) / {n}"
        x = [concat(*_hundredths(f"{p}_{m}_n", f"{p}_n + 1", text)) for m in METRICS]
        out[f"{p}_confusion_matrix"] = concat(
            "'[['", s(f"{p}_accuracy_n"), "','", s(f"{p}_n - {p}_accuracy_n"), "'],['",
            s(f"{p}_recall_macro_n"), "','", s(f"{p}_n - {p}_recall_macro_n"), "']]'",
        )
        curve = lambda a, b, y: ["'{\"" + a + "\":[0,'", x[0], "',1],\"" + b + "\":[0,'", y, "',1]}'"]
        out[f"{p}_roc_curve"] = concat(
            "'{\"0\":'", *curve("fpr", "tpr", x[1]), "',\"1\":'", *curve("fpr", "tpr", x[2]), "'}'"
        )
        out[f"{p}_pr_curve"] = concat(
            "'{\"0\":'", *curve("precision", "recall", x[3]), "',\"1\":'",
            *curve("precision", "recall", x[4]), "'}'",
        )
        flat = lambda order: ["'{\"dtp_1\": '", x[order[0]], "', \"dtp_2\": '", x[order[1]], "', \"opening_balance\": '", x[order[2]], "'}'"]
        out[f"{p}_feature_method"] = "CASE p_partkey % 2 WHEN 0 THEN 'importance' ELSE 'none' END"
        out[f"{p}_feature_parameters"] = "'{\"threshold\": \"median\"}'"
        out[f"{p}_features_json"] = "'[\"dtp_1\", \"dtp_2\", \"opening_balance\"]'"
        out[f"{p}_weights_json"] = "CASE WHEN p_partkey % 15 >= 9 THEN {} ELSE {} END".format(
            concat("'{\"stage_1\": '", *flat([0, 1, 2]), "', \"stage_2\": '", *flat([3, 4, 0]), "'}'"),
            concat(*flat([2, 3, 4])),
        )
    return out


def _select(text: str) -> str:
    return ",\n  ".join(f"{e} AS {n}" for n, e in _exprs(text).items())


def _count_columns() -> str:
    out = []
    for p, odd in (("baseline", 1), ("enhanced", 0)):
        side = f"l_linenumber % 2 = {odd}"
        out.append(f"coalesce(sum(CASE WHEN {side} THEN 1 ELSE 0 END), 0) AS {p}_n")
        out += [
            f"coalesce(sum(CASE WHEN {side} AND {c} THEN 1 ELSE 0 END), 0) AS {p}_{m}_n"
            for m, c in RATES.items()
        ]
    return ", ".join(out)


COUNTS = f"""SELECT p_partkey, any_value(p_size) AS p_size, {_count_columns()}
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey"""
part("part_counts", COUNTS)
part("wide", f"SELECT {_select('VARCHAR')}\nFROM part_counts")


def wide(spark, sf):
    def from_tables():
        lines = table(spark, sf, "lineitem")
        parts = table(spark, sf, "part")
        aggregates = []
        for p, odd in (("baseline", 1), ("enhanced", 0)):
            side = F.col("l_linenumber") % 2 == odd
            aggregates.append(F.count_if(side).alias(f"{p}_n"))
            aggregates += [
                F.count_if(side & F.expr(c)).alias(f"{p}_{m}_n") for m, c in RATES.items()
            ]
        counted = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(*aggregates)
        joined = parts.select("p_partkey", "p_size").join(counted, "p_partkey", "left").fillna(0)
        return joined.selectExpr(*[f"{e} AS {n}" for n, e in _exprs("STRING").items()])

    return staged(spark, sf, "wide", from_tables)


def tables(spark, sf):
    return src.normalise(wide(spark, sf))


part("experiments", "SELECT run_id, id, model, balance_strategy, undersample_threshold, parameters, param_hash FROM wide")
part(
    "metrics",
    " UNION ALL ".join(
        f"SELECT run_id, id AS experiment_id, '{p}' AS phase, {', '.join(f'{p}_{m} AS {m}' for m in METRICS)} FROM wide"
        for p in src.PHASES
    ),
)
part(
    "charts",
    " UNION ALL ".join(
        f"SELECT run_id, id AS experiment_id, '{p}' AS phase, '{c}' AS chart_type, {p}_{c} AS data FROM wide"
        for p in src.PHASES
        for c in src.CHARTS
    ),
)
part(
    "featured",
    " UNION ALL ".join(
        f"SELECT run_id, id AS experiment_id, '{p}' AS phase, {', '.join(f'{p}_{f} AS {f}' for f in src.FEATURE_FIELDS)} FROM wide"
        for p in src.PHASES
    ),
)
part(
    "derived",
    """SELECT *, CASE WHEN balance_strategy = 'hybrid' THEN printf('hybrid@%.1f', undersample_threshold)
    ELSE balance_strategy END AS strategy_label,
  CASE WHEN model LIKE 'ordinal%' THEN 'Ordinal' WHEN model LIKE 'two_stage%' THEN 'Two-Stage' ELSE 'Base' END AS family,
  enhanced_f1_macro - baseline_f1_macro AS f1_lift FROM wide""",
)
STACK = "kind:s;run_id:s;experiment_id:i;phase:s;name:s;number:f;body:s"
STACK_SQL = """SELECT 'metrics' AS kind, run_id, experiment_id, phase, NULL AS name, f1_macro AS number, NULL AS body FROM metrics
UNION ALL SELECT 'charts', run_id, experiment_id, phase, chart_type, NULL, data FROM charts
UNION ALL SELECT 'features', run_id, experiment_id, phase, feature_method, NULL, weights_json FROM featured
UNION ALL SELECT 'experiments', run_id, id, NULL, model || '/' || balance_strategy, undersample_threshold, param_hash FROM experiments"""


def _stack(found):
    null = F.lit(None)
    return (
        found["metrics"].select(
            F.lit("metrics").alias("kind"), "run_id", "experiment_id", "phase",
            null.cast("string").alias("name"), F.col("f1_macro").alias("number"), null.cast("string").alias("body"),
        )
        .unionByName(
            found["charts"].select(
                F.lit("charts").alias("kind"), "run_id", "experiment_id", "phase",
                F.col("chart_type").alias("name"), null.cast("double").alias("number"), F.col("data").alias("body"),
            )
        )
        .unionByName(
            found["features"].select(
                F.lit("features").alias("kind"), "run_id", "experiment_id", "phase",
                F.col("feature_method").alias("name"), null.cast("double").alias("number"), F.col("weights_json").alias("body"),
            )
        )
        .unionByName(
            found["experiments"].select(
                F.lit("experiments").alias("kind"), "run_id", F.col("id").alias("experiment_id"),
                null.cast("string").alias("phase"), F.concat_ws("/", "model", "balance_strategy").alias("name"),
                F.col("undersample_threshold").alias("number"), F.col("param_hash").alias("body"),
            )
        )
    )


def scratch(spark) -> str:
    """Fresh folder for the tables a query writes."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


@query("results_write", STACK, STACK_SQL)
def _(spark, sf):
    path = scratch(spark)
    src.results_write(wide(spark, sf), path)
    return _stack(src.results_read(spark, path))


@query("v1_to_v2_reshape", STACK, STACK_SQL)
def _(spark, sf):
    legacy = wide(spark, sf).withColumnRenamed("undersample_threshold", "underscore_threshold")
    return _stack(src.v1_to_v2_reshape(legacy.drop("param_hash")))


@query("results_flat", WIDE.replace(";id:i;", ";experiment_id:i;"), "SELECT *, id AS experiment_id FROM wide")
def _(spark, sf):
    return src.results_flat(tables(spark, sf))


@query(
    "run_partition_latest",
    "run_id:s;id:i;model:s",
    """SELECT * FROM experiments WHERE run_id = (SELECT max(run_id) FROM experiments)
UNION ALL SELECT * FROM experiments WHERE run_id = (SELECT DISTINCT run_id FROM experiments ORDER BY run_id DESC LIMIT 1 OFFSET 2)""",
)
def _(spark, sf):
    exps = tables(spark, sf)["experiments"]
    return src.run_partition_latest(exps).unionByName(src.run_partition_latest(exps, 2))


@query(
    "run_list",
    "run_id:s;experiments:i;position:i",
    "SELECT run_id, count(*) AS experiments, row_number() OVER (ORDER BY run_id DESC) - 1 AS position FROM experiments GROUP BY run_id",
)
def _(spark, sf):
    return src.run_list(tables(spark, sf)["experiments"])


@query("leaderboard_join", FIELDS, "SELECT * FROM wide")
def _(spark, sf):
    found = tables(spark, sf)
    return res.leaderboard_join(found["experiments"], found["metrics"])


PHASED = ";".join(f"{c}:f" for c in res.PHASED)


@query("metric_conditional_pivot", f"id:i;{PHASED}", "SELECT * FROM wide")
def _(spark, sf):
    return res.metric_conditional_pivot(tables(spark, sf)["metrics"])


@query("metrics_wide", FIELDS, "SELECT * FROM wide")
def _(spark, sf):
    found = tables(spark, sf)
    return res.metrics_wide(found["experiments"], found["metrics"])


def derived(spark, sf):
    return res.result_derivations(wide(spark, sf))


@query(
    "result_derivations", "id:i;model:s;strategy_label:s;family:s;f1_lift:f", "SELECT * FROM derived"
)
def _(spark, sf):
    return derived(spark, sf)


WATCHED = [f"{p}_{m}" for p in src.PHASES for m in ("f1_macro", "roc_auc_macro")]


def _domain_sql(check: str, column: str, domain: list[str], ok: str) -> str:
    items = ", ".join(f"('{d}')" for d in domain)
    return f"""UNION ALL SELECT '{check}', d, count(id), {ok} FROM (VALUES {items}) v(d)
LEFT JOIN derived ON {column} = d GROUP BY d"""


@query(
    "result_quality_checks",
    "check:s;subject:s;value:f;ok:s",
    "SELECT \"check\", subject, value, CASE WHEN ok THEN 'true' ELSE 'false' END AS ok FROM ("
    + " UNION ALL ".join(
        f"SELECT 'null metric' AS \"check\", '{c}' AS subject, count(*) - count({c}) AS value, count(*) = count({c}) AS ok FROM derived"
        for c in WATCHED
    )
    + """ UNION ALL SELECT 'null threshold', 'hybrid', count(*), count(*) = 0 FROM derived
  WHERE balance_strategy = 'hybrid' AND undersample_threshold IS NULL
UNION ALL SELECT 'mean lift', 'f1', avg(f1_lift), TRUE FROM derived
UNION ALL SELECT 'low lift', 'f1', count(*), count(*) <= 50 FROM derived WHERE f1_lift < -0.02 """
    + _domain_sql("rows per strategy", "strategy_label", res.STRATEGIES, "count(id) = 156")
    + " "
    + _domain_sql("rows per model", "model", res.ALL_MODELS, "count(id) > 0")
    + ")",
)
def _(spark, sf):
    return res.result_quality_checks(derived(spark, sf))


TOP = "id:i;model:s;strategy_label:s;enhanced_f1_macro:f;enhanced_roc_auc_macro:f"


@query(
    "top_n_by_metric",
    TOP,
    "SELECT * FROM derived ORDER BY enhanced_roc_auc_macro DESC NULLS LAST, id LIMIT 20",
)
def _(spark, sf):
    return res.top_n_by_metric(derived(spark, sf), "enhanced_roc_auc_macro", 20)


def best_sql(by: str) -> str:
    return f"""SELECT * FROM derived WHERE enhanced_f1_macro IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY enhanced_f1_macro DESC, id) = 1"""


@query("best_per_model", TOP, best_sql("model"))
def _(spark, sf):
    return res.best_per_model(derived(spark, sf))


@query("best_per_family", f"family:s;{TOP}", best_sql("family"))
def _(spark, sf):
    return res.best_per_model(derived(spark, sf), "family")


VARIANTS = ", ".join(
    f"('{v}', '{b}', '{'Ordinal' if v.startswith('ordinal') else 'Two-Stage'}')" for v, b in res.BASE_OF.items()
)


@query(
    "variant_vs_base",
    "variant:s;base:s;type:s;metric:s;base_val:f;variant_val:f;delta:f",
    " UNION ALL ".join(
        f"""SELECT variant, base, type, '{short}' AS metric, b.x AS base_val, v.x AS variant_val, v.x - b.x AS delta
FROM (VALUES {VARIANTS}) m(variant, base, type)
JOIN (SELECT model, max(enhanced_{short}_macro) AS x FROM derived GROUP BY model) b ON b.model = base
JOIN (SELECT model, max(enhanced_{short}_macro) AS x FROM derived GROUP BY model) v ON v.model = variant"""
        for short in ("f1", "roc_auc")
    ),
)
def _(spark, sf):
    return res.variant_vs_base(derived(spark, sf))


@query(
    "model_strategy_max",
    "model:s;strategy_label:s;" + ";".join(f"{c}:f" for c in WATCHED),
    "SELECT model, strategy_label, {} FROM derived GROUP BY ALL".format(
        ", ".join(f"max({c}) AS {c}" for c in WATCHED)
    ),
)
def _(spark, sf):
    return res.model_strategy_max(derived(spark, sf))


@query(
    "model_strategy_grid",
    "strategy_label:s;" + ";".join(f"{m}:f" for m in res.ALL_MODELS),
    "SELECT strategy_label, {} FROM derived GROUP BY ALL".format(
        ", ".join(f"max(CASE WHEN model = '{m}' THEN enhanced_f1_macro END) AS {m}" for m in res.ALL_MODELS)
    ),
)
def _(spark, sf):
    return res.model_strategy_grid(derived(spark, sf))


@query(
    "strategy_points",
    "balance_strategy:s;points:i",
    """SELECT balance_strategy, sum(CASE WHEN m IS NULL THEN 0 ELSE greatest(6 - r, 0) END) AS points FROM (
SELECT *, row_number() OVER (PARTITION BY model, parameters ORDER BY m DESC NULLS LAST, balance_strategy) AS r FROM (
SELECT model, parameters, balance_strategy, avg(enhanced_roc_auc_macro) AS m FROM derived GROUP BY ALL)) GROUP BY ALL""",
)
def _(spark, sf):
    return res.strategy_points(derived(spark, sf))


def _line(y: str) -> str:
    return f"CASE WHEN g >= 1 THEN 1 WHEN g < x THEN {y} * g / x ELSE {y} + (1 - {y}) * (g - x) / (1 - x) END"


def _rate(metric: str) -> str:
    return f"floor(99 * enhanced_{metric}_n / (enhanced_n + 1)) / 100"


@query(
    "macro_roc",
    "experiment_id:i;fpr:f;tpr:f",
    f"""SELECT p_partkey AS experiment_id, g AS fpr, ({_line("y0")} + {_line("y1")}) / 2 AS tpr
FROM (SELECT p_partkey, {_rate("accuracy")} AS x, {_rate("precision_macro")} AS y0, {_rate("recall_macro")} AS y1
  FROM part_counts), (SELECT unnest(range(0, 12)) / 11.0 AS g)""",
)
def _(spark, sf):
    return res.macro_roc(tables(spark, sf)["charts"], points=12)


@query(
    "feature_rank",
    "experiment_id:i;rank:i;feature:s;weight:f;shown:f",
    """SELECT *, CASE WHEN max(weight) OVER (PARTITION BY experiment_id) > 0
    THEN weight / max(weight) OVER (PARTITION BY experiment_id) ELSE weight END AS shown,
  row_number() OVER (PARTITION BY experiment_id ORDER BY weight DESC, feature) AS rank
FROM (SELECT experiment_id, unnest(['dtp_1', 'dtp_2', 'opening_balance']) AS feature,
  CAST(unnest([w->>'dtp_1', w->>'dtp_2', w->>'opening_balance']) AS DOUBLE) AS weight
  FROM (SELECT experiment_id, coalesce(CAST(weights_json AS JSON)->'stage_1', CAST(weights_json AS JSON)) AS w
    FROM featured WHERE phase = 'enhanced'))""",
)
def _(spark, sf):
    return res.feature_rank(tables(spark, sf)["features"])


@query(
    "leaderboard_view",
    "rank:i;id:i;model:s;balance_strategy:s;enhanced_f1_macro:f",
    """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY coalesce(enhanced_f1_macro, 0) DESC, id) AS rank FROM derived
WHERE model IN ('random_forest', 'xgboost', 'ordinal_xgboost') AND balance_strategy IN ('none', 'smote', 'hybrid'))
WHERE rank > 5""",
)
def _(spark, sf):
    return res.leaderboard_view(
        derived(spark, sf),
        models=["random_forest", "xgboost", "ordinal_xgboost"],
        strategies=["none", "smote", "hybrid"],
        offset=5,
    )


SIDES = ";".join(f"{s}_{m}:f" for s in ("left", "right") for m in METRICS)
ZERO = lambda p: ", ".join(f"coalesce({p}_{m}, 0) AS {{side}}_{m}" for m in METRICS)
BEST = ", ".join(f"max(coalesce(enhanced_{m}, 0)) AS right_{m}" for m in METRICS)
RIGHTS = ", ".join(f"right_{m}" for m in METRICS)
COMPARE = {
    "base_vs_enh": f"SELECT id, {ZERO('baseline').format(side='left')}, {ZERO('enhanced').format(side='right')}, '' AS right_name FROM derived",
    "regular_vs_ordinal": f"""SELECT id, {ZERO('enhanced').format(side='left')}, {RIGHTS},
  CASE WHEN right_accuracy IS NULL THEN '' ELSE 'ordinal_' || d.model END AS right_name FROM derived d
LEFT JOIN (SELECT substr(model, 9) AS model, {BEST} FROM derived WHERE family = 'Ordinal' GROUP BY ALL) o ON o.model = d.model
WHERE family = 'Base'""",
    "regular_vs_twostage": f"""SELECT id, {ZERO('enhanced').format(side='left')}, {RIGHTS}, 'Best Two-Stage' AS right_name
FROM derived, (SELECT {BEST} FROM derived WHERE family = 'Two-Stage') WHERE family = 'Base'""",
    "nosmote_vs_smote": f"""SELECT id, {ZERO('enhanced').format(side='left')}, {RIGHTS}, '' AS right_name FROM derived d
LEFT JOIN (SELECT model, parameters, {BEST} FROM derived
  WHERE balance_strategy IN ('smote', 'borderline_smote', 'smote_enn', 'smote_tomek') GROUP BY ALL) s
  ON s.model = d.model AND s.parameters = d.parameters WHERE balance_strategy = 'none'""",
}
part("exported", f"""SELECT c.*, e.model, e.balance_strategy, e.parameters, w FROM ({COMPARE['base_vs_enh']}) c
JOIN experiments e USING (id) JOIN (SELECT experiment_id, CAST(weights_json AS JSON) AS w FROM featured WHERE phase = 'enhanced') ON experiment_id = id""")


@query(
    "comparison_modes",
    f"mode:s;id:i;{SIDES};right_name:s",
    " UNION ALL BY NAME ".join(f"(SELECT '{m}' AS mode, * FROM ({sql}))" for m, sql in COMPARE.items()),
)
def _(spark, sf):
    result = None
    for mode in COMPARE:
        one = res.comparison_modes(derived(spark, sf), mode).withColumn("mode", F.lit(mode))
        result = one if result is None else result.unionByName(one)
    return result


def _weights_text(path: str) -> str:
    names = ("dtp_1", "dtp_2", "opening_balance")
    return " || ', ' || ".join(
        f"'{n}:' || CAST(CAST({path}->>'{n}' AS DOUBLE) AS VARCHAR)" for n in names
    )


@query(
    "leaderboard_export",
    f"id:i;model:s;balance_strategy:s;{SIDES};parameters:s;feature_weights:s;feature_weights_stage_1:s;feature_weights_stage_2:s",
    "SELECT id, model, balance_strategy, parameters, {}, CASE WHEN (w->'stage_1') IS NULL THEN {} END AS feature_weights, "
    "CASE WHEN (w->'stage_1') IS NOT NULL THEN {} END AS feature_weights_stage_1, "
    "CASE WHEN (w->'stage_1') IS NOT NULL THEN {} END AS feature_weights_stage_2 FROM exported".format(
        ", ".join(f"round({s}_{m}, 4) AS {s}_{m}" for s in ("left", "right") for m in METRICS),
        _weights_text("w"),
        _weights_text("(w->'stage_1')"),
        _weights_text("(w->'stage_2')"),
    ),
)
def _(spark, sf):
    compared = res.comparison_modes(derived(spark, sf), "base_vs_enh")
    rows = res.export_rows(compared, tables(spark, sf)["features"])
    path = scratch(spark)
    src.leaderboard_export(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").option("escape", "\\").csv(path)


@query(
    "metric_lift_long",
    "model:s;metric:s;mean_lift:f;improved:i;improved_pct:f",
    " UNION ALL ".join(
        f"""SELECT model, '{m}' AS metric, avg(enhanced_{m} - baseline_{m}) AS mean_lift,
  count(*) FILTER (WHERE enhanced_{m} > baseline_{m}) AS improved,
  count(*) FILTER (WHERE enhanced_{m} > baseline_{m}) * 100.0 / count(*) AS improved_pct FROM wide GROUP BY model"""
        for m in METRICS
    ),
)
def _(spark, sf):
    return res.metric_lift_long(wide(spark, sf))


MEANS = ", ".join(f"avg(enhanced_{m}) AS {m}" for m in METRICS)
M = ";".join(f"{m}:f" for m in METRICS)


@query(
    "threshold_sweep",
    f"model:s;undersample_threshold:f;{M};" + ";".join(f"smote_{m}:f" for m in METRICS),
    f"""SELECT * FROM (SELECT model, undersample_threshold, {MEANS} FROM wide
WHERE balance_strategy = 'hybrid' GROUP BY ALL) LEFT JOIN (SELECT model, {", ".join(f"avg(enhanced_{m}) AS smote_{m}" for m in METRICS)}
FROM wide WHERE balance_strategy = 'smote' GROUP BY ALL) USING (model)""",
)
def _(spark, sf):
    return res.threshold_sweep(wide(spark, sf))


@query(
    "strategy_means",
    f"balance_strategy:s;{M}",
    f"SELECT balance_strategy, {MEANS} FROM wide GROUP BY ALL",
)
def _(spark, sf):
    return res.strategy_means(wide(spark, sf))


@query(
    "stage_summary",
    f"run_id:s;id:i;{M}",
    "SELECT run_id, id, {} FROM ({})".format(
        ", ".join(f"enhanced_{m} AS {m}" for m in METRICS), best_sql("run_id")
    ),
)
def _(spark, sf):
    return res.stage_summary(wide(spark, sf))


@query(
    "metric_rank_agreement",
    "a:s;b:s;r:f",
    """SELECT 'enhanced_f1_macro' AS a, 'enhanced_roc_auc_macro' AS b, corr(rx, ry) AS r FROM (
SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
FROM (SELECT enhanced_f1_macro AS x, enhanced_roc_auc_macro AS y FROM wide
  WHERE enhanced_f1_macro IS NOT NULL AND enhanced_roc_auc_macro IS NOT NULL))""",
)
def _(spark, sf):
    return res.metric_rank_agreement(wide(spark, sf))


@query(
    "result_key",
    "id:i;result_key:s",
    "SELECT id, concat(model, '__', balance_strategy, '__', param_hash) AS result_key FROM experiments",
)
def _(spark, sf):
    return res.result_key(tables(spark, sf)["experiments"])


@query(
    "result_inventory",
    "what:s;item:s;n:i",
    """SELECT 'rows' AS what, 'experiments' AS item, count(*) AS n FROM experiments
UNION ALL SELECT 'rows', 'metrics', count(*) FROM metrics UNION ALL SELECT 'rows', 'charts', count(*) FROM charts
UNION ALL SELECT 'rows', 'features', count(*) FROM featured
UNION ALL SELECT 'distinct', 'model', count(DISTINCT model) FROM experiments
UNION ALL SELECT 'distinct', 'phase', count(DISTINCT phase) FROM metrics
UNION ALL SELECT 'strategy', concat_ws('@', balance_strategy, CAST(undersample_threshold AS VARCHAR)), count(*) FROM experiments GROUP BY ALL
UNION ALL SELECT 'chart_type', chart_type, count(*) FROM charts GROUP BY ALL""",
)
def _(spark, sf):
    return res.result_inventory(tables(spark, sf))


@query(
    "result_lookup",
    "experiment_id:i;phase:s;chart_type:s;data:s",
    "SELECT * FROM charts WHERE experiment_id = 17 AND phase = 'enhanced' AND chart_type = 'roc_curve'",
)
def _(spark, sf):
    return res.result_lookup(tables(spark, sf)["charts"], 17, "enhanced", "roc_curve")


def _lift_sql(run: str, side: str) -> str:
    cells = ", ".join(f"avg(enhanced_{m} - baseline_{m}) AS {side}_{m}" for m in METRICS)
    return f"(SELECT model, {cells} FROM wide WHERE run_id = '{run}' GROUP BY model)"


@query(
    "common_model_lift",
    "model:s;" + ";".join(f"{s}_{m}:f" for s in ("first", "second") for m in METRICS),
    f"SELECT * FROM {_lift_sql('2026_01_01_01', 'first')} JOIN {_lift_sql('2026_01_02_01', 'second')} USING (model)",
)
def _(spark, sf):
    rows = wide(spark, sf)
    return res.common_model_lift(
        rows.filter("run_id = '2026_01_01_01'"), rows.filter("run_id = '2026_01_02_01'")
    )
