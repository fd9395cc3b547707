"""Model training, evaluation, tuning, scoring and clustering queries.

The task table is the resolved issues with link counts, calendar parts and
one-hot priority/type; the target is log1p(resolution hours) (F16) and the
split is the seeded hash split (W9). Deterministic baseline predictors (mean
target of the same group in the training split) make the metric tables
checkable by SQL; the fitted Spark ML models are checked by row counts and
the property tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import log_target
from ..operators import cluster as CL
from ..operators import linear as L
from ..operators import model as M
from ..operators.columns import one_hot_values
from ..operators.sampling import HASH_DIGITS, hash_order_sql, random_split
from ..session import reuse
from ..sources import tables as T
from .catalog import register
from .sqlbase import ISSUES_TL, with_issues
from .standin import PRIORITIES, SEGMENTS, issues_tl

SEED = 11
NUMERIC = ["inward_count", "outward_count", "created_month", "created_year", "created_day_of_week"]
ONE_HOT = [f"prio_{p.lower().replace(' ', '_').replace('-', '_')}" for p in PRIORITIES] + \
          [f"type_{s.lower()}" for s in SEGMENTS]
FEATS = NUMERIC + ONE_HOT


def task_table(spark, sf_dir):
    d = issues_tl(spark, sf_dir).where(F.col("resolution_time_hours").isNotNull())
    d = d.withColumn("y", log_target("resolution_time_hours"))
    d = one_hot_values(d, "priority_name", "prio_", PRIORITIES)
    d = one_hot_values(d, "issue_type", "type_", SEGMENTS)
    return random_split(d, [0.8, 0.2], "id", seed=SEED)


def split_sets(spark, sf_dir):
    t = reuse(task_table(spark, sf_dir))    # fits read it again and again
    return t.where("split = 0"), t.where("split = 1")


def three_sets(spark, sf_dir):
    """Train, validation (to choose models on) and test (to score) tasks, written once for the many fits."""
    t = reuse(random_split(task_table(spark, sf_dir).drop("split"), [0.6, 0.2, 0.2], "id", seed=SEED))
    return t.where("split = 0"), t.where("split = 1"), t.where("split = 2")


def baseline(train, test, keys, out="prediction"):
    """Mean training target of the same group; the global training mean where the group is unseen."""
    g = train.groupBy(*keys).agg(F.avg("y").alias("_gm"))
    glob = train.agg(F.avg("y")).first()[0]
    return (test.join(T.small_side(g), keys, "left")
            .withColumn(out, F.coalesce(F.col("_gm"), F.lit(glob))).drop("_gm"))


# ---- SQL side ---------------------------------------------------------------------

TASK_SQL = ISSUES_TL + f""",
t AS (SELECT id, issue_type, priority_name, ln(1 + greatest(coalesce(resolution_time_hours, 0.0), 0.0)) AS y,
        CASE WHEN {hash_order_sql('id', SEED)} / CAST({1 << 4 * HASH_DIGITS} AS DOUBLE) < 0.8 THEN 0 ELSE 1 END AS split
      FROM itl WHERE resolution_time_hours IS NOT NULL),
gm AS (SELECT avg(y) AS g FROM t WHERE split = 0)"""


def _pred_sql(name: str, keys: list[str]) -> str:
    on = " AND ".join(f"t.{k} = b.{k}" for k in keys)
    return f"""{name} AS (SELECT t.id, t.y, coalesce(b.m, (SELECT g FROM gm)) AS prediction FROM t
  LEFT JOIN (SELECT {', '.join(keys)}, avg(y) AS m FROM t WHERE split = 0 GROUP BY {', '.join(keys)}) b ON {on}
  WHERE t.split = 1)"""


def _eval_sql(src: str) -> str:
    return f"""(SELECT avg(abs(yy - pp)) AS mae, sqrt(avg((yy - pp) * (yy - pp))) AS rmse,
    1 - sum((yy - pp) * (yy - pp)) / (var_pop(yy) * count(*)) AS r2, corr(ra, rb) AS spearman
  FROM (SELECT yy, pp, rank() OVER (ORDER BY yy) + (count(*) OVER (PARTITION BY yy) - 1) / 2.0 AS ra,
               rank() OVER (ORDER BY pp) + (count(*) OVER (PARTITION BY pp) - 1) / 2.0 AS rb
        FROM (SELECT exp(y) - 1 AS yy, exp(prediction) - 1 AS pp FROM {src})))"""


@register("M4_evaluate", with_issues(",\n" + _pred_sql("p", ["issue_type", "priority_name"]) + "\nSELECT * FROM "
                                     + _eval_sql("p"), TASK_SQL))
def q_evaluate(spark, sf_dir):
    """M4: MAE, RMSE, R² in hours (expm1 of the log target) and Spearman of a (type, priority) baseline."""
    train, test = split_sets(spark, sf_dir)
    return M.evaluate(baseline(train, test, ["issue_type", "priority_name"]), "y")


@register("M5_more_metrics", with_issues(",\n" + _pred_sql("p", ["issue_type", "priority_name"]) + """
SELECT quantile_cont(abs(yy - pp), 0.5) AS median_ae, avg(abs(yy - pp) / (abs(yy) + 1.0)) * 100.0 AS mape,
  avg(CASE WHEN isfinite(abs(yy - pp) / greatest(abs(yy), 1e-10)) THEN abs(yy - pp) / greatest(abs(yy), 1e-10) END) AS mmre
FROM (SELECT exp(y) - 1 AS yy, exp(prediction) - 1 AS pp FROM p)""", TASK_SQL))
def q_more_metrics(spark, sf_dir):
    """M5: median absolute error, MAPE (+1 denominator) and MMRE of the baseline, in hours."""
    train, test = split_sets(spark, sf_dir)
    p = baseline(train, test, ["issue_type", "priority_name"])
    p = p.select(F.expm1("y").alias("hours"), F.expm1("prediction").alias("pred_hours"))
    return M.more_metrics(p, "hours", "pred_hours")


@register("M6_ensemble_mean", with_issues(",\n" + _pred_sql("p1", ["issue_type"]) + ",\n" + _pred_sql("p2", ["priority_name"])
                                          + "\nSELECT p1.id, (p1.prediction + p2.prediction) / 2.0 AS prediction "
                                            "FROM p1 JOIN p2 ON p1.id = p2.id", TASK_SQL))
def q_ensemble_mean(spark, sf_dir):
    """M6: mean of two models' predictions (type baseline, priority baseline) per task."""
    train, test = split_sets(spark, sf_dir)
    a = baseline(train, test, ["issue_type"])
    b = baseline(train, test, ["priority_name"])
    return M.ensemble_mean([a, b], "id")


def _long_eval(src: str, model: str) -> str:
    e = _eval_sql(src)
    return " UNION ALL ".join(f"SELECT '{model}' AS model, '{m}' AS metric, {m} AS value FROM {e}"
                              for m in ["mae", "rmse", "r2", "spearman"])


@register("M9_compare", with_issues(",\n" + _pred_sql("po", ["priority_name"]) + ",\n"
                                    + _pred_sql("pt", ["issue_type", "priority_name"]) + f""",
o AS ({_long_eval('po', 'baseline')}), n AS ({_long_eval('pt', 'baseline')})
SELECT o.model, o.metric, o.value AS original, n.value AS tuned,
  CASE WHEN o.metric IN ('mae', 'rmse', 'median_ae', 'mape', 'mmre')
       THEN CASE WHEN abs(o.value) <> 0 THEN (o.value - n.value) / abs(o.value) END
       ELSE CASE WHEN abs(o.value) <> 0 THEN (n.value - o.value) / abs(o.value) END END * 100.0 AS improvement
FROM o JOIN n ON o.model = n.model AND o.metric = n.metric""", TASK_SQL))
def q_compare(spark, sf_dir):
    """M9: improvement table from a priority baseline ('original') to a (type, priority) baseline ('tuned')."""
    train, test = split_sets(spark, sf_dir)
    o = M.metrics_long(M.evaluate(baseline(train, test, ["priority_name"]), "y"), "baseline")
    n = M.metrics_long(M.evaluate(baseline(train, test, ["issue_type", "priority_name"]), "y"), "baseline")
    return M.compare(o, n)


@register("M15_example_profiles", with_issues(",\nq AS (SELECT " + ", ".join(
    f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS {f}" for f in NUMERIC[:3]) + " FROM itl WHERE resolution_time_hours IS NOT NULL)\n"
    + " UNION ALL ".join(f"SELECT CAST({lv} AS DOUBLE) AS quantile, " + ", ".join(f"{f}[{i + 1}] AS {f}" for f in NUMERIC[:3]) + " FROM q"
                         for i, lv in enumerate([0.25, 0.5, 0.75])), ISSUES_TL))
def q_example_profiles(spark, sf_dir):
    """Quartile profiles of the leading features as synthetic tasks."""
    t = task_table(spark, sf_dir)
    return M.example_profiles(t, NUMERIC[:3])


EXAMPLES = [*NUMERIC, *(f"prio_{p}" for p in ("1_urgent", "2_high", "3_medium", "4_not_specified", "5_low"))]
EXAMPLE_SQL = [*NUMERIC, *(f"CAST(priority_name = '{p}' AS INTEGER)" for p in PRIORITIES)]


@register("M15_example_tasks", with_issues(",\nr AS (SELECT repository, " + ", ".join(f"{e} AS {f}" for e, f in zip(EXAMPLE_SQL, EXAMPLES))
    + " FROM itl WHERE resolution_time_hours IS NOT NULL)\n"
    + " UNION ALL ".join(f"SELECT '{name}' AS name, NULL::VARCHAR AS cluster, " + ", ".join(f"CAST(quantile_cont({f}, {lv}) AS DOUBLE) AS {f}" for f in EXAMPLES) + " FROM r"
                         for lv, name in M.COMPLEXITY.items())
    + " UNION ALL SELECT 'Cluster ' || repository || ' specific task', repository, " + ", ".join(f"CAST(quantile_cont({f}, 0.5) AS DOUBLE)" for f in EXAMPLES)
    + " FROM r GROUP BY repository", ISSUES_TL))
def q_example_tasks(spark, sf_dir):
    """Example tasks of ten features: quartiles over all tasks, and each repository's medians."""
    return M.example_tasks(task_table(spark, sf_dir), EXAMPLES, "repository")


@register("M15_score_examples")
def q_score_examples(spark, sf_dir):
    """M15 + M14: the example tasks of a forest's ten top features, scored."""
    train, _ = split_sets(spark, sf_dir)
    m = M.fit_regressors(train, FEATS, "y", ("random_forest",), SEED, {"random_forest": {"numTrees": 20}})["random_forest"]
    return M.score_examples(train, m, FEATS, "repository")


# ---- fitted models (rows-only) -------------------------------------------------------

@register("M1_M3_fit_regressors")
def q_fit_regressors(spark, sf_dir):
    """M1-M3: the linear family (four kinds, from one pass), random forest and gradient boosting fitted on the training split, test predictions."""
    train, test = split_sets(spark, sf_dir)
    models = M.fit_regressors(train, FEATS, "y", ("random_forest", "gradient_boosting"), SEED,
                              {"random_forest": {"numTrees": 30}, "gradient_boosting": {"maxIter": 20}})
    parts = [m.transform(test).select("id", F.lit(k).alias("model"), "prediction") for k, m in models.items()]
    parts += [L.predict_linear(test, m, FEATS).select("id", F.lit(k).alias("model"), "prediction") for k, m in L.fit_family(train, FEATS, "y").items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("M7_tune")
def q_tune(spark, sf_dir):
    """M7: 3-fold grid search of ridge strength by RMSE; one row per grid point with its mean metric."""
    train, _ = split_sets(spark, sf_dir)
    grid = {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
    cv = M.tune(train, FEATS, "y", "linear", grid, folds=3, metric="rmse", parallelism=2)
    rows = [(float(pm[[p for p in pm if p.name == "regParam"][0]]), float(pm[[p for p in pm if p.name == "elasticNetParam"][0]]),
             float(v)) for pm, v in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(rows, "regParam double, elasticNetParam double, rmse double")


@register("M7_tune_spearman")
def q_tune_spearman(spark, sf_dir):
    """M7 + X6: the whole grid over five folds scored by the custom Spearman evaluator; one row per grid point."""
    train, _ = split_sets(spark, sf_dir)
    grid = {"numTrees": [10, 20], "maxDepth": [3, 5]}
    cv = M.tune(train, FEATS, "y", "random_forest", grid, folds=5, metric="spearman", parallelism=4)
    rows = [(*(int(next(v for p, v in m.items() if p.name == n)) for n in grid), float(s)) for m, s in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, spearman double")


@register("M8_cross_validate")
def q_cross_validate(spark, sf_dir):
    """M8: 5-fold R² mean and std of the linear model, from fold sums."""
    train, _ = split_sets(spark, sf_dir)
    return L.cross_validate_linear(train, FEATS, "y", "id", folds=5)


@register("M10_feature_importance")
def q_feature_importance(spark, sf_dir):
    """Random-forest feature importances, largest first."""
    train, _ = split_sets(spark, sf_dir)
    m = M.fit_regressors(train, FEATS, "y", ("random_forest",), SEED, {"random_forest": {"numTrees": 30}})
    return M.feature_importance(m["random_forest"], FEATS)


@register("M11_permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """RMSE increase when each feature is shuffled (10 seeded shuffles)."""
    train, test = split_sets(spark, sf_dir)
    m = M.fit_regressors(train, FEATS, "y", ("linear",), SEED)["linear"]
    return M.permutation_importance(m, test.select("id", "y", *FEATS), FEATS, "y", "id", repeats=10, seed=SEED)


@register("M12_fit_linear_per_group")
def q_fit_linear_per_group(spark, sf_dir):
    """Least-squares model per project from aggregated normal equations."""
    train, _ = split_sets(spark, sf_dir)
    return M.fit_linear_per_group(train, "project_id", NUMERIC, "y")


@register("M12_M13_predict_routed")
def q_predict_routed(spark, sf_dir):
    """M12 + M13: best linear/forest model per repository (enough rows), global fallback, routed scoring."""
    train, valid, test = three_sets(spark, sf_dir)
    models = M.fit_per_group(train, valid, "repository", FEATS, "y", ("linear", "random_forest"), 50, 20, SEED)
    return M.predict_routed(test.select("id", "repository", "y", *FEATS), models, "repository", FEATS) \
        .select("id", "repository", "prediction")


@register("M14_score_tasks")
def q_score_tasks(spark, sf_dir):
    """Batch scoring of the unresolved issues: predicted hours, days, work days and ±30 % bounds."""
    train, _ = split_sets(spark, sf_dir)
    m = M.fit_regressors(train, FEATS, "y", ("linear",), SEED)["linear"]
    open_ = issues_tl(spark, sf_dir).where(F.col("resolution_time_hours").isNull())
    open_ = one_hot_values(open_, "priority_name", "prio_", PRIORITIES)
    open_ = one_hot_values(open_, "issue_type", "type_", SEGMENTS)
    return M.score_tasks(open_, m, FEATS, keep=["id"])


# ---- clustering --------------------------------------------------------------------

def _embedded(spark, sf_dir):
    return CL.prepare(T.read_table(spark, sf_dir, "embeddings"), vector_col="embedding")


@register("M16_kmeans")
def q_kmeans(spark, sf_dir):
    """KMeans (k=10, 2 seeds, lowest cost kept) on standardised embeddings."""
    e = _embedded(spark, sf_dir)
    m = CL.kmeans(e, 10, SEED, n_init=2)
    return m.transform(e).select("vec_id", "label", F.col("prediction").alias("cluster"))


@register("M17_choose_k")
def q_choose_k(spark, sf_dir):
    """Inertia / silhouette / Davies-Bouldin per k with the voted choice."""
    return CL.choose_k(_embedded(spark, sf_dir), range(2, 7), SEED)


@register("M18_tune_kmeans")
def q_tune_kmeans(spark, sf_dir):
    """Init x n_init x max_iter grid scored by silhouette."""
    return CL.tune_kmeans(_embedded(spark, sf_dir), 5, seed=SEED)


@register("M19_pca2")
def q_pca2(spark, sf_dir):
    """Two principal components of the standardised embeddings."""
    return CL.pca2(_embedded(spark, sf_dir)).select("vec_id", "pca_x", "pca_y")


PROJECT_KEYS = ["total_issues", "avg_resolution_hours", "avg_inward", "avg_outward"]


def _projects(tasks):
    """Key features of each project."""
    return tasks.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_issues"), F.avg("resolution_time_hours").alias("avg_resolution_hours"),
                                           F.avg("inward_count").alias("avg_inward"), F.avg("outward_count").alias("avg_outward"))


@register("M20_two_stage")
def q_two_stage(spark, sf_dir):
    """Classify the projects on their resolution and link statistics, then per-class regression of their tasks and routed scoring."""
    t = reuse(task_table(spark, sf_dir).drop("split"))
    scored, _, _ = CL.two_stage(_projects(t), PROJECT_KEYS, t, FEATS, "y", 3, "project_id", "id", SEED)
    return scored.select("id", "cluster", "prediction")


@register("M20_two_stage_compared")
def q_two_stage_compared(spark, sf_dir):
    """M20 + M12: the global model against the class models on held-out tasks."""
    t = reuse(task_table(spark, sf_dir).drop("split"))
    return CL.two_stage(_projects(t), PROJECT_KEYS, t, FEATS, "y", 3, "project_id", "id", SEED)[1]
