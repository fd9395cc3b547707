"""Effort models: fit, evaluate, tune, compare, explain and batch-score.

Estimators are Spark ML (distributed fits); the vector is assembled only at
the estimator boundary. Metrics are one aggregation over the prediction
table; Spearman is the Pearson correlation of average ranks computed with the
skew-safe ranking helper. Per-group linear models come from per-group
sufficient statistics (XᵀX, Xᵀy) aggregated in one ``groupBy``, so a group of
any size is reduced on the map side and only p×p numbers per group are solved.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import average_ranks
from ..functions.stats import pearson
from .columns import align_columns, q

FEATURES = "features"


def assembler(features: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


# The linear family of the reference (alpha -> regParam, l1 ratio -> elasticNetParam).
LINEAR_FAMILY = {"linear": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (0.1, 1.0), "elastic_net": (0.1, 0.5)}


def make_estimator(kind: str, label: str, seed: int = 42, **params):
    """M1-M3: linear / ridge / lasso / elastic net, random forest, gradient boosting (also the XGBoost stand-in)."""
    if kind in LINEAR_FAMILY:
        reg, en = LINEAR_FAMILY[kind]
        return LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=params.get("regParam", reg),
                                elasticNetParam=params.get("elasticNetParam", en), maxIter=params.get("maxIter", 100))
    if kind == "random_forest":
        return RandomForestRegressor(featuresCol=FEATURES, labelCol=label, seed=seed,
                                     numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 8),
                                     featureSubsetStrategy=params.get("featureSubsetStrategy", "auto"))
    if kind in ("gradient_boosting", "xgboost"):
        return GBTRegressor(featuresCol=FEATURES, labelCol=label, seed=seed, maxIter=params.get("maxIter", 100),
                            maxDepth=params.get("maxDepth", 5), stepSize=params.get("stepSize", 0.1),
                            subsamplingRate=params.get("subsamplingRate", 0.8 if kind == "xgboost" else 1.0),
                            featureSubsetStrategy=params.get("featureSubsetStrategy", "all"))
    raise ValueError(kind)


def fit_regressors(train: DataFrame, features: Sequence[str], label: str,
                   kinds: Sequence[str] = ("linear", "random_forest", "gradient_boosting"), seed: int = 42,
                   params: Mapping[str, dict] | None = None) -> dict[str, PipelineModel]:
    """M1-M3: one fitted pipeline (assembler + estimator) per model kind."""
    out = {}
    for k in kinds:
        est = make_estimator(k, label, seed, **(params or {}).get(k, {}))
        out[k] = Pipeline(stages=[assembler(features), est]).fit(train)
    return out


# --------------------------------------------------------------------------
# M4-M6 metrics
# --------------------------------------------------------------------------

def spearman(df: DataFrame, a: str, b: str) -> Column | DataFrame:
    """Spearman correlation = Pearson of average ranks (ties share the mean rank)."""
    r = average_ranks(df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), [], a, "_ra")
    r = average_ranks(r, [], b, "_rb")
    return r.agg(pearson("_ra", "_rb").alias("spearman"))


def evaluate(pred: DataFrame, label: str, prediction: str = "prediction", log_space: bool = True) -> DataFrame:
    """M4: MAE, RMSE, R² in original units (expm1 when the model works in log space) and Spearman.

    Returns one row: mae, rmse, r2, spearman.
    """
    y = F.expm1(label) if log_space else F.col(label)
    p = F.expm1(prediction) if log_space else F.col(prediction)
    from ..session import reuse

    d = reuse(pred.select(y.cast("double").alias("_y"), p.cast("double").alias("_p"))
              .where("_y IS NOT NULL AND _p IS NOT NULL"))
    err = F.col("_y") - F.col("_p")
    base = d.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.sum(err * err).alias("_sse"), F.var_pop("_y").alias("_vy"), F.count(F.lit(1)).alias("_n"))
    base = base.select("mae", "rmse", (1.0 - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("_n"))).alias("r2"))
    return _attach(base, spearman(d, "_y", "_p"))


def _attach(one_row: DataFrame, other_one_row: DataFrame) -> DataFrame:
    """Put two single-row frames side by side (both have exactly one row: an equi-join on a constant key)."""
    a = one_row.withColumn("_k", F.lit(1))
    b = other_one_row.withColumn("_k", F.lit(1))
    return a.join(F.broadcast(b), "_k").drop("_k")


def more_metrics(pred: DataFrame, label: str, prediction: str = "prediction", exact: bool = True) -> DataFrame:
    """M5: median absolute error, MAPE with +1 in the denominator (%), MMRE with a 1e-10 floor skipping inf/nan."""
    from ..functions.stats import column_quantiles

    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ae = F.abs(y - p)
    mre = ae / F.greatest(F.abs(y), F.lit(1e-10))
    finite = ~F.isnan(mre) & (F.abs(mre) != F.lit(math.inf))
    med = (column_quantiles(pred.select(ae.alias("_ae")), ["_ae"], [0.5], exact).get("_ae") or [None])[0]
    return pred.agg(F.lit(med).cast("double").alias("median_ae"),
                    (F.avg(ae / (F.abs(y) + 1.0)) * 100.0).alias("mape"),
                    F.avg(F.when(finite, mre)).alias("mmre"))


def ensemble_mean(preds: Sequence[DataFrame], key: str, prediction: str = "prediction", out: str = "prediction") -> DataFrame:
    """M6: average of several models' predictions joined on the row id."""
    joined = preds[0].select(key, F.col(prediction).alias("_p0"))
    for i, p in enumerate(preds[1:], start=1):
        joined = joined.join(p.select(key, F.col(prediction).alias(f"_p{i}")), key)
    total = F.col("_p0")
    for i in range(1, len(preds)):
        total = total + F.col(f"_p{i}")
    return joined.select(key, (total / float(len(preds))).alias(out))


def metrics_long(metrics: DataFrame, model: str) -> DataFrame:
    """One metrics row -> (model, metric, value) rows."""
    cols = metrics.columns
    return metrics.unpivot([], cols, "metric", "value").select(F.lit(model).alias("model"), "metric", "value")


# Metrics where a lower value is better.
LOWER_IS_BETTER = ("mae", "rmse", "median_ae", "mape", "mmre")


def compare(original: DataFrame, tuned: DataFrame) -> DataFrame:
    """M9: (model, metric, original, tuned, improvement %) with the sign set by the metric's direction."""
    a = original.withColumnRenamed("value", "original")
    b = tuned.withColumnRenamed("value", "tuned")
    j = a.join(b, ["model", "metric"])
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    imp = F.when(lower, F.try_divide(F.col("original") - F.col("tuned"), F.abs(F.col("original"))))\
        .otherwise(F.try_divide(F.col("tuned") - F.col("original"), F.abs(F.col("original")))) * 100.0
    return j.withColumn("improvement", imp)


# --------------------------------------------------------------------------
# M7-M8 tuning
# --------------------------------------------------------------------------

class SpearmanEvaluator(Evaluator):
    """Spearman correlation of label and prediction as a Spark ML evaluator (larger is better)."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        v = spearman(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.predictionCol)).first()[0]
        return float(v) if v is not None else float("nan")

    def isLargerBetter(self) -> bool:
        return True


def tune(train: DataFrame, features: Sequence[str], label: str, kind: str, grid: Mapping[str, Sequence],
         folds: int = 5, metric: str = "rmse", n_random: int | None = None, seed: int = 42, parallelism: int = 4):
    """M7: exhaustive grid (or a seeded random subset of it) with k-fold cross-validation."""
    from pyspark.ml.evaluation import RegressionEvaluator

    est = make_estimator(kind, label, seed)
    pipe = Pipeline(stages=[assembler(features), est])
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    maps = b.build()
    if n_random and n_random < len(maps):
        rng = np.random.default_rng(seed)
        maps = [maps[i] for i in sorted(rng.choice(len(maps), n_random, replace=False))]
    ev = SpearmanEvaluator(label) if metric == "spearman" else RegressionEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=parallelism)
    return cv.fit(train)


def cross_validate(train: DataFrame, features: Sequence[str], label: str, kind: str, folds: int = 5,
                   seed: int = 42) -> DataFrame:
    """M8: R² mean and std over k folds (a one-point grid)."""
    from pyspark.ml.evaluation import RegressionEvaluator

    est = make_estimator(kind, label, seed)
    cv = CrossValidator(estimator=Pipeline(stages=[assembler(features), est]),
                        estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"), numFolds=folds, seed=seed)
    m = cv.fit(train)
    return train.sparkSession.createDataFrame([(kind, float(m.avgMetrics[0]), float(m.stdMetrics[0]))],
                                              "model string, r2_mean double, r2_std double")


# --------------------------------------------------------------------------
# M10-M11 explanations
# --------------------------------------------------------------------------

def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance) from a tree model, or |coefficient| for a linear one, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(list(zip(features, map(float, vals))), "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


def shuffled_values(df: DataFrame, cols: Sequence[str], key: str, repeats: int, seed: int = 42, out: str = "_shuffled") -> DataFrame:
    """``df`` with ``out``: per repeat a list of the values that ``cols`` have in another row; every repeat is a permutation of the rows.

    Rows stand in the order of their key's seeded hash; repeat r takes the row
    that is a drawn number of places further on. One shuffle joins all repeats:
    each row sends its values to the places that take them.
    """
    from ..functions.ranking import row_number_in_groups
    from ..session import cut_lineage
    from .sampling import hash_order

    placed = cut_lineage(row_number_in_groups(df, [], [hash_order(F.col(key), seed), F.col(key)], "_place"))
    n = placed.count()
    steps = [int(x) for x in np.random.default_rng(seed).integers(1, max(n, 2), repeats)]
    values = F.array(*[q(c).cast("double") for c in cols])
    sent = placed.select(F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("_r", "_step"), F.col("_place"), values.alias("_v"))
    sent = sent.select(F.pmod(F.col("_place") - 1 - F.col("_step"), F.lit(max(n, 1))).alias("_to"), "_r", "_v")
    lists = sent.groupBy("_to").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda s: s["_v"]).alias(out))
    return placed.join(lists, F.col("_place") - 1 == F.col("_to")).drop("_place", "_to")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: str,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean increase of RMSE when one feature is shuffled, over ``repeats`` seeded shuffles.

    All shuffles of all features are scored in one pass, so the number of jobs
    depends on neither. ``features`` are the model's, in its order.
    """
    from .scoring import as_arrays, shuffled_errors

    shuffled = shuffled_values(df.select(q(key), q(label), *[q(f) for f in features]), features, key, repeats, seed)
    mse = {(r["feature"], r["repeat"]): r["mse"] for r in
           shuffled_errors(shuffled, as_arrays(df.sparkSession, model), features, label, "_shuffled").collect()}
    rows = []
    for i, f in enumerate(features):
        losses = [math.sqrt(mse[i, r]) - math.sqrt(mse[-1, -1]) for r in range(repeats)] if mse else [0.0]
        rows.append((f, float(np.mean(losses)), float(np.std(losses))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, importance_std double") \
        .orderBy(F.col("importance").desc(), "feature")


# --------------------------------------------------------------------------
# M12-M15 grouped models and scoring
# --------------------------------------------------------------------------

def fit_linear_per_group(df: DataFrame, group: str, features: Sequence[str], label: str,
                         ridge: float = 1e-6, min_rows: int = 10) -> DataFrame:
    """M12 (many groups): ordinary least squares per group from aggregated XᵀX and Xᵀy.

    One grouped aggregation builds the (p+1)² + (p+1) sums per group on the map
    side; each group's small system is solved afterwards. Features are centred
    and scaled by their overall mean and deviation first, which keeps the
    systems well conditioned; the penalty leaves the intercept out. Groups with
    fewer than ``min_rows`` rows get no model (routed to the global one); a null
    group is a group.
    """
    cols = ["_one"] + list(features)
    d = df.select(group, F.lit(1.0).alias("_one"), *[q(c).cast("double").alias(c) for c in features],
                  F.col(label).cast("double").alias("_y")).na.drop(subset=[*features, "_y"])
    means = d.agg(*[F.avg(q(c)) for c in features], *[F.stddev_pop(q(c)) for c in features]).first()
    mean = [float(m or 0.0) for m in means[:len(features)]]
    scale = [float(s) if s else 1.0 for s in means[len(features):]]
    d = d.withColumns({c: (q(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, mean, scale)})
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(F.col(a) * F.col("_y")).alias(f"xy_{i}"))
        for j, b in enumerate(cols[i:], start=i):
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}"))
    stats = d.groupBy(group).agg(*aggs).where(F.col("_n") >= min_rows)
    p = len(cols)
    schema = f"{group} {df.schema[group].dataType.simpleString()}, intercept double, coefficients array<double>, n long"

    def solve(it):
        import pandas as pd
        for pdf in it:
            out = []
            for _, r in pdf.iterrows():
                xx = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"]
                xy = np.array([r[f"xy_{i}"] for i in range(p)])
                beta = np.linalg.solve(xx + ridge * np.diag([0.0] + [1.0] * (p - 1)), xy)
                slopes = [float(b) / s for b, s in zip(beta[1:], scale)]
                out.append((r[group], float(beta[0]) - sum(b * m for b, m in zip(slopes, mean)), slopes, int(r["_n"])))
            yield pd.DataFrame(out, columns=[group, "intercept", "coefficients", "n"])

    return stats.mapInPandas(solve, schema)


def predict_linear_per_group(df: DataFrame, models: DataFrame, group: str, features: Sequence[str],
                             out: str = "prediction") -> DataFrame:
    """Score rows with their group's linear model (null when the group has none)."""
    from ..sources.tables import small_side

    j = df.join(small_side(models.select(group, "intercept", "coefficients")), group, "left")
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefficients")[i] * q(f).cast("double")
    return j.withColumn(out, pred).drop("intercept", "coefficients")


def fit_per_group(train: DataFrame, valid: DataFrame, group: str, features: Sequence[str], label: str,
                  kinds: Sequence[str] = ("linear", "random_forest"), min_train: int = 50, min_valid: int = 20,
                  seed: int = 42) -> dict:
    """Per group with enough rows the kind with the best R² on its validation rows; a global model covers the rest (key None).

    Linear kinds come from sums of products for all groups at once. Ensembles of
    trees are fitted by Spark ML, a fit per group and kind, so ask for them for
    few groups (clusters, trackers); ``linear.fit_family_per_group`` has no such bound.
    The unknown group, null, is left to the global model.
    """
    from pyspark.ml.evaluation import RegressionEvaluator

    from .linear import FAMILY, fit_family_per_group
    from .scoring import LinearArrays

    family = [p for k in kinds for p in FAMILY if p.kind == k]
    trees = [k for k in kinds if k not in {p.kind for p in FAMILY}]
    best: dict = {}
    if family:
        for r in fit_family_per_group(train, valid, group, features, label, family, min_train, min_valid).collect():
            best[None if r["is_global"] else r[group]] = (r["r2"], LinearArrays(r["intercept"], np.array(r["coefficients"])))
    if trees:
        ev = RegressionEvaluator(labelCol=label, metricName="r2")
        sizes = [{r[group]: r["n"] for r in d.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()} for d in (train, valid)]
        own = [g for g, n in sizes[0].items() if g is not None and n >= min_train and sizes[1].get(g, 0) >= min_valid]
        for g in [None, *own]:
            tr, va = (train, valid) if g is None else (d.where(F.col(group) == g) for d in (train, valid))
            for m in fit_regressors(tr, features, label, trees, seed).values():
                r2 = ev.evaluate(m.transform(va))
                if g not in best or best[g][0] is None or r2 > best[g][0]:
                    best[g] = (r2, m)
    return {g: m for g, (_, m) in best.items()}


def predict_routed(df: DataFrame, models: Mapping, group: str, features: Sequence[str]) -> DataFrame:
    """Each row scored by its group's model, the global model (key None) for the rest, in one scan of ``df``."""
    from .scoring import as_arrays, predict_by_group

    return predict_by_group(df, {g: as_arrays(df.sparkSession, m) if isinstance(m, PipelineModel) else m for g, m in models.items()}, group, features)


def score_tasks(df: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] = (),
                log_space: bool = True, absent: float | None = None) -> DataFrame:
    """Align features (J8), predict, back-transform (expm1), hours -> days (/24) and work days (/8), ±30 % bounds.

    A feature that ``df`` lacks is an error, unless ``absent`` gives the value to score it with.
    """
    missing = [f for f in features if f not in df.columns]
    if missing and absent is None:
        raise ValueError(f"features absent from the tasks: {', '.join(missing)}")
    aligned = df.select(*[q(k) for k in keep], *[F.lit(absent).alias(f) if f in missing else q(f) for f in features])
    p = model.transform(aligned)
    h = F.expm1("prediction") if log_space else F.col("prediction")
    return p.select(*[q(k) for k in keep], h.alias("predicted_hours"), (h / 24.0).alias("predicted_days"),
                    (h / 8.0).alias("predicted_work_days"), (h * 0.7).alias("lower_bound_hours"),
                    (h * 1.3).alias("upper_bound_hours"))


def example_profiles(df: DataFrame, features: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
                     exact: bool = True) -> DataFrame:
    """One synthetic task per quantile level of the given features (quantiles in one aggregation)."""
    from ..functions.stats import column_quantiles

    got = column_quantiles(df, features, probs, exact)
    qs = df.sparkSession.createDataFrame([tuple(got[f] for f in features)],
                                         ", ".join(f"`{f}` array<double>" for f in features))
    rows = qs.select(F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "quantile"),
                     *[F.col(f"`{f}`") for f in features])
    return rows.select("quantile", *[F.col(f"`{f}`")[F.col("_i")].alias(f) for f in features])


# Names of the example tasks by quantile level.
COMPLEXITY = {0.25: "Low complexity task", 0.5: "Medium complexity task", 0.75: "High complexity task"}


def example_tasks(df: DataFrame, features: Sequence[str], cluster: str | None = None, exact: bool = True) -> DataFrame:
    """Synthetic tasks ``name, cluster, features..``: a row per quantile level of the features, and each cluster's medians.

    The medians of all clusters and features are one pass over (cluster,
    feature, value); the null cluster, unknown, has no task of its own.
    """
    from ..functions.stats import group_quantiles

    kind = "string" if cluster is None else df.schema[cluster].dataType.simpleString()
    levels = example_profiles(df, features, tuple(COMPLEXITY), exact)
    named = F.create_map(*[F.lit(x) for p in COMPLEXITY.items() for x in p])
    out = levels.select(named[F.col("quantile")].alias("name"), F.lit(None).cast(kind).alias("cluster"), *[q(f).cast("double").alias(f) for f in features])
    if cluster is None:
        return out
    long = df.where(q(cluster).isNotNull()).select(q(cluster).alias("cluster"), *[q(f).cast("double").alias(f) for f in features]) \
        .unpivot(["cluster"], list(features), "_feature", "_value")
    medians = group_quantiles(long, ["cluster", "_feature"], "_value", [0.5], exact, "_q").groupBy("cluster").agg(
        *[F.max(F.when(F.col("_feature") == f, F.col("_q")[0])).alias(f) for f in features])
    return out.unionByName(medians.select(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(" specific task")).alias("name"), "cluster",
                                          *[q(f) for f in features]))


def top_features(model: PipelineModel, features: Sequence[str], n: int = 10) -> list[str]:
    """The ``n`` most important features of a model (M10), by importance, then name."""
    return [r["feature"] for r in feature_importance(model, features).limit(n).collect()]


def score_examples(df: DataFrame, model: PipelineModel, features: Sequence[str], cluster: str | None = None, n: int = 10,
                   log_space: bool = True) -> DataFrame:
    """The example tasks of the model's ``n`` top features, scored by M14; features that an example does not give are 0."""
    examples = example_tasks(df, top_features(model, features, n), cluster)
    return score_tasks(examples, model, features, keep=["name", "cluster"], log_space=log_space, absent=0.0)
