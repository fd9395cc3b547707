"""Random search of model parameters: seeded draws from lists and distributions, every draw reported."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear as L
from .columns import q


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: np.random.Generator) -> float:
        return float(rng.uniform(self.low, self.high))


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng: np.random.Generator) -> float:
        return float(math.exp(rng.uniform(math.log(self.low), math.log(self.high))))


@dataclass(frozen=True)
class Integers:
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int

    def draw(self, rng: np.random.Generator) -> int:
        return int(rng.integers(self.low, self.high + 1))


Space = Mapping[str, "Sequence | Uniform | LogUniform | Integers"]

# The reference's search spaces in Spark's parameter names (an unbounded depth is Spark's greatest, 30).
FOREST_SPACE = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [1, 3, 5], "featureSubsetStrategy": ["sqrt", "log2"]}
BOOSTING_SPACE = {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1], "minInstancesPerNode": [1, 3, 5], "subsamplingRate": [0.8, 1.0]}
WIDE_FOREST_SPACE = {"numTrees": [100, 200, 300, 500], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["all", "sqrt"]}
WIDE_BOOSTING_SPACE = {"maxIter": [100, 200, 300, 500], "stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [3, 5, 7, 9], "minInstancesPerNode": [1, 2, 4],
                       "subsamplingRate": [0.8, 0.9, 1.0]}

BETTER_HIGH = ("r2", "spearman")


def draws(space: Space, n: int, seed: int) -> list[dict]:
    """``n`` parameter sets in a reproducible order.

    With lists alone they are distinct points of the grid, all of them if there
    are fewer than ``n``; with a distribution each is drawn by itself.
    """
    rng = np.random.default_rng(seed)
    names = sorted(space)
    if all(isinstance(space[k], Sequence) for k in names):
        total = math.prod(len(space[k]) for k in names)
        if total <= n:
            return [dict(zip(names, p)) for p in itertools.product(*(space[k] for k in names))]
        out = []
        for at in rng.choice(total, n, replace=False).tolist():
            point = {}
            for k in names:
                at, i = divmod(at, len(space[k]))
                point[k] = space[k][i]
            out.append(point)
        return out
    return [{k: space[k][int(rng.integers(len(space[k])))] if isinstance(space[k], Sequence) else space[k].draw(rng) for k in names} for _ in range(n)]


def random_search_linear(df: DataFrame, features: Sequence[str], label: str, kinds: Sequence[str], space: Space, key: str, n: int = 20,
                         folds: int = 5, metric: str = "spearman", seed: int = 42) -> DataFrame:
    """Draws of kind and penalty over fold sums; ``point, kind, alpha, l1_ratio, score, score_std, rank`` (1 is best).

    ``metric`` is r2, rmse, mae or spearman. Ridge and lasso have no use for
    ``l1_ratio`` and report 0 and 1.
    """
    points = []
    for d in draws({**space, "kind": list(kinds)}, n, seed):
        ratio = {"ridge": 0.0, "linear": 0.0, "lasso": 1.0}.get(d["kind"], d.get("l1_ratio", 0.5))
        points.append(L.Penalty(d["kind"], 0.0 if d["kind"] == "linear" else float(d.get("alpha", 1.0)), float(ratio)))
    found = L.tune_linear(df, features, label, points, key, folds, seed, rank_metrics=metric in ("mae", "spearman"))
    return _ranked(found.select("point", "kind", "alpha", "l1_ratio", F.col(f"{metric}_mean").alias("score"), F.col(f"{metric}_std").alias("score_std")), metric)


def _ranked(found: DataFrame, metric: str) -> DataFrame:
    """Rank of each draw; a row per draw, so they are ranked by one small collected table."""
    rows = sorted(found.collect(), key=lambda r: (r["score"] is None, 0 if r["score"] is None else -r["score"] if metric in BETTER_HIGH else r["score"], r["point"]))
    schema = found.schema.add("rank", T.IntegerType(), False)
    return found.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], schema)


def random_search(df: DataFrame, features: Sequence[str], label: str, kind: str, space: Space, n: int = 10, folds: int = 3, metric: str = "mae",
                  seed: int = 42, parallelism: int = 4) -> DataFrame:
    """Draws of an ensemble's parameters by k-fold cross-validation; ``point, params, score, score_std, rank``.

    ``params`` is a map from name to text. ``metric`` is mae, rmse, r2 or spearman.
    """
    from . import model as M

    est = M.make_estimator(kind, label, seed)
    points = draws(space, n, seed)
    maps = [{est.getParam(k): v for k, v in p.items()} for p in points]
    df = M.assembler(features).transform(df).select(M.FEATURES, q(label))     # each fold's rows are kept in memory: only what the models read
    judge = M.SpearmanEvaluator(label) if metric == "spearman" else RegressionEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, seed=seed,
                        parallelism=parallelism).fit(df)
    rows = [(i, {k: str(v) for k, v in p.items()}, float(s), float(sd)) for i, (p, s, sd) in enumerate(zip(points, cv.avgMetrics, cv.stdMetrics))]
    return _ranked(df.sparkSession.createDataFrame(rows, "point int, params map<string,string>, score double, score_std double"), metric)
