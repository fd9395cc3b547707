"""Linear models from sums of products.

A least-squares family needs its rows only for the sums of products of
features and label. One Arrow pass gives these sums by key (a group, a fold, or
both): a task multiplies its batches' matrices key by key and Spark adds the
partial sums, so a key of any size is reduced before the shuffle. Everything
else is arithmetic on (p + 2)² numbers: all kinds and penalties are solved, all
folds are left out by subtraction, and squared errors on any part follow from
that part's own sums, without reading a row again.

Penalties have the scale of scikit-learn, which the reference's parameters are
given in: ridge minimises ``|y - Xw|² + alpha |w|²``, lasso and elastic net
``|y - Xw|² / 2n + alpha (l1_ratio |w|₁ + (1 - l1_ratio) |w|² / 2)``; the
intercept is free. Sums are taken of centred and scaled columns for their
precision's sake; penalties are carried over to the unscaled weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import average_ranks, null_safe_join
from ..functions.stats import pearson
from ..session import reuse
from ..sources.tables import small_side
from .columns import q
from .sampling import unit_hash

#: Keys whose sums a task holds before it hands them on.
KEYS_AT_ONCE = 10_000


@dataclass(frozen=True)
class Penalty:
    """A kind of the linear family with its strength."""

    kind: str
    alpha: float = 0.0
    l1_ratio: float = 0.0


# The linear family of the reference.
FAMILY = (Penalty("linear"), Penalty("ridge", 1.0), Penalty("lasso", 0.1, 1.0), Penalty("elastic_net", 0.1, 0.5))


@dataclass(frozen=True)
class Linear:
    """A fitted model in the features' own units."""

    intercept: float
    coefficients: np.ndarray


@dataclass(frozen=True)
class Frame:
    """Centre and scale of features and label, in which sums are taken."""

    features: tuple[str, ...]
    label: str
    centre: np.ndarray
    scale: np.ndarray

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], label: str) -> Frame:
        """From one aggregation over the complete rows."""
        cols = [*features, label]
        d = complete_rows(df, features, label)
        row = d.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        centre, scale = (np.array([row[f"{k}{i}"] or 0.0 for i in range(len(cols))]) for k in "ms")
        return Frame(tuple(features), label, centre, np.where(scale > 1e-12 * np.maximum(np.abs(centre), 1.0), scale, 1.0))     # constant columns: 1


def complete_rows(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, features and label as doubles, of the rows that have them all."""
    d = df.select(*[q(k) for k in keep], *[q(c).cast("double").alias(c) for c in [*features, label]])
    return d.na.drop(subset=[*features, label])


class Sums:
    """Sums over rows of the products of (1, features, label), centred and scaled by a frame."""

    def __init__(self, products: np.ndarray):
        self.products = products

    @staticmethod
    def of_triangle(values: Sequence[float], p: int) -> Sums:
        out = np.zeros((p + 2, p + 2))
        out[np.triu_indices(p + 2)] = values
        return Sums(out + np.triu(out, 1).T)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.products + other.products)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.products - other.products)

    @property
    def n(self) -> float:
        return round(self.products[0, 0])

    def covariance(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means of (features, label), and the features' centred products with themselves and with the label."""
        mean = self.products[0, 1:] / self.products[0, 0]
        centred = self.products[1:, 1:] - self.products[0, 0] * np.outer(mean, mean)
        return mean, centred[:-1, :-1], centred[:-1, -1]

    def fit(self, frame: Frame, penalty: Penalty) -> Linear:
        mean, xx, xy = self.covariance()
        scale, label_scale = frame.scale[:-1], frame.scale[-1]
        if penalty.kind == "linear" or not penalty.alpha:
            v = np.linalg.lstsq(xx, xy, rcond=1e-10)[0]
        elif penalty.kind == "ridge":
            v = np.linalg.solve(xx + np.diag(penalty.alpha / scale ** 2), xy)
        else:
            # weights of the scaled columns are w * scale / label_scale
            l1 = penalty.alpha * penalty.l1_ratio / scale / label_scale
            v = coordinate_descent(xx / self.n, xy / self.n, l1, penalty.alpha * (1 - penalty.l1_ratio) / scale ** 2)
        w = v * label_scale / scale
        at = frame.centre + mean * frame.scale
        return Linear(float(at[-1] - w @ at[:-1]), w)

    def squared_errors(self, frame: Frame, model: Linear) -> tuple[float, float]:
        """Sum of the model's squared errors over these rows, and of the deviations from their own mean."""
        label_scale = frame.scale[-1]
        v = model.coefficients * frame.scale[:-1] / label_scale
        b = (model.intercept + model.coefficients @ frame.centre[:-1] - frame.centre[-1]) / label_scale
        left = np.concatenate([[-b], -v, [1.0]])
        total = self.products[-1, -1] - self.products[0, -1] ** 2 / self.products[0, 0]
        return max(float(left @ self.products @ left), 0.0) * label_scale ** 2, max(float(total), 0.0) * label_scale ** 2

    def r2(self, frame: Frame, model: Linear) -> float:
        """Share of the rows' variance that the model explains; nan where they have none."""
        error, total = self.squared_errors(frame, model)
        return 1 - error / total if total > 0 else float("nan")


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, rounds: int = 5_000, close: float = 1e-12) -> np.ndarray:
    """Minimiser of ``v'xx v / 2 - xy'v + sum(l1 |v|) + sum(l2 v²) / 2``, one weight at a time until none moves.

    Nearly collinear columns make the last steps slow. Once the signs stand, the
    weights that are not 0 solve linear equations, so now and then these are
    solved and taken if they meet the optimality conditions.
    """
    v, left = np.zeros(len(xy)), xy.astype(float).copy()          # left: xy - xx v
    for turn in range(1, rounds + 1):
        moved = 0.0
        for j in range(len(v)):
            if xx[j, j] + l2[j] <= 1e-14:
                continue
            pull = left[j] + xx[j, j] * v[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / (xx[j, j] + l2[j])
            if new != v[j]:
                left -= xx[:, j] * (new - v[j])
                moved = max(moved, abs(new - v[j]))
                v[j] = new
        if moved < close:
            return v
        if turn % 50 == 0 and (exact := _on_signs(xx, xy, l1, l2, v)) is not None:
            return exact
    raise ArithmeticError("coordinate descent did not converge")


def _on_signs(xx: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, v: np.ndarray, close: float = 1e-10) -> np.ndarray | None:
    """The minimiser with the signs of ``v``, if there is one."""
    own, out = v != 0, np.zeros(len(v))
    out[own] = np.linalg.lstsq(xx[np.ix_(own, own)] + np.diag(l2[own]), xy[own] - l1[own] * np.sign(v[own]), rcond=1e-12)[0]
    pull = xy - xx @ out - l2 * out
    same = (np.sign(out[own]) == np.sign(v[own])).all() and np.abs(pull[own] - l1[own] * np.sign(v[own])).max(initial=0.0) < close
    return out if same and (np.abs(pull[~own]) <= l1[~own] + close).all() else None


def product_sums(df: DataFrame, frame: Frame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and ``sums`` (upper triangle of the products) of the complete rows, a null key being a key."""
    keys, p = list(keys), len(frame.features)
    d = complete_rows(df, frame.features, frame.label, keys)
    types = [d.schema[k] for k in keys]
    upper = np.triu_indices(p + 2)
    centre, scale = frame.centre, frame.scale

    def handed_on(held: dict[tuple, np.ndarray], arrow_types: list[pa.DataType]) -> pa.RecordBatch:
        m = len(upper[0])
        columns = [pa.array([k[i] for k in held], t).take(pa.array(np.repeat(np.arange(len(held)), m))) for i, t in enumerate(arrow_types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(m, dtype=np.int32), len(held))),
                                           pa.array(np.concatenate([x[upper] for x in held.values()]))], [*keys, "_i", "_v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        arrow_types: list[pa.DataType] = []
        for b in batches:
            arrow_types = [b.schema.field(i).type for i in range(len(keys))]
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keys):]])
            z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
            code, names = np.zeros(len(z), np.int64), [()]
            for c in b.columns[:len(keys)]:
                coded = pc.dictionary_encode(c, null_encoding="encode")
                values = coded.dictionary.to_pylist()
                code = code * len(values) + coded.indices.to_numpy(zero_copy_only=False)
                names = [(*n, v) for n in names for v in values]
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
                own = z[part]
                key = names[code[part[0]]]
                held[key] = held.get(key, 0.0) + own.T @ own
            if len(held) >= KEYS_AT_ONCE:
                yield handed_on(held, arrow_types)
                held = {}
        if held:
            yield handed_on(held, arrow_types)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in types)
    summed = d.mapInArrow(run, fields + "_i int, _v double").groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
    return summed.groupBy(*keys).agg(listed.alias("sums"))


def _sums(df: DataFrame, frame: Frame, key: str) -> dict[object, Sums]:
    """Sums by a key of few values, such as a fold."""
    return {r[key]: Sums.of_triangle(r["sums"], len(frame.features)) for r in product_sums(df, frame, [key]).collect()}


def _total(parts: Mapping[object, Sums]) -> Sums:
    out = None
    for s in parts.values():
        out = s if out is None else out + s
    if out is None:
        raise ValueError("no complete rows to fit on")
    return out


# --------------------------------------------------------------------------
# M1 the family on one table
# --------------------------------------------------------------------------

def fit_family(df: DataFrame, features: Sequence[str], label: str, kinds: Sequence[Penalty] = FAMILY) -> dict[str, Linear]:
    """M1: every kind of the family from one pass for the sums (after one for centre and scale)."""
    frame = Frame.of(df, features, label)
    sums = _total(_sums(df.withColumn("_all", F.lit(0)), frame, "_all"))
    return {k.kind: sums.fit(frame, k) for k in kinds}


def predict_linear(df: DataFrame, model: Linear, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """``df`` with the model's value; null where a feature is."""
    value = F.lit(model.intercept)
    for f, w in zip(features, model.coefficients):
        value = value + F.lit(float(w)) * q(f).cast("double")
    return df.withColumn(out, value)


# --------------------------------------------------------------------------
# M7, M8 search over folds
# --------------------------------------------------------------------------

def fold_of(key: str, folds: int, seed: int) -> Column:
    """Fold 0, 1, ... of a row by the seeded hash of its key."""
    return F.floor(unit_hash(key, seed) * folds).cast("int")


@dataclass(frozen=True)
class Folds:
    """Sums by fold; ``left_out(i)`` are the sums of all other folds."""

    frame: Frame
    by_fold: dict[int, Sums]

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], label: str, fold: str) -> Folds:
        frame = Frame.of(df, features, label)
        return Folds(frame, dict(sorted(_sums(df, frame, fold).items())))

    def models(self, penalty: Penalty) -> dict[int, Linear]:
        """Per fold the model of the other folds' rows."""
        every = _total(self.by_fold)
        return {i: (every - s).fit(self.frame, penalty) for i, s in self.by_fold.items() if (every - s).n > 0}

    def scores(self, models: Mapping[int, Linear]) -> tuple[list[float], list[float]]:
        """R² and RMSE of each fold by the model that did not see it."""
        r2 = [self.by_fold[i].r2(self.frame, m) for i, m in models.items()]
        rmse = [float(np.sqrt(self.by_fold[i].squared_errors(self.frame, m)[0] / self.by_fold[i].n)) for i, m in models.items()]
        return r2, rmse


def grid_of(kinds: Mapping[str, Mapping[str, Sequence[float]]]) -> list[Penalty]:
    """Every combination: ``{"ridge": {"alpha": [..]}, "elastic_net": {"alpha": [..], "l1_ratio": [..]}, "linear": {}}``."""
    out = []
    for kind, space in kinds.items():
        for alpha in space.get("alpha", [0.0]):
            for ratio in space.get("l1_ratio", [1.0 if kind == "lasso" else 0.0]):
                out.append(Penalty(kind, float(alpha), float(ratio)))
    return out


def tune_linear(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[Penalty], key: str, folds: int = 5, seed: int = 42,
                rank_metrics: bool = False) -> DataFrame:
    """M7: every point of the grid over ``folds`` hash folds, a row each with the folds' mean and (population) deviation of R² and RMSE.

    Two passes over the rows whatever the size of the grid. ``rank_metrics`` adds
    mean absolute error and Spearman correlation by fold, which need the rows'
    predictions: one more pass for the error, and ranks of each point's
    predictions (rows times points are sorted).
    """
    d = df.withColumn("_fold", fold_of(key, folds, seed))
    if rank_metrics:
        d = reuse(complete_rows(d, features, label, ["_fold"]))
    parts = Folds.of(d, features, label, "_fold")
    models = [parts.models(p) for p in grid]
    rows = []
    for i, (p, m) in enumerate(zip(grid, models)):
        r2, rmse = parts.scores(m)
        rows.append((i, p.kind, p.alpha, p.l1_ratio, float(np.mean(r2)), float(np.std(r2)), float(np.mean(rmse)), float(np.std(rmse))))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "point int, kind string, alpha double, l1_ratio double, r2_mean double, r2_std double, rmse_mean double, rmse_std double")
    if not rank_metrics:
        return out
    predicted = with_predictions(d, features, models, "_fold").select("_fold", F.col(label).alias("_y"), F.posexplode("_predictions").alias("point", "_p"))
    errors = predicted.groupBy("point", "_fold").agg(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("mae"))
    ranked = average_ranks(predicted, ["point", "_fold"], "_p", "_rp")
    of_label = average_ranks(d.select("_fold", F.col(label).alias("_y")), ["_fold"], "_y", "_ry").distinct()
    ranked = null_safe_join(ranked, of_label, ["_fold", "_y"])
    spearman = ranked.groupBy("point", "_fold").agg(pearson("_ry", "_rp").alias("spearman"))
    both = null_safe_join(errors, spearman, ["point", "_fold"], "left").groupBy("point").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("spearman").alias("spearman_mean"), F.stddev_pop("spearman").alias("spearman_std"))
    return out.join(small_side(both), "point")


def with_predictions(df: DataFrame, features: Sequence[str], models: Sequence[Mapping[int, Linear]], fold: str) -> DataFrame:
    """``df`` with ``_predictions``: per list entry the value of the model of the row's fold, from one Arrow pass."""
    names = df.columns
    at = names.index(fold)
    where = [names.index(f) for f in features]
    weights = {i: (np.array([m[i].intercept for m in models]), np.column_stack([m[i].coefficients for m in models])) for i in (models[0] if models else {})}
    k = len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in where]) if where else np.zeros((b.num_rows, 0))
            of = b.column(at).to_numpy(zero_copy_only=False)
            out = np.full((b.num_rows, k), np.nan)
            for i, (intercept, w) in weights.items():
                own = of == i
                out[own] = x[own] @ w + intercept
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(k, 1), dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*names, "_predictions"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return df.mapInArrow(run, fields + "_predictions array<double>")


def cross_validate_linear(df: DataFrame, features: Sequence[str], label: str, key: str, penalty: Penalty = FAMILY[0], folds: int = 5, seed: int = 42) -> DataFrame:
    """M8: (model, r2_mean, r2_std) over the folds."""
    return tune_linear(df, features, label, [penalty], key, folds, seed).select(F.col("kind").alias("model"), "r2_mean", "r2_std")


# --------------------------------------------------------------------------
# M12, M13 a model set per group
# --------------------------------------------------------------------------

MODEL_FIELDS = "kind string, intercept double, coefficients array<double>, n_train long, n_valid long, r2 double, is_global boolean"


def fit_family_per_group(train: DataFrame, valid: DataFrame, group: str, features: Sequence[str], label: str, kinds: Sequence[Penalty] = FAMILY,
                         min_train: int = 50, min_valid: int = 20) -> DataFrame:
    """Per group with enough rows the kind with the best R² on its validation rows, and one model for all.

    Rows ``group, kind, intercept, coefficients, n_train, n_valid, r2, is_global``.
    Each group's sums are solved where they lie, in Spark; rows are read once for
    the frame and once for each set's sums. The global model is the best on all
    validation rows; it serves groups without a row of their own and the unknown
    group, null, which has no model. Ties go to the kind that is listed first;
    a group whose validation labels are all equal has no R² and takes that kind, too.
    """
    frame = Frame.of(train, features, label)
    named = F.col(group).isNotNull()
    a, b = (reuse(product_sums(d, frame, [group])) for d in (train, valid))
    kinds, p = list(kinds), len(features)

    def best(fit_on: Sequence[float], judged_on: Sequence[float]) -> tuple:
        s, v = Sums.of_triangle(fit_on, p), Sums.of_triangle(judged_on, p)
        found = [(k, m, v.r2(frame, m)) for k in kinds for m in [s.fit(frame, k)]]
        kind, model, r2 = max(found, key=lambda x: x[2] if np.isfinite(x[2]) else -np.inf)
        return kind.kind, model.intercept, model.coefficients.tolist(), s.n, v.n, float(r2) if np.isfinite(r2) else None

    def solve(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            rows = [(g, *best(s, v), False) for g, s, v in zip(pdf[group], pdf["sums"], pdf["_valid"])]
            yield pd.DataFrame(rows, columns=[group, "kind", "intercept", "coefficients", "n_train", "n_valid", "r2", "is_global"])

    kind_of = train.schema[group].dataType.simpleString()
    enough = a.where(named & (F.col("sums")[0] >= min_train - 0.5)).join(
        b.where(F.col("sums")[0] >= min_valid - 0.5).select(group, F.col("sums").alias("_valid")), group)
    groups = enough.select(group, "sums", "_valid").mapInPandas(solve, f"`{group}` {kind_of}, {MODEL_FIELDS}")

    def whole(sums: DataFrame) -> list[float]:
        rows = sums.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    fit_on, judged_on = whole(a), whole(b)
    if not fit_on or not judged_on:
        raise ValueError("training and validation rows are needed")
    one = df_of_one(train, group, best(fit_on, judged_on))
    return groups.unionByName(one)


def df_of_one(like: DataFrame, group: str, values: tuple) -> DataFrame:
    """The global model's row."""
    return like.sparkSession.createDataFrame([(None, *values, True)], f"`{group}` {like.schema[group].dataType.simpleString()}, {MODEL_FIELDS}")


def predict_family(df: DataFrame, models: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction`` (its group's model, else the global one), ``global_prediction`` and ``routed`` (whether the group has one).

    One scan of ``df``: the models are a keyed table, joined on the group.
    """
    one = models.where("is_global").first()
    own = models.where("NOT is_global").select(group, F.col("intercept").alias("_intercept"), F.col("coefficients").alias("_coefficients"))
    d = predict_linear(df, Linear(one["intercept"], np.array(one["coefficients"])), features, "global_prediction").join(small_side(own), group, "left")
    value = F.col("_intercept")
    for i, f in enumerate(features):
        value = value + F.col("_coefficients")[i] * q(f).cast("double")
    routed = F.col("_intercept").isNotNull()
    return (d.withColumns({"prediction": F.when(routed, value).otherwise(F.col("global_prediction")), "routed": routed})
            .drop("_intercept", "_coefficients").select(*df.columns, "prediction", "global_prediction", "routed"))


def compare_global(pred: DataFrame, group: str, label: str, prediction: str = "prediction", global_prediction: str = "global_prediction",
                   routed: str = "routed") -> DataFrame:
    """Metrics of the global model on all rows, of each group's own model on its rows, and the groups' averages.

    Rows ``model`` ('Global', 'Cluster <group>', 'Cluster Average', 'Weighted
    Average'), ``n, rmse, mae, r2, mmre`` and, on the averages, the improvement
    over the global row in percent (``rmse_improvement, r2_improvement,
    mmre_improvement``). 'Cluster Average' is the plain mean over groups, as the
    reference has it; 'Weighted Average' weighs groups by their rows. MMRE's
    denominator is 1e-10 at least. One grouped aggregation over the rows; groups
    without a model of their own count in 'Global' alone.
    """
    y = q(label).cast("double")

    def metrics(p: Column) -> list[Column]:
        e = y - p
        return [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                (1.0 - F.try_divide(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), y)) * F.count(e))).alias("r2"),
                F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-10))).alias("mmre")]

    whole = pred.agg(*metrics(q(global_prediction).cast("double"))).select(F.lit("Global").alias("model"), "n", "rmse", "mae", "r2", "mmre")
    each = pred.where(q(routed)).groupBy(q(group).alias("_g")).agg(*metrics(q(prediction).cast("double")))
    each = each.select(F.concat(F.lit("Cluster "), F.col("_g").cast("string")).alias("model"), "n", "rmse", "mae", "r2", "mmre")
    names = ["rmse", "mae", "r2", "mmre"]
    plain = each.agg(F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in names]).select(F.lit("Cluster Average").alias("model"), "n", *names)
    weighted = each.agg(F.sum("n").alias("n"), *[F.try_divide(F.sum(F.col(m) * F.col("n")), F.sum(F.when(F.col(m).isNotNull(), F.col("n")))).alias(m) for m in names]) \
        .select(F.lit("Weighted Average").alias("model"), "n", *names)
    averages = plain.unionByName(weighted).where("n IS NOT NULL")
    base = whole.select(*[F.col(m).alias(f"_{m}") for m in names])
    floor = F.lit(0.0001)
    improved = null_safe_join(averages, base, []).select(
        "model", "n", *names, (F.try_divide(F.col("_rmse") - F.col("rmse"), F.col("_rmse")) * 100.0).alias("rmse_improvement"),
        ((F.col("r2") - F.col("_r2")) / F.greatest(floor, F.abs("_r2")) * 100.0).alias("r2_improvement"),
        ((F.col("_mmre") - F.col("mmre")) / F.greatest(floor, F.col("_mmre")) * 100.0).alias("mmre_improvement"))
    return whole.unionByName(each).unionByName(improved, allowMissingColumns=True)
