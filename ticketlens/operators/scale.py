"""Scaling and power transforms with persisted fitted parameters.

``fit_*`` runs one aggregation (or a few passes, for the Yeo-Johnson search) and
returns a parameter table with one row per column: (column, kind, p1, p2,
lam). ``apply_scaler`` reads that small table and applies every transform
in one ``select``, so fit and apply can run on different data and the
parameters can be written to parquet next to a model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from .columns import column_stats, numeric_columns, q

PARAM_SCHEMA = "column string, kind string, p1 double, p2 double, lam double"


def _params_df(df: DataFrame, rows) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, PARAM_SCHEMA)


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard", exact: bool = True) -> DataFrame:
    """Fit one of standard (mean, population std), minmax (min, max), robust (median, IQR), yeo_johnson."""
    cols = list(cols)
    if kind == "yeo_johnson":
        return fit_yeo_johnson(df, cols)
    if kind == "standard":
        st = column_stats(df, {f"{c}\u0000a": e for c in cols for e in [F.avg(q(c))]} |
                          {f"{c}\u0000b": F.stddev_pop(q(c)) for c in cols})
    elif kind == "minmax":
        st = column_stats(df, {f"{c}\u0000a": F.min(q(c)).cast("double") for c in cols} |
                          {f"{c}\u0000b": F.max(q(c)).cast("double") for c in cols})
    elif kind == "robust":
        from ..functions.stats import column_quantiles

        qs = column_quantiles(df, cols, [0.25, 0.5, 0.75], exact)
        st = {}
        for c in cols:
            v = qs[c] or [None, None, None]
            st[f"{c}\u0000a"] = v[1]
            st[f"{c}\u0000b"] = (v[2] - v[0]) if v[0] is not None else None
    else:
        raise ValueError(kind)
    return _params_df(df, [(c, kind, st[f"{c}\u0000a"], st[f"{c}\u0000b"], None) for c in cols])


def _scale_expr(c: Column, kind: str, p1, p2, lam) -> Column:
    x = c.cast("double")
    if kind == "standard":        # sklearn: zero variance -> scale 1
        s = p2 if p2 not in (None, 0.0) else 1.0
        return (x - F.lit(p1)) / F.lit(s)
    if kind == "minmax":          # constant column -> 0
        rng = (p2 - p1) if p1 is not None and p2 is not None else None
        return (x - F.lit(p1)) / F.lit(rng if rng not in (None, 0.0) else 1.0)
    if kind == "robust":          # IQR 0 -> 1
        return (x - F.lit(p1)) / F.lit(p2 if p2 not in (None, 0.0) else 1.0)
    if kind == "yeo_johnson":     # transform, then standardise with the fitted mean/std
        s = p2 if p2 not in (None, 0.0) else 1.0
        return (yeo_johnson(x, lam) - F.lit(p1)) / F.lit(s)
    raise ValueError(kind)


def apply_scaler(df: DataFrame, params: DataFrame, prefix: Mapping[str, str] | None = None) -> DataFrame:
    """Apply fitted parameters; a column listed in ``prefix`` gets the output name ``prefix + column``."""
    rows = {r["column"]: r for r in params.collect()}
    out = []
    for c in df.columns:
        if c in rows:
            r = rows[c]
            name = (prefix or {}).get(c, "") + c
            out.append(_scale_expr(q(c), r["kind"], r["p1"], r["p2"], r["lam"]).alias(name))
        else:
            out.append(q(c))
    return df.select(*out)


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std."""
    return apply_scaler(df, fit_scaler(df, cols, "standard"))


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); constant column -> 0."""
    return apply_scaler(df, fit_scaler(df, cols, "minmax"))


def scale_robust(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """(x - median) / IQR with exact quartiles; IQR 0 -> 1."""
    return apply_scaler(df, fit_scaler(df, cols, "robust", exact))


# --------------------------------------------------------------------------
# I14 Yeo-Johnson
# --------------------------------------------------------------------------

def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """Yeo-Johnson transform of a column for a fixed (or per-row) lambda."""
    lc = lam if isinstance(lam, Column) else F.lit(float(lam))
    pos = F.when(F.abs(lc) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lc) - 1.0) / lc)
    neg = F.when(F.abs(lc - 2.0) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(-x + 1.0, 2.0 - lc) - 1.0) / (2.0 - lc))
    return F.when(x >= 0, pos).otherwise(neg)


#: Lambdas of the first round: fine where most columns have theirs, then ever further out.
_NEAR, _FAR = [-2.0 + 0.5 * i for i in range(9)], [3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 64.0]
_BETWEEN = 9      # lambdas between two neighbours in a round of refinement


def _transformed(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Yeo-Johnson transform, [rows x lambdas]."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        size = np.log1p(np.abs(x))[:, None]
        power = np.where((x >= 0)[:, None], lam, 2.0 - lam)
        value = np.where(np.abs(power) < 1e-12, size, np.expm1(power * size) / np.where(np.abs(power) < 1e-12, 1.0, power))
    return np.where((x >= 0)[:, None], value, -value)


def _moments(df: DataFrame, cols: list[str], lams: dict[str, list[float]], centre: dict[str, float]) -> dict[str, dict[float, tuple]]:
    """For every (column, lambda): n, mean and variance of the transform, and the sum of sign * log1p|x|, from one Arrow pass.

    Tasks sum the transform's difference to that of the column's mean, and its
    square; Spark adds the sums by number. Rows are neither unpivoted nor multiplied.
    """
    own = [c for c in cols if lams.get(c)]
    grids = [np.array(lams[c]) for c in own]
    shift = [_transformed(np.array([centre[c]]), g)[0] for c, g in zip(own, grids)]
    starts = np.cumsum([0, *(2 + 2 * len(g) for g in grids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1])
        for b in batches:
            for i, g in enumerate(grids):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                for at in range(0, len(x), 8192):
                    part = x[at:at + 8192]
                    with np.errstate(over="ignore", invalid="ignore"):
                        d = _transformed(part, g) - shift[i]
                        total[starts[i]:starts[i + 1]] += np.concatenate([[len(part), (np.sign(part) * np.log1p(np.abs(part))).sum()], d.sum(axis=0), (d * d).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    d = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(own)])
    got = {r["i"]: r["v"] for r in d.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    out: dict[str, dict[float, tuple]] = {}
    for i, c in enumerate(own):
        n, logs, k = got.get(starts[i], 0.0), got.get(starts[i] + 1, 0.0), len(grids[i])
        out[c] = {}
        for j, lam in enumerate(grids[i]):
            if n:
                mean = got[starts[i] + 2 + j] / n
                out[c][float(lam)] = (n, mean + shift[i][j], got[starts[i] + 2 + k + j] / n - mean * mean, logs)
    return out


def _loglik(lam: float, n: float, var: float, logs: float) -> float:
    """Log-likelihood of a lambda; minus infinity where the transform has no finite variance."""
    if n < 2 or not (var > 0) or math.isinf(var):
        return -math.inf
    return -n / 2.0 * math.log(var) + (lam - 1.0) * logs


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], close: float = 1e-3) -> DataFrame:
    """Per-column lambda by maximum likelihood (to ``close``), then mean / population std of the transformed column.

    The likelihood has one maximum. A first pass over the rows evaluates every
    column on one grid that reaches far out; where its edge is best the grid
    goes on, doubling, until the likelihood falls or is no longer finite. Each
    further pass looks between the neighbours of the best lambda, and a parabola
    through the last three gives the result: about six passes whatever the number of columns. A
    column without variance has no parameters.
    """
    cols = list(cols)
    df = reuse(df.select(*[q(c) for c in cols]))
    means = column_stats(df, {c: F.avg(F.nanvl(q(c).cast("double"), F.lit(None))) for c in cols})
    centre = {c: float(means[c]) for c in cols if means[c] is not None}
    tables: dict[str, dict[float, tuple]] = {c: {} for c in centre}
    todo = {c: sorted([1.0 - f for f in _FAR] + _NEAR + [1.0 + f for f in _FAR]) for c in centre}
    best: dict[str, float] = {}
    while todo:
        for c, t in _moments(df, cols, todo, centre).items():
            tables[c] |= t
        todo = {}
        for c, t in tables.items():
            score = {lam: _loglik(lam, n, var, logs) for lam, (n, _, var, logs) in t.items()}
            lams = sorted(score)
            top = max(lams, key=lambda x: (score[x], -abs(x)))
            if math.isinf(score[top]):
                continue
            at = lams.index(top)
            if at in (0, len(lams) - 1):
                todo[c] = [1.0 + (top - 1.0) * 2.0 ** k for k in range(1, 9)]
                continue
            low, high = lams[at - 1], lams[at + 1]
            if math.isinf(score[low]) or math.isinf(score[high]) or high - low > close * 20:
                if high - low <= 1e-9:
                    best[c] = top
                    continue
                todo[c] = [x for i in range(1, _BETWEEN + 1) for x in (low + (high - low) * i / (_BETWEEN + 1),) if x not in t]
                continue
            best[c] = _peak([(x, score[x]) for x in (low, top, high)])
    final = _moments(df, cols, {c: [lam] for c, lam in best.items()}, centre) if best else {}
    rows = []
    for c in cols:
        if c in best:
            _, mean, var, _ = final[c][best[c]]
            rows.append((c, "yeo_johnson", float(mean), math.sqrt(var), float(best[c])))
    return _params_df(df, rows)


def _peak(three: list[tuple[float, float]]) -> float:
    """Top of the parabola through three points, the middle one being the highest."""
    (a, fa), (b, fb), (c, fc) = three
    below = (b - a) * (fb - fc) - (b - c) * (fb - fa)
    return b if not below else b - 0.5 * ((b - a) ** 2 * (fb - fc) - (b - c) ** 2 * (fb - fa)) / below


def scale_yeo_johnson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Yeo-Johnson power transform + standardisation."""
    return apply_scaler(df, fit_yeo_johnson(df, cols))


# --------------------------------------------------------------------------
# I15 column transformer
# --------------------------------------------------------------------------

# Scaler per feature family and the output-name prefixes.
FAMILY_PREFIX = {"yeo_johnson": "time_power__", "minmax": "pct_minmax__", "standard": "count_std__",
                 "robust": "stat_robust__"}
LINK_PREFIX = "link_std__"
REMAINDER_PREFIX = "remainder__"


def default_groups(cols: Sequence[str]) -> dict[str, list[str]]:
    """Feature families by name: time/hours/duration -> power, pct/ratio -> min-max, count -> standard,
    statistics (std/skew/kurtosis/iqr/p25..) -> robust, link -> standard (own prefix)."""
    groups = {"time": [], "pct": [], "count": [], "stat": [], "link": []}
    for c in cols:
        n = c.lower()
        if "link" in n or "inward" in n or "outward" in n:
            groups["link"].append(c)
        elif any(t in n for t in ("hours", "time", "duration", "days")) and not any(t in n for t in ("std", "skew", "kurt", "iqr")):
            groups["time"].append(c)
        elif "pct" in n or "ratio" in n or "rate" in n:
            groups["pct"].append(c)
        elif "count" in n or "total" in n or "num_" in n:
            groups["count"].append(c)
        elif any(t in n for t in ("std", "skew", "kurt", "iqr", "_p25", "_p75", "_p90", "median")):
            groups["stat"].append(c)
    return groups


def fit_column_transformer(df: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None,
                           exact: bool = True) -> DataFrame:
    """I15 fit: one parameter table for every feature (kind by family; passthrough as 'remainder').

    All moment-based parameters (standard: mean / population std, min-max:
    min / max) come from one aggregation, the robust quartiles from one
    quantile pass, and the Yeo-Johnson lambdas from the grid search.
    """
    from ..functions.stats import column_quantiles

    groups = default_groups(features) if groups is None else groups
    kind_of = {"time": "yeo_johnson", "pct": "minmax", "count": "standard", "stat": "robust", "link": "standard"}
    plan: dict[str, tuple[str, str]] = {}
    for fam, cols in groups.items():
        for c in cols:
            if c in features and c not in plan:
                plan[c] = (kind_of[fam], LINK_PREFIX if fam == "link" else FAMILY_PREFIX[kind_of[fam]])
    std = [c for c, (k, _) in plan.items() if k == "standard"]
    mm = [c for c, (k, _) in plan.items() if k == "minmax"]
    rob = [c for c, (k, _) in plan.items() if k == "robust"]
    yj = [c for c, (k, _) in plan.items() if k == "yeo_johnson"]
    exprs = {f"{c}\u0000a": F.avg(q(c)) for c in std} | {f"{c}\u0000b": F.stddev_pop(q(c)) for c in std}
    exprs |= {f"{c}\u0000a": F.min(q(c)).cast("double") for c in mm} | {f"{c}\u0000b": F.max(q(c)).cast("double") for c in mm}
    st = column_stats(df, exprs) if exprs else {}
    qs = column_quantiles(df, rob, [0.25, 0.5, 0.75], exact) if rob else {}
    lam = {r["column"]: r for r in fit_yeo_johnson(df, yj).collect()} if yj else {}
    rows = []
    for c, (k, prefix) in plan.items():
        if k in ("standard", "minmax"):
            rows.append((c, k, st.get(f"{c}\u0000a"), st.get(f"{c}\u0000b"), None, prefix))
        elif k == "robust":
            v = qs.get(c) or [None, None, None]
            rows.append((c, k, v[1], (v[2] - v[0]) if v[0] is not None else None, None, prefix))
        elif c in lam:
            r = lam[c]
            rows.append((c, k, r["p1"], r["p2"], r["lam"], prefix))
        else:  # no usable lambda (e.g. all null): pass through
            rows.append((c, "remainder", None, None, None, REMAINDER_PREFIX))
    rows += [(c, "remainder", None, None, None, REMAINDER_PREFIX) for c in features if c not in plan]
    return df.sparkSession.createDataFrame(rows, PARAM_SCHEMA + ", prefix string")


def apply_column_transformer(df: DataFrame, params: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """I15 apply: transformed features with family prefixes, NaN/null -> 0, ``keep`` columns (ids, targets) untouched."""
    rows = params.collect()
    cols = [q(k) for k in keep]
    for r in rows:
        c = r["column"]
        e = q(c).cast("double") if r["kind"] == "remainder" else _scale_expr(q(c), r["kind"], r["p1"], r["p2"], r["lam"])
        e = F.when(e.isNull() | F.isnan(e), F.lit(0.0)).otherwise(e)
        cols.append(e.alias(r["prefix"] + c))
    return df.select(*cols)


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric_columns(df) if c not in set(exclude)]
