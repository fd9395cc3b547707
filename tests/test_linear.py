"""Linear family from sums of products: against numpy, optimality conditions, folds, groups, searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import linear as L
from ticketlens.operators import search as SE
from ticketlens.operators.sampling import unit_hash

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = np.column_stack([rng.normal(50, 3, n), rng.exponential(2, n), rng.integers(0, 2, n), rng.normal(0, 1e-2, n)]).astype(float)
    y = 3 + 0.5 * x[:, 0] - 1.2 * x[:, 1] + 2 * x[:, 2] + rng.normal(0, 0.7, n)
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    rows = [(i, None if i % 97 == 0 else int(g[i]), *map(float, x[i]), float(y[i])) for i in range(n)]
    rows += [(10_000, 1, None, 1.0, 1.0, 1.0, 1.0), (10_001, 1, 1.0, 1.0, 1.0, 1.0, None), (10_002, 1, 1.0, float("nan"), 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, g int, a double, b double, c double, d double, y double").repartition(6)
    return df, x, y, [r[1] for r in rows[:n]]


def _gradient(x, y, m):
    return x.T @ (y - x @ m.coefficients - m.intercept)


def test_family_meets_its_optimality_conditions(table):
    """Normal equations, ridge's gradient, and the subgradient conditions of lasso and elastic net, in unscaled features."""
    df, x, y, _ = table
    kinds = [*L.FAMILY, L.Penalty("lasso", 1.0, 1.0), L.Penalty("elastic_net", 0.01, 0.8)]
    for k in kinds:
        m = L.fit_family(df, X, "y", [k])[k.kind]
        n, g, w = len(y), _gradient(x, y, m), m.coefficients
        assert abs((y - x @ w - m.intercept).mean()) < 1e-8
        if k.kind in ("linear", "ridge"):
            assert np.abs(g - k.alpha * w).max() < 1e-5
            continue
        l1, l2 = k.alpha * k.l1_ratio, k.alpha * (1 - k.l1_ratio)
        pull = g / n - l2 * w
        for j in range(len(w)):
            if w[j]:
                assert pull[j] == pytest.approx(l1 * np.sign(w[j]), abs=1e-8)
            else:
                assert abs(pull[j]) <= l1 + 1e-8


def test_family_known_values(table):
    df, x, y, _ = table
    z = np.column_stack([np.ones(len(y)), x])
    m = L.fit_family(df, X, "y")
    assert list(m) == ["linear", "ridge", "lasso", "elastic_net"]
    assert np.allclose([m["linear"].intercept, *m["linear"].coefficients], np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-7)
    c = x - x.mean(axis=0)
    assert np.allclose(m["ridge"].coefficients, np.linalg.solve(c.T @ c + np.eye(4), c.T @ (y - y.mean())), atol=1e-7)
    assert m["lasso"].coefficients[3] == 0.0


def test_collinear_and_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, 1.0 + 3 * i) for i in range(30)], "a double, b double, k double, y double")
    for kind, m in L.fit_family(df, ["a", "b", "k"], "y").items():
        got = L.predict_linear(df, m, ["a", "b", "k"]).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert got < (1e-6 if kind == "linear" else 1.0), kind


@pytest.mark.parametrize("folds", [3, 5])
def test_grid_over_folds_against_numpy(table, folds):
    df, x, y, _ = table
    grid = L.grid_of({"linear": {}, "ridge": {"alpha": [0.5, 50.0]}, "lasso": {"alpha": [0.05]}, "elastic_net": {"alpha": [0.05], "l1_ratio": [0.3]}})
    got = {r["point"]: r for r in L.tune_linear(df, X, "y", grid, "id", folds, 7, rank_metrics=True).collect()}
    fold = np.array([r["f"] for r in df.where("id < 10000").orderBy("id").select(F.floor(unit_hash("id", 7) * folds).alias("f")).collect()])

    def ranks(v):
        order = v.argsort()
        out = np.empty(len(v))
        out[order] = np.arange(len(v))
        return np.array([out[v == u].mean() for u in v])

    for i, p in enumerate(grid):
        r2, rmse, mae, rho = [], [], [], []
        for k in range(folds):
            tr, te = fold != k, fold == k
            c, d = x[tr] - x[tr].mean(axis=0), y[tr] - y[tr].mean()
            n = tr.sum()
            if p.kind in ("linear", "ridge"):
                w = np.linalg.solve(c.T @ c + p.alpha * np.eye(4), c.T @ d)
            else:
                w = L.coordinate_descent(c.T @ c / n, c.T @ d / n, np.full(4, p.alpha * p.l1_ratio), np.full(4, p.alpha * (1 - p.l1_ratio)))
            e = y[te] - (y[tr].mean() + (x[te] - x[tr].mean(axis=0)) @ w)
            r2.append(1 - (e @ e) / ((y[te] - y[te].mean()) ** 2).sum())
            rmse.append(np.sqrt((e @ e) / te.sum()))
            mae.append(np.abs(e).mean())
            rho.append(np.corrcoef(ranks(y[te]), ranks(y[te] - e))[0, 1])
        for name, want in (("r2", r2), ("rmse", rmse), ("mae", mae), ("spearman", rho)):
            assert got[i][f"{name}_mean"] == pytest.approx(np.mean(want), abs=1e-6)
            assert got[i][f"{name}_std"] == pytest.approx(np.std(want), abs=1e-6)


def test_cross_validation_is_one_point_of_the_grid(table):
    df, *_ = table
    one = L.cross_validate_linear(df, X, "y", "id").first()
    grid = L.tune_linear(df, X, "y", [L.FAMILY[1], L.FAMILY[0]], "id").where("kind = 'linear'").first()
    assert (one["r2_mean"], one["r2_std"]) == pytest.approx((grid["r2_mean"], grid["r2_std"]))


def test_groups_best_kind_and_fallback(table):
    df, x, y, g = table
    train, valid = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    got = L.fit_family_per_group(train, valid, "g", X, "y", min_train=50, min_valid=20).collect()
    ids, gs = np.arange(len(y)), np.array([-1 if v is None else v for v in g])
    tr, va = ids % 3 != 0, ids % 3 == 0
    want = {v for v in set(gs.tolist()) - {-1} if (gs[tr] == v).sum() >= 50 and (gs[va] == v).sum() >= 20}
    assert {r["g"] for r in got if not r["is_global"]} == want and sum(r["is_global"] for r in got) == 1
    for r in got:
        own_t, own_v = (tr, va) if r["is_global"] else (tr & (gs == r["g"]), va & (gs == r["g"]))
        assert (r["n_train"], r["n_valid"]) == (own_t.sum(), own_v.sum())
        scores = {}
        for k in L.FAMILY:
            c, d, n = x[own_t] - x[own_t].mean(axis=0), y[own_t] - y[own_t].mean(), own_t.sum()
            if k.kind in ("linear", "ridge"):
                w = np.linalg.solve(c.T @ c + k.alpha * np.eye(4), c.T @ d)
            else:
                w = L.coordinate_descent(c.T @ c / n, c.T @ d / n, np.full(4, k.alpha * k.l1_ratio), np.full(4, k.alpha * (1 - k.l1_ratio)))
            e = y[own_v] - (y[own_t].mean() + (x[own_v] - x[own_t].mean(axis=0)) @ w)
            scores[k.kind] = 1 - (e @ e) / ((y[own_v] - y[own_v].mean()) ** 2).sum()
        assert r["r2"] == pytest.approx(max(scores.values()), abs=1e-8) and scores[r["kind"]] == pytest.approx(max(scores.values()), abs=1e-9)
    models = df.sparkSession.createDataFrame(got, L.fit_family_per_group(train, valid, "g", X, "y").schema)
    pred = L.predict_family(df.where("id < 10000"), models, "g", X)
    assert pred._jdf.queryExecution().executedPlan().toString().count("Scan ") <= 2       # the rows' and the models', once each
    for r in pred.collect():
        m = next((m for m in got if not m["is_global"] and m["g"] == r["g"]), next(m for m in got if m["is_global"]))
        assert r["prediction"] == pytest.approx(m["intercept"] + sum(w * r[c] for w, c in zip(m["coefficients"], X)), abs=1e-8)
        assert r["routed"] == (r["g"] in want)


def test_compare_counts_fallback_rows_in_global_alone(spark):
    rows = [("p", 1.0, 1.5, 1.0, True), ("p", 3.0, 2.0, 3.5, True), ("q", 2.0, 2.5, 2.5, False), (None, 4.0, 3.0, 3.0, False)]
    df = spark.createDataFrame(rows, "g string, y double, global_prediction double, prediction double, routed boolean")
    got = {r["model"]: r for r in L.compare_global(df, "g", "y").collect()}
    assert got["Global"]["n"] == 4 and set(got) == {"Global", "Cluster p", "Cluster Average", "Weighted Average"}
    assert got["Cluster p"]["mae"] == 0.25 and got["Cluster Average"]["n"] == 2
    assert got["Weighted Average"]["rmse_improvement"] == pytest.approx((got["Global"]["rmse"] - got["Cluster p"]["rmse"]) / got["Global"]["rmse"] * 100)
    none = L.compare_global(df.withColumn("routed", F.lit(False)), "g", "y").collect()
    assert [r["model"] for r in none] == ["Global"]


def test_draws_are_reproducible_and_distinct():
    space = {"x": [1, 2, 3], "y": ["p", "q"]}
    assert SE.draws(space, 4, 1) == SE.draws(space, 4, 1) != SE.draws(space, 4, 2)
    assert len({tuple(d.items()) for d in SE.draws(space, 4, 1)}) == 4
    assert len(SE.draws(space, 99, 1)) == 6
    mixed = SE.draws({"x": SE.LogUniform(0.01, 10), "k": SE.Integers(2, 4), "u": SE.Uniform(0, 1), "y": ["p"]}, 50, 3)
    assert len(mixed) == 50 and {d["k"] for d in mixed} == {2, 3, 4} and all(0.01 <= d["x"] <= 10 and 0 <= d["u"] <= 1 for d in mixed)


@pytest.mark.parametrize("metric", ["mae", "spearman", "r2"])
def test_random_search_reports_every_draw(table, metric):
    df, *_ = table
    got = SE.random_search_linear(df, X, "y", ("ridge", "lasso"), {"alpha": SE.LogUniform(1e-3, 10)}, "id", 6, 3, metric).collect()
    assert sorted(r["point"] for r in got) == list(range(6)) and sorted(r["rank"] for r in got) == list(range(1, 7))
    best = [r["score"] for r in sorted(got, key=lambda r: r["rank"])]
    assert best == sorted(best, reverse=metric != "mae")


def test_random_search_of_a_forest(table):
    df, *_ = table
    got = SE.random_search(df.where("id < 10000"), X, "y", "random_forest", {"numTrees": [3, 5], "maxDepth": SE.Integers(2, 4)}, 3, 2).collect()
    assert len(got) == 3 and {r["rank"] for r in got} == {1, 2, 3} and set(got[0]["params"]) == {"numTrees", "maxDepth"}


def test_random_search_keeps_only_what_the_models_read(table, monkeypatch):
    """Folds are held in memory while all draws are fitted: vectors and labels, not the table's other columns."""
    df, *_ = table
    kept, fit = [], SE.CrossValidator.fit
    monkeypatch.setattr(SE.CrossValidator, "fit", lambda self, d, *more: kept.append(d.columns) or fit(self, d, *more))
    got = SE.random_search(df.where("id < 3000"), X, "y", "random_forest", {"numTrees": [2], "maxDepth": [2, 3]}, 2, 2).collect()
    assert kept == [["features", "y"]] and {r["rank"] for r in got} == {1, 2} and all(r["score"] > 0 for r in got)
