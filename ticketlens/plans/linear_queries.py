"""Linear family, searches over folds and model sets per group, from sums of products.

With one feature every kind of the family has a closed form, which the SQL
spells out; the entries over all features are held against numpy in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as L
from ..operators import search as SE
from ..operators.sampling import HASH_DIGITS, hash_order_sql
from .catalog import register
from .model_queries import FEATS, SEED, split_sets, three_sets
from .sqlbase import ISSUES_TL, with_issues

ONE = ["outward_count"]
FOLDS = 5
#: The exhaustive grid: every kind, penalties over four decades.
GRID = {"linear": {}, "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]}, "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
        "elastic_net": {"alpha": [0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]}}


def _unit(seed: int) -> str:
    return f"({hash_order_sql('id', seed)} / CAST({1 << 4 * HASH_DIGITS} AS DOUBLE))"


ROWS_SQL = ISSUES_TL + f""",
rows AS (SELECT id, repository, CAST(outward_count AS DOUBLE) AS x, ln(1 + greatest(coalesce(resolution_time_hours, 0.0), 0.0)) AS y,
                {_unit(SEED)} AS u, CAST(floor({_unit(42)} * {FOLDS}) AS INTEGER) AS fold
         FROM itl WHERE resolution_time_hours IS NOT NULL)"""

SLOPE_SQL = """CASE kind WHEN 'linear' THEN sxy / sxx WHEN 'ridge' THEN sxy / (sxx + alpha)
       ELSE sign(sxy) * greatest(abs(sxy) / n - alpha * l1_ratio, 0) / (sxx / n + alpha * (1 - l1_ratio)) END"""


def _grid_sql(points) -> str:
    return ", ".join(f"({i}, '{p.kind}', CAST({p.alpha} AS DOUBLE), CAST({p.l1_ratio} AS DOUBLE))" for i, p in enumerate(points))


@register("M1_linear_family_one_feature", with_issues(f""",
kinds(point, kind, alpha, l1_ratio) AS (VALUES {_grid_sql(L.FAMILY)}),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM rows WHERE u < 0.8),
m AS (SELECT kind, {SLOPE_SQL} AS w, mx, my FROM kinds, s)
SELECT id, kind AS model, my - w * mx + w * x AS prediction FROM rows, m WHERE u >= 0.8""", ROWS_SQL))
def q_linear_family_one(spark, sf_dir):
    """M1: least squares, ridge, lasso and elastic net with one feature, from one pass; test predictions."""
    train, test = split_sets(spark, sf_dir)
    models = L.fit_family(train, ONE, "y")
    kinds = F.explode(F.create_map(*[x for k, m in models.items() for x in (F.lit(k), _value(m, ONE))]))
    return test.select("id", kinds.alias("model", "prediction"))


def _value(model: L.Linear, features):
    out = F.lit(model.intercept)
    for f, w in zip(features, model.coefficients):
        out = out + F.lit(float(w)) * F.col(f).cast("double")
    return out


@register("M7_M8_grid_one_feature", with_issues(f""",
grid(point, kind, alpha, l1_ratio) AS (VALUES {_grid_sql(L.grid_of(GRID))}),
tr AS (SELECT x, y, fold FROM rows WHERE u < 0.8),
s AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy
      FROM tr JOIN (SELECT DISTINCT fold AS k FROM tr) ON fold <> k GROUP BY k),
m AS (SELECT point, kind, alpha, l1_ratio, k, mx, my, {SLOPE_SQL} AS w FROM grid, s),
e AS (SELECT point, k, sum((y - my - w * (x - mx)) * (y - my - w * (x - mx))) AS sse, var_pop(y) * count(*) AS sst, count(*) AS n
      FROM m JOIN tr ON fold = k GROUP BY point, k)
SELECT g.point, g.kind, g.alpha, g.l1_ratio, avg(1 - sse / sst) AS r2_mean, stddev_pop(1 - sse / sst) AS r2_std,
       avg(sqrt(sse / n)) AS rmse_mean, stddev_pop(sqrt(sse / n)) AS rmse_std
FROM grid g JOIN e USING (point) GROUP BY ALL""", ROWS_SQL))
def q_grid_one(spark, sf_dir):
    """M7 + M8: the exhaustive grid over five folds with one feature: R² and RMSE mean and deviation of each point."""
    train, _ = split_sets(spark, sf_dir)
    return L.tune_linear(train, ONE, "y", L.grid_of(GRID), "id", FOLDS)


@register("M7_grid_linear")
def q_grid_linear(spark, sf_dir):
    """M7: the exhaustive grid over five folds with all features, from fold sums, with rank metrics."""
    train, _ = split_sets(spark, sf_dir)
    return L.tune_linear(train, FEATS, "y", L.grid_of(GRID), "id", FOLDS, rank_metrics=True)


@register("M7_random_search_linear")
def q_random_linear(spark, sf_dir):
    """M7: 20 seeded draws of kind and penalty, five folds, by Spearman; every draw is a row."""
    train, _ = split_sets(spark, sf_dir)
    space = {"alpha": SE.LogUniform(1e-3, 1e2), "l1_ratio": SE.Uniform(0.05, 1.0)}
    return SE.random_search_linear(train, FEATS, "y", ("ridge", "lasso", "elastic_net"), space, "id", n=20, folds=5, metric="spearman")


@register("M7_random_search_forest")
def q_random_forest(spark, sf_dir):
    """M7: 10 seeded draws of a forest's parameters, three folds, by MAE; every draw is a row."""
    train, _ = split_sets(spark, sf_dir)
    return SE.random_search(train, FEATS, "y", "random_forest", SE.FOREST_SPACE | {"numTrees": [10, 20, 30], "maxDepth": SE.Integers(3, 6)}, n=10, folds=3, metric="mae")


COMPARE_SQL = with_issues(""",
tr AS (SELECT * FROM rows WHERE u < 0.6), va AS (SELECT * FROM rows WHERE u >= 0.6 AND u < 0.8), te AS (SELECT * FROM rows WHERE u >= 0.8),
own AS (SELECT t.repository, regr_slope(t.y, t.x) AS w, regr_intercept(t.y, t.x) AS b FROM tr t GROUP BY t.repository
        HAVING count(*) >= 50 AND (SELECT count(*) FROM va v WHERE v.repository = t.repository) >= 20),
base AS (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM tr),
p AS (SELECT te.repository, te.y, base.b + base.w * te.x AS g, own.b + own.w * te.x AS o FROM te CROSS JOIN base LEFT JOIN own ON te.repository = own.repository),
one AS (SELECT 'Global' AS model, count(*) AS n, sqrt(avg((y - g) * (y - g))) AS rmse, avg(abs(y - g)) AS mae,
               1 - sum((y - g) * (y - g)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - g) / greatest(abs(y), 1e-10)) AS mmre FROM p),
each AS (SELECT 'Cluster ' || repository AS model, count(*) AS n, sqrt(avg((y - o) * (y - o))) AS rmse, avg(abs(y - o)) AS mae,
                1 - sum((y - o) * (y - o)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - o) / greatest(abs(y), 1e-10)) AS mmre
         FROM p WHERE o IS NOT NULL GROUP BY repository),
mean AS (SELECT 'Cluster Average' AS model, CAST(sum(n) AS BIGINT) AS n, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2, avg(mmre) AS mmre FROM each
         UNION ALL SELECT 'Weighted Average', CAST(sum(n) AS BIGINT), sum(rmse * n) / sum(n), sum(mae * n) / sum(n), sum(r2 * n) / sum(n), sum(mmre * n) / sum(n) FROM each)
SELECT *, NULL::DOUBLE AS rmse_improvement, NULL::DOUBLE AS r2_improvement, NULL::DOUBLE AS mmre_improvement FROM one
UNION ALL SELECT *, NULL, NULL, NULL FROM each
UNION ALL SELECT m.*, (one.rmse - m.rmse) / one.rmse * 100, (m.r2 - one.r2) / greatest(0.0001, abs(one.r2)) * 100,
                 (one.mmre - m.mmre) / greatest(0.0001, one.mmre) * 100 FROM mean m, one WHERE m.n IS NOT NULL""", ROWS_SQL)


@register("M12_M13_compare_global", COMPARE_SQL)
def q_compare_global(spark, sf_dir):
    """M12 + M13: least squares per repository (50 training and 20 validation rows at least) against the global model on test rows."""
    train, valid, test = three_sets(spark, sf_dir)
    models = L.fit_family_per_group(train, valid, "repository", ONE, "y", [L.FAMILY[0]])
    return L.compare_global(L.predict_family(test.select("id", "repository", "y", *ONE), models, "repository", ONE), "repository", "y")


@register("M12_fit_family_per_group")
def q_family_per_group(spark, sf_dir):
    """The best of four kinds per project, and the global model, from grouped sums."""
    train, valid, _ = three_sets(spark, sf_dir)
    return L.fit_family_per_group(train, valid, "project_id", FEATS, "y", min_train=50, min_valid=20)
