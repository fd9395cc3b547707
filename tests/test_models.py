"""Property tests for the model operators (no SQL oracle: invariants, exact cases, determinism)."""

import math

from pyspark.sql import functions as F

from ticketlens.operators import model as M


def test_evaluate_perfect_and_spearman_ties(spark):
    df = spark.createDataFrame([(float(math.log1p(v)),) for v in [1, 2, 2, 5, 9]], "y double").withColumn("prediction", F.col("y"))
    r = M.evaluate(df, "y").first()
    assert abs(r["mae"]) < 1e-9 and abs(r["rmse"]) < 1e-9 and abs(r["r2"] - 1.0) < 1e-9 and abs(r["spearman"] - 1.0) < 1e-9
    # Spearman with ties: ranks of a = 1, 2.5, 2.5, 4 ; b = 4, 3, 2, 1 -> pearson of those ranks
    d = spark.createDataFrame([(1.0, 4.0), (2.0, 3.0), (2.0, 2.0), (3.0, 1.0)], "a double, b double")
    got = M.spearman(d, "a", "b").first()[0]
    ra, rb = [1, 2.5, 2.5, 4], [4, 3, 2, 1]
    ma, mb = sum(ra) / 4, sum(rb) / 4
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb))
    want = cov / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert abs(got - want) < 1e-12


def test_linear_per_group_recovers_coefficients(spark):
    rows = [("g1", float(x), 2.0 + 3.0 * x) for x in range(20)] + [("g2", float(x), -1.0 + 0.5 * x) for x in range(20)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r["g"]: r for r in M.fit_linear_per_group(df, "g", ["x"], "y").collect()}
    assert abs(out["g1"]["intercept"] - 2.0) < 1e-4 and abs(out["g1"]["coefficients"][0] - 3.0) < 1e-5
    assert abs(out["g2"]["intercept"] + 1.0) < 1e-4 and abs(out["g2"]["coefficients"][0] - 0.5) < 1e-5
    scored = M.predict_linear_per_group(df, M.fit_linear_per_group(df, "g", ["x"], "y"), "g", ["x"])
    assert scored.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-3


def test_forest_is_deterministic_under_seed(spark):
    df = spark.range(0, 300).select(F.col("id").cast("double").alias("x"), ((F.col("id") * 7) % 13).cast("double").alias("z"),
                                    ((F.col("id") % 17) * 1.5).alias("y"))
    a = M.fit_regressors(df, ["x", "z"], "y", ("random_forest",), 7, {"random_forest": {"numTrees": 10}})["random_forest"]
    b = M.fit_regressors(df, ["x", "z"], "y", ("random_forest",), 7, {"random_forest": {"numTrees": 10}})["random_forest"]
    pa = [r[0] for r in a.transform(df).orderBy("x").select("prediction").collect()]
    pb = [r[0] for r in b.transform(df).orderBy("x").select("prediction").collect()]
    assert pa == pb
    imp = M.feature_importance(a, ["x", "z"]).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9


def test_compare_sign_by_direction(spark):
    o = spark.createDataFrame([("m", "mae", 10.0), ("m", "r2", 0.5)], "model string, metric string, value double")
    n = spark.createDataFrame([("m", "mae", 8.0), ("m", "r2", 0.6)], "model string, metric string, value double")
    got = {r["metric"]: r["improvement"] for r in M.compare(o, n).collect()}
    assert abs(got["mae"] - 20.0) < 1e-9 and abs(got["r2"] - 20.0) < 1e-9


def test_choose_k_flags_one_k(spark):
    from ticketlens.operators import cluster as CL

    pts = [(float(cx + dx), float(cy + dy)) for cx, cy in [(0, 0), (10, 10), (20, 0)] for dx in (0, 0.5, 1) for dy in (0, 0.5)]
    df = CL.prepare(spark.createDataFrame(pts, "a double, b double"), ["a", "b"])
    res = CL.choose_k(df, range(2, 5), 1).collect()
    assert sum(1 for r in res if r["chosen"]) == 1
    assert [r for r in res if r["chosen"]][0]["k"] == 3
