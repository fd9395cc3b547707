"""Operators without SQL, against plain Python: routed and shuffled scoring, silhouettes, power transforms, encoders, upserts and streams."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ticketlens.operators import cluster as CL
from ticketlens.operators import model as M
from ticketlens.operators import nested as N
from ticketlens.operators import impute as IM
from ticketlens.operators import profile as PR
from ticketlens.operators import sampling as W
from ticketlens.operators import scale as SC
from ticketlens.operators import stats as S
from ticketlens.sources import files as FS
from ticketlens.sources import issues as SI
from ticketlens.streaming import ingest as ST


# ---- M13, M11 -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def groups(spark):
    return spark.range(400).select("id", F.expr("CASE WHEN id % 50 = 0 THEN NULL ELSE concat('g', id % 3) END").alias("g"),
                                   F.expr("CAST(id % 23 AS DOUBLE)").alias("a"), F.expr("CASE WHEN id % 41 = 7 THEN NULL ELSE CAST(id * 7 % 11 AS DOUBLE) END").alias("b"),
                                   F.expr("CAST(id % 23 * 2 + id * 7 % 11 * (id % 3) AS DOUBLE)").alias("y")).repartition(5)


@pytest.mark.parametrize("kind", ["linear", "random_forest", "gradient_boosting"])
def test_routed_scoring_equals_each_models_transform(groups, kind):
    params = {kind: {"random_forest": {"numTrees": 7, "maxDepth": 4}, "gradient_boosting": {"maxIter": 6, "maxDepth": 3}}.get(kind, {})}
    whole = groups.where("b IS NOT NULL")
    fit = {g: M.fit_regressors(whole.where(c), ["a", "b"], "y", (kind,), 3, params)[kind] for g, c in (("g0", "g = 'g0'"), ("g1", "g = 'g1'"), (None, "true"))}
    got = M.predict_routed(whole, fit, "g", ["a", "b"])
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and got.columns == [*whole.columns, "prediction"]
    rows = {r["id"]: r["prediction"] for r in got.collect()}
    assert len(rows) == whole.count()
    for g, m in fit.items():
        part = whole.where(F.col("g") == g) if g else whole.where("g IS NULL OR g = 'g2'")
        for r in m.transform(part).select("id", "prediction").collect():
            assert rows[r["id"]] == pytest.approx(r["prediction"], abs=1e-9)


def test_shuffled_values_are_permutations(groups):
    got = M.shuffled_values(groups.select("id", "a", "y"), ["a", "y"], "id", 4, 9).collect()
    assert len(got) == 400
    for r in range(4):
        assert sorted(tuple(x["_shuffled"][r]) for x in got) == sorted((x["a"], x["y"]) for x in got)
        assert sum(tuple(x["_shuffled"][r]) == (x["a"], x["y"]) for x in got) < 100
    again = M.shuffled_values(groups.select("id", "a", "y").repartition(3), ["a", "y"], "id", 4, 9).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation_importance_against_transforms(spark, groups):
    whole = groups.where("b IS NOT NULL")
    m = M.fit_regressors(whole, ["a", "b"], "y", ("random_forest",), 3, {"random_forest": {"numTrees": 5, "maxDepth": 4}})["random_forest"]
    got = {r["feature"]: r for r in M.permutation_importance(m, whole, ["a", "b"], "y", "id", 10, 4).collect()}
    shuffled = M.shuffled_values(whole.select("id", "y", "a", "b"), ["a", "b"], "id", 10, 4).cache()

    def rmse(d):
        return m.transform(d).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]

    for i, f in enumerate(["a", "b"]):
        losses = [rmse(shuffled.withColumn(f, F.col("_shuffled")[r][i])) - rmse(whole) for r in range(10)]
        assert got[f]["importance"] == pytest.approx(np.mean(losses), abs=1e-9)
        assert got[f]["importance_std"] == pytest.approx(np.std(losses), abs=1e-9)
    shuffled.unpersist()


def test_number_of_jobs_does_not_follow_the_features(spark, groups):
    whole = groups.where("b IS NOT NULL").withColumns({f"n{i}": F.col("a") * i for i in range(8)})
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for feats in (["a"], ["a", "b", *(f"n{i}" for i in range(8))]):
        m = M.fit_regressors(whole, feats, "y", ("linear",), 3)["linear"]
        spark.sparkContext.setJobGroup(f"importance {len(feats)}", "")
        M.permutation_importance(m, whole, feats, "y", "id", 10, 4).count()
        jobs[len(feats)] = len(tracker.getJobIdsForGroup(f"importance {len(feats)}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[10]) <= 1


# ---- M16-M18 ------------------------------------------------------------------------

def _silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, c == o].mean() for o in set(c) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    c = np.r_[np.zeros(90, int), np.ones(60, int), np.full(30, 2), [3]]
    x = rng.normal(0, 1, (181, 5)) + c[:, None] * 2.0
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(c, x)]
    df = spark.createDataFrame(rows, "prediction int, v array<double>").repartition(4)
    return df.select("prediction", array_to_vector("v").alias("features")), x, c


def test_silhouette_is_euclidean(points):
    df, x, c = points
    mean, error = CL.euclidean_silhouette(df, 4, per_cluster=1000)
    assert mean == pytest.approx(_silhouette(x, c).mean(), abs=1e-6) and error == 0.0
    assert CL.euclidean_silhouette(df.where("prediction = 0"), 4) == (0.0, 0.0)


def test_sampled_silhouette_is_within_its_error(points):
    df, x, c = points
    mean, error = CL.euclidean_silhouette(df, 4, per_cluster=25)
    assert error > 0 and abs(mean - _silhouette(x, c).mean()) < 4 * error


def test_kmeans_repeats_keep_the_lowest_cost(points):
    df, *_ = points
    costs = [CL.kmeans(df.select("features"), 3, 5 + i, init="random").summary.trainingCost for i in range(3)]
    assert CL.kmeans(df.select("features"), 3, 5, n_init=3, init="random").summary.trainingCost == pytest.approx(min(costs))


def test_tuned_kmeans_are_scored_and_sorted(points):
    df, *_ = points
    got = CL.tune_kmeans(df.select("features"), 3, n_inits=(1,), max_iters=(5, 20), seed=5).collect()
    assert len(got) == 4 and [r["silhouette"] for r in got] == sorted((r["silhouette"] for r in got), reverse=True)
    for r in got:
        m = CL.kmeans(df.select("features"), 3, 5, r["n_init"], r["max_iter"], r["init"])
        rows = m.transform(df.select("features")).collect()
        want = _silhouette(np.array([v["features"].toArray() for v in rows]), np.array([v["prediction"] for v in rows])).mean()
        assert r["silhouette"] == pytest.approx(want, abs=1e-6)


def test_pca_against_numpy(points):
    df, x, _ = points
    centred = x - x.mean(axis=0)
    vec = df.sparkSession.createDataFrame([([float(v) for v in r],) for r in centred], "v array<double>").select(array_to_vector("v").alias("features"))
    got = np.array([(r["pca_x"], r["pca_y"]) for r in CL.pca2(vec).select("pca_x", "pca_y").collect()])
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    for i in range(2):
        assert min(np.abs(got[:, i] - want[:, i]).max(), np.abs(got[:, i] + want[:, i]).max()) < 1e-8


# ---- I14, I15 -----------------------------------------------------------------------

def _yj(x, lam):
    return np.array([(math.log1p(v) if abs(lam) < 1e-12 else ((v + 1) ** lam - 1) / lam) if v >= 0 else
                     (-math.log1p(-v) if abs(lam - 2) < 1e-12 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)) for v in x])


def _best_lambda(x):
    def ll(lam):
        return -len(x) / 2 * math.log(_yj(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    low, high = -60.0, 60.0
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if ll(a) < ll(b) else (low, b)
    return (low + high) / 2


def test_yeo_johnson_lambda_is_the_likeliest(spark):
    rng = np.random.default_rng(8)
    cols = {"lognormal": np.exp(rng.normal(2, 1, 300)), "normal": rng.normal(0, 2, 300), "left": -np.exp(rng.normal(1, .7, 300)),
            "far": 9 - np.exp(rng.normal(0, .6, 300)), "counts": rng.poisson(3, 300).astype(float)}
    rows = [tuple(float(v[i]) for v in cols.values()) + (5.0, None) for i in range(300)] + [(None,) * 5 + (5.0, None), (float("nan"),) * 5 + (5.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", constant double, empty double").repartition(3)
    got = {r["column"]: r for r in SC.fit_yeo_johnson(df, df.columns).collect()}
    assert set(got) == set(cols)
    for c, x in cols.items():
        want = _best_lambda(x)
        assert got[c]["lam"] == pytest.approx(want, abs=0.01), c
        t = _yj(x, got[c]["lam"])
        assert (got[c]["p1"], got[c]["p2"]) == pytest.approx((t.mean(), t.std()), rel=1e-6)
    assert abs(got["far"]["lam"]) > 2          # beyond the fine part of the first grid


def test_column_transformer_by_value(spark):
    rows = [(float(i), i * 10.0, (i * 7 % 5) / 4, float(i % 4), None if i == 3 else i * i * 1.0, i * 2.0) for i in range(12)]
    df = spark.createDataFrame(rows, "resolution_hours double, comment_count double, bug_pct double, hours_std double, link_total double, other double")
    params = SC.fit_column_transformer(df, df.columns)
    out = SC.apply_column_transformer(df, params).orderBy("remainder__other").toPandas()
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    assert np.allclose(out["count_std__comment_count"], (x[:, 1] - x[:, 1].mean()) / x[:, 1].std())
    assert np.allclose(out["pct_minmax__bug_pct"], x[:, 2])
    q1, q2, q3 = np.quantile(x[:, 3], [.25, .5, .75])
    assert np.allclose(out["stat_robust__hours_std"], (x[:, 3] - q2) / (q3 - q1))
    link = (x[:, 4] - np.nanmean(x[:, 4])) / np.nanstd(x[:, 4])
    assert np.allclose(out["link_std__link_total"], np.where(np.isnan(link), 0, link))
    lam = _best_lambda(x[:, 0])
    t = _yj(x[:, 0], lam)
    assert np.allclose(out["time_power__resolution_hours"], (t - t.mean()) / t.std(), atol=1e-2)
    assert list(out["remainder__other"]) == [i * 2.0 for i in range(12)]


# ---- N18, X5 ------------------------------------------------------------------------

def test_encoder_is_loaded_once_per_worker(spark, tmp_path):
    """Many tasks and batches; each worker process writes a file when it loads."""
    where = str(tmp_path)

    def load():
        open(os.path.join(where, f"{os.getpid()}-{len(os.listdir(where))}"), "w").close()
        return lambda texts: [[float(len(t)), float(os.getpid())] for t in texts]

    df = spark.createDataFrame([(i, None if i == 5 else "x" * (i % 50)) for i in range(2000)], "id long, text string").repartition(24)
    rows = N.embed_text(df, load=load).collect()
    assert len(rows) == 2000 and all(r["embedding"][0] == len(r["text"] or "") for r in rows)
    loads = [f.split("-")[0] for f in os.listdir(where)]
    assert len(loads) == len(set(loads)) == len({r["embedding"][1] for r in rows}) < 24


def test_default_embedding_by_hand(spark):
    """Term counts times inverse document frequency, unit length."""
    df = spark.createDataFrame([("a a b",), ("b c",), (None,)], "text string")
    rows = N.embed_text(df, num_features=4096).collect()
    weight = {t: math.log((3 + 1) / (n + 1)) for t, n in (("a", 1), ("b", 2), ("c", 1))}
    for r, counts in zip(rows, ({"a": 2, "b": 1}, {"b": 1, "c": 1}, {})):
        want = sorted((n * weight[t] for t, n in counts.items()), reverse=True)
        norm = math.sqrt(sum(v * v for v in want)) or 1.0
        assert sorted((v for v in r["embedding"] if v), reverse=True) == pytest.approx([v / norm for v in want], abs=1e-6)


# ---- S13, ST2 -----------------------------------------------------------------------

def test_repeated_updates_leave_the_row_count(spark):
    issues = spark.createDataFrame([("a", ["old"]), ("b", None), ("c", None)], "key string, comments array<string>")
    news = spark.createDataFrame([("a", ["1"], 1), ("a", ["3"], 3), ("a", ["2"], 2), ("b", None, 1), ("z", ["?"], 9), (None, ["?"], 9)],
                                 "key string, comments array<string>, at int")
    got = SI.upsert_comments(issues, news, order=["at"]).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", ["3"]), ("b", None), ("c", None)]
    once = {SI.upsert_comments(issues, news.repartition(n), order=[]).orderBy("key").first()["comments"][0] for n in (1, 2, 5)}
    assert len(once) == 1       # without an order the content decides, not chance


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_partitions_alone(spark):
    path = FS.scratch_path(spark, "upsert")
    rows = [(f"k{i}", ["old"] if i % 2 else None, "pqr"[i % 3] if i != 7 else None) for i in range(30)]
    SI.append_issues(spark.createDataFrame(rows, "key string, comments array<string>, repository string"), path)
    before = _files(path)
    news = spark.createDataFrame([("k0", ["a"], 1), ("k0", ["b"], 2), ("k3", ["c"], 1), ("k99", ["?"], 1)], "key string, comments array<string>, at int")
    assert SI.upsert_table(spark, path, news, order=["at"]) == ["p"]
    after = _files(path)
    assert {f for f in before if "repository=p" not in f} == {f for f in after if "repository=p" not in f}
    assert all(after[f] == before[f] for f in after if "repository=p" not in f)
    got = {r["key"]: r["comments"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 30 and got["k0"] == ["b"] and got["k3"] == ["c"] and all(got[k] == c for k, c, _ in rows if k not in ("k0", "k3"))
    assert SI.upsert_table(spark, path, news.where("key = 'k99'")) == []
    assert SI.upsert_table(spark, path, spark.createDataFrame([("k7", ["n"])], "key string, comments array<string>")) == [None]
    assert spark.read.parquet(path).count() == 30


UPDATE = "key string, comments array<struct<body:string,at:timestamp_ntz>>, created timestamp_ntz, n long"


def _update(spark, path, rows):
    made = spark.createDataFrame([(k, b, c, n) for k, b, c, n in rows], "key string, b string, c string, n long")
    made.select("key", F.array(F.struct(F.col("b").alias("body"), F.to_timestamp_ntz("c").alias("at"))).alias("comments"),
                F.to_timestamp_ntz("c").alias("created"), "n").coalesce(1).write.mode("append").parquet(path)


def test_stream_resumes_and_skips_what_is_known(spark):
    """Re-delivered, late, equal-time and null-key updates; a restart; then the enriched table."""
    src, log, ckpt = (FS.scratch_path(spark, n) for n in ("st2-src", "st2-log", "st2-ckpt"))
    schema = spark.createDataFrame([], UPDATE).schema

    def run(**more):
        ST.enrich_comments_stream(spark, src, schema, log, ckpt, order=["created", "n"], **more)
        issues = spark.createDataFrame([(k,) for k in "abcde"], "key string").withColumn("comments", F.lit(None).cast("array<struct<body:string,at:timestamp_ntz>>"))
        return {r["key"]: r["comments"][0]["body"] if r["comments"] else None for r in ST.enriched_view(issues, log).collect()}, spark.read.parquet(log).count()

    _update(spark, src, [("a", "a1", "2024-01-01 00:00:00.000001", 1), ("a", "a2", "2024-01-01 00:00:00.000002", 1), ("b", "b1", "2024-01-02 00:00:00", 2), (None, "x", "2024-01-09 00:00:00", 1)])
    assert run() == ({"a": "a2", "b": "b1", "c": None, "d": None, "e": None}, 2)
    assert run()[1] == 2                                            # a restart without files
    _update(spark, src, [("a", "a1", "2024-01-01 00:00:00.000001", 1), ("b", "b1", "2024-01-02 00:00:00", 2), ("b", "late", "2023-01-02 00:00:00", 9)])
    assert run()[1] == 2                                            # re-delivered and late
    _update(spark, src, [("b", "b2", "2024-01-02 00:00:00", 10), ("c", "c1", "2024-01-05 00:00:00", 1), ("d", "old", "2020-01-05 00:00:00", 1)])
    assert run(resume_from=F.col("created") >= F.lit("2024-01-02").cast("timestamp_ntz"))[0] == {"a": "a2", "b": "b2", "c": "c1", "d": None, "e": None}
    assert str(ST.resume_point(spark, log, "created")) == "2024-01-05 00:00:00"
    kept = spark.read.parquet(log).where("comments[0].body = 'a2'").first()
    assert kept["comments"][0]["at"].microsecond == 2
    _update(spark, src, [("c", "c2", "2024-02-05 00:00:00", 1), ("e", "e1", "2024-02-05 00:00:00", 1), ("e", "e2", "2024-02-06 00:00:00", 1)])
    assert run(only_first=True)[0] == {"a": "a2", "b": "b2", "c": "c1", "d": None, "e": "e2"}


def test_hot_key_shrinks_before_the_shuffle():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"_key": ["h"] * 500 + ["k", "k"], "_order": [f"{i:04d}" for i in range(500)] + ["2", "1"], "_payload": [str(i) for i in range(500)] + ["p", "q"]})
    out = pa.Table.from_batches(ST.newest_in_part(iter([b])))
    assert sorted(zip(out["_key"].to_pylist(), out["_payload"].to_pylist())) == [("h", "499"), ("k", "p")]


# ---- A1, A21, A31, I6, I7 -----------------------------------------------------------

@pytest.mark.parametrize(("name", "family"), [
    ("source_file", "core"), ("project_key", "core"), ("project_start_date", "temporal"), ("project_duration_days", "temporal"), ("avg_resolution_hours", "temporal"),
    ("priority_high_count", "priority"), ("type_bug_pct", "issue_type"), ("priority_high_type_bug", "priority_type"), ("inward_count", "dependency"),
    ("num_resolved_issues", "resolution"), ("team_velocity", "efficiency"), ("gini", "other")])
def test_family_of_each_kind(spark, name, family):
    assert S.family_of(name) == family
    assert spark.createDataFrame([(name,)], "c string").select(S.column_family(F.col("c"))).first()[0] == family


def test_profile_of_a_null_tracker(spark):
    from ticketlens.sources import tables as TB
    docs = TB.issue_documents(spark, "/root/testdata/sf0.001")
    named = {r["repository"]: r for r in PR.repository_profile(docs).collect()}
    unknown = docs.withColumn("repository", F.when(F.col("repository") != "ASIA", F.col("repository")))
    got = {r["repository"]: r for r in PR.repository_profile(unknown).collect()}
    assert set(got) == {None, *named} - {"ASIA"}
    assert tuple(got[None])[1:] == tuple(named["ASIA"])[1:] and None not in tuple(got[None])[1:]


def test_column_profile_and_plan_by_hand(spark):
    n = 200
    rows = [(i, str(i * 1.5) if i % 50 else None, f"2024-01-{i % 28 + 1:02d} 10:00:00", "true" if i % 2 else "false", f"c{i % 7}" if i % 10 else None,
             f"h{i % 60}" if i % 4 else None, f"t{i}", None if i % 2 else "x", f"2024-02-{i % 28 + 1:02d}" if i % 12 else None) for i in range(n)]
    cols = ("id", "numeric", "stamp", "flag", "category", "many", "text", "mostly_null", "late")
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in cols[1:]))
    got = {r["column"]: r for r in IM.imputation_plan(S.column_profile(df)).collect()}
    assert {c: (got[c]["kind"], got[c]["action"], got[c]["imputation_strategy"]) for c in cols} == {
        "id": ("numeric", "keep", "median"), "numeric": ("numeric", "keep", "median"), "stamp": ("datetime", "keep", "drop_rows"), "flag": ("boolean", "keep", "mode"),
        "category": ("categorical", "keep", "mode_by_group"), "many": ("high_cardinality", "keep", "mode_by_group"), "text": ("text", "keep", "drop_rows"),
        "mostly_null": ("categorical", "drop", "drop_column"), "late": ("datetime", "keep", "drop_rows")}
    assert got["numeric"]["missing_pct"] == 2.0 and got["category"]["distinct"] == 7 and got["many"]["distinct"] == 60 - 15
    assert (got["stamp"]["min_value"], got["stamp"]["max_value"]) == ("2024-01-01 10:00:00", "2024-01-28 10:00:00")


def test_plan_is_executed(spark):
    rows = [("g", 1.0, "a", 5.0, "p", None, "k1"), ("g", 3.0, "a", None, None, "z", "k2"), ("g", None, None, 7.0, "p", "z", "k3"),
            ("h", 10.0, "b", None, "q", None, None), ("h", None, "b", 100.0, None, "y", "k5"), (None, 4.0, "a", None, None, "y", "k6")]
    df = spark.createDataFrame(rows, "grp string, med double, mod string, gmed double, gmod string, cat string, key string").withColumn("gone", F.lit(1))
    plan = spark.createDataFrame([("med", "median"), ("mod", "mode"), ("gmed", "median_by_group"), ("gmod", "mode_by_group"), ("cat", "new_category"),
                                  ("gone", "drop_column")], "column string, imputation_strategy string")
    out = IM.apply_plan(df, plan, ["grp"], required=["key"])
    assert "gone" not in out.columns
    got = {r["key"]: r for r in out.collect()}
    assert set(got) == {"k1", "k2", "k3", "k5", "k6"}
    assert [got[k]["med"] for k in ("k1", "k2", "k3", "k5", "k6")] == [1, 3, 3.5, 3.5, 4]
    assert got["k3"]["mod"] == "a" and got["k2"]["gmed"] == 6 and got["k2"]["gmod"] == "p" and got["k5"]["gmod"] == "q"
    assert got["k6"]["gmed"] == pytest.approx(7.0) and got["k6"]["gmod"] == "p"        # nothing in its group: overall, after the groups' fills
    assert got["k1"]["cat"] not in (None, "z", "y") and got["k2"]["cat"] == "z"


# ---- M3, M14, M15, M20, W8 ----------------------------------------------------------

@pytest.mark.parametrize(("kind", "least"), [("random_forest", 0.9), ("gradient_boosting", 0.95), ("xgboost", 0.95)])
def test_ensembles_learn_a_surface(spark, kind, least):
    df = spark.range(1200).select(F.expr("CAST(id % 31 AS DOUBLE) / 31").alias("a"), F.expr("CAST(id * 17 % 29 AS DOUBLE) / 29").alias("b"), "id") \
        .withColumn("y", F.sin(F.col("a") * 6) + F.col("b") * F.col("a") * 2)
    params = {kind: {"numTrees": 20} if kind == "random_forest" else {"maxIter": 30}}
    m = M.fit_regressors(df.where("id % 4 <> 0"), ["a", "b"], "y", (kind,), 1, params)[kind]
    r2 = M.evaluate(m.transform(df.where("id % 4 = 0")), "y", log_space=False).first()["r2"]
    assert r2 > least


def test_scored_tasks_by_formula(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), 1.0 + .1 * i + .2 * (i % 3)) for i in range(40)], "id long, a double, b double, y double")
    m = M.fit_regressors(df, ["a", "b"], "y", ("linear",))["linear"]
    for r in M.score_tasks(df, m, ["a", "b"], keep=["id"]).collect():
        h = math.expm1(1 + .1 * r["id"] + .2 * (r["id"] % 3))
        assert (r["predicted_hours"], r["predicted_days"], r["predicted_work_days"], r["lower_bound_hours"], r["upper_bound_hours"]) == \
            pytest.approx((h, h / 24, h / 8, h * .7, h * 1.3), rel=1e-6)
    with pytest.raises(ValueError, match="absent"):
        M.score_tasks(df.drop("b"), m, ["a", "b"])


def test_example_tasks_are_scored_from_the_top_features(spark):
    df = spark.createDataFrame([(i, "pq"[i % 2], float(i), float(i % 5), 0.0, .1 * i) for i in range(60)], "id long, c string, a double, b double, z double, y double")
    feats = ["a", "b", "z"]
    m = M.fit_regressors(df, feats, "y", ("random_forest",), 3, {"random_forest": {"numTrees": 10}})["random_forest"]
    assert M.top_features(m, feats, 2)[0] == "a" and "z" not in M.top_features(m, feats, 2)
    got = {r["name"]: r for r in M.score_examples(df, m, feats, "c", 2).collect()}
    assert set(got) == {*M.COMPLEXITY.values(), "Cluster p specific task", "Cluster q specific task"}
    assert got["Low complexity task"]["predicted_hours"] < got["Medium complexity task"]["predicted_hours"] < got["High complexity task"]["predicted_hours"]
    want = m.transform(spark.createDataFrame([(29.0, 2.0, 0.0)], "a double, b double, z double")).first()["prediction"]
    assert got["Cluster p specific task"]["predicted_hours"] == pytest.approx(math.expm1(want)) and got["Cluster p specific task"]["cluster"] == "p"


def test_two_stages_over_projects(spark):
    """Two kinds of projects whose tasks follow different lines; one task of a project that is not in the table."""
    projects = spark.createDataFrame([(p, float(p % 2) * 10 + p * .01, 1.0) for p in range(8)], "project long, size double, other double")
    tasks = spark.createDataFrame([(i, i % 8, float(i % 11), (3.0 if i % 2 else -2.0) * (i % 11) + i % 2) for i in range(800)] + [(900, 99, 1.0, 1.0)],
                                  "id long, project long, x double, y double")
    scored, compared, seconds = CL.two_stage(projects, ["size", "other"], tasks, ["x"], "y", 2, "project", "id", 4)
    rows = scored.collect()
    assert len(rows) == 801 and {r["cluster"] for r in rows} == {0, 1, None}
    assert all(r["prediction"] == pytest.approx(r["y"], abs=1e-6) and r["routed"] for r in rows if r["id"] != 900)
    assert not next(r for r in rows if r["id"] == 900)["routed"]
    table = {r["model"]: r for r in compared.collect()}
    assert table["Weighted Average"]["rmse"] < 1e-6 < table["Global"]["rmse"]
    assert [r["stage"] for r in seconds.collect()] == ["prepare", "classify", "label", "regression", "compare"] and seconds.where("seconds <= 0").count() == 0


@pytest.mark.parametrize(("counts", "target", "want"), [
    ({"a": 900, "b": 1250, "c": 1400, "d": 300, "e": 50}, 1000, ["b"]),                     # the greatest within 1.3 x target is enough
    ({"a": 650, "d": 300, "e": 250, "f": 50}, 1000, ["a", "e"]),                            # large, a medium (smallest first) up to 0.7; 0.9 is reached
    ({"d": 300, "e": 250, "f": 220, "g": 150}, 1000, ["f", "e", "d", "g"]),                  # no large one
    ({"x": 5000, "s": 10}, 1000, ["s", "x"]),                                              # still short: one more, the greatest
    ({}, 1000, [])])
def test_greedy_mix_of_projects(spark, counts, target, want):
    df = spark.createDataFrame(list(counts.items()), "project_id string, issues long")
    assert W.select_projects(df, target) == want


def test_projects_are_fetched_whole(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "id long, project_id string")
    assert sorted(r["id"] for r in W.fetch_projects(df, ["a", "c"]).collect()) == [i for i in range(30) if i % 3 != 1]
    assert W.fetch_projects(df, [], fallback_rows=7).count() == 7


def test_capped_counts_are_one_pass_without_a_join(spark):
    """A column's values are never dealt by the column's name: that would be a task a column."""
    df = spark.createDataFrame([(float(i % 10), None) for i in range(100)] + [(1000.0, None), (-1000.0, None), (None, None), (float("nan"), None)],
                               "a double, b double")
    got = IM.capped_counts(df, ["a", "b"])
    assert {tuple(r) for r in got.collect()} == {("a", 1, 2, 1), ("b", 0, 0, 104)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert IM.capped_counts(df.where("a > 5000"), ["a"]).collect()[0]["above"] == 0
    assert IM.capped_counts(df.limit(0), ["a"]).collect() == []
