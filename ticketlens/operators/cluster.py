"""Project clustering with Spark ML KMeans and PCA, Euclidean silhouettes and Davies-Bouldin.

The only driver-side work is choosing k / hyper-parameters from a handful of
scalar scores; every fit, distance and score is a distributed job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, reuse
from ..sources.tables import small_side
from .columns import q
from .impute import _median_values

FEATURES = "features"


def prepare(df: DataFrame, features: Sequence[str] | None = None, vector_col: str | None = None,
            out: str = FEATURES) -> DataFrame:
    """Median-fill the key features and standardise them (population-style: mean 0, unit std) into a vector."""
    if vector_col is not None:
        v = df.withColumn("_raw", array_to_vector(F.col(vector_col).cast("array<double>")))
    else:
        med = _median_values(df, list(features))
        filled = df.withColumns({f: F.coalesce(q(f).cast("double"), F.lit(med.get(f) or 0.0)) for f in features})
        v = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(v)
    return scaler.transform(v).drop("_raw")


def kmeans(df: DataFrame, k: int, seed: int = 42, n_init: int = 1, max_iter: int = 300, init: str = "k-means||",
           features: str = FEATURES) -> KMeansModel:
    """KMeans; ``n_init`` seeds are tried and the lowest training cost kept."""
    best, best_cost = None, np.inf
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode=init, featuresCol=features).fit(df)
        cost = m.summary.trainingCost
        if cost < best_cost:
            best, best_cost = m, cost
    return best


def davies_bouldin(pred: DataFrame, model: KMeansModel, features: str = FEATURES, cluster: str = "prediction") -> float:
    """Davies-Bouldin index: mean over clusters of the worst (s_i + s_j) / d(c_i, c_j).

    s_i (mean distance to the centre) is one grouped aggregation; the k x k
    centre distances are computed from the k centres.
    """
    centers = [np.asarray(c) for c in model.clusterCenters()]
    k = len(centers)
    cen = pred.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                            f"{cluster} int, _c array<double>")
    d = (pred.select(cluster, vector_to_array(features).alias("_v")).join(F.broadcast(cen), cluster)
         .select(cluster, F.sqrt(F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                             lambda acc, x: acc + x)).alias("_d")))
    s = {r[cluster]: r["s"] for r in d.groupBy(cluster).agg(F.avg("_d").alias("s")).collect()}
    worst = []
    for i in range(k):
        ratios = [(s.get(i, 0.0) + s.get(j, 0.0)) / np.linalg.norm(centers[i] - centers[j])
                  for j in range(k) if j != i and np.linalg.norm(centers[i] - centers[j]) > 0]
        worst.append(max(ratios) if ratios else 0.0)
    return float(np.mean(worst)) if worst else float("nan")


#: Rows per cluster whose silhouettes are computed, each against all rows.
SILHOUETTE_ROWS = 200


def euclidean_silhouette(pred: DataFrame, k: int, per_cluster: int = SILHOUETTE_ROWS, features: str = FEATURES,
                         cluster: str = "prediction") -> tuple[float, float]:
    """Mean silhouette in Euclidean distance, and its standard error.

    Exact for tables whose clusters have ``per_cluster`` rows at most. Of larger
    clusters that many rows, by the hash of their vector, stand for the
    cluster: their silhouettes are exact, since one Arrow pass sums their
    distances to all rows of every cluster, block by block; the mean weighs clusters by
    their size, and the error is that of a stratified sample. A row that is alone in its
    cluster has silhouette 0, as has every row when there is one cluster.
    """
    rows = pred.select(F.col(cluster).cast("int").alias("_c"), vector_to_array(features).alias("_v"))
    size = np.zeros(k)
    for r in rows.groupBy("_c").count().collect():
        size[r["_c"]] = r["count"]
    if (size > 0).sum() < 2:
        return 0.0, 0.0
    first = F.row_number().over(Window.partitionBy("_c").orderBy(F.xxhash64("_v"), "_v"))
    picked = rows.withColumn("_r", first).where(F.col("_r") <= per_cluster).orderBy("_c", "_r").select("_c", "_v").collect()
    at = np.array([r["_v"] for r in picked])
    own = np.array([r["_c"] for r in picked])
    square = (at * at).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), k))
        for b in batches:
            c = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
            for start in range(0, len(c), 1024):
                part, of = x[start:start + 1024], c[start:start + 1024]
                d = np.sqrt(np.maximum(square[:, None] + (part * part).sum(axis=1) - 2 * at @ part.T, 0.0))
                for i in np.unique(of):
                    total[:, i] += d[:, of == i].sum(axis=1)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    total = np.zeros(len(at) * k)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    total = total.reshape(len(at), k)
    index = np.arange(len(at))
    inside = total[index, own] / np.maximum(size[own] - 1, 1)
    others = np.where((size > 0) & (np.arange(k) != own[:, None]), total / np.maximum(size, 1), np.inf).min(axis=1)
    widest = np.maximum(inside, others)
    value = np.where((size[own] > 1) & (widest > 0), (others - inside) / np.where(widest > 0, widest, 1), 0.0)
    mean = error = 0.0
    for i in range(k):
        part = value[own == i]
        if len(part):
            mean += size[i] / size.sum() * part.mean()
            if 1 < len(part) < size[i]:
                error += (size[i] / size.sum()) ** 2 * part.var(ddof=1) / len(part) * (1 - len(part) / size[i])
    return float(mean), float(np.sqrt(error))


def choose_k(df: DataFrame, ks: Sequence[int] = range(2, 9), seed: int = 42, features: str = FEATURES) -> DataFrame:
    """Per k the inertia, silhouette (Euclidean, with its standard error) and Davies-Bouldin, plus
    the votes of the elbow (largest |second difference| of inertia), max silhouette and min DB; the
    majority wins, silhouette breaks ties. Returns one row per k with a ``chosen`` flag."""
    rows = []
    for k in ks:
        m = kmeans(df, k, seed, features=features)
        p = reuse(m.transform(df).select(features, "prediction"))
        rows.append((k, float(m.summary.trainingCost), *euclidean_silhouette(p, k, features=features), davies_bouldin(p, m, features)))
    ks_l = [r[0] for r in rows]
    inert = [r[1] for r in rows]
    votes = {k: 0 for k in ks_l}
    if len(inert) >= 3:
        d2 = [abs(inert[i - 1] - 2 * inert[i] + inert[i + 1]) for i in range(1, len(inert) - 1)]
        votes[ks_l[1 + int(np.argmax(d2))]] += 1
    sil_k = ks_l[int(np.argmax([r[2] for r in rows]))]
    votes[sil_k] += 1
    votes[ks_l[int(np.argmin([r[4] for r in rows]))]] += 1
    top = max(votes.values())
    leaders = [k for k, v in votes.items() if v == top]
    chosen = sil_k if sil_k in leaders else leaders[0]
    return df.sparkSession.createDataFrame(
        [(k, i, s, e, db, votes[k], k == chosen) for k, i, s, e, db in rows],
        "k int, inertia double, silhouette double, silhouette_error double, davies_bouldin double, votes int, chosen boolean")


def tune_kmeans(df: DataFrame, k: int, inits: Sequence[str] = ("k-means||", "random"), n_inits: Sequence[int] = (1, 3),
                max_iters: Sequence[int] = (20, 100), seed: int = 42, features: str = FEATURES) -> DataFrame:
    """Grid over init mode x n_init x max_iter scored by the Euclidean silhouette."""
    rows = []
    for init in inits:
        for n in n_inits:
            for it in max_iters:
                m = kmeans(df, k, seed, n, it, init, features)
                rows.append((init, n, it, euclidean_silhouette(m.transform(df).select(features, "prediction"), k, features=features)[0]))
    return df.sparkSession.createDataFrame(rows, "init string, n_init int, max_iter int, silhouette double") \
        .orderBy(F.col("silhouette").desc(), "init", "n_init", "max_iter")


def pca2(df: DataFrame, features: str = FEATURES) -> DataFrame:
    """First two principal components as pca_x, pca_y (features are already centred; sign is arbitrary)."""
    m = PCA(k=2, inputCol=features, outputCol="_pca").fit(df)
    t = m.transform(df).withColumn("_arr", vector_to_array("_pca"))
    return t.withColumns({"pca_x": F.col("_arr")[0], "pca_y": F.col("_arr")[1]}).drop("_pca", "_arr")


def two_stage(projects: DataFrame, cluster_features: Sequence[str], tasks: DataFrame, reg_features: Sequence[str], label: str, k: int,
              project: str, key: str, seed: int = 42, kinds: Sequence[str] = ("linear", "ridge", "lasso", "elastic_net"), min_train: int = 10,
              min_valid: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classify the projects, then fit a model set per class on their tasks (M12) and score every task routed.

    Returns the scored tasks (``cluster``, ``prediction``, ``global_prediction``,
    ``routed``), the comparison of global and class models on the held-out fifth
    of the tasks, and ``stage, seconds``. Classes are a column of the project
    table, so only that small table is clustered; tasks of unknown projects have
    no class and are scored by the global model. Each stage's input is written once.
    """
    import time

    from . import linear as L
    from .sampling import random_split

    seconds: list[tuple[str, float]] = []

    def timed(name: str, make):
        start = time.perf_counter()
        out = make()
        seconds.append((name, time.perf_counter() - start))
        return out

    prepared = timed("prepare", lambda: cut_lineage(prepare(projects, cluster_features).select(F.col(project).alias("_project"), FEATURES)))
    model = timed("classify", lambda: kmeans(prepared, k, seed))
    classes = model.transform(prepared).select("_project", F.col("prediction").alias("cluster"))
    labelled = timed("label", lambda: cut_lineage(random_split(
        tasks.join(small_side(classes), F.col(project) == F.col("_project"), "left").drop("_project"), [0.8, 0.2], key, seed)))
    train, valid = labelled.where("split = 0"), labelled.where("split = 1")
    family = [p for p in L.FAMILY if p.kind in kinds]
    models = timed("regression", lambda: cut_lineage(L.fit_family_per_group(train, valid, "cluster", reg_features, label, family, min_train, min_valid)))
    scored = L.predict_family(labelled.drop("split"), models, "cluster", reg_features)
    compared = timed("compare", lambda: cut_lineage(L.compare_global(L.predict_family(valid, models, "cluster", reg_features), "cluster", label)))
    return scored, compared, projects.sparkSession.createDataFrame(seconds, "stage string, seconds double")
