"""Fitted models as arrays, applied in one Arrow pass.

A linear model is its weights; a forest or boosted ensemble is its table of
nodes, which Spark ML itself writes when it saves a model. As arrays they can
be chosen row by row, or fed altered features, inside one task, where a
``transform`` per model or per altered column would scan the input each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .columns import q

#: Bytes of all models' arrays that are shipped with the tasks at most.
MODEL_MAX_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class LinearArrays:
    intercept: float
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    @property
    def nbytes(self) -> int:
        return self.weights.nbytes


@dataclass(frozen=True)
class TreeArrays:
    """Nodes of all trees, a tree's root first: feature (-1: a leaf), threshold, children, value times the tree's weight."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            todo = rows
            while len(todo):
                todo = todo[self.feature[at[todo]] >= 0]
                node = at[todo]
                at[todo] = np.where(x[todo, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[at]
        return out

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.roots, self.feature, self.threshold, self.left, self.right, self.value))


def as_arrays(spark: SparkSession, model: PipelineModel) -> LinearArrays | TreeArrays:
    """The last stage of an (assembler, regressor) pipeline as arrays. A category split is refused."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        return LinearArrays(float(last.intercept), last.coefficients.toArray())
    path = scratch_table_path(spark)
    last.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.split.numCategories").alias("categories"))
    rows = nodes.orderBy("treeID", "id").toArrow()
    tree, node = rows["treeID"].to_numpy(), rows["id"].to_numpy()
    feature = rows["feature"].to_numpy()
    if ((rows["categories"].to_numpy() >= 0) & (feature >= 0)).any():
        raise ValueError("splits on categories are not supported")
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    start = roots[np.searchsorted(tree[roots], tree)]
    if not np.array_equal(node, np.arange(len(node)) - start):
        raise ValueError("a tree's nodes are not numbered from 0 on")
    weight = np.asarray(last.treeWeights)
    if "GBT" not in type(last).__name__:
        weight = weight / weight.sum()              # a forest's trees are averaged
    return TreeArrays(roots, feature, rows["threshold"].to_numpy(zero_copy_only=False).astype(float), start + rows["leftChild"].to_numpy(),
                      start + rows["rightChild"].to_numpy(), rows["prediction"].to_numpy() * weight[tree])


def _matrix(b: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """``n`` double columns from ``first`` on; null as nan, which goes right at a split as in Spark ML."""
    return np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)]) if n else np.zeros((b.num_rows, 0))


def _checked(models: Mapping) -> None:
    size = sum(m.nbytes for m in models.values())
    if size > MODEL_MAX_BYTES:
        raise ValueError(f"the models' arrays hold {size} bytes; {MODEL_MAX_BYTES} at most are shipped to every task")


def predict_by_group(df: DataFrame, models: Mapping[object, LinearArrays | TreeArrays], group: str, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """``df`` with each row's value by its group's model, or by the model under None; one pass, no shuffle."""
    _checked(models)
    named, names = {g: m for g, m in models.items() if g is not None}, df.columns
    rest, n, width = models[None], len(features), len(names)
    shared = df.sparkSession.sparkContext.broadcast((named, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_group, of_rest = shared.value
        for b in batches:
            x = _matrix(b, width + 1, n)
            code = b.column(width).dictionary_encode(null_encoding="encode")
            at = code.indices.to_numpy(zero_copy_only=False)
            value = np.full(len(x), np.nan)
            for i, g in enumerate(code.dictionary.to_pylist()):
                own = at == i
                value[own] = (of_rest if g is None else of_group.get(g, of_rest)).predict(x[own])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(value)], [*names, out])

    rows = df.select(*[q(c) for c in df.columns], q(group).alias("_group"), *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return rows.mapInArrow(run, fields + f"`{out}` double")


def shuffled_errors(df: DataFrame, model: LinearArrays | TreeArrays, features: Sequence[str], label: str, shuffled: str) -> DataFrame:
    """Mean squared errors ``feature, repeat, mse``: of each feature, replaced by the values in each entry of ``shuffled``.

    ``shuffled`` is a list of feature lists (an entry per repeat). The row
    ``(-1, -1)`` is the error of the features as they are. One Arrow pass sums
    all (feature, repeat) errors; Spark adds the sums.
    """
    _checked({0: model})
    n = len(features)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], float] = {}
        rows = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                y, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b, 1, n)
                other = b.column(n + 1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1, n)
                rows += len(y)
                total[-1, -1] = total.get((-1, -1), 0.0) + float(((y - shared.value.predict(x)) ** 2).sum())
                for r in range(other.shape[1]):
                    for f in range(n):
                        held = x[:, f].copy()
                        x[:, f] = other[:, r, f]
                        total[f, r] = total.get((f, r), 0.0) + float(((y - shared.value.predict(x)) ** 2).sum())
                        x[:, f] = held
        if rows:
            yield pa.RecordBatch.from_pydict({"feature": pa.array([k[0] for k in total], pa.int32()), "repeat": pa.array([k[1] for k in total], pa.int32()),
                                              "error": pa.array(list(total.values()), pa.float64()), "rows": pa.array([rows] * len(total), pa.int64())})

    rows = df.select(q(label).cast("double").alias("_y"), *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], q(shuffled).alias("_s")) \
        .where("_y IS NOT NULL")
    return (rows.mapInArrow(run, "feature int, repeat int, error double, rows long").groupBy("feature", "repeat")
            .agg((F.sum("error") / F.sum("rows")).alias("mse")))
