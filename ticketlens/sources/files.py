"""File sources and sinks.

Parquet is the internal format; CSV and JSON are interchange/export formats.
Scratch output goes below the shared folder named by ``spark.checkpoint.dir``
(never a machine-local temporary folder), one fresh sub-folder per call.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ticketlens-scratch/{name}-{uuid.uuid4().hex[:12]}"


def safe_name(col: Column) -> Column:
    """File-safe value: slashes and * ? : \" < > | become '_'."""
    return F.regexp_replace(col.cast("string"), r'[\\/*?:"<>|]', "_")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export with a header and no index."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv_tree(spark: SparkSession, base: str, pattern: str = "*.csv", schema: T.StructType | None = None,
                  group_col: str = "repository", file_col: str = "source_file") -> DataFrame:
    """Every CSV under ``base/<group>/``, tagged with the folder name and the file's base name.

    Files may have different headers: their columns are matched by name, and
    one that a file lacks is null in its rows. All columns are strings, or
    those of ``schema``, in its types. A row shorter than its file's header is
    filled with nulls; a longer one, or a file that cannot be read, fails the
    read rather than losing data. Without a file the result has ``schema``'s
    columns and no rows.
    """
    lines = spark.read.text(f"{base.rstrip('/')}/*/{pattern}").where(F.length("value") > 0)
    first = (lines.select("value", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"))
             .groupBy("_path").agg(F.min_by("value", "_at").alias("_header")))
    by_header: dict[str, list[str]] = {}
    for r in first.collect():   # one row per file, which the read below lists anyway
        by_header.setdefault(r["_header"], []).append(unquote(r["_path"]))
    # the metadata path is URL-encoded; keep a literal '+' before decoding
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    tags = [F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias(group_col), F.regexp_extract(path, r"([^/]+)$", 1).alias(file_col)]
    out = None
    for header in sorted(by_header):
        names = next(csv.reader([header]))
        own = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_more"]])
        too_long = F.raise_error(F.concat(F.lit("more values than the header has, in "), path)).cast("boolean")
        rows = (spark.read.option("header", True).schema(own).csv(sorted(by_header[header]))
                .where(F.when(F.col("_more").isNull(), F.lit(True)).otherwise(too_long))
                .select(*[F.col(f"`{n}`") for n in names], *tags))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if schema is None:
        return out if out is not None else spark.createDataFrame([], f"{group_col} string, {file_col} string")
    if out is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(group_col, T.StringType()), T.StructField(file_col, T.StringType())]))
    typed = [(F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return out.select(*typed, group_col, file_col)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV read with an explicit schema (no inference)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """One folder per value of ``by`` with a file-safe name, in one write; null has a folder of its own."""
    df.withColumn(by, safe_name(F.col(by))).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def columns_with_data(df: DataFrame, by: str) -> DataFrame:
    """Per group (null too) the columns that hold data in it, as ``by, columns``: the per-group C4.

    One partial aggregation; a reader of one group selects the listed columns.
    """
    cols = [c for c in df.columns if c != by]
    held = df.groupBy(safe_name(F.col(by)).alias(by)).agg(*[F.max(F.col(f"`{c}`").isNotNull().cast("int")).alias(f"_h{i}") for i, c in enumerate(cols)])
    names = F.array(*[F.when(F.col(f"_h{i}") == 1, F.lit(c)) for i, c in enumerate(cols)])
    return held.select(by, F.filter(names, lambda x: x.isNotNull()).alias("columns"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested result export as JSON lines."""
    df.write.mode(mode).json(path)


def keyed_object_text(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Render a small dimension table as ONE keyed JSON object {key: {field: value}} (one row, one string)."""
    entries = F.collect_list(F.struct(F.col(key).cast("string").alias("k"),
                                      F.struct(*[F.col(f) for f in fields]).alias("v")))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(entries))).alias("value"))


def read_json_dim(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object keyed by name (tracker registry, type definitions, mappings) -> one row per key."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"map<string, {value_schema}>").alias("m"))
    return parsed.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def rough_count(col: Column) -> Column:
    """Counts stored as text with thousands separators ('1,015,000') -> long."""
    return F.regexp_replace(col, ",", "").try_cast("long")
