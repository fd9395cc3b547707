"""Spark session helpers.

The library never creates its own cluster settings beyond what a test or a
local run needs: on a cluster the session comes from the caller and its
settings (``spark.checkpoint.dir`` in particular) are read, not overwritten.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ticketlens") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKETLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a
    scratch folder is made for a local master only (tests, a laptop); on a
    cluster that folder would lie on one machine's disk, so this raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf_dir = held.get() if held.isDefined() else None
    if not conf_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ticketlens-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where they could not by themselves.

    Workers find it in their working folder or on ``PYTHONPATH``; elsewhere the
    package's sources are sent once a session as a py-file.
    """
    here = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    name = f"{here.name}-src.zip"
    if any(x and Path(x).resolve() == here.parent for x in known) or name in getattr(sc, "_python_includes", []):
        return
    path = Path(tempfile.mkdtemp(prefix="ticketlens-src-")) / name
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(path))


def scratch_table_path(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder for one intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ticketlens-tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    The written table survives executor loss, cuts the lineage, and - being
    columnar - lets each consumer read only the columns it needs. Column names
    parquet cannot store fall back to Spark's reliable ``checkpoint()``.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark)
    if any(ch in c for c in df.columns for ch in " ,;{}()\n\t="):
        return df.checkpoint(eager=True)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Operators of an optimized plan that cost no more to run again than a read of their result.
_CHEAP = frozenset(("Project", "Filter", "LogicalRelation", "LocalRelation", "SubqueryAlias", "Range"))


def _is_scan(df: DataFrame) -> bool:
    """Whether the optimized plan is a scan with filters and projections alone."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _CHEAP:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def reuse(df: DataFrame) -> DataFrame:
    """Frame read by several branches of one plan: materialise it once when it is more than a scan.

    A bare scan (with filters/projections) is returned as is - re-reading
    pruned parquet is cheap. Anything with joins, aggregations or windows is
    checkpointed into the shared checkpoint folder, so every consumer reads
    the written result instead of recomputing the joins, and the lineage is
    cut (a lost executor re-reads the checkpoint, not the whole upstream).
    """
    return df if _is_scan(df) else cut_lineage(df)
