"""Incremental ingest with Structured Streaming.

ST1 replaces the resumable paged download: new issue files landing in a
folder are appended to the issue table; the checkpoint records which files
were committed, so a restarted job continues where it stopped and a file is
never appended twice.

ST2 replaces the per-issue comment enrichment, which resumes at a date and
skips issues that have their comments. Updates arrive as files, some of them
again, late or for issues that are enriched already. Keyed streaming state holds, per
issue, the order of the update that was taken last; only updates that the
state does not yet cover pass. What passes a micro-batch is written below its
batch number, so a batch that runs again after a failure replaces its own
folder. State and file list are in the query's checkpoint and survive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.issues import newest_updates, upsert_comments

#: Timestamps inside the payload keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def ingest_issues_stream(spark: SparkSession, source_dir: str, schema: T.StructType, table_path: str,
                         checkpoint: str, partition_by: str | None = "repository", max_files: int = 100):
    """ST1: append every new issue file of ``source_dir`` to the parquet table; returns the finished query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir))
    w = stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(partition_by)
    q = w.start()
    q.awaitTermination()
    return q


def _order_text(order: Sequence[str], col: str) -> Column:
    """A text that sorts as (order columns, then the update's content) does, so that equal times have an order, too.

    Numbers and times are brought to one width; a null sorts first.
    """
    parts: list[Column] = []
    for o in order:
        c = F.col(o)
        parts.append(F.coalesce(F.when(F.col(o).isNotNull(), F.concat(F.lit("1"), c)), F.lit("0")))
    return F.concat_ws("\u0001", *parts, F.md5(F.coalesce(F.to_json(F.struct(col), _JSON), F.lit(""))))


def _sortable(schema: T.StructType, name: str) -> Column:
    """``name`` as a text of one width that sorts like its value."""
    kind, c = schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        big = c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
        return F.lpad(big.cast("decimal(20,0)").cast("string"), 20, "0")
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.DateType, T.StringType)):
        return c.cast("string")
    raise TypeError(f"an order column is a whole number, a date, a time or a text, not {kind.simpleString()}")


def newest_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest row of each key in an Arrow batch (columns: key, order, payload): hot keys shrink before the shuffle."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).append_column("_at", pa.array(range(b.num_rows), pa.int64()))
        t = t.sort_by([("_order", "ascending")])
        last = t.group_by("_key", use_threads=False).aggregate([("_at", "last")])["_at_last"]
        yield b.take(last.combine_chunks())


def _take_new(only_first: bool):
    def run(key: tuple[Any, ...], rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seen = state.get[0] if state.exists else None
        best = None
        for pdf in rows:
            at = pdf["_order"].to_numpy().argmax() if len(pdf) else None
            if at is not None and (best is None or pdf["_order"].iloc[at] > best[0]):
                best = (pdf["_order"].iloc[at], pdf["_payload"].iloc[at])
        if best is None or (seen is not None and (only_first or best[0] <= seen)):
            return
        state.update((best[0],))
        yield pd.DataFrame({"_key": [key[0]], "_order": [best[0]], "_payload": [best[1]]})
    return run


def enrich_comments_stream(spark: SparkSession, updates_dir: str, schema: T.StructType, log_path: str, checkpoint: str, key: str = "key",
                           col: str = "comments", order: Sequence[str] = (), resume_from: Column | None = None, only_first: bool = False,
                           max_files: int = 100):
    """ST2: write the updates that are news to ``log_path/batch=<id>``; returns the finished query.

    News are updates of an issue that come after its last one taken, by the
    ``order`` columns, then by content; re-delivered, older and late ones are
    skipped. ``only_first`` skips every issue that was enriched before.
    ``resume_from`` is a condition on the updates, such as ``created >= date``
    (see :func:`resume_point`); others are not read into the state. Rows without
    a key are skipped. Of many updates of one issue each part of the input sends one
    to the issue's state.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.from_json("_payload", schema, _JSON).alias("r"), "_order").select("r.*", "_order")
        rows.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(updates_dir).where(F.col(key).isNotNull())
    if resume_from is not None:
        stream = stream.where(resume_from)
    for o in order:
        stream = stream.withColumn(f"_sort_{o}", _sortable(schema, o))
    keyed = stream.select(F.col(key).cast("string").alias("_key"), _order_text([f"_sort_{o}" for o in order], col).alias("_order"),
                          F.to_json(F.struct(*[F.col(f"`{f}`") for f in schema.names]), _JSON).alias("_payload"))
    fields = "_key string, _order string, _payload string"
    news = (keyed.mapInArrow(newest_in_part, fields).groupBy("_key")
            .applyInPandasWithState(_take_new(only_first), fields, "last string", "update", GroupStateTimeout.NoTimeout))
    q = (news.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def resume_point(spark: SparkSession, log_path: str, created: str):
    """The greatest ``created`` of the logged updates, where the next run may resume; None before the first."""
    return spark.read.parquet(log_path).agg(F.max(created)).first()[0]


def enriched_view(issues: DataFrame, log_path: str, key: str = "key", col: str = "comments") -> DataFrame:
    """Issues with the newest logged value per key merged in."""
    log = issues.sparkSession.read.parquet(log_path)
    return upsert_comments(issues, newest_updates(log, key, col, ["_order", "batch"]), key, col)
