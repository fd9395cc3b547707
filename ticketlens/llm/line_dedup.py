"""Line dedup: a sharded minimal perfect hash indexes the distinct lines' fingerprints and counts.

1. Every text is split once; each row keeps the 128-bit hashes of its distinct
   line keys (written as a table, so the text is not split again for probing).
2. The hashes are counted with partial aggregation and dealt to shards. One
   task per shard builds a minimal perfect hash over the shard's distinct
   hashes and, by slot, a fingerprint array and a document-count array.
3. The hashes of each distinct text are sent to their shards and probe the
   arrays there; a shard with many probes (a line that a third of all texts
   share) is copied and its probes are dealt over the copies. Only hits come
   back.
4. A row with hits drops those lines from its own text.

No line text leaves its row and no line table is joined. Shards hold about
``SHARD_LINES`` lines whatever the input's size; nothing goes through the
driver but the number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage
from ticketlens.sources.tables import small_side

from .mph import MinimalPerfectHash
from .workers import tidy

#: Rows of the line table that one shard indexes, on average.
SHARD_LINES = 1 << 18
#: Probes that one copy of a shard answers.
COPY_PROBES = 1 << 19
#: Texts that are in a task's Python memory at once.
ROWS_AT_ONCE = 256


def line_keys(text: str) -> list[bytes]:
    """Key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in text.encode().lower().split(b"\n")]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        ends, digests = [0], []
        for text in b.column(1).to_pylist():
            keys = set(line_keys(text))
            keys.discard(b"")
            digests += [xxhash.xxh3_128_digest(k) for k in keys]
            ends.append(len(digests))
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(h[:, i]))) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["text_md5", "h1", "h2"])


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
    counts = rows["n"].to_numpy()
    index = MinimalPerfectHash.build(h1, h2)
    slot = index.slots(h1, h2)
    marks = np.empty(len(h1), np.uint32)
    marks[slot] = h2 >> np.uint64(32)
    by_slot = np.empty(len(h1), np.min_scalar_type(int(counts.max())))
    by_slot[slot] = counts
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "probes": [int(counts.sum())],
                         "width": [by_slot.dtype.itemsize], "index": [index.to_bytes()],
                         "marks": [marks.tobytes()], "counts": [by_slot.tobytes()]})


def line_index(hashes: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the minimal perfect hash and its fingerprint and count arrays."""
    counts = (hashes.select(F.explode(F.arrays_zip("h1", "h2")).alias("x")).select("x.h1", "x.h2")
              .groupBy(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2").agg(F.count("*").alias("n")))
    return counts.groupBy("shard").applyInPandas(
        _build_shard, "shard long, probes long, width int, index binary, marks binary, counts binary")


def line_probes(hashes: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``text_md5, h1, h2`` of each distinct text's lines once, with the ``shard`` and the ``copy`` of it that they probe."""
    copies = F.ceil(F.col("probes") / COPY_PROBES)
    hot = index.where(copies > 1).select("shard", copies.cast("long").alias("copies"))
    return (hashes.dropDuplicates(["text_md5"]).select("text_md5", F.explode(F.arrays_zip("h1", "h2")).alias("x")).select("text_md5", "x.h1", "x.h2")
            .withColumn("shard", F.pmod("h1", F.lit(shards))).join(small_side(hot), "shard", "left")
            .withColumn("copy", F.pmod(F.xxhash64("text_md5"), F.coalesce("copies", F.lit(1)))).drop("copies"))


def _probe(min_docs: int):
    def probe(key: tuple, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(shard):
            return rows[["text_md5", "h1", "h2"]].iloc[:0]
        at = shard.iloc[0]
        h1, h2 = rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
        slot = MinimalPerfectHash.from_bytes(at["index"]).slots(h1, h2)
        marks = np.frombuffer(at["marks"], np.uint32)
        counts = np.frombuffer(at["counts"], np.dtype(f"u{at['width']}"))
        hit = (slot >= 0) & (marks[slot] == h2 >> np.uint64(32)) & (counts[slot] >= min_docs)
        return rows.loc[hit, ["text_md5", "h1", "h2"]]
    return probe


def _keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        texts, d1, d2 = (b.column(b.schema.get_field_index(c)) for c in ("_text", "_d1", "_d2"))
        lines, dropped, kept = [], [], []
        for text, x1, x2 in zip(texts.to_pylist(), d1, d2, strict=True):
            n = text.count("\n") + 1
            lines.append(n)
            if not x1.is_valid:
                dropped.append(0)
                kept.append(text)
                continue
            hits = np.array([x1.values.to_numpy(), x2.values.to_numpy()], np.int64)
            gone = {x.tobytes() for x in np.ascontiguousarray(hits.T)}
            left = [line for line, key in zip(text.split("\n"), line_keys(text), strict=True)
                    if not key or xxhash.xxh3_128_digest(key) not in gone]
            dropped.append(n - len(left))
            kept.append("\n".join(left))
        own = [i for i, c in enumerate(b.schema.names) if c not in ("_text", "_d1", "_d2")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in own), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            [*(b.schema.names[i] for i in own), "n_lines", "n_dropped", "kept_text"])


def drop_repeated_lines(docs: DataFrame, columns: list[str], text: str = "text", min_docs: int = 10) -> DataFrame:
    """``columns`` of every row, and ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line is dropped when its key (see :func:`line_keys`), of one character at
    least, is found in ``min_docs`` rows at least; each row is a document of its
    own, also where ids or whole rows repeat. A null or empty text is one empty
    line, which stays. A text that loses all its lines becomes empty. An empty
    table gives an empty result. ``columns`` are passed through as they are,
    nulls too, and may not be named like the three results.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hashes = cut_lineage(docs.select(F.md5(whole).alias("text_md5"), whole.alias("text"))
                         .mapInArrow(tidy(_hash_lines), "text_md5 string, h1 array<long>, h2 array<long>"))
    total = hashes.agg(F.sum(F.size("h1"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_LINES))
    index = cut_lineage(line_index(hashes, shards))
    probes = line_probes(hashes, index, shards)
    copies = F.ceil(F.col("probes") / COPY_PROBES)
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies.cast("long"), F.lit(1).cast("long")) - 1)))
    hits = (probes.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy"))
            .applyInPandas(_probe(min_docs), "text_md5 string, h1 long, h2 long"))
    # written, so that the join has no aggregation beside it and the rows of a text of very many copies can be split
    gone = cut_lineage(hits.groupBy("text_md5").agg(F.collect_set(F.struct("h1", "h2")).alias("x"))
                       .select("text_md5", F.col("x.h1").alias("_d1"), F.col("x.h2").alias("_d2")))
    rows = docs.select(*columns, whole.alias("_text"), F.md5(whole).alias("_md5"))
    rows = rows.join(gone, rows["_md5"] == gone["text_md5"], "left").select(*columns, "_text", "_d1", "_d2")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(tidy(_keep_lines), f"{fields}, n_lines long, n_dropped long, kept_text string")
