"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples.

Every k-mer of code points is numbered by its occurrence in the text; the pair
is hashed once, and the hash deals it to one of ``BINS`` sketches (one
permutation instead of one per sketch). In each sketch the ``ORDER`` smallest
are selected, put back into text order, and the tuple of their k-mers is hashed
to 16 bits. Two texts agree in a sketch when the same k-mers are selected in
the same order, so the share of agreeing sketches falls with the edit distance,
also when only the order of passages changes.

Texts are fingerprinted row by row. The comparison with the next document needs
the order of ids: rows are dealt to ranges of ids (one shuffle of the table),
each range also gets the first row of the range after it, and a task streams
through its sorted rows holding two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.sources.tables import estimated_bytes

#: Code points of a k-mer (three doublings in :func:`kmer_hashes`), sketches, and k-mers in a tuple.
K, BINS, ORDER = 8, 64, 2
#: Input bytes of one range of ids, and the most ranges.
RANGE_BYTES, MAX_RANGES = 8 << 20, 20_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWER = {n: _U(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4)}
_SHIFT = _U(64 - BINS.bit_length() + 1)
_LOW = (_U(1) << _SHIFT) - _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _join(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of neighbouring parts as one; ``size`` is that of the first part."""
    return a[:len(a) - size] * _POWER[size] + b[size:]


def kmer_hashes(text: str) -> np.ndarray:
    """A hash of each k-mer in text order; a shorter text is one k-mer, an empty one has none."""
    one = _mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U) + _U(1))
    if len(one) < K:
        whole = 0
        for x in one.tolist():
            whole = (whole * _BASE + x) & 0xFFFFFFFFFFFFFFFF
        return _mix(np.array([whole], _U)) if len(one) else one
    two = _join(one, one, 1)
    four = _join(two, two, 2)
    return _mix(_join(four, four, 4))


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each hash came before, at each place."""
    out = np.zeros(len(h), _U)
    bits = len(h).bit_length() + 2
    bucket = (h >> _U(64 - bits)).astype(np.int64)
    shared = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    if len(shared):
        order = shared[np.argsort(h[shared], kind="stable")]
        s = h[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return out


def sketch(text: str) -> np.ndarray:
    """The fingerprint as ``BINS`` numbers of 16 bits; 0 stands for an empty sketch."""
    h = kmer_hashes(text)
    out = np.zeros(BINS, np.uint16)
    if not len(h):
        return out
    rank = _mix(h + _mix(occurrences(h) + _U(_BASE)))
    at = None
    if len(h) > BINS * 32:  # the smallest of a bin are among the small ones, unless a bin has too few of them
        few = np.flatnonzero((rank & _LOW) < _U(int(_LOW) * BINS * 16 // len(h)))
        if np.bincount((rank[few] >> _SHIFT).astype(np.int64), minlength=BINS).min() >= ORDER:
            at = few
    if at is None:
        at = np.arange(len(h))
    at = at[np.argsort(rank[at], kind="stable")]
    bins = (rank[at] >> _SHIFT).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    held = np.diff(np.r_[first, len(bins)])
    made = np.zeros(BINS, _U)
    picks = np.full((BINS, ORDER), len(h), np.int64)
    for i in range(ORDER):
        own = held > i
        picks[own, i] = at[first[own] + i]
    picks.sort(axis=1)
    padded = np.r_[h, _U(0)]
    for i in range(ORDER):
        made = _mix(made * _U(_BASE) + padded[picks[:, i]] + _U(i + 1))
    full = held > 0
    out[full] = made[full] % _U(65535) + _U(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing sketches among those that either text fills; 1 for two empty texts."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum()) / n if n else 1.0


def as_string(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def edited(text: str, after: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first code points of ``after``, or all."""
    cut = len(text) // 3
    return text[:len(text) - cut] + after[:cut]


def _ranged(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """Rows by range of ids, sorted, each range closed by a copy of the row that follows it (``_border``)."""
    spark = docs.sparkSession
    ranges = min(MAX_RANGES, max(1, estimated_bytes(docs) // RANGE_BYTES))
    rows = docs.select(F.struct(*keep).alias("_keep"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                       F.col(doc_id).isNull().alias("_none"), F.bitwise_not(F.col(doc_id).cast("long")).alias("_down"))
    rows = rows.withColumn("_place", F.coalesce(F.col("_down").cast("double"), F.lit(float("inf"))))
    cuts = rows.where(~F.col("_none")).approxQuantile("_place", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_place", outputCol="_range").transform(rows).withColumn("_range", F.col("_range").cast("int"))
    order = ("_none", "_down", "_text")
    full = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.min("_down")).collect())  # two numbers for each of MAX_RANGES at most
    firsts = spark.createDataFrame([(own, down, before) for (own, down), (before, _) in zip(full, full[-1:] + full[:-1], strict=True)],
                                   "own int, first long, before int")
    borders = (rows.join(F.broadcast(firsts), (rows["_range"] == firsts["own"]) & rows["_down"].eqNullSafe(firsts["first"]))
               .groupBy("before", "_none", "_down").agg(F.min("_text").alias("_text"))
               .select(F.lit(None).cast(rows.schema["_keep"].dataType).alias("_keep"), "_text", "_none", "_down",
                       F.col("before").alias("_range"), F.lit(True).alias("_border")))
    rows = rows.drop("_place").withColumn("_border", F.lit(False)).unionByName(borders)
    return rows.repartition(max(1, len(full)), "_range").sortWithinPartitions("_range", "_border", *order)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None   # the row before: what is kept of it, its text and sketch

    def made(done: list[tuple]) -> pa.RecordBatch:
        keep = pa.concat_arrays([x[0] for x in done])
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([keep, *(pa.array([x[i + 1] for x in done], k) for i, k in enumerate(kinds))],
                                          ["_keep", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    done, size = [], 0
    for b in batches:
        keep, texts, borders = (b.column(b.schema.get_field_index(c)) for c in ("_keep", "_text", "_border"))
        for i, (text, border) in enumerate(zip(texts.to_pylist(), borders.to_pylist(), strict=True)):
            own = sketch(text)
            if held is not None:
                kept, old, was = held
                new = edited(old, text)
                other = sketch(new)
                done.append((kept, len(old), new, as_string(was), as_string(other), likeness(was, other), likeness(was, own)))
                size += len(new)
            held = None if border else (keep.slice(i, 1), text, own)
            if size > 1 << 22:
                yield made(done)
                done, size = [], 0
    if done:
        yield made(done)


def edited_neighbours(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of every row, and its fingerprint beside those of its edited text and of the next document.

    Adds ``n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next``. The next document is the next row by descending id, after the
    last the first; rows of equal id follow each other by text, null ids come
    last. A null text is empty; an empty text has an empty fingerprint, and two
    such are alike (1.0). A table of one row is its own next; an empty table
    gives an empty result. ``columns`` pass through and may not be named like
    the results.
    """
    kept = docs.select(*columns).schema.simpleString()
    rows = _ranged(docs, doc_id, text, columns).select("_keep", "_text", "_border")
    out = rows.mapInArrow(_stream, f"_keep {kept}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double")
    return out.select("_keep.*", *out.columns[1:])


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row and ``fingerprint``; a null text is empty. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([as_string(sketch(x)) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], prints], [*b.schema.names[:-1], "fingerprint"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, fields + "fingerprint string")
