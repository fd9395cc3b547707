"""Target-distribution importance resampling: documents that look most like a target corpus, drawn without replacement.

Words' hashed n-grams are counted by bucket over the whole corpus and the whole
target. A bucket's gain is its log-likelihood ratio of target to corpus (one
added to every bucket) in thousandths, and a document's weight is the mean gain
of its features, read from the gains' array. Gumbel noise from a hash of the id
makes the k best scores a draw in proportion to the weights.

The k best are found by quickselect over the composite key (score, id, text's
hash, row): a few rows are drawn as pivots by a hash, one aggregation counts the
rows between and on the pivots exactly, and only the part that holds the k-th
key is kept for the next round. Each round leaves about one ``pivots``-th of the
rows, so their number follows the logarithm of the input. Only the winners are
then sorted and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ticketlens.functions.ranking import null_safe_join, row_number_in_groups
from ticketlens.session import cut_lineage

#: A-Z to lower case; ASCII that is no letter or digit to a blank. Other bytes stay: they belong to words.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def feature_buckets(text: bytes, low: int, high: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a UTF-8 text, and the bucket of each run of ``low`` to ``high`` words."""
    words = text.translate(_WORD_BYTES).split()
    runs = words if (low, high) == (1, 1) else [b" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets


def bucket_counts(docs: DataFrame, low: int, high: int, buckets: int, text: str = "text") -> np.ndarray:
    """Features of all rows by bucket: partial sums by partition, ``buckets`` numbers at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(feature_buckets(x.as_py(), low, high, buckets)[1], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["i", "n"])

    got = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus share by bucket, one added to each, floored."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of the SHA-256 of seed and id (a null id counts as '')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def select_kth(keys: DataFrame, key: str, k: int, pivots: int = 15) -> Row:
    """The ``k``-th smallest (from 1) of the distinct values of ``key``, of which there are ``k`` at least.

    Each round counts exactly the keys below, on and between pivot keys that a
    hash draws from those still in question; these are written between rounds.
    """
    left, turn = keys.select(key), 0
    while True:
        turn += 1
        drawn = left.orderBy(F.xxhash64(key, F.lit(turn)), key).limit(pivots)
        pivot = drawn.agg(F.array_sort(F.collect_list(key)).alias("_pivots"))
        below, on = F.size(F.filter("_pivots", lambda p: p < F.col(key))), F.exists("_pivots", lambda p: p == F.col(key))
        dealt = null_safe_join(left, pivot, []).select(key, (2 * below + on.cast("int")).alias("_bin"))
        counts = {r["_bin"]: r["n"] for r in dealt.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        at = -1
        for at in sorted(counts):
            if k <= counts[at]:
                break
            k -= counts[at]
        if at % 2:
            return dealt.where(F.col("_bin") == at).first()[key]
        left = cut_lineage(dealt.where(F.col("_bin") == at).select(key))


def resample(docs: DataFrame, target: DataFrame, columns: list[str], share: tuple[int, int] = (10, 100), grams: tuple[int, int] = (1, 1),
             buckets: int = 10_000, min_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``columns`` of every row, ``n_words, n_features, weight, score`` and ``rank`` (1 for the best score; null where the row is not drawn).

    Of the rows with ``min_words`` words at least, ``share`` (as a ratio, floored)
    is drawn, by descending score; ties go to the smaller id, a null id last,
    then to the text's hash. Rows that are equal throughout are drawn one by one.
    Words are runs of ASCII letters and digits and of all other characters, A-Z
    lower-cased. A null or empty text has no words, no features and weight 0. An
    empty target has no features, its buckets have the added one alone. An empty
    table gives an empty result. ``columns`` pass through and may not be named
    like the results, ``_key`` or ``_words``.
    """
    low, high = grams
    gain = gains(bucket_counts(docs, low, high, buckets, text), bucket_counts(target, low, high, buckets, target_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [feature_buckets(x.as_py(), low, high, buckets) for x in b.column(b.num_columns - 1)]
            n = [len(x) for _, x in found]
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for _, x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in ([w for w, _ in found], n, weight))],
                                             [*b.schema.names[:-1], "n_words", "n_features", "weight"])

    inputs = docs.select(*columns, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_words"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in inputs.drop("_words").schema)
    scored = inputs.mapInArrow(run, fields + "n_words long, n_features long, weight long")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed))
    key = F.struct((-F.col("score")).alias("s"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("h"),
                   F.monotonically_increasing_id().alias("row"))
    names = [*columns, "n_words", "n_features", "weight", "score"]
    scored = cut_lineage(scored.select(*names, key.alias("_key")))      # fixes the row numbers
    may = F.col("n_words") >= min_words
    k = scored.where(may).count() * share[0] // share[1]
    if not k:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    last = docs.sparkSession.createDataFrame([(select_kth(scored.where(may), "_key", k),)], scored.select(F.col("_key").alias("_last")).schema)
    marked = null_safe_join(scored, last, [])
    drawn = may & (F.col("_key") <= F.col("_last"))
    ranked = row_number_in_groups(marked.where(drawn).drop("_last"), [], [F.col("_key")], "rank")
    return (ranked.select(*names, F.col("rank").cast("long").alias("rank"))
            .unionByName(marked.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))))
