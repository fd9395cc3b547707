"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are hashed, k neighbouring words make a k-gram, and of every w
neighbouring k-grams the least hash is kept as a fingerprint. A span of
w + k - 1 words that a document shares with an item keeps the same fingerprint
on both sides, so joining fingerprints misses none. A window is as long as the
span that is guaranteed: 13 words with k = 6 and w = 8; items of fewer words are
windows of their own and get fingerprints with a shorter guarantee, if any exist.

The join names the texts that share a fingerprint. Around its places in those
texts alone the hits are extended to windows, which are compared word for word
with the items' windows. Benchmark tables and the texts' hits are broadcast only
below a checked size; else the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage
from ticketlens.sources.tables import small_side

#: Words of a window and the most words of a k-gram.
WINDOW, GRAM = 13, 6
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of a-z, 0-9 and all beyond ASCII; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def _grams(hashes: str, k: int) -> Column:
    """Hash of every k-gram, from the column of word hashes."""
    every = F.transform(F.col(hashes), lambda x, i: F.xxhash64(x, *(F.get(F.col(hashes), i + j) for j in range(1, k))))
    return F.slice(every, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0)))


def _least(grams: str, w: int) -> Column:
    """Least hash of every w neighbouring k-grams."""
    every = F.transform(F.col(grams), lambda x, i: F.least(x, *(F.get(F.col(grams), i + j) for j in range(1, w)))) if w > 1 else F.col(grams)
    return F.slice(every, 1, F.greatest(F.size(grams) - (w - 1), F.lit(0)))


def winnow(rows: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``print``: the fingerprints of the column ``words`` that no shared span of ``span`` words escapes."""
    k = min(GRAM, span)
    rows = rows.select(*keep, F.transform("words", lambda x: F.xxhash64(x)).alias("_h"))
    rows = rows.select(*keep, _grams("_h", k).alias("_g"))
    return rows.select(*keep, F.explode(F.array_distinct(_least("_g", span - k + 1))).alias("print"))


def _windows(size: Column, at: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), at + 1, size), " ")


def _places(grams: str, shared: str) -> Column:
    """Where the k-grams are among the shared fingerprints."""
    at = F.transform(F.col(grams), lambda g, i: F.when(F.array_contains(F.col(shared), g), i))
    return F.filter(at, lambda i: i.isNotNull())


def _extended(places: str, k: int, size: int) -> Column:
    """All windows of ``size`` words around k-grams at ``places``: where they start, their size and their words."""
    end = F.size("words") - size

    def starts(p: Column) -> Column:
        low, high = F.greatest(p - (size - k), F.lit(0)), F.least(p, end)
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    every = F.array_distinct(F.flatten(F.transform(F.col(places), starts)))
    made = F.transform(every, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), _windows(F.lit(size), i).alias("window")))
    return F.coalesce(made, F.array().cast("array<struct<at:int,size:int,window:string>>"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], text: str = "text", item: str = "item_id",
                       item_text: str = "text") -> DataFrame:
    """``columns`` of every document row, and ``n_words, n_hit, items, contaminated``.

    A window is 13 consecutive words of an item; an item of fewer words, but
    not none, is one window. Document words inside any occurrence of a window
    are hit. ``items`` lists the ids, as sorted strings, of the items with
    occurring windows (a null id as "null"); a document is contaminated if at
    least one word in twenty is hit. Null and empty texts have no words. Repeated
    rows each give a row, items of equal id count once; an empty benchmark hits
    nothing, an empty table gives an empty result. ``columns`` pass through and
    may not be named like the results.
    """
    items = cut_lineage(benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words(F.col(item_text)).alias("words"))
                        .where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(WINDOW))))
    windows = cut_lineage(items.select("item", "size", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
                          .select("item", "size", _windows(F.col("size"), F.col("at")).alias("window")).distinct())
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())   # 13 numbers at most
    spans = ([WINDOW] if WINDOW in sizes else []) + ([sizes[0]] if sizes and sizes[0] < WINDOW else [])

    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_md5", F.md5("_text"))
    split = rows.select("_md5", words(F.col("_text")).alias("words"))
    found = []
    for span in spans:
        prints = cut_lineage(winnow(items.where(F.col("size") == WINDOW if span == WINDOW else F.col("size") < WINDOW), span, []).distinct())
        found.append(winnow(split, span, ["_md5"]).join(small_side(prints), "print", "left_semi").withColumn("span", F.lit(span)))
    if not found:
        return rows.select(*columns, F.size(words(F.col("_text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    shared = found[0] if len(found) == 1 else found[0].union(found[1])
    shared = cut_lineage(shared.groupBy(F.col("_md5").alias("_of")).agg(
        *(F.collect_set(F.when(F.col("span") == s, F.col("print"))).alias(f"_shared{s}") for s in spans)))

    rows = rows.join(small_side(shared), F.col("_md5") == F.col("_of"), "left").withColumn("words", words(F.col("_text"))).drop("_text")
    hit = F.col("_of").isNotNull()
    rows = rows.withColumn("_h", F.when(hit, F.transform("words", lambda x: F.xxhash64(x))))
    extended = []
    for span in spans:
        k = min(GRAM, span)
        rows = rows.withColumn(f"_g{span}", F.when(hit & (F.size(f"_shared{span}") > 0), _grams("_h", k)))
        rows = rows.withColumn(f"_at{span}", _places(f"_g{span}", f"_shared{span}"))
        extended += [_extended(f"_at{span}", k, size) for size in ([WINDOW] if span == WINDOW else [s for s in sizes if s < WINDOW])]
    judged = cut_lineage(rows.select(*columns, "_md5", F.size("words").cast("long").alias("n_words"), F.concat(*extended).alias("_windows")))

    occurs = (judged.where(F.size("_windows") > 0).select("_md5", F.explode("_windows").alias("w")).select("_md5", "w.*")
              .join(small_side(windows), ["size", "window"]))
    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("at", "size"))), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                          lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["size"]).alias("end"),
                                                (s["n"] + F.greatest(x["at"] + x["size"] - F.greatest(s["end"], x["at"]), F.lit(0))).alias("n")))
    # written, so that the join has no aggregation beside it and the rows of a text of very many copies can be split
    hits = cut_lineage(occurs.groupBy(F.col("_md5").alias("_of")).agg(covered["n"].alias("_n_hit"), F.array_sort(F.collect_set("item")).alias("_items")))
    return (judged.join(small_side(hits), judged["_md5"] == hits["_of"], "left")
            .select(*columns, "n_words", F.coalesce("_n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
