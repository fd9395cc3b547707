"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, tokens.

``STAGES`` are applied in order to ``documents``; each stage works on all that
the one before kept and is written as Parquet before the next one reads it. All
but the last return the columns of ``documents``.

1. quality: documents that the co-trained classifier rejects go.
2. lines: lines that ten documents at least hold go from every document;
   ``n_chars`` follows the text. A document that loses all lines stays, empty.
3. near_duplicates: documents link at a Jaccard likeness of 0.8 of their
   five-word shingles; of each component the one with the smallest id stays (rows of that id that repeat are the same document).
4. decontamination: contaminated documents go.
5. tokens: doc_id, n_tokens and ids of every document that is left.

Empty tables pass through every stage. SQL cannot say the first stage, so there
is no oracle; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from ticketlens.llm.queries import BPE_FILE, MIN_LINE_DOCS
from ticketlens.session import cut_lineage, ship_package
from ticketlens.sources.tables import read_table, small_side

ORACLE_SQL = None

#: Near duplicates: words of a shingle, and the least Jaccard likeness as a ratio. (op9's 4 and 85/100 are its own contract.)
NEAR_WIDTH, NEAR_NUM, NEAR_DEN = 5, 80, 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged = quality.classify(docs, read_table(spark, sf_dir, "labels"), docs.columns)
    return judged.where("keep").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = line_dedup.drop_repeated_lines(docs, others, min_docs=MIN_LINE_DOCS)
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: of the smallest id, rows without an id last.

    Rows are told apart by id and text, so neither null nor repeated ids take
    other rows along. Rows of one id and text are copies of each other.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    keyed = docs.select(key.alias("doc_id"), "text")
    found = cut_lineage(ngram_join.jaccard_components(keyed, width=NEAR_WIDTH, num=NEAR_NUM, den=NEAR_DEN))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.withColumn("_row", key).join(small_side(gone), F.col("_row") == F.col("_gone"), "left_anti")
    twice = (found.where("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("_twice")).count()
             .where("count > 1").select("_twice"))
    once = left.join(small_side(twice), F.col("_row") == F.col("_twice"), "left_anti").select(*docs.columns)
    one = (left.join(small_side(twice), F.col("_row") == F.col("_twice"), "left_semi")
           .groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("_one")).select("_one.*"))
    return once.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left."""
    coder = byte_bpe.load(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return byte_bpe.encode_decode(docs, ["doc_id"], coder, outputs=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
