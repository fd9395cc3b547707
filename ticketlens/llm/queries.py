"""The operators' registered queries over the given tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import ship_package
from ticketlens.sources.tables import read_table

from . import (
    byte_bpe,
    chat,
    decontaminate,
    importance,
    license_scan,
    line_dedup,
    ngram_join,
    order_minhash,
    quality,
    token_align,
    toxicity,
    url_filter,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed values of the contracts.
MIN_LINE_DOCS = 10
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
ALIGN_FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
TOXIC_FROM = 0.7
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def query(name: str, sql: str | None = None):
    def keep(build):
        @functools.wraps(build)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = shipped
        if sql:
            SQL[name] = sql
        return build
    return keep


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the two co-trained views."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, ["doc_id"])


@query("op2_line_dedup", r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents at least go from every document."""
    kept = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), ["doc_id"], min_docs=MIN_LINE_DOCS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_license_scan", license_scan.ORACLE_SQL)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the rules they fulfil, for every document."""
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.withColumn("findings", F.array_join("findings", ", "))


@query("op5_chat_perspectives", chat.ORACLE_SQL)
def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant, as rendered and masked turns."""
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again."""
    coder = byte_bpe.load(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    coded = byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"), ["doc_id"], coder, outputs=("ids_le", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_url_filter", r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
         FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest fitting entry."""
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), ["page_id"], URL_RULES)


@query("op10_warc_derivatives")
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    return warc.build_derivatives(warc.responses_of_pages(read_table(spark, sf_dir, "pages")))


@query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    near = order_minhash.edited_neighbours(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return near.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next")


@query("op9_ngram_join", r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM cut),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM toks a JOIN toks b ON a.t = b.t AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON s.doc_id = r.x
""")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of linked shingle sets."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), num=85, den=100)


@query("op7_decontamination", r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS first, unnest(list_transform(range(1, len(w) - size + 2),
                  lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g FROM dw, sizes WHERE len(w) >= size),
occurs AS (SELECT p.doc_id, p.first, p.size, x.item_id FROM places p JOIN wins x ON p.size = x.size AND p.g = x.g),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(first, first + size)) AS pos FROM occurs) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occurs) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows."""
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of a third of the ids are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"], ~held_out, TOXIC_FROM)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned."""
    pair = token_align.load(spark, *map(public_tokenizers.path, ALIGN_FILES))
    found = token_align.align(read_table(spark, sf_dir, "documents"), ["doc_id"], pair)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


@query("op13_importance_resampling", r"""
WITH RECURSIVE crc_step(n, c, k) AS (
  SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8),
texts AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark),
cut AS (SELECT doc_id, target, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
words AS (SELECT doc_id, target, unnest(w) AS w FROM cut),
coded AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS UBIGINT)) AS b
          FROM (SELECT DISTINCT w FROM words)),
hashed AS (SELECT w, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b),
                  lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) % 10000 AS bucket
           FROM coded, crc_table),
counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket)
            WHERE NOT target GROUP BY doc_id),
noise AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM cut WHERE NOT target),
scored AS (SELECT doc_id, n AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM noise LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS all_n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= all_n * 10 // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
""")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words at least, drawn towards the benchmark's words."""
    drawn = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"],
                                share=(10, 100), grams=(1, 1), buckets=10_000, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
