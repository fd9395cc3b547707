"""Alignment of two tokenizers: where both end a token, which tokens overlap, and how often each id pair does so.

A text is encoded by a byte-level BPE (A, on a space and the text) and by a
sentence-piece model (B, which adds the space itself). Inside a task the work is
a chain of Arrow kernels over a batch of texts: the token lists are flattened
with their parent indices, cumulative sums of the tokens' byte lengths, less the
document's start, give each token's end, and an Acero hash join on
(document, end) finds the ends that both have. Between two neighbouring ends of
the joined table lies a piece of text that one A and one B token cover, so its
rows, with the gaps filled from the next end, are exactly the overlapping pairs.

``Table.group_by`` counts the id pairs of a batch, and Spark adds the partial
counts. Documents then read the counts of their links: the most frequent pairs,
``head`` at most, are broadcast as arrays, and links of rarer pairs, which are
never hot, are joined with the rest of the counts.

Tokens are written once, between the counting and the reading pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage

#: Pairs whose counts are broadcast, text bytes (later: links) that are worked on at once, and pairs that a task counts before it hands them on.
HEAD_PAIRS, BYTES_AT_ONCE, PAIRS_AT_ONCE = 1_000_000, 1 << 18, 500_000

A_ENDS, B_ENDS = 1, 2
BOTH_END = A_ENDS | B_ENDS


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, and per id the bytes of its token. Built in each worker from the vocabularies' contents."""

    def __init__(self, bpe: bytes, pieces: bytes):
        import sentencepiece

        alphabet = byte_alphabet()
        made = json.loads(bpe)
        special = {t["id"] for t in made["added_tokens"]}
        self.bytes_a = {i: bytes(alphabet[c] for c in entry) for entry, i in made["model"]["vocab"].items() if i not in special}
        self._encode_a = self._encoder(bpe, made)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_b = {i: self._piece(i) for i in range(self._b.get_piece_size()) if not (self._b.is_control(i) or self._b.is_unknown(i))}
        self.a, self.b = (self._by_id(x) for x in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encoder(self, bpe: bytes, made: dict):
        """Encodes without special tokens. Merges in the order of their ids are ranks, which tiktoken resolves faster with the same result."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        vocab = made["model"]["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in made["model"]["merges"]]
        plain = made["normalizer"] is None and made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and merged == list(range(256, 256 + len(merged))):
            coder = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})
            return coder.encode_ordinary
        whole = Tokenizer.from_str(bpe.decode())
        whole.encode_special_tokens = True
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _by_id(tokens: dict[int, bytes]) -> dict[str, pa.Array]:
        """Columns by id: the token's bytes and their number."""
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        return {"bytes": pa.array(every, pa.binary()), "length": pa.array([len(x) for x in every], pa.int64())}

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and B per text; none for a text that either does not give back byte for byte."""
        spaced = [f" {t}" if t else "" for t in texts]
        a = pa.array([self._encode_a(s) for s in spaced], pa.list_(pa.int32()))
        b = pa.array(self._b.encode(texts, num_threads=1) if texts else [], pa.list_(pa.int32()))
        want = pa.array([s.encode() for s in spaced], pa.binary())
        good = [pc.equal(pc.binary_join(pa.ListArray.from_arrays(ids.offsets, of["bytes"].take(ids.flatten())), b""), want)
                for ids, of in ((a, self.a), (b, self.b))]
        keep = pc.and_(*good)
        none = pa.scalar([], a.type)
        return pc.if_else(keep, a, none), pc.if_else(keep, b, none)


_HELD: dict[tuple[int, int], Tokenizers] = {}


def _tokenizers(shared) -> Tokenizers:
    """The broadcast vocabularies' tokenizers, built once in a worker."""
    bpe, pieces, *_ = shared.value
    key = (hash(bpe), hash(pieces))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokenizers(bpe, pieces)
    return _HELD[key]


def load(spark: SparkSession, bpe_path: str, pieces_path: str):
    """Both vocabularies' contents, and how their ids are written, as a broadcast (a few MB, whatever the corpus)."""
    bpe, pieces = Path(bpe_path).read_bytes(), Path(pieces_path).read_bytes()
    both = Tokenizers(bpe, pieces)
    return spark.sparkContext.broadcast((bpe, pieces, *("<u2" if len(x["length"]) <= 1 << 16 else "<u4" for x in (both.a, both.b))))


def token_ends(ids: pa.ListArray, length: pa.Array) -> pa.Table:
    """Per token ``doc``, ``end`` (bytes from the document's start) and ``id``."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(length.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets[:-1])
    return pa.table({"doc": doc, "end": pc.subtract(total, before.take(doc)), "id": flat})


def links(a: pa.Table, b: pa.Table) -> pa.Table:
    """Overlapping token pairs ``a, b`` (ids) in text order with ``doc`` and ``ends``: whose tokens end where the overlap does."""
    both = a.rename_columns(["doc", "end", "a"]).join(b.rename_columns(["doc", "end", "b"]), ["doc", "end"], join_type="full outer", use_threads=False)
    both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    ends = pc.add(*(pc.multiply(both[c].is_valid().cast(pa.int8()), pa.scalar(n, pa.int8())) for c, n in (("a", A_ENDS), ("b", B_ENDS))))
    return pa.table({"doc": both["doc"], "a": pc.fill_null_backward(both["a"]), "b": pc.fill_null_backward(both["b"]), "ends": ends})


def _lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.ListArray:
    """``values``, in the order of their document's number, as a list per document."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=n))], pa.int32()), values)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` as bytes, ``counts`` of them a row."""
    offsets = (np.r_[0, np.cumsum(counts)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> pa.ListArray:
    """Rows of :func:`_packed` as lists."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data, np.uint8)[at[0]:at[-1]].tobytes() if data else b""
    values = np.frombuffer(values, kind)
    return pa.ListArray.from_arrays(pa.array((at - at[0]) // values.itemsize, pa.int32()), pa.array(values.astype(np.int32)))


def _read_links(a: pa.ListArray, b: pa.ListArray, ends: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Written tokens as links again: document, A id, B id, ends."""
    flag, doc = ends.values.to_numpy(), pc.list_parent_indices(ends).to_numpy()
    out = []
    for ids, bit in ((a, A_ENDS), (b, B_ENDS)):
        own = (flag & bit) > 0
        out.append(ids.values.to_numpy()[np.cumsum(own) - own])
    return doc, *out, flag


def _written(part: pa.RecordBatch, pair) -> list[pa.ListArray]:
    """The columns ``_a, _b, _ends`` of a batch as lists."""
    return [_unpacked(part.column(c), kind) for c, kind in zip(("_a", "_b", "_ends"), (*pair.value[2:], "u1"), strict=True)]


def group_texts(a: pa.ListArray, b: pa.ListArray, doc: np.ndarray, flag: np.ndarray) -> pa.Array:
    """Per document its groups, as ``a1,a2|b1;a3|b2,b3``."""
    n = len(a)
    both = flag == BOTH_END
    group = np.cumsum(both) - both
    sides, text, docs = [], [], []
    for ids, bit, last in ((a, A_ENDS, "|"), (b, B_ENDS, ";")):
        own = (flag & bit) > 0
        separator = pc.if_else(pa.array(both[own]), last, ",")
        text.append(pc.binary_join_element_wise(pc.list_flatten(ids).cast(pa.string()), separator, ""))
        sides.append(2 * group[own] + (bit == B_ENDS))
        docs.append(doc[own])
    order = np.argsort(np.concatenate(sides), kind="stable")
    joined = pc.binary_join(_lists(pa.concat_arrays(text).take(pa.array(order)), np.concatenate(docs), n), "")
    return pc.utf8_slice_codeunits(joined, 0, -1)


def _slices(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    """Parts of batches that hold about ``BYTES_AT_ONCE`` by ``size(batch)`` (per row), a longer row by itself."""
    for whole in batches:
        total = np.cumsum(size(whole))
        start = 0
        while start < whole.num_rows:
            used = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, used + BYTES_AT_ONCE, side="right")))
            yield whole.slice(start, stop - start)
            start = stop


def _links_of(batch: pa.RecordBatch) -> np.ndarray:
    """Number of links of each row."""
    return pc.binary_length(batch.column("_ends")).to_numpy()


def encode_both(docs: DataFrame, columns: list[str], pair, text: str = "text") -> DataFrame:
    """``columns`` of every row and ``_row`` (its number), ``_a``, ``_b`` (ids) and ``_ends`` (per link, see :func:`links`) as bytes, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(pair)
        for part in _slices(batches, lambda x: pc.binary_length(x.column(x.num_columns - 1)).to_numpy(zero_copy_only=False)):
            a, b = both.encode(part.column(part.num_columns - 1).to_pylist())
            made = links(token_ends(a, both.a["length"]), token_ends(b, both.b["length"]))
            ids = [_packed(pc.list_flatten(x).to_numpy().astype(kind), pc.list_value_length(x).to_numpy()) for x, kind in zip((a, b), pair.value[2:])]
            ends = _packed(_whole(made["ends"]).to_numpy().astype("u1"), np.bincount(made["doc"].to_numpy(), minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *ids, ends], [*part.schema.names[:-1], "_a", "_b", "_ends"])

    rows = docs.select(*columns, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_text").schema)
    return cut_lineage(rows.mapInArrow(run, fields + "_a binary, _b binary, _ends binary"))


def pair_counts(encoded: DataFrame, pair) -> DataFrame:
    """How many links of all documents hold each id pair: ``a, b, n``."""
    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in _slices(batches, _links_of):
            _, a, b, _ = _read_links(*_written(part, pair))
            held.append(pa.table({"a": a, "b": b}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"]))
            if sum(t.num_rows for t in held) > PAIRS_AT_ONCE:
                held = [merged(held)]
                if held[0].num_rows > PAIRS_AT_ONCE // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    return encoded.select("_a", "_b", "_ends").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _parted(counts: DataFrame, head: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs from a count up, ``head`` at most, and the others (None if there are none)."""
    size = F.floor(F.log2("n"))
    by_size = sorted(counts.groupBy(size.alias("s")).count().collect(), key=lambda r: -r["s"])
    least, room = 0, head
    for r in by_size:
        room -= r["count"]
        if room < 0:
            least = r["s"] + 1
            break
    return counts.where(size >= least), counts.where(size < least) if room < 0 else None


def align(docs: DataFrame, columns: list[str], pair, text: str = "text", head: int = HEAD_PAIRS) -> DataFrame:
    """``columns`` of every row, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``groups`` are the runs of A and B tokens between ends that both have, as
    ``a1,a2|b1;a3|b2,b3``. A link is a pair of an A and a B token that overlap;
    its count is how many links of all rows hold its id pair. ``count_sum`` adds
    the counts of a row's links, ``n_best`` are those whose count is the highest
    of their B id, ties included.

    A null or empty text has no tokens, nor has one whose joined A or B bytes are
    not a space and the text: all numbers are 0 and ``groups`` is ''. Repeated
    rows each give a row and each count; an empty table gives an empty result;
    ``columns`` pass through and may not be named like the results or ``_row``,
    ``_a``, ``_b``, ``_ends``, ``_n``, ``_m``.
    """
    encoded = encode_both(docs, columns, pair, text)
    counts = cut_lineage(pair_counts(encoded, pair))
    top = counts.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_top"))      # at most as many rows as B has ids
    counts = counts.join(F.broadcast(top), F.col("b") == F.col("_b")).select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))
    often, rare = _parted(counts, head)
    got = often.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "n", "best").orderBy("key").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("key", "n", "best")))

    def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each link: whether its pair is broadcast, its count and whether that is its B id's highest."""
        keys, n, best = shared.value
        key = (a.astype(np.int64) << 32) + b
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        own = keys[at] == key
        return own, np.where(own, n[at], 0), own & best[at]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, _links_of):
            doc, a, b, _ = _read_links(*_written(part, pair))
            far = ~counted(a, b)[0]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[far])), pa.array(a[far]), pa.array(b[far])], ["_row", "_ra", "_rb"])

    if rare is None:
        rows = encoded.select("*", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_m"))
    else:
        far = (encoded.select("_row", "_a", "_b", "_ends").mapInArrow(rest, "_row long, _ra int, _rb int").groupBy("_row", "_ra", "_rb").count()
               .join(rare, (F.col("_ra") == F.col("a")) & (F.col("_rb") == F.col("b")))
               .groupBy(F.col("_row").alias("_at")).agg(F.sum(F.col("count") * F.col("n")).alias("_n"), F.sum(F.when(F.col("best"), F.col("count"))).alias("_m")))
        rows = (encoded.join(far, F.col("_row") == F.col("_at"), "left").drop("_at").fillna(0, ["_n", "_m"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, _links_of):
            n = part.num_rows
            a, b, ends = _written(part, pair)
            doc, of_a, of_b, flag = _read_links(a, b, ends)
            _, count, best = counted(of_a, of_b)
            more, more_best = (part.column(c).to_numpy() for c in ("_n", "_m"))
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, count)
            numbers = [pc.list_value_length(a), pc.list_value_length(b), np.bincount(doc[flag == BOTH_END], minlength=n), pc.list_value_length(ends),
                       np.bincount(doc[best], minlength=n) + more_best, total + more]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(x).cast(pa.int64()) for x in numbers), group_texts(a, b, doc, flag)],
                                             [*columns, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return (rows.select(*columns, "_a", "_b", "_ends", "_n", "_m")
            .mapInArrow(run, fields + "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"))
