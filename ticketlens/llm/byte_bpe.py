"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes.

The vocabulary file (rank per token, base64) is read on the driver; its size
is fixed, so it is broadcast. A pre-token that a worker has not met yet is
looked up in the minimal perfect hash (the slot's token bytes are compared, so
a pre-token outside the vocabulary never passes); one that is not there is
merged in a linked list of bytes, lowest rank first. A bounded memo keeps what
was found. There is no shuffle; a task's memory is a batch of rows and the memo.

Texts are split by class changes of their code points where the pattern is
``CLASS_PATTERN``, else by the pattern itself.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mph import MinimalPerfectHash
from .workers import tidy

#: Distinct pre-tokens that a worker remembers before it starts over, and their longest.
MEMO_TOKENS, MEMO_CHARS = 400_000, 256

#: Fixed value: the pattern that :func:`class_cuts` follows.
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_ENDINGS = {"s": 2, "t": 2, "m": 2, "d": 2, "re": 3, "ve": 3, "ll": 3}


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, by the properties that the pattern names."""
    out = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = "".join(map(chr, points.tolist()))
    for kind, prop in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(prop, every):
            out[points[m.start():m.end()]] = kind
    return out


def class_cuts(text: str) -> np.ndarray:
    """Starts of the pre-tokens of ``text`` under ``CLASS_PATTERN``, and its length."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes()[points]
    starts = np.empty(n + 1, bool)
    starts[0] = starts[n] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
    ends = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE))   # last white space before something else
    starts[ends] = True
    starts[ends[points[ends] == 32] + 1] = False                          # a space goes with what follows
    for i in np.flatnonzero((points[:-1] == 39) & starts[:n - 1] & (kind[1:] == _LETTER)).tolist():
        size = _ENDINGS.get(text[i + 1]) or _ENDINGS.get(text[i + 1:i + 3])
        if size:
            starts[i + 1], starts[i + size] = False, True
    return np.flatnonzero(starts)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}


def _digests(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, tokens)), np.uint64).reshape(-1, 2)


class ByteBPE:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        h = _digests(tokens)
        self.index = MinimalPerfectHash.build(h[:, 0], h[:, 1])
        slots = self.index.slots(h[:, 0], h[:, 1]).tolist()
        self.token_at: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, slots, strict=True):
            self.token_at[slot] = token
        self.rank_at = [ranks[t] for t in self.token_at]
        lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.length_of, self.start_of = lengths, np.cumsum(lengths) - lengths
        self.all_bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.memo = _Memo(self)
        self._pattern = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "_pattern": None}

    def __setstate__(self, state):
        self.__dict__ = state | {"memo": _Memo(self)}

    def pre_tokens(self, text: str) -> list[str]:
        if self.pattern == CLASS_PATTERN:
            cuts = class_cuts(text).tolist()
            return [text[a:b] for a, b in itertools.pairwise(cuts)]
        if self._pattern is None:
            self._pattern = regex.compile(self.pattern)
        return self._pattern.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: merge the neighbours of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))       # end of the part that starts here; 0 once merged away
        prev = list(range(-1, n - 1))     # start of the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue                  # one of the two has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def resolve(self, pre_token: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        piece = pre_token.encode()
        h = xxhash.xxh3_128_digest(piece)
        slot = self.index.slot(int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little"))
        if slot >= 0 and self.token_at[slot] == piece:
            return self.rank_at[slot].to_bytes(4, "little")
        return np.array(self.merge(piece), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.pre_tokens(text)))

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.length_of[at]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.all_bytes[np.repeat(self.start_of[at] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


class _Memo(dict):
    """Ids by pre-token; resolves what it does not hold."""

    def __init__(self, coder: ByteBPE):
        super().__init__()
        self.coder = coder

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.coder.resolve(pre_token)
        if len(pre_token) <= MEMO_CHARS:
            self[pre_token] = ids
        return ids


_HELD: dict[int, ByteBPE] = {}


def _coder(shared) -> ByteBPE:
    """The broadcast coder; a reused worker keeps its memo from task to task."""
    if shared.id not in _HELD:
        _HELD.clear()
        _HELD[shared.id] = shared.value
    return _HELD[shared.id]


def load(spark: SparkSession, path: str, pattern: str):
    """Broadcast coder of a rank file. The vocabulary's size bounds it (a few MB)."""
    return spark.sparkContext.broadcast(_Shared(ByteBPE(read_ranks(path), pattern)))


class _Shared:
    """Names a broadcast coder, so that a worker can tell two apart."""

    def __init__(self, value: ByteBPE):
        self.value = value
        self.id = hash((len(value.ranks), value.pattern, xxhash.xxh3_64_intdigest(b"\0".join(value.token_at))))


#: Rows that are in a task's Python memory at once.
ROWS_AT_ONCE = 256


def encode_decode(docs: DataFrame, columns: list[str], coder, text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``columns`` of every row, ``n_tokens``, and ``outputs``.

    Outputs: ``ids`` (array), ``ids_le`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded`` (the bytes that the ids decode to). Special tokens
    are never made: their strings are ordinary text. A null text is the empty
    text, which has no ids. Equal rows each give a row; an empty table gives an
    empty result; ``columns`` pass through as they are and may not be named like
    the results.
    """
    kinds = {"ids": "array<int>", "ids_le": "binary", "decoded": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(coder.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                ids = [bpe.encode(x) for x in b.column(b.num_columns - 1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                made = {"ids_le": lambda ids=ids: pa.array(ids, pa.binary()),
                        "decoded": lambda ids=ids: pa.array([bpe.decode(x) for x in ids], pa.binary()),
                        "ids": lambda ids=ids, sizes=sizes: pa.ListArray.from_arrays(
                            pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))}
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes), *(made[x]() for x in outputs)],
                                                 [*b.schema.names[:-1], "n_tokens", *outputs])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(tidy(run), fields + "n_tokens long" + "".join(f", {x} {kinds[x]}" for x in outputs))
