"""N-gram Jaccard join by universe partition: pigeonhole over hashed segments, then exact verification.

A text's set is its distinct word shingles. Sets are banded by size; in a band
the universe of shingles is hashed into so many segments that two linked sets
must agree in enough of them. With H the greatest symmetric difference of two
linked sets and v(i) in {0, 1, 2} the effort a set spends on segment i, any
allocation with sum v >= H + 1 finds a segment where the sets differ by less
than v(i) shingles (pigeonhole): v = 1 asks for the same segment subset, v = 2
also for one deletion on either side, v = 0 skips it. The allocation skips the
dearest segments, those whose subsets many sets share: empty ones, and those
whose rarest shingle is common, as counted on a bounded sample, then those with
the fewest shingles: first as far as the band has segments to spare, then by
v = 2 on segments that hold enough shingles. The sample decides on costs alone:
any allocation finds every link.

1. Each text gives its set's size and class (a hash of the whole set): copies
   are one class from here on.
2. Each class gives a row per segment subset (and one-deletion subset) it may
   be asked for. Rows of one key are read as a sorted stream: short runs give
   their pairs, long runs a star around their largest set and a chain.
3. Pairs whose parity bits differ in more places than linked sets may differ in
   shingles go. The others are verified on the texts of the classes concerned:
   whole sets, integer arithmetic. Verified links make components (large-star, small-star).
4. Long runs that still hold several components give, for each row, its nearest
   partner in another component; when these are verified and joined, what is left
   gives all pairs across components whose parity bits allow a link. So no link between components is lost,
   and pairs inside a component are not spelled out.
5. Every document gets the smallest id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage
from ticketlens.sources.tables import small_side

from .workers import tidy

_U = np.uint64
_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
#: Least ratio of a band's bounds, and the longest runs of a key that give all their pairs.
BAND_RATIO, SHORT_RUN = 1.6, 12
#: Rows of a long run that are compared with its others at once.
BLOCK = 256
#: Distinct texts, about, on which shingles are counted for the costs, the buckets of the counts, and the least count that is kept.
SAMPLE, BUCKETS, COMMON = 4_000, 1 << 23, 3
#: Bytes of a table of classes, about, up to which it is sent to all tasks; larger ones are shuffled. Each step is short, so a shuffle's tasks would outweigh it.
FEW = 3 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words between ASCII white space.

    A text of fewer words than ``width`` has its whole sequence as the one
    shingle; a text without words has none.
    """
    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = min(width, len(h))
    out = np.full(max(0, len(h) - n + 1) if n else 0, _U(n))
    for i in range(n):
        out = _mix(out * _U(_STEP) + h[i:len(h) - n + i + 1])
    return np.unique(out)


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set; equal sets have equal classes."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def parities(s: np.ndarray) -> bytes:
    """A bit per bucket of shingles: whether it holds an odd number of them.

    There is a bucket a shingle at least, a power of two: linked sets differ in
    a small part of their shingles, of which few cancel out, and pairs carry the bits
    through a join. Two sets differ in as many shingles at least as their
    parities differ in bits.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    bucket = (_mix(s + _U(_STEP >> 1)) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(rows: list[bytes], words: int) -> np.ndarray:
    """Parities as rows of ``words`` 64-bit words: those of more buckets have their halves added up."""
    out = np.empty((len(rows), words), _U)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join([rows[i] for i in own.tolist()]), _U).reshape(len(own), -1)
        while x.shape[1] > words:
            x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        out[own] = x
    return out


class Threshold:
    """Bands, segments and efforts for a Jaccard likeness of ``num / den`` at least."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = max(BAND_RATIO, 1.1 * 20 * den / (19 * num))    # linked sets lie in the same band or in neighbours
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * ratio)))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not self.near_in_size(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def near_in_size(self, a: int, b: int) -> bool:
        return self.den * min(a, b) >= self.num * max(a, b) and min(a, b) > 0

    def differ(self, a: int) -> int:
        """Greatest symmetric difference of a set of ``a`` shingles and a linked one that is no larger."""
        return 2 * a * (self.den - self.num) // (self.den + self.num)

    def most(self, sizes):
        """Greatest symmetric difference of two linked sets, from their sizes' sum."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def segments(self, band: int) -> tuple[int, int, int]:
        """Segments of a band, how many of them (the last) take deletions, and the largest size."""
        top = self.lows[band + 1] - 1
        m = self.differ(top) + 1
        return m, m if m <= 8 else max(2, m // 32), top

    def rows(self, s: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set, and whether it asks under each (else it is only found there).

        ``common`` counts shingles by bucket (see :func:`common_shingles`).
        """
        size, keys, asks = len(s), [], []
        g, c = _mix(s ^ _U(_STEP)), _mix(s + _U(_STEP))
        often = np.zeros(size, np.int64) if common is None else common[(g & _U(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
        own = self.band(size)
        for band in (own, own + 1):
            m, deletions, top = self.segments(band)
            if band > own and self.den * size < self.num * self.lows[band]:
                break                                   # too small for any set of that band
            seg = (g % _U(m)).astype(np.int64)
            held = np.bincount(seg, minlength=m)
            order = np.argsort(seg, kind="stable")
            sums = np.zeros(m, _U)
            full = np.flatnonzero(held)
            sums[full] = np.add.reduceat(c[order], (np.cumsum(held) - held)[full])
            dear = np.full(m, 1 << 30)
            dear[full] = np.minimum.reduceat(often[order], (np.cumsum(held) - held)[full])
            salt = _mix(np.arange(m, dtype=_U) + _U(band << 44))
            keys.append(_mix(sums + salt))
            effort, upgrades = np.zeros(m, np.int8), False
            if band == own:
                upgrades = m <= 8 or size * 20 >= top * 19
                effort = self._effort(held, dear, m - self.differ(size) - 1, deletions if upgrades else 0)
            asks.append(effort > 0)
            # deletions are asked for by sets of 0.95 of the top at least, and found in those that may be linked to such
            if m <= 8 or band == own and 20 * self.den * size >= 19 * self.num * top:
                at = np.flatnonzero(seg >= m - deletions)
                keys.append(_mix(sums[seg[at]] - c[at] + salt[seg[at]]))
                asks.append(effort[seg[at]] == 2)
        return np.concatenate(keys), np.concatenate(asks)

    @staticmethod
    def _effort(held: np.ndarray, dear: np.ndarray, spare: int, deletions: int) -> np.ndarray:
        """Effort by segment: skip the ``spare`` dearest, and one more for each segment raised to two.

        ``held`` are the segments' shingles, ``dear`` the count of the rarest one.
        """
        effort = np.ones(len(held), np.int8)
        dearest = np.lexsort([held, -dear])
        effort[dearest[:spare]] = 0
        left = [i for i in dearest[spare:].tolist() if held[i] <= 1 or dear[i] > 0]
        able = [i for i in range(len(held) - deletions, len(held)) if effort[i] and held[i] > 1 and not dear[i]]
        for drop, rise in zip(left, able, strict=False):
            effort[drop], effort[rise] = 0, 2
        return effort


#: Texts that are in a task's Python memory at once.
ROWS_AT_ONCE = 256


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _texts(b: pa.RecordBatch) -> list[str]:
    return b.column(b.num_columns - 1).to_pylist()


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            sets = [shingle_set(t, width) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                                              pa.array([parities(s) if len(s) else None for s in sets], pa.binary())],
                                             [*b.schema.names[:-1], "n_shingles", "class", "parities"])
    return run


def common_shingles(rows: DataFrame, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of shingles that many texts hold, and their counts (255 at most), on about ``SAMPLE`` distinct texts of the column ``_text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint8)
        for b in _parts(batches):
            for text in set(_texts(b)):
                at = np.unique((_mix(shingle_set(text, width) ^ _U(_STEP)) & _U(BUCKETS - 1)).astype(np.int64))
                counts[at] += counts[at] < 255
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own], pa.int64())], ["at", "n"])

    few = rows.where(F.pmod(F.xxhash64("_text"), F.lit(max(1, n_rows // SAMPLE))) == 0).select("_text")
    got = few.mapInArrow(tidy(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    return got["at"].to_numpy(), np.minimum(got["n"].to_numpy(), 255).astype(np.uint8)


def _key_rows(width: int, threshold: Threshold, sampled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(BUCKETS, np.uint8)
        at, n = sampled.value
        common[at] = n
        for b in _parts(batches):
            held, n = [], 0
            for text in _texts(b):
                s = shingle_set(text, width)
                if len(s):
                    keys, asks = threshold.rows(s, common)
                    held.append((keys.view(np.int64), np.full(len(keys), class_of(s)), len(s) * 2 + asks))
                    n += len(keys)
                if n > 1 << 17:
                    yield _long_batch(held, ["key", "class", "tag"])
                    held, n = [], 0
            if held:
                yield _long_batch(held, ["key", "class", "tag"])
    return run


def _long_batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], names)


def _runs(threshold: Threshold):
    """Stream of rows sorted by key and falling tag: pairs (kind 0), and the rows of long runs (kind 1)."""
    num, den = threshold.num, threshold.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)      # the rows of the last key, as far as it may still be a short run
        long_key = top = last = None           # a long run that goes on: its key, first row and last row

        def found(rows: np.ndarray, over: bool) -> list[tuple]:
            """Output for whole runs in ``rows``; without ``over`` the last run may go on."""
            nonlocal held, long_key, top, last
            key, cls, tag = rows
            out: list[tuple] = []
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[new, len(key)])
            if not over and length[-1] <= SHORT_RUN and key[-1] != long_key:
                held = rows[:, new[-1]:]
                key, cls, tag = rows[:, :new[-1]]
                new, length = new[:-1], length[:-1]
            else:
                held = rows[:, :0]
            if not len(key):
                return out
            goes_on = key == long_key if long_key is not None else np.zeros(len(key), bool)
            each = np.repeat(length, length)
            short = (each <= SHORT_RUN) & ~goes_on
            size, asks = tag >> 1, tag & 1 == 1
            for d in range(1, min(SHORT_RUN, int(length.max()))):
                a, b = slice(0, len(key) - d), slice(d, len(key))
                ok = short[a] & (key[a] == key[b]) & (cls[a] != cls[b]) & (asks[a] | (asks[b] & (size[a] == size[b]))) & (den * size[b] >= num * size[a])
                out.append((np.zeros(int(ok.sum()), np.int64), cls[a][ok], cls[b][ok], tag[b][ok]))
            if not short.all():
                far = np.flatnonzero(~short)
                first = np.repeat(new, length)
                before = np.maximum(np.arange(len(key)) - 1, first)
                pivot, prior, pivot_size, prior_size = cls[first], cls[before], size[first], size[before]
                if goes_on.any():
                    pivot[goes_on], pivot_size[goes_on] = top
                    prior[0], prior_size[0] = last
                for other, other_size in ((pivot, pivot_size), (prior, prior_size)):
                    ok = far[(other[far] != cls[far]) & (den * size[far] >= num * other_size[far])]
                    out.append((np.zeros(len(ok), np.int64), other[ok], cls[ok], tag[ok]))
                out.append((np.ones(len(far), np.int64), key[far], cls[far], tag[far]))
                if not over and not short[-1]:
                    long_key, top, last = key[-1], (pivot[-1], pivot_size[-1]), (cls[-1], size[-1])
            return out

        def batch(parts: list[tuple]) -> pa.RecordBatch | None:
            if not parts:
                return None
            b = _long_batch(parts, ["kind", "a", "b", "tag"])
            return b if b.num_rows else None

        for b in batches:
            rows = np.stack([c.to_numpy() for c in b.columns])
            rows = np.concatenate([held, rows], axis=1)
            if rows.shape[1]:
                same = (rows[:, 1:] == rows[:, :-1]).all(axis=0)        # copies of a class
                if made := batch(found(rows[:, np.r_[True, ~same]], False)):
                    yield made
        if held.shape[1] and (made := batch(found(held, True))):
            yield made
    return run


def _sift(threshold: Threshold):
    """Pairs whose parities allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            words = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)])
            ok = np.zeros(len(words), bool)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                differ = folded([x[i] for i in at.tolist()], w) ^ folded([y[i] for i in at.tolist()], w)
                ok[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= threshold.most(na[at] + nb[at])
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])
    return run


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in _parts(batches):
            texts = _texts(b)
            classes = [class_of(s) if len(s := shingle_set(t, width)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([press(t.encode()) for t in texts], pa.binary())], ["class", "packed"])
    return run


def _verify(width: int, threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        recent: dict[int, np.ndarray] = {}

        def of(cls: int, packed: bytes) -> np.ndarray:
            if cls not in recent:
                if len(recent) >= 64:
                    del recent[next(iter(recent))]
                recent[cls] = shingle_set(unpack(packed).decode(), width)
            return recent[cls]

        for b in batches:
            a, c, pa_, pc = (x.to_pylist() for x in b.columns)
            ok = np.array([threshold.linked(of(x, p), of(y, q)) for x, y, p, q in zip(a, c, pa_, pc, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])
    return run


def _across(threshold: Threshold, nearest: bool):
    """Pairs across components of long runs that their parities allow to link, from rows sorted by key and falling tag.

    Blocks of rows are compared with the rows before them that are near enough
    in size; only those are held. ``nearest`` gives each row's nearest partner
    alone, at most a pair a row; else all pairs.
    """
    num, den = threshold.num, threshold.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = np.zeros((4, 0), np.int64), []
        for b in batches:
            rows, own = np.stack([c.to_numpy() for c in b.columns[:4]]), b.column(4).to_pylist()
            for at in range(0, rows.shape[1], BLOCK):
                held, bits = np.concatenate([held, rows[:, at:at + BLOCK]], axis=1), bits + own[at:at + BLOCK]
                first = held.shape[1] - min(BLOCK, rows.shape[1] - at)
                key, cls, tag, comp = held
                size, asks = tag >> 1, tag & 1 == 1
                for k in np.unique(key[first:]).tolist():
                    run_rows = np.flatnonzero(key == k)
                    late = run_rows[run_rows >= first]
                    near = (comp[run_rows][:, None] != comp[late]) & (run_rows[:, None] < late) & (den * size[late] >= num * size[run_rows][:, None])
                    near &= asks[run_rows][:, None] | (asks[late] & (size[run_rows][:, None] == size[late]))
                    i, j = np.nonzero(near)
                    if len(i):
                        x = folded([bits[n] for n in run_rows.tolist()], min(len(bits[n]) for n in run_rows.tolist()) // 8)
                        place = np.searchsorted(run_rows, late)
                        step = max(64, (1 << 19) // x.shape[1])     # 4 MB at once
                        best: dict[int, tuple[int, int]] = {}
                        for cut in range(0, len(i), step):
                            p, q = i[cut:cut + step], j[cut:cut + step]
                            differ = np.bitwise_count(x[p] ^ x[place[q]]).sum(axis=1, dtype=np.int64)
                            ok = differ <= threshold.most(size[run_rows[p]] + size[late[q]])
                            p, q, differ = p[ok], q[ok], differ[ok]
                            if nearest:
                                order = np.lexsort([p, differ, q])
                                for n in order[np.r_[True, np.diff(q[order]) > 0]].tolist() if len(q) else ():
                                    best[int(q[n])] = min(best.get(int(q[n]), (1 << 60, 0)), (int(differ[n]), int(p[n])))
                            elif len(p):
                                yield pa.RecordBatch.from_arrays([pa.array(cls[run_rows[p]]), pa.array(cls[late[q]])], ["a", "b"])
                        if best:
                            yield pa.RecordBatch.from_arrays([pa.array([int(cls[run_rows[n]]) for _, n in best.values()], pa.int64()),
                                                              pa.array([int(cls[late[n]]) for n in best], pa.int64())], ["a", "b"])
                keep = np.flatnonzero((key == key[-1]) & (den * size[-1] >= num * size))
                held, bits = held[:, keep], [bits[n] for n in keep.tolist()]
    return run


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of links ``a, b``: large-star and small-star until the links are stars.

    Every step is a partial aggregation and a join, written to the shared
    checkpoint folder; a node of very many links is reduced before it is
    shuffled. Nulls and links of a node with itself are left out.
    """
    links = cut_lineage(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = small_side(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = cut_lineage(both.join(low, both["u"] == low["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), "m", "n")
        # a node of one link gives that link alone
        joined = large.join(small_side(low.where("n > 1")), F.col("u") == F.col("w")).where("v <> m")
        links = cut_lineage(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        # stars: every node links to one other, which links to none
        ends = links.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("v")).union(
            links.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(1).alias("v")))
        if ends.groupBy("u").agg(F.max("n").alias("n"), F.max("v").alias("v")).where("n > 1 OR n > 0 AND v > 0").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_further(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (``node, component``) after more links ``a, b``: they link components, whose own components are found alone."""
    of = small_side(label)
    ends = (links.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    above = components(ends).withColumnsRenamed({"node": "was", "component": "now"})
    moved = label.join(small_side(above), F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    return moved.union(above.select(F.col("was").alias("node"), F.col("now").alias("component"))).distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of
    ``width``-word shingles; ``component_id`` is the smallest id that links
    reach, the row's own included. A null, empty or blank text has no shingles
    and links with nothing, not with another such text. Repeated rows and copies
    share a component. Null ids do not count as smallest: a component of null
    ids alone has a null id. An empty table gives an empty result; further
    columns are left out.

    Shingles and sets are compared as 64-bit hashes.
    """
    threshold = Threshold(num, den)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    members = cut_lineage(rows.mapInArrow(tidy(_classes(width)), f"doc_id {id_type}, n_shingles long, class long, parities binary"))
    classes = cut_lineage(members.where("class IS NOT NULL").dropDuplicates(["class"]).withColumnRenamed("doc_id", "one"))
    sampled = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, members.count(), width))      # bounded by the sample's shingles
    keyed = rows.select("_text").mapInArrow(tidy(_key_rows(width, threshold, sampled)), "key long, class long, tag long")
    keyed = keyed.repartition("key").sortWithinPartitions("key", F.desc("tag"), "class")
    found = cut_lineage(keyed.mapInArrow(tidy(_runs(threshold)), "kind long, a long, b long, tag long"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        one = small_side(classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("na"), F.col("parities").alias("xa")), FEW)
        two = small_side(classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("nb"), F.col("parities").alias("xb")), FEW)
        pairs = cut_lineage(pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "xa", "xb")
                            .mapInArrow(tidy(_sift(threshold)), "a long, b long"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        chosen = cut_lineage(classes.join(wanted, "class", "left_semi").select("class", "one"))
        ids = chosen.select("one").distinct()
        packed = (rows.join(small_side(ids), rows["doc_id"].eqNullSafe(ids["one"]), "left_semi").select("_text")
                  .mapInArrow(tidy(_pack(width)), "class long, packed binary").join(chosen.select("class"), "class", "left_semi").dropDuplicates(["class"]))
        packed = cut_lineage(packed)
        one = small_side(packed.select(F.col("class").alias("a"), F.col("packed").alias("pa")), FEW)
        two = small_side(packed.select(F.col("class").alias("b"), F.col("packed").alias("pb")), FEW)
        return cut_lineage(pairs.join(two, "b").join(one, "a").select("a", "b", "pa", "pb").mapInArrow(tidy(_verify(width, threshold)), "a long, b long"))

    label = cut_lineage(components(verified(found.where("kind = 0"))))
    runs = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("class"), "tag")
    for nearest in (True, False) if not runs.isEmpty() else ():
        placed = runs.join(small_side(label.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        rest = (placed.join(small_side(mixed, FEW), "key", "left_semi").join(small_side(classes.select("class", "parities"), FEW), "class")
                .select("key", "class", "tag", "component", "parities").repartition("key").sortWithinPartitions("key", F.desc("tag"), "class"))
        more = cut_lineage(rest.mapInArrow(tidy(_across(threshold, nearest)), "a long, b long"))
        if more.isEmpty():
            break
        more = verified(more)
        if not more.isEmpty():
            label = cut_lineage(joined_further(label, more))
    # one aggregation, then a join with nothing above it: a component of very many rows is broadcast to or split
    placed = (members.select("doc_id", "n_shingles", "class").join(small_side(label.withColumnRenamed("node", "class")), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    lowest = cut_lineage(placed.where("class IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("lowest")))
    return (placed.join(small_side(lowest), "component", "left")
            .select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")))
