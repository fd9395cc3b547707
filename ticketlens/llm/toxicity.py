"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel of order three:
common character triples count ``DECAY`` to the power of the characters they
skip, so that a gap or an inserted character (``id-iot``, ``i.d.i.o.t``) lowers
the likeness and does not end it. It is normalised to 1 for equal words, sharpened by
a power, and summed over the words of two sentences, which keeps it a kernel.

Landmarks are words and parts of words, chosen on the fitting sample: those whose
presence tells toxic from clean documents best, unlike each other, and some
common ones. A sentence's features are its kernel values with the landmarks,
whitened by the landmarks' own kernel matrix (Nyström). Labels belong to
documents, so the machine is fitted on sentences in rounds: each document gives
the sentence that scores highest so far, toxic ones as positive, clean ones as
negative examples, and clean sentences of earlier rounds stay. Every document
also counts with a character inserted into each of its words, so that the
machine is fitted to disguised words as well. Labels may be wrong: toxic
documents that no round gets near the toxic side do not bend the next one.

A text's score is its most toxic sentence's, calibrated on held-back documents
of the sample. Since the kernel is a sum over words, a word's share of the score
is a number that workers keep, and scoring is one pass without a shuffle.

The sample is bounded by ``Fit.per_class``; its texts stay in Spark, and only
counts of strings and one feature row per document and round reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage

#: Weight of a skipped character, and the most places from the first to the last of a triple (its weight is 0.34 there).
DECAY, REACH = 0.7, 5
#: Bins of characters: letters a-z by themselves, others by code point.
CHARS = 64
#: Words of a sentence (longer ones are cut), letters of a word (longer ones are cut), words that a worker remembers, and those looked up at once.
SENTENCE_WORDS, WORD_CHARS, MEMO_WORDS, WORDS_AT_ONCE = 64, 48, 400_000, 2048

_CUT = re.compile(r"[.!?]+(?=\s|$)|\n")
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_WORD = re.compile(r"[^\W_]+")
_EDGE = ".,;:!?\"'()[]{}<>«»¡¿*_-"


@dataclass(frozen=True)
class Fit:
    """Bound of the labelled sample and settings of kernel and machine."""

    per_class: int = 3_000    # labelled documents of each class
    telling: int = 96         # landmarks that tell the classes apart, at most
    surely: float = 5.0       # standard errors between the classes' shares of documents that make a string telling
    common: int = 24          # frequent ones
    lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    power: int = 4            # sharpens a word's likeness
    alike: float = 0.6        # likeness above which a string adds no landmark
    rounds: int = 4
    cost: float = 1.0
    floor: float = 0.05       # least eigenvalue of the landmarks' kernel matrix that is divided by
    lost: float = -0.5        # toxic documents below this margin after a round are taken as mislabelled in the next


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence in lower case, without marks at their ends.

    Letters spelled one by one are a word. A word with marks inside counts
    without them, and so does each of its parts of three characters at least.
    """
    out = []
    for part in _CUT.split(text.lower()):
        if _SPELLED.search(part):
            part = _SPELLED.sub(lambda m: re.sub(r"\s", "", m[0]), part)
        words = []
        for x in part.split():
            if x.isalnum() or (x := x.strip(_EDGE)).isalnum():
                words.append(x)
            elif parts := _WORD.findall(x):
                words += ["".join(parts), *(p for p in parts if len(p) > 2 and len(parts) > 1)]
        out += [words[i:i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def _pieces(word: str) -> list[str]:
    return [word[i:i + WORD_CHARS] for i in range(0, len(word), WORD_CHARS)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gapped triples of each word: number of the word (ascending), triple, summed weight. Longer words count by their parts."""
    parts = [p for w in words for p in _pieces(w)]
    owner = np.repeat(np.arange(len(words)), [max(1, -(-len(w) // WORD_CHARS)) if w else 0 for w in words])
    joined = "".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (CHARS - 26))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    part_of = np.repeat(np.arange(len(parts)), size)
    end = np.cumsum(size)[part_of]
    at = np.arange(len(code))
    keys, weights = [], []
    for first in range(1, REACH):
        for second in range(1, REACH - first + 1):
            a = at[at + first + second < end]
            keys.append((owner[part_of[a]] * CHARS + code[a]) * CHARS * CHARS + code[a + first] * CHARS + code[a + first + second])
            weights.append(np.full(len(a), DECAY ** (first + second - 2)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(key))
    return key // CHARS ** 3, key % CHARS ** 3, weight


class Landmarks:
    """Strings, and the kernel of any word with each of them."""

    def __init__(self, strings: list[str], power: int):
        self.strings, self.power = strings, power
        owner, triple, weight = triples(strings)
        norm = np.sqrt(np.bincount(owner, weight ** 2, len(strings)))
        own = np.unique(triple)
        self.row = np.zeros(CHARS ** 3, np.int32)               # 0: no landmark has the triple
        self.row[own] = np.arange(1, len(own) + 1)
        self.table = np.zeros((len(own) + 1, len(strings)), np.float32)
        self.table[self.row[triple], owner] = weight / np.maximum(norm[owner], 1e-12)

    def likeness(self, words: list[str]) -> np.ndarray:
        """Normalised kernel, [words x landmarks]."""
        owner, triple, weight = triples(words)
        norm = np.sqrt(np.bincount(owner, weight ** 2, len(words)))
        row = self.row[triple]
        hit = row > 0
        out = np.zeros((len(words), len(self.strings)), np.float32)
        if hit.any():
            owner, value = owner[hit], self.table[row[hit]] * weight[hit, None].astype(np.float32)
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[start]] = np.add.reduceat(value, start, axis=0)
        return out / np.maximum(norm, 1e-12)[:, None].astype(np.float32)

    def features(self, words: list[str]) -> np.ndarray:
        """Sharpened kernel, [words x landmarks]."""
        return self.likeness(words) ** self.power

    def sentence_features(self, sentence: list[list[str]]) -> np.ndarray:
        """Kernel of each sentence with the landmarks, [sentences x landmarks]."""
        every = [w for s in sentence for w in s]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(every))}
        of_word = self.features(list(distinct))
        out = np.zeros((len(sentence), len(self.strings)), np.float32)
        np.add.at(out, np.repeat(np.arange(len(sentence)), list(map(len, sentence))), of_word[[distinct[w] for w in every]])
        return out


def choose_landmarks(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int, fit: Fit) -> tuple[Landmarks, np.ndarray]:
    """Landmarks from strings with their numbers of toxic and clean documents, and a first weight of each: its log odds."""
    def odds(toxic: int, clean: int) -> float:
        return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))

    def errors(toxic: int, clean: int) -> float:
        share = (toxic + clean) / (n_toxic + n_clean)
        return (toxic / n_toxic - clean / n_clean) / max(np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean)), 1e-12)

    chosen: list[tuple[str, float]] = []

    def take(strings: list[tuple[str, int, int]], wanted: int) -> None:
        stop = len(chosen) + wanted
        for s, toxic, clean in strings:
            if len(chosen) == stop:
                break
            if any(s in c or c in s for c, _ in chosen):
                continue
            if not chosen or Landmarks([c for c, _ in chosen], fit.power).likeness([s]).max() <= fit.alike:
                chosen.append((s, odds(toxic, clean)))

    sure = {r: e for r in found if (e := errors(*r[1:])) >= fit.surely}
    # a part of a word that hardly occurs without the rest stands for the whole
    whole = [max((o for o in sure if r[0] in o[0] and o[1] >= 0.9 * r[1]), key=lambda o: (len(o[0]), o)) for r in sorted(sure, key=lambda r: (-sure[r], r))]
    take(whole, fit.telling)
    take(sorted(found, key=lambda r: (-r[1] - r[2], r[0])), fit.common)
    return Landmarks([c for c, _ in chosen], fit.power), np.array([w for _, w in chosen])


def disguised(words: list[str]) -> list[str]:
    """Each word with one more letter inside, both by its hash."""
    out = []
    for w in words:
        h = zlib.crc32(w.encode())
        at = 1 + h % max(len(w) - 1, 1)
        out.append(f"{w[:at]}{chr(97 + h // 64 % 26)}{w[at:]}")
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Linear support vector machine (squared hinge, primal Newton steps); the last of the weights is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.ones(z.shape[1])
    ridge[-1] = 1e-4

    def loss(v: np.ndarray) -> float:
        return float((ridge * v * v).sum() / 2 + cost * (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum())

    for _ in range(50):
        slack = np.maximum(0, 1 - y * (z @ w))
        own = slack > 0
        gradient = ridge * w - 2 * cost * z.T @ (weight * y * slack)
        zo = z[own]
        step = np.linalg.solve(np.diag(ridge) + 2 * cost * (zo * weight[own, None]).T @ zo, gradient)
        t, now = 1.0, loss(w)
        while loss(w - t * step) > now and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(step).max() * t < 1e-8:
            break
    return w


@dataclass
class Model:
    """Weight of each landmark's kernel value and bias of a sentence, and the map to probabilities; without landmarks the prior scores."""

    landmarks: Landmarks | None
    alpha: np.ndarray
    bias: float
    floor: float
    slope: float
    shift: float
    prior: float
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def margins(self, texts: list[str]) -> np.ndarray:
        """Decision value of each text's most toxic sentence; of a text without words, the bias."""
        cut = [sentences(t) for t in texts]
        words = {w for doc in cut for s in doc for w in s}
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i:i + WORDS_AT_ONCE]
            self.memo.update(zip(part, (self.landmarks.features(part) @ self.alpha).tolist(), strict=True))
        share = self.memo.__getitem__
        return np.array([max((sum(map(share, s)) for s in doc), default=0.0) for doc in cut]) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.prior)
        return self.floor + (1 - self.floor) / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Floor, slope and shift: probability = floor + (1 - floor) * logistic(slope * margin + shift).

    The floor is the share of toxic labels in the lower half of the margins, where
    only wrong labels are toxic; it keeps them from flattening the slope. Fitted by
    expectation (which toxic rows are above the floor) and Newton steps.
    """
    low = margin <= np.median(margin)
    floor = min(float((weight * y)[low].sum() / max(weight[low].sum(), 1e-9)), 0.5)
    z, w, ridge = np.c_[margin, np.ones(len(margin))], np.array([2.0, 0.0]), np.array([0.05, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        aim = y * p / np.maximum(floor + (1 - floor) * p, 1e-12)
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            w = w + np.clip(np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (aim - p)) - ridge * w), -2, 2)
    return floor, max(float(w[0]), 1e-3), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit, doc_id: str, label: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """Written rows ``at, y, text`` of ``per_class`` labelled documents of each class at most, by a hash of the id; and all labelled ones by class.

    A document's label is the mean of its labels, above a half as 1; of repeated rows of an id the one with the smallest hash counts.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & may_learn).groupBy(F.col(doc_id).alias("_id"))
             .agg((F.avg(label) > 0.5).cast("int").alias("y")).withColumn("at", F.xxhash64("_id", F.lit("toxicity"))))
    ids = docs.select(F.col(doc_id).alias("_doc")).where("_doc IS NOT NULL").distinct().join(known, F.col("_doc") == F.col("_id")).select("_id", "y", "at")
    ids = cut_lineage(ids)
    total = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    bounded = [ids.where(F.col("y") == y).orderBy("at", "_id").limit(fit.per_class) for y in (0, 1)]
    wanted = cut_lineage(bounded[0].unionByName(bounded[1]))
    rows = (docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(wanted), F.col("_doc") == F.col("_id"))
            .groupBy("_id", "at", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    # a few hundred documents a task, whatever the input's partitions
    return cut_lineage(rows.drop("_id").repartition(max(1, 2 * fit.per_class // 500), "at")), total


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, fit: Fit = Fit(), doc_id: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Fit on labels whose rows fulfil ``may_learn``. Null labels do not count."""
    rows, total = _sample(docs, labels, may_learn, fit, doc_id, label, text)
    prior = total.get(1, 0) / max(1, sum(total.values()))
    if min(total.get(0, 0), total.get(1, 0)) < 4:
        return Model(None, np.zeros(0), 0.0, 0.0, 1.0, 0.0, prior)
    fits, held = rows.where("pmod(at, 4) <> 3"), F.expr("pmod(at, 4) = 3")       # a quarter calibrates

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for s in sentences(t) for w in s}
                seen[y].update(words | {w[i:i + n] for w in words for n in fit.lengths for i in range(len(w) - n + 1)})
        for y in (0, 1):
            yield pa.RecordBatch.from_pydict({"s": pa.array(list(seen[y]), pa.string()), "clean": pa.array([n * (1 - y) for n in seen[y].values()], pa.int64()),
                                              "toxic": pa.array([n * y for n in seen[y].values()], pa.int64())})

    n = {r["y"]: r["count"] for r in fits.groupBy("y").count().collect()}
    counts = cut_lineage(fits.select("y", "text").mapInArrow(strings, "s string, clean long, toxic long").groupBy("s")
                         .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 5"))
    lift = F.col("toxic") / max(n.get(1, 0), 1) - F.col("clean") / max(n.get(0, 0), 1)
    telling = counts.where("length(s) >= 3").orderBy(lift.desc(), F.length("s").desc(), "s").limit(40 * fit.telling)
    common = counts.where("length(s) >= 4").orderBy((F.col("toxic") + F.col("clean")).desc(), "s").limit(20 * fit.common)
    found = [tuple(r) for r in telling.union(common).distinct().select("s", "toxic", "clean").collect()]
    if not found or len(n) < 2:
        return Model(None, np.zeros(0), 0.0, 0.0, 1.0, 0.0, prior)
    landmarks, alpha = choose_landmarks(found, n.get(1, 0), n.get(0, 0), fit)
    m = len(landmarks.strings)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = sentences(t) or [[]]
                x = [landmarks.sentence_features(c).tobytes() for c in (cut, [disguised(c) for c in cut])]
                yield pa.RecordBatch.from_arrays([pa.array([at] * 2, pa.int64()), pa.array([y] * 2, pa.int32()), pa.array(x, pa.binary())], ["at", "y", "x"])

    table = cut_lineage(rows.select("at", "y", "text").mapInArrow(features, "at long, y int, x binary"))

    def witnesses(of: DataFrame, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the sentence with the highest score, and its label."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every = [np.frombuffer(x, np.float32).reshape(-1, m) for x in b.column(2).to_pylist()]
                best = [x[int((x @ weight).argmax())].tobytes() for x in every]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.binary())], ["at", "y", "x"])
        got = of.mapInArrow(run, "at long, y int, x binary").orderBy("at", "x").toArrow()
        return np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, m).astype(float), got["y"].to_numpy()

    of_fits = table.where(~held)
    kernel = landmarks.features(landmarks.strings).astype(float)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    whiten = vector * (1 / np.sqrt(np.maximum(value, fit.floor))) @ vector.T
    clean: list[np.ndarray] = []
    bias = np.nan
    for _ in range(fit.rounds):
        x, y = witnesses(of_fits, alpha)
        clean.append(x[y == 0])
        negative = np.unique(np.vstack(clean), axis=0)
        positive = x[y == 1]
        near = positive @ alpha + bias >= fit.lost          # none in the first round
        positive = positive[near] if near.any() else positive
        z, label_of = np.vstack([positive, negative]), np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w = svm(z @ whiten, label_of, np.where(label_of > 0, 1 / len(positive), 1 / max(len(negative), 1)) * len(label_of) / 2, fit.cost)
        alpha, bias = whiten @ w[:-1], float(w[-1])
    x, y = witnesses(table.where(held), alpha)
    margin = x @ alpha + bias
    if len(set(y.tolist())) < 2:
        floor, slope, shift = 0.0, 2.0, 0.0
    else:
        share = {1: prior / max(y.mean(), 1e-9), 0: (1 - prior) / max(1 - y.mean(), 1e-9)}
        floor, slope, shift = _calibrated(margin, y.astype(float), np.where(y == 1, share[1], share[0]))
    return Model(landmarks, alpha, bias, floor, slope, shift, prior)


_HELD: dict[int, Model] = {}


def _held_model(shared) -> Model:
    """The broadcast model; a reused worker keeps its words' shares from task to task."""
    if id(shared.value) not in _HELD:
        _HELD.clear()
        _HELD[id(shared.value)] = shared.value
    return _HELD[id(shared.value)]


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], may_learn: Column | None = None, threshold: float = 0.7, fit: Fit = Fit(),
             doc_id: str = "doc_id", label: str = "toxic", text: str = "text") -> DataFrame:
    """``columns`` of every row, ``score`` (0 to 1, of toxicity) and ``predicted`` (1 from ``threshold`` on, else 0).

    ``may_learn`` is a condition on the rows of ``labels``; all may be learnt from
    without one. Only the text enters a score. A null text is empty; an empty text
    has no words and scores as a sentence of none. With fewer than four labels of
    either class the share of toxic labels (0 without labels) is every score.
    Whole texts are read, in sentences of ``SENTENCE_WORDS`` words at most. Equal
    texts score alike, repeated rows each give a row, an empty table gives an
    empty result; ``columns`` pass through and may not be named like the results.
    """
    model = train(docs, labels, F.lit(True) if may_learn is None else may_learn, fit, doc_id, label, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # landmarks and a table of their triples, some MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held_model(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                p = held.score(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                                 [*b.schema.names[:-1], "score", "predicted"])

    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_text").schema)
    return rows.mapInArrow(run, fields + "score double, predicted int")
