"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

The fit uses a bounded sample of labelled documents, whose size is a parameter,
and all unlabelled ones, whose features are written once. In every round each
view is fitted on its own training rows and scores all unlabelled rows in Spark;
a share of the corpus, those it is most confident of, become pseudo-labelled
training rows of the other view. Which rows are taught is a rule (a bin of the
confidence and, inside that bin, a bound on the row's hash), so no state is kept
by row. The text view is fitted by Newton steps on sums of gradient and Hessian
that each partition gives, the metadata view on the row counts of its possible
feature rows, of which there are SOURCES x LANGS x SIZES. A view that knows nothing is
never confident and so teaches nothing. Both views are then calibrated on
labelled rows that neither was fitted on, and their calibrated log-odds are
added (less the prior's, which both hold) to score every document.

The labelled sample is chosen on ids alone, and one row of each id counts (the
smallest hash); only these rows' features, and sums, come to the driver. Scoring is one pass over the table without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import cut_lineage
from ticketlens.sources.tables import small_side

from .workers import tidy

#: Buckets for words, sources and languages; bins of the logarithm of the length.
WORDS, SOURCES, LANGS, SIZES = 128, 64, 16, 24
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "'\"()-", "#$%&*@^~_=+<>", "|/\\[]{}`", " ", "\n\t\r")


@dataclass(frozen=True)
class Fit:
    """Bound of the labelled sample and settings of the rounds."""

    labelled: int = 20_000
    rounds: int = 4
    taught: float = 0.05      # share of the unlabelled rows that a view may teach in a round
    confident: float = 0.95   # least probability of a pseudo-label
    penalty: float = 1.0


def _kind_table() -> np.ndarray:
    table = np.zeros((256, len(_KINDS) + 1))
    table[:, -1] = 1.0
    for i, chars in enumerate(_KINDS):
        for c in chars:
            table[ord(c)] = np.eye(len(_KINDS) + 1)[i]
    return table


_KIND = _kind_table()
N_TEXT = len(_KINDS) + 1 + 6 + WORDS
N_META = SOURCES + LANGS + SIZES + 1


def text_features(text: str) -> np.ndarray:
    """Shares of character kinds, repetition, word and line shape, and hashed distinct words."""
    raw = text.encode()
    out = np.zeros(N_TEXT, np.float32)
    words = raw.split()
    if not words:
        return out
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = _KIND.shape[1]
    out[:k] = chars @ _KIND / len(raw)
    distinct = set(words)
    lines = raw.split(b"\n")
    n = len(words)
    out[k:k + 6] = (sum(map(eq, words, words[1:])) / n, len(distinct) / n, min(len(raw) / n, 40.0) / 10, np.log1p(n) / 5,
                    len(set(lines)) / len(lines), min(n / len(lines), 100.0) / 50)
    hashed = np.bincount(np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)) % WORDS, minlength=WORDS)
    out[k + 6:] = hashed / np.sqrt(np.square(hashed).sum())
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Source and language by bucket, and the stated length; nulls have buckets of their own."""
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32(f"s{source}".encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS] = 1
    size = 0 if n_chars is None else min(max(int(n_chars), 0).bit_length() + 1, SIZES - 1)
    out[SOURCES + LANGS + size] = 1
    out[-1] = size / SIZES
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """L2-penalised logistic regression on standardised features, fitted by Newton steps.

    ``weight`` counts equal rows. ``more`` gives sums over rows that are not
    here: of their number, values and squared values around a centre, and of
    gradient and Hessian at given weights.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float, weight: np.ndarray | None = None, more: TaughtRows | None = None):
        weight = np.ones(len(x)) if weight is None else weight
        centre = np.average(x, axis=0, weights=weight)
        moments = _moments(x - centre, weight) + (more.moments(centre) if more else 0)
        n, total, squares = moments[0], *np.split(moments[1:], 2)
        self.mean = centre + total / n
        spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
        self.scale = np.where(spread > 1e-6, spread, 1.0)
        self.w = np.zeros(x.shape[1] + 1)
        ridge = np.full(len(self.w), penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            gradient, hessian = _unpacked(self.newton_sums(x, y, weight) + (more.newton_sums(self) if more else 0), len(self.w))
            step = np.linalg.solve(hessian + np.diag(ridge), gradient - ridge * self.w)
            self.w += step
            if np.abs(step).max() < (1e-4 if more else 1e-6):
                break

    def newton_sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and the Hessian's upper triangle over the rows, without the penalty."""
        z = self._design(x)
        p = _sigmoid(z @ self.w)
        hessian = (z * ((p * (1 - p) + 1e-9) * weight)[:, None]).T @ z
        return np.concatenate([z.T @ ((y - p) * weight), hessian[np.triu_indices(len(self.w))]])

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


def _moments(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.concatenate([[weight.sum()], weight @ x, weight @ np.square(x)])


def _unpacked(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    hessian = np.zeros((k, k))
    hessian[np.triu_indices(k)] = sums[k:]
    return sums[:k], hessian + np.triu(hessian, 1).T


class Calibrated:
    """A view with its log-odds mapped to probabilities on held-out rows."""

    def __init__(self, view: Logistic, x: np.ndarray, y: np.ndarray):
        self.view, self.map = view, Logistic(view.logit(x)[:, None], y, 1.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.map.logit(self.view.logit(x)[:, None])


@dataclass
class CoTrained:
    """Two calibrated views; without both classes among the labels there are none, and the prior alone scores."""

    text: Calibrated | None
    meta: Calibrated | None
    prior: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            return tuple(np.full(len(xt), self.prior) for _ in range(3))
        a, b = self.text.logit(xt), self.meta.logit(xm)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - np.log(self.prior / (1 - self.prior)))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, fit: Fit) -> CoTrained:
    """Fit in memory on labelled rows (text and metadata features, labels) and a pool of unlabelled ones."""
    prior = float(y.mean()) if len(y) else 1.0
    held = np.arange(len(y)) % 4 == 3        # rows come in hash order; these calibrate
    if any(len(set(y[part].tolist())) < 2 for part in (held, ~held)):
        return CoTrained(None, None, prior)
    pools, sets = (ut, um), ([(xt[~held], y[~held])], [(xm[~held], y[~held])])
    free = [np.ones(len(ut), bool), np.ones(len(ut), bool)]       # rows each view has not been taught
    tested = (xt[held], xm[held])

    def views() -> list[Calibrated]:
        return [Calibrated(Logistic(np.vstack([a for a, _ in s]), np.concatenate([b for _, b in s]), fit.penalty), t, y[held])
                for s, t in zip(sets, tested, strict=True)]

    for _ in range(fit.rounds):
        both = views()
        for teacher, pupil in ((0, 1), (1, 0)):
            p = _sigmoid(both[teacher].logit(pools[teacher])) if len(pools[teacher]) else np.zeros(0)
            for label, sure, share in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):
                may = np.flatnonzero(free[pupil] & (sure >= fit.confident))
                best = may[np.argsort(-sure[may], kind="stable")][:max(1, int(fit.taught * share * len(p)))]
                if len(best):
                    sets[pupil].append((pools[pupil][best], np.full(len(best), label)))
                    free[pupil][best] = False
    return CoTrained(*views(), prior)


#: Bins of the confidence from ``Fit.confident`` up, and possible feature rows of the metadata view.
BINS, CODES = 4096, SOURCES * LANGS * SIZES
_LEAST = -(1 << 63)


def code_features() -> np.ndarray:
    """The metadata view's features by code (see :func:`_codes`)."""
    out, code = np.zeros((CODES, N_META), np.float32), np.arange(CODES)
    for at, bucket in ((0, code // (LANGS * SIZES)), (SOURCES, code // SIZES % LANGS), (SOURCES + LANGS, code % SIZES)):
        out[code, at + bucket] = 1
    out[:, -1] = code % SIZES / SIZES
    return out


def _codes(xm: np.ndarray) -> np.ndarray:
    source, lang, size = (xm[:, a:b].argmax(axis=1) for a, b in ((0, SOURCES), (SOURCES, SOURCES + LANGS), (SOURCES + LANGS, N_META - 1)))
    return (source * LANGS + lang) * SIZES + size


def _bins(logit: np.ndarray, label: float, confident: float) -> np.ndarray:
    """Bin of the confidence in ``label``, -1 below ``confident``."""
    low = np.log(confident / (1 - confident))
    sure = np.clip(logit if label else -logit, -40, 40)
    return np.where(sure >= low, np.minimum((sure - low) / (40 - low) * BINS, BINS - 1), -1).astype(np.int64)


@dataclass
class Rule:
    """What a teacher taught of one label in a round: rows above a bin, and rows in it whose hash is below a bound."""

    teacher: Calibrated | np.ndarray        # the text view, or the metadata view's log-odds by code
    label: float
    bin: int
    below: int

    @staticmethod
    def of(teacher: Calibrated | np.ndarray, label: float, counts: np.ndarray, wanted: int) -> Rule:
        """The rule that takes ``wanted`` rows (all, if there are fewer) from the surest down, as the rows' hashes are even."""
        over = np.cumsum(counts[::-1])[::-1]
        at = int(np.flatnonzero(over >= wanted)[-1]) if over[0] > wanted else -1
        part = 1.0 if at < 0 else (wanted - (over[at] - counts[at])) / counts[at]
        return Rule(teacher, label, at, _LEAST + int(part * (1 << 64))) if part < 1 else Rule(teacher, label, at - 1 if at > 0 else -1, _LEAST)


def _taught(rules: list[Rule], at: np.ndarray, code: np.ndarray, x: np.ndarray, confident: float) -> np.ndarray:
    """The label that the rules, in their order, have taught of each row; nan where none has."""
    out, logits = np.full(len(at), np.nan), {}
    for r in rules:
        if id(r.teacher) not in logits:
            logits[id(r.teacher)] = r.teacher[code] if isinstance(r.teacher, np.ndarray) else r.teacher.logit(x)
        b = _bins(logits[id(r.teacher)], r.label, confident)
        out[np.isnan(out) & ((b > r.bin) | ((b == r.bin) & (b >= 0) & (at < r.below)))] = r.label
    return out


class TaughtRows:
    """All unlabelled rows ``at, code, x`` (hash, metadata code, text features), and sums over them by partition."""

    def __init__(self, table: DataFrame, confident: float):
        self.table, self.confident = table, confident
        self.to_text: list[Rule] = []       # by the metadata view
        self.to_meta: list[Rule] = []       # by the text view

    def sums(self, size: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                for start in range(0, b.num_rows, 4096):
                    at, code, x = b.slice(start, 4096).columns
                    total += of(at.to_numpy(), code.to_numpy(), np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, N_TEXT))
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["i", "v"])

        got = self.table.mapInArrow(tidy(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got["i"].to_numpy()] = got["v"].to_numpy()
        return out

    def confidence(self, text: Calibrated, by_code: np.ndarray) -> np.ndarray:
        """Rows not yet taught by bin: [text view, metadata view] x [label 0, label 1] x bin."""
        to_text, to_meta, confident = self.to_text, self.to_meta, self.confident

        def of(at, code, x):
            out = np.zeros((2, 2, BINS))
            for t, (rules, logit) in enumerate(((to_meta, text.logit(x)), (to_text, by_code[code]))):
                free = np.isnan(_taught(rules, at, code, x, confident))
                for label in (0, 1):
                    b = _bins(logit, label, confident)
                    out[t, label] = np.bincount(b[free & (b >= 0)], minlength=BINS)
            return out.ravel()
        return self.sums(4 * BINS, of).reshape(2, 2, BINS)

    def codes(self) -> np.ndarray:
        """Rows taught to the metadata view: [label 0, label 1] x code."""
        rules, confident = self.to_meta, self.confident

        def of(at, code, x):
            label = _taught(rules, at, code, x, confident)
            return np.concatenate([np.bincount(code[label == v], minlength=CODES) for v in (0, 1)])
        return self.sums(2 * CODES, of).reshape(2, CODES)

    def moments(self, centre: np.ndarray) -> np.ndarray:
        rules, confident = self.to_text, self.confident

        def of(at, code, x):
            x = x[~np.isnan(_taught(rules, at, code, x, confident))]
            return _moments(x - centre, np.ones(len(x)))
        return self.sums(1 + 2 * N_TEXT, of)

    def newton_sums(self, view: Logistic) -> np.ndarray:
        rules, confident = self.to_text, self.confident

        def of(at, code, x):
            label = _taught(rules, at, code, x, confident)
            own = ~np.isnan(label)
            return view.newton_sums(x[own], label[own], np.ones(int(own.sum())))
        k = N_TEXT + 1
        return self.sums(k + k * (k + 1) // 2, of)


def co_train_all(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, rows: Callable[[], DataFrame], fit: Fit) -> CoTrained:
    """Fit on labelled rows and all unlabelled rows, as :func:`co_train` does in memory; ``rows`` are made if there is something to teach."""
    prior = float(y.mean()) if len(y) else 1.0
    held = np.arange(len(y)) % 4 == 3        # rows come in hash order; these calibrate
    if any(len(set(y[part].tolist())) < 2 for part in (held, ~held)):
        return CoTrained(None, None, prior)
    table, every = rows(), code_features()
    free, n = TaughtRows(table, fit.confident), table.count()

    def calibrated(text: Logistic, meta: Logistic) -> tuple[Calibrated, Calibrated]:
        return Calibrated(text, xt[held], y[held]), Calibrated(meta, xm[held], y[held])

    text, meta = Logistic(xt[~held], y[~held], fit.penalty), Logistic(xm[~held], y[~held], fit.penalty)
    for _ in range(fit.rounds if n else 0):
        by_text, by_meta = calibrated(text, meta)
        by_code = by_meta.logit(every)
        counts = free.confidence(by_text, by_code)
        for label, share in ((1, prior), (0, 1 - prior)):
            wanted = max(1, int(fit.taught * share * n))
            free.to_meta.append(Rule.of(by_text, float(label), counts[0, label], wanted))
            free.to_text.append(Rule.of(by_code, float(label), counts[1, label], wanted))
        bad, good = free.codes()
        own = np.flatnonzero(bad + good)
        meta = Logistic(np.vstack([xm[~held], every[own], every[own]]), np.concatenate([y[~held], np.zeros(len(own)), np.ones(len(own))]), fit.penalty,
                        np.concatenate([np.ones(int((~held).sum())), bad[own], good[own]]))
        text = Logistic(xt[~held], y[~held], fit.penalty, more=free)
    return CoTrained(*calibrated(text, meta), prior)


def _features(b: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    return _features_of(*(b.column(text + i).to_pylist() for i in range(4)))


def _features_of(texts: list[str], source: list, lang: list, size: list) -> tuple[np.ndarray, np.ndarray]:
    xt = np.array([text_features(x) for x in texts], np.float32).reshape(len(texts), N_TEXT)
    xm = np.array([meta_features(*x) for x in zip(source, lang, size, strict=True)], np.float32).reshape(len(texts), N_META)
    return xt, xm


def _inputs(text: str, source: str, lang: str, n_chars: str) -> list:
    return [F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(source).cast("string").alias("_source"),
            F.col(lang).cast("string").alias("_lang"), F.col(n_chars).cast("long").alias("_size")]


def train(docs: DataFrame, labels: DataFrame, fit: Fit, doc_id: str = "doc_id", label: str = "quality", text: str = "text",
          source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> CoTrained:
    """Fit the two views. Null labels do not count; of repeated ids the mean label does, above a half as 1."""
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
             .agg((F.avg(label) > 0.5).cast("double").alias("_y")))
    ids = (docs.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").distinct().join(known, "_id")
           .withColumn("_at", F.xxhash64("_id", F.lit("sample"))))
    sample = ids.orderBy("_at", "_id").limit(fit.labelled).collect()
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sample, ids.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.hstack(_features(b, 3))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], flat], ["_id", "_y", "_at", "x"])

    kind = ids.schema["_id"].dataType.simpleString()
    # one row an id, however many rows it is on, so the sample's bound holds for what is fetched
    rows = (docs.select(F.col(doc_id).alias("_doc"), *_inputs(text, source, lang, n_chars))
            .join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).select("_id", "_y", "_at", "_text", "_source", "_lang", "_size")
            .mapInArrow(tidy(run), f"_id {kind}, _y double, _at long, x array<float>"))
    got = rows.groupBy("_id", "_y", "_at").agg(F.min_by("x", F.xxhash64("x")).alias("x")).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_TEXT + N_META) if got.num_rows else np.zeros((0, N_TEXT + N_META), np.float32)
    y, at = got["_y"].to_numpy(), got["_at"].to_numpy()
    order = np.lexsort([x.sum(axis=1), at])
    x, y = x[order], y[order].astype(float)

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                xt, xm = _features(b, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_codes(xm), pa.int32()), pa.array([r.tobytes() for r in xt], pa.binary())],
                                                 ["_doc", "at", "code", "x"])

    def unlabelled() -> DataFrame:
        told = known.select("_id")
        return cut_lineage(docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(F.col(doc_id), F.col(text), F.lit("sample")).alias("at"),
                                       *_inputs(text, source, lang, n_chars))
                           .mapInArrow(tidy(code_rows), f"_doc {kind}, at long, code int, x binary")
                           .join(small_side(told), F.col("_doc") == F.col("_id"), "left_anti").select("at", "code", "x"))

    return co_train_all(x[:, :N_TEXT], x[:, N_TEXT:], y, unlabelled, fit)


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], fit: Fit = Fit(), doc_id: str = "doc_id", label: str = "quality",
             text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """``columns`` of every row, ``p_text``, ``p_meta``, ``score`` (probabilities of good quality) and ``keep`` (score >= 0.5).

    A null text is empty: all its content features are 0. Null source, language
    or length has a bucket of its own. Where the labels do not hold both classes
    every score is the share of good labels, 1 without labels, and all rows are
    kept. Repeated rows each give a row; an empty table gives an empty result.
    ``columns`` pass through and may not be named like the results.
    """
    model = train(docs, labels, fit, doc_id, label, text, source, lang, n_chars)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # some thousand numbers
    trained = model.text is not None
    # a text that passes through is not sent to the workers a second time
    at_text = columns.index(text) if text in columns else len(columns)
    inputs = _inputs(text, source, lang, n_chars)[at_text < len(columns):]
    more = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                p = shared.value.score(*_features_of([t or "" for t in b.column(at_text).to_pylist()], *(c.to_pylist() for c in b.columns[-3:])))
                keep = p[2] >= 0.5 if trained else np.ones(b.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*b.columns[:-more], *(pa.array(x, pa.float64()) for x in p), pa.array(keep, pa.bool_())],
                                                 [*b.schema.names[:-more], "p_text", "p_meta", "score", "keep"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    return docs.select(*columns, *inputs).mapInArrow(tidy(run), fields + "p_text double, p_meta double, score double, keep boolean")
