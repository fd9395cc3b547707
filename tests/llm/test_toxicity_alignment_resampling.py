"""op11 (held-out accuracy, disguised words), op12 and op13 (brute force), each on odd rows too."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import importance, token_align, toxicity
from ticketlens.llm.queries import ALIGN_FILES, QUERIES

from .conftest import SF

INSULTS = ["idiot", "moron", "trash", "clown"]
CALM = "the river runs slowly past old mills while people carry bread and water to small houses near hills".split()


# ---- op11 ---------------------------------------------------------------------------

def _talk(i: int, toxic: bool) -> str:
    rng = np.random.default_rng(i)
    lines = [[CALM[j] for j in rng.integers(0, len(CALM), 9)] for _ in range(5)]
    if toxic:
        lines[int(rng.integers(0, 5))][4] = INSULTS[i // 4 % len(INSULTS)]
    return ". ".join(" ".join(x) for x in lines) + "."


@pytest.fixture(scope="module")
def tox_model(spark):
    docs = spark.createDataFrame([(i, _talk(i, i % 4 == 0)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    return toxicity.train(docs, labels, F.lit(True))


def test_plain_and_disguised_insults(tox_model):
    toxic = tox_model.score([_talk(i, True) for i in range(1000, 1100)])
    clean = tox_model.score([_talk(i, False) for i in range(2000, 2100)])
    assert (toxic >= 0.7).all() and (clean < 0.7).all()
    hidden = ["people carry the idxiot to old mills", "you m.o.r.o.n near the river", "slowly t r a s h and water", "a cloown in small houses", "IDIOT!"]
    assert (tox_model.score(hidden) >= 0.7).all()
    assert (tox_model.score(["", "...", "old mills"]) < 0.7).all()


def test_kernel_against_plain_sums():
    """Normalised gapped triples of two words, counted one by one."""
    def triples(w):
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    if k - i <= toxicity.REACH:
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "ixdiot", "i", "", "trash", "thrashing", "ééclat", "a" * 60, "idioot"]
    marks = toxicity.Landmarks(["idiot", "trash", "éclat"], 1)
    got = marks.likeness(words)
    for w, row in zip(words, got, strict=True):
        for m, k in zip(marks.strings, row, strict=True):
            if len(w) <= toxicity.WORD_CHARS:
                a, b = triples(w), triples(m)
                norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                assert k == pytest.approx(sum(a[t] * b[t] for t in a) / norm if norm else 0.0, abs=1e-5)


def test_spelled_and_marked_words():
    assert toxicity.sentences("You I D I O T! a.b c,long-word\n\n? x") == [["you", "idiot"], ["ab", "clongword", "long", "word"], ["x"]]
    assert [len(s) for s in toxicity.sentences("ww " * 150)] == [64, 64, 22]


def test_toxicity_query_learns_only_from_allowed_labels(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_toxicity"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_held_out_accuracy(spark):
    """On a larger table: the English insults of held-out documents are found, clean documents left alone."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, sf).where("held_out")
    known = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    insult = F.lower("text").rlike(r"\b(idiot|moron|scum|stupid|pathetic|clown|loser|worthless|disgusting|trash)\b")
    rows = got.join(known, "doc_id").select("predicted", "toxic", insult.alias("plain")).toPandas()
    assert rows[(rows.toxic == 1) & rows.plain].predicted.mean() > 0.8
    assert rows[(rows.toxic == 0) & ~rows.plain].predicted.mean() < 0.02


def test_toxicity_odd_rows(spark, odd, texts):
    labels = spark.createDataFrame([(1, 0), (2, None), (7, 1), (None, 1)], "doc_id long, toxic int")
    few = toxicity.classify(odd, labels, odd.columns)
    assert few.count() == odd.count() and few.select("score").distinct().collect()[0][0] == 0.5
    none = toxicity.classify(odd, labels.limit(0), ["doc_id"])
    assert [tuple(r) for r in none.select("score", "predicted").distinct().collect()] == [(0.0, 0)]
    assert toxicity.classify(odd.limit(0), labels, ["doc_id"]).count() == 0
    more = spark.createDataFrame([(100 + i, _talk(i, i % 2 == 0), "en", "s", 1, "x", 1, None) for i in range(80)], odd.schema)
    every = spark.createDataFrame([(100 + i, int(i % 2 == 0)) for i in range(80)] + [(100, 1), (100, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd.union(more), every, ["doc_id", "class", "words", "key"])
    assert got.count() == odd.count() + 80
    same = {r["score"] for r in got.where("doc_id IN (2, 3)").collect()}
    assert len(same) == 1       # null, empty
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


# ---- op12 ---------------------------------------------------------------------------

def _brute_alignment(texts: dict) -> dict:
    """Per id: numbers and the group string, from the reference libraries and nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = map(public_tokenizers.path, ALIGN_FILES)
    coder = Tokenizer.from_file(a_path)
    coder.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    entry = {i: e for e, i in json.load(open(a_path))["model"]["vocab"].items()}
    alphabet = token_align.byte_alphabet()
    made, found = {}, {}
    for i, t in texts.items():
        want = f" {t}".encode() if t else b""
        a = [(x, bytes(alphabet[c] for c in entry[x])) for x in coder.encode(want.decode(), add_special_tokens=False).ids]
        b = []
        for x in pieces.encode(t or ""):
            p = pieces.id_to_piece(x)
            b.append((x, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()))
        if any(b"".join(y for _, y in z) != want for z in (a, b)):
            a, b = [], []
        made[i] = (a, b)
        spans = []
        for z in (a, b):
            at, out = 0, []
            for x, y in z:
                out.append((at, at + len(y), x))
                at += len(y)
            spans.append(out)
        ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, start = [], 0
        for e in sorted(ends):
            groups.append("|".join(",".join(str(x) for s, f, x in z if start <= s and f <= e) for z in spans))
            start = e
        own, low = [], 0
        for s, f, x in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < f:
                own.append((x, spans[1][k][2]))
                k += 1
        found[i] = (len(a), len(b), len(ends), own, ";".join(groups))
    n = Counter(p for *_, own, _ in found.values() for p in own)
    top = defaultdict(int)
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return {i: (x, y, g, len(own), sum(n[p] == top[p[1]] for p in own), sum(n[p] for p in own), s) for i, (x, y, g, own, s) in found.items()}


ODD_TEXTS = ["", None, " ", "  two  blanks ", "▁ a lower one eighth block", "<|endoftext|> is text </s> <s>", "tab\tnul\x00 crlf\r\n", "日本語 テキスト 🙂🙂", "don't I'll WE'VE 1234567",
             "<0x41> piece", "é é ﬁ", "x" * 3000, "a" * 7 + " b"]


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_alignment_against_brute_force(spark, head):
    """With all counts broadcast, with the rarer ones joined, and with all joined."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    texts = {r["doc_id"]: r["text"] for r in rows} | {10_000 + i: t for i, t in enumerate(ODD_TEXTS)}
    want = _brute_alignment(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = token_align.align(docs, ["doc_id"], token_align.load(spark, *map(public_tokenizers.path, ALIGN_FILES)), head=head).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert want[10_004] == (0, 0, 0, 0, 0, 0, "")           # U+2581 does not come back


def test_alignment_query_digests(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = _brute_alignment({r["doc_id"]: r["text"] for r in rows})
    for r in QUERIES["op12_token_alignment"](spark, SF).collect():
        *numbers, groups = want[r["doc_id"]]
        assert tuple(r)[1:] == (*numbers, hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_odd_rows(spark, odd):
    pair = token_align.load(spark, *map(public_tokenizers.path, ALIGN_FILES))
    got = token_align.align(odd, odd.columns, pair)
    rows = got.collect()
    assert len(rows) == odd.count()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add((r["n_a"], r["n_links"], r["count_sum"], r["groups"]))
    assert all(len(x) == 1 for x in by_text.values()) and by_text[""] == {(0, 0, 0, "")}
    assert token_align.align(odd.limit(0), ["doc_id"], pair).count() == 0


def test_every_pair_has_one_entry():
    """Byte tokens of both vocabularies: each byte is an entry of A, and each piece's bytes are known."""
    both = token_align.Tokenizers(*(open(public_tokenizers.path(f), "rb").read() for f in ALIGN_FILES))
    assert {bytes([b]) for b in range(256)} <= set(both.bytes_a.values())
    assert {bytes([b]) for b in range(256)} <= set(both.bytes_b.values())


# ---- op13 ---------------------------------------------------------------------------

def _brute_resampling(docs: list, target: list, share=(10, 100), grams=(1, 1), buckets=10_000, min_words=20, seed=2024) -> list:
    """(id, n_words, n_features, weight, score, rank) of every row, row by row."""
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 0x80 else " " for c in low).split(" ")

    def features(t):
        w = [x for x in words(t) if x]
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]

    made = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (i, text), (n, f) in zip(docs, made, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = len(may) * share[0] // share[1]
    for r in out:
        r.append(None)
    for rank, r in enumerate(may[:k], 1):
        r[5] = rank
    return [tuple(r) for r in out]


@pytest.mark.parametrize(("share", "grams", "min_words"), [((10, 100), (1, 1), 20), ((1, 3), (1, 2), 3), ((1, 1), (2, 3), 0)])
def test_resampling_against_brute_force(spark, share, grams, min_words):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = _brute_resampling(docs, target, share, grams, 500, min_words, 7)
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
                              ["doc_id"], share, grams, 500, min_words, 7).collect()
    assert sorted(map(tuple, got)) == sorted(want) if share == (1, 1) else {tuple(r) for r in got} == set(want)


def test_resampling_odd_rows(spark, odd):
    """Null, empty and repeated rows; copies with equal keys are drawn one by one."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(50, "same words again")] * 30
    docs = odd.unionByName(spark.createDataFrame([(50, "same words again")] * 30, "doc_id long, text string"), allowMissingColumns=True)
    for target in (["shared line only"], [], [None, ""]):
        want = _brute_resampling(rows, target, (1, 2), min_words=1)
        got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), ["doc_id", "class", "words", "key"], (1, 2), min_words=1)
        def key(r):
            return tuple((x is None, x or 0) for x in r)
        assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert importance.resample(docs.limit(0), docs.select("text"), ["doc_id"]).count() == 0
    few = importance.resample(docs, docs.select("text"), ["doc_id"], (1, 1_000_000))
    assert few.count() == len(rows) and few.where("rank IS NOT NULL").count() == 0


@pytest.mark.parametrize("k", [1, 2, 17, 499, 500])
def test_select_kth(spark, k):
    import random

    values = list(range(500))
    random.Random(3).shuffle(values)
    keys = spark.createDataFrame([((v // 7, v),) for v in values], "key struct<a:int,b:int>").repartition(4)
    assert tuple(importance.select_kth(keys, "key", k, pivots=3)) == ((k - 1) // 7, k - 1)
