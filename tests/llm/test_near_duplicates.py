"""N-gram Jaccard join and order MinHash: odd rows, brute force and planted cases."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ticketlens.llm import ngram_join, order_minhash
from ticketlens.llm.queries import op4_order_minhash

from .conftest import ROWS, SF


def shingles(text: str, width: int = 4) -> frozenset:
    words = text.encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, num=85, den=100):
    """doc_id -> (set size, smallest id reachable)."""
    sets = [(i, shingles(t or "")) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, s), g in zip(sets, group, strict=True):
        ids = [j for (j, _), h in zip(sets, group, strict=True) if h == g and j is not None]
        out.append((i, len(s), min(ids) if ids and s else i))
    return sorted(out, key=repr)


def found(docs, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, **kw).collect()), key=repr)


def test_join_odd_rows(odd):
    assert found(odd) == brute([(i, t) for i, t, *_ in ROWS])


def test_join_empty_table(odd):
    assert found(odd.limit(0)) == []


def varied(seed: int, groups: int, copies: int, words: int, edits: int) -> list[tuple[int, str]]:
    """Groups of near copies with a shared passage, and chains of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = text
            rows.append((len(rows), " ".join(text + passage if rng.random() < 0.2 else text)))
    return rows


@pytest.mark.parametrize("seed,groups,copies,words,edits", [(1, 60, 4, 300, 4), (2, 3, 60, 120, 3), (3, 150, 2, 14, 1)])
def test_join_against_brute_force(spark, monkeypatch, seed, groups, copies, words, edits):
    rows = varied(seed, groups, copies, words, edits)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 10**9))
def test_every_link_shares_a_key(size, change, seed):
    """The allocation's guarantee: any linked pair shares a key under which the larger set asks."""
    rng = np.random.default_rng(seed)
    limit = ngram_join.Threshold(85, 100)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    keep = a[rng.permutation(len(a))[:max(1, len(a) - change // 2)]]
    b = np.unique(np.r_[keep, rng.integers(0, 1 << 63, change - change // 2, dtype=np.uint64)])
    if not limit.linked(a, b):
        return
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    (ka, asks), (kb, _) = limit.rows(a), limit.rows(b)
    assert set(ka[asks].tolist()) & set(kb.tolist())


def five_word_brute(rows):
    """Group number of each row by links of 0.8 on five-word shingles; a text without words is alone."""
    sets = [shingles(t or "", 5) for _, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def test_pipeline_stage_links_from_080_on_five_words(spark):
    """A copy with a fifth appended (0.833), one cut by 18 percent, and varied groups, against 5/0.8 brute force."""
    rng = random.Random(11)
    words = [f"v{rng.randrange(10**6)}" for _ in range(1000)]
    rows = [(0, " ".join(words)), (1, " ".join(words + [f"x{i}" for i in range(200)])), (2, " ".join(words[:820]))]
    rows += [(10 + i, t) for i, t in varied(6, 40, 4, 120, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()}
    group = five_word_brute(rows)
    assert got == {min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    assert not {1, 2} & got


def test_pipeline_stage_decides_by_row(spark):
    """Null ids, one id over two texts, and repeated rows: one row of each component stays, and each unlinked row."""
    rng = random.Random(12)
    a, b, c, d, e, f = (" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c + " end"), (5, d), (6, d), (6, e), (7, f), (7, f),
            (None, None), (None, ""), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    want = [(1, a), (None, b), (5, d), (6, e), (7, f), (None, None), (None, ""), (8, ""), (8, "")]
    ends = [x for x in got if x in ((None, c), (None, c + " end"))]
    assert len(ends) == 1
    assert sorted(got, key=repr) == sorted(want + ends, key=repr)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in (100, 200, 300)} == {100}
    assert {got[2000 + i] for i in range(50)} == {1000}


def test_components_end_with_stars(spark, monkeypatch):
    """Links that are stars after one round need no second one, and further links are joined over components alone."""
    cuts, cut = [], ngram_join.cut_lineage
    monkeypatch.setattr(ngram_join, "cut_lineage", lambda d: cuts.append(1) or cut(d))
    label = ngram_join.components(spark.createDataFrame([(2, 1), (3, 2), (11, 10), (21, 20)], "a long, b long"))
    assert {(r.node, r.component) for r in label.collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (20, 20), (21, 20)}
    assert len(cuts) == 3
    more = spark.createDataFrame([(3, 11), (11, 10), (40, 21), (51, 50), (0, 52), (52, 51)], "a long, b long")
    got = {r.node: r.component for r in ngram_join.joined_further(label, more).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 10, 11), 1), **dict.fromkeys((20, 21, 40), 20), **dict.fromkeys((0, 50, 51, 52), 0)}
    same = ngram_join.joined_further(label, more.limit(0)).collect()
    assert {tuple(r) for r in same} == {tuple(r) for r in label.collect()} and len(same) == 7


def kmers(text: str) -> list:
    k = order_minhash.K
    return [text[i:i + k] for i in range(max(1, len(text) - k + 1))] if text else []


def test_occurrence_numbers():
    text = "abcabcabcabcabcabcabcabc" * 5 + "xyz"
    h = order_minhash.kmer_hashes(text)
    seen, want = {}, []
    for x in kmers(text):
        want.append(seen.get(x, 0))
        seen[x] = want[-1] + 1
    assert order_minhash.occurrences(h).tolist() == want
    assert len(set(h.tolist())) == len(seen)


def test_sketch_selects_the_smallest_of_every_bin():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    h = order_minhash.kmer_hashes(text)
    rank = order_minhash._mix(h + order_minhash._mix(order_minhash.occurrences(h) + np.uint64(order_minhash._BASE)))
    want = np.zeros(order_minhash.BINS, np.uint16)
    for b in range(order_minhash.BINS):
        own = [i for i in range(len(h)) if int(rank[i]) >> 58 == b]
        made = 0
        for n, i in enumerate(sorted(sorted(own, key=lambda i: int(rank[i]))[:order_minhash.ORDER])):
            made = int(order_minhash._mix(np.array([(made * order_minhash._BASE + int(h[i]) + n + 1) % (1 << 64)], np.uint64))[0])
        want[b] = made % 65535 + 1
    assert order_minhash.sketch(text).tolist() == want.tolist()


def test_likeness_follows_edits_and_order():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(800)]
    text = " ".join(words)
    own = order_minhash.sketch(text)
    assert order_minhash.likeness(own, order_minhash.sketch(text)) == 1.0
    few, many = list(words), list(words)
    for i in range(0, 800, 80):
        few[i] = "changed"
    for i in range(0, 800, 4):
        many[i] = "changed"
    moved = " ".join(words[400:] + words[:400])
    near = [order_minhash.likeness(own, order_minhash.sketch(t)) for t in (" ".join(few), " ".join(many))]
    assert near[0] > 0.6 > 0.2 > near[1]
    assert 0.1 < order_minhash.likeness(own, order_minhash.sketch(moved)) < 0.9


def neighbours(rows):
    """The contract by hand: (id, text, next text) by falling id, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)]


def check_neighbours(got, rows):
    want = sorted(((i, t[:len(t) - len(t) // 3] + after[:len(t) // 3], order_minhash.as_string(order_minhash.sketch(t)))
                   for i, t, after in neighbours(rows)), key=repr)
    assert sorted(((r.doc_id, r.edited_text, r.fingerprint) for r in got), key=repr) == want


@pytest.mark.parametrize("span", [1 << 30, 1])
def test_edited_neighbours_odd_rows(odd, monkeypatch, span):
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", span)
    monkeypatch.setattr(order_minhash, "MAX_RANGES", 6)
    got = order_minhash.edited_neighbours(odd, ["doc_id", "class"]).collect()
    check_neighbours(got, [(i, t or "") for i, t, *_ in ROWS])
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_edited_neighbours_one_and_no_row(odd):
    got = order_minhash.edited_neighbours(odd.where("doc_id = 1"), ["doc_id"]).collect()
    check_neighbours(got, [(1, ROWS[0][1])])
    assert order_minhash.edited_neighbours(odd.limit(0), ["doc_id"]).collect() == []


def test_order_minhash_query(spark, duck_small):
    rows = duck_small.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    after = {i: (t, x) for i, t, x in neighbours(rows)}
    for r in op4_order_minhash(spark, SF).collect():
        t, x = after[r.doc_id]
        edited = order_minhash.edited(t, x)
        a, b, c = (order_minhash.sketch(y) for y in (t, edited, x))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (order_minhash.as_string(a), order_minhash.as_string(b))
        assert (r.near_edited, r.near_next) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))
