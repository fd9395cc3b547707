"""Line dedup and byte-level BPE: odd rows and brute force."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import byte_bpe, line_dedup
from ticketlens.llm.mph import MinimalPerfectHash
from ticketlens.llm.queries import BPE_FILE, op6_byte_bpe

from .conftest import ROWS, SF

RANKS = byte_bpe.read_ranks(public_tokenizers.path(BPE_FILE))
CODER = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def kept_lines(texts: list[str], least: int) -> list[tuple[int, int, str]]:
    count = Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for t in texts:
        lines = t.split("\n")
        left = [x for x in lines if count[key(x)] < least]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("least", [2, 10, 100])
def test_line_dedup_odd_rows(odd, least):
    got = line_dedup.drop_repeated_lines(odd, ["doc_id", "key"], min_docs=least).collect()
    want = [(r[0], *x) for r, x in zip(ROWS, kept_lines([r[1] or "" for r in ROWS], least), strict=True)]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == sorted(want, key=repr)


def test_line_dedup_probes_each_distinct_text_once(spark, monkeypatch):
    """A text of very many copies does not make one pandas group of all their probes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "COPY_PROBES", 20)
    texts = ["common\nhot line"] * 200 + [f"common\nown {i}" for i in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.md5("text").alias("text_md5"), "text").repartition(4)
    hashes = rows.mapInArrow(line_dedup._hash_lines, "text_md5 string, h1 array<long>, h2 array<long>")
    probes = line_dedup.line_probes(hashes, line_dedup.line_index(hashes, 1), 1)
    assert probes.count() == 2 * 101
    assert probes.groupBy("shard", "copy").count().agg(F.max("count")).first()[0] <= 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.drop_repeated_lines(docs, ["doc_id"]).collect()}
    assert got == {i: "" if i < 200 else f"own {i - 200}" for i in range(300)}


def test_line_dedup_copies_of_a_hot_shard(spark, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 8)
    monkeypatch.setattr(line_dedup, "COPY_PROBES", 4)
    got = line_dedup.drop_repeated_lines(odd, ["doc_id"], min_docs=3).collect()
    want = [x[2] for x in kept_lines([r[1] or "" for r in ROWS], 3)]
    assert sorted(r.kept_text for r in got) == sorted(want)


def test_line_dedup_empty_table(odd):
    assert line_dedup.drop_repeated_lines(odd.limit(0), ["doc_id"]).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        index = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(*h).to_bytes())
        assert sorted(index.slots(*h).tolist()) == list(range(n))
        assert [index.slot(int(a), int(b)) for a, b in h.T] == index.slots(*h).tolist()
    same = np.zeros(2, np.uint64)
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(same, same)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é1'strevlmd!?\n\t \x1c\x85 日本😀ÀßZ"), max_size=60))
def test_bpe_equals_tiktoken(text):
    ids = CODER.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TRUTH.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


def test_bpe_own_pattern():
    own = byte_bpe.ByteBPE(RANKS, r"\S+|\s")
    truth = tiktoken.Encoding("own2", pat_str=r"\S+|\s", mergeable_ranks=RANKS, special_tokens={})
    text = "don't stop  now " + "x" * 3000
    assert np.frombuffer(own.encode(text), "<u4").tolist() == truth.encode_ordinary(text)


def test_bpe_odd_rows(spark, odd):
    shared = byte_bpe.load(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    got = byte_bpe.encode_decode(odd, ["doc_id", "class"], shared, outputs=("ids", "ids_le", "decoded")).collect()
    want = sorted(((i, (t or "").encode()) for i, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=repr) == want
    for r in got:
        assert r.ids == TRUTH.encode_ordinary(bytes(r.decoded).decode()) == np.frombuffer(r.ids_le, "<u4").tolist()
        assert r.n_tokens == len(r.ids)
    assert byte_bpe.encode_decode(odd.limit(0), ["doc_id"], shared).collect() == []


def test_bpe_query(spark, duck_small):
    got = {r.doc_id: r for r in op6_byte_bpe(spark, SF).collect()}
    for i, t in duck_small.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = np.array(TRUTH.encode_ordinary(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_rank_file_round_trip(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ((b"a", 0), (b"b", 1), (b"ab", 2))))
    assert byte_bpe.ByteBPE(byte_bpe.read_ranks(str(path)), r"\S+").merge(b"abab") == [2, 2]
