"""Quality, licences, chat, decontamination, URLs, WARC and the pipeline: odd rows and brute force."""

import hashlib
from html.parser import HTMLParser
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlens.llm import chat, decontaminate, license_scan, quality, url_filter, warc
from ticketlens.llm.queries import URL_RULES
from ticketlens.sources.tables import read_table

from .conftest import LONG, ROWS, SF

# -- quality -------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    half = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, half, ["doc_id"]).toPandas()
    return got, labels.where("doc_id % 2 = 1").toPandas().merge(got, on="doc_id")


def test_quality_on_held_out_labels(judged):
    got, held = judged
    assert len(got) == 1000 and len(held) > 100
    assert ((held.keep) == (held.quality == 1)).mean() >= 0.95
    assert (~held[held.quality == 1].keep).mean() <= 0.02


def test_quality_views_are_calibrated(judged):
    _, held = judged
    for p in (held.p_text, held.p_meta, held.score):
        assert abs(p.mean() - held.quality.mean()) < 0.08


def test_co_training_lets_one_view_teach_the_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    views = [(y * 2 - 1)[:, None] * s + rng.normal(size=(3000, 3)) for s in (2.0, 1.0)]
    few = 60
    fit = quality.Fit(rounds=4, taught=0.1, confident=0.9)
    taught = quality.co_train(views[0][:few], views[1][:few], y[:few], views[0][few:], views[1][few:], fit)
    alone = quality.co_train(views[0][:few], views[1][:few], y[:few], views[0][:0], views[1][:0], fit)
    score = lambda m: ((m.score(views[0][few:], views[1][few:])[2] > 0.5) == y[few:]).mean()
    assert score(taught) >= max(0.97, score(alone) - 0.005)


def test_co_training_in_spark_uses_every_unlabelled_row(spark):
    """30,000 unlabelled rows, some without an id: all are scored, taught by share, and the sums give the same fit as the rows."""
    import pandas as pd

    rng = np.random.default_rng(3)
    n, few = 30_000, 400
    y = rng.integers(0, 2, n + few).astype(float)
    xt = rng.normal(size=(n + few, quality.N_TEXT)).astype(np.float32)
    xt[:, :3] += (y * 2 - 1)[:, None] * 1.5
    code = rng.integers(0, 40, n + few) * 2 + np.where(rng.random(n + few) < 0.97, y, 1 - y).astype(int)
    xm, fit = quality.code_features()[code], quality.Fit(rounds=2)
    at = rng.integers(-(1 << 63), (1 << 63) - 1, n)
    table = spark.createDataFrame(pd.DataFrame({"at": at, "code": code[few:].astype(np.int32), "x": [r.tobytes() for r in xt[few:]]}),
                                  "at long, code int, x binary").repartition(3)
    assert quality._codes(xm).tolist() == code.tolist()
    rows = quality.TaughtRows(table, 0.5)
    view = quality.Calibrated(quality.Logistic(xt[:few], y[:few], 1.0), xt[:few], y[:few])
    by_code = np.where(np.arange(quality.CODES) % 2, 3.0, -3.0)
    counts = rows.confidence(view, by_code)
    assert counts[0].sum() >= n and counts[1].sum() == n
    for label in (1, 0):
        rows.to_text.append(quality.Rule.of(by_code, float(label), counts[1, label], 3000))
    label = quality._taught(rows.to_text, at, code[few:], xt[few:], 0.5)
    own = ~np.isnan(label)
    assert abs(own.sum() - 6000) < 400
    want = quality.Logistic(np.vstack([xt[:few], xt[few:][own]]), np.concatenate([y[:few], label[own]]), 1.0)
    assert np.allclose(quality.Logistic(xt[:few], y[:few], 1.0, more=rows).w, want.w, atol=1e-3)
    model = quality.co_train_all(xt[:few], xm[:few], y[:few], lambda: table, fit)
    assert ((model.score(xt[few:], xm[few:])[2] > 0.5) == y[few:]).mean() > 0.98


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.classify(odd, labels, ["doc_id", "class"]).collect()
    assert len(got) == len(ROWS) and all(r.keep for r in got)             # one class among the labels: all stay
    assert quality.classify(odd.limit(0), labels, ["doc_id"]).collect() == []
    both = spark.createDataFrame([(i, int(i < 8)) for i in range(30)] * 2, "doc_id long, quality int")
    got = quality.classify(odd, both, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


# -- licences ------------------------------------------------------------------

MIT = [license_scan.SENTENCES[i] for i in (3, 4, 5, 6)]
WRAPPED = "Copyright 2020 X.\n\n" + re.sub(r"(.{40}\S*) ", "\\1\n", ". ".join(MIT).replace("conditions. The", "conditions:\n\nThe")) + "."


def test_license_rules(spark):
    texts = {1: "Text.\nReleased under the MIT License.\nMore.", 2: WRAPPED, 3: "BSD.\n" + "\n".join(license_scan.SENTENCES[i] + ":" for i in (40, 41, 42, 43)),
             4: "\n".join(license_scan.SENTENCES[i] + ";" for i in (40, 41, 42)), 5: "licensed under the APACHE license, version 2.0. " * 3,
             6: "The license of the MIT.", 7: None, 8: "", 9: LONG + " Licensed under CC BY-NC 4.0.",
             10: "\n".join(license_scan.SENTENCES[i] for i in (42, 41, 40))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.findings for r in license_scan.scan_licenses(docs, ["doc_id"]).collect()}
    assert got == {1: ["MIT (reference)"], 2: ["MIT (text)"], 3: ["BSD-3-Clause (text)"], 4: ["BSD-2-Clause (text)"], 5: ["Apache-2.0 (reference)"],
                   6: [], 7: [], 8: [], 9: ["CC-BY-NC-4.0 (reference)"], 10: []}


def test_license_tables():
    assert all(any(m in s.lower() for m in license_scan.MARKS) for s in license_scan.SENTENCES.values())
    assert all(i in license_scan.SENTENCES for *_, ids in license_scan.RULES for i in ids)
    lengths = [len(ids) for *_, ids in license_scan.RULES]
    assert lengths == sorted(lengths, reverse=True)


@pytest.mark.parametrize("width", [None, 30, 47])
def test_every_sentence_and_rule_is_found_in_its_own_text(spark, width):
    """Plain and wrapped, also where the cut divides a sentence; each mark is within a word."""
    import textwrap

    def shown(text):
        return textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False) if width else text
    assert not any(" " in m for m in license_scan.MARKS)
    texts = [(f"s{i}", shown(f"{s}. More text.")) for i, s in license_scan.SENTENCES.items()]
    texts += [(f"r{n}", shown(". ".join(license_scan.SENTENCES[i] for i in ids) + ".")) for n, (*_, ids) in enumerate(license_scan.RULES)]
    texts += [("own", "\n\n".join([shown(". ".join(license_scan.SENTENCES[i] for i in (11, 12)) + ". You may obtain a copy of the License at"),
                                   "    http://www.apache.org/licenses/LICENSE-2.0", shown(". ".join(license_scan.SENTENCES[i] for i in (14, 15)))]))]
    rows = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string"), ["doc_id"]).collect()
    got = {r.doc_id: r for r in rows}
    for i in license_scan.SENTENCES:
        assert f"<{i}>" in got[f"s{i}"].wrapped_sequence
    for n, (name, kind, _) in enumerate(license_scan.RULES):
        assert got[f"r{n}"].findings == [f"{name} ({kind})"]
    assert got["own"].wrapped_sequence == "<11><12><13><14><15>"


def test_every_rule_at_every_width(spark):
    """A notice, however it is wrapped, gives its own rule and no shorter one beside it."""
    import textwrap

    texts = [(f"{n} {w}", textwrap.fill(". ".join(license_scan.SENTENCES[i] for i in ids) + ".", w, break_long_words=False, break_on_hyphens=False))
             for n, (*_, ids) in enumerate(license_scan.RULES) for w in range(25, 101)]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string").repartition(8), ["doc_id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        name, kind, ids = license_scan.RULES[int(r.doc_id.split()[0])]
        assert (r.sequence, r.findings) == ("".join(f"<{i}>" for i in ids), [f"{name} ({kind})"]), r.doc_id


def test_license_sql_knows_parted_sentences(spark, tmp_path):
    """Query and SQL on every rule at some widths, MPL-2.0 among them, and on mixed texts."""
    import textwrap

    import duckdb

    from ticketlens.plans.oracle import compare

    rule_texts = [". ".join(license_scan.SENTENCES[i] for i in ids) + ". More." for *_, ids in license_scan.RULES]
    texts = [textwrap.fill(t, w) for t in rule_texts for w in (40, 75, 1000)] + ["\n".join(rule_texts), "Heading\n".join(rule_texts), None, "", "no licence here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = license_scan.scan_licenses(docs, ["doc_id"])
    got = got.selectExpr("doc_id", "line_sequence", "wrapped_sequence", "sequence", "array_join(findings, ', ') AS findings").toPandas()
    assert compare(got, con.execute(license_scan.ORACLE_SQL).fetchdf()) == []
    assert "MPL-2.0 (reference)" in set(got["findings"])


def test_license_odd_rows(odd):
    assert all(r.findings == [] and r.sequence == "" for r in license_scan.scan_licenses(odd, odd.columns).collect())
    assert len(license_scan.scan_licenses(odd, ["doc_id", "words"]).collect()) == len(ROWS)
    assert license_scan.scan_licenses(odd.limit(0), ["doc_id"]).collect() == []


# -- chat ----------------------------------------------------------------------


def test_chat_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Rules"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé"), (1, 3, None, None), (1, 1, "ann", "Hi"),
                                   (None, 0, "ann", "x"), (2, None, "system", "only")], "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(turns.withColumn("of", turns.text).withColumn("salt", turns.turn)).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(seen) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    assert all(len(seen[1, p]) == 5 for p in ("ann", "bob", "unknown"))
    for (_, p), rows in seen.items():
        for r in rows:
            trained = r.segment[r.mask_start:r.mask_end]
            body = {"Rules": "Rules", "Hi": "Hi"}.get(r.segment.split("\n", 1)[1].removesuffix("<|im_end|>"), None)
            if r.speaker == p:
                assert r.role == "assistant" and trained == r.segment.split("\n", 1)[1] and r.segment.startswith("<|im_start|>assistant\n")
            else:
                assert trained == "" and r.segment.startswith("<|im_start|>system\n" if r.speaker == "system" else f"<|im_start|>user name={r.speaker}\n")
            assert body is None or body in r.segment
    assert chat.rotate_perspectives(turns.limit(0)).collect() == []


# -- decontamination -----------------------------------------------------------


def words_of(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items):
    w, hit, found = words_of(text), set(), set()
    for i, t in items:
        x = words_of(t)
        n = min(13, len(x))
        wins = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if x else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j:j + n]) in wins:
                hit |= set(range(j, j + n))
                found.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, " ".join(f"item{i}" for i in range(40))), (2, "Short Item of six words É"), (3, "one"), (4, None), (5, "..."), (10, "beta shared line"),
         (None, " ".join(f"item{i}" for i in range(20, 33))), (6, " ".join(["same"] * 30))]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1] + ITEMS[6:], ITEMS[1:2]])
def test_contamination_against_brute_force(spark, odd, items):
    seq = [f"item{i}" for i in range(40)]
    extra = [(100, " ".join(["x"] * 50 + seq[3:16] + ["y"] * 3)), (101, " ".join(seq[:12] + ["z"] + seq[12:20])), (102, "-".join(s.upper() for s in seq)),
             (103, " ".join(seq[5:25] + seq[10:30] * 3)), (104, "a short item of six words é b"), (105, "a short item of six words É"), (106, "same " * 14),
             (107, " ".join(["w"] * 300 + seq[:13])), (107, " ".join(["w"] * 200 + seq[:13])), (108, "one")]
    rows = [(i, t) for i, t, *_ in ROWS] + extra
    docs = odd.select("doc_id", "text", "words", "class").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True).withColumnRenamed("words", "item")
    got = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "class"]).collect()
    want = sorted(((i, *contamination(t, items)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == want


def test_contamination_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_contamination(odd, none, ["doc_id"]).collect()
    assert sorted(r.n_words for r in got) == sorted(len(words_of(r[1])) for r in ROWS) and not any(r.contaminated for r in got)
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(odd.limit(0), some, ["doc_id"]).collect() == []


# -- URLs ----------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "https://x.net/es/q", "x.net/es/", None, "", "ftp://com/",
            "http://notexample.com/en/", "http://net", "http://net/fr/", "a://b://c/d", "http://x.net?/es/", "http://É.COM/Ü"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(
        spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").coalesce(1), ["page_id"], URL_RULES).orderBy("page_id").collect()]
    for u, (host, path, rule, verdict) in zip(urls, got, strict=True):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match("[^/?#]*", rest)[0]
        assert host == re.sub("[A-Z]", lambda m: m[0].lower(), h) and path == re.match("[^?#]*", rest[len(h):])[0]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (rule, verdict) == ((best.host + best.path, best.verdict) if best else (None, "allow"))


def test_url_trie_precedence():
    rule = url_filter.Rule
    root = url_filter.build_trie([rule("block", "a.b", "/x"), rule("allow", "a.b", "/x"), rule("allow", "a.b", "/x/y/"), rule("block", "", "/zz"), rule("allow", "b", "")])
    best = lambda h, p: (r := url_filter.longest(root, h, p)) and (r.verdict, r.host, r.path)
    assert best("a.b", "/xyz") == ("block", "a.b", "/x")
    assert best("q.a.b", "/x/y/z") == ("allow", "a.b", "/x/y/")
    assert best("b", "/x") == ("allow", "b", "")
    assert best("c", "/zz/1") == ("block", "", "/zz")
    assert best("c", "/z") is None


# -- WARC ----------------------------------------------------------------------

PAGE = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-Own: a b\r\n\r\n<html><head><title> A &amp; B </title><style>p{}</style></head>"
        b"<body><p>One &lt;1&gt;<br>caf\xe9 <b>bo</b>ld<!-- no --></p><script>var x='</p>';</script><a href='/q?a=1&amp;b=2'>link</a><div>end")


def test_warc_records(spark):
    rows = [("urn:uuid:1", "http://x/", "2024-01-01T00:00:00Z", "sha1:GIVEN", PAGE), (None, None, None, None, None), ("i", "u", "d", None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89"),
            ("j", "u", "d", None, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")]
    kind = "record_id string, target_uri string, warc_date string, payload_digest string, block binary"
    got = warc.build_derivatives(spark.createDataFrame(rows, kind).coalesce(1)).collect()
    assert [r.warc_type for r in got] == ["metadata", "conversion"] * 2 + ["metadata"] + ["metadata", "conversion"]
    meta, text = got[:2]
    head, body = bytes(text.record).split(b"\r\n\r\n", 1)
    assert body == "One <1>\ncafé bold\nlink\nend".encode() + b"\r\n\r\n"
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert headers["WARC-Refers-To"] == "<urn:uuid:1>" and headers["Content-Length"] == str(len(body) - 4) == str(text.content_length)
    assert headers["WARC-Block-Digest"] == warc.digest(body[:-4]) == text.block_digest and headers["WARC-Date"] == rows[0][2]
    about = bytes(meta.record).decode()
    assert f"conversion: <{text.record_id}>" in about and "source-header-x-own: a b" in about and "title: A & B" in about and "outlink: /q?a=1&b=2" in about
    assert "source-payload-digest: sha1:GIVEN" in about and f"source-block-digest: {warc.digest(PAGE)}" in about
    assert got[-1].content_length == 5 and bytes(got[-1].record).endswith(b"abcde\r\n\r\n")
    assert len({r.record_id for r in got}) == len(got)
    again = warc.build_derivatives(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.record_id for r in again) == sorted(r.record_id for r in got)
    assert warc.build_derivatives(spark.createDataFrame([], kind)).collect() == []


class _Reader(HTMLParser):
    """Text, title and links of a page by Python's own reader; block tags end lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.inside = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc._SKIPPED:
            self.inside.append(tag)
        elif not self.inside:
            if tag == "a" and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"])
            if tag in warc._BLOCK:
                self.out.append("\n")

    def handle_endtag(self, tag):
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()
        elif not self.inside and tag in warc._BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        (self.title if self.inside == ["title"] else [] if self.inside else self.out).append(data)

    def result(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x), " ".join("".join(self.title).split()), self.links


def _read(page):
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.result()


def test_page_text_against_another_reader(spark):
    """Every page of the table, and pages with declarations, instructions and quoted angle brackets."""
    pages = [r.html for r in read_table(spark, SF, "pages").select("html").collect() if r.html]
    pages += ['<!DOCTYPE html><p>x<p title="a > b">y', '<?xml version="1.0"?><html><body>z</body></html>', '<a title="a > b" href="/q">y</a> w',
              "<a title='it\"s > 1' href='/r'>1</a><br>2", '<p data-x=">" class=k>in</p>out', "<!-- a > b --><b>c</b>d", "<p>don't > \"stop\"</p>",
              "<A HREF=/u>v</A><a name=href>n</a><a HREF = '/w'>s</a>"]
    for page in pages:
        assert warc.html_text(page) == _read(page)
        assert not warc.html_text(page)[0].lower().startswith("<!doctype")


def test_page_with_open_quotes():
    assert warc.html_text('<a href="x>y</a><p>z')[0] == "y\nz"
    assert warc.html_text('<a x="' * 20000 + ">t")[0] == "t"
    assert warc.html_text("<!" * 20000)[0] == "" and warc.html_text("<?a" * 20000)[0] == ""


def test_warc_odd_records(spark):
    """Repeated rows, a long body, broken compression and further columns."""
    def response(body, *headers):
        return "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *headers]).encode() + b"\r\n\r\n" + body

    rows = [("r", "http://a/", "2024-01-01T00:00:00Z", None, response(b"<p>one"))] * 2
    rows += [("l", "http://b/", "2024-01-01T00:00:00Z", None, response(b"<p>word " * 200_000)),
             ("g", "http://c/", "2024-01-01T00:00:00Z", None, response(b"not gzip", "Content-Encoding: gzip")),
             ("d", "http://d/", "2024-01-01T00:00:00Z", None, response(b"not deflate", "Content-Encoding: deflate"))]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, payload_digest string, block binary").withColumn("record", F.lit("clash"))
    got = warc.build_derivatives(df).collect()
    assert sorted(r.warc_type for r in got) == ["conversion"] * 5 + ["metadata"] * 5
    texts = {r.target_uri: r.record.split(b"\r\n\r\n", 1)[1].removesuffix(b"\r\n\r\n").decode() for r in got if r.warc_type == "conversion"}
    assert texts["http://a/"] == "one" and len(texts["http://b/"]) == 200_000 * 5 - 1
    assert (texts["http://c/"], texts["http://d/"]) == ("not gzip", "not deflate")


def test_warc_query(spark, duck_small):
    from ticketlens.llm.queries import op10_warc_derivatives

    got = op10_warc_derivatives(spark, SF).collect()
    pages = duck_small.execute("SELECT url, html FROM pages").fetchall()
    assert len(got) == 2 * len(pages)
    by_uri = {}
    for r in got:
        by_uri.setdefault(r.target_uri, []).append(r)
    for url, html in pages:
        body = (html or "").encode()
        assert any(r.source_payload_digest == warc.digest(body) for r in by_uri[url])
        assert all(r.refers_to == r.response_id for r in by_uri[url])


def test_html_text_finds_closing_tags_in_capitals_beside_letters_that_grow():
    page = "<TITLE>\u0130zmir</TITLE><p>one</p><SCRIPT>x</SCRIPT><p>two</p><style>y</STYLE><p>\u0130\u0130 three"
    assert warc.html_text(page) == ("one\ntwo\n\u0130\u0130 three", "\u0130zmir", [])
    assert warc.html_text("\u0130<script>x</\u017fcript>y</Script>z")[0] == "\u0130z"


def test_html_text_is_linear():
    assert warc.html_text("<script>" * 20000 + "x")[0] == ""
    assert warc.html_text("<!--" * 20000)[0] == ""
    assert warc.html_text("a<b")[0] == "a"
    assert warc.html_text("1 < 2 & 3")[0] == "1 < 2 & 3"


# -- pipeline ------------------------------------------------------------------


def test_url_filter_odd_rows(spark, odd):
    """An empty table, repeated rows, a very long URL and clashing columns."""
    rules = [url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "com", "/")]
    url = "http://www.Example.COM/en/" + "x" * 100_000
    rows = spark.createDataFrame([(1, url), (1, url), (None, None), (2, ""), (3, "http://example.com/fr/"), (4, "no scheme")], "page_id long, url string") \
        .withColumn("trie", F.lit("clash")).withColumn("labels", F.lit(1))
    got = sorted(((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge_urls(rows, ["page_id", "trie", "labels"], rules).collect()), key=str)
    long = (1, "www.example.com", len(url) - len("http://www.example.com"), "example.com/en/", "block")
    assert got == sorted([long, long, (None, "", 0, None, "allow"), (2, "", 0, None, "allow"), (3, "example.com", 4, "com/", "allow"), (4, "", 0, None, "allow")], key=str)
    assert url_filter.judge_urls(rows.limit(0), ["page_id"], rules).collect() == []


def test_quality_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id on very many rows counts once among the fetched rows, whatever the order of the rows."""
    seen = []
    monkeypatch.setattr(quality, "co_train_all", lambda xt, xm, y, rows, fit: seen.append((len(xt), xt.sum(), y.tolist())) or quality.CoTrained(None, None, 1.0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, f"text {i}", "s", "en", 6) for i in range(30)] + [(3, f"copy {j}", "s", "en", 6) for j in range(200)],
                                     "doc_id long, text string, source string, lang string, n_chars long").repartition(parts)
        quality.train(docs, labels, quality.Fit(labelled=19))
    assert seen[0][0] == 19 and seen[0][2] == seen[1][2] and abs(seen[0][1] - seen[1][1]) < 1e-3


def test_training_in_spark_equals_training_in_memory(spark):
    """All rounds, end to end, where every confident row is taught: the same scores as the in-memory version."""
    import numpy as np

    rng = np.random.default_rng(4)

    def rows(n):
        y = rng.integers(0, 2, n).astype(float)
        xt = rng.normal(0, 1, (n, quality.N_TEXT)).astype(np.float32)
        xt[:, 0] += 2 * y
        code = np.where(rng.random(n) < 0.85, y * 3, 3 - y * 3).astype(int) * quality.SIZES + rng.integers(0, 4, n)
        return xt, code, quality.code_features()[code], y

    xt, _, xm, y = rows(400)
    ut, ucode, um, _ = rows(600)
    table = spark.createDataFrame([(int(h), int(c), r.tobytes()) for h, c, r in zip(rng.integers(-2**62, 2**62, 600), ucode, ut)], "at long, code int, x binary").repartition(4)
    fit = quality.Fit(taught=1.0, rounds=2, confident=0.9)
    here = quality.co_train(xt, xm, y, ut, um, fit)
    there = quality.co_train_all(xt, xm, y, lambda: table, fit)
    nt, _, nm, _ = rows(300)
    for a, b in zip(here.score(nt, nm), there.score(nt, nm)):
        assert np.abs(a - b).max() < 0.02


def test_pipeline_stages(spark):
    """Each stage against brute force over what the one before kept."""
    from .test_lines_tokens import TRUTH, kept_lines
    from .test_near_duplicates import five_word_brute

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(list(before.values()), docs.schema).repartition(3), SF)
        after = {r.doc_id: r for r in out.collect()}
        ids = sorted(before)
        if name != "tokens":
            assert out.columns == columns
        if name == "quality":
            good = [i for i in ids if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.98 * len(good)
            assert sum(i in after for i in ids if labels.get(i) == 0) <= 0.1 * len(ids)
        elif name == "lines":
            want = [x[2] for x in kept_lines([before[i].text or "" for i in ids], 10)]
            assert [after[i].text for i in ids] == want and all(after[i].n_chars == len(after[i].text) for i in ids)
        elif name == "near_duplicates":
            group = five_word_brute([(i, before[i].text) for i in ids])
            assert set(after) == {min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
        elif name == "decontamination":
            assert set(after) == {i for i in ids if not contamination(before[i].text, items)[3]}
        else:
            assert {i: list(r.ids) for i, r in after.items()} == {i: TRUTH.encode_ordinary(before[i].text or "") for i in ids}
        before = after
    assert hashlib.sha256(str(sorted(before)).encode()).hexdigest() == hashlib.sha256(str(sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())).encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        assert len(stage(spark, docs, SF).collect()) > 0
