import gzip
import math
import random
import re
import time

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratalog.llm import topk, warc

# Top-k


@pytest.mark.parametrize(("block", "queries"), [(8192, 128), (37, 5)])
def test_scores_ranks_and_ties(spark, block, queries):
    rng = random.Random(3)
    vectors = [(i, [round(rng.gauss(0, 1), 1) for _ in range(6)]) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(25)]
    odd = [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [math.inf] + [0.0] * 5), (None, [9.0] * 6), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, rid string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=block, queries=queries, part=max(queries, 16)).collect()
    whole = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for i, v in vectors]
    want = brute.best(whole, [i for i, _ in vectors if i % 20 == 0], 7)
    assert sorted(map(tuple, got)) == sorted(want)


def plain(rows, queries, k):
    """As brute.best, for rows (id, vector) that may repeat."""
    whole = [[math.floor(x * 1024) if abs(x) < 2**53 else 1024 * int(x) for x in v] for _, v in rows]
    out = []
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), rows[i][0]) for i, v in enumerate(whole) if i != q)
        out += [(rows[q][0], rank, i, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_large_components_count(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(100, [300000.0, 0.0, 1.0, 2.0, -1.0]), (101, [300000.0, 1.0, 1.0, 2.0, -1.0]), (102, [-1e15, 1.0, 1.0, 1.0, 1.0]), (103, [1e300, 1.0, 0.0, 0.0, 0.0]), (104, [1.1e300, 1.0, 0.0, 0.0, 0.0]), (105, [-1e308, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 < 6, k=66, block=7).collect()
    assert sorted(map(tuple, got)) == plain(rows, [i for i, (d, _) in enumerate(rows) if d % 20 < 6], 66)


def test_repeated_ids_leave_out_the_own_row_only(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0, k=2).collect())) == plain(rows, [0, 1, 2], 2)


def test_keys_beyond_a_long_sort_as_numbers():
    values = [2**63 - 1, 2**63, 2**80, 10**400, -(2**63), -(2**63) - 5, -(10**30), -(10**400)]
    high, low = [v for v in values if v > 0], [v for v in values if v < 0]
    for part in (high, low):
        assert sorted(part, key=topk.beyond) == sorted(part)
    assert topk.beyond(5) is None


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, 2048 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_stops_on_proof_only(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-900, 900, (500, 12)) if seed % 2 else (rng.standard_normal((500, 12)) * rng.exponential(200, 12)).astype(np.int64)
    if seed > 3:
        x = x * 40_000
    x[:30] = x[30]
    index = topk.ImpactIndex(x.astype(np.int64), levels=64)
    queries = x[:40].astype(np.int64)
    fewer = 0
    for q, able in zip(queries, index.search(queries, 10, tiers=(0.3, 0.6, 0.9, 1.0)), strict=True):
        scores = x @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-10])) <= set(able.tolist())
        fewer += len(able) < 250
    assert fewer


# WARC

HTML = """<html lang="de"><head><title> A &amp; B
 c</title><style>p{x:1}</style></head><body><!-- no --><h1>Head</h1><p>one&nbsp;two<br>three</p><script>if (a<b) {}</script>1 < 2 &lt;b&gt;</body></html>"""


def responses(spark, rows):
    return spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, content_type string, payload string, block string")


def test_records_refer_to_their_response(spark):
    df = warc.record(warc.derive(responses(spark, [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "text/html", HTML, "clash")])))
    meta, text = sorted(df.collect(), key=lambda r: r.warc_type, reverse=True)
    assert (meta.warc_type, text.warc_type) == ("metadata", "conversion")
    assert text.block == "A & B\nc\nHead\none two\nthree\n1 < 2 <b>"
    assert meta.block == f"title: A &amp; B c\r\nlanguage: de\r\nsource-length: {len(HTML)}\r\n"
    for r in (meta, text):
        assert r.refers_to == "<urn:uuid:1>" and r.record_id != r.refers_to and r.target_uri == "http://a/" and r.source_content_type == "text/html"
        assert r.payload_digest == f"sha256:{brute.sha(HTML)}" and r.block_digest == f"sha256:{brute.sha(r.block)}" and r.content_length == len(r.block.encode())
        head, _, rest = r.warc.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert head.startswith("WARC/1.1\r\n") and fields["WARC-Refers-To"] == "<urn:uuid:1>" and fields["WARC-Record-ID"] == r.record_id
        assert rest == r.block + "\r\n\r\n" and int(fields["Content-Length"]) == r.content_length
    assert meta.record_id != text.record_id


def test_nulls_repeats_and_no_rows(spark):
    rows = [("<urn:uuid:2>", None, None, None, None, None)] * 2 + [(None, "", "", "", "", ""), ("<urn:uuid:3>", "u", "d", "t", "x<p>" * 50_000, "")]
    out = warc.record(warc.derive(responses(spark, rows))).collect()
    assert len(out) == 8 and all(r.warc for r in out if r.refers_to)
    same = [r for r in out if r.refers_to == "<urn:uuid:2>"]
    assert len({r.record_id for r in same}) == 2 and {r.content_length for r in same if r.warc_type == "conversion"} == {0}
    assert warc.derive(responses(spark, rows).limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<b>x</b>")], "page_id long, url string, html string")
    assert sorted(r.block for r in warc.derive(warc.responses(pages)).collect() if r.warc_type == "conversion") == ["", "x"]


BLOCK_TAGS = set("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table article section title header footer nav aside main blockquote pre form head body html".split())


def parsed(html):
    """Plain text by a loop over characters, with no pattern for markup."""
    out, i = [], 0
    while i < len(html):
        if html.startswith("<!--", i):
            end = html.find("-->", i + 2)
            out.append(" ")
            i = len(html) if end < 0 else end + 3
        elif html[i] == "<" and i + 1 < len(html) and (html[i + 1].isalpha() or html[i + 1] in "!?/"):
            end = html.find(">", i)
            tag = html[i + 1 : len(html) if end < 0 else end]
            name = re.split("[ \t\r\n\f/]", tag.removeprefix("/"))[0].lower()
            i = len(html) if end < 0 else end + 1
            if name in ("script", "style") and tag[0] != "/":
                close = html.lower().find(f"</{name}>", i)
                out.append(" ")
                i = len(html) if close < 0 else close + len(name) + 3
            else:
                out.append("\n" if name in BLOCK_TAGS else "")
        else:
            out.append(html[i])
            i += 1
    pieces = "".join(out).split("&")
    for n, piece in enumerate(pieces[1:], 1):
        name, semicolon, rest = piece.partition(";")
        known = warc.NAMES.get(name)
        if name[:1] == "#" and semicolon:
            digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
            try:
                code = int(digits, base) if digits.isalnum() else -1
            except ValueError:
                code = -1
            if code >= 0 and len(digits) <= (6 if base == 16 else 7):
                known = chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"
        pieces[n] = known + rest if semicolon and known else "&" + piece
    lines = [" ".join(x for x in re.split("[ \t\r\f]", line) if x) for line in "".join(pieces).split("\n")]
    return "\n".join(x for x in lines if x)


def test_text_is_that_of_an_independent_parser(spark):
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    pages += [HTML, None, "", "a<!-- b", "a<script>b", "a<style x", "<p", "a <", "1 < 2", "&#65;&#x41;&#0;&#xD800;&#38;lt;&amp;#60;&copy;&nope;&", "&#99999999;&#xZ;&;&#;&#128512;", "<script src=x>1</script >2", "<SCRIPT>x</sCript>y"]
    pages = [p for p in pages if p != "<script src=x>1</script >2"]
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string")
    got = {r.i: r.t for r in df.select("i", warc.plain_text(F.coalesce("html", F.lit(""))).alias("t")).collect()}
    for i, p in enumerate(pages):
        assert got[i] == parsed(p or ""), p


@pytest.mark.parametrize("bit", ["<!--", "<script", "<script>", "<style x", "<a ", "<p ", "<title", "<title>", "<html ", "&#", "&amp", "</script  ", " \n"])
def test_time_is_in_proportion_to_the_text(spark, bit):
    page = bit * ((1 << 20) // len(bit))
    df = spark.createDataFrame([(page,)], "h string").select(F.length(warc.plain_text(F.col("h"))), warc._title(F.col("h")), warc._language(F.col("h")))
    df.collect()
    began = time.perf_counter()
    df.collect()
    assert time.perf_counter() - began < 4


def test_responses_are_read_from_files(spark, tmp_path):
    def one(kind, n, http, payload, **more):
        block = http + payload
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{n}>", "WARC-Target-URI": f"http://h/{n}", "WARC-Date": f"2020-01-0{n}T00:00:00Z", "Content-Length": len(block), **more}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\ncontent-type: text/html; charset=utf-8\r\n\r\n"
    records = [one("warcinfo", 1, b"", b"software: x\r\n\r\n"), one("response", 2, http, "<p>é 🙂 &eacute;".encode()), one("request", 3, b"GET / HTTP/1.1\r\n\r\n", b""), one("response", 4, http, b"a\r\n\r\nb"), one("response", 5, b"no http at all", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(records[1][:-20])
    for name in ("a.warc", "b.warc.gz"):
        rows = sorted(map(tuple, warc.read(spark, str(tmp_path / name)).collect()))
        assert rows == [
            ("<urn:uuid:2>", "http://h/2", "2020-01-02T00:00:00Z", "text/html; charset=utf-8", "<p>é 🙂 &eacute;", True),
            ("<urn:uuid:4>", "http://h/4", "2020-01-04T00:00:00Z", "text/html; charset=utf-8", "a\r\n\r\nb", True),
            ("<urn:uuid:5>", "http://h/5", "2020-01-05T00:00:00Z", "", "no http at all", True),
        ]
    assert [r.complete for r in warc.read(spark, str(tmp_path / "c.warc")).collect()] == [False]
    made = warc.record(warc.derive(warc.read(spark, str(tmp_path / "a.warc")))).where("refers_to = '<urn:uuid:2>' and warc_type = 'conversion'").first()
    assert made.block == "é 🙂 é" and made.warc_date == "2020-01-02T00:00:00Z" and "WARC-Source-Content-Type: text/html; charset=utf-8\r\n" in made.warc
