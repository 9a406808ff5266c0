"""The queries that SQL can express, against DuckDB, and their edge cases."""

import html
import math
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from pnlbook.llm import neighbours, oracle, queries, rules, warc
from tests.conftest import SF_SMALL
from tests.oracle_util import duck, same


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), oracle.SQL[name])


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 1 + len(queries.QUERIES)))


def test_rules_on_odd_texts(spark):
    junk = "a b c d e f g h " * 9
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, junk), (4, "w " * 7), (5, junk), (5, junk), (6, "x" * 5000), (7, "# $ % | < > & *\n" * 6),
            (8, " ".join(f"word{k}" for k in range(40)))]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id LONG, text STRING, words STRING, t STRING")
    book = rules.ledger(df)
    got = {r.doc_id: r for r in book.collect()}
    assert book.count() == len(rows) and got[1].n_words == got[3].n_words == 0 and got[2].fail_bits & rules.bit("few_words")
    assert got[5].n_repeat_words == got[5].n_words == 72 and got[4].n_repeat_words == 0
    assert got[7].n_symbols == 48 and got[7].n_dup_lines == 5 and got[7].n_lines == 6
    kept = rules.kept_rows(df)
    assert [r.doc_id for r in kept.collect()] == [8] and kept.columns == df.columns
    assert rules.kept_rows(df.limit(0)).count() == 0
    table = {(r.version, r.rule): r for r in rules.ablations(book).collect()}
    assert table[1, "few_words"].n_failed == 5 and table[2, "repeated_windows"].n_rejected == 9


def test_neighbours_on_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(neighbours, "STRIPE", 4)
    good = [(k, [float((k * 7) % 11 - 5), float(k % 3), 0.25 * (k % 5)]) for k in range(60)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, math.nan, 0.0]), (103, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (104, [math.inf, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [3.0, 4.0]), (40, good[40][1]), (40, [5.0, 5.0, 1.0]), (41, [9.0, 9.0, 9.0]), (107, [])]
    df = spark.createDataFrame([(*r, 1) for r in good + odd], "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT")
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, 6).collect()
    vectors = [(i, v) for i, v in [*good, (40, good[40][1]), (40, [5.0, 5.0, 1.0]), (41, [9.0, 9.0, 9.0])] if any(v)]
    want = [(105, 1, 106, 11.0)]
    for n, (q, v) in enumerate(vectors):
        if q % 5 == 0:                  # every row of an id is a query of its own, and a candidate of the others
            best = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(vectors) if m != n), key=lambda x: (-x[0], x[1]))[:6]
            want += [(q, k + 1, i, s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_warc_links_and_odd_pages(spark):
    rows = [(1, "http://a/", "<html lang=de><head><title>T &amp; <b>x</b>\n</title><meta charset='UTF-8'></head><p>a&nbsp;b</p><script>no</script><!-- no --><br>c</html>"),
            (2, None, None), (None, "http://b/", ""), (1, "http://a/", "<style>p{"), (3, "u", "<b>" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id LONG, url STRING, html STRING, block STRING")
    responses = {r.record_id: r for r in warc.responses(df).collect()}
    made = warc.derive(warc.responses(df)).collect()
    assert len(made) == 2 * len(rows) and all(r.refers_to in responses and r.payload_digest == responses[r.refers_to].payload_digest for r in made)
    text = next(r for r in made if r.page_id == 1 and r.warc_type == "conversion" and r.block)
    assert text.block == "T & x\na b\nc" and f"Content-Length: {len(text.block.encode())}\r\n" in text.header
    meta = next(r for r in made if r.refers_to == text.refers_to and r.warc_type == "metadata")
    assert "title: T & x\r\nlanguage: de\r\ncharset: utf-8\r\n" in meta.block and "WARC-Refers-To: " + text.refers_to in meta.header
    assert all(("WARC-Target-URI" in r.header) == (r.target_uri is not None) for r in made)
    raw = warc.serialised(warc.derive(warc.responses(df))).collect()
    assert all(bytes(r.warc).startswith(b"WARC/1.1\r\n") and bytes(r.warc).endswith(b"\r\n\r\n") for r in raw)
    assert warc.derive(warc.responses(df.limit(0))).count() == 0


def test_references_as_html_unescape(spark):
    rng = random.Random(2)
    names = [*html5, "nosuch;", "notit;", "ampx", "amp;lt;", "#", "#x", "#;", "#x;", "x" * 40, " amp;", "#38;", "#x26;amp;"]
    numbers = [0, 1, 8, 9, 10, 11, 13, 14, 38, 127, 128, 150, 159, 160, 8217, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x1F600, 0x10FFFF, 0x110000, 99999999999]
    refs = names + [f"#{n}{e}" for n in numbers for e in (";", "", "z")] + [f"#{x}{n:x}{e}" for n in numbers for x in "xX" for e in (";", " ")] + ["#00038;", "#x00026;"]
    texts = ["&" + r for r in refs] + ["".join(rng.choice(["&", "a", " ", "&" + rng.choice(refs), ";", "\u00e9"]) for _ in range(30)) for _ in range(300)] + ["", "&&", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in df.select("t", warc.unescaped(F.col("t")).alias("u")).collect():
        assert r.u == html.unescape(r.t), r.t


def test_warc_headers_hold_no_foreign_lines(spark):
    rows = [(1, "http://a/\r\nX-Evil: 1", "<title>x&#13;&#10;X-Evil: 1&#x2028;y</title>&middot;&#8217;"), (2, "http://b/\x00\x7f", "<p>a &amp;lt; b")]
    pages = warc.responses(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING"))
    made = warc.derive(pages.withColumn("http_header", F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: s\r\nSet-Cookie: a=b\r\n"), F.lit("Content-Type: text/html\r\n\r\n")))).collect()
    assert not any(line.startswith("X-Evil") for r in made for line in r.header.splitlines() + (r.block.splitlines() if r.warc_type == "metadata" else []))
    meta = next(r for r in made if r.page_id == 1 and r.warc_type == "metadata")
    assert "title: x X-Evil: 1 y\r\n" in meta.block and "source-header: Server: s\r\nsource-header: Set-Cookie: a=b\r\nsource-header: Content-Type: text/html\r\n" in meta.block
    assert "http://a/%0D%0AX-Evil: 1\r\n" in meta.header
    text = {r.page_id: r.block for r in made if r.warc_type == "conversion"}
    assert text[1].endswith("\u00b7\u2019") and text[2] == "a &lt; b"
