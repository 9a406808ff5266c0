"""Each stage against a plain version, on its predecessor's output."""

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pnlbook.llm import oracle, pii
from pnlbook.session import scratch_dir

from .brute import similar_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", None, None), (90002, "", None, "x", 0), (90003, "long " * 9000, "en", "x", 45000)], docs.schema)
    docs, root, out = docs.unionByName(odd), scratch_dir(spark, "stages"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out.append((name, docs.toPandas()))
        stage(spark, docs, "").write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return [*out, ("result", docs.toPandas())]


def ids(df):
    return sorted(df["doc_id"].tolist())


def test_columns(stages):
    for _, df in stages[:-1]:
        assert list(df.columns) == COLUMNS


def test_quality(stages):
    documents = stages[0][1]                        # read by name in the SQL
    con = duckdb.connect()
    con.register("documents", documents)
    kept = con.sql(f"SELECT doc_id FROM ({oracle.OP5}) WHERE kept").df()
    assert ids(stages[1][1]) == ids(kept)


def test_near_duplicates(stages):
    before, after = stages[1][1], stages[2][1]
    rows = list(zip(before["doc_id"], before["text"], strict=True))
    assert ids(after) == sorted(i for i, _, c in similar_components(rows, 5, 80) if i == c)
    texts = dict(rows)
    assert all(texts[i] == t for i, t in zip(after["doc_id"], after["text"], strict=True))


def test_suffixes(stages):
    before, after = stages[2][1], stages[3][1]
    assert ids(before) == ids(after)
    count, n = {}, 200
    for t in before["text"]:
        b = t.encode()
        for k in range(len(b) - n + 1):
            count[b[k:k + n]] = count.get(b[k:k + n], 0) + 1
    new = dict(zip(after["doc_id"], zip(after["text"], after["n_chars"], strict=True), strict=True))
    for i, t, c in zip(before["doc_id"], before["text"], before["n_chars"], strict=True):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k:k + n]] > 1:
                gone[k:k + n] = b"\x01" * n
        at, want = 0, []
        for ch in t:                                # a character goes if all of its bytes do
            size = len(ch.encode())
            if not all(gone[at:at + size]):
                want.append(ch)
            at += size
        want = "".join(want)
        assert new[i] == (want, len(want) if want != t else c)


def test_personal_data(spark, stages):
    before, after = stages[3][1], stages[4][1]
    assert ids(before) == ids(after)
    new = dict(zip(after["doc_id"], after["text"], strict=True))
    changed = 0
    for i, t in zip(before["doc_id"], before["text"], strict=True):
        base = pii.rule_spans(t)
        assert all(t[a:b] not in new[i] for _, a, b in base if b - a > 8)
        changed += new[i] != t
        if not any(c in "0123456789@" for c in t):
            assert new[i] == t
    assert changed


def test_packing(stages):
    before, pieces = stages[4][1], stages[5][1]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: pd.array(tok.encode(t, add_special_tokens=False).ids + [1], "uint32").to_numpy().astype("<u4").tobytes()
            for i, t in zip(before["doc_id"], before["text"], strict=True)}
    got = {i: b"".join(p.sort_values("start")["ids"]) for i, p in pieces.groupby("doc_id")}
    assert got == want


def test_empty_and_nulls(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(3)
    for frame in (docs.limit(0), docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "1 as u", "'x' as t", "2 as row").unionAll(
            docs.selectExpr("doc_id", "cast(null as string)", "lang", "source", "cast(null as long)", "1", "'x'", "2"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "")
            assert out.count() <= 1000
            if name != "packing":
                assert out.columns == frame.columns
