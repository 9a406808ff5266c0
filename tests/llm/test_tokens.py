"""Encoding against the libraries, packing against its own rules."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from pnlbook.llm import packing, pieces

ODD = [None, "", " ", "a", " a", "a ", "  a  b   ", "a\nb\n\n c", "a \n b", "\ttab\t x", "▁x y▁z", "\x00a b", "café é Ａ",
       "<|endoftext|> x<|endoftext|>", "<s> </s>", "x y z", "don't we'll  it's", "\U0001f600 a\U0001f600b", "no" * 5000, "a " * 3000, " " * 700 + "z",
       "1234 5,6 7.8", "a　 b", "same", "same"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = pd.DataFrame({"doc_id": range(len(ODD)), "text": ODD, "ids": "clash", "t": "clash"})
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    real["doc_id"] += 1000
    return pd.concat([rows, real], ignore_index=True)


def frame(spark, texts, cols="doc_id long, text string, ids string, t string"):
    return spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in texts.itertuples(index=False)], cols)


def test_pieces_equal_library(spark, texts):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in pieces.round_trip(frame(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for i, t in zip(texts["doc_id"], texts["text"], strict=True):
        want = sp.encode(t or "")
        assert got[i]["ids"] == want, (i, t)
        assert got[i]["decoded"] == sp.decode(want)


def test_pieces_empty_table(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.digests(pieces.round_trip(frame(spark, texts[:0]), path)).count() == 0


def test_packing_holds_every_id_once(spark, texts):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, texts), path).toPandas()
    want = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            for i, t in zip(texts["doc_id"], texts["text"], strict=True)}
    for i, pieces_ in got.sort_values("start").groupby("doc_id"):
        assert b"".join(pieces_["ids"]) == want.pop(i).tobytes(), i
        assert (pieces_["doc_tokens"] == sum(pieces_["length"])).all()
        assert list(pieces_["start"]) == [0, *np.cumsum(pieces_["length"])[:-1]]
    assert not want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        total = int(seq["length"].sum())
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]]
        assert total <= 2048 and total & (total - 1) == 0 and (seq["tier"] == total).all()
    assert all(zlib.crc32(x) >= 0 for x in got["ids"])


def test_plan_random():
    rng = np.random.default_rng(5)
    for scale in (1, 30, 300, 3000, 30000):
        sizes = (1 + rng.exponential(scale, rng.integers(1, 400))).astype(int).tolist()
        windows = packing.plan(sizes)
        done = [0] * len(sizes)
        for doc, start, length in sorted(p for w in windows for p in w):
            assert start == done[doc] and length > 0
            done[doc] += length
        assert done == sizes
        full = [sum(p[2] for p in w) for w in windows]
        assert all(n <= 2048 and n & (n - 1) == 0 for n in full)
        assert sum(n < 256 for n in full) <= 8


def test_step_groups_balance():
    lengths = [2048] * 300 + [256] * 77 + [3]
    groups = packing.step_groups(lengths, 1 << 15)
    load = np.bincount(groups, weights=lengths)
    assert load.max() - load.min() <= 2048


def test_packing_empty_and_same(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(frame(spark, texts[:0]), path).count() == 0
