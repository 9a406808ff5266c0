"""PartEnum components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pnlbook.llm import partenum

from .brute import similar_components

SCHEMA = "doc_id long, text string, u string, component_id string"


def family(rnd, words, copies, edits):
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        b = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            b[rnd.randrange(len(b))] = f"e{rnd.randrange(5000)}"
        if rnd.random() < 0.3:
            b = b[rnd.randrange(max(1, words // 12)):]
        out.append(" ".join(b))
    return out


def planted(seed):
    rnd = random.Random(seed)
    texts = [t for w, c, e in ((3, 5, 1), (6, 8, 1), (12, 10, 1), (25, 14, 2), (60, 20, 4), (150, 25, 8), (400, 15, 20), (1200, 6, 60))
             for t in family(rnd, w, c, e)]
    texts += [texts[9], texts[30].upper(), texts[60].replace(" ", "\n\t "), "", None, " ", "", "a", "A", "a b c", "a b", "x " * 300, "x " * 50, "é " * 9]
    rnd.shuffle(texts)
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in partenum.components_of(df, gram=4, percent=85, **kw).collect()]
    assert sorted(got, key=str) == sorted(similar_components(rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 4 if seed == 2 else 768)
    run(spark, planted(seed))


def test_empty_and_repeats(spark):
    run(spark, [])
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "q"), (9, "A b c d e f g"), (11, None)]
    df = spark.createDataFrame([(*r, "", "") for r in [*rows, (None, "a b c d e f g"), (None, None)]], SCHEMA)
    got = sorted([tuple(r) for r in partenum.components_of(df, gram=4, percent=85).collect()], key=str)
    assert got == sorted([(5, 4, 5), (5, 4, 5), (2, 1, 2), (9, 4, 5), (11, 0, 11), (None, 4, 5), (None, 0, None)], key=str)


def test_signatures_meet():
    """Every pair within the band's differences shares a signature."""
    rng = np.random.default_rng(1)
    bands = partenum.Bands(85)
    for size in (7, 8, 11, 13, 20, 33, 47, 90, 200, 700, 2500):
        for _ in range(60):
            a = rng.integers(0, 2 ** 63, size, dtype=np.uint64)
            drop = rng.integers(0, int(size * 0.15) + 1)
            b = a.copy()
            rng.shuffle(b)
            b = np.concatenate((b[drop:], rng.integers(0, 2 ** 63, int(rng.integers(0, drop + 1)), dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or set(a) == set(b):
                continue
            who, sign = partenum.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(sign[who == 0]) & set(sign[who == 1]), (size, len(b), both)


def test_intersections():
    rng = np.random.default_rng(2)
    for n, domain in ((1, 5), (7, 40), (90, 60), (150, 3000), (200, 80)):
        sets = [np.unique(rng.integers(0, domain, rng.integers(0, 50)).astype(np.uint64)) for _ in range(n)]
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        got = partenum.intersections(np.concatenate(sets), at)
        off = ~np.eye(n, dtype=bool)
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (got[off] == want[off]).all()


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    run(spark, rows)


def test_long_texts_beside_the_threshold(monkeypatch):
    percent = 67
    both = next(b for b in range(700_000, 701_000) if 100 * b < percent * (100 * b // percent + 1) <= float(np.float32(100 * b)))
    most = 100 * both // percent                        # the largest union that links
    for union, linked in ((most + 1, 0), (most, 1)):
        values = np.concatenate([np.arange(union), np.arange(both)]).astype(np.uint64)
        at = np.array([0, union, union + both])
        monkeypatch.setattr(partenum, "shingles", lambda texts, gram, sets=(values, at): sets)
        assert partenum.block_links(1, percent)(pa.table({"u": [1, 2], "c": [1, 2], "t": ["x", "y"]})).num_rows == linked


def test_bitmaps_never_rule_out_a_link():
    """The bound of ``near`` against the true differences, for sets of any size, and its power on unlike ones."""
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 2 ** 63, 40_000, dtype=np.uint64)
    sets = []
    for size in (1, 2, 3, 10, 40, 300, 1000, 5000, 40_000):
        base = rng.choice(pool, size, replace=False)
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.5):
            sets.append(np.unique(np.concatenate((base[:int(size * share)], rng.integers(1, 2 ** 63, rng.integers(0, size // 10 + 1), dtype=np.uint64)))))
    sets = [s for s in sets if len(s)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    size = np.diff(at)
    for percent in (80, 85):
        ok = partenum.near(partenum.bitmaps(np.concatenate(sets), at), size, percent)
        true = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets])
        assert not (true & ~ok).any() and true.sum() > len(sets)
        assert ok.sum() < 2 * true.sum()


def test_groups_are_cut_into_blocks(spark, monkeypatch):
    """A group larger than a block: every two blocks meet, and batches cut no group."""
    monkeypatch.setattr(partenum, "GROUP", 5)
    monkeypatch.setattr(partenum, "BLOCK", 7)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:57] + [f"x{k}", f"y{k}"])) for k in range(40)] + [(100 + k, " ".join(words[:30] + [f"z{k}{m}" for m in range(30)])) for k in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = partenum.components_of(spark.createDataFrame(rows, "doc_id LONG, text STRING"), gram=1, percent=85).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == sorted(similar_components(rows, n=1))
