"""Difference-cover dedup against the definition."""

import random

import pytest

from pnlbook.llm import cover

from .brute import word_dedup

SCHEMA = "doc_id long, text string, u string, places string"


def planted(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randrange(40))
    text = lambda k: [word() for _ in range(k)]
    shared = [text(k) for k in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            body += text(rnd.randrange(30)) + (p if rnd.random() < 0.6 else p[a:])
        rows.append((i * 7, "  \n".join([" ".join(body), " ".join(text(rnd.randrange(40)))])))
    rows += [(1000, rows[5][1]), (1001, rows[5][1].replace("\n", "\t")), (1002, ""), (1003, None), (1004, " \n "),
             (1005, "x " * 400), (1006, "x " * 120), (1007, "é " * 60), (1008, "é " * 49)]
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in cover.digests(cover.dedup(df)).collect()]
    assert sorted(got, key=str) == sorted(word_dedup(rows), key=str)


def test_cover_is_a_difference_cover():
    diffs = {(a - b) % cover.PERIOD for a in cover.COVER for b in cover.COVER}
    assert diffs == set(range(cover.PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_definition(spark, seed):
    run(spark, planted(seed))


def test_repeated_and_null_ids(spark):
    rows = planted(4, 25)
    rows += [rows[3], rows[3], (rows[3][0], rows[4][1]), (None, rows[4][1]), (None, rows[4][1]), (None, None)]
    run(spark, rows)


def test_empty_table(spark):
    run(spark, [])


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    run(spark, rows)
