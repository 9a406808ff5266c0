"""The family of suffix arrays against the definition."""

import random

import pytest
from pyspark.sql import functions as F

from pnlbook.llm import suffixes

from .brute import byte_dedup

SCHEMA = "doc_id long, text string, u string, digest string"


def planted(seed=3, n=40):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("abcdefg  \né") for _ in range(k))
    shared = [text(k) for k in (150, 190, 200, 201, 260, 500)]
    rows = []
    for i in range(n):
        body = ""
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(shared)
            a = rnd.randrange(80)
            body += text(rnd.randrange(120)) + (p if rnd.random() < 0.6 else p[a:])
        rows.append((i * 7, body + text(rnd.randrange(200))))
    long_ = text(3000)
    for k in range(6):                                  # near copies, an edit here and there
        b = list(long_)
        for _ in range(k * 4):
            b[rnd.randrange(len(b))] = "Z"
        rows.append((600 + k, "".join(b)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1] + " "), (1002, ""), (1003, None), (1005, "x" * 700), (1006, "xy" * 150),
             (1007, "x" * 200), (1008, "z" * 200), (1009, "q" * 201), (1010, text(90) + long_[:300] + long_[:300])]
    return rows


def run(spark, rows, batches=4):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in suffixes.digests(suffixes.dedup(df, batches)).collect()]
    assert sorted(got, key=str) == sorted(byte_dedup(rows), key=str)


@pytest.mark.parametrize("seed,batches", [(1, 4), (2, 1), (5, 7)])
def test_equals_definition(spark, seed, batches):
    run(spark, planted(seed), batches)


def test_repeated_and_null_ids(spark):
    rows = planted(4, 15)
    run(spark, rows + [rows[3], rows[3], (rows[3][0], rows[4][1]), (None, rows[6][1]), (None, None)])


def test_empty_table(spark):
    run(spark, [], 2)


def test_runs_merge_geometrically(spark):
    index = suffixes.Levels(spark)
    docs = spark.createDataFrame(planted(6), "u long, t string").fillna("")
    for b in range(7):
        index.insert(docs.where(F.col("u") % 7 == b))
    assert sorted(level for level, _ in index.runs) in ([0, 1, 2], [0, 0, 1, 1], [0, 1, 1, 1])
    assert sum(r.count() for _, r in index.runs) == sum(
        1 for _ in suffixes.map_arrow(docs, suffixes.entry_rows, "key long, u long, pos int, known boolean").collect())


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    run(spark, rows, 2)


@pytest.mark.parametrize("rows_in_slice", [1, 3, 20_000])
def test_cores_with_unlike_surroundings(spark, rows_in_slice):
    """One passage in all texts, of about a window's length, between bytes that differ or agree: however the texts fall into slices."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(214))
    rows = []
    for i in range(60):
        cut = passage[rnd.randrange(12):]
        left, right = (rnd.choice(["", "p", "qq", "".join(rnd.choice("uvw") for _ in range(30))]) for _ in range(2))
        rows.append((i, left + cut + right))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"       # a batch is a slice at most
    before = spark.conf.get(conf)
    spark.conf.set(conf, rows_in_slice)
    try:
        got = [tuple(r) for r in suffixes.digests(suffixes.dedup(df, 2)).collect()]
    finally:
        spark.conf.set(conf, before)
    assert sorted(got) == sorted(byte_dedup(rows))


def test_levels_meet_by_merging_files(spark):
    index = suffixes.Levels(spark)
    docs = spark.createDataFrame(planted(9), "u long, t string").fillna("")
    for b in range(3):
        index.insert(docs.where(F.col("u") % 3 == b))
    (_, a), (_, b) = index.runs
    keys = a.select("key").join(b.select("key").hint("merge"), "key", "left_semi")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    names = set(index.tables.values())
    index.close()
    assert len(names) == len(index.tables) + 7 and not names & {t.name for t in spark.catalog.listTables()}


def test_a_bucket_is_one_file(spark, monkeypatch):
    """Also where the session deals to more partitions than asked for."""
    frame = type(spark.range(1))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(n, 61), *cols))
    index = suffixes.Levels(spark)
    docs = spark.createDataFrame(planted(9), "u long, t string").fillna("")
    for b in range(3):
        index.insert(docs.where(F.col("u") % 3 == b))
    for run in [r for _, r in index.runs] + index.marks:
        assert len(run.inputFiles()) <= index.buckets
    index.close()
