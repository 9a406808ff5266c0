"""Slots, maps and places."""

import os
import random
import zlib

import pytest
from pyspark.errors import AnalysisException

from pnlbook.llm import sharding
from pnlbook.session import scratch_dir


def test_rebalance_moves_few_slots_and_evens_bytes():
    rnd = random.Random(2)
    weight = [0] * sharding.SLOTS
    for _ in range(20_000):
        weight[rnd.randrange(sharding.SLOTS)] += int(rnd.lognormvariate(7, 1.2))
    old = sharding.even_map(16)
    new = sharding.rebalance(old, weight, 16)
    load = [0] * 16
    for slot, shard in enumerate(new):
        load[shard] += weight[slot]
    assert max(load) - min(load) < 0.001 * sum(load) / 16
    assert sum(a != b for a, b in zip(old, new, strict=True)) < sharding.SLOTS / 10


@pytest.mark.parametrize("rows", [[], [(1, "é", "x")], [(k, "t" * (k % 50), "x") for k in range(300)] + [(None, None, "x"), (None, None, "x"), (7, None, "x"), (7, "", "x")]])
def test_documents_are_placed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, shard STRING")
    got = sharding.shard_documents(df, scratch_dir(spark, "map")).collect()
    data = lambda t: (t or "").encode()
    want = sorted((i is None, i or 0, len(data(t)) + 1, zlib.crc32(data(t))) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("i", [None, 5])
def test_equal_rows_are_spread(spark, monkeypatch, i):
    monkeypatch.setattr(sharding, "RUN", 6, raising=False)
    df = spark.range(4000).selectExpr("id + 10 AS doc_id", "repeat('t', 100) AS text")
    df = df.unionAll(spark.range(2000).selectExpr(f"CAST({'NULL' if i is None else i} AS LONG)", "repeat('x', 100)"))
    runs = []
    for parts in (3, 7):
        got = sharding.shard_documents(df.repartition(parts), scratch_dir(spark, "map")).collect()
        load, places, copies = [0] * 16, {}, []
        for r in got:
            load[r.shard] += r.size
            places.setdefault(r.shard, []).append(r.slot)
            if r.doc_id == i:
                copies.append(r.virtual_slot)
        assert len(got) == 6000 and len(copies) == 2000 and max(copies.count(s) for s in set(copies)) < 10
        assert max(load) - min(load) <= 0.03 * sum(load) / 16
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        runs.append(sorted(((r.doc_id or 0), r.virtual_slot) for r in got))
    assert runs[0] == runs[1]


def test_versions_are_kept(spark):
    path = scratch_dir(spark, "map")
    sharding.store_map(spark, path, sharding.even_map(4, 8), 1)
    sharding.store_map(spark, path, [0] * 8, 2)
    assert {r.shard for r in sharding.load_map(spark, path).collect()} == {0}
    assert {r.shard for r in sharding.load_map(spark, path, 1).collect()} == {0, 1, 2, 3}


def test_a_living_map(spark, tmp_dir):
    """New rows edit the last stored map; a repeated call changes nothing; a version is written once."""
    path = os.path.join(tmp_dir, "living")
    rows = [(k, "x" * (k * 37 % 400)) for k in range(300)]
    schema = "doc_id LONG, text STRING"

    def place(some):
        got = sharding.shard_documents(spark.createDataFrame(some, schema), path, shards=4, slots=64).collect()
        assert len(got) == len(some)
        return {r.doc_id: (r.virtual_slot, r.shard) for r in got}, sharding.latest_map(spark, path)

    first, (one, map_one) = place(rows)
    again, (same, map_same) = place(rows)
    assert again == first and (one, map_one) == (same, map_same)
    more = rows + [(1000 + k, "y" * 900) for k in range(40)]
    second, (two, map_two) = place(more)
    moved = {s for s in range(64) if map_one[s] != map_two[s]}
    assert two == one + 1 and moved and len(moved) < 32
    assert all(second[k] == first[k] for k in first if first[k][0] not in moved)
    third, (three, map_three) = place(more + [(5000, "z" * 3000)])
    assert three in (two, two + 1) and sum(a != b for a, b in zip(map_two, map_three, strict=True)) < 32
    with pytest.raises(AnalysisException):
        sharding.store_map(spark, path, map_one, 1)
    with pytest.raises(ValueError, match="64 slots"):
        sharding.shard_documents(spark.createDataFrame(rows, schema), path, shards=4, slots=32)
