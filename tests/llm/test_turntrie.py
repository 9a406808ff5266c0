"""Subtree totals by centroids, and the conversation trie, against plain walks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pnlbook.llm import forest, turntrie


def random_parents(rng, n, kind):
    if kind == "chain":
        return [max(0, k - 1) for k in range(n)]
    if kind == "star":
        return [0] * n
    if kind == "broom":                              # a chain with a star at its end
        return [max(0, min(k - 1, n // 2)) for k in range(n)]
    return [rng.randrange(k) if k and rng.random() > 0.02 else k for k in range(n)]


def plain_totals(parents, values):
    out = list(values)
    for k in range(len(parents) - 1, -1, -1):        # children come after their parents
        if parents[k] != k:
            out[parents[k]] += out[k]
    return out


@pytest.mark.parametrize("kind", ["chain", "star", "broom", "random"])
def test_halves(kind):
    rng = random.Random(kind)
    for n in (1, 2, 3, 7, 64, 1000):
        parents = random_parents(rng, n, kind)
        values = [rng.randrange(1000) for _ in range(n)]
        top = list(range(n))
        for k in range(n):
            top[k] = k if parents[k] == k else top[parents[k]]
        shuffled = rng.sample(range(n), n)           # the order of the nodes does not matter
        place = np.argsort(shuffled)
        pick = lambda x: np.array([x[k] for k in shuffled])
        sums = forest.halves(place[pick(parents)], place[pick(top)], pick(plain_totals(parents, [1] * n)), pick(values)[:, None])
        assert sums[:, 0].tolist() == pick(plain_totals(parents, values)).tolist()


def as_paths(parents, values):
    """Owners and their paths: each node goes on with its owner's chain at its first child."""
    n = len(parents)
    depth, owner, seen = [1] * n, list(range(n)), set()
    for k in range(n):
        p = parents[k]
        if p != k:
            depth[k] = depth[p] + 1
            if p not in seen:
                owner[k] = owner[p]
                seen.add(p)
    size = plain_totals(parents, [1] * n)
    last = {}
    for k in range(n):
        last[owner[k]] = k
    rows = []
    for o, k in last.items():
        while True:
            own = owner[k] == o
            rows.append((o, owner[k], depth[k], owner[parents[k]] if parents[k] != k else None, size[k], values[k] if own else None, 1 if own else None))
            if parents[k] == k:
                break
            k = parents[k]
    return rows, {(owner[k], depth[k]): k for k in range(n)}


@pytest.mark.parametrize("kind", ["chain", "broom", "random"])
def test_subtree_totals_in_rounds(spark, kind, monkeypatch):
    monkeypatch.setattr(forest, "BATCH", 16)
    rng = random.Random(kind)
    parents = random_parents(rng, 90, kind)
    values = [rng.randrange(1000) for _ in range(90)]
    rows, nodes = as_paths(parents, values)
    paths = spark.createDataFrame(rows, "owner LONG, node LONG, depth LONG, parent LONG, size LONG, v LONG, one LONG")
    got = forest.subtree_totals(paths, ["v", "one"], whole=8).collect()
    want, sizes = plain_totals(parents, values), plain_totals(parents, [1] * 90)
    assert {(r.node, r.depth): (r.v, r.one) for r in got} == {key: (want[k], sizes[k]) for key, k in nodes.items()} and len(got) == 90
    assert forest.subtree_totals(paths.limit(0), ["v", "one"]).count() == 0


def plain_trie(rows):
    """Every node of rows (conv_id, turn, role, text), by following each conversation."""
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
        own = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        leaves[key], saved[key] = leaves.get(key, 0) or 1, saved.get(key, 0) + own
        if key:
            leaves[key[:-1]] = leaves.get(key[:-1], 0) + leaves[key]
            saved[key[:-1]] = saved.get(key[:-1], 0) + saved[key]
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()), key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_on_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "CHUNK", 4)
    monkeypatch.setattr(turntrie, "END_RUN", 3)
    rng = random.Random(13)
    rows = []
    for c in [*range(-12, 90), 10_000, 10_001, 10_002]:
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é" * 20])))
    rows += [(5, None, None, None), (5, None, "user", None), (6, 3, "user", "tie"), (6, 3, "user", "tie"), (6, 3, "assistant", "tie"), (None, 0, "user", "lost")]
    rows += [(200, k, "user", str(k % 3)) for k in range(150)] + [(201, 1, "user", "same")] * 60       # a third of all rows in one conversation, and equal rows
    rows += [(300 + k, 0, "user", "hello") for k in range(40)] + [(400, 0, "user", "long " * 200_000), (401, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, depth INT, node STRING")
    got = turntrie.trie(df, whole=16)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id LONG, turn LONG, role STRING, text STRING"
    assert turntrie.trie(spark.createDataFrame([], schema)).count() == 0
    assert turntrie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    assert zlib.crc32(b"401") % 9                    # its only turn is replaced by an opening that nobody lends
    (row,) = turntrie.trie(spark.createDataFrame([(401, 0, "user", "x")], schema)).collect()
    assert tuple(row) == (401, 0, None, 1, 0, 1, 0, hashlib.sha256(b"401").hexdigest())
