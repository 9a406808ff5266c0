"""Subtree totals of a forest by centroid decomposition.

A forest is held as paths: each node belongs to one owner, is named (owner, depth),
and every owner's path from its root down to its last node is there as rows. That
is what a trie gives for free (an owner is a sequence, its path its prefixes), and
it answers the one question a split asks: on which side of the centroid is a node?

Each round splits every component at its centroid, the deepest node that holds at
least half of the component's nodes (counted downwards from its top). The nodes
that hold at least half are exactly the path from the centroid to the top. The total
of the centroid's side is summed once and added to every node of that path; then the
centroid goes, its children's subtrees and the rest above become components of
their own, none larger than half. A node is the total of what it was given, so the
depth of the forest does not matter: a chain of n nodes takes log2(n) rounds.

While a component has more than ``WHOLE`` nodes its rounds are Spark jobs over all
such components at once. Smaller ones are dealt to tasks and go through the same rounds
as arrays, many at a time; a task holds no more than ``BATCH`` nodes and one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import stored

WHOLE = 1024            # nodes of a component that one task takes whole
BATCH = 1 << 17         # nodes that are decomposed at once in a task


def halves(parent: np.ndarray, top: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals (nodes, columns) of a forest in arrays, by the same rounds.

    ``parent``: index of the parent, a root's own index; ``top``: index of the root;
    ``size``: nodes of the subtree; ``values``: what is summed.
    """
    parent, top, size = parent.copy(), top.copy(), size.copy()
    out = np.zeros_like(values)
    live = np.arange(len(parent))
    while len(live):
        t, total = top[live], size[top[live]]
        on_path = live[2 * size[live] >= total]
        # the centroid is the smallest of its component's path
        order = on_path[np.lexsort((size[on_path], top[on_path]))]
        centroid = np.full(len(parent), -1)
        heads = np.ones(len(order), bool)
        heads[1:] = top[order][1:] != top[order][:-1]
        centroid[top[order[heads]]] = order[heads]
        z = centroid[t]
        # cut above each centroid, then each node's root tells its side
        jump = parent.copy()
        jump[z] = z
        while True:
            further = jump[jump[live]]
            if np.array_equal(further, jump[live]):
                break
            jump[live] = further
        below = jump[live] == z
        side = np.zeros_like(values)
        np.add.at(side, z[below], values[live[below]])
        out[on_path] += side[centroid[top[on_path]]]
        above = on_path[on_path != centroid[top[on_path]]]
        size[above] -= size[centroid[top[above]]]
        # the children of a centroid are tops now, their subtrees components
        child = live[(parent[live] == z) & (live != z)]
        parent[child] = child
        jump = parent.copy()
        while True:
            further = jump[jump[live]]
            if np.array_equal(further, jump[live]):
                break
            jump[live] = further
        top[live] = np.where(below, jump[live], top[live])
        live = live[live != z]
    return out


def _whole(columns: list[str]):
    kind = pa.schema([("node", pa.int64()), ("depth", pa.int64()), *((c, pa.int64()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def totals(table: pa.Table) -> Iterator[pa.RecordBatch]:
            g = {c: table[c].to_numpy() for c in table.column_names}
            names, width = np.unique(g["node"]), int(g["depth"].max()) + 1
            number = lambda n, d: np.searchsorted(names, n) * width + d
            key = number(g["node"], g["depth"])
            order = np.argsort(key)
            at = lambda n, d: order[np.searchsorted(key, number(n, d), sorter=order)]
            is_top = (g["node"] == g["top"]) & (g["depth"] == g["top_depth"])
            parent = np.arange(len(key))
            parent[~is_top] = at(g["parent"][~is_top], g["depth"][~is_top] - 1)
            sums = halves(parent, at(g["top"], g["top_depth"]), g["size"], np.stack([g[c] for c in columns], 1))
            yield pa.record_batch([g["node"], g["depth"], *sums.T], schema=kind)

        for batch in batches:                   # in the order of the tops
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                table = pa.Table.from_batches(held)
                last = [table[c][-1].as_py() for c in ("top", "top_depth")]
                cut = rows
                while cut and [table[c][cut - 1].as_py() for c in ("top", "top_depth")] == last:
                    cut -= 1                    # the last component may go on: at most WHOLE nodes
                if cut:
                    yield from totals(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if rows:
            yield from totals(pa.Table.from_batches(held).combine_chunks())

    return run, "node long, depth long, " + ", ".join(f"{c} long" for c in columns)


def subtree_totals(paths: DataFrame, columns: list[str], whole: int | None = None) -> DataFrame:
    """(node, depth, columns): each node's total of ``columns`` over its subtree.

    ``paths`` (owner, depth, node, parent, size, columns): for every owner the nodes
    from its root (the least depth) down, each with its parent's name, the number of
    nodes in its subtree and its values. A node is (node, depth); its own row is the one
    with owner = node.
    """
    whole = WHOLE if whole is None else whole
    root = paths.groupBy("owner").agg(F.min_by(F.struct(F.col("node").alias("top"), F.col("depth").alias("top_depth"), F.col("size").alias("total")), "depth").alias("r"))
    live = stored(paths.join(root, "owner").select(*paths.columns, "r.*"), "forest")
    small, added = [], []
    own = F.col("owner") == F.col("node")
    while True:
        small.append(live.where(own & (F.col("total") <= whole)))
        live = live.where(F.col("total") > whole)
        if live.isEmpty():
            break
        on_path = 2 * F.col("size") >= F.col("total")
        z = (live.where(own & on_path).groupBy("top", "top_depth")
             .agg(F.min_by(F.struct(F.col("node").alias("z"), F.col("depth").alias("z_depth"), F.col("size").alias("z_size")), "size").alias("c"))
             .select("top", "top_depth", "c.*"))
        rows = live.join(z, ["top", "top_depth"])
        hit = (F.col("node") == F.col("z")) & (F.col("depth") == F.col("z_depth"))
        child = F.struct(F.col("node").alias("new_top"), F.col("depth").alias("new_depth"), F.col("size").alias("new_total"))
        sides = (rows.where((F.col("depth") == F.col("z_depth")) | (F.col("depth") == F.col("z_depth") + 1))
                 .groupBy("owner", "top", "top_depth")
                 .agg(F.max(hit).alias("through"), F.max(F.when(F.col("depth") == F.col("z_depth") + 1, child)).alias("child")).where("through"))
        rows = stored(rows.join(sides, ["owner", "top", "top_depth"], "left")
                      .withColumn("below", F.coalesce("through", F.lit(False)) & (F.col("depth") >= F.col("z_depth"))), "split")
        hit = (F.col("node") == F.col("z")) & (F.col("depth") == F.col("z_depth"))
        side = rows.where(own & F.col("below")).groupBy("top", "top_depth").agg(*(F.sum(c).alias(c) for c in columns))
        path = rows.where(own & on_path).select("top", "top_depth", "node", "depth")
        added.append(path.join(side, ["top", "top_depth"]).select("node", "depth", *columns))
        down, shrunk = F.col("below"), ~F.col("below") & on_path
        live = stored(rows.where(~hit).select(
            "owner", "depth", "node", "parent", F.when(shrunk, F.col("size") - F.col("z_size")).otherwise(F.col("size")).alias("size"), *columns,
            F.when(down, F.col("child.new_top")).otherwise(F.col("top")).alias("top"),
            F.when(down, F.col("child.new_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
            F.when(down, F.col("child.new_total")).otherwise(F.col("total") - F.col("z_size")).alias("total")), "forest")
    run, schema = _whole(columns)
    local = reduce(DataFrame.unionByName, (part.select("top", "top_depth", "node", "depth", "parent", "size", *columns) for part in small))
    out = local.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth").mapInArrow(run, schema)
    return reduce(DataFrame.unionByName, added, out).groupBy("node", "depth").agg(*(F.sum(c).cast("long").alias(c) for c in columns))
