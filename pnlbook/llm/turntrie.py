"""Conversation prefix trie: shared openings of conversations, rolled up per node.

``rebuilt`` makes the conversations (own turns after an opening lent by another
one); ``prefixes`` gives every first d turns a 128-bit key, the running xor of two
64-bit hashes of (place, role, text), so a key needs no walk along the sequence and
a long conversation is dealt in chunks. ``trie`` groups equal keys of one depth
into nodes. A node is named by its smallest member and its depth: below a
node that a conversation owns it owns the rest of its own path, so the trie is a set
of chains, and ``forest.subtree_totals`` rolls leaves and saved bytes up the
parent edges by centroid decomposition. The root is kept apart; its subtree is
the whole forest.

Hot keys: turns are numbered by a sort on all columns, so a conversation of any
length spreads over tasks; a common opening is one node, counted before the
shuffle and joined back by the skew join; the ids that end at a node become strings of
``END_RUN`` ids where they were sorted, and only those go to the one task that must
feed them to SHA-256 in order, a batch at a time.

Edge cases: turns are ordered by turn (null first), then role, then text; null role
or text is empty; equal rows are so many equal turns; rows without a conv_id belong to no
conversation and are left out; a conversation left without turns is a member of the
root alone; an empty table has no nodes, not even a root. Only ``conv_id``, ``turn``, ``role`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import subtree_totals
from .repeats import stored

CHUNK = 256             # turns of one window
END_RUN = 512           # ids in one string on their way to the digest
MOST_LENT = 8           # the longest opening that is lent
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, a, b, bytes): the turns of each conversation, numbered from 1,
    their contents as two hashes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("t"), F.monotonically_increasing_id().alias("place"))
            .orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "t", "place"))
    rows = stored(rows.select("conv_id", F.xxhash64("role", "t").alias("a"), F.xxhash64("t", F.lit(1), "role").alias("b"),
                              F.octet_length("t").cast("long").alias("bytes"),
                              F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "turns")
    # a conversation's rows stand together, in one sorted part or several in turn
    spans = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("start") + 1).alias("shift"))
    return rows.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("idx"), "a", "b", "bytes")


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, base, h, lent, n): where each conversation's opening comes from, how
    many turns it lends, and how many turns the rebuilt one has."""
    sizes = turns.groupBy("conv_id").agg(F.max("idx").alias("own"))
    convs = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)).alias("h"))
    lenders = sizes.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    return convs.join(lenders, "base", "left").select(
        "conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, n, a, b, bytes): the rebuilt conversations' turns. A turn is
    lent to at most nine conversations."""
    own = turns.join(convs, "conv_id").where("idx > h").select("conv_id", (F.col("idx") - F.col("h") + F.col("lent")).alias("depth"), "n", "a", "b", "bytes")
    first = turns.where((F.col("idx") <= MOST_LENT) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    lent = first.join(convs, "base").where("idx <= h").select("conv_id", F.col("idx").alias("depth"), "n", "a", "b", "bytes")
    return own.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n, bytes, k1, k2): the key of each conversation's first ``depth`` turns."""
    term = lambda seed: F.xxhash64(F.lit(seed), "depth", "a", "b")
    rows = turns.select("conv_id", "depth", "n", "bytes", term(1).alias("t1"), term(2).alias("t2"), F.floor(F.col("depth") / CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"w1": F.bit_xor("t1").over(inside), "w2": F.bit_xor("t2").over(inside)})
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    carry = sums.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"s{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    return rows.join(carry, ["conv_id", "chunk"]).select("conv_id", "depth", "n", "bytes", *(F.col(f"w{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"k{k}") for k in (1, 2)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, conv_id) to strings of ids, a run each."""
    kind = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        out, key, ids = [], None, []
        for node, depth, conv in zip(*(batch[c].to_pylist() for c in ("node", "depth", "conv_id")), strict=True):
            if key != (node, depth) or len(ids) == END_RUN:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (node, depth), []
            ids.append(conv)
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield pa.record_batch([pa.array([r[k] for r in out], kind.field(k).type) for k in range(4)], schema=kind)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of ids to one digest a node; the state goes on from batch to batch."""
    kind = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    made = lambda rows: pa.record_batch([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(3)], schema=kind)
    key = state = None
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(batch[c].to_pylist() for c in ("node", "depth", "ids")), strict=True):
            if key == (node, depth):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (node, depth), hashlib.sha256(ids.encode())
        yield made(out)
    if key is not None:
        yield made([(*key, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the conversations (node, depth, conv_id) that end at a node."""
    order = ["node", "depth", "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "node long, depth long, first long, ids string")
    return (runs.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
            .mapInArrow(_digests, "node long, depth long, ends_sha256 string"))


def trie(conversations: DataFrame, whole: int | None = None) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    turns = stored(numbered(conversations), "numbered")
    convs = stored(members(turns), "members")
    keys = stored(prefixes(rebuilt(turns, convs)), "prefixes")
    found = keys.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    path = stored(keys.drop("bytes").join(found, ["depth", "k1", "k2"]).select("conv_id", "depth", "n", "node", "n_convs", "bytes"), "paths")

    # each owner's first own depth, and whose chain it hangs on
    mine = F.col("node") == F.col("conv_id")
    owners = path.groupBy("conv_id").agg(F.min(F.when(mine, F.col("depth"))).alias("from_depth"),
                                         F.max_by(F.when(~mine, F.col("node")), F.when(~mine, F.col("depth"))).alias("hangs_on")).where("from_depth is not null")
    rows = stored(path.join(owners, "conv_id"), "owners")
    own = rows.where(mine).select("node", "depth", F.when(F.col("depth") > F.col("from_depth"), F.col("node")).otherwise(F.col("hangs_on")).alias("parent"), "n_convs",
                                  ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sizes = rows.groupBy("node", "depth").agg(F.sum(F.col("n") - F.greatest("depth", "from_depth") + 1).alias("size"))
    kids = own.where("depth > 1").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(own.join(sizes, ["node", "depth"]).join(kids, ["node", "depth"], "left")
                   .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                   .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    paths = rows.select(F.col("conv_id").alias("owner"), "node", "depth").join(nodes.select("node", "depth", "parent", "size", "n_leaves", "saved_tokens"), ["node", "depth"])
    totals = stored(subtree_totals(paths, ["n_leaves", "saved_tokens"], whole), "totals")

    root = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")).first()
    tops = nodes.where("depth = 1").join(totals.withColumnsRenamed({"n_leaves": "leaves", "saved_tokens": "saved"}), ["node", "depth"]).agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    top = tops.select(F.lit(root.node).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
                      F.lit(root.n_convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens").where(F.lit(root.n_convs > 0))
    below = nodes.drop("size", "n_leaves", "saved_tokens").join(totals, ["node", "depth"])
    below = below.withColumn("parent", F.when(F.col("depth") == 1, F.lit(root.node)).otherwise(F.col("parent")))
    last = path.where("depth = n").select("node", "depth", "conv_id").unionByName(
        convs.where("n = 0").select(F.lit(root.node).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    whole_trie = below.unionByName(top).join(end_digests(last), ["node", "depth"], "left")
    return whole_trie.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                             F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
