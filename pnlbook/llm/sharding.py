"""Sharding by fixed virtual slots with a versioned slot-to-shard map.

Every record hashes into one of ``SLOTS`` virtual slots and stays there for
good. Rows and bytes are aggregated per slot. A map gives each slot its shard;
a rebalance edits the map (moves or swaps of whole slots) until the shards'
bytes are near equal and stores it as the next version, so only the records of
the moved slots change place. The slot table has a fixed number of rows, which
is all that the driver ever holds.

Law ``bytes``: the shards' sizes are near equal (as near as whole slots
allow). Records are spread by ``doc_id`` and text together, so one repeated
``doc_id`` does not fill one slot. Rows equal in both are numbered, and each but
the first is spread by its number as well: how many of them a slot holds is the
same in every run, only which of the equal rows are there can change.

Edge cases: a null text counts one byte (and has the checksum of no bytes), a
null ``doc_id`` hashes like any value, an empty table gives an empty result and
a map of even slot counts, repeated rows are each placed and numbered. Input
columns named like the results are replaced; other columns pass through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import stored

SLOTS = 4096
CELLS = 16          # numbering cells per slot: windows over rows stay small
RUN = 12            # equal rows are numbered in runs of 2**RUN rows of a partition
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")
OWN = ("cell", "_key", "_row", "_copy", "_run", "_start")     # columns of the steps


def copy_numbers(df: DataFrame) -> DataFrame:
    """Adds ``_copy``, 0, 1, 2 ... within the rows of equal ``_key``; ``df`` is
    stored with its ``_row``. No window holds more than a run's rows of a key, or
    one row for each run of a key."""
    df = df.withColumn("_run", F.shiftright("_row", RUN))
    before = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy("_key", "_run").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_start", F.sum("n").over(before)).where("_start > 0").drop("n"))
    inside = Window.partitionBy("_key", "_run").orderBy("_row")
    df = df.withColumn("_copy", F.row_number().over(inside) - 1).join(starts, ["_key", "_run"], "left")
    return df.withColumn("_copy", F.col("_copy") + F.coalesce("_start", F.lit(0))).drop("_run", "_start", "_row")


def with_slot(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Replaces the text by ``virtual_slot``, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and the numbering cell; stored."""
    df = df.drop(*(c for c in df.columns if c in RESULT or c in OWN))
    text = F.encode(F.coalesce(df["text"].cast("string"), F.lit("")), "UTF-8")
    df = (df.withColumn("size", F.octet_length(text).cast("long") + 1)
          .withColumn("text_crc32", F.crc32(text).cast("long")).drop("text")
          .withColumn("_key", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("_row", F.monotonically_increasing_id()))
    df = copy_numbers(stored(df, "sized"))
    again = lambda first: F.when(F.col("_copy") == 0, first).otherwise(F.xxhash64(first, "_copy"))
    df = (df.withColumn("virtual_slot", F.pmod(again(F.col("_key")), F.lit(slots)).cast("int"))
          .withColumn("cell", F.pmod(again(F.xxhash64("size", "doc_id", "virtual_slot")), F.lit(CELLS)).cast("int")))
    return stored(df.drop("_key", "_copy"), "slotted")


def slot_bytes(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each (slot, cell): at most SLOTS x CELLS rows."""
    return placed.groupBy("virtual_slot", "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt out in turn, before anything is known of sizes."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    """Edits a map until no single move or swap of slots between the fullest
    and the emptiest shard brings them closer. Slots not named stay put."""
    out = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(out):
        held[shard].append((weight[slot], slot))
        load[shard] += weight[slot]
    for _ in range(8 * len(out)):
        full, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[low]
        if gap <= 1:
            break
        # the change d nearest to gap / 2: a move (partner weighs 0) or a swap
        best = _nearest_change(sorted(held[full]), [(0, -1), *sorted(held[low])], gap)
        if best is None:
            break
        (w, a), (v, b) = best
        held[full].remove((w, a))
        held[low].append((w, a))
        out[a] = low
        if b >= 0:
            held[low].remove((v, b))
            held[full].append((v, b))
            out[b] = full
        load[full] -= w - v
        load[low] += w - v
    return out


def _nearest_change(mine: list, theirs: list, gap: int):
    """Of pairs with 0 < w - v < gap, one whose difference is nearest to gap / 2 (two pointers)."""
    best, score, j = None, gap, 0
    for m in mine:
        while j + 1 < len(theirs) and m[0] - theirs[j + 1][0] >= gap / 2:
            j += 1
        for t in theirs[j:j + 2]:
            d = m[0] - t[0]
            if 0 < d < gap and abs(gap - 2 * d) < score:
                best, score = (m, t), abs(gap - 2 * d)
    return best


def fresh_map(weight: list[int], shards: int) -> list[int]:
    """A map made from sizes alone: heaviest slot first, to the emptiest shard."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(weight)
    for slot in sorted(range(len(weight)), key=lambda s: (-weight[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weight[slot], shard))
    return out


def store_map(spark: SparkSession, path: str, shard_of: list[int], version: int) -> None:
    """Writes one version of the map below ``path``; a version that is there already is refused."""
    rows = [(slot, shard) for slot, shard in enumerate(shard_of)]
    (spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1)
     .write.mode("errorifexists").parquet(f"{path}/map_version={version}"))


def latest_map(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last stored version and its shards by slot; 0 and none if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0, []
    rows = load_map(spark, path).orderBy("virtual_slot").collect()          # one row per slot
    return rows[0]["map_version"], [r["shard"] for r in rows]


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map (the latest by default)."""
    maps = spark.read.parquet(path)
    version = version if version is not None else maps.agg(F.max("map_version")).first()[0]
    return maps.where(F.col("map_version") == version)


def assign(placed: DataFrame, shard_map: DataFrame, stats: DataFrame) -> DataFrame:
    """Gives every row its shard and its place ``slot`` in the shard (gapless from 0).

    Places come from per-cell counts: a running sum over the cells of a shard
    (SLOTS x CELLS rows in all) plus the row's number in its own cell, so no
    window holds a shard's rows. Both small tables have a fixed number of rows.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (stats.join(F.broadcast(shard_map), "virtual_slot")
              .select("virtual_slot", "cell", "shard", "map_version",
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32")
    return (placed.withColumn("in_cell", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), ["virtual_slot", "cell"])
            .withColumn("slot", (F.col("start") + F.col("in_cell")).cast("long"))
            .drop("in_cell", "start", "cell"))


def shard_documents(docs: DataFrame, path: str, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Places all rows of ``docs`` into ``shards`` shards by bytes.

    The last map stored at ``path`` is edited by moves and swaps of single slots and
    written as the next version, if anything moved; records of other slots stay where
    they are. Where none is stored yet, version 1 is made from even slot counts, or, if
    edits of it get stuck on a few heavy slots, from the sizes. Returns the rows with the
    columns of ``RESULT``; the text is not moved.
    """
    spark = docs.sparkSession
    placed = with_slot(docs, slots)
    stats = slot_bytes(placed)
    weight = [0] * slots
    for r in stats.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect():   # one row per slot
        weight[r["virtual_slot"]] = r["bytes"]
    version, current = latest_map(spark, path)
    if not version:
        version, current = 1, even_map(shards, slots)
        spread = lambda m: _spread(m, weight, shards)
        if spread(edited := rebalance(current, weight, shards)) > 0.001 * sum(weight) / shards and spread(fresh := fresh_map(weight, shards)) < spread(edited):
            current = fresh
        store_map(spark, path, current, version)
    if len(current) != slots or max(current) >= shards:
        raise ValueError(f"the map at {path} is for {len(current)} slots and {max(current) + 1} shards")
    edited = rebalance(current, weight, shards)
    if edited != current:
        version += 1
        store_map(spark, path, edited, version)
    out = assign(placed, load_map(spark, path, version), stats)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def _spread(shard_of: list[int], weight: list[int], shards: int) -> int:
    load = [0] * shards
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
    return max(load) - min(load)
