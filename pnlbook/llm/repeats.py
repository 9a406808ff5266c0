"""Shared steps of the operators that look for equal passages.

A pass over the texts makes rows (key, u, pos): text ``u`` has the passage with
fingerprint ``key`` at ``pos``. ``settle`` brings equal keys together in one
shuffle. Before it, every Python slice combines its own rows (``combine``): of
the texts of a slice that share a key one goes on, the others are settled
already and travel under a key of their own. So a passage held by a third of
all texts has at most one row for each slice in any group.

``u`` numbers the texts; it is ``doc_id`` itself where that is an integer
without nulls and repeats, else a number in the order of ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType

from pnlbook.session import scratch_dir

from .textarrays import mix, signed

_U = np.uint64
# Spark deletes a query's shuffle files when the query has ended
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, so the shuffle
    files behind it are released with the query that wrote it. A table of
    a known number of ``rows`` goes into as few files as it needs."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(RELEASE_CONF, None)
    spark.conf.set(RELEASE_CONF, "true")
    try:
        (df if rows is None else df.coalesce(4 + rows // 100_000)).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(RELEASE_CONF)
        else:
            spark.conf.set(RELEASE_CONF, before)
    return spark.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read any more."""
    for df in tables:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


@dataclass
class Identified:
    """``texts``: (u, d, copies, doc_id, t), one row for each distinct (doc_id, text);
    ``u`` is unique and rises with ``doc_id`` (nulls last), ``d`` is the first ``u``
    of the same ``doc_id``, ``copies`` counts equal rows, ``t`` is the text, null as
    empty. ``rows``: (u, row), every input row. ``unique``: no row is repeated."""
    texts: DataFrame
    rows: DataFrame
    unique: bool


def identify(docs: DataFrame) -> Identified:
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    df = docs.select("doc_id", t.alias("t"), F.struct(*docs.columns).alias("row"))
    if isinstance(df.schema["doc_id"].dataType, (LongType, IntegerType, ShortType)):
        n, some, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
        if n == some == distinct:
            u = F.col("doc_id").cast("long")
            return Identified(df.select(u.alias("u"), u.alias("d"), F.lit(1).cast("long").alias("copies"), "doc_id", "t"), df.select(u.alias("u"), "row"), True)
    keyed = df.withColumn("h", F.sha2(F.encode("t", "UTF-8"), 256))
    ids = (keyed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
           .orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("u", F.monotonically_increasing_id()))
    ids = stored(ids, "ids")                # in the order of ids, and fixed from here on
    ids = ids.withColumnsRenamed({"doc_id": "id_", "h": "h_"})
    firsts = ids.groupBy(F.col("id_").alias("first_")).agg(F.min("u").alias("d"))       # joined back: an id of a third of the rows is in no single task
    ids = ids.join(firsts, F.col("id_").eqNullSafe(F.col("first_"))).drop("first_")
    rows = keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["id_"]) & (F.col("h") == F.col("h_")))
    texts = rows.dropDuplicates(["u"]).select("u", "d", "copies", "doc_id", "t")
    return Identified(stored(texts, "texts"), rows.select("u", "row"), False)


def identified(docs: DataFrame) -> DataFrame:
    """The distinct texts of ``docs`` (see ``Identified``)."""
    return identify(docs).texts


def with_first(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """``df`` with ``rep``, the smallest u of its ``key`` (and further aggregates).

    A grouped minimum, reduced before the shuffle, joined back: a key that a third
    of the rows share is split by the skew join, where a window would hold it in
    one task. ``df`` is read twice, so it should be a stored table.
    """
    return df.join(df.groupBy(key).agg(F.min("u").alias("rep"), *more), key)


def lone(u: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key that no other row has, for rows that are settled."""
    return mix(mix(u.astype(np.uint64)) + pos.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def combine(key: np.ndarray, u: np.ndarray, pos: np.ndarray, *, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, known) of a slice's rows, some of them settled.

    Without ``across``, two places with one key settle each other. With it, a
    row is settled by a smaller ``u`` than its own ``across`` (its document's
    first number); every row of the smallest ``u`` goes on.
    """
    order = np.lexsort((pos, u, key))
    k, v = key[order], u[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))     # where each row's key begins
    known = np.zeros(len(k), bool)
    goes_on = first.copy()
    if across is None:
        known[1:] = ~first[1:]
        known[:-1] |= ~first[1:]
    else:
        known = v[head] < across[order]
        goes_on = ~known
    out_key, out_known = key.copy(), np.zeros(len(key), bool)
    out_known[order] = known
    moved = order[~goes_on]
    out_key[moved] = lone(u[moved], pos[moved])
    return out_key, out_known


def settle(rows: DataFrame) -> DataFrame:
    """rows (key, u, pos, known, ...) with ``lo`` = the smallest u of the key and ``n`` = its rows."""
    by = Window.partitionBy("key")
    return rows.withColumn("lo", F.min("u").over(by)).withColumn("n", F.count(F.lit(1)).over(by))


__all__ = ["Identified", "combine", "dropped", "identified", "identify", "lone", "settle", "signed", "stored", "with_first"]
