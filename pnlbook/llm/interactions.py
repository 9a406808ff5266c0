"""Filter interaction audit: what each filter removes, alone and in any order.

``measured`` reads every text once and writes, for each row, the bits of the
filters that judge a text alone (A to D) and a 64-bit hash of the text. The
filter that needs other rows (E: a row of a smaller doc_id has the same text) is an
existential self-join: ``copies`` is a left semi join on hash, exact text and
smaller doc_id. Only texts whose hash comes under several doc_ids enter it, and its
right side is one row, the smallest doc_id, for each distinct text, so a group of
copies costs one probe for each row; the skew join splits a hot group.

``failures`` unites the ids that fail E with the other filters' and sums up the
bits of each id. ``combinations`` counts the rows by part, bits and labels: at most
32 * 4 rows for a part. Every figure of every filter order (``audit``) comes from
those counts; the texts are read twice, whatever the number of orders.

A row is known by (doc_id, hash), as all filters depend on doc_id and text alone.

Edge cases: a null text is empty (it fails A, and E as any other text); a null
doc_id is smaller than none and never fails E; rows equal in doc_id and text count
each, and neither makes the other a copy; a null lang is the empty part; labels
may name a doc_id several times (one hit is enough) or not at all; an
empty table gives no rows. Only ``doc_id``, ``text``, ``lang`` and the labels' doc_id,
``quality`` and ``toxic`` are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pnlbook.plans.joins import bounded_broadcast

from .repeats import stored

FILTERS = "ABCDE"
SPACES = "[ \\x09-\\x0D]+"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}


def own_bits(text: Column) -> Column:
    """The bits of the filters that a text fails by itself."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    # the array is named once in a struct, so that it is not built again for each use
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("unlike")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {"A": counts["all"] < 100, "B": 100 * counts["unlike"] < 80 * counts["all"],
              "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(c, BIT[f]).otherwise(0) for f, c in failed.items()), F.lit(0))


def texts(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), t.alias("t"), F.xxhash64(t).alias("h"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, bits) of every row."""
    return texts(docs).select("doc_id", "part", "h", own_bits(F.col("t")).alias("bits"))


def copies(docs: DataFrame, book: DataFrame) -> DataFrame:
    """(doc_id, part, h) of the rows whose text a smaller doc_id has, too."""
    shared = stored(book.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "shared-hashes")
    # within the checked bound other texts stay where they are; beyond it all texts are shuffled by hash
    rows = texts(docs).where(F.col("doc_id").isNotNull()).join(bounded_broadcast(shared), "h", "left_semi")
    first = rows.groupBy("h", "t").agg(F.min("doc_id").alias("first_id"))
    first = stored(first.withColumnsRenamed({"h": "first_h", "t": "first_t"}), "first-copies")      # a table of its own, so that the skew join can split its partner
    smaller = (F.col("h") == F.col("first_h")) & (F.col("t") == F.col("first_t")) & (F.col("first_id") < F.col("doc_id"))
    return rows.join(first, smaller, "left_semi").select("doc_id", "part", "h")


def failures(docs: DataFrame, book: DataFrame) -> DataFrame:
    """(doc_id, part, h, bits, docs): the failed filters of each id, E included,
    and the number of rows that share it."""
    own = book.select("doc_id", "part", "h", "bits", F.lit(1).cast("long").alias("docs"))
    # equal rows come from the semi join several times; they set one bit and add no documents
    found = copies(docs, book).select("doc_id", "part", "h", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("docs"))
    return own.unionByName(found).groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("docs").alias("docs"))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, docs): documents by their failures and labels."""
    book = stored(measured(docs), "filter-bits")
    by_id = failures(docs, book).groupBy("doc_id", "part", "bits").agg(F.sum("docs").alias("docs"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    return (by_id.join(marks, F.col("doc_id") == F.col("id"), "left")
            .groupBy("part", "bits", (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("x", F.lit(0)) == 1).alias("toxic"))
            .agg(F.sum("docs").alias("docs")))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of ``filters``, per part, from ``combinations``."""
    steps = [("".join(p), k + 1, sum(BIT[f] for f in p[:k]), BIT[f]) for p in permutations(filters) for k, f in enumerate(p)]
    orders = len({s[0] for s in steps})
    listed = F.from_json(F.lit("[" + ",".join('{"o":"%s","s":%d,"m":%d,"f":%d}' % s for s in steps) + "]"), "array<struct<o:string,s:int,m:int,f:int>>")
    rows = counts.withColumn("step", F.explode(listed)).select("*", "step.*")
    alive, fails = F.col("bits").bitwiseAND(F.col("m")) == 0, F.col("bits").bitwiseAND(F.col("f")) != 0
    total = lambda cond, of="docs": F.coalesce(F.sum(F.when(cond, F.col(of))), F.lit(0)).cast("long")
    # a document that fails k filters is removed by each of them in a k-th of the orders
    rows = rows.withColumn("share", F.when(F.col("bits") != 0, F.expr(f"docs * {orders} div bit_count(bits)")))
    return rows.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("bits") == F.col("f")).alias("unique_fails"), total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"), total(fails, "share").alias("shapley"))
