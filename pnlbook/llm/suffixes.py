"""Substring deduplication with a logarithmic family of suffix arrays.

A byte is removed where a ``MATCH``-byte string covers it that also starts
anywhere else, in the same text too; strings are judged on the input.

The index is sparse: of every window of ``MATCH`` bytes it holds the suffix
that starts at the window's smallest ``GRAM``-byte fingerprint (the leftmost of
equals), so equal windows hold the same suffix at the same distance and about
one suffix in 80 is stored. An entry's key is its first three bytes followed by
40 bits of the gram's fingerprint: sorting by key sorts suffixes by their first
bytes and brings equal grams together.

``Levels`` is the family. A new batch of texts becomes a sorted run (level 0)
and is merge-scanned against every run that is there, a merge join of sorted
files: keys found on both sides are marked. Two runs of equal level are merged into one of the next level before
the next batch comes, so a suffix is rewritten a logarithmic number of times.

Marked suffixes are only candidates. Their windows are decided exactly by
fingerprints of what surrounds the suffix, ``STRIDE`` windows at a time: if the
bytes common to those windows (the core) occur once, none matches; if the bytes
that hold them all (the hull) occur twice, all match; where one core has unlike
hulls, windows are compared on their own (one text for each hull). A group of
equal texts is decided by its digest, and only its first text is searched.

Edge cases: null and empty texts and those under ``MATCH`` bytes lose nothing;
null ids and several texts under one id are texts like any other; repeated rows
are copies of each other, reported as often as they come; an empty table gives
no rows. Only ``doc_id`` and the text are read. Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pnlbook.session import scratch_dir

from .batches import lists, map_arrow, slices
from .repeats import combine, dropped, identified, identify, lone, settle, signed, stored, with_first
from .textarrays import BASES, Prefix, Texts, mix, spans_cover, texts_of

MATCH = 200
GRAM = 40
REACH = MATCH - GRAM + 1        # gram starts in a window
STRIDE = 17
BATCHES = 4
SEGMENT = 1 << 23               # bytes whose minima are found at once
LEAST_BUCKETS = 16
BUCKET_BYTES = 1 << 29         # text bytes whose suffixes make one bucket of the family
ORDER_CONF = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_U = np.uint64


def minima(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """(text, place, first, last, prefix): for each stored suffix its text, its
    place in the buffer and the first and last window start that it stands for."""
    prefix = t.byte_prefix(BASES[0])
    n = len(t.buf)
    if n < MATCH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, prefix
    i = np.arange(n - GRAM + 1)
    gram = prefix.of(i, i + GRAM)
    chosen = np.empty(n - MATCH + 1, np.int64)
    for a in range(0, len(chosen), SEGMENT):        # fixed 40 bits of fingerprint, 24 of place
        b = min(a + SEGMENT, len(chosen))
        v = (gram[a:b + REACH - 1] & ~_U((1 << 24) - 1)) | np.arange(b - a + REACH - 1, dtype=np.uint64)
        span = 1
        while span * 2 <= REACH:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < REACH:
            v = np.minimum(v[:len(v) - (REACH - span)], v[REACH - span:])
        chosen[a:b] = (v & _U((1 << 24) - 1)).astype(np.int64) + a
    start = np.arange(len(chosen))
    doc = np.searchsorted(t.at, start, "right") - 1
    inside = np.flatnonzero(start + MATCH <= t.at[doc + 1])
    place, doc = chosen[inside], doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], place[at], inside[at], inside[np.append(at[1:], len(inside)) - 1] if len(at) else at, prefix


def entry_rows(it):
    """The stored suffixes of a slice's texts."""
    for batch in it:
        for part in slices(batch, "t"):
            u, t = part.column("u").to_numpy(), texts_of(part.column("t"))
            doc, place, _, _, prefix = minima(t)
            gram = prefix.of(place, place + GRAM)
            head = t.buf.astype(np.uint64)
            key = (head[place] << _U(56)) | (head[place + 1] << _U(48)) | (head[place + 2] << _U(40)) | (gram >> _U(24))
            pos = place - t.at[doc]
            key, known = combine(key, u[doc], pos)
            yield {"key": signed(key), "u": u[doc], "pos": pos.astype(np.int32), "known": known}


class Levels:
    """A family of sorted runs of suffixes, as bucketed tables in the shared folder.

    A run is dealt to ``buckets`` by key and each bucket is one sorted file, so a
    new run meets a level by a merge join of sorted files, bucket by bucket:
    neither side is shuffled. All runs have the same buckets.
    """

    def __init__(self, spark: SparkSession, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.buckets = spark, scratch_dir(spark, "suffix-levels"), buckets
        self.runs: list[tuple[int, DataFrame]] = []
        self.marks: list[DataFrame] = []
        self.tables: dict[int, str] = {}

    def _write(self, df: DataFrame) -> DataFrame:
        name = f"suffix_run_{uuid.uuid4().hex}"
        bucket = F.pmod(F.hash("key"), F.lit(self.buckets))     # named, so that a bucket is one file whatever counts the session deals to
        (df.repartitionById(self.buckets, bucket).sortWithinPartitions("key")
         .write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.root}/{name}").saveAsTable(name))
        run = self.spark.table(name)
        self.tables[id(run)] = name
        return run

    def _drop(self, run: DataFrame) -> None:
        dropped(run)
        self.spark.sql(f"DROP TABLE {self.tables.pop(id(run))}")

    def _carry(self) -> None:
        """Merges runs of equal level until all levels differ; what was merged is deleted."""
        self.runs.sort(key=lambda r: r[0])
        while len(self.runs) > 1 and self.runs[0][0] == self.runs[1][0]:
            (level, a), (_, b) = self.runs[:2]
            merged = self._write(a.unionByName(b))
            self.runs = sorted([(level + 1, merged), *self.runs[2:]], key=lambda r: r[0])
            self._drop(a)
            self._drop(b)

    def insert(self, batch: DataFrame) -> None:
        """Adds a batch (u, t): its suffixes as a run, merge-scanned against itself and all others."""
        self._carry()
        with ordered_scans(self.spark):
            run = self._write(map_arrow(batch.select("u", "t"), entry_rows, "key long, u long, pos int, known boolean"))
            keys = run.select("key")
            self.marks.append(self._write(keys.groupBy("key").count().where("count > 1").select("key")))
            for _, level in self.runs:
                self.marks.append(self._write(keys.join(level.select("key").hint("merge"), "key", "left_semi").distinct()))
        self.runs.append((0, run))

    def close(self) -> None:
        """Deletes all runs and marks."""
        for run in [r for _, r in self.runs] + self.marks:
            self._drop(run)
        self.runs, self.marks = [], []

    def shared(self) -> DataFrame:
        """(u, pos) of the suffixes whose key occurs in several places."""
        marks = reduce(DataFrame.unionByName, self.marks)
        found = [run.where("known").select("u", "pos") for _, run in self.runs]
        found += [run.where(~F.col("known")).join(marks, "key", "left_semi").select("u", "pos") for _, run in self.runs]
        return reduce(DataFrame.unionByName, found)


@contextmanager
def ordered_scans(spark: SparkSession):
    """Scans of a bucket that is one file keep the file's order, so a merge join sorts nothing."""
    before = spark.conf.get(ORDER_CONF, None)
    spark.conf.set(ORDER_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ORDER_CONF)
        else:
            spark.conf.set(ORDER_CONF, before)


def digest_rows(it):
    for batch in it:
        t = texts_of(batch.column("t"))
        buf, at = t.buf.tobytes(), t.at.tolist()
        yield {"u": batch.column("u"), "d": batch.column("d"), "copies": batch.column("copies"), "doc_id": batch.column("doc_id"),
               "n_bytes": np.diff(t.at), "digest": pa.array([hashlib.sha256(buf[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())}


def _marked(part: pa.RecordBatch):
    """The slice's texts and the shared ones of its suffixes (text, place, first, last)."""
    t = texts_of(part.column("t"))
    doc, place, first, last, prefix = minima(t)
    want = part.column("places")
    holder = np.repeat(np.arange(t.n), np.diff(want.offsets.to_numpy()))
    on = np.isin(place, t.at[holder] + want.flatten().to_numpy())
    return t, doc[on], place[on], first[on], last[on], prefix


def strides(t: Texts, doc, place, first, last):
    """(row, k): the k-th stride of each suffix's windows: those that start
    STRIDE * k to STRIDE * k + STRIDE - 1 bytes before it."""
    low, high = (place - last) // STRIDE, (place - first) // STRIDE
    n = high - low + 1
    row = np.repeat(np.arange(len(place)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    return row, k


def context_rows(it):
    """One row for each stride of the shared suffixes: ``key`` its core, ``hull``
    its hull (null where that leaves the text), ``pos`` the suffix, ``k`` the stride.
    Strides of a slice with one hull are settled but for the first. Where a core has
    several hulls in a slice all are ``unlike``, and only the first stays under the core's
    key, the others under core and hull: no core has more than a row for each slice."""
    for batch in it:
        for part in slices(batch, "t"):
            u = part.column("u").to_numpy()
            t, doc, place, first, last, prefix = _marked(part)
            row, k = strides(t, doc, place, first, last)
            end = place[row] - STRIDE * k + MATCH
            begin = end - MATCH - STRIDE + 1
            fits = (begin >= t.at[doc[row]]) & (end <= t.at[doc[row] + 1])
            core = mix(prefix.of(end - MATCH, end - STRIDE + 1) + k.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            hull = prefix.of(np.where(fits, begin, 0), np.where(fits, end, 0))
            owner, pos = u[doc[row]], place[row] - t.at[doc[row]]
            both = np.where(fits, mix(core + hull), lone(owner, pos * 64 + k))
            key, known = combine(both, owner, pos * 64 + k)
            on = np.flatnonzero(key == both)
            on = on[np.argsort(core[on], kind="stable")]
            new = np.ones(len(on), bool)
            new[1:] = core[on[1:]] != core[on[:-1]]
            n = np.diff(np.append(np.flatnonzero(new), len(on)))
            unlike = np.zeros(len(key), bool)
            unlike[on] = np.repeat(n > 1, n)
            key[on[new]] = core[on[new]]
            yield {"key": signed(key), "hull": pa.array(signed(hull), pa.int64(), mask=~fits),
                   "u": owner, "pos": pos.astype(np.int32), "k": k.astype(np.int32), "known": known, "unlike": unlike}


def strides_settled(rows: DataFrame) -> DataFrame:
    """(u, code): strides whose windows all match (bit 0), and those whose windows
    are compared one by one (bit 1): where a core has unlike hulls, every stride
    that no equal hull decides, and one of each that are equal."""
    core, same = Window.partitionBy("key"), Window.partitionBy("key", "hull")
    df = (rows.withColumn("n", F.count(F.lit(1)).over(core)).withColumn("hulls", F.count("hull").over(core))
          .withColumn("low", F.min("hull").over(core)).withColumn("high", F.max("hull").over(core))
          .withColumn("mixed", F.max("unlike").over(core)).withColumn("equal", F.count(F.lit(1)).over(same))
          .withColumn("head", F.min(F.struct("u", "pos")).over(same)))
    all_match = F.col("hull").isNotNull() & (F.col("known") | (F.col("equal") > 1))
    unlike = (F.col("hulls") < F.col("n")) | (F.col("low") != F.col("high")) | F.col("mixed")
    head = (F.col("head.u") == F.col("u")) & (F.col("head.pos") == F.col("pos"))
    open_ = ((F.col("n") > 1) | F.col("unlike")) & unlike & (~all_match | head)
    code = F.col("pos").cast("long") * 256 + F.col("k") * 4 + F.when(all_match, 1).otherwise(0) + F.when(open_, 2).otherwise(0)
    return df.where(all_match | open_).select("u", code.alias("code"))


def _decided(part: pa.RecordBatch):
    """Windows (text, first start, last start) known to match, and those to be compared one by one."""
    t, doc, place, first, last, prefix = _marked(part)
    row, k = strides(t, doc, place, first, last)
    hits = part.column("hits")
    holder = np.repeat(np.arange(t.n), np.diff(hits.offsets.to_numpy()))
    code = hits.flatten().to_numpy()
    code = (t.at[holder] + (code >> 8)) * 256 + (code & 255)      # place in the buffer, stride and bits
    mine = place[row] * 256 + 4 * k
    all_match = np.isin(mine + 1, code) | np.isin(mine + 3, code)
    open_ = np.isin(mine + 2, code) | np.isin(mine + 3, code)
    a = np.maximum(first[row], place[row] - STRIDE * k - STRIDE + 1)
    b = np.minimum(last[row], place[row] - STRIDE * k)
    return t, prefix, doc[row], a, b, all_match, open_


def window_rows(it):
    """The windows of strides that are compared one by one."""
    for batch in it:
        for part in slices(batch, "t"):
            u = part.column("u").to_numpy()
            t, prefix, doc, a, b, _, open_ = _decided(part)
            n = (b - a + 1) * open_
            doc = np.repeat(doc, n)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            pos = start - t.at[doc]
            key, known = combine(prefix.of(start, start + MATCH), u[doc], pos)
            yield {"key": signed(key), "u": u[doc], "pos": pos.astype(np.int32), "known": known}


def cut_rows(it):
    """The spans to remove of each text (starts and ends in bytes) and their sum."""
    for batch in it:
        for part in slices(batch, "t"):
            t, _, doc, a, b, hull, _ = _decided(part)
            single = part.column("singles")
            holder = np.repeat(np.arange(t.n), np.diff(single.offsets.to_numpy()))
            start = t.at[holder] + single.flatten().to_numpy()
            gone = spans_cover(np.concatenate((a[hull], start)), np.concatenate((b[hull], start)) + MATCH, len(t.buf))
            edge = np.zeros(len(gone) + 1, np.int8)
            edge[:-1] += gone
            edge[1:] -= gone
            edge[t.at] = 0                              # spans end with their text
            whole = np.zeros(len(gone) + 2, bool)
            whole[1:-1] = gone
            opens = np.flatnonzero(gone & (~whole[:-2] | np.isin(np.arange(len(gone)), t.at)))
            closes = np.flatnonzero(gone & (~whole[2:] | np.isin(np.arange(len(gone)) + 1, t.at))) + 1
            at = np.searchsorted(opens, t.at)
            of = np.searchsorted(t.at, opens, "right") - 1
            total = np.concatenate(([0], np.cumsum(gone)))
            buf, keep = t.buf, ~gone
            left = [buf[x:y][keep[x:y]].tobytes() for x, y in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
            yield {"u": part.column("u"), "n_removed": total[t.at[1:]] - total[t.at[:-1]], "kept": pa.array(left, pa.binary()),
                   "span_starts": lists((opens - t.at[of]).astype(np.int32), at, pa.int32()),
                   "span_ends": lists((closes - t.at[of]).astype(np.int32), at, pa.int32())}


def _dedup(base: DataFrame, batches: int) -> DataFrame:
    """One row for each distinct text; see ``dedup``."""
    spark = base.sparkSession
    kind = base.schema["doc_id"].dataType.simpleString()
    seen = stored(map_arrow(base, digest_rows, f"u long, d long, copies long, doc_id {kind}, n_bytes long, digest binary"), "suffix-texts")
    seen = with_first(seen, "digest", F.sum("copies").alias("members"))
    size = seen.agg(F.sum("n_bytes")).first()[0] or 0
    index = Levels(spark, max(LEAST_BUCKETS, 1 + size // BUCKET_BYTES))
    for b in range(batches):
        index.insert(base.where(F.pmod(F.xxhash64("u"), F.lit(batches)) == b))
    places = index.shared().groupBy("u").agg(F.collect_list("pos").alias("places"))
    firsts = seen.where(F.col("u") == F.col("rep")).select("u")
    texts = stored(base.select("u", "t").join(places.join(firsts, "u", "left_semi"), "u"), "suffix-candidates")
    index.close()
    context = map_arrow(texts, context_rows, "key long, hull long, u long, pos int, k int, known boolean, unlike boolean")
    hits = strides_settled(context).groupBy("u").agg(F.collect_list("code").alias("hits"))
    candidates, texts = texts, stored(texts.join(hits, "u"), "suffix-contexts")
    dropped(candidates)
    windows = settle(map_arrow(texts, window_rows, "key long, u long, pos int, known boolean"))
    singles = windows.where(F.col("known") | (F.col("n") > 1)).groupBy("u").agg(F.collect_list("pos").alias("singles"))
    cut = map_arrow(texts.join(singles, "u", "left").withColumn("singles", F.coalesce("singles", F.array().cast("array<int>"))), cut_rows,
                    "u long, n_removed long, kept binary, span_starts array<int>, span_ends array<int>")
    out = seen.join(cut.withColumnRenamed("u", "rep"), "rep", "left")
    whole = (F.col("members") > 1) & (F.col("n_bytes") >= MATCH)
    none, n = F.array().cast("array<int>"), F.col("n_bytes").cast("int")
    pick = lambda name, all_, no: F.when(whole, all_).otherwise(F.coalesce(F.col(name), no)).alias(name)
    return (out.select("u", "copies", "doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0).cast("long")),
                    pick("span_starts", F.array(F.lit(0)), none), pick("span_ends", F.array(n), none),
                    F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.lower(F.hex("digest")).alias("digest")))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, span_starts, span_ends, kept, digest): the
    removed spans in bytes and, of texts that lose any of them, the bytes that are
    left; ``digest`` is the whole text's sha256. One row for every row of ``docs``."""
    return (_dedup(identified(docs), batches)
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("u", "copies", "copy"))


def _whole_characters(buf: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the spans, each shrunk to whole characters."""
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        while a < b and buf[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(buf) and buf[b] & 0xC0 == 0x80:
            b -= 1
        out.append(buf[at:a])
        at = b
    return b"".join([*out, buf[at:]]).decode()


def text_rows(it):
    for batch in it:
        for part in slices(batch, "t"):
            t = texts_of(part.column("t"))
            buf, at = t.buf.tobytes(), t.at.tolist()
            left = [_whole_characters(buf[a:b], s, e) for a, b, s, e in
                    zip(at[:-1], at[1:], part.column("span_starts").to_pylist(), part.column("span_ends").to_pylist(), strict=True)]
            yield {"u": part.column("u"), "left": pa.array(left, pa.string())}


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated strings cut out of the texts, at whole characters
    (a character cut in two by a span's end stays). All rows stay, a text that is
    repeated as a whole is empty; ``n_chars``, if there, follows the text."""
    known = identify(docs)
    spans = _dedup(known.texts, batches).where("n_removed > 0").select("u", "span_starts", "span_ends")
    cut = map_arrow(known.texts.select("u", "t").join(spans, "u"), text_rows, "u long, left string")
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    changed = F.col("left").isNotNull()
    return known.rows.join(cut, "u", "left").select(
        *((F.when(changed, new[c]).otherwise(F.col(f"row.{c}")) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digests(out: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes."""
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"),
                      F.coalesce(F.sha2("kept", 256), "digest").alias("kept_sha256"))
