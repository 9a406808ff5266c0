"""Substring deduplication by difference-cover anchors.

A window is ``WINDOW`` consecutive words. The words of a document that lie in a
window whose sequence also starts in a document with a smaller ``doc_id`` are
removed; windows are judged on the input.

Positions are taken modulo ``PERIOD`` and only those in ``COVER``, a difference
cover, carry an anchor: the fingerprint of the next ``ANCHOR`` words. For any
two places there is a shift below the period that brings both onto the cover, so
two equal windows share an anchor at the same distance, and a fifth of all
positions is enough to find every match. The steps:

1. anchors of all texts, brought together by key in one shuffle; those that
   another text has too are listed per text;
2. texts with shared anchors extend them: every window that holds a shared
   anchor is fingerprinted whole and goes to its smallest owner;
3. the covered words are cut out.

Exact copies (equal word sequences) are decided by their first text, so a group
of copies is searched once.

Edge cases: null and empty texts and those under ``WINDOW`` words lose nothing;
rows with a null ``doc_id`` come after all others; several texts under one
``doc_id`` do not own each other's windows and are reported apart; repeated rows
are reported as often as they come; an empty table gives no rows. Only
``doc_id`` and the text are read. Sequences are compared by 64-bit fingerprints
of two unlike polynomials (one for anchors, one for windows).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_arrow, slices
from .repeats import combine, identified, lone, settle, signed, stored, with_first
from .textarrays import BASES, Prefix, Words, spans_cover, texts_of, word_prints, words_of

WINDOW = 50
# fixed values: a perfect difference set, every difference modulo 31 occurs
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
ANCHOR = WINDOW - PERIOD + 1
EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(buf: bytes, w: Words, keep: np.ndarray, k: int) -> bytes:
    """Text k's kept words joined by one space."""
    a, b = w.at[k], w.at[k + 1]
    at = np.flatnonzero(keep[a:b]) + a
    return b" ".join([buf[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])


def anchor_rows(it):
    """Per text: one row with its word count and digest, and its anchors' rows."""
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    for batch in it:
        for part in slices(batch, "t"):
            u, t = part.column("u").to_numpy(), texts_of(part.column("t"))
            w = words_of(t)
            buf, all_words = t.buf.tobytes(), np.ones(len(w.start), bool)
            digest = [hashlib.sha256(_joined(buf, w, all_words, k)).digest() for k in range(t.n)]
            n, doc = np.diff(w.at), w.doc
            pos = np.arange(len(doc)) - w.at[doc]
            i = np.flatnonzero(on[pos % PERIOD] & (pos + ANCHOR <= n[doc]) & (n[doc] >= WINDOW))
            key = Prefix(word_prints(t, w), BASES[1]).of(i, i + ANCHOR)
            # an anchor is settled where two texts of the slice have it
            owner, place = u[doc[i]], pos[i]
            key, known = _combine_texts(key, owner, place)
            none = pa.nulls(len(i), pa.binary())
            yield {"key": signed(key), "u": owner, "pos": place.astype(np.int32), "known": known,
                   "n_words": np.zeros(len(i), np.int64), "digest": none}
            minus = np.full(t.n, -1)
            yield {"key": signed(lone(u, minus)), "u": u, "pos": minus.astype(np.int32), "known": np.zeros(t.n, bool),
                   "n_words": n, "digest": pa.array(digest, pa.binary())}


def _combine_texts(key: np.ndarray, u: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``combine``, but a key is settled only by another text; the smallest text's first row goes on."""
    order = np.lexsort((pos, u, key))
    k, v = key[order], u[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(k)) - 1
    several = (v[starts] != v[ends])[group] if len(k) else first
    out_key, known = key.copy(), np.zeros(len(key), bool)
    known[order] = several
    moved = order[several & ~first]
    out_key[moved] = lone(u[moved], pos[moved])
    return out_key, known


def window_rows(it):
    """The windows around shared anchors, each with its fingerprint."""
    for batch in it:
        for part in slices(batch, "t"):
            u, d, t = part.column("u").to_numpy(), part.column("d").to_numpy(), texts_of(part.column("t"))
            w = words_of(t)
            at = part.column("places")
            doc = np.repeat(np.arange(t.n), np.diff(at.offsets.to_numpy()))
            anchor = at.flatten().to_numpy()
            last = np.diff(w.at)[doc] - WINDOW
            near = spans_cover(w.at[doc] + np.maximum(anchor - (WINDOW - ANCHOR), 0), w.at[doc] + np.minimum(anchor, last) + 1, len(w.start))
            i = np.flatnonzero(near)
            doc = np.searchsorted(w.at, i, "right") - 1
            key = Prefix(word_prints(t, w), BASES[2]).of(i, i + WINDOW)
            pos = i - w.at[doc]
            key, known = combine(key, u[doc], pos, across=d[doc])
            yield {"key": signed(key), "u": u[doc], "d": d[doc], "pos": pos.astype(np.int32), "known": known}


def cut_rows(it):
    """What is left of each text without the words of the windows in ``places``."""
    for batch in it:
        for part in slices(batch, "t"):
            t = texts_of(part.column("t"))
            w = words_of(t)
            at = part.column("places")
            doc = np.repeat(np.arange(t.n), np.diff(at.offsets.to_numpy()))
            start = w.at[doc] + at.flatten().to_numpy()
            gone = spans_cover(start, start + WINDOW, len(w.start))
            buf = t.buf.tobytes()
            total = np.concatenate(([0], np.cumsum(gone)))
            kept = [_joined(buf, w, ~gone, k).decode() for k in range(t.n)]
            yield {"u": part.column("u"), "n_removed": total[w.at[1:]] - total[w.at[:-1]], "kept": pa.array(kept, pa.string())}


def _places(hits: DataFrame) -> DataFrame:
    """The positions of each text as one array (no longer than the text)."""
    return hits.groupBy("u").agg(F.collect_list("pos").alias("places"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, digest): for texts that lose some but not
    all words, ``kept`` is what is left; ``digest`` is the full text's (sha256 of
    its words joined by one space)."""
    base = identified(docs)
    rows = settle(map_arrow(base.select("u", "t"), anchor_rows,
                            "key long, u long, pos int, known boolean, n_words long, digest binary")
                  .withColumn("hi", F.max("u").over(Window.partitionBy("key"))))
    shared = F.col("known") | (F.col("lo") != F.col("hi"))
    seen = (rows.where((F.col("pos") < 0) | shared).groupBy("u")
            .agg(F.max("n_words").alias("n_words"), F.max("digest").alias("digest"),
                 F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("places")))
    seen = with_first(stored(seen, "cover-texts"), "digest")
    firsts = seen.where((F.col("u") == F.col("rep")) & (F.size("places") > 0)).select("u", "places")
    texts = stored(base.join(firsts, "u").select("u", "d", "t", "places"), "cover-candidates")
    windows = settle(map_arrow(texts, window_rows, "key long, u long, d long, pos int, known boolean"))
    hits = _places(windows.where(F.col("known") | (F.col("lo") < F.col("d"))))
    cut = map_arrow(texts.select("u", "t").join(hits, "u"), cut_rows, "u long, n_removed long, kept string")
    own = base.select("u", "d", "copies", "doc_id")
    rep_d = seen.join(own.select("u", "d"), "u").where(F.col("u") == F.col("rep")).select("rep", F.col("d").alias("rep_d"))
    out = (own.join(seen.drop("places"), "u").join(rep_d, "rep").join(cut.withColumnRenamed("u", "rep"), "rep", "left"))
    whole = (F.col("d") > F.col("rep_d")) & (F.col("n_words") >= WINDOW)      # a copy of an earlier text
    return (out.withColumn("n_removed", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))))
            .withColumn("kept", F.when(whole, F.lit("")).otherwise(F.col("kept")))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "n_words", "n_removed", "kept", F.hex("digest").alias("digest")))


def digests(out: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return out.select("doc_id", "n_words", "n_removed",
                      F.coalesce(F.sha2(F.encode("kept", "UTF-8"), 256), F.lower("digest")).alias("kept_sha256"))
