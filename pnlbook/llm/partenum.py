"""Similarity join of shingle sets by partition-and-enumerate signatures.

Texts are lower-cased (A-Z), cut into words, and become sets of distinct
``gram``-word shingles (the whole sequence where it is shorter). Two documents
link when ``100 * intersection >= percent * union``.

Sizes fall into bands, each as wide as one step of the threshold. For a pair
whose smaller set is in band j the two sets differ in at most ``k_j`` elements.
Band j's signatures divide the feature domain into first-level parts, each into
``SPLIT`` second-level parts, and take every choice of ``SPLIT - SLACK`` of
these: with more than ``k_j / (SLACK + 1)`` first-level parts, some part holds at
most ``SLACK`` differences, so one choice is free of them and both sets give
the same signature there. A set signs its own band and, if it can pair with a
smaller one, the band below.

A signature over parts without elements says nothing. Some spare first-level
parts make up for those: a set with more bare parts than spares also signs
under another seed, and after ``SEEDS`` of them with its bare parts too, so no
pair is missed (two sets that meet only in bare parts both have too many).

Candidates are checked with the full sets. Equal sets are one class, searched
once. First every text is checked with the text it shares the most signatures
with (the smallest of each group of equal signatures stands for it). In groups of
equal signatures whose members are then not in one component, every pair's
difference is bounded from below: each set has a parity bitmap (a bit for each
cell of a hashed domain, set where an odd number of elements fall), and two sets
differ in at least as many elements as their bitmaps in bits. Pairs that this
bound leaves gather their texts into clusters (a group sends a spanning forest of
them, no row for each pair), and a cluster is compared whole, block by block: two blocks
of texts meet in one task, where intersections of all their sets are counted at once
(matrix products for shingles that many sets hold), and only what joins
components leaves it. A pair that is never compared is in one component anyway, or
too far apart.

Edge cases: null, empty and blank texts have an empty set and link with
nothing; repeated rows and equal texts are one class; null ids come after all
others; an empty table gives no rows; only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_arrow, slices
from .components import components
from .repeats import dropped, identified, identify, lone, signed, stored, with_first
from .textarrays import BASES, Prefix, Texts, mix, texts_of, word_prints, words_of

SPLIT, SLACK = 2, 1
SEEDS = 6
BLOCK = 768         # texts of a cluster's block
BLOCK_SHINGLES = 1 << 20
GROUP = 2048        # bitmaps of a group's block
LEAST_BITS, MOST_BITS = 64, 1 << 16
_U = np.uint64


def shingles(t: Texts, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending: (all, where each text starts)."""
    w = words_of(t)
    n, doc = np.diff(w.at), w.doc
    prefix = Prefix(word_prints(t, w, fold=True), BASES[1])
    size = np.minimum(n, gram)[doc]
    i = np.flatnonzero(np.arange(len(doc)) + size <= w.at[1:][doc])
    i = i[(n[doc[i]] >= gram) | (i == w.at[doc[i]])]
    key = prefix.of(i, i + size[i]) ^ mix(size[i].astype(np.uint64))
    order = np.lexsort((key, doc[i]))
    key, of = key[order], doc[i][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], np.searchsorted(of[new], np.arange(t.n + 1))


def bitmaps(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity bitmap of each set, of a power of two of bits: twice its elements and more."""
    size = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    base = np.concatenate(([0], np.cumsum(bits)))
    cell = (mix(values) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], size)
    packed = np.packbits((np.bincount(cell, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    ends = (base // 8).tolist()
    return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def near(bits: list[bytes], size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may link, by size and by what their bitmaps say they differ in at least."""
    n = len(bits)
    width = np.array([len(b) for b in bits])
    out = np.zeros((n, n), bool)
    # linked sets have at most this share of their sizes' sum in differences
    most = (size[:, None] + size[None, :]) * (100 - percent) // (100 + percent)
    fits = 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    for w in np.unique(width):
        narrow = np.flatnonzero(width == w)
        words = np.frombuffer(b"".join(bits[k] for k in narrow), np.uint64).reshape(len(narrow), -1)
        for v in np.unique(width[width >= w]):
            wide = np.flatnonzero(width == v)
            if not fits[np.ix_(narrow, wide)].any():
                continue
            folded = np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[k] for k in wide), np.uint64).reshape(len(wide), v // w, -1), axis=1)
            step = max(1, (1 << 22) // (len(wide) * words.shape[1]))
            for k in range(0, len(narrow), step):
                apart = np.bitwise_count(words[k:k + step, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
                ok = apart <= most[np.ix_(narrow[k:k + step], wide)]
                out[np.ix_(narrow[k:k + step], wide)] = ok
                out[np.ix_(wide, narrow[k:k + step])] = ok.T
    return out & fits


def near_edges(percent: int):
    """Of each group (or two blocks of one), rows together: edges that join what ``near`` leaves
    of its pairs between components."""
    def forest(u: np.ndarray, c: np.ndarray, size: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        links = near(bits, size, percent) & (c[:, None] != c[None, :])
        label = np.arange(len(u))
        while True:
            low = np.minimum(label, np.where(links, label[None, :], len(u)).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        joined = np.flatnonzero(label != np.arange(len(u)))
        return u[label[joined]], u[joined]

    def rows(batches):
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in _whole_groups(batches):
            at = np.append(batch["start"], len(batch["u"]))
            made = [forest(batch["u"][x:y], batch["c"][x:y], batch["size"][x:y], batch["bits"][x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
            a, b = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.record_batch([a, b], schema=kind)

    return rows


def _whole_groups(batches):
    """Batches of rows (sign, i, j, u, c, size, bits) sorted by group, cut between groups."""
    held = []

    def cut(tables, last):
        t = pa.Table.from_batches(tables)
        key = np.stack([t[c].to_numpy() for c in ("sign", "i", "j")])
        new = np.ones(t.num_rows, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        end = t.num_rows if last else int(start[-1])
        done = t.slice(0, end)
        out = {"start": start[start < end], "bits": done["bits"].to_pylist(), **{c: done[c].to_numpy() for c in ("u", "c", "size")}}
        return out, t.slice(end).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            out, held = cut(held, False)
            if len(out["start"]):
                yield out
    if held:
        yield cut(held, True)[0]


class Bands:
    """Size bands of a threshold, and each band's number of differences and parts."""

    def __init__(self, percent: int):
        self.percent = percent
        self.high = [0]                 # the largest size of each band
        self.grow(1)

    def grow(self, size: int) -> None:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.high.append(max(low, low * 100 // self.percent))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(self.high, sizes)

    def differences(self, band: np.ndarray) -> np.ndarray:
        """The most elements in which a linked pair differs whose smaller set is in the band."""
        small = np.array(self.high)[band]
        return (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def spares(self, band: np.ndarray) -> np.ndarray:
        """First-level parts beyond those that the differences need: about as many
        as stay bare in the band's smallest sets (a choice of cells without
        elements), and some standard deviations more."""
        low = np.array(self.high)[band - 1] + 1
        need = self.differences(band) // (SLACK + 1) + 1
        spare = np.zeros_like(need)
        for _ in range(8):
            held = low * (SPLIT - SLACK) / ((need + spare) * SPLIT)
            bare = (need + spare) * np.minimum(1, comb(SPLIT, SLACK) * np.exp(-held))
            spare = np.minimum(np.ceil(bare + 2.5 * np.sqrt(bare)).astype(np.int64), need // 2)
        return spare


def signatures(values: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets (set i is values[at[i]:at[i + 1]])."""
    size = np.diff(at)
    own = bands.of(size)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    below = np.array(bands.high)[np.maximum(own - 1, 0)]
    for who, band in ((np.flatnonzero(size > 0), own), (np.flatnonzero((own > 1) & (bands.percent * size <= 100 * below)), own - 1)):
        k = bands.differences(band[who])
        who, k = who[k > 0], k[k > 0]           # none differ: equal sets, a class already
        for seed in range(SEEDS):
            if not len(who):
                break
            spare = bands.spares(band[who])
            parts = k // (SLACK + 1) + 1 + spare
            cells = parts * SPLIT
            base = np.concatenate(([0], np.cumsum(cells)))
            count = size[who]
            x = values[np.repeat(at[who], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            x = mix(x + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2 ** 64 - 1)))
            cell = ((x >> _U(40)).astype(np.int64) * np.repeat(cells, count)) >> 24
            cell += np.repeat(base[:-1], count)
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, cell, mix(x))
            filled = np.bincount(cell, minlength=base[-1])
            holder = np.repeat(np.arange(len(who)), parts)
            part = np.arange(len(holder)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = base[holder] + part * SPLIT
            tag = mix(band[who][holder].astype(np.uint64) * _U(1000003) + _U(seed)) + part.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            bare = np.zeros(len(holder), bool)
            made = []
            for c, choice in enumerate(combinations(range(SPLIT), SPLIT - SLACK)):
                sign, n = tag + _U(c * 7919), np.zeros(len(holder), np.int64)
                for s in choice:
                    sign = mix(sign + mix(total[first + s] + _U(s)))
                    n += filled[first + s]
                bare |= n == 0
                made.append((holder, sign, n))
            short = np.bincount(holder, bare, len(who)) > spare         # more bare parts than spares
            last = seed == SEEDS - 1
            for h, sign, n in made:
                on = (n > 0) | (short[h] if last else False)
                out.append((who[h[on]], sign[on]))
            who, k = who[short], k[short]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def signature_rows(gram: int, percent: int):
    """Per text one row with its set's size and digest, and rows of signatures.

    Equal sets of a slice sign once. Of a slice's texts with one signature the
    smallest goes on; the others name it as ``leader`` and keep the signature
    in ``sign``, under a key of their own.
    """
    def rows(it):
        bands = Bands(percent)
        for batch in it:
            for part in slices(batch, "t"):
                u = part.column("u").to_numpy()
                values, at = shingles(texts_of(part.column("t")), gram)
                bounds = at.tolist()
                digest = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = len(u)
                none = pa.nulls(n, pa.int64())
                yield {"key": signed(lone(u, np.full(n, -1))), "u": u, "sign": none, "leader": none, "size": np.diff(at), "digest": pa.array(digest, pa.binary()),
                       "bits": pa.array(bitmaps(values, at), pa.binary())}
                order = np.argsort(u, kind="stable").tolist()
                once = {}
                for k in order:
                    once.setdefault(digest[k], k)
                keep = np.array(sorted(once.values()), np.int64)
                count = np.diff(at)[keep]
                start = np.concatenate(([0], np.cumsum(count)))
                held = values[np.repeat(at[keep], count) + np.arange(start[-1]) - np.repeat(start[:-1], count)]
                who, sign = signatures(held, start, bands)
                owner = u[keep][who]
                order = np.lexsort((owner, sign))
                sign, owner = sign[order], owner[order]
                first = np.ones(len(sign), bool)
                first[1:] = sign[1:] != sign[:-1]
                head = np.maximum.accumulate(np.where(first, np.arange(len(sign)), 0))
                several = np.zeros(len(sign), bool)
                several[:-1] = ~first[1:]
                key = np.where(first, sign, lone(owner, (sign >> _U(2)).astype(np.int64)))
                n = len(sign)
                yield {"key": signed(key), "u": owner, "sign": pa.array(signed(sign), pa.int64(), mask=first & ~several),
                       "leader": pa.array(owner[head], pa.int64(), mask=first), "size": pa.nulls(n, pa.int64()), "digest": pa.nulls(n, pa.binary()),
                       "bits": pa.nulls(n, pa.binary())}

    return rows


def checked_rows(gram: int, percent: int):
    """Which pairs of texts link."""
    def rows(it):
        for batch in it:
            for part in slices(batch, "ta"):
                va, aa = shingles(texts_of(part.column("ta")), gram)
                vb, ab = shingles(texts_of(part.column("tb")), gram)
                na, nb = np.diff(aa), np.diff(ab)
                both = np.array([len(np.intersect1d(va[aa[i]:aa[i + 1]], vb[ab[i]:ab[i + 1]], assume_unique=True)) for i in range(part.num_rows)], np.int64)
                yield {"a": part.column("a"), "b": part.column("b"), "links": (100 * both >= percent * (na + nb - both)) & (both > 0)}

    return rows


def check(pairs: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """(a, b, links) for pairs (a, b) of ``texts`` (u, t)."""
    df = (pairs.join(texts.select(F.col("u").alias("b"), F.col("t").alias("tb")), "b")
          .join(texts.select(F.col("u").alias("a"), F.col("t").alias("ta")), "a"))
    return stored(map_arrow(df.select("a", "b", "ta", "tb"), checked_rows(gram, percent), "a long, b long, links boolean"), "checked")


def open_texts(groups: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, c, size, cluster): texts of the groups that still hold several components,
    where a pair of them may link. Texts of such pairs, directly or through others, are one
    cluster."""
    df = groups.join(comp.select(F.col("vertex").alias("u"), "component"), "u", "left")
    df = df.select("sign", "u", "size", F.coalesce("component", "u").alias("c"))
    held = df.groupBy("sign").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"),
                                  *(F.sum(F.xxhash64(F.lit(k), "u").cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2))).where("lo <> hi")
    # groups with the same members are one
    open_ = held.groupBy("n", "m1", "m2").agg(F.min("sign").alias("sign")).select("sign", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    df = stored(df.join(open_, "sign"), "open-groups")
    own = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    dealt = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (dealt.select("sign", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "u", "c", "size")
             .join(sets.select("u", "bits"), "u").repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j", "u"))
    edges = stored(dealt.select("sign", "i", "j", "u", "c", "size", "bits").mapInArrow(near_edges(percent), "a long, b long"), "near")
    clusters = components(edges).select(F.col("vertex").alias("u"), F.col("component").alias("cluster"))
    out = stored(df.select("u", "c", "size").distinct().join(clusters, "u"), "open-texts")
    dropped(df, edges)
    return out


def intersections(values: np.ndarray, at: np.ndarray, heavy: int = 48) -> np.ndarray:
    """The sizes of all pairwise intersections of a block's sets."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(v)))
    out = np.zeros((n, n))                              # exact below 2**53
    often = np.flatnonzero(size >= heavy)               # in many sets: matrix products, some columns at a time
    for k in range(0, len(often), 1024):
        part = often[k:k + 1024]
        m = np.zeros((n, len(part)), np.float32)
        m[d[np.repeat(start[part], size[part]) + _runs(size[part])], np.repeat(np.arange(len(part)), size[part])] = 1
        out += m @ m.T
    for c in np.unique(size[(size > 1) & (size < heavy)]):      # in few: their pairs are counted
        rows = d[start[size == c][:, None] + np.arange(c)]
        for k in range(0, len(rows), max(1, (1 << 20) // (c * c))):
            r = rows[k:k + max(1, (1 << 20) // (c * c))]
            pairs = (r[:, :, None] * n + r[:, None, :]).ravel()
            out += np.bincount(pairs, minlength=n * n).reshape(n, n) if n <= 64 or len(pairs) > n * n // 8 else _counted(pairs, n)
    return out.astype(np.int64)


def _counted(pairs: np.ndarray, n: int) -> np.ndarray:
    cells, count = np.unique(pairs, return_counts=True)
    out = np.zeros(n * n, np.float32)
    out[cells] = count
    return out.reshape(n, n)


def _runs(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def block_links(gram: int, percent: int):
    """Of a block of texts (two blocks of a cluster) every pair is compared; (a, b)
    joins each text to the smallest one that links lead to, so no more rows leave
    than came in."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("u")
        u, c = t["u"].to_numpy(), t["c"].to_numpy()
        values, at = shingles(texts_of(t["t"]), gram)
        n = np.diff(at)
        both = intersections(values, at)
        links = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
        _, first, label = np.unique(c, return_index=True, return_inverse=True)
        label = first[label]                            # each text starts in its component
        links |= label[:, None] == label[None, :]
        while True:
            low = np.where(links, label[None, :], len(u)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        new = label != first[np.unique(c, return_inverse=True)[1]]
        return pa.table({"a": u[label[new]], "b": u[new]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def cluster_links(members: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """(a, b) joined by links, over every pair of a cluster: clusters are dealt into
    blocks of about ``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles, and each two
    blocks meet in one group."""
    need = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    blocks = members.groupBy("cluster").agg(F.ceil(need).cast("int").alias("blocks"))
    df = members.drop("size").join(blocks, "cluster").join(texts, "u")
    own = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    df = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "u", "c", "t")
    return df.groupBy("cluster", "i", "j").applyInArrow(block_links(gram, percent), "a long, b long")


def _components(base: DataFrame, gram: int, percent: int) -> DataFrame:
    """(u, copies, doc_id, size, c): ``c`` is the first text of the component."""
    rows = map_arrow(base.select("u", "t"), signature_rows(gram, percent), "key long, u long, sign long, leader long, size long, digest binary, bits binary")
    by = Window.partitionBy("key")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("lo", F.min("u").over(by))
    kept = stored(rows.where(F.col("size").isNotNull() | F.col("sign").isNotNull() | (F.col("n") > 1))
                  .select("u", F.when(F.col("size").isNull(), F.coalesce("sign", "key")).alias("sign"),
                          F.coalesce("leader", "lo").alias("leader"), "size", "digest", "bits"), "signatures")
    sets = stored(with_first(kept.where(F.col("size").isNotNull()).select("u", "size", "digest", "bits"), "digest").drop("digest"), "sets")
    rep = lambda name: sets.select(F.col("u").alias(name), F.col("rep").alias(f"{name}_rep"))
    met = kept.where(F.col("size").isNull()).join(rep("u"), "u")
    groups = (met.select("sign", F.col("u_rep").alias("u")).distinct()
              .join(sets.where("u = rep").select("u", "size"), "u"))
    several = groups.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sign")
    groups = stored(groups.join(several, "sign", "left_semi"), "groups")
    # first round: each text with the leader it meets most often
    pairs = (met.where("leader <> u").select("u_rep", "leader").join(rep("leader"), "leader").where("leader_rep <> u_rep")
             .select(F.least("u_rep", "leader_rep").alias("a"), F.greatest("u_rep", "leader_rep").alias("b"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    texts = stored(base.select("u", "t").join(groups.select("u").distinct(), "u", "left_semi"), "candidates")
    links = check(pairs, texts, gram, percent).where("links").select("a", "b")
    dropped(kept)
    comp = components(links)
    members = open_texts(groups, comp, sets, percent)
    dropped(groups)
    if not members.isEmpty():
        more = stored(cluster_links(members, texts, gram, percent), "block-links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    dropped(texts)
    comp_of = comp.select(F.col("vertex").alias("rep"), "component")
    first = F.when(F.col("size") == 0, F.col("u")).otherwise(F.coalesce("component", "rep"))
    return (base.select("u", "copies", "doc_id").join(sets, "u").join(comp_of, "rep", "left")
            .select("u", "copies", "doc_id", "size", first.alias("c")))


def components_of(docs: DataFrame, gram: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the component's smallest doc_id, for every row."""
    base = identified(docs)
    ids = base.select(F.col("u").alias("c"), F.col("doc_id").alias("component_id"))
    return (_components(base, gram, percent).join(ids, "c")
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", F.col("size").alias("n_shingles"), "component_id"))


def representatives(docs: DataFrame, gram: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: the smallest
    doc_id's (of equal rows, one). Texts without words all stay."""
    known = identify(docs)
    first = _components(known.texts, gram, percent).where(F.col("u") == F.col("c")).select("u")
    kept = known.rows.join(first, "u", "left_semi")
    return (kept if known.unique else kept.dropDuplicates(["u"])).select("row.*")
