"""Hierarchical packing into sequences of several context sizes.

A document is its tokenizer ids and an end id. Whole windows are cut off long
documents; what remains is routed to the smallest tier it fits. Tiers are
packed from the longest down: a window starts with its tier's longest document
and its gap is filled with the longest documents of the shorter tiers that fit,
at last with a piece cut to the gap's size (the rest of that document goes back
to the tier it now fits). Every window is filled to its tier's size, a power of
two; the last few ids of a block become sequences of smaller powers of two. So
no padding is needed at all. Sequences are dealt to step groups of
``STEP_TOKENS`` ids so that the groups of a block weigh about the same.

Packing runs in blocks of about ``BLOCK_TOKENS`` ids inside a task; nothing is
shuffled and nothing grows with the table. Ids are made per distinct chunk: the
tokenizer's pattern never crosses a space that has no other white space beside
it, so texts are cut there and each distinct chunk is encoded once (texts with
other spacing, or with a special token's string, are encoded whole).

Edge cases: null and empty texts are the end id alone; a text longer than a
block is a block of its own; null ids and repeated rows are packed like any
row; an empty table gives no pieces. Only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import map_arrow, slices, text_of
from .chunks import ChunkTable

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 17
END_ID = 1
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"

# fixed values: white space other than the space and the line feed
_OTHER_SPACE = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
_LOADED: dict[int, tuple] = {}


# fixed value: the pattern by which a byte-level tokenizer cuts text before merging
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge_ranks(data: bytes) -> dict[bytes, int] | None:
    """The vocabulary as bytes -> id, if ids rise in the order of the merges (so
    that they serve as merge ranks) and the text is cut by the usual pattern."""
    spec = json.loads(data)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merged]
    usual = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not usual or spec["normalizer"] or model.get("dropout") or ids != list(range(256, 256 + len(ids))):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def tokenizer(data: bytes):
    """(library tokenizer, chunk table, its special strings), one per worker process.

    New chunks are encoded from the same vocabulary by rank, which gives the same
    ids in less time; a tokenizer of another make encodes them itself.
    """
    from tokenizers import Tokenizer

    key = hash(data)
    if key not in _LOADED:
        tok = Tokenizer.from_buffer(data)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        whole = lambda text: tok.encode(text, add_special_tokens=False).ids
        ranks = merge_ranks(data)
        if ranks:
            import tiktoken
            by_rank = tiktoken.Encoding("by_rank", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            by_rank = whole
        encode = lambda chunks: [whole(c[0]) if isinstance(c, tuple) else by_rank(" " + c) for c in chunks]
        _LOADED[key] = tok, ChunkTable(encode), special
    return _LOADED[key]


def chunks_of(text: str, special: list[str]) -> list:
    """Chunks that can be encoded on their own: a text's first as a tuple, the others
    without the space before them. Where spacing is unusual the text is one chunk."""
    if not text:
        return []
    if ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "
            or any(c in text for c in _OTHER_SPACE) or any(s in text for s in special)):
        return [(text,)]
    parts = text.split(" ")
    parts[0] = (parts[0],)
    return parts


def plan(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id once.

    Each sequence's length is a power of two, ``tiers[-1]`` at most.
    """
    top = tiers[-1]
    out: list[list[tuple[int, int, int]]] = []
    queue: list[list[tuple[int, int, int]]] = [[] for _ in tiers]      # (length, document, start), ascending

    held = [0] * len(tiers)                                            # ids in each queue

    def tier_of(length: int) -> int:
        return next(k for k, t in enumerate(tiers) if length <= t)

    def take(k: int, at: int) -> tuple[int, int, int]:
        x = queue[k].pop(at)
        held[k] -= x[0]
        return x

    for doc, n in enumerate(sizes):
        whole = n // top
        out += [[(doc, k * top, top)] for k in range(whole)]
        if n % top:
            queue[tier_of(n % top)].append((n % top, doc, whole * top))
    for k, q in enumerate(queue):
        q.sort()
        held[k] = sum(x[0] for x in q)
    for k in range(len(tiers) - 1, -1, -1):
        while queue[k] and sum(held[:k + 1]) >= tiers[k]:               # enough for a full window
            length, doc, start = take(k, -1)
            window, gap = [(doc, start, length)], tiers[k] - length
            while gap:
                fits = ((j, bisect_right(queue[j], (gap, 1 << 62, 0))) for j in range(k, -1, -1))
                if found := next(((j, at) for j, at in fits if at), None):
                    length, doc, start = take(found[0], found[1] - 1)   # the longest that fits
                else:                                                   # cut a piece of the shortest
                    length, doc, start = take(next(j for j in range(k + 1) if queue[j]), 0)
                    j = tier_of(length - gap)
                    insort(queue[j], (length - gap, doc, start + gap))
                    held[j] += length - gap
                    length = gap
                window.append((doc, start, length))
                gap -= length
            out.append(window)
    rest = [x for q in queue for x in q]                # the block's last ids, as powers of two
    left = sum(x[0] for x in rest)
    while left:
        room = min(1 << (left.bit_length() - 1), top)
        left -= room
        window = []
        while room:
            length, doc, start = rest.pop()
            took = min(length, room)
            window.append((doc, start, took))
            room -= took
            if took < length:
                rest.append((length - took, doc, start + took))
        out.append(window)
    return out


def step_groups(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence; the groups' sums are near equal (longest first, to the lightest)."""
    import heapq

    n = max(1, -(-sum(lengths) // step_tokens))
    heap, out = [(0, g) for g in range(n)], [0] * len(lengths)
    for s in sorted(range(len(lengths)), key=lambda s: (-lengths[s], s)):
        load, g = heap[0]
        out[s] = g
        heapq.heapreplace(heap, (load + lengths[s], g))
    return out


def _packed(docs: list[tuple[object, np.ndarray]], first: int) -> tuple[dict, int]:
    """The pieces of one block; its sequences (and step groups) are numbered from ``first``."""
    windows = plan([len(x) for _, x in docs])
    groups = step_groups([sum(p[2] for p in w) for w in windows])
    cols: dict[str, list] = {k: [] for k in ("doc", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids")}
    for s, window in enumerate(windows):
        offset, size = 0, sum(p[2] for p in window)
        for doc, start, length in window:
            ids = docs[doc][1]
            for k, v in (("doc", docs[doc][0]), ("start", start), ("length", length), ("doc_tokens", len(ids)), ("sequence_id", first + s),
                         ("offset", offset), ("tier", size), ("step_group", first + groups[s]), ("ids", ids[start:start + length].tobytes())):
                cols[k].append(v)
            offset += length
    return cols, first + len(windows)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, its place in the document and in a sequence,
    and its ids as little-endian unsigned 32-bit values."""
    with open(os.fspath(tokenizer_path), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(it: Iterator[pa.RecordBatch]):
        tok, table, special = tokenizer(data.value)
        first = TaskContext.get().partitionId() << 36
        block, held = [], 0

        def emit():
            nonlocal first, block, held
            cols, first = _packed(block, first)
            block, held = [], 0
            yield {"doc_id": pa.array(cols.pop("doc"), kind), **cols}

        kind = None
        for batch in it:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch, "t"):
                ids, at = table.join([chunks_of(t, special) for t in part.column("t").to_pylist()])
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    block.append((doc, np.append(ids[at[k]:at[k + 1]], END_ID).astype("<u4")))
                    held += len(block[-1][1])
                    if held >= BLOCK_TOKENS:
                        yield from emit()
        if block:
            yield from emit()

    df = docs.select("doc_id", text_of(docs).alias("t"))
    return map_arrow(df, rows, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {PIECE}")
