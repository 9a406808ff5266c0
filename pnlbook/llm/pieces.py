"""SentencePiece ids by a distinct-chunk table, and back.

In the model's normal form every space is the marker U+2581 and one marker is
put in front of the text. No piece of the model has a marker after another
character (checked when the model is loaded), so the text falls into chunks -
markers followed by a marked word - that pieces never cross. Each distinct
chunk is segmented once by the library and its ids are joined back by position.

A model's bytes (under a megabyte) are broadcast from ``model_path``, which only
the driver needs to read.

Edge cases: null and empty texts have no ids and decode to an empty text; a
literal U+2581 is the same as a space to the library, also here; runs of spaces,
leading and trailing ones keep their markers; texts without spaces are one
chunk, however long; repeated rows and null ids pass through; an empty table
gives an empty result. Only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lists, map_arrow, slices, text_of
from .chunks import ChunkTable

MARK = "▁"
_LOADED: dict[int, tuple] = {}


def processor(model: bytes):
    """The library's processor and a chunk table over it, one per worker process."""
    import sentencepiece

    key = hash(model)
    if key not in _LOADED:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for i in range(sp.get_piece_size()):
            if MARK in sp.id_to_piece(i).lstrip(MARK):
                raise ValueError(f"piece {i} crosses a marker; chunks cannot be encoded on their own")
        lone = sp.piece_to_id(MARK)
        _LOADED[key] = sp, ChunkTable(lambda chunks: [ids if c else [lone] for c, ids in zip(chunks, sp.encode(chunks, num_threads=1), strict=True)])
    return _LOADED[key]


def chunks_of(text: str) -> list[str]:
    """The text's chunks, their markers as spaces and without the first marker
    (which the library puts before any text); a lone marker is an empty chunk."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        run += 1
        if p:
            out.append(" " * (run - 1) + p)
            run = 0
    if run:
        out.append(" " * (run - 1))
    return out


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the library's ids of every text."""
    return _run(docs, model_path, decode=False)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids, and the library's decode of them."""
    return _run(docs, model_path, decode=True)


def _run(docs: DataFrame, model_path: str, decode: bool) -> DataFrame:
    with open(os.fspath(model_path), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(it):
        sp, table = processor(model.value)
        for batch in it:
            for part in slices(batch, "t"):
                texts = part.column("t").to_pylist()
                ids, at = table.join([chunks_of(t) for t in texts])
                out = {"doc_id": part.column("doc_id"), "ids": lists(ids, at, pa.int32())}
                if decode:
                    flat = ids.tolist()
                    out["decoded"] = pa.array([sp.decode(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
                yield out

    df = docs.select("doc_id", text_of(docs).alias("t"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return map_arrow(df, rows, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def digests(trip: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text."""
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
