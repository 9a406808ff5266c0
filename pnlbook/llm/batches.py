"""Arrow batches through Spark: bounded slices, typed output, column names.

``map_arrow`` is the one place where rows pass through Python: Spark deals the
partitions, each task walks its Arrow batches in slices of at most
``SLICE_BYTES`` of text, so a task holds one slice (or one longer text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_BYTES = 2 << 20
SLICE_ROWS = 20_000


def slices(batch: pa.RecordBatch, column: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that ``column`` holds about ``most`` bytes in each part."""
    if not batch.num_rows:
        return
    if column is None:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)
        return
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    k = 0
    while k < batch.num_rows:
        end = int(np.searchsorted(at, int(at[k]) + most, "right")) - 1
        end = min(max(end, k + 1), k + SLICE_ROWS, batch.num_rows)
        yield batch.slice(k, end - k)
        k = end


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` yields dicts of columns (arrays or Arrow arrays)."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(it):
            arrays = []
            for field in arrow:
                x = cols[field.name]
                if not isinstance(x, (pa.Array, pa.ChunkedArray)):
                    x = pa.array(x, type=field.type)
                if isinstance(x, pa.ChunkedArray):
                    x = x.combine_chunks()
                arrays.append(x if x.type == field.type else x.cast(field.type))
            out = pa.RecordBatch.from_arrays(arrays, schema=arrow)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, kind)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row i holds values[at[i]:at[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, type=kind))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
