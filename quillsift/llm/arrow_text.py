"""Small helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; bounds the arrays made from them.
SLICE_BYTES = 1 << 20


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, text) of ``docs`` with null texts as empty, and no other input columns."""
    return docs.select(
        docs[id_col].cast("long").alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *more,
    )


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus))


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = string_offsets(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def string_offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's values in its data buffer, as int64."""
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind, count=array.offset + len(array) + 1)
    return offsets[array.offset :].astype(np.int64)


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, one after the other, and each value's offset in them."""
    offsets = string_offsets(array)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
