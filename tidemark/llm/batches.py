"""Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

CHUNK_BYTES = 3 << 20


def release_memory() -> None:
    """Give what has been freed back to the system: workers stay on between stages, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def texts_in_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about ``size`` bytes of text (one row at least) and their texts, null as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        done = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = done[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(done, before + size, "right")))
            part = batch.slice(at, to - at)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            at = to
        release_memory()


def with_fields(table: DataFrame, **kinds: DataType) -> StructType:
    """The schema of ``table`` and further fields."""
    return StructType([*table.schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])
