"""Row-wise Arrow batches over a text column, for the operators that work on whole texts in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.runtime import quoted

#: A slice of a batch is worked on at once up to this many characters; a longer single text is a slice of its own.
SLICE_CHARS = 1_000_000


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and several wait beside each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def map_rows(df: DataFrame, columns: dict[str, str], out: str | T.StructType, work: Callable[[], Callable[[list[list]], list[list]]]) -> DataFrame:
    """Apply ``work()`` to slices of the rows of ``df``.

    columns: names in ``df`` to pass, keyed by the name they get; the last one holds the text by which slices are cut.
    work: called once in each Python worker task; gives a function from lists (one a column) to lists (one an output
    column). Rows keep their order; no shuffle.
    """
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    arrow = to_arrow_schema(schema)
    names = list(columns)
    slim = df.select(*[quoted(old).alias(new) for new, old in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        got = part = texts = None
        for batch in batches:
            start, n = 0, batch.num_rows
            texts = batch.column(len(names) - 1)
            while start < n:
                end, size = start, 0
                while end < n and (end == start or size < SLICE_CHARS):
                    v = texts[end]
                    size += len(v.as_buffer()) if v.is_valid else 0
                    end += 1
                part = batch.slice(start, end - start)
                got = step([part.column(i).to_pylist() for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(got, arrow, strict=True)], schema=arrow)
                start = end
        step = got = part = texts = None
        give_back()

    return slim.mapInArrow(run, schema)


def as_text(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))
