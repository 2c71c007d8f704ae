"""Whole texts through Arrow: slices of bounded size, computed columns beside the ones that were there."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A slice holds at most so many rows and, unless one text alone is longer, so many bytes of text.
SLICE_ROWS, SLICE_BYTES = 2_000, 3_000_000
GATHERED_BYTES = 12_000_000


#: Rows that Spark hands to Python at once, where the session has no setting of its own. Texts may be long.
BATCH_ROWS = 1_000
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def release() -> None:
    """Hand freed memory back, since a worker lives on and its later tasks may be of another kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded size; each task hands its memory back at its end."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right"))), at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def gathered(parts: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Parts put together up to GATHERED_BYTES of text, for work that costs less on many texts at once."""
    held, n_held = [], 0
    for part in parts:
        held.append(part)
        n_held += part.column(text).nbytes
        if n_held > GATHERED_BYTES:
            yield pa.concat_batches(held)
            held, n_held = [], 0
    if held:
        yield pa.concat_batches(held)


def free(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], start: Callable[[], Callable[[list], list]], drop: tuple[str, ...] = (), arrow: bool = False) -> DataFrame:
    """df with columns computed from the text column.

    start() runs once a task and returns a function from a list of texts (None for null), or their Arrow array if arrow
    is set, to one list or Arrow array for each field. Columns of df that have a field's name are replaced; those in drop are left out.
    """
    names = {name for name, _ in fields}
    keep = [f.name for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    wanted = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(wanted)]
        work = start()
        for part in gathered(slices(batches, text), text) if arrow else slices(batches, text):
            made = work(part.column(text) if arrow else part.column(text).to_pylist())
            made = [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *(f.name for f in wanted)])

    source = df if text in keep else df.select(*keep, text)
    return mapped(source, run, schema)
