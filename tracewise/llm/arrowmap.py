"""Narrow Arrow stages that add columns to a table of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewise.llm.textops import SLICE_BYTES, slices


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, by exact name, so that other columns of whatever name never get in the way."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives its free memory back: it outlives the task, beside the executor's heap."""

    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return run_and_trim


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """``df`` with ``fields`` added; input columns of those names are replaced.

    ``make()`` runs once in each task and returns the function that gets rows of about ``most`` bytes of text and returns the new columns.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    if text.lower() in names:
        raise ValueError(f"{text} is both the text column and a result column")
    df = only(df, *[f.name for f in kept]).toDF(*[f"c{i}" for i in range(len(kept))])  # mapInArrow takes no name with a dot
    out = [f for f in kept if keep is None or f.name in keep] + fields
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    arrow = to_arrow_schema(schema)
    at = [i for i, f in enumerate(kept) if keep is None or f.name in keep]
    own = [f.name for f in kept]
    new = [arrow.field(len(at) + i) for i in range(len(fields))]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=own), text, most):
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(work(part), new, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i).cast(arrow.field(k).type) for k, i in enumerate(at)] + made, schema=arrow)

    return df.mapInArrow(trimmed(run), schema)


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))
