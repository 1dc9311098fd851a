"""Small helpers for functions that see Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory: Python workers are used again, so it would add to what the next
    step needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, carry: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow`` for a function that gives new columns, one value per row, from a batch.

    ``carry`` names the columns that are handed on untouched. ``make`` runs once per task.
    """
    new = T.StructType.fromDDL(schema)
    fields = [(f.name, arrow_type(f.dataType)) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                made = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], type=t) for n, t in fields]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made], names=[*carry, *(n for n, _ in fields)])
                del batch, columns, made
        del step
        give_back()

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in carry] + new.fields))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]]) -> DataFrame:
    """``mapInArrow`` for a generator of dictionaries of columns, with any number of rows."""
    target = T.StructType.fromDDL(schema)
    fields = [(f.name, arrow_type(f.dataType)) for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make()(batches):
            made = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], type=t) for n, t in fields]
            yield pa.RecordBatch.from_arrays(made, names=[n for n, _ in fields])
            del columns, made
        give_back()

    return df.mapInArrow(run, target)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
              "binary": pa.binary(), "float": pa.float32()}
    return simple[t.simpleString()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as its UTF-8 bytes, which Arrow holds anyway."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """A list column from one flat array."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
