"""Spark helpers of this subpackage: Arrow maps, merged fixed-size arrays."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm import text
from siftspark.session import cut


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def skeleton(s):
    """Column form of text.skeleton."""
    return s.map(text.skeleton, na_action="ignore")


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """list<int64> array of unsigned hashes."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


#: Codes of counts in one byte: exact to 127, beyond that steps of a fifth of a doubling, to 2**32 and more.
EXACT, STEPS = 128, 5
_COUNTS = np.r_[np.arange(EXACT), EXACT * 2.0 ** (np.arange(128) / STEPS)]


def code(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each; larger counts have larger or equal codes."""
    big = np.minimum(EXACT + STEPS * np.log2(np.maximum(counts, EXACT) / EXACT), 255)
    return np.where(counts < EXACT, counts, big).astype(np.uint8)


#: Of the cells' own type: numpy adds a Python number many times slower.
ONE = np.uint32(1)


def _pieces(cells: np.ndarray, piece: int):
    small = code(cells)
    for k in range(0, len(small), piece):
        yield k, zlib.compress(small[k : k + piece].tobytes(), 1)


def _added(pieces: DataFrame, size: int) -> np.ndarray:
    """Sum of the pieces (k, cells) on the executors, in codes; ``size`` bytes reach the driver."""

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in rows:
            for cells in b.column("cells"):
                x = _COUNTS[np.frombuffer(zlib.decompress(cells.as_py()), dtype=np.uint8)]
                total = x if total is None else total + x
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([zlib.compress(code(total).tobytes(), 1)], pa.binary())})

    out = np.zeros(size, dtype=np.uint8)
    for row in pieces.groupBy("k").applyInArrow(add, "k long, cells binary").toLocalIterator():
        cells = np.frombuffer(zlib.decompress(row.cells), dtype=np.uint8)
        out[row.k : row.k + len(cells)] = cells
    return out


def merge_counts(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], size: int, piece: int = 1 << 18) -> np.ndarray:
    """Sum over all batches of ``fn``'s indices counted in ``size`` cells, as codes of one byte.

    Every task holds one array and emits it in pieces, which are added on the
    executors. What reaches the driver are ``size`` bytes, whatever the number of rows.
    """

    def run(batches):
        cells = np.zeros(size, dtype=np.uint32)
        some = False
        for b in batches:
            i = fn(b)
            if len(i):
                some = True
                np.add.at(cells, i, ONE)
        if some:
            for k, x in _pieces(cells, piece):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "cells": pa.array([x], pa.binary())})

    return _added(df.mapInArrow(run, "k long, cells binary"), size)


def rows_and_counts(df: DataFrame, fn: Callable[[pa.RecordBatch, set], Iterator[tuple[list[pa.Array], np.ndarray]]], schema: str, size: int, piece: int = 1 << 18) -> tuple[DataFrame, np.ndarray]:
    """Rows and a count array from one pass over the texts.

    ``fn(batch, seen)`` yields (arrays of ``schema``, indices to count); ``seen``
    is a set of the task's own. The pass is written once, in the shared folder.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    types = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(types.schema)

    def run(batches):
        cells = np.zeros(size, dtype=np.uint32)
        seen: set = set()
        for b in batches:
            for arrays, i in fn(b, seen):
                np.add.at(cells, i, ONE)
                n = len(arrays[0])
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], [*names, "k", "cells"])
        if seen:
            for k, x in _pieces(cells, piece):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in fields], pa.array([k], pa.int64()), pa.array([x], pa.binary())], [*names, "k", "cells"])

    both = cut(df.mapInArrow(run, f"{schema}, k long, cells binary"))
    return both.where("k is null").select(*names), _added(both.where("k is not null").select("k", "cells"), size)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: a key of fixed size in place of long values."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(7), *reversed(cols), F.lit(13))]
