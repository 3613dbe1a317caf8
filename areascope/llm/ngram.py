"""TF-IDF vectors over hashed byte n-grams, and the document frequencies behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import byte_array, ship_package

#: Bytes of a text that are hashed at a time.
_PIECE = 1 << 22


def gram_counts(data: np.ndarray, dims: int, sizes: tuple = (2, 3)) -> np.ndarray:
    """How often each hashed byte n-gram occurs in the whole text."""
    out = np.zeros(dims, np.int64)
    for s in range(0, len(data), _PIECE):
        part = data[s: s + _PIECE + max(sizes) - 1].astype(np.uint32)
        for n in sizes:
            stop = min(len(part) - n + 1, _PIECE)
            if stop <= 0:
                continue
            code = np.full(stop, n, np.uint32)
            for j in range(n):
                code = (code << np.uint32(8)) | part[j: j + stop]
            code *= np.uint32(0x9E3779B1)
            out += np.bincount((code >> np.uint32(8)) % np.uint32(dims), minlength=dims)
    return out


def term_weights(counts: np.ndarray) -> np.ndarray:
    """Dampened term frequencies."""
    return np.log1p(counts).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame, vector: Callable, dims: int) -> np.ndarray:
    """Smoothed inverse document frequencies over all rows of ``docs`` (text).

    Each task sends one partial count a dimension; ``dims`` sums and one total reach the driver.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType.fromDDL("dim int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += vector(text) > 0
                rows += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.append(seen, rows))], schema=arrow)

    sums = docs.select("text").mapInArrow(run, schema).groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dims + 1)
    for dim, n in sums:
        df[dim] = n
    return (np.log((1 + df[dims]) / (1 + df[:dims])) + 1).astype(np.float32)


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def letter_bytes(text: str | None) -> np.ndarray:
    """The lower-cased letters (and whatever else lies beyond ASCII) of a text, with one space for all between."""
    data = _LETTERS[byte_array(" " + text.lower() + " " if text else text)]
    gap = data == 32
    return data[~gap | np.concatenate(([True], ~gap[:-1]))] if len(data) else data
