"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir, cut_lineage, ship_package

__all__ = ["table", "cut_lineage", "map_rows", "schema_of", "scratch_path", "held_out", "hash_fraction", "sha", "small_enough",
           "shuffle_parts", "ship_package"]

#: Words are runs of anything but space and tab..carriage return (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{int(time.time())}-{uuid.uuid4().hex[:8]}"


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 modulo 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_fraction(*cols: Column) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_of(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The columns ``keep`` of ``df`` as they are, then those of the DDL string ``more``."""
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: T.StructType) -> DataFrame:
    """``fn`` over the columns of each row, in Arrow batches; one output row for each input row.

    Columns are handed over as Python values, null as ``None``; a few hundred rows are held as such at a time.
    """
    def one(*values) -> Iterator[tuple]:
        yield fn(*values)

    return flat_map_rows(df, one, schema, rows=512)


def flat_map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: T.StructType, rows: int = 128) -> DataFrame:
    """Like ``map_rows``, but ``fn`` yields any number of rows, and at most ``rows`` are held as Python values."""
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def batch_of(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for values in zip(*(c.to_pylist() for c in batch.slice(start, rows).columns)):
                    for row in fn(*values):
                        found.append(row)
                        if len(found) >= rows:
                            yield batch_of(found)
                            found = []
        yield batch_of(found)

    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps.

    Spark drops them when the driver's JVM collects the plans that made them, which it may not do for hours while
    the executors' disks fill. Call it after a step's result is written and the frames behind it are gone.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read back: lineage cut, columns pruned by later reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table whose every use has itself been written."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_array(text: str | None) -> np.ndarray:
    return np.frombuffer(utf8(text), dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
