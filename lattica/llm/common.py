"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch that are Python objects at one time, and bytes of their texts (a longer text goes alone).
ROWS, BYTES = 512, 4 << 20
_held: dict = {}


def held(key: tuple, make: Callable):
    """A worker's vocabulary, automaton or cache: one at a time, so operators that follow each other in a worker don't add up."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # where the C library can, give the memory back
                ctypes.CDLL(None).malloc_trim(0)
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet under the shared folder and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(col):
    """A-Z only: other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def replaced(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """schema with fields in place of columns of the same name (compared as Spark does, without case), new ones last."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def portions(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """(first row, rows) of portions of columns: at most ROWS rows and BYTES of strings and binaries, one row at least."""
    rows = len(columns[0])
    sizes = np.zeros(rows, np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, out, at = np.cumsum(sizes), [], 0
    while at < rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
        n = max(1, min(ROWS, upto - at))
        out.append((at, n))
        at += n
    return out


def map_rows(df: DataFrame, schema: T.StructType, inputs: list[str], compute: Callable[..., dict[str, list]]) -> DataFrame:
    """Add computed columns to df, at most ROWS rows and BYTES of texts of an Arrow batch at a time.

    compute gets a Python list for each input column and returns a list for each of the schema's
    columns that is not passed through. Columns of df that the schema does not name are dropped.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, n) for b in batches for i, n in portions([b.column(b.schema.get_field_index(c)) for c in inputs])):
            out = compute(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            columns = [pa.array(out[f.name], f.type) if f.name in out else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in target]))

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def total(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0
