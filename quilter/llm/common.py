"""Shared plumbing of the training-data operators: tables, staging, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
import quilter
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quilter.sources.store import forget, scratch

#: Rows and bytes of an Arrow batch: texts may be very long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: A key is hot that has more rows than HOT_ROWS and than one in HOT_KEYS of all; so no more than HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 1000, 4096

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(quilter)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores as keep it from meeting another."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded in rows and bytes for the actions inside; the session's own bounds hold again afterwards."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Staged:
    """Tables written once to the shared folder and read again: lineage ends there, so a lost executor costs nothing.

    Tables still needed by a lazy result stay until the driver exits; ``drop`` removes one earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch(spark)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        forget(self.spark, f"{self.root}/{name}")


def _give_back() -> None:
    """Memory that is free in this process goes back to the system, as far as the C library knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _bounded(batches: Iterator[pa.RecordBatch], fn: Callable) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = max(1, min(BATCH_ROWS, n * BATCH_BYTES // max(1, batch.nbytes)))
            for at in range(0, n, rows):
                yield batch.slice(at, rows)

    try:
        yield from fn(pieces())
    finally:
        _give_back()  # the worker lives on, for other tasks


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches bounded in rows and bytes, whatever the session's own bounds, which stay as they are."""
    return df.mapInArrow(partial(_bounded, fn=fn), schema)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Rows joined with their key's facts (one row a key; ``weight`` of them are its rows, of ``total``), wherever a hot key's rows stand.

    Facts of hot keys, HOT_KEYS rows at most, are broadcast; the others' rows are shuffled by key. Both inputs are read twice.
    """
    hot = F.col(weight) > max(HOT_ROWS, total // HOT_KEYS)
    few = facts.where(hot)
    first = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~hot), key, how)
    return first.unionByName(rest)
