"""Files in any store: written by the tasks that hold their bytes, in one step each."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where one machine is all there is may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"{tempfile.gettempdir()}/quilter-shared"


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder; what is gone already, or cannot be reached any more, is left."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the driver exits."""
    path = f"{shared_dir(spark)}/quilter-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def _put(batches: Iterator[pa.RecordBatch], path: str, suffix: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    for batch in batches:
        names, sizes = [], []
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, whole = data.as_py(), f"{root}/{name}{suffix}"
            part = f"{root}/_{name}.{uuid.uuid4().hex}"  # readers pass over names with an underscore
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, whole)  # a task that is run again puts the same bytes in the same place
            names.append(f"{name}{suffix}")
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])


def write_files(rows: DataFrame, name_col: str, data_col: str, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Writes each row's bytes to a file of its own under ``path``; (name, bytes) of each file, which is one row an image."""
    d = rows.select(F.col(name_col).cast("string"), F.col(data_col)).mapInArrow(partial(_put, path=path, suffix=suffix), "name string, bytes long")
    return sorted((r["name"], r["bytes"]) for r in d.collect())
