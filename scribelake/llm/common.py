"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII white-space characters, for translate() and strip().
ASCII_SPACE = " \t\n\x0b\x0c\r"

WORD_RE = re.compile(WORD)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="scribelake-")  # one machine: its own folder is shared
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


#: Folder below the application's that tables are written to, innermost last.
_SCOPES: list[str] = []


def new_path(spark: SparkSession, outside: bool = False) -> str:
    """A path for a table in the shared folder; ``outside`` of the innermost :func:`scratch`, so that it stays."""
    scopes = _SCOPES[:-1] if outside else _SCOPES
    return "/".join([shared_dir(spark), "scribelake", spark.sparkContext.applicationId, *scopes, uuid.uuid4().hex])


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`materialize` writes inside are deleted at the end; only for what is not read afterwards."""
    path = new_path(spark)
    _SCOPES.append(path.rsplit("/", 1)[1])
    try:
        yield
    finally:
        _SCOPES.pop()
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage; the files outlive any executor, so a lost executor costs a re-read and not a
    recomputation. They stay until the owner of ``spark.checkpoint.dir`` clears it or
    :func:`release` is called.
    """
    spark = df.sparkSession
    if columns:
        df = df.select(*columns)
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


#: What makes Python workers give freed memory back at once instead of keeping it for later batches.
_LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def bound_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Hand rows to Python workers in batches of about ``size`` bytes, where the session doesn't set it, and keep the workers lean.

    By default a batch holds 10,000 rows however long they are. Several operators that run one after
    the other share an executor with the workers of all of them, so there each should stay small.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(size))
    # columns of long texts are read some hundred rows at a time, so their arrays stay small on the JVM's side too
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(rows) == "4096":
        spark.conf.set(rows, "512")
    env = spark.sparkContext.environment
    env.update({k: v for k, v in _LEAN.items() if k not in env})


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int):
    """Inside, Python workers get batches of about ``size`` bytes; only for what is written inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Delete everything that :func:`materialize` wrote in this application."""
    delete(spark, f"{shared_dir(spark)}/scribelake/{spark.sparkContext.applicationId}")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit word (wraps on overflow)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def sample_share(rows: int, bound: int) -> int:
    """Millionths of rows to keep so that about ``bound`` of ``rows`` stay."""
    return 1_000_000 if rows <= bound else max(1, bound * 1_000_000 // rows)


def in_sample(key, share: int, salt: str = "sample"):
    """Column: the key falls into a seeded sample of ``share`` millionths; the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < F.lit(share)


def held_out(key, parts: int, part: int):
    """Column: crc32 of the key as text leaves ``part`` modulo ``parts``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == F.lit(part)


def objects(column: pd.Series) -> np.ndarray:
    """The values of a column for a new frame; text columns of a batch are arrays of objects, not of Arrow pieces."""
    values = column.to_numpy()
    return values if values.dtype != object and values.dtype.kind in "iufb" else np.array(list(values), dtype=object)


def pieces(texts: pd.Series, limit: int = 1 << 17):
    """Split a batch of texts into runs of about ``limit`` characters; yields (first row, texts).

    Bounds the size of the numpy arrays made from one run; a single text is never cut.
    """
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run
