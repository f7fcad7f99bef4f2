"""What the operators share: the shared folder, tables that cut lineage, text keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master may lack it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this Python ends."""
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass

    atexit.register(remove)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a lost executor costs no recomputation of what came before, and later steps read only the columns they use."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of this very name, whatever letters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, names: list[str] | None = None) -> Column:
    """A struct of columns, all by default, under their own names."""
    return F.struct(*[column(c).alias(c) for c in names or df.columns])


#: Bytes of texts that a Python worker takes in hand together; a longer text is taken alone.
BYTES_AT_ONCE = 16 << 20


def slices(texts, rows: int, most: int | None = None):
    """Parts of an Arrow array of texts, one after the other, of up to so many rows and bytes; a part holds a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    most = most or BYTES_AT_ONCE
    at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield texts.slice(at, to - at)
        at = to


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def filesystem(uri: str):
    """pyarrow's file system of a URI or a path, and the path there. Files that workers write themselves go to file, hdfs (with its client library), s3, s3a or gs."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme = uri.partition(":")[0]
    if scheme not in ("file", "hdfs", "s3", "s3a", "gs"):
        raise ValueError(f"workers can't write files to {scheme}: set spark.checkpoint.dir to a folder of file, hdfs, s3, s3a or gs")
    return fs.FileSystem.from_uri("s3" + uri[3:] if scheme == "s3a" else uri)


def estimated_bytes(df: DataFrame, text: str) -> int:
    """About the bytes that the rows take: what Spark's statistics say of files, without reading any; the texts' lengths where they know nothing, as for rows that are no files or come from joins."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 50 else df.agg(F.coalesce(F.sum(F.octet_length(column(text))), F.lit(0))).first()[0]


_held: dict = {"owner": None}


def give_back() -> None:
    """Returns what this Python worker's allocators hold without need. Workers stay between tasks; what they hold then counts against the executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def claim(owner: str) -> dict:
    """What this Python worker keeps from task to task for an operator. Workers serve one operator after the other: the first task of another one drops what was kept, and gives the memory back."""
    if _held["owner"] != owner:
        _held.clear()
        _held["owner"] = owner
        gc.collect()
        give_back()
    return _held
