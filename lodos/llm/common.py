"""What the operators of this subpackage share: the shared folder and written stages."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The regular expression of one word, here and in every operator: no space, no 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a worker has in hand at once, where rows are worked on one by one; a longer text is in hand alone.
IN_HAND = 1 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (local mode, as in tests) gets a temporary one; on a cluster, where executors
    could not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lodos-"))
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is removed when the JVM ends."""
    path = f"{shared_dir(spark)}/lodos/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a stage to the shared folder and reads it back, so that no lineage and no executor's disk holds it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join that no side is broadcast for. Spark sizes a table by its files and columns, too low after an explode, and packed files are
    several times as large in memory; a broadcast goes through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a stage that :func:`written` made and nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/lodos/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns to the system what this worker has freed; workers are used again, and count to their executor meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = IN_HAND) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``most`` bytes of a column. A batch may be a whole partition, and what is made
    of it several times as large; slices take no room. Behind the last one, what the worker has freed is given back.
    """
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist(), 1):
            held += n or 0
            if held >= most:
                yield batch.slice(start, i - start)
                start, held = i, 0
        if start < batch.num_rows or not batch.num_rows:
            yield batch.slice(start)
    give_back()


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
