"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset on one machine, as in tests, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-quillmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Open(threading.local):
    """Folders that this thread has written since its innermost open swept() began; None outside of any. Batches of a stream run in threads of their own."""

    written: list[str] | None = None


_open = _Open()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage is cut, and lost executors lose nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open.written is not None:
        _open.written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote, once no later step reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Working tables written within go at the end, whatever happens; so what is returned from within must not read them any more, but be written elsewhere."""
    outer, _open.written = _open.written, []
    try:
        yield
    finally:
        made, _open.written = _open.written, outer
        for folder in made:
            remove(spark, folder)
