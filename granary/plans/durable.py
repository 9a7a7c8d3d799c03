"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete the shuffle files of a statement once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that a Python worker gets at once (64 MB by default), and a limit that keeps a worker small.
_AT_ONCE, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder is, but only if the driver runs the tasks itself: the executors of a cluster
    would each write to a disk of their own, and what is read back would be incomplete.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, partition_by: list[str] | None = None, at_once: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut, and lost executors cost no recomputation. at_once: bytes of rows that a Python worker gets at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    with _set(spark, {_CLEANUP: "true"} | ({_AT_ONCE: str(at_once)} if at_once else {})):
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            table._stored_at = None
