"""Cutting lineage and sharing work in ways that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A written table is broadcast up to this many rows, of some 60 bytes each.
BROADCAST_ROWS = 400_000


class NoCheckpointFolder(RuntimeError):
    """The session names no shared folder, and none can be guessed on a cluster."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder in tests on a single machine; on a cluster, whose machines share no such folder, an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*)?", context.master):
                raise NoCheckpointFolder("set spark.checkpoint.dir to a folder that all executors reach")
            named = tempfile.mkdtemp(prefix="palimp-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read back, so that later stages neither
    recompute it nor depend on any executor that made it. It is computed once (a checkpoint would compute its
    last stage twice), and its size is known to the planner. The order of its rows is not kept: ``pinned``
    keeps it. ``clean`` removes what was written."""
    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: rows keep their partitions and their order in them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(spark: SparkSession) -> None:
    """Removes this application's tables and checkpoints. Frames that were read from them can no longer be used."""
    place = spark.sparkContext.getCheckpointDir()
    if place is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def meet(large: DataFrame, small: DataFrame, on: list, how: str) -> DataFrame:
    """A join with a written table: broadcast if counting shows that it is small, else left to the planner."""
    return large.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has task slots. Large inputs are read in as many and
    stay as they are; only inputs of a few small files are redistributed before CPU-bound work. What is not
    read from files is left as it is planned. Told from the files' sizes: nothing is planned or run."""
    spark = df.sparkSession
    slots, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= slots:
        return df
    path, hadoop = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    sizes = [path(f).getFileSystem(hadoop).getFileStatus(path(f)).getLen() for f in files]
    conf = spark._jsparkSession.sessionState().conf()
    open_cost = conf.filesOpenCostInBytes()
    split = min(conf.filesMaxPartitionBytes(), max(open_cost, (sum(sizes) + open_cost * len(sizes)) // slots))
    return df if sum(-(-size // split) for size in sizes) >= slots else df.repartition(slots)
