"""Revisions as a stream: an extension, for stores that are written to all the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimp.operators.revisions import age


def stage_activity(revisions: DataFrame, late: str = "7 days", window: str = "1 hour") -> DataFrame:
    """Rows and tokens per stage and window of ``created_at``. Repeats within ``late`` count once; later
    rows are dropped by the watermark. Works on a stream and, the same, on a table."""
    once = revisions.filter("created_at is not null and seq is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["seq"]) if revisions.isStreaming else revisions.filter("created_at is not null and seq is not null").dropDuplicates(["seq"])
    return once.groupBy(F.window("created_at", window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")).select("w.start", "stage", "n", "output_tokens")


def keep_latest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch, reduced to its newest row per key, as ``batch=<n>`` below ``folder``; a batch that runs
    twice writes the same. ``latest`` reads the newest rows of all batches, ``compact`` puts them into one."""

    def append(batch: DataFrame, n: int) -> None:
        newest_by_key(batch).write.mode("overwrite").parquet(f"{folder}/batch={n:010d}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_by_key(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c != "key"]
    return rows.filter("key is not null").groupBy("key").agg(F.max_by(F.struct(*rest), age()).alias("r")).select("key", "r.*").select(*rows.columns)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every key: of the last compacted state, if there is one, and the batches since."""
    return newest_by_key(spark.read.parquet(folder).drop("batch"))


def compact(spark: SparkSession, folder: str) -> None:
    """Replaces all batches by one that has the newest rows; run it while no stream writes. The state is written
    beside the batches under a number of its own before they are removed: a reader that meets both sees
    rows twice, which ``latest`` takes once."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [status.getPath() for status in system.listStatus(root) if status.getPath().getName().startswith("batch=")]
    last = max(int(p.getName().split("=")[1]) for p in old)
    made = hadoop.Path(f"{folder}/.compacting")
    latest(spark, folder).write.mode("overwrite").parquet(str(made))
    for p in old:
        if int(p.getName().split("=")[1]) != last:
            system.delete(p, True)
    place = hadoop.Path(f"{folder}/batch={last:010d}")
    system.delete(place, True)
    system.rename(made, place)
