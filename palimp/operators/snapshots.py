"""Snapshots of small keyed tables (preferences, run metadata) and of the revision table: written beside
the old one, then pointed to, so that a reader sees all of a change or none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.operators.revisions import WATERFALL, chunk_ids_of

POINTER = "CURRENT"


class ChunkerMismatch(ValueError):
    """A run's chunking differs from the stored one."""


class Store:
    """A folder of small files on whatever file system its path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.system = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def text(self, name: str) -> str | None:
        if not self.system.exists(self.path(name)):
            return None
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file and closes it; on a file system with renames it appears whole, on an object store a
        closed write does."""
        stream = self.system.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def current(spark: SparkSession, folder: str) -> str | None:
    """The newest finished snapshot: the pointer of the highest number."""
    store = Store(spark, folder)
    if not store.system.exists(store.path("")):
        return None
    names = [s.getPath().getName() for s in store.system.listStatus(store.path(""))]
    done = sorted(n.removeprefix(f"{POINTER}-") for n in names if n.startswith(f"{POINTER}-"))
    return f"{store.folder}/{done[-1]}" if done else None


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    place = current(spark, folder)
    return spark.read.parquet(place) if place else None


def swap(df: DataFrame, folder: str) -> str:
    """Writes ``df`` as the next snapshot, then an empty pointer of its number: a reader sees the snapshot before
    or this one, whole, also where files cannot be renamed."""
    spark = df.sparkSession
    last = current(spark, folder)
    name = f"v{int(last.rsplit('/v', 1)[1]) + 1 if last else 1:06d}"
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    Store(spark, folder).put(f"{POINTER}-{name}", "")
    return f"{folder.rstrip('/')}/{name}"


def backup(spark: SparkSession, folder: str, to: str) -> str | None:
    """A copy of the newest snapshot below another folder, with its pointer; None if there is none."""
    held = read(spark, folder)
    return None if held is None else swap(held, to)


def check_preference(revisions: DataFrame, book_id: int, chunk_id: str, stage: str) -> None:
    """A preferred stage must be in the waterfall, and the chunk must have it."""
    if stage not in WATERFALL:
        raise ValueError(f"{stage} is no stage of {', '.join(WATERFALL)}")
    if chunk_ids_of(revisions, stage).filter((F.col("book_id") == book_id) & (F.col("chunk_id") == chunk_id)).isEmpty():
        raise ValueError(f"chunk {chunk_id} has no {stage}")


def meta(spark: SparkSession, folder: str, key: str):
    """The value stored under a key, or None."""
    held = Store(spark, folder).text(f"{key}.json")
    return None if held is None else json.loads(held)


def set_meta(spark: SparkSession, folder: str, key: str, value) -> None:
    Store(spark, folder).put(f"{key}.json", json.dumps(value, ensure_ascii=False, indent=2))


def chunker_params(spark: SparkSession, folder: str, params: dict) -> None:
    """Stores the chunking of a store once; a later run with another is an error, a store without passes."""
    known = meta(spark, folder, "chunker")
    if known is None:
        set_meta(spark, folder, "chunker", params)
    elif known != params:
        raise ChunkerMismatch(f"stored {known}, asked {params}")


#: The stages of a run in their order; those that wait for a person are not recorded as done, and
#: those that stand for the finished text are taken back when it is cleared.
RUN_STAGES = ["init", "extract", "glossary", "pause_1", "translate", "pause_2", "done"]
WAITING, FINISHED = ("pause_1", "pause_2"), ("translate", "pause_2", "done")


def advance(state: dict, stage: str) -> dict:
    """The state of a run, ``{"stage", "completed"}``, gone on to ``stage``, which is recorded once unless it waits."""
    if stage not in RUN_STAGES:
        raise ValueError(f"{stage} is no stage of a run")
    done = list(state.get("completed", []))
    return {"stage": stage, "completed": done if stage in WAITING or stage in done else [*done, stage]}


def taken_back(state: dict) -> dict:
    """The state after its text was cleared: the stages that stood for it are no longer recorded."""
    return {**state, "completed": [s for s in state.get("completed", []) if s not in FINISHED]}
