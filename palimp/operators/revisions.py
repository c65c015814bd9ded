"""The append-only revision table: reading, compacting, counting, selecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of a text in their order, and where the side stages belong.
WATERFALL = ["translate", "reflect", "proofread", "style", "verify", "repair"]
OVERVIEW = ["translate", "judge", "reflect", "proofread", "style", "verify"]
PARENT = {"reflect_notes": "reflect", "repair_verdicts": "repair"}


def stage_rank(stage: Column) -> Column:
    """1 for the first stage of the waterfall; null outside it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, WATERFALL)), stage), F.lit(0))


def meta_field(meta: Column, path: str, kind: str = "string") -> Column:
    """A field of JSON that may be null or malformed (then null)."""
    return F.try_variant_get(F.try_parse_json(meta), path, kind)


def age() -> Column:
    """Revision order: time, then sequence, as the clock is coarse and late rows occur."""
    return F.struct("created_at", "seq")


def rows(revisions: DataFrame, *columns: str, stages: list[str] | None = None) -> DataFrame:
    """The table as stored, repeats included, with ``chunk_id`` taken from meta in legacy rows: ``seq`` and
    ``columns`` of the given stages, both pushed to the scan. For readers that repeats cannot mislead,
    such as those that take the newest row."""
    if stages is not None:
        revisions = revisions.filter(F.col("stage") == stages[0] if len(stages) == 1 else F.col("stage").isin(stages))
    chunk = F.coalesce("chunk_id", meta_field(F.col("meta"), "$.chunk_id")).alias("chunk_id")
    return revisions.filter("seq is not null").select("seq", *[chunk if c == "chunk_id" else c for c in columns if c != "seq"])


def current(revisions: DataFrame, *columns: str, stages: list[str] | None = None) -> DataFrame:
    """``rows`` with repeats, which are unchanged rows, counted once. For readers that count: callers name
    lean columns only, as they are what is shuffled."""
    return rows(revisions, *columns, stages=stages).distinct()


def upsert(revisions: DataFrame) -> DataFrame:
    """The newest row of every key: what replacing by key would have left."""
    rest = [c for c in revisions.columns if c != "key"]
    return revisions.filter("key is not null").groupBy("key").agg(F.max_by(F.struct(*rest), age()).alias("r")).select("key", "r.*")


def stage_counts(revisions: DataFrame) -> DataFrame:
    return current(revisions, "stage").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def stage_stats(revisions: DataFrame) -> DataFrame:
    """Per stage: rows, chunks, legacy rows, cost and tokens (nulls as 0)."""
    rows = current(revisions, "stage", "book_id", "chunk_id", "cost_usd", "input_tokens", "output_tokens")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    legacy = F.count_if(F.col("chunk_id").isNull())
    chunks = F.count_distinct("book_id", "chunk_id")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), chunks.alias("n_chunks"), legacy.alias("n_legacy"), (chunks + legacy).alias("n_total"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), total("input_tokens"), total("output_tokens"))


def chunk_ids_of(revisions: DataFrame, stage: str) -> DataFrame:
    return rows(revisions, "book_id", "chunk_id", stages=[stage]).filter("chunk_id is not null").select("book_id", "chunk_id").distinct()


def latest_of(revisions: DataFrame, stage: str) -> DataFrame:
    """The newest revision of one stage for every chunk; the stage reaches the scan, one shuffle."""
    held = rows(revisions, "book_id", "chunk_id", "created_at", "content", stages=[stage]).filter("chunk_id is not null")
    return held.groupBy("book_id", "chunk_id").agg(F.max_by(F.struct("seq", "content"), age()).alias("r")).select("book_id", "chunk_id", "r.seq", "r.content")


def timeline(revisions: DataFrame) -> DataFrame:
    """Every revision of every chunk with its place in the chunk's history."""
    held = rows(revisions, "stage", "book_id", "chunk_id", "created_at").filter("chunk_id is not null")
    history = held.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set(F.struct("created_at", "seq", "stage"))).alias("h"))
    return history.select("book_id", "chunk_id", F.posexplode("h").alias("place", "x")).select("book_id", "chunk_id", "place", "x.seq", "x.stage")


def cleared_stages(stage: str) -> tuple[list[str], list[str]]:
    """What clearing from ``stage`` on removes: the text stages, and the side stages whose parent goes."""
    gone = WATERFALL[WATERFALL.index(stage) :]
    return gone, [s for s, parent in PARENT.items() if parent in gone]


def to_clear(revisions: DataFrame, stage: str) -> DataFrame:
    """The rows that clearing from ``stage`` on removes: it and all later stages, verdicts on them, side
    rows of their parents; never the glossary."""
    gone, side = cleared_stages(stage)
    held = rows(revisions, "stage", "book_id", "chunk_id", "cost_usd", "meta", stages=[*gone, *side, "judge"])
    judged = F.coalesce(meta_field(F.col("meta"), "$.judged_stage"), F.lit("translate"))
    return held.filter((F.col("stage") != "judge") | judged.isin(gone)).drop("meta").distinct()


def clear(revisions: DataFrame, stage: str) -> DataFrame:
    """The snapshot that is left: write it beside the old one, then point readers to it."""
    return revisions.join(to_clear(revisions, stage).select("seq"), "seq", "left_anti")


def preferences_left(preferences: DataFrame, stage: str) -> DataFrame:
    """The preferences that clearing from ``stage`` on leaves: those for a cleared stage go with it."""
    return preferences.filter(~F.col("preferred_stage").isin(cleared_stages(stage)[0]))


def cache_hits(requests: DataFrame, revisions: DataFrame, key: str = "key") -> DataFrame:
    """Requests with ``hit``: whether the key has been answered. Null keys never are."""
    known = revisions.select(F.col("key").alias("_k")).filter("_k is not null").distinct()
    return requests.join(known, F.col(key) == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def last_write(log: DataFrame, keys: list[str], order: list[str], deleted: str = "deleted") -> DataFrame:
    """The current rows of a log of writes and tombstones."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return newest.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
