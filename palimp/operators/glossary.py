"""Glossaries: entries, merging a book's into a series', rendering, summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.jsonfix import ENTRY_TYPES, OVERRIDE, read_glossary
from palimp.functions.text import squeeze
from palimp.operators.revisions import meta_field
from palimp.plans.ranking import running_total

#: Fixed value: what stands for a glossary without entries.
NO_TERMS = "(no known terms yet)"


def type_rank(kind: Column) -> Column:
    """0 for the first type; 99 for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENTRY_TYPES)), kind), F.lit(0)) - 1, F.lit(99))


def entries(candidates: DataFrame) -> DataFrame:
    """Glossary entries of a candidate table: one row per ``cand_id``, null genders ``unknown``."""
    one = candidates.filter("cand_id is not null").dropDuplicates(["cand_id"])
    return one.select("cand_id", "book_id", "original", "translation", F.col("entry_type").alias("type"), F.coalesce("gender", F.lit("unknown")).alias("gender"), F.col("note_text").alias("notes"))


def promote(book: DataFrame, series: DataFrame, approved: Column | None = None) -> DataFrame:
    """``(cand_id, original, outcome, series_translation)`` for every entry of ``book`` (with ``series``
    naming where it goes): ``unapproved``, ``added``, ``existing`` or ``conflict``.

    ``series`` has ``(series, original, translation)``, of repeats the last by ``pos``. In the book the
    first approved entry of a term that the series lacks is added and is what later ones compare with.
    A null original stays out."""
    known = series.groupBy("series", "original").agg(F.max_by("translation", "pos").alias("_known"))
    rows = book.filter("original is not null").withColumn("_ok", F.coalesce(approved, F.lit(False)) if approved is not None else F.lit(True))
    joined = rows.join(known, ["series", "original"], "left")
    order = Window.partitionBy("series", "original", "_ok").orderBy("pos")
    first = F.first("translation").over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(order)
    against = F.coalesce("_known", F.when(F.col("_n") > 1, F.col("_first")))
    outcome = F.when(~F.col("_ok"), "unapproved").when(against.isNull(), "added").when(against.eqNullSafe(F.col("translation")), "existing").otherwise("conflict")
    return joined.withColumn("_n", n).withColumn("_first", first).select("cand_id", "series", "original", "translation", outcome.alias("outcome"), F.when(F.col("_ok"), against).alias("series_translation"))


def merged(book: DataFrame, series: DataFrame, approved: Column | None = None) -> DataFrame:
    """The series after promotion, ``(series, original, translation, type, place)``: its own entries and those
    that ``promote`` adds, ordered by type, then original without case (``place`` counts from 0).
    ``series`` also has ``type``."""
    own = series.groupBy("series", "original").agg(F.max_by(F.struct("translation", "type"), "pos").alias("r")).select("series", "original", "r.*")
    made = promote(book, series, approved).filter("outcome = 'added'").join(book.select("cand_id", "type"), "cand_id").select("series", "original", "translation", "type")
    every = own.unionByName(made)
    return running_total(every, ["series"], type_rank(F.col("type")), [F.lower("original"), F.col("original")], F.lit(1), "place")


def render(df: DataFrame, keys: list[str], every: DataFrame | None = None) -> DataFrame:
    """``(*keys, block)``: one line per entry in order, ``original | translation | type[, gender] | notes``;
    notes on one line, over 120 characters cut to 117 and an ellipsis. Keys of ``every`` without entries
    get ``NO_TERMS``. A key is one glossary, which has to fit a prompt."""
    notes = squeeze(F.col("notes"))
    short = F.when(F.length(notes) > 120, F.concat(F.substring(notes, 1, 117), F.lit("..."))).otherwise(notes)
    meta = F.when((F.col("type") == "person") & F.col("gender").isNotNull(), F.concat_ws(", ", "type", "gender")).otherwise(F.col("type"))
    line = F.concat(F.concat_ws(" | ", "original", "translation", meta), F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.concat(F.lit(" | "), short)).otherwise(""))
    blocks = df.groupBy(*keys).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("cand_id", line.alias("line")))), lambda x: x["line"])).alias("block"))
    return blocks if every is None else every.join(blocks, keys, "left").select(*keys, F.coalesce("block", F.lit(NO_TERMS)).alias("block"))


def summary(df: DataFrame) -> DataFrame:
    """Entries and overrides per type, and their total (type ``total``); ``place`` is the order to show them
    in, the total last."""
    marked = F.count_if(F.col("notes").startswith(OVERRIDE))
    return df.rollup("type").agg(F.count(F.lit(1)).alias("n"), marked.alias("n_override"), F.grouping("type").alias("_g")).select(F.when(F.col("_g") == 1, "total").otherwise(F.col("type")).alias("type"), "n", "n_override", F.when(F.col("_g") == 1, 100).otherwise(type_rank(F.col("type"))).alias("place"))


def top(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries of each type by original, with how many more there are."""
    order = Window.partitionBy("type").orderBy(F.lower("original"), "cand_id")
    size = df.groupBy("type").agg(F.count(F.lit(1)).alias("_all"))
    ranked = df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return ranked.join(size, "type").select("type", "place", "cand_id", "original", F.greatest(F.col("_all") - n, F.lit(0)).alias("n_more"))


def read_replies(replies: DataFrame, id_col: str, text_col: str, marks: bool = True) -> DataFrame:
    """``(id, outcome, n_invalid, entries)`` of glossary replies: ``read``; ``cut_start`` or ``cut_end`` if a mark
    that the request put before or behind the book (columns ``bookstart``, ``bookend``) did not come back,
    so that the reply is about part of it; ``empty``; or ``unreadable``. Only what is ``read`` has entries.
    Without ``marks`` none are looked for."""
    kind = replies.schema[id_col].dataType.simpleString()
    entry = "original string, translation string, plural string, notes string, type string, gender string"
    fields = [f.split()[0] for f in entry.split(", ")]
    named = replies.select(id_col, text_col, *((F.col("bookstart"), F.col("bookend")) if marks else (F.lit(None).cast("string").alias("bookstart"), F.lit(None).cast("string").alias("bookend"))))

    def one(text, start, end):
        if not (text or "").strip():
            return "empty", None, None
        try:
            first, last, held, bad = read_glossary(text)
        except (ValueError, RecursionError):
            return "unreadable", None, None
        if marks and (first or "") != start:
            return "cut_start", bad, None
        return ("cut_end", bad, None) if marks and (last or "") != end else ("read", bad, held)

    def run(batches):
        for batch in batches:
            out = [one(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            held = pa.list_(pa.struct([(f, pa.string()) for f in fields]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], held)], names=[id_col, "outcome", "n_invalid", "entries"])

    return named.mapInArrow(run, f"{id_col} {kind}, outcome string, n_invalid int, entries array<struct<{entry.replace(' string', ':string')}>>")


def guarded(stored: DataFrame) -> DataFrame:
    """Stored glossary replies that can be trusted: those whose meta has both marks."""
    has = lambda f: meta_field(F.col("meta"), f"$.{f}").isNotNull()
    return stored.filter(has("bookstart") & has("bookend"))
