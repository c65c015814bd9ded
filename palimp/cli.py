"""Commands over a store: a folder with ``revisions.parquet``, ``chunks.parquet`` and, where set, preferences;
what commands change is kept as snapshots."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.functions import text as X
from palimp.functions.udfs import slugify, unified_diff
from palimp.operators import chunking, glossary, notes, snapshots
from palimp.operators import revisions as R
from palimp.operators import verdicts as V
from palimp.operators import waterfall as W
from palimp.plans import pipeline, settings
from palimp.plans.ship import ship
from palimp.sources import epub
from palimp.sources.tables import table

SHOWN = 10_000
PREFERENCE = "book_id bigint, chunk_id string, preferred_stage string, reason string, at bigint, deleted boolean"


def _revisions(spark: SparkSession, a) -> DataFrame:
    return snapshots.read(spark, os.path.join(a.store, "snapshots", "revisions")) or table(spark, a.store, "revisions")


def _log(spark: SparkSession, a) -> DataFrame | None:
    return snapshots.read(spark, os.path.join(a.store, "snapshots", "preferences"))


def _preferences(spark: SparkSession, a) -> DataFrame | None:
    log = _log(spark, a)
    return None if log is None else R.last_write(log, ["book_id", "chunk_id"], ["at"])


def status(spark, a) -> DataFrame:
    rows, wanted = _revisions(spark, a), _preferences(spark, a)
    if a.scores:
        shown = V.scores(rows)
        return (shown.filter(F.col("score") < a.below) if a.below else shown).orderBy("score", "chunk_id", "seq")
    if a.grid:
        reflected = not R.chunk_ids_of(rows, "reflect").isEmpty()
        return W.grid_wide(rows, V.latest_verdicts(rows, None), reflected).orderBy("book_id", "chunk_id")
    if a.assembly_map:
        return W.resolve(rows, wanted).groupBy("stage", "reason").count().orderBy("stage", "reason")
    if a.diff:
        return unified_diff(rows, a.diff, a.stages.split(",") if a.stages else None).orderBy("seq")
    return R.stage_stats(rows).withColumn("_r", F.coalesce(R.stage_rank(F.col("stage")), F.lit(99))).orderBy("_r", "stage").drop("_r")


def _inputs(spark, a, rows: DataFrame) -> DataFrame:
    """What a stage is asked about: the chunks' paragraphs as ``source`` and, behind translation, the valid text before
    the stage as ``text``; the verdict is in ``issues``."""
    keys = ["book_id", "chunk_id"]
    chunks = table(spark, a.store, "chunks", *keys, "chapter_idx", "para_idx").filter("chunk_id is not null").dropDuplicates(keys)
    places = chunks.select(*keys, "chapter_idx", F.posexplode("para_idx").alias("pos", "para_idx"))
    texts = chunking.distinct_paragraphs(table(spark, a.store, "paragraphs", "book_id", "chapter_idx", "para_idx", "text"))
    source = places.join(texts, ["book_id", "chapter_idx", "para_idx"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))).alias("ps"))
    counts = chunks.select(*keys, F.size("para_idx").alias("n_expected"))
    asked = source.join(counts, keys).select(*keys, "n_expected", X.join_markers(F.transform("ps", lambda x: x["t"])).alias("source"))
    if a.stage != "translate":
        before = W.valid_before(rows, counts, None if a.stage == "judge" else a.stage)
        verdicts = V.latest_verdicts(rows).select(*keys, F.array_join("issues", "; ").alias("issues"))
        asked = asked.join(before.select(*keys, X.join_markers(F.col("paragraphs")).alias("text")), keys).join(verdicts, keys, "left").withColumn("issues", F.coalesce("issues", F.lit("")))
    return asked.orderBy("book_id", "chunk_id").limit(a.limit_chunks) if a.limit_chunks else asked


def stage(spark, a) -> DataFrame:
    """Runs a stage over the store: requests from a prompt file, replies from a table of them by key. New revisions and
    the replies that were of no use are kept as snapshots; without replies, shows what would be asked."""
    rows, model = _revisions(spark, a), a.model or settings.load(a.settings).models.get(a.stage, "model")
    with open(a.prompt, encoding="utf-8") as held:
        prompt = pipeline.load_prompt(held.read())
    given = _inputs(spark, a, rows), prompt.version or "1", prompt.system, prompt.user
    if not a.replies:
        return pipeline.requests_for(given[0], a.stage, model, *given[1:]).select("book_id", "chunk_id", "key", "system", "user").orderBy("book_id", "chunk_id")
    source = pipeline.table_source(spark.read.parquet(a.replies))
    run = pipeline.run_judge(given[0], rows, source, model, *given[1:]) if a.stage == "judge" else pipeline.run_checked(given[0], rows, source, a.stage, model, *given[1:])
    last = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    made = run.made.withColumn("seq", last + 1 + F.monotonically_increasing_id()).withColumn("created_at", F.current_timestamp().cast(rows.schema["created_at"].dataType))
    snapshots.swap(rows.unionByName(made, allowMissingColumns=True).select(*rows.columns), os.path.join(a.store, "snapshots", "revisions"))
    lost = snapshots.read(spark, os.path.join(a.store, "snapshots", "rejects"))
    snapshots.swap(run.rejects if lost is None else lost.unionByName(run.rejects), os.path.join(a.store, "snapshots", "rejects"))
    return pipeline.run_stats(run.outcomes).orderBy("outcome")


def glossary_file(spark, a) -> DataFrame:
    """Shows a glossary file, or makes an empty one of a series (``--init TITLE``, ``--author``)."""
    if a.init:
        return spark.createDataFrame([(settings.init_series(a.file, slugify(a.init), a.init, a.author or ""),)], "made string")
    entries = [(n, 0, e["original"], e["translation"], e["type"], e["gender"], e["notes"]) for n, e in enumerate(settings.load_glossary(a.file)["entries"])]
    df = spark.createDataFrame(entries, "cand_id bigint, book_id bigint, original string, translation string, type string, gender string, notes string")
    return glossary.top(df, a.top).orderBy(glossary.type_rank(F.col("type")), "place") if a.top else glossary.summary(df).orderBy("place")


def prefer(spark, a) -> DataFrame:
    if not a.reset:
        snapshots.check_preference(_revisions(spark, a), a.book, a.chunk, a.stage)
    log = _log(spark, a)
    at = 1 + ((log.agg(F.max("at")).first()[0] or 0) if log is not None else 0)
    new = spark.createDataFrame([(a.book, a.chunk, a.stage, a.reason, at, a.reset)], PREFERENCE)
    snapshots.swap(new if log is None else log.unionByName(new), os.path.join(a.store, "snapshots", "preferences"))
    return _preferences(spark, a)


def clear(spark, a) -> DataFrame:
    rows = _revisions(spark, a)
    gone = R.to_clear(rows, a.stage).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")).orderBy("stage")
    if a.yes:
        shown, log = gone.collect(), _log(spark, a)
        snapshots.swap(R.clear(rows, a.stage), os.path.join(a.store, "snapshots", "revisions"))
        if log is not None:
            snapshots.swap(R.preferences_left(log, a.stage), os.path.join(a.store, "snapshots", "preferences"))
        return spark.createDataFrame(shown, gone.schema)
    return gone


def promote(spark, a) -> DataFrame:
    """Entries of glossary files (JSON lists of entries) against a series' file."""
    fields = "original string, translation string, type string, gender string, notes string, approved_by_human boolean"
    load = lambda path: spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("pos", F.monotonically_increasing_id()).withColumn("series", F.lit(a.series))
    return glossary.promote(load(a.book).withColumn("cand_id", F.col("pos")), load(a.known), None if a.all else F.col("approved_by_human")).orderBy("cand_id")


def read(spark, a) -> DataFrame:
    return {"meta": epub.read_meta, "chapters": epub.read_chapters, "paragraphs": epub.read_paragraphs, "items": epub.read_items, "books": epub.read_anthology}[a.what](epub.archives(spark, a.folder))


def assemble(spark, a) -> DataFrame:
    """Archives named ``<book_id>.epub`` with the store's text, or that of one stage; chunks without one are an error
    unless forced. With ``--notes FILE``, notes for the glossary's terms."""
    rows, chunks, wanted = _revisions(spark, a), table(spark, a.store, "chunks"), _preferences(spark, a)
    if not a.force and not (lost := W.unassembled(chunks, rows, wanted, a.stage)).isEmpty():
        first = ", ".join(f"{r['book_id']}/{r['chunk_id']} ({r['why']})" for r in lost.orderBy("book_id", "chunk_id").limit(10).collect())
        raise SystemExit(f"some chunks have no valid text: {first}; --force leaves their source")
    archives = epub.archives(spark, a.folder).withColumn("book_id", F.regexp_extract("path", r"(\d+)\.epub$", 1).try_cast("bigint"))
    texts = W.assemble(chunks, rows, wanted, a.stage).join(archives.select("book_id", "path"), "book_id").select("path", "chapter_idx", "para_idx", F.col("text").alias("xhtml"))
    terms, chosen = None, settings.load(a.settings).reader_notes.wanted(True if a.notes else None, a.note_types)
    if a.notes and chosen:
        entries = [(n, 0, e["original"], e["translation"], e["type"], e["gender"], e["notes"]) for n, e in enumerate(settings.load_glossary(a.notes)["entries"])]
        df = spark.createDataFrame(entries, "cand_id bigint, book_id bigint, original string, translation string, type string, gender string, notes string")
        terms = notes.eligible(df, chosen.types).select(F.col("notes").alias("note"), "translation", "gender", "place").withColumn("path", F.explode(F.lit([r["path"] for r in archives.select("path").collect()])))
    n = epub.save(epub.translate_archives(archives, texts, a.language, terms), a.out)
    return spark.createDataFrame([(n,)], "n_written bigint")


def cover(spark, a) -> DataFrame:
    """Shows or saves covers; replaces them all by one image (``--image``), or declares them as readers look for them
    (``--fix``)."""
    archives = epub.archives(spark, a.folder)
    if a.image or a.fix:
        if not a.out:
            raise SystemExit("--out says where the archives go")
        image = None
        if a.image:
            with open(a.image, "rb") as held:
                image = held.read()
        return spark.createDataFrame([(epub.save(epub.covered(archives, image), a.out),)], "n_written bigint")
    found = epub.read_covers(archives)
    if a.out:
        endings = F.create_map(*[F.lit(x) for pair in settings.EXTENSIONS.items() for x in pair])
        epub.save(found.select(F.concat(F.regexp_replace("path", r"\.epub$", ""), F.coalesce(F.try_element_at(endings, F.lower("media_type")), F.lit(settings.extension(None)))).alias("path"), "content"), a.out)
    return found.select("path", "name", "media_type", "how", F.length("content").alias("n_bytes"))


def split(spark, a) -> DataFrame:
    with open(a.archive, "rb") as held:
        content = held.read()
    books = list(epub.Archive(content).books())
    if a.out:
        os.makedirs(a.out, exist_ok=True)
        for n, title, prefix, *_ in books:
            if a.book in (None, n):
                with open(os.path.join(a.out, f"{n:02d}.epub"), "wb") as out:
                    out.write(epub.split_anthology(content, prefix, title))
    return spark.createDataFrame([b[:5] for b in books], "book_no int, title string, prefix string, entry string, n_items int")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimp")
    commands = p.add_subparsers(required=True)

    def command(run, *options):
        c = commands.add_parser(run.__name__, help=(run.__doc__ or "").split("\n")[0])
        for names, extra in options:
            c.add_argument(*names.split(), **extra)
        c.set_defaults(run=run)

    flag, store = {"action": "store_true"}, ("store", {})
    command(status, store, ("--scores", flag), ("--below", {"type": int}), ("--grid", flag), ("--assembly-map", flag), ("--diff", {}), ("--stages", {}))
    command(stage, store, ("stage", {"choices": [*R.WATERFALL[:5], "judge"]}), ("prompt", {}), ("--replies", {}), ("--model", {}), ("--settings", {}), ("--limit-chunks", {"type": int}))
    command(glossary_file, ("file", {}), ("--init", {}), ("--author", {}), ("--top", {"type": int}))
    command(prefer, store, ("book", {"type": int}), ("chunk", {}), ("stage", {"nargs": "?"}), ("--reason", {}), ("--reset", flag))
    command(clear, store, ("stage", {"choices": R.WATERFALL}), ("--yes", flag))
    command(promote, ("book", {}), ("known", {}), ("--series", {"default": "series"}), ("--all", flag))
    command(read, ("folder", {}), ("what", {"choices": ["meta", "chapters", "paragraphs", "items", "books"]}))
    command(assemble, store, ("folder", {}), ("out", {}), ("--language", {}), ("--stage", {"choices": R.WATERFALL}), ("--notes", {}), ("--note-types", {}), ("--settings", {}), ("--force", flag))
    command(cover, ("folder", {}), ("--out", {}), ("--image", {}), ("--fix", flag))
    command(split, ("archive", {}), ("--book", {"type": int}), ("--out", {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    shown = a.run(ship(spark or SparkSession.builder.appName("palimp").getOrCreate()), a)
    shown.show(SHOWN, truncate=False)
    return shown


if __name__ == "__main__":
    main(sys.argv[1:])
