"""Which revision of a chunk holds: the stage waterfall, preferences, validity, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.text import once, split_markers, strip
from palimp.functions.udfs import last_well_formed
from palimp.operators.revisions import WATERFALL, age, chunk_ids_of, latest_of, rows, stage_rank

GRID = ["reflect", "proofread", "style", "verify"]


def by_stage(revisions: DataFrame, *fields: Column | str, first: bool = False, stages: list[str] = WATERFALL) -> DataFrame:
    """``(book_id, chunk_id, held)``: one row per chunk with, in stage order, the newest (or ``first``)
    revision of every stage it has, as ``struct(stage, rank, seq, *fields)``.

    The stages reach the scan, fields are computed below the only shuffle, and repeats cannot win twice.
    A row holds at most one text per stage, however many revisions a chunk has."""
    fields = fields or ("content",)
    names = [f"_f{i}" for i in range(len(fields))]
    held = rows(revisions, "stage", "book_id", "chunk_id", "created_at", "content", "meta", stages=stages).filter("chunk_id is not null")
    held = held.select("seq", "stage", "book_id", "chunk_id", "created_at", *[(F.col(f) if isinstance(f, str) else f).alias(n) for f, n in zip(fields, names)])
    pick = F.min_by if first else F.max_by
    best = [pick(F.struct("seq", *names), F.when(F.col("stage") == s, age())).alias(f"_s{i}") for i, s in enumerate(stages)]
    cell = lambda i, s: F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.lit(s).alias("stage"), F.lit(WATERFALL.index(s) + 1).alias("rank"), F.col(f"_s{i}.seq").alias("seq"), *[F.col(f"_s{i}.{n}").alias(f if isinstance(f, str) else n) for f, n in zip(fields, names)]))
    return held.groupBy("book_id", "chunk_id").agg(*best).select("book_id", "chunk_id", F.filter(F.array(*[cell(i, s) for i, s in enumerate(stages)]), lambda x: x.isNotNull()).alias("held"))


def per_stage(revisions: DataFrame, first: bool = False) -> DataFrame:
    """``(book_id, chunk_id, stage, rank, seq, content)``: the newest (or ``first``) revision of every
    stage of the waterfall that a chunk has."""
    return by_stage(revisions, first=first).select("book_id", "chunk_id", F.inline("held"))


def _wanted(held: DataFrame, preferences: DataFrame | None) -> DataFrame:
    """Adds ``wanted``, the chunk's preferred stage or null."""
    if preferences is None:
        return held.withColumn("wanted", F.lit(None).cast("string"))
    return held.join(preferences.select("book_id", "chunk_id", F.col("preferred_stage").alias("wanted")), ["book_id", "chunk_id"], "left")


def resolve(revisions: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """``(book_id, chunk_id, stage, reason)``: the preferred stage where the chunk has it, else its
    highest stage. Needs no text: one partial aggregation over (chunk, stage)."""
    lean = rows(revisions, "stage", "book_id", "chunk_id", stages=WATERFALL).filter("chunk_id is not null")
    have = lean.groupBy("book_id", "chunk_id").agg(F.max(stage_rank(F.col("stage"))).alias("_top"), *[F.max(F.col("stage") == s).alias(f"_has{i}") for i, s in enumerate(WATERFALL)])
    joined = _wanted(have, preferences)
    there = F.coalesce(*[F.when(F.col("wanted") == s, F.col(f"_has{i}")) for i, s in enumerate(WATERFALL)], F.lit(False))
    highest = F.element_at(F.array(*map(F.lit, WATERFALL)), F.col("_top").cast("int"))
    reason = F.when(there, "preference").when(F.col("wanted").isNotNull(), "waterfall (preference unavailable)").otherwise("waterfall")
    return joined.select("book_id", "chunk_id", F.when(there, F.col("wanted")).otherwise(highest).alias("stage"), reason.alias("reason"))


def assembly_map(revisions: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """Chunks by the stage they resolve to. Translations whose chunk is not known even from meta count with
    ``translate``, a row each."""
    known = resolve(revisions, preferences).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    lost = rows(revisions, "book_id", "chunk_id", stages=["translate"]).filter("chunk_id is null").select("seq").distinct()
    return known.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("translate").alias("stage"), "n")).groupBy("stage").agg(F.sum("n").alias("n"))


def _resolved() -> Column:
    """The entry of ``held`` that the chunk resolves to: of ``wanted`` if it has it, else the last."""
    return F.coalesce(F.get(F.filter("held", lambda x: x["stage"] == F.col("wanted")), F.lit(0)), F.element_at("held", -1))


def resolved_texts(revisions: DataFrame, preferences: DataFrame | None = None, first: bool = False) -> DataFrame:
    """The text each chunk resolves to: the newest (or ``first``) revision of the resolved stage."""
    return _wanted(by_stage(revisions, first=first), preferences).withColumn("r", _resolved()).select("book_id", "chunk_id", "r.stage", "r.rank", "r.seq", "r.content")


def _below(target: str | None) -> list[str]:
    return WATERFALL[: WATERFALL.index(target)] if target in WATERFALL else WATERFALL


def before(revisions: DataFrame, target: str) -> DataFrame:
    """The text a stage starts from: the newest revision of the highest stage strictly before it, or of
    the highest at all for a stage outside the waterfall. Preferences play no part."""
    held = by_stage(revisions, stages=_below(target)).withColumn("r", F.element_at("held", -1))
    return held.select("book_id", "chunk_id", "r.stage", "r.seq", "r.content")


def fragments(content: Column, expected: Column, bare: bool = True) -> Column:
    """The paragraphs of a revision if it has as many as expected, else null; with ``bare``, text without
    markers serves a chunk of one paragraph."""
    single = F.when((expected == 1) & (strip(content) != "") & F.lit(bare), F.array(strip(content)))
    return once(split_markers(content), lambda parts: F.when(parts.isNull(), single).when(F.size(parts) == expected, parts))


def _highest_valid(tried: DataFrame, expected: Column, bare: bool) -> DataFrame:
    """Adds ``r``, ``struct(stage, rank, seq, paragraphs)`` of the last entry of ``tried`` whose text has the
    expected paragraphs, each of them well formed, or null. Entries are parsed from the last on, and
    only until one is valid."""
    cut = F.transform("tried", lambda x: F.struct(x["stage"].alias("stage"), x["rank"].alias("rank"), x["seq"].alias("seq"), fragments(x["content"], expected, bare).alias("paragraphs")))
    return last_well_formed(tried.withColumn("tried", F.filter(cut, lambda x: x["paragraphs"].isNotNull())), "tried", "r")


def valid_before(revisions: DataFrame, counts: DataFrame, target: str | None = None) -> DataFrame:
    """Like ``before`` but of the highest stage whose text is valid: as many paragraphs as the chunk has in
    ``counts(book_id, chunk_id, n_expected)``, each well formed; adds the ``paragraphs``."""
    held = by_stage(revisions, stages=_below(target)).withColumnRenamed("held", "tried")
    found = _highest_valid(held.join(counts, ["book_id", "chunk_id"]), F.col("n_expected"), True)
    return found.filter("r is not null").select("book_id", "chunk_id", "r.stage", "r.seq", "r.paragraphs")


def rehydrate(chunks: DataFrame, revisions: DataFrame, preferences: DataFrame | None = None, forced: str | None = None, every: bool = True) -> DataFrame:
    """``(book_id, chunk_id, chapter_idx, para_idx, n_revisions, r)`` for every chunk: ``r`` is
    ``struct(stage, rank, seq, paragraphs)`` of the text to put into the book, null where none is valid.

    The resolved stage comes first, then the stages before it. ``forced``: only that stage, without
    preferences. ``every``: translations count too, as for a book read anew; without, only chunks that
    resolve to a later stage give a row, and none falls back to its translation."""
    own = chunks.select("book_id", "chunk_id", "chapter_idx", "para_idx").filter("chunk_id is not null").dropDuplicates(["book_id", "chunk_id"])
    held = by_stage(revisions, stages=[forced] if forced else WATERFALL)
    joined = _wanted(own.join(held, ["book_id", "chunk_id"], "left"), None if forced else preferences).withColumn("_top", _resolved())
    if not (forced or every):
        joined = joined.filter("_top.stage <> 'translate'")
    least = 1 if forced or every else 2
    tried = F.filter("held", lambda x: (x["rank"] <= F.col("_top.rank")) & (x["rank"] >= least))
    found = _highest_valid(joined.withColumn("n_revisions", F.coalesce(F.size("held"), F.lit(0))).withColumn("tried", tried).drop("held", "_top", "wanted"), F.size("para_idx"), False)
    return found.select("book_id", "chunk_id", "chapter_idx", "para_idx", F.greatest("n_revisions", F.lit(0)).alias("n_revisions"), "r")


def assemble(chunks: DataFrame, revisions: DataFrame, preferences: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """``(book_id, chapter_idx, para_idx, stage, text)``: every paragraph of every chunk that has a valid
    text at or below its resolved stage; other chunks are in ``unassembled``."""
    best = rehydrate(chunks, revisions, preferences, forced).filter("r is not null")
    return best.select("book_id", "chapter_idx", F.col("r.stage").alias("stage"), F.explode(F.arrays_zip("para_idx", F.col("r.paragraphs").alias("text"))).alias("x")).select("book_id", "chapter_idx", "x.para_idx", "stage", "x.text")


def unassembled(chunks: DataFrame, revisions: DataFrame, preferences: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """Chunks without a valid text: ``broken`` if they have a revision (of the forced stage, if one is), else
    ``missing``."""
    left = rehydrate(chunks, revisions, preferences, forced).filter("r is null")
    return left.select("book_id", "chunk_id", F.when(F.col("n_revisions") > 0, "broken").otherwise("missing").alias("why"))


def rehydrated(chunks: DataFrame, revisions: DataFrame, preferences: DataFrame | None = None, forced: str | None = None, every: bool = True) -> DataFrame:
    """Per book, how many chunks got a text and how many did not."""
    tried = rehydrate(chunks, revisions, preferences, forced, every)
    return tried.groupBy("book_id").agg(F.count_if(F.col("r").isNotNull()).alias("n_rehydrated"), F.count_if(F.col("r").isNull()).alias("n_failed"))


def _marked(revisions: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, cells)`` of translated chunks: by stage, whether the text differs from that of
    the previous stage present; null for the first. Only digests of texts are shuffled."""
    held = by_stage(revisions, F.md5(strip(F.col("content"))), stages=["translate", *GRID]).filter("held[0].stage = 'translate'")
    changed = lambda x, i: F.when(i > 0, x["_f0"] != F.get(F.col("held"), i - 1)["_f0"])
    return held.select("book_id", "chunk_id", F.transform("held", lambda x, i: F.struct(x["stage"].alias("stage"), changed(x, i).alias("changed"))).alias("cells"))


def grid(revisions: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, stage, changed)`` for every stage a translated chunk has: whether its text
    differs from that of the previous stage present; null for the first."""
    return _marked(revisions).select("book_id", "chunk_id", F.inline("cells"))


def grid_wide(revisions: DataFrame, scores: DataFrame | None = None, reflect: bool = True) -> DataFrame:
    """One row per translated chunk, one column per stage: ``base``, ``true``, ``false`` or null; with
    ``scores(book_id, chunk_id, score)``, the judge's as ``judge_score``. ``reflect``: whether to have its
    column, which a store without reflections can do without."""
    cells = F.map_from_entries(F.transform("cells", lambda x: F.struct(x["stage"], F.coalesce(x["changed"].cast("string"), F.lit("base")))))
    wide = _marked(revisions).withColumn("m", cells).select("book_id", "chunk_id", *[F.try_element_at("m", F.lit(s)).alias(s) for s in ["translate", *GRID] if reflect or s != "reflect"])
    return wide if scores is None else wide.join(scores.select("book_id", "chunk_id", F.col("score").alias("judge_score")), ["book_id", "chunk_id"], "left")


def grid_totals(revisions: DataFrame) -> DataFrame:
    return grid(revisions).groupBy("stage").agg(F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_unchanged"), F.count_if(F.col("changed").isNull()).alias("n_base"))


def effective_source(revisions: DataFrame) -> DataFrame:
    """The stage whose text a chunk really carries: the last that changed it, or its base."""
    real = F.filter("cells", lambda x: F.coalesce(x["changed"], F.lit(True)))
    return _marked(revisions).select("book_id", "chunk_id", F.element_at(real, -1)["stage"].alias("source"))


def missing_in(revisions: DataFrame, stage: str) -> DataFrame:
    """Translated chunks that lack ``stage``."""
    return chunk_ids_of(revisions, "translate").join(chunk_ids_of(revisions, stage), ["book_id", "chunk_id"], "left_anti")


def translated_of(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """The chunks of the present chunking that have a translation."""
    return chunks.filter("chunk_id is not null").dropDuplicates(["book_id", "chunk_id"]).join(chunk_ids_of(revisions, "translate"), ["book_id", "chunk_id"], "left_semi")


def steps(revisions: DataFrame) -> DataFrame:
    """Consecutive revisions of a chunk, verdicts aside, with whether the text changed and by how many
    characters. Digests and lengths are shuffled, texts are not."""
    lean = rows(revisions, "stage", "book_id", "chunk_id", "created_at", "content").filter("chunk_id is not null and stage <> 'judge'")
    lean = lean.select("book_id", "chunk_id", F.struct("created_at", "seq", "stage", F.md5("content").alias("h"), F.length("content").alias("n")).alias("x"))
    history = lean.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    pairs = F.transform(F.slice("xs", 2, F.size("xs")), lambda x, i: F.struct(x.alias("now"), F.get(F.col("xs"), i).alias("old")))
    each = history.select("book_id", "chunk_id", F.explode(pairs).alias("p"))
    return each.select("book_id", "chunk_id", "p.now.seq", "p.now.stage", F.col("p.old.seq").alias("prev_seq"), (F.col("p.old.h") != F.col("p.now.h")).alias("changed"), (F.col("p.now.n") - F.col("p.old.n")).alias("delta"))


def reflect_input(revisions: DataFrame, originals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Originals with the newest translation and, if there is one, the verdict on it. ``originals`` has
    ``(book_id, chunk_id, original)``, ``verdicts`` ``(book_id, chunk_id, score, issues)``."""
    joined = originals.join(latest_of(revisions, "translate").select("book_id", "chunk_id", F.col("content").alias("translation")), ["book_id", "chunk_id"])
    none = F.expr("cast(array() as array<string>)")
    return joined.join(verdicts, ["book_id", "chunk_id"], "left").select("book_id", "chunk_id", "original", "translation", "score", F.coalesce("issues", none).alias("issues"))
