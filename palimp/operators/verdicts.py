"""Judge verdicts: strict and lenient reading, scores, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.text import strip_fences
from palimp.operators.revisions import age, chunk_ids_of, meta_field, rows

EMPTY = "cast(array() as array<string>)"


def _value(content: Column) -> Column:
    return F.try_parse_json(strip_fences(content))


def raw_score(content: Column) -> Column:
    """The score as an integer: numbers lose their fraction, strings must be whole numbers; else null."""
    v = _value(content)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.score", "variant"))
    text = F.trim(F.try_variant_get(v, "$.score", "string"))
    return F.when(kind == "STRING", text.try_cast("int")).otherwise(F.try_variant_get(v, "$.score", "double").try_cast("int"))


def strict_score(content: Column) -> Column:
    """1 to 5, else null: the reply is then an error."""
    score = raw_score(content)
    return F.when(score.between(1, 5), score)


def issues(content: Column, lenient: bool = True) -> Column:
    """A string is one issue, a list its items as strings; anything else is itself an issue (lenient) or
    nothing; null and missing are nothing."""
    v = _value(content)
    listed = F.try_variant_get(v, "$.issues", "array<string>")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.issues", "variant"))
    text = F.try_variant_get(v, "$.issues", "string")
    other = F.when(text.isNotNull() & (F.lit(lenient) | (kind == "STRING")), F.array(text))
    return F.coalesce(F.when(kind.startswith("ARRAY"), listed), other, F.expr(EMPTY))


def _judged(revisions: DataFrame) -> DataFrame:
    held = rows(revisions, "book_id", "chunk_id", "created_at", "content", "meta", stages=["judge"])
    return held.withColumn("judged_stage", F.coalesce(meta_field(F.col("meta"), "$.judged_stage"), F.lit("translate"))).withColumn("run", meta_field(F.col("meta"), "$.run"))


def _read(revisions: DataFrame, lenient: bool) -> DataFrame:
    """Verdicts that are no measurement run, read where they are scanned; repeats are kept."""
    readable = _value(F.col("content")).isNotNull()
    score = F.coalesce(raw_score(F.col("content")), F.lit(0)) if lenient else strict_score(F.col("content"))
    found = F.when(readable, issues(F.col("content"), lenient)).otherwise(F.array(F.lit("parse error")))
    return _judged(revisions).filter("run is null").select("seq", "book_id", "chunk_id", "judged_stage", "created_at", score.alias("score"), found.alias("issues"))


def verdicts(revisions: DataFrame, lenient: bool = True) -> DataFrame:
    """``(seq, book_id, chunk_id, judged_stage, created_at, score, issues)`` of every verdict that is no
    measurement run. Lenient: an unreadable verdict scores 0 with the issue ``parse error``; strict:
    only verdicts of score 1 to 5."""
    out = _read(revisions, lenient).distinct()
    return out if lenient else out.filter("score is not null")


def latest_verdicts(revisions: DataFrame, judged_stage: str | None = "translate") -> DataFrame:
    """The newest verdict on one stage (or, with None, on any) of every chunk; verdicts without a chunk are
    left out."""
    held = _read(revisions, True).filter("chunk_id is not null")
    if judged_stage is not None:
        held = held.filter(F.col("judged_stage") == judged_stage)
    return held.groupBy("book_id", "chunk_id").agg(F.max_by(F.struct("score", "issues"), age()).alias("r")).select("book_id", "chunk_id", "r.score", "r.issues")


def histogram(revisions: DataFrame) -> DataFrame:
    return verdicts(revisions).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def scores(revisions: DataFrame) -> DataFrame:
    """Every verdict with whether its chunk was reflected on; callers order by (score, chunk_id)."""
    reflected = chunk_ids_of(revisions, "reflect").withColumn("_r", F.lit(True))
    joined = verdicts(revisions).join(reflected, ["book_id", "chunk_id"], "left")
    return joined.select("seq", "book_id", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "score", F.size("issues").alias("n_issues"), F.coalesce("_r", F.lit(False)).alias("reflected"))


def at_most(revisions: DataFrame, trigger: int = 2, strict: bool = False, every: bool = False) -> DataFrame:
    """Chunks to act on: newest score at most ``trigger`` (``strict``: below it); ``every``: all judged
    chunks. A trigger outside 1 to 5 is an error."""
    if not 1 <= trigger <= 5:
        raise ValueError(f"a score is 1 to 5, not {trigger}")
    held = latest_verdicts(revisions).select("book_id", "chunk_id", "score")
    return held if every else held.filter(F.col("score") < trigger if strict else F.col("score") <= trigger)


def measurement_runs(revisions: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, run, score)``: the newest verdict of every measurement run on a translation."""
    held = _judged(revisions).filter("run is not null and chunk_id is not null and judged_stage = 'translate'")
    score = F.coalesce(raw_score(F.col("content")), F.lit(0))
    return held.select("seq", "created_at", "book_id", "chunk_id", "run", score.alias("score")).groupBy("book_id", "chunk_id", "run").agg(F.max_by("score", age()).alias("score"))


def agreement(base: DataFrame, runs: DataFrame, trigger: int = 2) -> DataFrame:
    """``(run, n, n_equal, shift, n_both, n_either, jaccard)``: how far each run ``(book_id, chunk_id, run, score)``
    agrees with the verdicts ``base(book_id, chunk_id, score)`` on the chunks both judged: equal scores,
    the sum of absolute differences, and the likeness of the chunks each would select (null if none)."""
    pairs = runs.join(base.select("book_id", "chunk_id", F.col("score").alias("base")), ["book_id", "chunk_id"])
    a, b = F.col("score") <= trigger, F.col("base") <= trigger
    both, either = F.count_if(a & b), F.count_if(a | b)
    return pairs.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == F.col("base")).alias("n_equal"), F.sum(F.abs(F.col("score") - F.col("base"))).cast("bigint").alias("shift"),
        both.alias("n_both"), either.alias("n_either"), F.round(both / F.nullif(either, F.lit(0)), 6).alias("jaccard"),
    )
