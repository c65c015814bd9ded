"""From a judge's issue to a vetted substitution."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.jsonfix import read_verdicts
from palimp.functions.text import join_markers, split_markers
from palimp.operators.revisions import meta_field

#: Categories acted on, reasons that no model should retry, and how an issue is written.
CATEGORIES = ["grammar", "markup", "accuracy"]
HOPELESS = ["quote_absent", "out_of_scope", "no_category", "no_op"]
ISSUE_CATEGORY = r"(?i)^\s*([a-z_]+)\s*[:/]"
ISSUE_PARAGRAPH = r"(?i)\bp\.\s*(\d+)"
ISSUE_PAIR = r"«([^«»]{2,})»\s*(?:→|->)\s*«([^«»]+)»"


def parse_issue(raw: Column) -> Column:
    """``struct(category, paragraph, old, new)`` of «category: p.N «old» → «new»»; missing parts null."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        some(F.lower(F.regexp_extract(raw, ISSUE_CATEGORY, 1))).alias("category"),
        some(F.regexp_extract(raw, ISSUE_PARAGRAPH, 1)).try_cast("int").alias("paragraph"),
        some(F.trim(F.regexp_extract(raw, ISSUE_PAIR, 1))).alias("old"),
        F.when(raw.rlike(ISSUE_PAIR), F.trim(F.regexp_extract(raw, ISSUE_PAIR, 2))).alias("new"),
    )


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping literal occurrences; 0 for a null or empty part."""
    gone = F.length(text) - F.length(F.replace(text, part))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(0)


def classify(issue: Column, paragraphs: Column, categories: list[str] = CATEGORIES) -> Column:
    """Why an issue is no substitution (the first rule that fails), or null."""
    at = F.get(paragraphs, issue["paragraph"] - 1)
    count = occurrences(at, issue["old"])
    return (
        F.when(issue["category"].isNull(), "no_category")
        .when(~issue["category"].isin(categories), "out_of_scope")
        .when(issue["paragraph"].isNull(), "no_paragraph")
        .when(~issue["paragraph"].between(1, F.size(paragraphs)), "bad_paragraph")
        .when(issue["old"].isNull() | issue["new"].isNull(), "no_pair")
        .when(issue["old"] == issue["new"], "no_op")
        .when(count == 0, "quote_absent")
        .when(count > 1, "quote_ambiguous")
    )


def propose(verdicts: DataFrame, texts: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """``(book_id, chunk_id, n, raw, issue, skip, deferred)``: every issue of every verdict whose chunk has a
    text, numbered from 1; ``place``, its number among the chunk's candidates, is null where it is none.
    ``texts`` has ``(book_id, chunk_id, paragraphs)``.

    The issues of a chunk are judged inside the one row where they meet its text; only they leave it."""
    met = verdicts.select("book_id", "chunk_id", "issues").join(texts.select("book_id", "chunk_id", "paragraphs"), ["book_id", "chunk_id"])
    parsed = F.transform("issues", lambda raw, i: F.struct((i + 1).alias("n"), raw.alias("raw"), parse_issue(raw).alias("issue")))
    judged = F.transform(parsed, lambda x: F.struct(x["n"].alias("n"), x["raw"].alias("raw"), x["issue"].alias("issue"), classify(x["issue"], F.col("paragraphs"), categories).alias("skip")))
    rows = met.select("book_id", "chunk_id", judged.alias("xs"))
    place = F.when(F.col("x.skip").isNull(), F.size(F.filter("xs", lambda y: y["skip"].isNull() & (y["n"] <= F.col("x.n")))))
    skip = F.col("skip")
    each = rows.select("book_id", "chunk_id", "xs", F.explode("xs").alias("x")).select("book_id", "chunk_id", "x.*", place.alias("place"))
    return each.withColumn("deferred", skip.isNotNull() & ~skip.isin(HOPELESS))


def vet(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates ``(book_id, chunk_id, place, …)`` with ``accepted`` from the verdict of that number,
    ``(book_id, chunk_id, place, accepted)``; no verdict rejects."""
    return candidates.join(verdicts.select("book_id", "chunk_id", "place", "accepted"), ["book_id", "chunk_id", "place"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def apply(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, paragraphs, n_applied)``: accepted candidates substituted in order, each only if
    its quote then still occurs exactly once. Chunks with none accepted give no row. A chunk's candidates
    are gathered before they meet its text, which is moved once."""
    kept = candidates.filter("skip is null and accepted").groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", "issue.paragraph", "issue.old", "issue.new"))).alias("cs"))
    fold = """aggregate(cs, named_struct('ps', paragraphs, 'k', 0), (a, c) ->
        if((length(a.ps[c.paragraph - 1]) - length(replace(a.ps[c.paragraph - 1], c.old))) = length(c.old),
           named_struct('ps', transform(a.ps, (p, i) -> if(i = c.paragraph - 1, replace(p, c.old, c.new), p)), 'k', a.k + 1), a))"""
    met = kept.join(texts.select("book_id", "chunk_id", "paragraphs"), ["book_id", "chunk_id"])
    return met.withColumn("r", F.expr(fold)).select("book_id", "chunk_id", F.col("r.ps").alias("paragraphs"), F.col("r.k").alias("n_applied"))


def read_vetting(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """``(book_id, chunk_id, readable, place, accepted, why)`` from vetting replies ``(book_id, chunk_id, reply)``:
    one row per verdict. A reply that cannot be read has one row, not readable, with the rest null."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for book, chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += [(book, chunk, True, n, ok, why) for n, (ok, why) in read_verdicts(text or "").items() if abs(n) < 1 << 31]
                except ValueError:
                    out.append((book, chunk, False, None, None, None))
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["book_id", "chunk_id", "readable", "place", "accepted", "why"])

    return replies.select("book_id", "chunk_id", text_col).mapInArrow(run, "book_id bigint, chunk_id string, readable boolean, place int, accepted boolean, why string")


def stage_rows(proposals: DataFrame, replies: DataFrame, texts: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, stage, content, accepted)``: what the repair of chunks with candidates adds to the
    revisions. A readable reply is always kept, under ``repair_verdicts``; a ``repair`` text only where at
    least one candidate was accepted, so that an unchanged copy never outranks a later text. Replies that
    cannot be read add nothing. ``replies`` has ``(book_id, chunk_id, reply)``."""
    candidates = proposals.filter("skip is null")
    asked = replies.join(candidates.select("book_id", "chunk_id").distinct(), ["book_id", "chunk_id"], "left_semi")
    read = read_vetting(asked)
    vetted = vet(candidates, read.filter("readable"))
    bad = read.filter("not readable").select("book_id", "chunk_id")
    counts = vetted.groupBy("book_id", "chunk_id").agg(F.count_if("accepted").cast("int").alias("accepted"))
    kept = asked.join(bad, ["book_id", "chunk_id"], "left_anti").join(counts, ["book_id", "chunk_id"]).select("book_id", "chunk_id", F.lit("repair_verdicts").alias("stage"), F.col("reply").alias("content"), "accepted")
    text = apply(vetted, texts).join(counts, ["book_id", "chunk_id"]).select("book_id", "chunk_id", F.lit("repair").alias("stage"), join_markers(F.col("paragraphs")).alias("content"), "accepted")
    return kept.unionByName(text)


def legacy(repairs: DataFrame, proposals: DataFrame, counts: DataFrame) -> DataFrame:
    """``(book_id, chunk_id, outcome, accepted, rejected)`` of repair texts stored before verdicts were,
    ``repairs(book_id, chunk_id, content, meta)``: they are used as they stand, with the accepted number
    that meta tells (else 0) and the rest of the candidates rejected. One with another number of
    paragraphs than ``counts(book_id, chunk_id, n_expected)`` is ``broken``."""
    old = repairs.filter(~F.coalesce(meta_field(F.col("meta"), "$.verdicts", "boolean"), F.lit(False)))
    n = proposals.filter("skip is null").groupBy("book_id", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    joined = old.join(counts, ["book_id", "chunk_id"]).join(n, ["book_id", "chunk_id"], "left")
    fine = F.coalesce(F.size(split_markers(F.col("content"))), F.lit(0)) == F.col("n_expected")
    accepted = F.coalesce(meta_field(F.col("meta"), "$.accepted", "int"), F.lit(0))
    left = F.greatest(F.coalesce("_n", F.lit(0)) - accepted, F.lit(0))
    return joined.select("book_id", "chunk_id", F.when(fine, "used").otherwise("broken").alias("outcome"), F.when(fine, accepted).alias("accepted"), F.when(fine, left).alias("rejected"))
