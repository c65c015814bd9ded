"""Reader notes: which terms are noted, where they first occur, and in which order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions.declension import LETTER, find, join_keys, probe
from palimp.plans.ranking import running_total

SCOPES = {"first-in-book": ["book_id"], "first-in-chapter": ["book_id", "chapter_idx"], "all": ["book_id", "chapter_idx", "para_idx"]}


def eligible(entries: DataFrame, types: list[str]) -> DataFrame:
    """Entries of the types with notes and a translation that is not blank, with ``place``: longest
    translation first within the book, then as entered."""
    rows = entries.filter(F.col("type").isin(types) & (F.coalesce(F.col("notes"), F.lit("")) != "") & F.col("translation").rlike(r"(?U)\S"))
    ranked = running_total(rows, ["book_id"], -F.length("translation"), [F.col("cand_id")], F.lit(1), "place")
    return ranked.withColumn("place", (F.col("place") + 1).cast("int"))


def _with(terms: DataFrame, name: str, kind: str, made) -> DataFrame:
    """Terms with ``name``, what ``made(translation, gender)`` says of each."""
    out = pa.list_(pa.string()) if kind.startswith("array") else pa.string()

    def run(batches):
        for batch in batches:
            held = [made(t or "", g) for t, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, out)], names=[*batch.schema.names, name])

    return terms.select("cand_id", "book_id", "translation", "gender", "place").mapInArrow(run, f"cand_id bigint, book_id bigint, translation string, gender string, place int, {name} {kind}")


def probes(terms: DataFrame) -> DataFrame:
    return _with(terms, "_probe", "string", probe)


def words_of(paragraphs: DataFrame, to: str) -> DataFrame:
    """``(book_id, chapter_idx, para_idx, to)``: the different lower-case words of every paragraph."""
    return paragraphs.filter("text is not null").select("book_id", "chapter_idx", "para_idx", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"{LETTER}+"), 0))).alias(to))


def occurrences(terms: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(cand_id, book_id, chapter_idx, para_idx, at, place)``: every paragraph that holds a term so
    that it counts, with the place of its first match.

    A term is expanded into the words one of which such a paragraph must have (its declined forms, or the
    first of its words), and meets the book's paragraphs on them: an equi-join on (book, word), spread
    over all words however large a book is. Only what meets is searched with the term's pattern."""
    wanted = _with(terms, "_keys", "array<string>", lambda t, g: list(join_keys(t, g))).withColumn("_word", F.explode("_keys")).drop("_keys")
    met = wanted.join(words_of(paragraphs, "_word"), ["book_id", "_word"]).drop("_word").distinct()
    texts = met.join(paragraphs.select("book_id", "chapter_idx", "para_idx", "text"), ["book_id", "chapter_idx", "para_idx"])

    def run(batches):
        for batch in batches:
            at = [find(t, g, x) for t, g, x in zip(*(batch.column(i).to_pylist() for i in (5, 6, 7)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at, pa.int32())], names=["cand_id", "book_id", "chapter_idx", "para_idx", "place", "at"])

    found = texts.select("cand_id", "book_id", "chapter_idx", "para_idx", "place", "translation", "gender", "text")
    return found.mapInArrow(run, "cand_id bigint, book_id bigint, chapter_idx int, para_idx int, place int, at int").filter("at >= 0")


def word_matches(terms: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(cand_id, book_id, chapter_idx, para_idx)``: paragraphs of the book with a word equal to the term's
    ``probe``: an equi-join of words, where containment would compare every term with every paragraph."""
    return terms.filter("probe <> ''").join(words_of(paragraphs, "probe"), ["book_id", "probe"]).select("cand_id", "book_id", "chapter_idx", "para_idx")


def probe_matches(terms: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(cand_id, book_id, chapter_idx, para_idx)``: paragraphs of the book that contain the term's probe
    anywhere, inside longer words too.

    A probe holds no white space, so it lies within one of the words between white space. Probes meet a
    book's different words on three characters in a row (a shorter probe on all it has), what contains
    them meets the paragraphs by equality; no term is compared with every paragraph. The different
    starts of probes, of three characters at most, are broadcast so that only those are shuffled."""
    wanted = probes(terms).filter("_probe <> ''").select("cand_id", "book_id", "_probe", F.substring("_probe", 1, 3).alias("_key"))
    words = paragraphs.filter("text is not null").select("book_id", "chapter_idx", "para_idx", F.explode(F.array_distinct(F.split(F.lower("text"), r"(?U)\s+"))).alias("_word"))
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all("_word", F.lit(f"(?s)(?=({'.' * n}))"), 1) for n in (1, 2, 3))))
    keyed = words.select("book_id", "_word").distinct().select("book_id", "_word", F.explode(grams).alias("_key")).join(F.broadcast(wanted.select("_key").distinct()), "_key", "left_semi")
    met = wanted.join(keyed, ["book_id", "_key"]).filter("contains(_word, _probe)").select("cand_id", "book_id", "_word")
    return met.join(words, ["book_id", "_word"]).select("cand_id", "book_id", "chapter_idx", "para_idx").distinct()


def placements(terms: DataFrame, paragraphs: DataFrame, scope: str = "first-in-book") -> DataFrame:
    """Where notes go: a term's first paragraph in its scope, numbered per book in reading order."""
    group = ["cand_id", *SCOPES[scope]]
    first = occurrences(terms, paragraphs).groupBy(*group).agg(F.min(F.struct("chapter_idx", "para_idx", "at", "place")).alias("r"), F.first("book_id").alias("_b"))
    rows = first.select("cand_id", F.col("_b").alias("book_id"), "r.*")
    order = [F.col(c) for c in ("para_idx", "at", "place", "cand_id")]
    return running_total(rows, ["book_id"], F.col("chapter_idx"), order, F.lit(1), "number").select("cand_id", "book_id", "chapter_idx", "para_idx", "at", (F.col("number") + 1).cast("int").alias("number"))
