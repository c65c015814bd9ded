"""Arrow-batched functions for what the built-in ones lack."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimp.functions.jsonfix import parse
from palimp.functions.xhtml import well_formed


def slugify(text: str | None, fallback: str = "book") -> str:
    """Lower-case ASCII words joined by hyphens; ``fallback`` where nothing is left."""
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return "-".join(re.findall(r"[a-z0-9]+", plain)) or fallback


def slug(df: DataFrame, col: str, to: str = "slug") -> DataFrame:
    def run(batches):
        for batch in batches:
            made = pa.array([slugify(t) for t in batch.column(col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def parse_replies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, ok, score, n_issues)``: judge replies read with quote repair; a score outside 1 to 5, or
    none, is not ok."""
    named = df.select(F.col(id_col), F.col(text_col))

    def one(text):
        try:
            value = parse(text or "")
            score = int(value["score"])
            held = value.get("issues")
            n = 1 if isinstance(held, str) else len(held) if isinstance(held, list) else 0
            return 1 <= score <= 5, score, n
        except (ValueError, TypeError, KeyError, RecursionError, AttributeError):
            return False, None, None

    def run(batches):
        for batch in batches:
            out = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=[id_col, "ok", "score", "n_issues"])

    return named.mapInArrow(run, f"{id_col} {named.schema[id_col].dataType.simpleString()}, ok boolean, score int, n_issues int")


def _valid_from_the_end(texts: list | None) -> int:
    """The place of the last list of fragments that are all well formed, or -1."""
    for i in range(len(texts or ()) - 1, -1, -1):
        if all(map(well_formed, texts[i])):
            return i
    return -1


def last_well_formed(df: DataFrame, col: str, to: str) -> DataFrame:
    """Replaces ``col``, an array of structs that have ``paragraphs``, by ``to``: the last of the structs whose
    paragraphs all parse, else null. Fragments are plain text or markup."""
    kind = df.schema[col].dataType.elementType
    rest = [f for f in df.schema.fields if f.name != col]

    def run(batches):
        for batch in batches:
            held = batch.column(batch.schema.get_field_index(col))
            best = []
            for row in held.to_pylist():
                at = _valid_from_the_end([x["paragraphs"] for x in row or ()])
                best.append(row[at] if at >= 0 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), pa.array(best, held.type.value_type)], names=[*(f.name for f in rest), to])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(to, kind)]))


def first_malformed(df: DataFrame, col: str, to: str) -> DataFrame:
    """Adds ``to``: the number (from 1) of the first fragment of the array ``col`` that does not parse; 0 if all
    do, null for null."""

    def run(batches):
        for batch in batches:
            found = [None if v is None else next((i for i, x in enumerate(v, 1) if not well_formed(x)), 0) for v in batch.column(batch.schema.get_field_index(col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.IntegerType())]))


def unified_diff(revisions: DataFrame, chunk: str | None = None, stages: list[str] | None = None) -> DataFrame:
    """``(seq, prev_seq, n_removed, n_added, diff)`` of consecutive revisions of a chunk, verdicts aside; of
    one ``chunk`` or some ``stages`` only, if given."""
    held = revisions.filter("stage <> 'judge'" if stages is None else F.col("stage").isin(stages)).filter("seq is not null")
    held = held.select("seq", "book_id", "created_at", "content", F.coalesce("chunk_id", F.try_variant_get(F.try_parse_json("meta"), "$.chunk_id", "string")).alias("chunk_id"))
    held = held.filter(F.col("chunk_id").isNotNull() if chunk is None else F.col("chunk_id") == chunk)
    order = Window.partitionBy("book_id", "chunk_id").orderBy("created_at", "seq")
    # a repeat stands beside its like, so it is told by its own seq before it
    pairs = held.select("seq", F.lag("seq").over(order).alias("prev_seq"), F.lag("content").over(order).alias("_a"), F.col("content").alias("_b")).filter("prev_seq <> seq")

    def run(batches):
        for batch in batches:
            removed, added, diffs = [], [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = [x for x in difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=0)][2:]
                removed.append(sum(x.startswith("-") for x in lines))
                added.append(sum(x.startswith("+") for x in lines))
                diffs.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int32()), pa.array(added, pa.int32()), pa.array(diffs, pa.string())], names=["seq", "prev_seq", "n_removed", "n_added", "diff"])

    return pairs.mapInArrow(run, "seq bigint, prev_seq bigint, n_removed int, n_added int, diff string")
