"""Packing ordered paragraphs into word-budgeted chunks with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions.text import word_count

TARGET_WORDS, OVERLAP = 150, 1


def distinct_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """One row per (book_id, chapter_idx, para_idx): repeats count once, and of differing texts the
    smallest holds. Rows with a null position are left out."""
    keyed = paragraphs.filter("book_id is not null and chapter_idx is not null and para_idx is not null")
    return keyed.groupBy("book_id", "chapter_idx", "para_idx").agg(F.min("text").alias("text"))


def pack(paragraphs: DataFrame, target: int = TARGET_WORDS) -> DataFrame:
    """``(book_id, chapter_idx, chunk_no, para_idx array, word_count)`` in document order.

    Per chapter, a chunk is closed when it is not empty and the next paragraph would exceed ``target``;
    a paragraph above the target stands alone; chunks do not cross chapters. Null and blank paragraphs
    hold no words. Words are counted where texts are read; the fold runs over numbers only, in one pass
    over a chapter's sorted rows with one open chunk in memory, however long the chapter."""
    counted = paragraphs.filter("book_id is not null and chapter_idx is not null and para_idx is not null")
    # of differing texts of a place the smallest holds, as in distinct_paragraphs; its count goes with it
    one = counted.groupBy("book_id", "chapter_idx", "para_idx").agg(F.min_by(word_count(F.col("text")), F.col("text")).alias("n")).select("book_id", "chapter_idx", "para_idx", F.coalesce("n", F.lit(0)).alias("n"))
    rows = one.repartition("book_id", "chapter_idx").sortWithinPartitions("book_id", "chapter_idx", "para_idx")

    def run(batches):
        at, no, held, total = None, 0, [], 0
        out: list[tuple] = []

        def flush():
            nonlocal out
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["book_id", "chapter_idx", "chunk_no", "para_idx", "word_count"])
            out = []
            return made

        for batch in batches:
            for book, chapter, p, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (book, chapter) != at or (held and total + n > target):
                    if held:
                        out.append((*at, no, held, total))
                    no = no + 1 if (book, chapter) == at else 1
                    at, held, total = (book, chapter), [], 0
                held.append(p)
                total += n
            yield flush()
        if held:
            out.append((*at, no, held, total))
            yield flush()

    return rows.mapInArrow(run, "book_id bigint, chapter_idx int, chunk_no int, para_idx array<int>, word_count bigint")


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.format_string("ch%02d_c%02d", F.col("chapter_idx") + 1, F.col("chunk_no")))


def with_overlap(chunks: DataFrame, k: int = OVERLAP) -> DataFrame:
    """Adds the last and first ``k`` paragraphs of the neighbouring chunks of the chapter."""
    order = Window.partitionBy("book_id", "chapter_idx").orderBy("chunk_no")
    none = F.expr("cast(array() as array<int>)")
    before, after = F.lag("para_idx").over(order), F.lead("para_idx").over(order)
    chunks = chunks.withColumn("_b", before).withColumn("_a", after)
    last = F.slice("_b", F.greatest(F.size("_b") - k + 1, F.lit(1)), k)
    return chunks.withColumn("prev_overlap", F.coalesce(last, none)).withColumn("next_overlap", F.coalesce(F.slice("_a", 1, k), none)).drop("_a", "_b")
