"""Occurrences and presence of every distinct term of a collection (problem 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.plans.durable import durable, meet, pinned

#: A maximal run of letters; one apostrophe or hyphen between two letters belongs to it.
TERM = r"\p{L}+(?:['’-]\p{L}+)*"
#: Identifiers are summed in ranges of this many.
RANGE = 1 << 12
#: A block hands on its counts when it has met this many different terms.
BLOCK_TERMS = 200_000
NOT_BLANK = r"(?U)\S"


def _records(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``_text`` of every record once. Which keys have several rows is told by the keys alone; only the texts of
    those keys are moved, so that the smallest can be kept."""
    names = [f"_k{i}" for i in range(len(keys))]
    named = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text")).filter(F.col("_text").rlike(NOT_BLANK))
    several = durable(named.select(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(n).alias(f"{n}r") for n in names]))
    same = [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]
    lone = meet(named, several, same, "left_anti").select("_text")
    again = meet(named, several, same, "left_semi").groupBy(*names).agg(F.min("_text").alias("_text")).select("_text")
    return lone.unionByName(again)


def _count_blocks(batches):
    """For the terms of a block, its counts of occurrences and of records: one row per term, and one
    without a term that has the number of the block's records."""
    find = regex.compile(TERM).findall
    number: dict[str, int] = {}
    occurs, present, records = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def block():
        n = len(number)
        columns = [pa.array([*number, None], pa.string()), pa.array(np.append(occurs[:n], 0)), pa.array(np.append(present[:n], records))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "n_occurrences", "n_records"])

    for batch in batches:
        for text in batch.column(0):
            spelt = [number.setdefault(t.lower().replace("’", "'"), len(number)) for t in find(text.as_py())]
            while len(number) > len(occurs):
                occurs, present = np.append(occurs, np.zeros_like(occurs)), np.append(present, np.zeros_like(present))
            codes, times = np.unique(np.array(spelt, np.int64), return_counts=True)
            occurs[codes] += times
            present[codes] += 1
            records += 1
            if len(number) > BLOCK_TERMS:
                yield block()
                number, occurs, present, records = {}, np.zeros_like(occurs), np.zeros_like(present), 0
    if records:
        yield block()


def dictionary(blocks: DataFrame) -> DataFrame:
    """``(term, term_id)`` for every term of the blocks: dense identifiers from 0 in the order of the terms.

    The distinct terms are ordered across partitions; a partition's first identifier is the number of
    terms before it, told by one count per partition."""
    terms = pinned(blocks.filter("term is not null").select("term").distinct().repartitionByRange("term").sortWithinPartitions("term"))

    def sizes(batches):
        n = sum(batch.num_rows for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in terms.mapInArrow(sizes, "part int, n bigint").collect()):
        starts[part], total = total, total + n

    def numbered(batches):
        at = starts[TaskContext.get().partitionId()]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + batch.num_rows), pa.int64())], names=["term", "term_id"])
            at += batch.num_rows

    return terms.mapInArrow(numbered, "term string, term_id bigint")


_ARRAYS = "part bigint, at array<int>, n_occurrences array<bigint>, n_records array<bigint>"


def _arrays(batches):
    """Rows of encoded counts, sorted by identifier, as arrays: for every range of identifiers that the block
    touches, the places it has counts for and the counts. Memory holds one range."""
    held, occ, rec = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

    def ended():
        at = np.flatnonzero(rec)
        row = [pa.array([held], pa.int64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([occ[at]], pa.list_(pa.int64())), pa.array([rec[at]], pa.list_(pa.int64()))]
        occ[:], rec[:] = 0, 0
        return pa.RecordBatch.from_arrays(row, names=["part", "at", "n_occurrences", "n_records"])

    for batch in batches:
        ids, occs, recs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts = ids // RANGE
        edges = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1))
        for lo, hi in zip(edges, np.append(edges[1:], len(ids))):
            if held is not None and parts[lo] != held:
                yield ended()
            held = int(parts[lo])
            np.add.at(occ, ids[lo:hi] % RANGE, occs[lo:hi])
            np.add.at(rec, ids[lo:hi] % RANGE, recs[lo:hi])
    if held is not None:
        yield ended()


def _sum_ranges(batches):
    """The arrays of all blocks, sorted by range, summed range by range; one row per identifier."""
    held, occ, rec = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

    def ended():
        at = np.flatnonzero(rec)
        row = [pa.array(held * RANGE + at), pa.array(occ[at]), pa.array(rec[at])]
        occ[:], rec[:] = 0, 0
        return pa.RecordBatch.from_arrays(row, names=["term_id", "n_occurrences", "n_records"])

    for batch in batches:
        for part, at, occs, recs in zip(*batch.columns):
            if held is not None and part.as_py() != held:
                yield ended()
            held = part.as_py()
            places = at.values.to_numpy()
            occ[places] += occs.values.to_numpy()
            rec[places] += recs.values.to_numpy()
    if held is not None:
        yield ended()


def _counted(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, int]:
    """(the term table, the number of records)."""
    blocks = durable(_records(df, keys, text).mapInArrow(_count_blocks, "term string, n_occurrences bigint, n_records bigint"))
    known = durable(dictionary(blocks))
    encoded = blocks.filter("term is not null").join(known, "term").select("term_id", "n_occurrences", "n_records").sortWithinPartitions("term_id")
    sums = encoded.mapInArrow(_arrays, _ARRAYS).repartition("part").sortWithinPartitions("part").mapInArrow(_sum_ranges, "term_id bigint, n_occurrences bigint, n_records bigint")
    total = blocks.filter("term is null").agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n")).scalar()
    return sums.join(known, "term_id").select("term_id", "term", "n_occurrences", "n_records"), total


def term_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(term_id, term, n_occurrences, n_records)``, one row per distinct term of the collection.

    A record is one value of ``keys`` whose text is neither null nor blank; rows that repeat a record
    count once, of differing texts the smallest (null keys count as a value of their own). Terms are
    lower-cased with the straight apostrophe. Identifiers are dense and ascend with the term. An empty
    table gives no rows. Other columns are ignored.

    The global dictionary is built first, from the distinct terms of all blocks. A block counts every term
    of its records once before anything is shuffled, so a term that is in every record is moved once per
    block. The counts are encoded by the dictionary, packed into arrays by range of identifiers, and the
    arrays of a range are summed in one task that holds that range only."""
    return _counted(df, keys, text)[0]


def mark_terms(df: DataFrame, keys: list[str], text: str = "text", rare_at_most: int = 2, common_over: float = 0.35) -> DataFrame:
    """``term_table`` with ``mark``: ``rare`` (at most ``rare_at_most`` occurrences), ``common`` (more,
    and in more than the share ``common_over`` of the records) or null."""
    table, total = _counted(df, keys, text)
    mark = F.when(F.col("n_occurrences") <= rare_at_most, "rare").when(F.col("n_records") > F.lit(total) * F.lit(common_over), "common")
    return table.withColumn("mark", mark)


def p3_terms(spark, root: str) -> DataFrame:
    chapters = spark.read.parquet(f"{root}/extracted_chapters.parquet")
    return mark_terms(chapters, ["book_id", "pos"]).select("term", "n_occurrences", "n_records", "mark")


def p3_found(spark, root: str) -> DataFrame:
    chapters = spark.read.parquet(f"{root}/extracted_chapters.parquet")
    return mark_terms(chapters, ["book_id", "pos"]).filter("mark is not null").select("term", "mark")


_COUNTED = r"""
WITH rec AS (
  SELECT book_id, pos, min(text) AS text FROM extracted_chapters
  WHERE regexp_matches(text, '[^\s\p{Z}\x{85}]') GROUP BY book_id, pos),
term AS (
  SELECT book_id, pos, replace(lower(unnest(regexp_extract_all(text, '\p{L}+(?:[''’-]\p{L}+)*'))), '’', '''') AS term
  FROM rec),
counted AS (
  SELECT term, CAST(count(*) AS BIGINT) AS n_occurrences, CAST(count(DISTINCT (book_id, pos)) AS BIGINT) AS n_records
  FROM term GROUP BY term),
marked AS (
  SELECT *, CASE WHEN n_occurrences <= 2 THEN 'rare'
                 WHEN n_records > 0.35 * (SELECT count(*) FROM rec) THEN 'common' END AS mark
  FROM counted)
"""
SQL = {
    "p3_terms": _COUNTED + "SELECT term, n_occurrences, n_records, mark FROM marked",
    "p3_found": _COUNTED + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
}
