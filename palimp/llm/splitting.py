"""Splitting chunks that hold more words than the limit (problem 5)."""

from __future__ import annotations

from collections import Counter
from math import sqrt

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.plans.durable import durable, meet

LIMIT = 150
#: A sentence ends here; its last character stays with it.
SENTENCE_END = regex.compile(r"(?<=[.!?…»])\s+")
#: Words on either side of a gap whose likeness is compared.
BLOCK_WORDS = 40
#: A piece holds at least this share of the limit where a cut leaves the choice.
FILL = 0.5
LEVELS = ("paragraph", "sentence", "word")
PIECES = (
    "book_id bigint, chunk_id string, piece_no int, n_pieces int, level string, para_idx array<int>, first_word int, word_count int, text string, "
    "prev_overlap array<int>, next_overlap array<int>, prev_text string, next_text string, cut_level string"
)


def sentences(paragraph: str) -> list[str]:
    return [s for s in SENTENCE_END.split(paragraph.strip()) if s]


def valleys(units: list[list[str]]) -> list[float]:
    """For each gap between neighbouring units, how far the likeness of the word blocks on both sides
    lies below the nearest peaks to the left and right. Both blocks slide along with the gap."""
    words = [w for unit in units for w in unit]
    ends, at = [], 0
    for unit in units[:-1]:
        at += len(unit)
        ends.append(at)
    left, right, like = Counter(), Counter(), []
    lo = mid = hi = 0
    dot = ll = rr = 0

    def change(side: Counter, other: Counter, word: str, by: int) -> tuple[int, int]:
        n = side[word]
        side[word] = n + by
        return by * other[word], by * (2 * n + by)

    for gap in ends:
        while hi < min(len(words), gap + BLOCK_WORDS):
            d, q = change(right, left, words[hi], 1)
            dot, rr, hi = dot + d, rr + q, hi + 1
        while mid < gap:
            d, q = change(right, left, words[mid], -1)
            dot, rr = dot + d, rr + q
            d, q = change(left, right, words[mid], 1)
            dot, ll, mid = dot + d, ll + q, mid + 1
        while lo < gap - BLOCK_WORDS:
            d, q = change(left, right, words[lo], -1)
            dot, ll, lo = dot + d, ll + q, lo + 1
        like.append(dot / sqrt(ll * rr) if ll and rr else 0.0)
    n = len(like)
    peak_left, peak_right = like[:], like[:]
    for i in range(1, n):
        if like[i - 1] >= like[i]:
            peak_left[i] = peak_left[i - 1]
    for i in range(n - 2, -1, -1):
        if like[i + 1] >= like[i]:
            peak_right[i] = peak_right[i + 1]
    return [peak_left[i] + peak_right[i] - 2 * like[i] for i in range(n)]


def cut(units: list[list[str]], limit: int) -> list[tuple[int, int]]:
    """Half-open ranges of units, each of at most ``limit`` words (no unit holds more). Of the gaps
    that leave a piece at least half full, the deepest valley is cut; the later of equal ones."""
    sizes = [len(u) for u in units]
    depth, out, start, left = valleys(units), [], 0, sum(sizes)
    while start < len(units):
        if left <= limit:
            out.append((start, len(units)))
            break
        best, end, held = None, start, 0
        while end < len(units) and held + sizes[end] <= limit:
            held += sizes[end]
            end += 1
            if end < len(units) and (best is None or (held >= FILL * limit and (best[2] < FILL * limit or depth[end - 1] >= best[0])) or best[2] < FILL * limit):
                best = (depth[end - 1], end, held)
        out.append((start, best[1]))
        left -= best[2]
        start = best[1]
    return out


def split_chunk(indexes: list[int], texts: list[str | None], limit: int = LIMIT, before: tuple | None = None, after: tuple | None = None) -> list[dict]:
    """The pieces of one chunk in order; none if it holds at most ``limit`` words.

    Runs of whole paragraphs are cut at paragraph ends; a paragraph over the limit at its sentence
    ends; a sentence over the limit between words. Each piece carries as overlap the neighbouring
    paragraph on either side or, where the cut lies inside a paragraph, the neighbouring sentence (of
    a sentence cut between words, the part of it in the neighbouring piece); ``before`` and ``after``
    are the chunk's neighbours (index, text)."""
    texts = [t or "" for t in texts]
    words = [t.split() for t in texts]
    if sum(map(len, words)) <= limit:
        return []
    pieces: list[dict] = []

    def add(level, paras, first, count, text, head, tail):
        pieces.append({"level": level, "para_idx": paras, "first_word": first, "word_count": count, "text": text, "head": head, "tail": tail})

    def whole(lo: int, hi: int) -> None:
        run = [[w.lower() for w in words[i]] for i in range(lo, hi)]
        for a, b in cut(run, limit):
            a, b = a + lo, b + lo
            add("paragraph", indexes[a:b], 0, sum(map(len, words[a:b])), "\n".join(texts[a:b]), texts[a], texts[b - 1])

    lo, deepest = 0, 0
    for i, own in enumerate(words):
        if len(own) <= limit:
            continue
        if lo < i:
            whole(lo, i)
        lo = i + 1
        deepest = max(deepest, 1)
        # units inside the paragraph: sentences, or the words of a sentence that is itself too long
        spans = [s.split() for s in sentences(texts[i])]
        first, at = 0, 0
        while at < len(spans):
            if len(spans[at]) > limit:
                deepest = 2
                for a, b in cut([[w.lower()] for w in spans[at]], limit):
                    text = " ".join(spans[at][a:b])
                    add("word", [indexes[i]], first + a, b - a, text, text, text)
                first += len(spans[at])
                at += 1
                continue
            stop = at
            while stop < len(spans) and len(spans[stop]) <= limit:
                stop += 1
            for a, b in cut([[w.lower() for w in s] for s in spans[at:stop]], limit):
                held = spans[at + a : at + b]
                add("sentence", [indexes[i]], first, sum(map(len, held)), " ".join(" ".join(s) for s in held), " ".join(held[0]), " ".join(held[-1]))
                first += sum(map(len, held))
            at = stop
    if lo < len(words):
        whole(lo, len(words))
    for n, piece in enumerate(pieces):
        prior, later = pieces[n - 1] if n else None, pieces[n + 1] if n + 1 < len(pieces) else None
        # the neighbouring paragraph or sentence, as the neighbouring piece ends or begins
        piece["prev_overlap"], piece["prev_text"] = ([prior["para_idx"][-1]], prior["tail"]) if prior else ([before[0]], before[1]) if before else ([], None)
        piece["next_overlap"], piece["next_text"] = ([later["para_idx"][0]], later["head"]) if later else ([after[0]], after[1]) if after else ([], None)
        piece |= {"piece_no": n, "n_pieces": len(pieces), "cut_level": LEVELS[deepest]}
    return pieces


def split_oversized(chunks: DataFrame, paragraphs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces of every chunk whose paragraphs hold more than ``limit`` words (``PIECES``).

    Words are counted in the paragraphs' texts, never taken from a count column. Repeats of a chunk or
    paragraph count once; a paragraph entered with two texts has the smaller; a listed paragraph that
    does not exist, or has a null text, holds no words; chunks with a null key or list give no rows.
    Empty tables give no rows; other columns are ignored. A chunk is the unit of work: its paragraphs
    meet in one row, chunks of one book do not. Words are counted where paragraphs are read; texts are
    fetched for chunks that can be over the limit only."""
    named = chunks.select("book_id", "chunk_id", "chapter_idx", F.col("para_idx").alias("_list")).filter("chunk_id is not null and size(_list) > 0")
    keys = ["book_id", "chapter_idx", "para_idx"]
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    # counts come first, the largest of a paragraph's texts: chunks that cannot be over the limit are left out
    counts = paragraphs.filter("text is not null").select(*keys, words("text").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_n"))
    listed = named.distinct().select("book_id", "chunk_id", "chapter_idx", F.explode("_list").alias("para_idx"))
    large = durable(listed.join(counts, keys).groupBy("book_id", "chunk_id").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > limit).select("book_id", "chunk_id"))
    reach = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), (F.array_min("_list") - 1).alias("idx"))), F.transform("_list", lambda x, i: F.struct(i.alias("pos"), x.alias("idx"))), F.array(F.struct(F.lit(2**31 - 1).alias("pos"), (F.array_max("_list") + 1).alias("idx"))))
    over_any = meet(named, large, ["book_id", "chunk_id"], "left_semi").distinct()
    wanted = durable(over_any.select("book_id", "chunk_id", "chapter_idx", F.explode(reach).alias("_at")).select("book_id", "chunk_id", "chapter_idx", F.col("_at.pos").alias("_pos"), F.col("_at.idx").alias("para_idx")))
    texts = paragraphs.select(*keys, F.col("text").alias("_text")).filter("_text is not null")
    held = meet(texts, wanted, keys, "inner").select("book_id", "chunk_id", F.struct(F.col("_pos").alias("pos"), F.col("para_idx").alias("idx"), F.col("_text").alias("text"), words("_text").alias("n")).alias("_p"))
    grouped = held.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set("_p")).alias("_ps"))
    inner = F.filter("_ps", lambda p: p["pos"].between(0, 2**31 - 2))
    over = grouped.filter(F.aggregate(inner, F.lit(0), lambda s, p: s + p["n"]) > limit)

    def run(frames):
        for frame in frames:
            out = []
            for book, chunk, rows in zip(frame["book_id"], frame["chunk_id"], frame["_ps"]):
                seen, own, before, after = set(), [], None, None
                for row in rows:
                    if row["pos"] in seen:
                        continue
                    seen.add(row["pos"])
                    if row["pos"] == -1:
                        before = (row["idx"], row["text"])
                    elif row["pos"] == 2**31 - 1:
                        after = (row["idx"], row["text"])
                    else:
                        own.append(row)
                for piece in split_chunk([int(r["idx"]) for r in own], [r["text"] for r in own], limit, before, after):
                    out.append({"book_id": book, "chunk_id": chunk} | {k: v for k, v in piece.items() if k not in ("head", "tail")})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return over.mapInPandas(run, PIECES)


def p5_pieces(spark, root: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{root}/chunks.parquet"), spark.read.parquet(f"{root}/paragraphs.parquet"))


def p5_found(spark, root: str) -> DataFrame:
    return p5_pieces(spark, root).filter("piece_no = 0").select("book_id", "chunk_id", "cut_level")


SQL = {
    "p5_found": r"""
WITH one AS (SELECT DISTINCT book_id, chunk_id, chapter_idx, para_idx FROM chunks WHERE chunk_id IS NOT NULL),
item AS (SELECT book_id, chunk_id, chapter_idx, unnest(para_idx) AS para_idx FROM one),
para AS (SELECT DISTINCT book_id, chapter_idx, para_idx, text FROM paragraphs WHERE text IS NOT NULL),
held AS (
  SELECT book_id, chunk_id, para_idx,
    len(regexp_extract_all(text, '[^\s\p{Z}\x{85}]+')) AS n,
    list_max(list_transform(regexp_extract_all(
        regexp_replace(text, '([.!?…»])[\s\p{Z}\x{85}]+', '\1' || chr(10) || chr(10), 'g'), '(?:[^\n]|\n[^\n])+'),
      lambda s: len(regexp_extract_all(s, '[^\s\p{Z}\x{85}]+')))) AS longest
  FROM item JOIN para USING (book_id, chapter_idx, para_idx))
SELECT book_id, chunk_id,
  CASE WHEN max(n) <= 150 THEN 'paragraph' WHEN coalesce(max(longest), 0) <= 150 THEN 'sentence' ELSE 'word' END AS cut_level
FROM held GROUP BY book_id, chunk_id HAVING sum(n) > 150"""
}
