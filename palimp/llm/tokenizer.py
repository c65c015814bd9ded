"""Encoding with a public byte-level BPE vocabulary (problem 6).

The vocabulary is a rank file (base64 token, blank, rank per line); its place is a parameter."""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimp.plans.durable import spread

#: Fixed value: the published pattern that cuts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = os.environ.get("PALIMP_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Words of more bytes than this are merged with a heap instead of repeated scans.
SHORT_WORD = 96
#: A worker forgets its words when it remembers this many.
MEMORY_WORDS = 60_000
NO_RANK = 1 << 60


class ByteBPE(dict):
    """Maps a word to its ids; remembers short words."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.words = regex.compile(WORDS).findall

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.scan(raw) if len(raw) <= SHORT_WORD else self.heap(raw)
        if len(raw) <= SHORT_WORD:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def scan(self, raw: bytes) -> list[int]:
        """Contiguous arrays of part boundaries and of the rank of each adjacent pair; the first
        smallest rank is merged by deleting the boundary inside its pair."""
        rank_of = self.ranks.get
        at = list(range(len(raw) + 1))
        ranks = [rank_of(raw[i : i + 2], NO_RANK) for i in range(len(raw) - 1)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(raw[at[i - 1] : at[i + 1]], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(raw[at[i] : at[i + 2]], NO_RANK)
        return [self.ranks[raw[a:b]] for a, b in zip(at, at[1:])]

    def heap(self, raw: bytes) -> list[int]:
        """The same merges for very long words in n log n: a heap of pairs over linked boundaries."""
        n, rank_of = len(raw), self.ranks.get
        after, before = [*range(1, n + 1), n], [-1, *range(n)]
        current = {}
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            rank = rank_of(raw[i : after[j]], NO_RANK) if j < n else NO_RANK
            current[i] = rank
            if rank != NO_RANK:
                heapq.heappush(queue, (rank, i))

        for i in range(n):
            offer(i)
        while queue:
            rank, i = heapq.heappop(queue)
            if current.get(i) != rank:
                continue
            j = after[i]
            after[i] = after[j]
            before[after[j]] = i
            current.pop(j, None)
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for word in self.words(text) if text else ():
            out += self[word]
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self[word]) for word in self.words(text)) if text else 0


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One encoder per worker process and rank file."""
    return ByteBPE(path)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``(id_col, ids)``: one row per input row, with the token ids of the whole text.

    Null and empty texts have the empty list; no special tokens are added and their strings are
    ordinary text. A null id stays null; repeated rows stay repeated; other columns are ignored."""
    source = spread(df.select(id_col, text_col))
    kind = source.schema[id_col].dataType

    def run(batches):
        bpe = load(ranks)
        for batch in batches:
            ends, ids = [0], []
            for text in batch.column(1).to_pylist():
                ids += bpe.encode(text)
                ends.append(len(ids))
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[id_col, "ids"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` and ``n_tokens`` (bigint); a null or empty text has 0 tokens."""
    source = spread(df.select(*keep, text_col))
    fields = [source.schema[c] for c in keep]

    def run(batches):
        bpe = load(ranks)
        for batch in batches:
            counts = pa.array([bpe.count(text) for text in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))


def p6_ids(spark, root: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"))
