"""Which language a paragraph is in: character trigram models of the languages that labelled texts are in."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.lookalike import Speller
from palimp.plans.durable import spread

WORD = regex.compile(r"\p{L}+(?:['’-]\p{L}+)*")
#: Characters whose presence makes a text worth folding before it is looked into.
UNUSUAL = regex.compile(r"[ ­̀-ͯ͏؜ᅟᅠ឴឵᠋-᠎ -‏ -  -⁯　ㅤ︀-️﻿＀-￯\U0001d400-\U0001d7ff]")
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}--\n]|\p{Cf}", flags=regex.V1)
#: Trigrams are counted in this many slots; a language needs this share of all labelled trigrams.
SLOTS, LEAST_SHARE = 1 << 16, 0.005
#: Log likelihood ratio from which a paragraph speaks for one language against another.
SURE = 6.0
#: Characters scored at once.
AT_ONCE = 1 << 19
#: A letter of one script right beside one of another.
MIXED = regex.compile(r"[A-Za-zÀ-ɏ][Ͱ-ԯ԰-֏]|[Ͱ-ԯ԰-֏][A-Za-zÀ-ɏ]")


@lru_cache(maxsize=1)
def _speller() -> Speller:
    return Speller({})


def fold(text: str) -> str:
    """Compatibility forms unified, invisible characters deleted and look-alike letters brought into
    one script per word, where there are any."""
    if UNUSUAL.search(text):
        text = IGNORABLE.sub("", unicodedata.normalize("NFKC", text))
    return _speller().canonical(text) if MIXED.search(text) else text


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Character -> itself in lower case if it is a letter, else 0; and whether it is Cyrillic (2), another
    letter (1) or none (0)."""
    low, script = np.zeros((1 << 16) + 1, np.int64), np.zeros((1 << 16) + 1, np.int8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            low[code] = min(ord(c.lower()[:1]), 1 << 16)
            script[code] = 2 if unicodedata.name(c, "").startswith("CYRILLIC") else 1
    return low, script


def _read(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of the trigram around each character, or -1 where that is no letter; script of each character;
    where each paragraph starts)."""
    seen = np.minimum(np.frombuffer((" " + " ".join(paragraphs) + " ").encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
    low, scripts = _letters()
    letters, script = low[seen], scripts[seen]
    slots = np.full(len(seen), -1)
    mixed = (letters[:-2] * 0x9E3779B1 ^ letters[1:-1] * 0x85EBCA77 ^ letters[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    slots[1:-1] = np.where(letters[1:-1] > 0, (mixed * 0x27D4EB2F >> 15) % SLOTS, -1)
    starts = np.cumsum([1, *(len(p) + 1 for p in paragraphs[:-1])]) if paragraphs else np.zeros(0, np.int64)
    return slots, script, starts


def trigram_counts(texts: list[str]) -> np.ndarray:
    slots = _read(texts)[0]
    return np.bincount(slots[slots >= 0], minlength=SLOTS)


class Languages:
    """Log probabilities of trigrams by language, add-one smoothed, from ``counts[language][slot]``."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        totals = {lang: sum(c.values()) for lang, c in counts.items()}
        whole = sum(totals.values())
        self.names = sorted(lang for lang, n in totals.items() if n >= LEAST_SHARE * whole and n > 0)
        self.table = np.zeros((SLOTS, len(self.names)), np.float32)
        self.cyrillic: dict[str, bool] = {}
        for i, lang in enumerate(self.names):
            held = np.ones(SLOTS)
            for slot, n in counts[lang].items():
                held[slot] += n
            self.table[:, i] = np.log(held / held.sum())

    def scores(self, paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood by paragraph and language, Cyrillic letters, letters)."""
        out, cyrillic, letters, at = np.zeros((len(paragraphs), len(self.names))), np.zeros(len(paragraphs), np.int64), np.zeros(len(paragraphs), np.int64), 0
        while at < len(paragraphs):
            stop, size = at, 0
            while stop < len(paragraphs) and (stop == at or size + len(paragraphs[stop]) < AT_ONCE):
                size += len(paragraphs[stop]) + 1
                stop += 1
            slots, script, starts = _read(paragraphs[at:stop])
            held = np.where((slots >= 0)[:, None], self.table[slots], 0.0)
            out[at:stop] = np.add.reduceat(held, starts)
            cyrillic[at:stop] = np.add.reduceat((script == 2).astype(np.int64), starts)
            letters[at:stop] = np.add.reduceat((script > 0).astype(np.int64), starts)
            at = stop
        return out, cyrillic, letters

    def differ(self, paragraphs: list[str], targets: list[str]) -> list[bool | None]:
        """Whether each paragraph is surely not in its target language; None if it speaks for neither. A target
        that no labelled text is in is told by its script only."""
        if not paragraphs:
            return []
        scores, cyrillic, letters = self.scores(paragraphs)
        place = {lang: i for i, lang in enumerate(self.names)}
        out: list[bool | None] = []
        for n, target in enumerate(targets):
            verdict = None
            base = target.lower().replace("_", "-").split("-", 1)[0]
            if letters[n]:
                i = place.get(base)
                if i is not None and len(self.names) > 1:
                    ratio = max(scores[n, j] for j in range(len(self.names)) if j != i) - scores[n, i]
                    verdict = True if ratio > SURE else False if ratio < -SURE else None
                if verdict is None and (2 * cyrillic[n] > letters[n]) != (base in CYRILLIC):
                    verdict = True
            out.append(verdict)
        return out


#: Languages written in Cyrillic.
CYRILLIC = ("ru", "uk", "be", "bg", "mk", "sr", "kk", "ky", "mn", "tg")


def fitted(texts: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, dict[int, int]]:
    """Trigram counts by label over all labelled texts, counted in the partitions and summed by label and slot.
    Few labels are wrong, so they weigh little; the labels are as few as languages, the slots are ``SLOTS``."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(label, []).append(value)
            for label, values in by.items():
                total[label] = total.get(label, 0) + trigram_counts(values)
        for label, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["label", "slot", "n"])

    named = texts.select(F.lower(lang).alias("_lang"), F.col(text).alias("_text")).filter("_lang is not null and _text is not null")
    sums = spread(named).mapInArrow(run, "label string, slot int, n bigint").groupBy("label", "slot").agg(F.sum("n").alias("n"))
    out: dict[str, dict[int, int]] = {}
    for row in sums.collect():
        out.setdefault(row["label"], {})[row["slot"]] = row["n"]
    return out
