"""One form for text that looks the same (problem 1)."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.plans.durable import durable, spread

#: Letters that look alike; in each group Latin, Cyrillic, then Greek and others.
GROUPS = (
    "aаα cсϲ eе oоοօ pрρ xхχ yуγ iіι jјϳ sѕ hһհ dԁ qԛզ wԝ vѵν uսυ nո "
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟՕ PРΡ SЅՏ TТΤ XХΧ YУΥ ZΖ QԚ WԜ"
).split()
LATIN, CYRILLIC, OTHER = 0, 1, 2
#: Leaving a script inside a token is a last resort; the script of the value's unambiguous letters is
#: next; the n-gram scores decide the rest.
SWITCH, PRIOR, FLOOR = -1000.0, 100.0, -12.0
#: Compatibility characters that draw more or something else than what they decompose to, by kind of
#: decomposition and, of the rest, one by one: they stay.
KEPT_KINDS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
KEPT = "…‥․‼⁇⁈⁉″‴⁗‶‷№℀℁℅℆℠™℡¨¯´¸˘˙˚˛˜˝‗‾"
#: Letters of one script that look alike.
SAME_SCRIPT = {"ɡ": "g", "ӏ": "l"}
#: A class of equal-looking rows is paired in parts of about this many rows.
CLASS_ROWS = 1000
MEMORY_TOKENS = 100_000
TOKEN = regex.compile(r"(<\s*/?\s*)?([\p{L}\p{M}]+)")
IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--\t\n\r]", flags=regex.V1)
SPACE = regex.compile(r"[\p{Z}\x0b\x0c\x85]")


def _script(char: str) -> int:
    name = unicodedata.name(char, "")
    return LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else OTHER


@lru_cache(maxsize=1)
def alternatives() -> dict[str, dict[int, str]]:
    """Letter -> its look-alike in each script; the first other letter of a group stands for the others."""
    out: dict[str, dict[int, str]] = {}
    for group in GROUPS:
        forms: dict[int, str] = {}
        for c in group:
            forms.setdefault(_script(c), c)
        for c in group:
            out[c] = forms
    return out


class _Folded(dict):
    """Character (as a number) -> what it is folded to."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.decomposition(c)
        if SPACE.match(c):
            out = " "
        elif IGNORABLE.match(c):
            out = ""
        elif c in SAME_SCRIPT:
            out = SAME_SCRIPT[c]
        elif c in alternatives():
            out = c  # the lattice has it by its shape, whatever it is a variant of
        elif kind.startswith("<") and c not in KEPT and not kind.startswith(KEPT_KINDS):
            out = SPACE.sub(" ", unicodedata.normalize("NFKC", c))
        else:
            out = c
        self[code] = out
        return out


FOLDED = _Folded()


def fold(value: str) -> str:
    """Compatibility forms as ordinary ones (but for those in ``KEPT`` and ``KEPT_KINDS``), every space the
    same, nothing invisible."""
    return unicodedata.normalize("NFC", value.translate(FOLDED))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """UTF-16 unit -> 0 no letter, 1 Latin, 2 Latin with a look-alike, 3 Cyrillic, 4 Cyrillic with one,
    5 anything that needs the full treatment, 6 other letters."""
    table = np.zeros(1 << 16, np.uint8)
    alike = alternatives()
    for code in range(1 << 16):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cs", "Co", "Cn") or category[0] == "M" or FOLDED[code] != c or unicodedata.normalize("NFC", c) != c:
            table[code] = 5
        elif category[0] == "L":
            bare = unicodedata.normalize("NFD", c)[0]
            script, double = _script(bare), bare in alike
            table[code] = 5 if script == OTHER and double else 6 if script == OTHER else (1, 3)[script] + double
    return table


@lru_cache(maxsize=1)
def _bare() -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 unit -> its letter without marks, lower case (0 for none), and its script + 1 (0 for none, 4 for a
    mark, which is no part of a token's letters)."""
    letter, script = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if unicodedata.category(c)[0] == "M":
            script[code] = 4
        elif c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            low = base.lower()[:1]
            letter[code], script[code] = ord(low) if ord(low) < 1 << 16 else 0, _script(base) + 1
    return letter, script


def pair_counts(values: list[str]) -> dict[tuple[int, int, int], int]:
    """How often a letter follows another (0: begins) in tokens written in one script, Latin or Cyrillic, marks
    aside: (script, last letter, letter) -> times. One look-up per character."""
    units = np.frombuffer("\0".join(["", *values, ""]).encode("utf-16-le", "surrogatepass"), np.uint16)
    letters, scripts = (t[units] for t in _bare())
    keep = scripts != 4
    letters, scripts = letters[keep].astype(np.int64), scripts[keep].astype(np.int64)
    inside = scripts > 0
    first = inside & ~np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(first)
    if not len(starts):
        return {}
    token = np.cumsum(first) - 1
    low, high = np.full(len(starts), 9), np.zeros(len(starts), np.int64)
    np.minimum.at(low, token[inside], scripts[inside])
    np.maximum.at(high, token[inside], scripts[inside])
    fine = inside & (low == high)[np.maximum(token, 0)] & (scripts < OTHER + 1)
    at = np.flatnonzero(fine)
    before = np.where(first[at], 0, letters[np.maximum(at - 1, 0)])
    keys, times = np.unique((scripts[at] - 1) << 32 | before << 16 | letters[at], return_counts=True)
    return {(int(k) >> 32, int(k) >> 16 & 0xFFFF, int(k) & 0xFFFF): int(n) for k, n in zip(keys, times)}


def scores_of(counts: dict[tuple[int, int, int], int]) -> dict:
    """Log scores (script, last letter, letter) from ``pair_counts``; ``^`` stands before the first letter."""
    firsts: Counter = Counter()
    for (script, a, _), n in counts.items():
        firsts[script, a] += n
    return {(script, chr(a) if a else "^", chr(b)): log(n / firsts[script, a]) for (script, a, b), n in counts.items()}


def fit(values: list[str]) -> dict:
    return scores_of(pair_counts(values))


class Speller:
    def __init__(self, scores: dict):
        self.scores = scores
        self.tokens: dict[tuple[str, int], str] = {}

    def spell(self, token: str, prior: int) -> str:
        """The best path through the token's lattice: each letter in any script that has its shape,
        scored by the n-grams of that script. What is observed among look-alikes does not matter, so
        tokens that look the same come out the same."""
        held = self.tokens.get((token, prior))
        if held is not None:
            return held
        alike, score = alternatives(), self.scores.get
        parts: list[list[str]] = []  # letter, its marks
        for c in unicodedata.normalize("NFD", token):
            if parts and unicodedata.combining(c):
                parts[-1].append(c)
            else:
                parts.append([c])
        ends: dict[int, tuple[float, str, str]] = {}
        for n, (c, *marks) in enumerate(parts):
            forms = alike.get(c) or {_script(c): c}
            now: dict[int, tuple[float, str, str]] = {}
            for script in sorted(forms):
                form, low = forms[script], forms[script].lower()
                best = None
                for before, (total, last, spelt) in ends.items() if n else [(script, (PRIOR if script == prior else 0.0, "^", ""))]:
                    gain = score((script, last, low), FLOOR) if before == script else SWITCH + score((script, "^", low), FLOOR)
                    if best is None or total + gain > best[0]:
                        best = (total + gain, low, spelt + form + "".join(marks))
                now[script] = best
            ends = now
        out = unicodedata.normalize("NFC", max(ends.values(), key=lambda e: e[0])[2]) if ends else token
        if len(token) <= 48:
            if len(self.tokens) > MEMORY_TOKENS:
                self.tokens.clear()
            self.tokens[token, prior] = out
        return out

    def canonical(self, value: str) -> str:
        """The one form of a value. Names inside tags stay Latin."""
        value = fold(value)  # also composes what stands outside tokens
        counts = [0, 0, 0]
        alike = alternatives()
        for c in unicodedata.normalize("NFD", value):
            if c.isalpha() and c not in alike:
                counts[_script(c)] += 1
        prior = CYRILLIC if counts[CYRILLIC] > counts[LATIN] else LATIN if counts[LATIN] > counts[CYRILLIC] else OTHER
        return TOKEN.sub(lambda m: (m[1] or "") + self.spell(m[2], LATIN if m[1] else prior), value)


def _settled(values: list[str]) -> list[bool]:
    """Which values are their own canonical form for sure, told from their character classes at once:
    nothing to fold, no token of two scripts, and no token wholly of look-alikes unless it is in the
    script of most unambiguous letters (or, in a tag, Latin)."""
    units = np.frombuffer("\0".join(values).encode("utf-16-le", "surrogatepass") + b"\0\0", np.uint16)
    ends = np.flatnonzero(units == 0)
    if len(ends) != len(values):
        return [False] * len(values)
    kinds = _classes()[units]
    kinds[ends] = 0
    starts = np.concatenate([[0], ends[:-1] + 1])
    row = np.zeros(len(units), np.int64)
    row[ends[:-1] + 1] = 1
    row = np.cumsum(row)
    n = len(values)
    bad = np.bincount(row[kinds == 5], minlength=n) > 0
    latin, cyrillic = (kinds == 1) | (kinds == 2), (kinds == 3) | (kinds == 4)
    other = kinds == 6
    touching = (latin[:-1] & (cyrillic | other)[1:]) | (cyrillic[:-1] & (latin | other)[1:]) | (other[:-1] & (latin | cyrillic)[1:])
    bad |= np.bincount(row[:-1][touching], minlength=n) > 0
    n_latin = np.bincount(row[kinds == 1], minlength=n)
    n_cyrillic = np.bincount(row[kinds == 3], minlength=n)
    letter = latin | cyrillic | other
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if len(first):
        sure = np.add.reduceat(((kinds == 1) | (kinds == 3) | other).astype(np.int32), first) > 0
        # reduceat runs on to the next token's start; between them are no letters
        open_ = first[~sure]
        rows, is_latin = row[open_], latin[open_]
        behind = units[np.maximum(open_ - 1, 0)]
        before = units[np.maximum(open_ - 2, 0)]
        tag = (open_ > starts[rows]) & ((behind == 0x3C) | ((behind == 0x2F) & (before == 0x3C)))
        agrees = np.where(is_latin, tag | (n_latin[rows] > n_cyrillic[rows]), ~tag & (n_cyrillic[rows] > n_latin[rows]))
        bad |= np.bincount(rows[~agrees], minlength=n) > 0
    return (~bad).tolist()


@lru_cache(maxsize=2)
def _speller(scores: tuple) -> Speller:
    return Speller(dict(scores))


def fitted(values: DataFrame, col: str) -> dict:
    """``fit`` over a whole column: pairs of letters are counted in the partitions and summed; there are no
    more of them than the square of the two alphabets."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            total.update(pair_counts([v for v in batch.column(0).to_pylist() if v]))
        columns = [pa.array([k[i] for k in total], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.int64())], names=["script", "a", "b", "n"])

    sums = spread(values.select(col)).mapInArrow(run, "script int, a int, b int, n bigint").groupBy("script", "a", "b").agg(F.sum("n").alias("n"))
    return scores_of({(r["script"], r["a"], r["b"]): r["n"] for r in sums.collect()})


def _fitted(values: DataFrame):
    return values.sparkSession.sparkContext.broadcast(tuple(sorted(fitted(values, "_value").items())))


def canonical_column(df: DataFrame, id_col: str, value_col: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """``(id_col, value_col, changed)``: every value in its canonical form, one row per input row.

    Null stays null and unchanged. Case, visible accents and punctuation are kept; full-width forms,
    decomposed letters, invisible characters and kinds of space are unified, and each token is spelt in
    the script that its letters allow and its n-grams favour. Other columns are ignored. The n-gram
    scores are counted over all values of ``fitted_on`` (or of ``df``); which of two scripts a wholly
    ambiguous token gets can depend on them, that equal-looking tokens come out equal cannot."""
    named = df.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value"))
    scores = _fitted(named if fitted_on is None else fitted_on.select(F.col(value_col).alias("_value")))
    kind = named.schema["_id"].dataType.simpleString()

    def run(batches):
        speller = _speller(scores.value)
        for batch in batches:
            values = batch.column(1).to_pylist()
            settled = _settled([v or "" for v in values])
            out = [v if v is None or ok else speller.canonical(v) for v, ok in zip(values, settled)]
            changed = [v is not None and v != w for v, w in zip(values, out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(changed, pa.bool_())], names=[id_col, value_col, "changed"])

    return spread(named).mapInArrow(run, f"{id_col} {kind}, {value_col} string, changed boolean")


def _digests(values: DataFrame, scope: list[str]) -> tuple[DataFrame, list[str]]:
    """(rows ``fld, id, *scope as _s0.., _canon, _raw``, each once, written; the columns that name a class)."""
    scores = _fitted(values)
    keys = [f"_s{i}" for i in range(len(scope))]
    source = spread(values.select("fld", "id", "_value", *[F.col(c).cast("string").alias(k) for c, k in zip(scope, keys)]).filter("_value is not null"))

    def run(batches):
        speller = _speller(scores.value)
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            held = batch.column(2).to_pylist()
            raw = [digest(v.encode("utf-8", "surrogatepass")) for v in held]
            canon = [r if ok else digest(speller.canonical(v).encode("utf-8", "surrogatepass")) for v, r, ok in zip(held, raw, _settled(held))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[3:], pa.array(canon, pa.binary()), pa.array(raw, pa.binary())], names=["fld", "id", *keys, "_canon", "_raw"])

    schema = "fld string, id bigint, " + "".join(f"{k} string, " for k in keys) + "_canon binary, _raw binary"
    return durable(source.mapInArrow(run, schema).distinct()), ["fld", *keys, "_canon"]


def _several(rows: DataFrame, group: list[str]) -> DataFrame:
    """Classes with more than one stored form: ``group``, the number of rows and the smallest id."""
    return rows.groupBy(*group).agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first")).filter("_lo <> _hi").drop("_lo", "_hi")


def _same(a: str, b: str, group: list[str]) -> list:
    return [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]


def alike_pairs(values: DataFrame, scope: list[str]) -> DataFrame:
    """``(fld, id_a, id_b)``, id_a < id_b: rows of one field and scope whose values differ as stored but
    have the same canonical form. ``values`` has ``fld``, ``id``, ``_value`` and the scope columns.

    Null values have no partner; rows that repeat an id with the same value count once; a null in the
    scope equals only itself. Values become two 128-bit digests where they are read, so no text is
    shuffled. Groups of a single stored form, however large, end in a pre-aggregated minimum and
    maximum and are never joined; only the rows of groups with several forms meet, and only across
    forms. A large group meets in parts: one side is cut by hash, the other repeated for each part. Every
    such pair is returned; ``alike_classes`` says the same without pairs."""
    rows, group = _digests(values, scope)
    parts = F.ceil(F.col("g._n") / F.lit(CLASS_ROWS)).cast("int")
    meeting = rows.alias("r").join(_several(rows, group).alias("g"), _same("r", "g", group)).select("r.*", parts.alias("_parts"))
    a = meeting.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).alias("a")
    b = meeting.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("b")
    return a.join(b, [*_same("a", "b", group), F.col("a._part") == F.col("b._part"), F.col("a.id") < F.col("b.id"), F.col("a._raw") != F.col("b._raw")]).select("a.fld", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def alike_classes(values: DataFrame, scope: list[str]) -> DataFrame:
    """``(fld, id, class_id, n_links)``: every row that ``alike_pairs`` would pair, with the smallest id of its
    class and the number of its partners, from counts alone."""
    rows, group = _digests(values, scope)
    own = rows.groupBy(*group, "_raw").agg(F.count(F.lit(1)).alias("_own"))
    sized = own.alias("o").join(_several(rows, group).alias("g"), _same("o", "g", group)).select("o.*", "_first", (F.col("_n") - F.col("_own")).alias("n_links"))
    met = rows.alias("r").join(sized.alias("z"), [*_same("r", "z", group), F.col("r._raw") == F.col("z._raw")])
    return met.select("r.fld", "r.id", F.col("_first").alias("class_id"), "n_links").distinct()


def _fields(spark, root: str) -> DataFrame:
    revisions = spark.read.parquet(f"{root}/revisions.parquet").filter("chunk_id is not null")
    notes = spark.read.parquet(f"{root}/note_candidates.parquet")
    return (
        revisions.select(F.lit("revisions.content").alias("fld"), F.col("seq").alias("id"), "book_id", "chunk_id", F.col("content").alias("_value"))
        .unionByName(notes.select(F.lit("note_candidates.translation").alias("fld"), F.col("cand_id").alias("id"), "book_id", F.lit(None).cast("string").alias("chunk_id"), F.col("translation").alias("_value")))
        .unionByName(notes.select(F.lit("note_candidates.probe").alias("fld"), F.col("cand_id").alias("id"), "book_id", F.lit(None).cast("string").alias("chunk_id"), F.col("probe").alias("_value")))
    )


def p1_found(spark, root: str) -> DataFrame:
    return alike_pairs(_fields(spark, root), ["book_id", "chunk_id"])


def p1_classes(spark, root: str) -> DataFrame:
    return alike_classes(_fields(spark, root), ["book_id", "chunk_id"])


def p1_changed(spark, root: str) -> DataFrame:
    """Every value that has another canonical form, with that form."""
    values = _fields(spark, root).select(F.struct("fld", "id").alias("at"), F.col("_value").alias("value"))
    return canonical_column(values, "at", "value").filter("changed").select("at.fld", "at.id", "value").distinct()


