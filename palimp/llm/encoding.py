"""Finding and undoing wrong character decodings (problem 8)."""

from __future__ import annotations

from functools import lru_cache
from math import inf, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.plans.durable import spread

#: Encoding pairs: what the text was written in, what it was read as. One hidden state each.
MULTI_BYTE = ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp1250", "cp850", "koi8-r", "cp866"]
SINGLE_BYTE = [
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("cp1251", "mac_roman"), ("cp1251", "cp866"), ("koi8-u", "cp1251"), ("cp1251", "koi8-u"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp1250"),
    ("iso8859-5", "cp1251"), ("iso8859-5", "cp1252"), ("cp1251", "iso8859-5"), ("cp866", "latin-1"),
]
#: Log cost of entering a garbled span, by kind of pair; leaving is free.
ENTER_MULTI, ENTER_SINGLE = 4.0, 14.0
#: Further log cost of changing state inside a word, for single-byte pairs.
INSIDE_WORD = 6.0
#: Log gain, below 0, of a sequence that decodes to a character unknown to the model.
STRANGER = -6.0
#: A single-byte span counts if its changed words gain so much over the clean reading.
WORDS_GAIN = ENTER_SINGLE
FLOOR = -13.0
CASE_BREAK, SCRIPT_BREAK = -4.0, -5.0
MEMORY_TOKENS = 100_000
LOST = "�"
#: Characters that clean text of these languages is made of; tokens with others don't train the model.
EXPECTED = regex.compile(r"[\x20-\x7e\n\tа-яА-ЯёЁіїєґІЇЄҐÀàÂâÇçÉéÈèÊêËëÎîÏïÔôÛûÙùŒœÄäÖöÜüßÁáÍíÓóÚúÑñ¿¡«»“”„‘’…—–→€©№]+")

#: A word in which a changed letter has another beside it.
WORD = regex.compile(r"\p{L}{2,}")


@lru_cache(maxsize=None)
def _bytes_of(read_as: str) -> dict[str, int]:
    """Character -> byte of a code page; where a Windows page leaves a byte open, its control character."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(read_as)] = b
        except UnicodeDecodeError:
            if read_as.startswith("cp125"):
                out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _single(pair: tuple[str, str]) -> dict[str, str]:
    """Character as seen -> as written; with those that both pages have in one place, as a span runs on over them."""
    out = {}
    for char, b in _bytes_of(pair[1]).items():
        try:
            out[char] = bytes([b]).decode(pair[0])
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _sequences(read_as: str):
    """A pattern of the multi-byte sequences as this code page shows them."""
    chars = {b: regex.escape(c) for c, b in _bytes_of(read_as).items()}

    def some(lo: int, hi: int) -> str:
        return "[" + "".join(chars[b] for b in range(lo, hi + 1) if b in chars) + "]"

    later = some(0x80, 0xBF)
    return regex.compile(f"{some(0xC2, 0xDF)}{later}|{some(0xE0, 0xEF)}{later}{{2}}|{some(0xF0, 0xF4)}{later}{{3}}")


def _decode(read_as: str, seen: str) -> str | None:
    table = _bytes_of(read_as)
    try:
        return bytes(table[c] for c in seen).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(maxsize=1)
def _codes() -> tuple[str, np.ndarray]:
    """The letters of the model, case folded, a blank first; and character -> place in them, 0 for all others."""
    clean = [chr(c) for c in range(1 << 16) if EXPECTED.fullmatch(chr(c)) and not chr(c).isspace()]
    letters = " " + "".join(sorted({c.lower() for c in clean}))
    table = np.zeros((1 << 16) + 1, np.uint16)
    for c in clean:
        table[ord(c)] = 1 + letters.index(c.lower())
    for c in range(1 << 16):
        if chr(c).isspace():
            table[c] = 1
    return letters, table


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each letter of the model stands before each, in tokens wholly of expected characters and at
    their ends. One look-up per character; every character of every text counts."""
    letters, table = _codes()
    n = len(letters) + 1
    seen = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[np.minimum(seen, 1 << 16)].astype(np.int64)
    inside = codes != 1
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if len(starts):
        token = np.cumsum(np.bincount(starts, minlength=len(codes))) - 1
        odd = np.bincount(token[codes == 0], minlength=len(starts)) > 0
        codes[inside & odd[np.maximum(token, 0)]] = 0
    a, b = codes[:-1], codes[1:]
    held = (a > 0) & (b > 0) & ~((a == 1) & (b == 1))
    return np.bincount(a[held] * n + b[held], minlength=n * n)


def model_of(counts: dict[int, int]) -> dict[str, float]:
    """Log probabilities of a character after another (case folded), of clean text, from ``pair_counts``."""
    letters, _ = _codes()
    n = len(letters) + 1
    pairs = np.zeros((n, n))
    for at, times in counts.items():
        pairs[divmod(at, n)] = times
    firsts, chars = pairs.sum(1), pairs.sum(0)
    total = chars.sum() or 1.0
    model = {letters[a - 1] + letters[b - 1]: log(0.9 * pairs[a, b] / firsts[a] + 0.1 * chars[b] / total) for a, b in zip(*np.nonzero(pairs))}
    return model | {letters[b - 1]: max(FLOOR, log(0.1 * chars[b] / total)) for b in np.flatnonzero(chars)}


def fit(texts: list[str]) -> dict[str, float]:
    return model_of({int(k): int(v) for k, v in enumerate(pair_counts(texts)) if v})


def fitted(texts: DataFrame, col: str) -> dict[str, float]:
    """``fit`` over a whole column: pairs are counted in every partition, sums by pair of letters are few."""

    def run(batches):
        total = 0
        for batch in batches:
            total = total + pair_counts([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(total) if isinstance(total, np.ndarray) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at] if len(at) else [], pa.int64())], names=["pair", "n"])

    sums = texts.select(col).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return model_of({r["pair"]: r["n"] for r in sums.collect()})  # at most the square of the model's alphabet


class Repairer:
    """The hidden Markov model: one clean state, one state for each encoding pair, and one that emits what a
    decoder put in the place of bytes it could not read."""

    def __init__(self, model: dict[str, float]):
        self.model = model
        self.states = [("utf-8", m) for m in MULTI_BYTE] + SINGLE_BYTE + [("utf-8", LOST)]
        self.lost, self.twice = len(self.states) - 1, _bytes_of("cp1252")
        self.tokens: dict[str, tuple[tuple[int, float], ...]] = {}
        self.pairs: dict[str, float] = {}
        self.singles = [None if s[0] == "utf-8" else {c: c if self.keeps(c, x) else x for c, x in _single(s).items()} for s in self.states]
        self.tables = [None if t is None else str.maketrans(t) for t in self.singles]

    def keeps(self, char: str, x: str) -> bool:
        """A no-break space or a mark of clean text that would become a character unknown to the model
        was set into garbled text later: it stays, in whatever state it is met."""
        return not char.isalpha() and (char == "\xa0" or char in self.model) and x.lower() not in self.model

    def known(self, char: str) -> bool:
        """Whether a decoded character can be meant: the model has it, or it is one of those that twice garbled
        text is first decoded to."""
        return char.lower() in self.model or char in self.twice

    def step(self, last: str, char: str) -> float:
        """The log score of a character after another; remembered, as a text has few different pairs."""
        known = self.pairs.get(last + char)
        if known is None:
            if len(self.pairs) > MEMORY_TOKENS:
                self.pairs.clear()
            known = self.pairs[last + char] = self.score(last, char)
        return known

    def score(self, last: str, char: str) -> float:
        low = char.lower()
        two = self.model.get(last.lower() + low)
        if two is None:
            two = self.model.get(low, FLOOR)
        if char != low and last.islower():
            two += CASE_BREAK
        if (low >= "Ѐ") != (last >= "Ѐ") and "a" <= low < "԰" and "A" <= last < "԰" and low.isalpha() and last.isalpha():
            two += SCRIPT_BREAK
        return two

    def likely(self, token: str) -> float:
        known, step, framed = self.pairs.get, self.step, f" {token} "
        total = 0.0
        for last, c in zip(framed, framed[1:]):
            value = known(last + c)
            total += step(last, c) if value is None else value
        return total

    def read(self, state: int, token: str) -> str:
        """The token as this state would have it."""
        written, read_as = self.states[state]
        if state == self.lost:
            return token
        if written == "utf-8":
            return _sequences(read_as).sub(lambda m: x if (x := _decode(read_as, m[0])) is not None else m[0], token)
        return token.translate(self.tables[state])

    def bounds(self, token: str) -> tuple[tuple[int, float], ...]:
        """(state, the most that any part of the token gains in it), where that is above 0."""
        held = self.tokens.get(token)
        if held is None:
            found = []
            for k, (written, _) in enumerate(self.states):
                if written == "utf-8":
                    if k == self.lost:
                        most = inf if LOST in token else 0.0
                    else:
                        most = self.most_of_sequences(k, token)
                    if most > 0:
                        found.append((k, most))
                elif (most := self.most(k, token)) > 0:
                    found.append((k, most))
            held = tuple(found)
            if len(token) < 64:
                if len(self.tokens) > MEMORY_TOKENS:
                    self.tokens.clear()
                self.tokens[token] = held
        return held

    def most(self, state: int, token: str) -> float:
        """The most that a run of the token's characters gains over the clean reading, entry not paid."""
        table = self.singles[state]
        if token.translate(self.tables[state]) == token:
            return 0.0
        known, step = self.pairs.get, self.step
        most, own, last, was = 0.0, None, " ", " "
        for char in f"{token} ":
            x = table.get(char, char if char < "\x80" else None)
            clean = step(was, char) if (v := known(was + char)) is None else v
            if own is not None:
                left = own + (step(last, char) if (v := known(last + char)) is None else v) - clean
                if left > most:
                    most = left
            if x is None:
                own = None
            else:
                if own is not None:
                    own = left if x == char else own + step(last, x) - clean
                if x != char and (own is None or step(was, x) - clean > own):
                    own = step(was, x) - clean
                last = x
            was = char
        return most

    def most_of_sequences(self, state: int, token: str) -> float:
        """``most`` for a multi-byte state, which stands on whole sequences and, between them, on ASCII."""
        ends = self.sequences(state, token)
        if not ends:
            return 0.0
        step, seen = self.step, f"{token} "
        clean = [step(a, b) for a, b in zip(f" {seen}", seen)]
        own: dict[int, tuple[float, str]] = {}
        most = 0.0
        for i, char in enumerate(seen):
            held = own.get(i)
            if held is not None:
                most = max(most, held[0] + step(held[1], char) - clean[i])
            if i in ends:
                stop, x = ends[i]
                base, last = held if held is not None and held[0] > 0 else (0.0, seen[i - 1] if i else " ")
                gain = base + step(last, x) - sum(clean[i:stop]) + (0.0 if self.known(x) else STRANGER)
            elif held is not None and char < "\x80":
                stop, x, gain = i + 1, char, held[0] + step(held[1], char) - clean[i]
            else:
                continue
            if stop not in own or gain > own[stop][0]:
                own[stop] = (gain, x)
        return most

    def sequences(self, state: int, text: str) -> dict[int, tuple[int, str]]:
        """Where whole sequences of a multi-byte state start, with their ends and what they decode to."""
        read_as = self.states[state][1]
        return {m.start(): (m.end(), x) for m in _sequences(read_as).finditer(text, overlapped=True) if (x := _decode(read_as, m[0])) is not None}

    def active(self, line: str) -> list[int]:
        """The states that the best path of a line can enter. A span must gain more than its entry costs,
        and gains at most what the best parts of the line's tokens do; spaces read the same in every state."""
        gain: dict[int, float] = {}
        for token in line.split(" "):
            if not token.isascii():
                for k, most in self.bounds(token):
                    gain[k] = gain.get(k, 0.0) + most
        states = sorted(k for k, most in gain.items() if most > (ENTER_SINGLE if self.states[k][0] != "utf-8" else ENTER_MULTI))
        if len(states) < 2:
            return states
        chars, read = {c for c in line if c >= "\x80"}, {}
        for k in states:
            table = self.singles[k]
            # one state of those that read the line alike
            read.setdefault(tuple(map(table.get, chars)) if table is not None else k if k == self.lost else tuple(self.sequences(k, line).items()), k)
        return sorted(read.values())

    def label(self, text: str, active: list[int]) -> list[tuple[int, int, int, str]]:
        """Viterbi over the characters: spans (start, end, state, original) outside the clean state.

        A multi-byte state emits a whole sequence as one decoded character; every state scores what it
        decodes with the model of clean text."""
        n = len(text)
        at = [[None] * (len(active) + 1) for _ in range(n + 1)]  # (score, decoded last, from position, from slot, emitted)
        at[0][0] = (0.0, " ", -1, -1, "")
        tables = [self.singles[k] for k in active]
        ends = []
        for k in active:
            written = self.states[k][0]
            if k == self.lost:
                ends.append({i: (i + 1, LOST) for i, c in enumerate(text) if c == LOST})
                continue
            ends.append(self.sequences(k, text) if written == "utf-8" else None)
        cost = [ENTER_MULTI if t is None else ENTER_SINGLE for t in tables]
        step, lost = self.step, self.lost
        single = [False, *(t is not None for t in tables)]
        kinds = [(s, tables[s - 1], ends[s - 1], cost[s - 1], k == lost) for s, k in enumerate(active, 1)]
        for i in range(n):
            row, char = at[i], text[i]
            held = [(s, h[0], h[1]) for s, h in enumerate(row) if h is not None]
            inside = i > 0 and text[i - 1].isalpha() and char.isalpha()
            score, slot = -inf, 0
            for s, total, last in held:
                total += step(last, char) - (INSIDE_WORD if inside and single[s] else 0.0)
                if total > score:
                    score, slot = total, s
            if held and ((now := at[i + 1][0]) is None or score > now[0]):
                at[i + 1][0] = (score, char, i, slot, char)
            for s, table, starts, price, is_lost in kinds:
                own, gain, fresh = row[s], 0.0, True
                if table is not None:
                    x, stop = table.get(char, char if char < "\x80" else None), i + 1
                    if x is None:
                        continue
                    if inside:
                        price += INSIDE_WORD
                    fresh = x != char  # a span starts with a change
                elif i in starts:
                    stop, x = starts[i]
                    gain = 0.0 if is_lost or self.known(x) else STRANGER
                elif own is not None and char < "\x80" and not is_lost:
                    stop, x, fresh = i + 1, char, False
                else:
                    continue
                score, slot = -inf, -1
                # nothing but lost characters is seen in their state, and what follows them is not scored by them
                if fresh:
                    for t, total, last in held:
                        total += (0.0 if is_lost else step(last, x)) - (0.0 if t == s else price)
                        if total > score:
                            score, slot = total, t
                elif own is not None:
                    score, slot = own[0] + step(own[1], x), s
                if slot >= 0 and ((now := at[stop][s]) is None or score + gain > now[0]):
                    at[stop][s] = (score + gain, " " if is_lost else x[-1], i, slot, x)
        spans: list[list] = []
        i, slot = n, max((s for s in range(len(active) + 1) if at[n][s] is not None), key=lambda s: at[n][s][0])
        while i > 0:
            _, _, came, source, x = at[i][slot]
            if slot:
                if spans and spans[-1][0] == i and spans[-1][2] == active[slot - 1]:
                    spans[-1][0], spans[-1][3] = came, x + spans[-1][3]
                else:
                    spans.append([came, i, active[slot - 1], x])
            i, slot = came, source
        return [tuple(s) for s in reversed(spans) if self.counts(text, *s)]

    def counts(self, text: str, start: int, end: int, state: int, original: str) -> bool:
        """Multi-byte spans that change anything; single-byte spans whose words, read whole in the line
        and of two letters at least, gain enough by what is changed in them. Symbols that would become
        letters with no letter beside them speak for nothing, however many stand in a line; words
        that come out as strange as they were speak for an alphabet the model doesn't know."""
        if self.states[state][0] == "utf-8":
            return state == self.lost or text[start:end] != original
        while start and text[start - 1].isalpha():
            start, original = start - 1, text[start - 1] + original
        while end < len(text) and text[end].isalpha():
            end, original = end + 1, original + text[end]
        gain, fitting, strange = 0.0, 0, 0
        for word in WORD.finditer(original):
            seen = text[start + word.start() : start + word.end()]
            if seen == word[0]:
                continue
            if self.fits(seen, word[0]):
                gain += self.likely(word[0]) - self.likely(seen)
                fitting += 1
            else:
                strange += 1
        return gain > WORDS_GAIN and fitting > strange

    def fits(self, seen: str, word: str) -> bool:
        """Whether every pair of letters with a changed one in it is known to the model, in proper case."""
        was, now = f" {seen} ", f" {word} "
        return all((a + b).lower() in self.model and not (a.islower() and b.isupper()) for c, d, a, b in zip(was, was[1:], now, now[1:]) if (c, d) != (a, b))

    def repair(self, text: str | None) -> tuple[bool, str | None, list[str]]:
        """Whether the text holds a wrongly decoded sequence, the text restored as far as it goes, and
        the pairs undone. Twice garbled text is undone as often as a pass still finds spans."""
        if not text or text.isascii():
            return False, text, []
        undone: set[int] = set()
        lines = text.split("\n")
        for n, line in enumerate(lines):
            past: set[str] = set()
            while line not in past and not line.isascii():
                past.add(line)
                active = self.active(line)
                for start, end, state, original in reversed(self.label(line, active) if active else []):
                    line = line[:start] + original + line[end:]
                    undone.add(state)
            lines[n] = line
        pairs = sorted(f"{self.states[k][0]} as {self.states[k][1]}" for k in undone if k != self.lost)
        return bool(undone), "\n".join(lines), pairs


@lru_cache(maxsize=2)
def _repairer(model: tuple) -> Repairer:
    return Repairer(dict(model))


def repair_encoding(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, garbled, restored, pairs, complete)``: one row per input row.

    ``garbled``: the text holds at least one sequence from a wrong decoding, replacement characters
    included; ``restored``: the text with every labelled span put through its state's inverse, else the
    text itself; ``pairs``: the decodings undone; ``complete``: no replacement character is left. Null
    and empty texts are not garbled; other columns are ignored.

    The model of clean text is counted over all rows (garbled text is rare, and made of characters that
    train nothing or little); every row is then labelled, whole."""
    spark = df.sparkSession
    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = spark.sparkContext.broadcast(tuple(sorted(fitted(named, "_text").items())))
    kind = named.schema["_id"].dataType.simpleString()

    def run(batches):
        fix = _repairer(model.value).repair
        for batch in batches:
            out = [fix(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.list_(pa.string())), pa.array([LOST not in (o[1] or "") for o in out], pa.bool_())],
                names=[id_col, "garbled", "restored", "pairs", "complete"],
            )

    return spread(named).mapInArrow(run, f"{id_col} {kind}, garbled boolean, restored string, pairs array<string>, complete boolean")


def p8_repaired(spark, root: str) -> DataFrame:
    return repair_encoding(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")).filter("garbled")


def p8_found(spark, root: str) -> DataFrame:
    return p8_repaired(spark, root).select("doc_id").distinct()


