"""Values that were cut off (problem 4)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.language import WORD, fold
from palimp.plans.durable import durable, spread

MARKER = regex.compile(r"^[ \t]*===[ \t]*PARAGRAPH[ \t]+(\d+)[ \t]*===[ \t]*$", regex.M | regex.I)
FENCE = regex.compile(r"^[ \t]*```[\w-]*[ \t]*$", regex.M)
#: A note about the cut that stands behind a cut value.
CUT_NOTE = regex.compile(
    r"(?:\.{3}|…)?\s*[\[(<{]\s*(?:…|\.{3})?\s*(?:\+?\s*\d+\s*(?:more\s+)?(?:chars?|characters?|bytes?|tokens?|words?)|(?:output\s+|text\s+)?(?:truncated|cut(?:\s*off)?|clipped|snip(?:ped)?)|to be continued|continued)[^\])>}]{0,40}[\])>}]\s*$",
    regex.I,
)
TERMINATORS = ".!?…。！？"
CLOSERS = "»”“\"'’)]}*_›‹`"
PAIRS = {"«": "»", "„": "“", "“": "”", "(": ")"}
LIST_LINE = regex.compile(r"^[ \t]*(?:[-*•–]|\d+[.)])[ \t]+\S")
TAG = regex.compile(r"<(/?)([A-Za-z][\w:-]*)[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "wbr"}
OPEN_END = regex.compile(r"(?:<[^<>]*|&[#\w]{0,8}|\\u?[0-9a-fA-F]{0,3})$")
#: Without a passage to compare, endings are told apart by the kind of the last line; one of at most this many
#: words is of another kind than longer ones. Whether its kind may end bare, the source's baseline says.
SHORT_WORDS = 5
#: A kind of ending is judged by its own source if that has so many of it, else by all sources; a kind that
#: all sources together lack is judged by ``EXPECTED``. It may end bare if at least this share of it does.
LEAST_SEEN, MAY_END_BARE = 30, 0.5
#: Kinds of endings: what the last paragraph answers, or what the last line looks like.
ANSWERS_BARE, ANSWERS_ENDED, LIST, SHORT, LINE = "answers bare", "answers ended", "list", "short", "line"
EXPECTED = {ANSWERS_BARE: True, ANSWERS_ENDED: False, LIST: True, SHORT: True, LINE: False}
EXPECTED_OF_REASONING = EXPECTED | {SHORT: False}
#: A proofreader's full answer that nothing changes.
NO_CHANGES = regex.compile(r"^[`\s]*(?:no[_ ]?changes?|\[\s*\])[`.\s]*$", regex.I)
TAGS = regex.compile(r"<[^<>]*>|```[\w-]*")
#: Stages whose answer is a translation; one with this share of its word pairs in the passage or prompt
#: gives them back instead.
COPY_STAGES, COPY_SHARE = ["translate", "reflect"], 0.5
WHOLE, CUT, BARE, ENDED = "whole", "cut", "bare", "ended"


def open_json(body: str) -> bool:
    """Whether a string, list or object is still open at the end: a stack automaton."""
    stack, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append(c)
        elif c in "]}" and stack:
            stack.pop()
    return quoted or bool(stack)


def open_tags(body: str) -> bool:
    stack = []
    for close, name, empty in TAG.findall(body):
        name = name.lower()
        if close:
            if name in stack:
                while stack.pop() != name:
                    pass
        elif not empty and name not in VOID:
            stack.append(name)
    return bool(stack)


def open_quote(body: str) -> bool:
    """Whether a quotation or bracket opened in this paragraph stays open. A German quotation closes
    with the mark that opens an English one."""
    stack = []
    for c in body:
        if c == "“" and stack and stack[-1] == "“" and "„" in body:
            stack.pop()
        elif stack and c == stack[-1]:
            stack.pop()
        elif c in PAIRS:
            stack.append(PAIRS[c])
    return bool(stack)


def completeness(text: str | None, reasoning: bool = False) -> tuple[str, int, str]:
    """(state, number of the last paragraph, its text or last line).

    ``whole`` and ``cut`` follow from the structure. Else the last paragraph is prose: ``ended`` by a
    terminator, or ``bare``, as a heading or a list is; whether it was cut depends on what its kind of
    ending is like. Null and blank values are whole."""
    if text is None or not (body := text.rstrip()):
        return WHOLE, 0, ""
    if "�" == body[-1] or CUT_NOTE.search(body):
        return CUT, 0, ""
    if body.count("```") % 2:
        return CUT, 0, ""
    if body.endswith("```"):
        body = body[:-3].rstrip()
    start = FENCE.sub("", body, 1).lstrip() if body.startswith("```") else body
    if len(start) < 40 and NO_CHANGES.match(start):
        return WHOLE, 0, ""
    if start[:1] in "[{" and not reasoning:
        return (CUT if open_json(start) else WHOLE), 0, ""
    markers = list(MARKER.finditer(body))
    last = body[markers[-1].end() :].strip() if markers else body
    number = int(markers[-1][1]) if markers else 0
    if not last:
        return WHOLE, number, ""
    line = last.rsplit("\n", 1)[-1].strip()
    if line.startswith("=") and not MARKER.match(line):
        return CUT, number, ""
    if not markers and not reasoning:
        last = last.rsplit("\n\n", 1)[-1].strip() if "\n\n" in last else line
    if OPEN_END.search(line) and line[-1] not in "0123456789 " or open_tags(last):
        return CUT, number, last
    plain = TAG.sub("", last).strip()
    if not any(c.isalnum() for c in plain):
        return WHOLE, number, plain
    ends = ends_bare(plain)
    if not ends and open_quote(plain.rsplit("\n", 1)[-1]):
        return CUT, number, plain
    if ends and plain[-1] in ",;-–—" or (reasoning and ends and plain[-1] == ":"):
        return CUT, number, plain
    return (BARE if ends else ENDED), number, line if reasoning else plain


def ends_bare(paragraph: str) -> bool:
    """Whether a paragraph, tags aside, ends without a terminator: a heading, a list line, a number."""
    bare = TAG.sub("", fold(paragraph)).rstrip().rstrip(CLOSERS + "\xa0 ")
    return not bare or bare[-1] not in TERMINATORS


def kind_of(number: int, plain: str, source: list[str]) -> str:
    """The kind of an ending: by the paragraph of the passage it answers, if there is one, else by its look."""
    answered = source[number - 1] if 0 < number <= len(source) else source[-1] if source and not number else None
    if answered is not None:
        return ANSWERS_BARE if ends_bare(answered) else ANSWERS_ENDED
    if LIST_LINE.match(plain):
        return LIST
    return SHORT if len(plain.split()) <= SHORT_WORDS and plain[:1].isupper() and plain[-1] != ":" else LINE


def ending(text: str | None, passage: Callable[[], list[str]] | None = None, reasoning: bool = False) -> tuple[str, str | None]:
    """(state, kind): ``completeness`` and, of prose, the kind of its ending."""
    state, number, plain = completeness(fold(text) if text else text, reasoning)
    return state, kind_of(number, plain, passage() if passage else []) if state in (BARE, ENDED) else None


def was_cut(text: str | None, passage: Callable[[], list[str]] | None = None, reasoning: bool = False) -> bool:
    """Whether a single value was cut off, its source being unknown."""
    state, kind = ending(text, passage, reasoning)
    return state == CUT or (state == BARE and not (EXPECTED_OF_REASONING if reasoning else EXPECTED)[kind])


def prompt_passage(prompt: str | None) -> list[str]:
    """The marked paragraphs of a prompt, in order."""
    parts = MARKER.split(prompt or "")
    return [p.strip() for p in parts[2::2]]


def bare(text: str) -> str:
    """The text without marker lines, tags and code fences."""
    return TAGS.sub(" ", MARKER.sub("", text)) if "<" in text or "=" in text or "`" in text else text


def _pairs(text: str) -> set:
    words = [w.lower() for w in WORD.findall(text)]
    words = [w for w in words if w != "paragraph"]
    return set(zip(words, words[1:])) or {(w,) for w in words}


def is_copy(text: str, given: list[str]) -> bool:
    own = _pairs(bare(text))
    theirs = set().union(*(_pairs(bare(fold(g))) for g in given)) if given else set()
    if own and all(len(p) == 1 for p in own):
        theirs |= {(w,) for p in theirs for w in p}
    return bool(own) and len(own & theirs) >= COPY_SHARE * len(own)


def baseline(endings: DataFrame) -> DataFrame:
    """``(provider, fld, kind, n, n_bare, may_end_bare)``: how often the endings of each kind lack a terminator in
    each source, from ``(provider, fld, state, kind)``, one row per value. Kinds that a source has fewer
    than ``LEAST_SEEN`` of are judged by all sources. A row per source, field and kind; few."""
    seen = endings.filter(F.col("state").isin(BARE, ENDED)).groupBy("provider", "fld", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == BARE).alias("n_bare"))
    every = seen.groupBy("fld", "kind").agg(F.sum("n").alias("_n"), F.sum("n_bare").alias("_bare"))
    joined = seen.join(every, ["fld", "kind"])
    own, pooled = F.col("n_bare") / F.col("n"), F.col("_bare") / F.col("_n")
    held = lambda expected: F.col("kind").isin([k for k, v in expected.items() if v])
    listed = F.when(F.col("fld") == "reasoning", held(EXPECTED_OF_REASONING)).otherwise(held(EXPECTED))
    may = F.when(F.col("n") >= LEAST_SEEN, own >= MAY_END_BARE).when(F.col("_n") >= LEAST_SEEN, pooled >= MAY_END_BARE).otherwise(listed)
    return joined.select("provider", "fld", "kind", "n", "n_bare", may.alias("may_end_bare"))


def decided(endings: DataFrame) -> DataFrame:
    """Adds ``is_cut`` to written endings: cut by structure, or bare where the source's baseline for the kind
    expects a terminator."""
    known = baseline(endings).select(F.col("provider").alias("_p"), F.col("fld").alias("_f"), F.col("kind").alias("_k"), "may_end_bare")
    on = [F.col("provider").eqNullSafe(F.col("_p")), F.col("fld") == F.col("_f"), F.col("kind") == F.col("_k")]
    cut = (F.col("state") == CUT) | ((F.col("state") == BARE) & ~F.coalesce("may_end_bare", F.lit(False)))
    return endings.join(known, on, "left").withColumn("is_cut", cut).drop("_p", "_f", "_k", "may_end_bare")


def endings_of(df: DataFrame) -> DataFrame:
    """``(completion_id, provider, fld, state, kind)`` of every non-blank ``text`` and ``reasoning``, each once,
    written: the rates of a source are taken from it before any value is decided."""
    named = df.select("completion_id", "provider", "user_prompt", "text", "reasoning", "stage").filter("text is not null or reasoning is not null")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, provider, prompt, text, reason, stage in zip(*(c.to_pylist() for c in batch.columns)):
                for fld, value in (("text", text), ("reasoning", reason)):
                    if value and value.strip():
                        state, kind = ending(value, (lambda p=prompt: prompt_passage(p)) if fld == "text" else None, fld == "reasoning")
                        if state in (CUT, BARE) and fld == "text" and stage in COPY_STAGES and prompt and is_copy(fold(value), [prompt]):
                            state, kind = WHOLE, None
                        for column, x in zip(out, (i, provider, fld, state, kind)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], names=["completion_id", "provider", "fld", "state", "kind"])

    return durable(spread(named).mapInArrow(run, "completion_id bigint, provider string, fld string, state string, kind string").distinct())


def find_cut(df: DataFrame) -> DataFrame:
    """``(completion_id, provider, fld, is_cut)`` for every non-blank ``text`` and ``reasoning``.

    Whatever ``finish_reason`` says, a value counts as cut if a string, list, tag, fence, marker or
    quotation stays open, if it ends in a broken character or behind a comma or dash, or if it ends without
    a terminator where its source's baseline for such endings expects one: endings are told apart by
    whether the paragraph of ``user_prompt`` they answer has a terminator or, without one, by the look of
    their last line. A translation that gives back its passage, altered at the end, is a copy and not cut:
    what it lacks was not cut off. Null and blank values give no row; repeated rows count once; a null id
    or provider is kept as null; other columns are ignored."""
    return decided(endings_of(df)).select("completion_id", "provider", "fld", "is_cut").distinct()


def cut_rates(found: DataFrame) -> DataFrame:
    """Per provider and field: values, cut values and their share."""
    return found.groupBy("provider", "fld").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("is_cut").alias("n_cut")).withColumn("cut_rate", F.col("n_cut") / F.col("n_values"))


def p4_found(spark, root: str) -> DataFrame:
    return find_cut(spark.read.parquet(f"{root}/completions.parquet")).filter("is_cut").select("completion_id", "fld")


def p4_rates(spark, root: str) -> DataFrame:
    return cut_rates(find_cut(spark.read.parquet(f"{root}/completions.parquet")))




def p4_baseline(spark, root: str) -> DataFrame:
    """How often endings of each kind lack a terminator, by provider and field, and whether they may."""
    return baseline(endings_of(spark.read.parquet(f"{root}/completions.parquet")))
