"""The staged pipeline over many books: requests by content hash, replies from a pluggable source,
validation, one more ask, append-only output."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.functions.text import content_key, split_markers
from palimp.functions.udfs import first_malformed, parse_replies
from palimp.plans.durable import durable
from palimp.plans.ranking import running_total

REPLY = "key string, content string, finish_reason string, input_tokens bigint, output_tokens bigint"
#: Takes requests (key, system, user) and gives replies (``REPLY``); a missing row is a failed request.
Source = Callable[[DataFrame], DataFrame]


def table_source(replies: DataFrame) -> Source:
    """Replies that are already in a table, joined by key."""
    held = replies.select(*[c.split()[0] for c in REPLY.split(", ")]).dropDuplicates(["key"])
    return lambda requests: requests.select("key").join(held, "key")


def callable_source(ask: Callable[[str, str], str], slots: int | None = None) -> Source:
    """Replies of a function (system, user) -> text that runs on the workers, at most ``slots`` at once.
    A call that raises gives no reply."""

    def run(frames):
        for frame in frames:
            out = []
            for key, system, user in zip(frame["key"], frame["system"], frame["user"]):
                try:
                    out.append((key, ask(system, user), None, None, None))
                except Exception:  # noqa: BLE001 - whatever the provider raises, the request has failed
                    continue
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    def source(requests: DataFrame) -> DataFrame:
        asked = requests.select("key", "system", "user")
        return (asked.repartition(slots) if slots else asked).mapInPandas(run, REPLY)

    return source


def render(prompt: str, inputs: DataFrame, to: str) -> DataFrame:
    """Adds ``to``: the template with each ``{{ name }}`` replaced by the column of that name. A name that
    is no column is an error, as is a null value (the row's prompt is then null and never asked)."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", prompt)
    missing = set(parts[1::2]) - set(inputs.columns)
    if missing:
        raise KeyError(f"no such input: {', '.join(sorted(missing))}")
    columns = [F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return inputs.withColumn(to, F.concat(*columns))


class Prompt(NamedTuple):
    system: str
    user: str
    version: str | None = None
    temperature: float | None = None
    max_tokens: int | None = None
    reasoning_effort: str | None = None


def load_prompt(text: str) -> Prompt:
    """A prompt file: settings in front matter between ``---`` lines, then parts under ``# System`` and
    ``# User``; without these headings all of it is the user part. Other settings are ignored."""
    front, body = "", text
    if text.startswith("---\n") and (end := text.find("\n---\n", 3)) >= 0:
        front, body = text[4 : end + 1], text[end + 5 :]
    values = dict(re.findall(r"(?m)^(\w+):[ \t]*(.*?)[ \t]*$", front))
    number = lambda name, kind: kind(values[name]) if values.get(name) else None
    named: dict[str, list[str]] = {}
    part = None
    for line in body.split("\n"):
        if found := re.fullmatch(r"#\s*(System|User)\s*", line):
            part = named.setdefault(found[1], [])
        elif part is not None:
            part.append(line)
    system, user = ("\n".join(named.get(k, [])).strip() for k in ("System", "User"))
    return Prompt(system, user if named else body.strip(), values.get("version", "").strip("\"'") or None, number("temperature", float), number("max_tokens", int), values.get("reasoning_effort") or None)


def sections(prompt: str) -> tuple[str, str]:
    """The system and user parts of a prompt file."""
    return load_prompt(prompt)[:2]


def requests_for(inputs: DataFrame, stage: str, model: str, version: str, system: str, user: str) -> DataFrame:
    rendered = render(user, render(system, inputs, "system"), "user").filter("system is not null and user is not null")
    return rendered.withColumn("key", content_key(F.lit(stage), F.lit(model), F.lit(version), F.col("system"), F.col("user")))


#: What is asked again, behind the first request; ``{{ error }}`` says why.
PARAGRAPHS_NOTE = "\n\nYour previous reply was not usable: {{ error }}. Answer again with every paragraph, each of them closed, and nothing else."
VERDICT_NOTE = "\n\nYour previous reply was not usable: {{ error }}. Give the same verdict again, as valid JSON only."


def checked(df: DataFrame, content: str, n_expected: str = "n_expected") -> DataFrame:
    """Adds ``error``: empty for a reply of the expected number of marked paragraphs, all well formed; else what
    is wrong, naming the first bad paragraph. A null reply is ``no reply``."""
    cut = first_malformed(df.withColumn("_ps", split_markers(F.col(content))), "_ps", "_bad")
    n, expected = F.size("_ps"), F.col(n_expected)
    error = (
        F.when(F.col(content).isNull(), "no reply")
        .when(F.col("_ps").isNull(), "no paragraph markers")
        .when(~n.eqNullSafe(expected), F.concat(F.lit("expected "), F.coalesce(expected.cast("string"), F.lit("?")), F.lit(" paragraphs, got "), n.cast("string")))
        .when(F.col("_bad") > 0, F.concat(F.lit("paragraph "), F.col("_bad").cast("string"), F.lit(" is not well formed")))
        .otherwise("")
    )
    return cut.withColumn("error", error).drop("_ps", "_bad")


def checked_verdict(df: DataFrame, content: str) -> DataFrame:
    """Adds ``error``: empty for a verdict with a score from 1 to 5. ``df`` has a unique ``key``."""
    read = parse_replies(df, "key", content)
    error = F.when(F.col(content).isNull(), "no reply").when(F.col("ok"), "").when(F.col("score").isNotNull(), F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(" is not 1 to 5"))).otherwise("no readable verdict")
    return df.join(read, "key").withColumn("error", error).drop("ok", "score", "n_issues")


class StageRun(NamedTuple):
    """``made``: new revisions; ``outcomes``: one per input, with the tokens paid; ``rejects``: replies that were
    of no use, with why, so that what was paid for is not lost."""

    made: DataFrame
    outcomes: DataFrame
    rejects: DataFrame


def run_checked(inputs: DataFrame, revisions: DataFrame, source: Source, stage: str, model: str, version: str, system: str, user: str, check: Callable[[DataFrame, str], DataFrame] = checked, note: str = PARAGRAPHS_NOTE) -> StageRun:
    """One stage. ``inputs`` has ``(book_id, chunk_id, n_expected, …)`` and what the templates name.

    Keys already in ``revisions`` are not asked: their stored reply is checked, and one that fails is
    ``cached_broken``, never asked anew. A reply that ``check`` finds fault with is asked for once more,
    with the fault named, as long as the budget of the run lasts (a tenth of the inputs, at least 3; which
    of more rejected keys are asked again is decided by hash). Outcome per input: ``cached``,
    ``cached_broken``, ``new``, ``retried`` or ``failed``."""
    order = [c for c in ("created_at", "seq") if c in revisions.columns] or ["key"]
    content = F.col("content") if "content" in revisions.columns else F.lit(None).cast("string")
    known = revisions.filter("key is not null").groupBy("key").agg(F.max_by(F.struct(content.alias("_held")), F.struct(*order)).alias("_r"))
    asked = durable(requests_for(inputs, stage, model, version, system, user).join(known, "key", "left").withColumn("_held", F.col("_r._held")).withColumn("_hit", F.col("_r").isNotNull()).drop("_r"))
    hits = check(asked.filter("_hit"), "_held").select("book_id", "chunk_id", "key", F.when(F.col("error") == "", "cached").otherwise("cached_broken").alias("outcome"))
    misses = asked.filter("not _hit").drop("_held", "_hit")
    paid = ["content", "finish_reason", "input_tokens", "output_tokens"]
    first = durable(check(misses.join(source(misses), "key", "left"), "content"))
    bad = first.filter("error <> ''").select("key", "error", F.xxhash64("key").alias("_h"))
    budget = max(3, asked.count() // 10)
    ranked = running_total(bad.withColumn("_one", F.lit(1)), ["_one"], F.pmod("_h", F.lit(4096)), [F.col("_h"), F.col("key")], F.lit(1), "_n")
    again = misses.join(ranked.filter(F.col("_n") < budget).select("key", "error"), "key").withColumn("user", F.concat("user", _filled(note))).drop("error")
    second = durable(check(again.join(source(again), "key", "left"), "content"))

    old = first.filter("error <> ''").select("key", *[F.col(c).alias(f"_1{c}") for c in (*paid, "error")])
    retried = second.join(old, "key")
    both = lambda c: F.coalesce(F.col(f"_1{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
    fine = first.filter("error = ''").withColumn("outcome", F.lit("new")).select("book_id", "chunk_id", "key", "outcome", "content", "input_tokens", "output_tokens")
    mended = retried.filter("error = ''").select("book_id", "chunk_id", "key", F.lit("retried").alias("outcome"), "content", both("input_tokens").alias("input_tokens"), both("output_tokens").alias("output_tokens"))
    kept = fine.unionByName(mended)
    lost = first.filter("error <> ''").select("book_id", "chunk_id", "key", *[F.col(c).alias(f"_1{c}") for c in (*paid, "error")]).join(second.select("key", F.col("error").alias("_2error"), *[F.col(c).alias(f"_2{c}") for c in paid]), "key", "left").filter("_2error is null or _2error <> ''")
    either = lambda c: F.coalesce(F.col(f"_1{c}"), F.lit(0)) + F.coalesce(F.col(f"_2{c}"), F.lit(0))
    named = [F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version")]
    rejects = lost.select("book_id", "chunk_id", "key", *named, F.coalesce("_2error", "_1error").alias("error"), F.coalesce("_2finish_reason", "_1finish_reason").alias("finish_reason"), F.col("_1content").alias("reply"), F.col("_2content").alias("retry_reply"))
    failed = lost.select("book_id", "chunk_id", "key", F.lit("failed").alias("outcome"), either("input_tokens").alias("input_tokens"), either("output_tokens").alias("output_tokens"))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")]
    outcomes = hits.select("*", *nothing).unionByName(kept.drop("content")).unionByName(failed)
    return StageRun(kept.select("book_id", "chunk_id", "key", *named, "input_tokens", "output_tokens", "content"), outcomes, rejects)


def run_judge(inputs: DataFrame, revisions: DataFrame, source: Source, model: str, version: str, system: str, user: str) -> StageRun:
    """``run_checked`` for verdicts: what is asked again is the same verdict as valid JSON."""
    return run_checked(inputs, revisions, source, "judge", model, version, system, user, lambda df, c: checked_verdict(df, c), VERDICT_NOTE)


def run_stage(inputs: DataFrame, revisions: DataFrame, source: Source, stage: str, model: str, version: str, system: str, user: str) -> tuple[DataFrame, DataFrame]:
    """(new revisions, outcomes per input) of ``run_checked``."""
    made, outcomes, _ = run_checked(inputs, revisions, source, stage, model, version, system, user)
    return made, outcomes.select("book_id", "chunk_id", "key", "outcome")


def run_stats(outcomes: DataFrame) -> DataFrame:
    """What a run did, per outcome: inputs and tokens paid. Counted from the outcomes, so that a task that ran
    twice counts once."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def _filled(note: str) -> Column:
    parts = re.split(r"\{\{\s*error\s*\}\}", note)
    return F.concat(*[x for i, part in enumerate(parts) for x in ((F.col("error"), F.lit(part)) if i else (F.lit(part),))])
