from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimp.plans import pipeline as P
from palimp.streaming import ingest


def inputs(spark):
    return spark.createDataFrame([(1, "c1", 1, "one"), (1, "c2", 1, "two"), (1, "c3", 2, "three"), (1, "c4", 1, None)], "book_id bigint, chunk_id string, n_expected int, source string")


def ask(system, user):
    if "three" in user and "previous" not in user:
        return "===PARAGRAPH 1===\nonly"
    if "two" in user:
        return "no marker"
    n = 2 if "three" in user else 1
    return "\n".join(f"===PARAGRAPH {i + 1}===\nt" for i in range(n))


def test_stage(spark):
    empty = spark.createDataFrame([], "key string")
    made, outcomes = P.run_stage(inputs(spark), empty, P.callable_source(ask), "translate", "m", "v1", "sys", "Translate: {{ source }}")
    assert {(r["chunk_id"], r["outcome"]) for r in outcomes.collect()} == {("c1", "new"), ("c2", "failed"), ("c3", "retried")}
    assert {r["chunk_id"] for r in made.collect()} == {"c1", "c3"}
    again, second = P.run_stage(inputs(spark), made, P.callable_source(ask), "translate", "m", "v1", "sys", "Translate: {{ source }}")
    assert {(r["chunk_id"], r["outcome"]) for r in second.collect()} == {("c1", "cached"), ("c2", "failed"), ("c3", "cached")} and again.count() == 0
    replies = made.withColumn("finish_reason", F.lit(None).cast("string"))
    table, third = P.run_stage(inputs(spark), empty, P.table_source(replies), "translate", "m", "v1", "sys", "Translate: {{ source }}")
    assert {(r["chunk_id"], r["outcome"]) for r in third.collect()} == {("c1", "new"), ("c2", "failed"), ("c3", "new")}


def test_broken_replies(spark):
    empty = spark.createDataFrame([], "key string")
    prompt = ("translate", "m", "v1", "sys", "Translate: {{ source }}")
    run = P.run_checked(inputs(spark), empty, P.callable_source(ask), *prompt)
    rejects = {r["chunk_id"]: (r["error"], r["reply"], r["retry_reply"]) for r in run.rejects.collect()}
    assert rejects == {"c2": ("no paragraph markers", "no marker", "no marker")}
    assert {(r["outcome"], r["n"]) for r in P.run_stats(run.outcomes).collect()} == {("new", 1), ("retried", 1), ("failed", 1)}
    broken = run.made.withColumn("content", F.lit("===PARAGRAPH 1===\n<p>open"))
    second = P.run_checked(inputs(spark), broken, P.callable_source(ask), *prompt)
    assert {(r["chunk_id"], r["outcome"]) for r in second.outcomes.collect()} == {("c1", "cached_broken"), ("c2", "failed"), ("c3", "cached_broken")}
    many = spark.createDataFrame([(1, f"c{i}", 1, f"t{i}") for i in range(50)], "book_id bigint, chunk_id string, n_expected int, source string")
    mended = P.run_checked(many, empty, P.callable_source(lambda s, u: "===PARAGRAPH 1===\nt" if "not usable: no paragraph markers" in u else "bad"), *prompt)
    assert {(r["outcome"], r["n"]) for r in P.run_stats(mended.outcomes).collect()} == {("retried", 5), ("failed", 45)} and mended.rejects.filter("retry_reply is null").count() == 45
    judged = P.run_judge(inputs(spark), empty, P.callable_source(lambda s, u: '{"score": 4, "issues": []}' if "valid JSON only" in u or "one" in u else '{"score": 9}'), "m", "v1", "sys", "Judge: {{ source }}")
    assert {(r["chunk_id"], r["outcome"]) for r in judged.outcomes.collect()} == {("c1", "new"), ("c2", "retried"), ("c3", "retried")}


def test_prompts(spark):
    held = P.load_prompt("---\nversion: '2'\ntemperature: 0.3\nmax_tokens: 900\nother: x\n---\n# User\nDo.")
    assert held == P.Prompt("", "Do.", "2", 0.3, 900, None)
    assert P.sections("---\nversion: 1\n---\n# System\nBe good.\n# User\nDo {{ x }}.") == ("Be good.", "Do {{ x }}.") and P.sections("plain") == ("", "plain")
    with pytest.raises(KeyError):
        P.render("{{ missing }}", inputs(spark), "p")


def test_stream(spark, tmp_path):
    rows = [(s, k, st, datetime(2025, 1, 1, s % 5), t) for s, k, st, t in [(1, "a", "translate", 3), (2, "b", "style", None), (3, "a", "translate", 5), (3, "a", "translate", 5), (4, None, "judge", 1)]]
    df = spark.createDataFrame(rows, "seq bigint, key string, stage string, created_at timestamp, output_tokens bigint")
    place = str(tmp_path / "in")
    df.filter("seq < 3").coalesce(1).write.parquet(place)
    latest, checkpoint = str(tmp_path / "latest"), str(tmp_path / "checkpoint")
    for more in (None, "seq >= 3"):
        if more:
            df.filter(more).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(df.schema).parquet(place)
        ingest.keep_latest(stream, latest, checkpoint).awaitTermination(120)
    assert {(r["key"], r["seq"]) for r in ingest.latest(spark, latest).collect()} == {("a", 3), ("b", 2)}
    ingest.compact(spark, latest)
    assert {(r["key"], r["seq"]) for r in spark.read.parquet(latest).collect()} == {("a", 3), ("b", 2)}
    df.filter("seq >= 3").withColumn("seq", F.col("seq") + 10).coalesce(1).write.mode("append").parquet(place)
    ingest.keep_latest(spark.readStream.schema(df.schema).parquet(place), latest, checkpoint).awaitTermination(120)
    assert {(r["key"], r["seq"]) for r in ingest.latest(spark, latest).collect()} == {("a", 13), ("b", 2)}
    stream = spark.readStream.schema(df.schema).parquet(place)
    query = ingest.stage_activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in ingest.stage_activity(spark.read.parquet(place)).collect()}
    assert {tuple(r) for r in spark.table("activity").collect()} == want and len(want) == 4
