import os
import shutil

import pytest

from palimp import cli

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")


@pytest.fixture
def store(tmp_path):
    for name in ("revisions", "chunks"):
        shutil.copy(f"{ROOT}/{name}.parquet", tmp_path)
    return str(tmp_path)


def test_status_and_clear(spark, store):
    stats = {r["stage"]: r["n"] for r in cli.main(["status", store], spark).collect()}
    for option in ("--scores", "--grid", "--assembly-map"):
        assert cli.main(["status", store, option], spark).count() > 0
    preview = {r["stage"]: r["n"] for r in cli.main(["clear", store, "style"], spark).collect()}
    assert {r["stage"]: r["n"] for r in cli.main(["status", store], spark).collect()} == stats
    assert {r["stage"]: r["n"] for r in cli.main(["clear", store, "style", "--yes"], spark).collect()} == preview
    left = {r["stage"]: r["n"] for r in cli.main(["status", store], spark).collect()}
    assert "style" not in left and left["translate"] == stats["translate"] and stats["judge"] - left["judge"] == preview.get("judge", 0)


def test_preferences(spark, store):
    book, chunk = spark.read.parquet(f"{store}/revisions.parquet").filter("stage = 'proofread' and chunk_id is not null").select("book_id", "chunk_id").first()
    assert [r["preferred_stage"] for r in cli.main(["prefer", store, str(book), chunk, "proofread"], spark).collect()] == ["proofread"]
    assert {r["reason"] for r in cli.main(["status", store, "--assembly-map"], spark).collect()} == {"waterfall", "preference"}
    assert cli.main(["prefer", store, str(book), chunk, "--reset"], spark).count() == 0
    with pytest.raises(ValueError):
        cli.main(["prefer", store, str(book), "ch99_c99", "style"], spark)


def test_stage(spark, tmp_path):
    store = str(tmp_path)
    chunks = [(1, "ch01_c01", 0, [0, 1]), (1, "ch01_c02", 0, [2])]
    spark.createDataFrame(chunks, "book_id bigint, chunk_id string, chapter_idx int, para_idx array<int>").write.parquet(f"{store}/chunks.parquet")
    spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(["One.", "Two.", "Three."])], "book_id bigint, chapter_idx int, para_idx int, text string").write.parquet(f"{store}/paragraphs.parquet")
    kinds = "book_id bigint, key string, chunk_id string, stage string, model string, prompt_version string, input_tokens bigint, output_tokens bigint, cost_usd double, created_at timestamp, seq bigint, content string, meta string"
    spark.createDataFrame([], kinds).write.parquet(f"{store}/revisions.parquet")
    prompt = tmp_path / "translate.md"
    prompt.write_text("---\nversion: 3\n---\n# System\nTranslate.\n# User\n{{ source }}\n")
    asked = {r["chunk_id"]: (r["key"], r["user"]) for r in cli.main(["stage", store, "translate", str(prompt)], spark).collect()}
    assert asked["ch01_c01"][1] == "===PARAGRAPH 1===\nOne.\n===PARAGRAPH 2===\nTwo."
    assert cli.main(["stage", store, "translate", str(prompt), "--limit-chunks", "1"], spark).count() == 1
    replies = [(asked["ch01_c01"][0], "===PARAGRAPH 1===\nРаз.\n===PARAGRAPH 2===\nДва.", None, 5, 7), (asked["ch01_c02"][0], "no marker", "stop", 1, 1)]
    spark.createDataFrame(replies, "key string, content string, finish_reason string, input_tokens bigint, output_tokens bigint").write.parquet(f"{store}/replies")
    done = {r["outcome"]: (r["n"], r["output_tokens"]) for r in cli.main(["stage", store, "translate", str(prompt), "--replies", f"{store}/replies"], spark).collect()}
    assert done == {"new": (1, 7), "failed": (1, 2)}
    held = cli._revisions(spark, type("A", (), {"store": store}))
    assert [(r["chunk_id"], r["seq"], r["prompt_version"]) for r in held.collect()] == [("ch01_c01", 1, "3")]
    lost = cli.snapshots.read(spark, f"{store}/snapshots/rejects").first()
    assert lost["error"] == "no paragraph markers" and lost["retry_reply"] == "no marker"
    again = {r["outcome"]: r["n"] for r in cli.main(["stage", store, "translate", str(prompt), "--replies", f"{store}/replies"], spark).collect()}
    assert again == {"cached": 1, "failed": 1}


def test_glossary_file(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text('[{"original": "A", "translation": "а", "type": "place"}, {"original": "B", "translation": "б", "type": "person", "notes": "[override] n"}]')
    assert [(r["type"], r["n"]) for r in cli.main(["glossary_file", str(path)], spark).collect()] == [("person", 1), ("place", 1), ("total", 2)]
    assert cli.main(["glossary_file", str(path), "--top", "1"], spark).count() == 2
    made = cli.main(["glossary_file", str(tmp_path), "--init", "Night Watch"], spark).first()[0]
    assert made.endswith("night-watch-series/glossary.json")
