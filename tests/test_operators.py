import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimp.functions.declension import find, probe
from palimp.operators import chunking, glossary, notes, patches, repair, snapshots
from palimp.operators import revisions as R
from palimp.operators import verdicts as V
from palimp.operators import waterfall as W

REVISIONS = "book_id bigint, key string, chunk_id string, stage string, cost_usd double, input_tokens bigint, output_tokens bigint, created_at timestamp, seq bigint, content string, meta string"


def revisions(spark, rows):
    """(seq, chunk, stage, minute, content, meta)"""
    return spark.createDataFrame([(1, f"k{s}", c, st, None, None, 5, datetime(2025, 1, 1, 0, m), s, x, meta) for s, c, st, m, x, meta in rows], REVISIONS)


@pytest.fixture(scope="module")
def history(spark):
    two = "===PARAGRAPH 1===\n{}\n===PARAGRAPH 2===\nx"
    rows = [
        (1, "c1", "translate", 1, two.format("a"), None), (2, "c1", "translate", 3, two.format("b"), None), (3, "c1", "style", 2, two.format("b") + " \n", None), (4, "c1", "verify", 9, "===PARAGRAPH 1===\nonly one", None),
        (5, "c2", "translate", 1, two.format("q"), None), (6, None, "proofread", 2, two.format("r"), '{"chunk_id": "c2"}'), (7, None, "style", 2, "z", '{"chunk_id": "c2'),
        (8, "c1", "judge", 4, '```json\n{"score": "2", "issues": "bad"}\n```', '{"judged_stage": "translate"}'), (9, "c1", "judge", 5, '{"score": 3.7, "issues": ["a", "b"]}', None), (10, "c2", "judge", 5, "broken", None), (11, "c2", "judge", 6, '{"score": 1}', '{"run": "r1"}'), (12, "c2", "judge", 5, '{"score": null, "issues": {"a": 1}}', '{"judged_stage": "style"}'),
        (13, "c3", "translate", 5, None, None), (14, "c3", "glossary", 5, "[]", None),
    ]
    return revisions(spark, rows + rows[:3])


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_counts(history):
    stats = {r["stage"]: (r["n"], r["n_chunks"], r["n_legacy"], r["cost_usd"]) for r in R.stage_stats(history).collect()}
    assert stats["translate"] == (4, 3, 0, 0.0) and stats["style"] == (2, 1, 1, 0.0) and stats["proofread"] == (1, 1, 0, 0.0)
    assert as_set(R.latest_of(history, "translate"), "chunk_id", "seq") == {("c1", 2), ("c2", 5), ("c3", 13)}


def test_waterfall(spark, history):
    assert as_set(W.resolve(history), "chunk_id", "stage") == {("c1", "verify"), ("c2", "proofread"), ("c3", "translate")}
    wanted = spark.createDataFrame([(1, "c1", "style"), (1, "c2", "repair")], "book_id bigint, chunk_id string, preferred_stage string")
    assert as_set(W.resolve(history, wanted), "chunk_id", "stage", "reason") == {("c1", "style", "preference"), ("c2", "proofread", "waterfall (preference unavailable)"), ("c3", "translate", "waterfall")}
    assert as_set(W.resolved_texts(history, None, first=True), "chunk_id", "seq") == {("c1", 4), ("c2", 6), ("c3", 13)}
    assert as_set(W.before(history, "style"), "chunk_id", "seq") == {("c1", 2), ("c2", 6), ("c3", 13)}
    counts = spark.createDataFrame([(1, "c1", 2), (1, "c2", 2), (1, "c3", 1)], "book_id bigint, chunk_id string, n_expected int")
    assert as_set(W.valid_before(history, counts), "chunk_id", "stage") == {("c1", "style"), ("c2", "proofread")}
    shuffled = history.repartition(7, F.rand(3))
    assert as_set(W.per_stage(shuffled), "chunk_id", "stage", "seq") == as_set(W.per_stage(history), "chunk_id", "stage", "seq")


def test_assembly_and_grid(spark, history):
    chunks = spark.createDataFrame([(1, "c1", 0, [0, 1]), (1, "c2", 0, [2, 3]), (1, "c3", 1, [0]), (1, "c4", 1, [1])] * 2, "book_id bigint, chunk_id string, chapter_idx int, para_idx array<int>")
    assert as_set(W.assemble(chunks, history), "chapter_idx", "para_idx", "stage", "text") == {(0, 0, "style", "b"), (0, 1, "style", "x"), (0, 2, "proofread", "r"), (0, 3, "proofread", "x")}
    assert as_set(W.unassembled(chunks, history), "chunk_id", "why") == {("c3", "broken"), ("c4", "missing")}
    assert as_set(W.grid(history), "chunk_id", "stage", "changed") == {("c1", "translate", None), ("c1", "style", False), ("c1", "verify", True), ("c2", "translate", None), ("c2", "proofread", True), ("c3", "translate", None)}
    assert as_set(W.effective_source(history), "chunk_id", "source") == {("c1", "verify"), ("c2", "proofread"), ("c3", "translate")}
    assert as_set(W.missing_in(history, "verify"), "chunk_id") == {("c2",), ("c3",)}


def test_a_malformed_text_gives_way_to_an_earlier_one(spark):
    page = "===PARAGRAPH 1===\n<p>{}</p>\n===PARAGRAPH 2===\nx & y"
    history = revisions(spark, [(1, "c1", "translate", 1, page.format("a"), None), (2, "c1", "style", 2, page.format("<i>b"), None), (3, "c2", "translate", 1, page.format("<b"), None), (4, "c3", "style", 1, page.format("s"), None), (5, "c3", "verify", 2, page.format("v"), None)])
    chunks = spark.createDataFrame([(1, f"c{i}", i, [0, 1]) for i in (1, 2, 3)], "book_id bigint, chunk_id string, chapter_idx int, para_idx array<int>")
    counts = chunks.select("book_id", "chunk_id", F.size("para_idx").alias("n_expected"))
    assert as_set(W.valid_before(history, counts), "chunk_id", "stage") == {("c1", "translate"), ("c3", "verify")}
    assert as_set(W.assemble(chunks, history).filter("para_idx = 0"), "chapter_idx", "stage", "text") == {(1, "translate", "<p>a</p>"), (3, "verify", "<p>v</p>")}
    assert as_set(W.unassembled(chunks, history), "chunk_id", "why") == {("c2", "broken")}
    assert as_set(W.assemble(chunks, history, forced="style").filter("para_idx = 0"), "chapter_idx", "text") == {(3, "<p>s</p>")}
    assert as_set(W.unassembled(chunks, history, forced="style"), "chunk_id", "why") == {("c1", "broken"), ("c2", "missing")}
    assert W.rehydrated(chunks, history).first()[1:] == (2, 1) and W.rehydrated(chunks, history, every=False).first()[1:] == (1, 1)
    wanted = spark.createDataFrame([(1, "c3", "style")], "book_id bigint, chunk_id string, preferred_stage string")
    assert as_set(W.assemble(chunks, history, wanted).filter("chapter_idx = 3 and para_idx = 0"), "stage") == {("style",)}


def test_agreement(spark):
    base = spark.createDataFrame([(1, c, s) for c, s in (("a", 1), ("b", 4), ("c", 2), ("d", 5))], "book_id bigint, chunk_id string, score int")
    runs = spark.createDataFrame([(1, c, "r", s) for c, s in (("a", 2), ("b", 4), ("c", 5), ("e", 1))], "book_id bigint, chunk_id string, run string, score int")
    assert V.agreement(base, runs).first()[:] == ("r", 3, 1, 4, 1, 2, 0.5)
    assert V.agreement(base, runs.limit(0)).count() == 0


def test_verdicts(history):
    got = {r["seq"]: (r["score"], r["issues"], r["judged_stage"]) for r in V.verdicts(history).collect()}
    assert got[8] == (2, ["bad"], "translate") and got[9] == (3, ["a", "b"], "translate") and got[10] == (0, ["parse error"], "translate") and 11 not in got
    assert got[12][0] == 0 and got[12][2] == "style" and len(got[12][1]) == 1
    assert as_set(V.verdicts(history, lenient=False), "seq") == {(8,), (9,)}
    assert as_set(V.at_most(history, 3), "chunk_id", "score") == {("c1", 3), ("c2", 0)} and as_set(V.at_most(history, 3, strict=True), "chunk_id") == {("c2",)}


def test_clear_and_upsert(spark, history):
    rows = revisions(spark, [(1, "c", "translate", 1, "", None), (2, "c", "verify", 1, "", None), (3, "c", "judge", 1, "", '{"judged_stage": "verify"}'), (4, "c", "judge", 1, "", None), (5, "c", "repair_verdicts", 1, "", None), (6, "c", "glossary", 1, "", None), (7, "c", "judge", 1, "", "{bad")])
    assert as_set(R.to_clear(rows, "verify"), "seq") == {(2,), (3,), (5,)}
    assert as_set(R.clear(rows, "translate"), "seq") == {(6,)}
    wanted = spark.createDataFrame([(1, "c", "verify"), (1, "d", "reflect")], "book_id bigint, chunk_id string, preferred_stage string")
    assert as_set(R.preferences_left(wanted, "style"), "chunk_id") == {("d",)}
    twice = rows.withColumn("key", F.lit("k"))
    assert as_set(R.upsert(twice), "seq") == {(7,)}


def test_last_write(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "a", 1, False), (2, None, 3, True)], "k int, v string, at int, deleted boolean")
    assert as_set(R.last_write(log, ["k"], ["at"]), "k", "v") == {(1, "b")}


def test_chunking_is_the_sequential_packing(spark):
    r = random.Random(5)
    data = [(b, c, p, " ".join(["w"] * r.choice([0, 1, 5, 30, 70, 200]))) for b in range(2) for c in range(3) for p in range(r.randint(1, 25))]
    df = spark.createDataFrame([*data, *data[:9], (None, 0, 0, "x"), (1, None, 0, "x")], "book_id bigint, chapter_idx int, para_idx int, text string")
    want = {}
    for b, c, p, t in data:
        chunks = want.setdefault((b, c), [[]])
        sizes = lambda ps: sum(len(next(x[3] for x in data if x[:3] == (b, c, q)).split()) for q in ps)  # noqa: B023, E731
        if chunks[-1] and sizes(chunks[-1]) + len(t.split()) > 100:
            chunks.append([])
        chunks[-1].append(p)
    got = {}
    for row in chunking.with_overlap(chunking.pack(df.repartition(5), 100)).orderBy("chunk_no").collect():
        got.setdefault((row["book_id"], row["chapter_idx"]), []).append(row)
    assert {k: [x["para_idx"] for x in v] for k, v in got.items()} == want
    for rows in got.values():
        for a, b in zip(rows, rows[1:]):
            assert a["next_overlap"] == b["para_idx"][:1] and b["prev_overlap"] == a["para_idx"][-1:]
    assert chunking.pack(df.limit(0)).count() == 0


def test_patches(spark):
    long = "This is a sentence that is certainly longer than forty characters."
    paragraphs = spark.createDataFrame([(i, p, t) for i in range(1, 8) for p, t in ((1, "— Да."), (2, f"Own text. {long}"), (3, "Third."))], "id int, p int, text string")
    replies = spark.createDataFrame(
        [(1, '[{"p": 1, "text": "— Нет."}, {"p": 1, "text": "— Ну."}]'), (2, '[{"p": 1, "text": "«Да»"}, {"p": 3, "text": "<b>x"}]'), (3, '[{"p": 9, "text": "a"}, {"p": 1, "text": "— Э."}]'), (4, f'[{{"p": 3, "text": "Third. {long}"}}]'), (5, "NO_CHANGES"), (6, None), (7, '[{"p": 3}]'), (8, "[]")],
        "id int, reply string",
    )
    read = patches.read_replies(replies, "id", "reply")
    assert as_set(read, "id", "outcome") == {(1, "patches"), (2, "patches"), (3, "patches"), (4, "patches"), (5, "no_changes"), (6, "rejected"), (7, "rejected"), (8, "no_changes")}
    got = as_set(patches.apply_patches(read, paragraphs, "id"), "id", "at", "verdict")
    assert got == {(1, 0, "overridden"), (1, 1, "applied"), (2, 0, "dash"), (2, 1, "malformed"), (3, 0, "out_of_range"), (3, 1, "out_of_range"), (4, 0, "borrowed")}
    texts = {r["id"]: (r["outcome"], r["changed"], r["paragraphs"]) for r in patches.patched(read, paragraphs, "id").collect()}
    assert texts[1] == ("patches", True, ["— Ну.", f"Own text. {long}", "Third."]) and texts[2][:2] == ("patches", False) and texts[3] == ("out_of_range", None, None) and texts[5][:2] == ("no_changes", False) and texts[6] == ("rejected", None, None)
    assert patches.apply_patches(patches.read_replies(replies.limit(0), "id", "reply"), paragraphs, "id").count() == 0


def test_repair(spark):
    issues = ["grammar: p.1 «aa bb» → «cc»", "grammar/ p.2 «xx» -> «yy»", "style: p.1 «aa bb» → «c»", "no category", "grammar: «aa bb» → «c»", "grammar: p.9 «aa» → «b»", "grammar: p.1 prose", "grammar: p.1 «aa bb» → «aa bb»", "markup: p.1 «zz» → «b»", "accuracy: p.1 «cc dd» → «e»", "grammar: p.2 «yy» → «w»"]
    verdicts = spark.createDataFrame([(1, "c", issues), (1, "gone", issues)], "book_id bigint, chunk_id string, issues array<string>")
    texts = spark.createDataFrame([(1, "c", ["aa bb dd", "xx yy"])], "book_id bigint, chunk_id string, paragraphs array<string>")
    got = repair.propose(verdicts, texts)
    skips = [r["skip"] for r in got.orderBy("n").collect()]
    assert skips == [None, None, "out_of_scope", "no_category", "no_paragraph", "bad_paragraph", "no_pair", "no_op", "quote_absent", "quote_absent", None]
    assert as_set(got.filter("deferred"), "n") == {(5,), (6,), (7,)}
    accepted = spark.createDataFrame([(1, "c", 1, True), (1, "c", 2, True), (1, "c", 3, True)], "book_id bigint, chunk_id string, place int, accepted boolean")
    done = repair.apply(repair.vet(got, accepted), texts).first()
    # the second substitution makes «yy» occur twice, so the third no longer applies
    assert done["paragraphs"] == ["cc dd", "yy yy"] and done["n_applied"] == 2
    replies = spark.createDataFrame([(1, "c", '[{"n": 1, "verdict": "accept"}, {"n": "2", "verdict": "no"}]'), (1, "other", "[]")], "book_id bigint, chunk_id string, reply string")
    assert as_set(repair.stage_rows(got, replies, texts), "chunk_id", "stage", "accepted", "content") == {("c", "repair_verdicts", 1, replies.first()["reply"]), ("c", "repair", 1, "===PARAGRAPH 1===\ncc dd\n===PARAGRAPH 2===\nxx yy")}
    refused = replies.withColumn("reply", F.lit('{"n": 1, "verdict": "reject"}'))
    assert as_set(repair.stage_rows(got, refused, texts), "chunk_id", "stage") == {("c", "repair_verdicts")}
    assert repair.stage_rows(got, replies.withColumn("reply", F.lit("fine by me")), texts).count() == 0 and repair.stage_rows(got, replies.withColumn("reply", F.lit(None).cast("string")), texts).count() == 0
    counts = spark.createDataFrame([(1, "c", 2), (1, "d", 1), (1, "e", 1)], "book_id bigint, chunk_id string, n_expected int")
    old = spark.createDataFrame([(1, "c", "===PARAGRAPH 1===\na\n===PARAGRAPH 2===\nb", '{"accepted": 2}'), (1, "d", "text", None), (1, "e", "===PARAGRAPH 1===\na", '{"verdicts": true}')], "book_id bigint, chunk_id string, content string, meta string")
    assert as_set(repair.legacy(old, got, counts), "chunk_id", "outcome", "accepted", "rejected") == {("c", "used", 2, 1), ("d", "broken", None, None)}


def test_glossary(spark):
    series = spark.createDataFrame([("s", "A", "x", 1), ("s", "A", "а", 2)], "series string, original string, translation string, pos int")
    book = spark.createDataFrame([(1, "s", "A", "а", 1, True), (2, "s", "A", "б", 2, True), (3, "s", "B", "в", 3, False), (4, "s", "B", "г", 4, True), (5, "s", "B", "д", 5, True), (6, "s", None, "е", 6, True), (7, "s", "B", "г", 7, None)], "cand_id bigint, series string, original string, translation string, pos int, approved boolean")
    assert as_set(glossary.promote(book, series, F.col("approved")), "cand_id", "outcome") == {(1, "existing"), (2, "conflict"), (3, "unapproved"), (4, "added"), (5, "conflict"), (7, "unapproved")}
    entries = spark.createDataFrame([(1, 1, "A", "а", "person", "f", "n " * 80), (2, 1, "B", "б", "place", "f", None)], "cand_id bigint, book_id bigint, original string, translation string, type string, gender string, notes string")
    lines = glossary.render(entries, ["book_id"]).first()["block"].split("\n")
    assert lines[0].startswith("A | а | person, f | n n") and lines[0].endswith("...") and lines[1] == "B | б | place"
    assert as_set(glossary.summary(entries), "type", "n", "place") == {("person", 1, 0), ("place", 1, 1), ("total", 2, 100)}
    every = spark.createDataFrame([(1,), (2,)], "book_id bigint")
    assert as_set(glossary.render(entries, ["book_id"], every).filter("book_id = 2"), "block") == {(glossary.NO_TERMS,)}
    typed = series.withColumn("type", F.lit("place"))
    assert as_set(glossary.merged(book.withColumn("type", F.lit("person")), typed, F.col("approved")), "original", "translation", "type", "place") == {("B", "г", "person", 0), ("A", "а", "place", 1)}


def test_glossary_replies(spark):
    one, bad = '{"original": "A", "translation": "а", "type": "person", "override": true, "notes": "n"}', '{"original": "A", "type": "person"}'
    full = f'```json\n{{"bookstart": " s ", "entries": [{one}, {bad}], "bookend": "e"}}\n```'
    texts = [full, full.replace(" s ", "x"), full.replace('"e"', "null"), f"[{one}]", f"[{bad}]", "", None, "prose", "[]", '{"entries": 3}']
    replies = spark.createDataFrame([(i, t, "s", "e") for i, t in enumerate(texts)], "id int, reply string, bookstart string, bookend string")
    got = {r["id"]: (r["outcome"], r["n_invalid"], r["entries"]) for r in glossary.read_replies(replies, "id", "reply").collect()}
    assert [got[i][0] for i in range(10)] == ["read", "cut_start", "cut_end", "cut_start", "unreadable", "empty", "empty", "unreadable", "cut_start", "unreadable"]
    assert got[0][1] == 1 and got[0][2][0]["notes"] == "[override] n" and got[1][2] is None
    free = {r["id"]: r["outcome"] for r in glossary.read_replies(replies, "id", "reply", marks=False).collect()}
    assert free[3] == "read" and free[8] == "read"
    stored = spark.createDataFrame([(1, '{"bookstart": "a", "bookend": "b"}'), (2, '{"bookstart": "a"}'), (3, None)], "id int, meta string")
    assert as_set(glossary.guarded(stored), "id") == {(1,)}


def test_notes(spark):
    terms = spark.createDataFrame([(1, 1, "x", "Облако", "term", "n", "note"), (2, 1, "x", "скрип", "term", "m", "note"), (3, 1, "x", "я", "term", None, "note"), (4, 1, "x", "дом", "term", None, None), (5, 1, "x", " ", "term", None, "n")], "cand_id bigint, book_id bigint, original string, translation string, type string, gender string, notes string")
    texts = spark.createDataFrame([(1, 0, 0, "Облако тут. Он скрипел."), (1, 0, 1, "Он видел Облако и скрипы."), (1, 1, 0, "Скрипа нет, а я тут, в Облаке."), (1, 1, 1, None), (2, 0, 0, "В Облаке")], "book_id bigint, chapter_idx int, para_idx int, text string")
    chosen = notes.eligible(terms, ["term"])
    assert as_set(chosen, "cand_id", "place") == {(1, 1), (2, 2), (3, 3)}
    assert as_set(notes.occurrences(chosen, texts), "cand_id", "chapter_idx", "para_idx", "at") == {(1, 0, 1, 9), (2, 0, 1, 18), (1, 1, 0, 23), (2, 1, 0, 0), (3, 1, 0, 14)}
    assert as_set(notes.placements(chosen, texts), "cand_id", "chapter_idx", "para_idx", "number") == {(1, 0, 1, 1), (2, 0, 1, 2), (3, 1, 0, 3)}
    assert notes.placements(chosen, texts, "first-in-chapter").count() == 5


def test_occurrences_are_those_of_brute_force(spark):
    rng = random.Random(7)
    held = ["Облако", "скрип", "Старый мост", "Келор-20", "орёл", "тень", "река", "«Дом»", "C++", "земля", "Армия", "здание", "Я", ""]
    terms = [(i, 1 + i % 2, t, g, i) for i, (t, g) in enumerate((t, g) for t in held for g in (None, "f"))]
    bits = ["в Облаках", "скрипы", "поскрипывал.", "под старым мостом", "Старый  мост", "старый мостам", "Келор-20", "Келором", "Орла", "орёл", "тенью", "реки", "«Дом»", "c++", "земли", "Армией", "в здании", "И я.", "— Облако"]
    texts = [(1 + i % 2, i % 3, i, " ".join(rng.choices(bits, k=rng.randint(0, 6)))) for i in range(80)] + [(1, 0, 99, None)]
    got = notes.occurrences(spark.createDataFrame(terms, "cand_id bigint, book_id bigint, translation string, gender string, place int"), spark.createDataFrame(texts, "book_id bigint, chapter_idx int, para_idx int, text string"))
    want = {(i, c, p, at) for i, b, t, g, _ in terms for o, c, p, x in texts if b == o and x and (at := find(t, g, x)) >= 0}
    assert as_set(got, "cand_id", "chapter_idx", "para_idx", "at") == want and got.count() == len(want) > 100


def test_probe_containment_is_that_of_brute_force(spark):
    rng = random.Random(5)
    held = ["Облако", "скрип", "я", "Да", "Старый мост", "Тихая\u00a0гавань", "Орёл", "река", "C++", "🙂ок", " "]
    terms = [(i, 1 + i % 2, t, "unknown") for i, t in enumerate(held + held)] + [(99, None, "река", "f"), (100, 1, None, None)]
    bits = ["В Облаках", "заоблачный", "скрипы", "поскрипывал", "да", "вода", "старого моста", "старый", "тихая", "орла", "реки", "прирекать", "c++.", "🙂ок", "«Орёл»", ""]
    texts = [(1 + i % 2, 0, i, rng.choice([" ", "\u00a0", "\n"]).join(rng.choices(bits, k=rng.randint(0, 5)))) for i in range(60)] + [(None, 0, 0, "река"), (1, 1, 0, None)]
    got = notes.probe_matches(spark.createDataFrame([(*t, None) for t in terms], "cand_id bigint, book_id bigint, translation string, gender string, place int"), spark.createDataFrame(texts, "book_id bigint, chapter_idx int, para_idx int, text string"))
    want = {(i, c, p) for i, b, t, g in terms for o, c, p, x in texts if b and b == o and x and (held := probe(t or "", g)) and held in x.lower()}
    assert as_set(got, "cand_id", "chapter_idx", "para_idx") == want and got.count() == len(want)
    assert {i for i, _, _ in want} >= {0, 1, 2, 4, 5}


def test_snapshots(spark, tmp_path, history):
    folder = str(tmp_path / "prefs")
    assert snapshots.read(spark, folder) is None
    snapshots.swap(spark.range(3), folder)
    snapshots.swap(spark.range(5), folder)
    assert snapshots.read(spark, folder).count() == 5
    snapshots.chunker_params(spark, folder, {"target": 150})
    snapshots.chunker_params(spark, folder, {"target": 150})
    with pytest.raises(snapshots.ChunkerMismatch):
        snapshots.chunker_params(spark, folder, {"target": 99})
    assert snapshots.meta(spark, folder, "none") is None
    snapshots.set_meta(spark, folder, "run", {"a": ["ж"]})
    assert snapshots.meta(spark, folder, "run") == {"a": ["ж"]}
    copied = str(tmp_path / "copy")
    assert snapshots.backup(spark, str(tmp_path / "nothing"), copied) is None and snapshots.backup(spark, folder, copied) and snapshots.read(spark, copied).count() == 5
    state = {}
    for stage in ("glossary", "pause_1", "translate", "done", "done"):
        state = snapshots.advance(state, stage)
    assert state == {"stage": "done", "completed": ["glossary", "translate", "done"]} and snapshots.taken_back(state) == {"stage": "done", "completed": ["glossary"]}
    with pytest.raises(ValueError):
        snapshots.advance(state, "nap")
    snapshots.check_preference(history, 1, "c1", "style")
    for stage in ("repair", "judge"):
        with pytest.raises(ValueError):
            snapshots.check_preference(history, 1, "c1", stage)
