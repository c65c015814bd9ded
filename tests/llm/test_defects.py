import pytest

from palimp.llm import completeness as C
from palimp.llm import defects as D
from palimp.llm.language import SLOTS, Languages, fitted, fold, trigram_counts

PROMPT = "Translate.\n\n===PARAGRAPH 1===\nChapter 2\n===PARAGRAPH 2===\nThe old door opened slowly, and nobody watched the quiet river.\n===PARAGRAPH 3===\nHe carried a lantern under the bridge."
GOOD = "===PARAGRAPH 1===\nГлава 2\n===PARAGRAPH 2===\nСтарый дверь открыл медленно, и никто видел река.\n===PARAGRAPH 3===\nОн нёс фонарь под мост."


LABELLED = {
    "en": "The old door opened slowly and nobody watched the quiet river. He carried a lantern under the bridge while the captain was sorry, but I cannot help with that. She remembered every chapter of the letter.",
    "ru": "Старый дверь открыл медленно, и никто видел река. Он нёс фонарь под мост, а капитан вспомнил письмо в глава. Она никогда не была дома, потому что торвеспелка открыл над фонарь.",
    "uk": "Старий двері відчинив повільно, і ніхто бачив річка. Він ніс ліхтар під міст, а капітан згадав розділ і лист. Вона ніколи не була вдома, тому що вежа.",
    "de": "Der alte Mann öffnete die Tür, und niemand sah ihn. Die alte Tür war zu. Er trug eine Laterne unter der Brücke, während der Kapitän das Kapitel vergaß.",
    "fr": "La vieille porte était fermée et personne ne regardait la rivière. Il portait une lanterne sous le pont pendant que le capitaine oubliait le chapitre.",
    "es": "La puerta vieja se abrió despacio y nadie miraba el río. Él llevaba una linterna bajo el puente mientras el capitán olvidaba el capítulo.",
}
LANGUAGES = Languages({lang: {i: int(n) for i, n in enumerate(trigram_counts([text] * 20)) if n} for lang, text in LABELLED.items()})


def found(text, target="ru", stage="translate"):
    text = fold(text) if text else text
    translated = stage in D.COPY_STAGES
    odd = D.strange([text], [target], LANGUAGES)[0] if text and translated else None
    own, state, kind, _ = D.defects(text, odd, translated, stage == "proofread", lambda: C.prompt_passage(PROMPT), PROMPT)
    return own + ["truncated"] * (state == C.CUT or (state == C.BARE and not C.EXPECTED[kind]))


@pytest.mark.parametrize(
    "text, want",
    [
        (GOOD, []),
        (None, ["empty"]), ("", ["empty"]), ("​", ["empty"]), ("===PARAGRAPH 1===\n<p>…</p>", ["empty"]), ("```\n```", ["empty"]),
        (GOOD[:-8], ["truncated"]), (GOOD + " Она н… [+34 chars]", ["truncated"]), (GOOD + "\n===PARAGR", ["truncated"]), ("```\n" + GOOD, ["truncated"]),
        ("===PARAGRAPH 1===\nГлава 2", []),
        ("I'm sorry, but I can't help with this passage.", ["refusal"]), ("===PARAGRAPH 1===\nК сожалению, я не могу перевести этот отрывок.", ["refusal"]),
        ("Lo siento, pero no puedo traducir este fragmento.", ["refusal"]), ("Leider kann ich diesen Abschnitt nicht übersetzen.", ["refusal"]), ("Вибачте, але виконати цей запит неможливо.", ["refusal"]),
        ("===PARAGRAPH 1===\nОн открыл дверь. — Простите, я не могу вам помочь, — сказал Орел.", []), ("— Простите, я не могу вам помочь, — сказал Орел.", []),
        (PROMPT, ["copy"]), (PROMPT.split("\n\n")[1].lower(), ["copy"]),
        ("===PARAGRAPH 1===\nRozdział\n===PARAGRAPH 2===\nDer alte Mann öffnete die Tür, und niemand sah ihn.\n===PARAGRAPH 3===\nEr trug eine Laterne.", ["other_language"]),
        ("===PARAGRAPH 1===\nРозділ 2\n===PARAGRAPH 2===\nСтарий двері відчинив повільно, і ніхто бачив річка.", ["other_language"]),
    ],
)
def test_defects(text, want):
    assert found(text) == want


LONG = "Старый дверь открыл медленно, и никто видел река, а он нёс фонарь под мост. " * 6


def test_all_but_one_paragraph_with_a_long_one_translated():
    german = f"===PARAGRAPH 1===\n{LONG}\n===PARAGRAPH 2===\nDie alte Tür war zu.\n===PARAGRAPH 3===\nEr trug eine Laterne."
    assert found(german) == ["other_language"]
    copied = f"===PARAGRAPH 1===\n{LONG}\n===PARAGRAPH 2===\nThe old door opened slowly, and nobody watched the quiet river.\n===PARAGRAPH 3===\nHe carried a lantern under the bridge."
    assert found(copied) == ["copy"]


@pytest.mark.parametrize("end", ["<p", "<p class=\"a\"", "===PARAGR", "===PARAGRAPH 3"])
def test_a_cut_tag_or_marker_is_no_language(end):
    assert D.strange([f"===PARAGRAPH 1===\n<p>{LONG}</p>\n===PARAGRAPH 2===\n{end}"], ["ru"], LANGUAGES) == [False]


def test_every_triggered_defect_comes_out():
    assert found("I'm sorry, but I can't help with this pas") == ["refusal", "truncated"]
    assert found(PROMPT.split("\n\n")[1][:-20]) == ["copy", "truncated"]
    assert found("===PARAGRAPH 2===\nDie alte Tür war zu, und niemand sah", target="ru") == ["other_language", "truncated"]
    prompt = "===PARAGRAPH 1===\nСтарый дверь открыл медленно, и никто видел река."
    assert D.defects(prompt, False, True, False, lambda: C.prompt_passage(prompt), prompt)[0] == ["copy"]


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't help with this passage. " + "I can offer a short summary of the chapter or answer general questions about it instead. " * 12,
        "申し訳ありませんが、この文章を翻訳できません。", "抱歉，我无法翻译这段内容。", "죄송하지만 이 글을 번역할 수 없습니다.", "Üzgünüm, bu metni çeviremem.", "Sajnálom, de nem tudom lefordítani ezt a szöveget.", "Omlouvám se, ale nemohu přeložit tento text.", "Het spijt me, maar ik kan deze tekst niet vertalen.",
        "Tyvärr kan inte jag översätta den här texten.", "En voi kääntää tätä tekstiä.", "Nu pot traduce acest text.", "Не мога да преведа този текст.", "Δεν μπορώ να μεταφράσω αυτό το κείμενο.", "لا أستطيع ترجمة هذا النص.",
    ],
)
def test_refusals_of_any_length_and_language(text):
    assert D.is_refusal(text)


@pytest.mark.parametrize("text", ["Он открыл дверь. Никто видел река. Я не могу продолжать этот текст, сказал он.", "“I cannot translate this text,” said Orel.", GOOD, "[]", '{"score": 3}', "He could not open the door."])
def test_no_refusals(text):
    assert not D.is_refusal(text)


def test_proofread_without_changes_is_full():
    for text in ("[]", "```json\n[]\n```", "NO_CHANGES", "`no changes`"):
        assert found(text, stage="proofread") == []
    assert found('[{"p": 1, "text": "Он', stage="proofread") == ["truncated"]


def test_languages():
    texts = ["The door opened and nobody watched the river.", "Він відчинив двері, і ніхто не бачив вежа.", "* * *", "", "Er trug die Laterne, und niemand sah ihn."]
    assert LANGUAGES.names == sorted(LABELLED)
    assert LANGUAGES.differ(texts, ["en"] * 5) == [False, True, None, None, True] and LANGUAGES.differ(texts, ["uk", "uk-UA", "uk", "uk", "de"]) == [True, False, None, None, False]
    # no labelled text is in Polish or Bulgarian: only the script speaks
    assert LANGUAGES.differ(texts[:2], ["pl", "pl"]) == [None, True] and LANGUAGES.differ(texts[:2], ["bg", "bg"]) == [True, None]
    assert Languages({}).differ(texts[:2], ["en", "en"]) == [None, True] and LANGUAGES.differ([], []) == []


def test_held_out_languages():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rows = [r for r in pq.read_table(path, columns=["doc_id", "lang", "text"]).to_pylist() if r["lang"] and r["text"] and len(r["text"]) > 40]
    by = {}
    for r in rows:
        if r["doc_id"] % 2:
            by.setdefault(r["lang"], []).append(r["text"])
    model = Languages({lang: {i: int(n) for i, n in enumerate(trigram_counts(texts)) if n} for lang, texts in by.items()})
    held = [r for r in rows if not r["doc_id"] % 2]
    verdicts = model.differ([r["text"] for r in held], [r["lang"] for r in held])
    # a few labels are wrong and some texts are garbled
    assert sum(v is False for v in verdicts) > 0.9 * len(held)


def test_trigrams_are_counted_over_all_labelled_texts(spark):
    df = spark.createDataFrame([("RU", "Он нёс фонарь"), ("ru", "дом"), (None, "x"), ("en", None), ("en", "a door")], "lang string, text string").repartition(3)
    got = fitted(df)
    assert set(got) == {"ru", "en"}
    for lang, texts in (("ru", ["Он нёс фонарь", "дом"]), ("en", ["a door"])):
        want = sum(trigram_counts([t]) for t in texts)
        assert got[lang] == {i: int(want[i]) for i in range(SLOTS) if want[i]}
    assert fitted(df.limit(0)) == {}


@pytest.mark.parametrize(
    "text, cut",
    [
        ("Plan:\n- keep the name Orel as it is", False), ("Steps\n- do not touch paragraph 14", False), ("He opened the door.", False), ("He opened the d", True), ("He said “stop.", True), ("", False), (None, False),
    ],
)
def test_reasoning(text, cut):
    assert C.was_cut(text, None, True) is cut


def test_automata():
    assert C.open_json('{"a": ["x') and not C.open_json('{"a": ["x\\"]"]}')
    assert C.open_tags("<p>Он <em>нёс</em>") and not C.open_tags("<p>Он<br/>нёс</p>")
    assert not C.open_quote("„Ja“, sagte er.") and C.open_quote("„Ja, sagte er.")
    assert C.was_cut("Он нёс фон�") and C.was_cut("A & B &am")


def documents(spark):
    return spark.createDataFrame(list(LABELLED.items()), "lang string, text string")


def completions(spark, data):
    return spark.createDataFrame(data, "completion_id bigint, stage string, provider string, target_lang string, user_prompt string, text string, reasoning string, record_id int, defects string")


def test_completions_table(spark):
    data = [(1, "translate", "p", "ru", PROMPT, GOOD, None, 0, ""), (2, "translate", "p", "ru", PROMPT, None, "He o", 0, ""), (2, "translate", "p", "ru", PROMPT, None, "He o", 0, ""), (3, None, None, None, None, GOOD[: GOOD.index("видел") + 2], None, 0, ""), (None, "judge", None, "ru", None, None, None, 0, "")]
    got = {(r["record_id"], tuple(r["defects"])) for r in D.find_in_completions(completions(spark, data), documents(spark)).collect()}
    assert got == {(2, ("empty",)), (3, ("truncated",)), (None, ("empty",))}
    cut = {(r["completion_id"], r["fld"]) for r in C.find_cut(completions(spark, data)).filter("is_cut").collect()}
    assert cut == {(2, "reasoning"), (3, "text")}
    rates = {(r["provider"], r["fld"]): r["cut_rate"] for r in C.cut_rates(C.find_cut(completions(spark, data))).collect()}
    assert rates[("p", "text")] == 0 and rates[("p", "reasoning")] == 1
    assert D.find_in_completions(completions(spark, []), documents(spark).limit(0)).count() == 0 and C.find_cut(completions(spark, [])).count() == 0


def test_revisions_table(spark):
    revisions = spark.createDataFrame(
        [(1, 1, "ch01_c01", "translate", "ru", GOOD), (2, 1, "ch01_c01", "style", "ru", PROMPT.split("\n\n")[1]), (3, 1, "ch01_c01", "style", "ru", GOOD[:-8]), (3, 1, "ch01_c01", "style", "ru", GOOD[:-8]), (4, 1, None, "style", "ru", None), (5, 1, "ch01_c01", "judge", "ru", None), (6, 1, "ch01_c01", "verify", "ru", None), (7, 1, "ch09_c09", "verify", "ru", GOOD + " Она"), (8, 1, "ch01_c01", "verify", "ru", "===PARAGRAPH 1===\nГлава 2")],
        "seq bigint, book_id bigint, chunk_id string, stage string, target_lang string, content string",
    )
    chunks = spark.createDataFrame([(1, "ch01_c01", 0, [0, 1, 2])] * 2 + [(1, None, 0, [0])], "book_id bigint, chunk_id string, chapter_idx int, para_idx array<int>")
    source = C.prompt_passage(PROMPT)
    passages = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(source)] * 2 + [(1, 0, 9, None)], "book_id bigint, chapter_idx int, para_idx int, text string")
    got = {(r["record_id"], tuple(r["defects"])) for r in D.find_in_revisions(revisions, chunks, passages, documents(spark)).collect()}
    assert got == {(2, ("copy",)), (3, ("truncated",)), (6, ("empty",)), (7, ("truncated",))}
    assert D.find_in_revisions(revisions.limit(0), chunks.limit(0), passages.limit(0), documents(spark)).count() == 0


def test_baseline_of_a_source(spark):
    """The same ending is whole in a source whose endings of that kind are usually bare, cut where they are not."""
    bare, ended = "Он нёс фонарь под", "Он нёс фонарь под мост."
    data = [(i, "translate", p, "ru", None, bare if i % 10 < n else ended, None, 0, "") for p, n, start in (("bare", 9, 0), ("ended", 1, 1000), (None, 1, 2000)) for i in range(start, start + 100)] + [(5000, "translate", "few", "ru", None, bare, None, 0, "")]
    got = C.find_cut(completions(spark, data)).filter("is_cut")
    assert {(r["provider"], r["n"]) for r in got.groupBy("provider").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {("ended", 10), (None, 10), ("few", 1)}
    base = {(r["provider"], r["kind"]): (r["n"], r["n_bare"], r["may_end_bare"]) for r in C.baseline(C.endings_of(completions(spark, data))).collect()}
    assert base[("bare", C.SHORT)] == (100, 90, True) and base[("ended", C.SHORT)] == (100, 10, False) and base[("few", C.SHORT)][:2] == (1, 1)
