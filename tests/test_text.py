import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimp.functions import declension, jsonfix
from palimp.functions import text as X
from palimp.functions.udfs import slugify


def values(spark, column, data, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", column(F.col("v"))).collect())]


def test_words(spark):
    assert values(spark, X.word_count, ["a b  c", "a\xa0b", "", "  ", None, " x\ny "]) == [3, 2, 0, 0, 0, 2]


def test_markers(spark):
    texts = ["===PARAGRAPH 1===\n a \n===PARAGRAPH 7===\nb", "```\n===PARAGRAPH 1===\na\n```", "no marker", "", None, "===PARAGRAPH 1===\n", "x\n===PARAGRAPH 1===  \ny"]
    assert values(spark, X.split_markers, texts) == [["a", "b"], ["a"], None, None, None, [""], ["y"]]
    got = values(spark, lambda c: X.split_markers(X.join_markers(X.split_markers(c))), texts)
    assert got[0] == ["a", "b"] and got[5] == [""]


def test_ampersands_and_plain(spark):
    assert values(spark, X.escape_ampersands, ["AT&T &amp; &#123; &x; &#xAf;", None]) == ["AT&amp;T &amp; &#123; &amp;x; &#xAf;", None]
    assert values(spark, X.plain_text, ["<p>a <em>b</em>\xa0c</p>", None]) == ["a b c", None]


def test_no_changes_and_delta(spark):
    texts = ["NO_CHANGES", "`no changes`", "Fine.\n```\nNO_CHANGES\n```", "[1]\n```\nNO_CHANGES\n```", "Он", None]
    assert values(spark, X.is_no_changes, texts) == [True, True, True, False, False, None]
    assert values(spark, X.is_delta, ["NO CHANGES", "```json\n[]\n```", "===PARAGRAPH 1===\na", "hm"]) == [True, True, False, True]


def test_dash(spark):
    df = spark.createDataFrame([("— Да", "«Да»"), ("<p>– Да</p>", "<p>«Да»</p>"), ("Да", "«Да»"), ("— Да", "— Нет")], "a string, b string")
    assert [r[0] for r in df.select(X.breaks_dash(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_key(spark):
    want = hashlib.sha256("a\x1f\x1fb\x1f".encode()).hexdigest()
    assert spark.range(1).select(X.content_key(F.lit("a"), F.lit(None), F.lit("b"))).first()[0] == want


def test_names_paths_images(spark):
    assert values(spark, X.language_name, ["ru", "pt-BR", "DA_dk", "en", "xx", None]) == ["Russian", "Portuguese", "Danish", None, None, None]
    assert values(spark, X.normalize_path, ["a/./b/../c.x#f", "../a?q", "/a//b", ""]) == ["a/c.x", "a", "a/b", ""]
    images = [b"\xff\xd8\xff\xe0abc", b"\x89PNG\r\n\x1a\nxx", b"RIFF1234WEBPVP8 ", b"GIF89a..", b"BM1234", b"II*\0", b"text", b""]
    assert values(spark, X.image_type, [bytearray(i) for i in images], "binary") == ["image/jpeg", "image/png", "image/webp", "image/gif", "image/bmp", "image/tiff", None, None]
    assert values(spark, X.retry_budget, [0, 31, 100], "int") == [3, 3, 10]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('{"a": 1} as asked', {"a": 1}),
        ('{"issues": ["p.1 «and "No," she said» is wrong", "b"]}', {"issues": ['p.1 «and "No," she said» is wrong', "b"]}),
        ('["a "b" c"]', ['a "b" c']), (r'["a \"b\" c"]', ['a "b" c']),
    ],
)
def test_json_repair(text, want):
    assert jsonfix.parse(text) == want


def test_json_reading_knows_its_place():
    assert jsonfix.parse('{"a": ["x "y"} z", "b"], "c": "d "e", f"}') == {"a": ['x "y"} z', "b"], "c": 'd "e", f'}
    far = '{"a": "he said "no"' + " " * 2000 + 'and left", "b": 1}'
    assert jsonfix.parse(far)["b"] == 1
    long = '["' + 'a "b" ' * 20000 + '"]'
    assert jsonfix.parse(long) == ["a \"b\" " * 20000]
    cut = "[" + '{"p": 1, "text": "a"}, ' * 5000 + '{"p": 2, "te'
    assert len(jsonfix.read_patches(cut)) == 5000
    for bad in ('["a" "b"', '{"a" 1}', "[1,]", '{"a": "b",}', "[" * 100_000):
        with pytest.raises(ValueError):
            jsonfix.parse(bad)


def test_json_failures():
    for bad in ("", "no json", '{"a": '):
        with pytest.raises(ValueError):
            jsonfix.parse(bad)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_valid_json_is_never_changed(value):
    assert jsonfix.parse(json.dumps(value)) == value


def test_patches():
    assert jsonfix.read_patches('See [14]: [{"p": 1, "text": "a"}]') == [{"p": 1, "text": "a"}]
    assert jsonfix.read_patches('[{"p": 1, "text": "a"}, {"p": 2, "text": "b') == [{"p": 1, "text": "a"}]
    assert jsonfix.read_patches("```json\n[]\n```") == [] and jsonfix.read_patches("[1, 2]") == [1, 2]
    for bad in ("nothing", '{"p": 1}'):
        with pytest.raises(ValueError):
            jsonfix.read_patches(bad)


def test_verdict_list():
    assert jsonfix.read_verdicts('```\n[{"n": 1, "verdict": "Accepted", "why": "ok"}, {"n": "x"}, {"n": "2", "verdict": "reject"}]\n```') == {1: (True, "ok"), 2: (False, "")}
    assert jsonfix.read_verdicts('{"n": 3, "verdict": "accept"}') == {3: (True, "")}
    with pytest.raises(ValueError):
        jsonfix.read_verdicts("all good")


@pytest.mark.parametrize(
    "term, gender, text, at",
    [
        ("скрип", None, "двери скрипели", -1), ("скрип", None, "курс скрипа рос", 5), ("Облако", "n", "В небе облако.", -1), ("Облако", "n", "Облако ждёт. Он вошёл в Облако.", 24), ("ведьма", "f", "двух ведьмами", 5),
        ("Большой Медведь", "m", "видел Большой Медведя там", 6), ("печать", "f", "под печатью", 4), ("кот", None, "два кота", -1), ("", None, "x", -1), ("кофе", None, "кофе", 0),
    ],
)
def test_declension(term, gender, text, at):
    assert declension.find(term, gender, text) == at
    if at >= 0:
        assert declension.probe(term, gender) in text.lower()


def test_forms_follow_the_declension():
    assert set(declension.forms("книга")) == {"книга", "книги", "книге", "книгу", "книгой", "книгою", "книгам", "книгами", "книгах"}
    assert set(declension.forms("король", "m")) == {"король", "короля", "королю", "королем", "короле", "короли", "королей", "королям", "королями", "королях"}
    assert {"синий", "синего", "синяя", "синюю", "синими"} <= set(declension.forms("синий", "unknown")) and "земле" in declension.forms("земля")
    assert declension.forms("здание")[0] == "зданиями" and "здании" in declension.forms("здание") and declension.forms("Большой кот") == ["большой кот"] and declension.forms(" ") == []


def test_slugs():
    assert [slugify(t) for t in ("Élan Vital!", "Книга", None, "a--b")] == ["elan-vital", "book", "book", "a-b"]
