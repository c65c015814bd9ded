import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm import lookalike as K

PLAIN = "Медленно тихий район, чужа́к"


def speller():
    return K.Speller(K.fit(["Медленно тихий район открыл", "the quiet door opened slowly"]))


def test_variants_come_out_the_same():
    s = speller()
    forms = ["Мeдлeннo тиxий paйoн", "Медленно тих​ий район", "Медленно тихий　район", "Медленно тихйй район".replace("йй", "ий"), "Медленнօ тихий райοн"]
    assert {s.canonical(f) for f in forms[:3] + forms[4:]} == {"Медленно тихий район"}
    assert s.canonical("ｄｏｏｒ") == "door" and s.canonical("dооr") == "door"
    assert s.canonical("ѕеrvе") == "serve"


def test_visible_differences_stay():
    s = speller()
    for a, b in [("Дом", "дом"), ("чужак", "чужа́к"), ("дверь.", "дверь!"), ("нес", "нёс"), ("он и", "он й"), ("a b", "a  b"), ("It's", "It’s"), ("…", "...")]:
        assert s.canonical(a) != s.canonical(b)


def test_tags_stay_latin():
    assert speller().canonical("<p>Он</p>") == "<p>Он</p>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aаαeеoоοpрcсxхyуiіbдфgжRLя <p>/é́̆​ １－.", max_size=14))
def test_canonical_is_idempotent_and_settled_values_are_fixed(value):
    s = speller()
    once = s.canonical(value)
    assert s.canonical(once) == once
    if K._settled([value])[0]:
        assert once == value


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(K.GROUPS), min_size=1, max_size=6), st.randoms())
def test_tokens_of_the_same_shapes_are_equal(groups, random):
    s = speller()
    a, b = ("".join(random.choice(g) for g in groups) for _ in range(2))
    assert s.canonical(a + " door") == s.canonical(b + " door")


def rows(spark, data):
    return spark.createDataFrame(data, "fld string, id bigint, book bigint, chunk string, _value string, fld2 string")


def test_pairs_match_brute_force(spark):
    values = ["дом", "дoм", "д​ом", "дом", None, "", "​", "Дом", "дом "]
    data = [("f", i, i % 2, "c", v, "x") for i, v in enumerate(values * 2)] + [("f", 3, 1, "c", "дом", "x")]
    found = {tuple(r) for r in K.alike_pairs(rows(spark, data), ["book", "chunk"]).collect()}
    s = speller()
    want = set()
    one = {(f, i, b, c): v for f, i, b, c, v, _ in data}
    for (ka, va), (kb, vb) in itertools.combinations(sorted(one.items(), key=lambda x: x[0][1]), 2):
        if ka[2] == kb[2] and va is not None and vb is not None and va != vb and s.canonical(va) == s.canonical(vb):
            want.add(("f", ka[1], kb[1]))
    assert found == want and want


def test_empty_table_and_null_scope(spark):
    assert K.alike_pairs(rows(spark, []), ["book", "chunk"]).count() == 0
    found = K.alike_pairs(rows(spark, [("f", 1, None, None, "oн", ""), ("f", 2, None, None, "он", ""), ("f", 3, 1, None, "он", "")]), ["book", "chunk"]).collect()
    assert [tuple(r) for r in found] == [("f", 1, 2)]


def test_canonical_column(spark):
    df = spark.createDataFrame([(1, "oн", 5), (2, None, 6), (3, "a" * 200_000 + "ｂ", 7)], "k bigint, v string, changed int")
    got = {r["k"]: (r["v"], r["changed"]) for r in K.canonical_column(df, "k", "v").collect()}
    assert got[1] == ("он", True) and got[2] == (None, False) and got[3] == ("a" * 200_000 + "b", True)


@pytest.mark.parametrize("a, b", [("ﬁre", "fire"), ("𝐀bc", "Abc"), ("Ⅷ", "VIII"), ("a\u2028b", "a b"), ("a\x85b", "a b"), ("ɡo", "go"), ("ӀV", "IV"), ("Ａ１，", "A1,"), ("≠", "=\u0338"), ("Å", "Å"), ("ﬀ ﬆ", "ff st"), ("ﾊﾟ", "パ"), ("ⅰ.", "i.")])
def test_equal_looking_forms(a, b):
    assert speller().canonical(a + " door") == speller().canonical(b + " door")


@pytest.mark.parametrize("a, b", [("…", "..."), ("①", "1"), ("x²", "x2"), ("½", "1/2"), ("№", "No"), ("é", "e"), ("A", "a"), ("—", "-"), ("™", "TM"), ("a\nb", "a b")])
def test_different_looking_forms(a, b):
    assert speller().canonical(a) != speller().canonical(b)


def test_pairs_are_counted_as_by_brute_force(spark):
    import unicodedata
    from collections import Counter

    values = ["Тихий дом, café – Ёлка", "Москвa x", "naïve ЁЖ й", "日本 ab", "", "e\u0301te\u0301 b\u200bc", "don't İs", "🙂ok"]
    want = Counter()
    for value in values:
        for token in K.regex.findall(r"[\p{L}\p{M}]+", value):
            letters = [unicodedata.normalize("NFD", c)[0].lower()[:1] for c in token if c.isalpha()]
            scripts = {K._script(unicodedata.normalize("NFD", c)[0]) for c in token if c.isalpha()}
            if len(scripts) == 1 and (script := scripts.pop()) != K.OTHER:
                want.update((script, a, b) for a, b in zip([chr(0), *letters], letters))
    assert {(k, chr(a), chr(b)): n for (k, a, b), n in K.pair_counts(values).items()} == want
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string").repartition(3)
    assert K.fitted(df, "v") == K.fit(values) and K.fitted(df.limit(0), "v") == {}


def test_classes_count_the_pairs(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(K, "CLASS_ROWS", 3)
    forms = ["Орёл", "Оpёл", "Орёл", "Орёл\u200b", "Орел"]
    data = [("f", i, 1, forms[i % 5] if i % 7 else None) for i in range(40)] + [("f", 3, 1, forms[3])] + [("f", 100, None, "дом"), ("f", 101, None, "дoм"), ("f", 102, 2, "дом")]
    values = spark.createDataFrame(data, "fld string, id bigint, s int, _value string")
    held = [(i, s, v) for _, i, s, v in dict.fromkeys(data) if v]
    canon = speller().canonical
    want = {("f", a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and canon(a[2]) == canon(b[2])}
    pairs = [tuple(r) for r in K.alike_pairs(values, ["s"]).collect()]
    assert set(pairs) == want and len(pairs) == len(want) > 100
    links = Counter(i for _, a, b in want for i in (a, b))
    rows = K.alike_classes(values, ["s"]).collect()
    assert {r["id"]: r["n_links"] for r in rows} == links and len(rows) == len(links)
    assert {r["class_id"] for r in rows if r["id"] < 100} == {min(i for i in links if i < 100)} and K.alike_classes(values.limit(0), ["s"]).count() == 0
