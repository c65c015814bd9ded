import random

import pytest

from palimp.llm import encoding as E

RU = ["Медленно тихий капитан открыл старый дверь, и никто видел река.", "Она вспомнил бледный фонарь под мост, а он нёс письмо.", "Никогда далёкий колокол слышал её голос… — спросил Орел.", "Я перешёл узкий дорога около башня, потому она сжёг карта."]
EN = ["The quiet captain opened the old door, and nobody watched the river.", "“He carried a lantern,” said Orel. She didn’t remember the bridge…", "Their voice crossed a naïve café — slowly."]
DE = ["Der müde Kapitän öffnete die Tür während der Fluss größer war.", "„Sie hörte die Straße“, fragte Orel."]
FR = ["La rivière était près de la forêt, où l’étranger répondait déjà à l’été."]


@pytest.fixture(scope="module")
def repairer():
    return E.Repairer(E.fit((RU + EN + DE + FR) * 20))


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp1250"])
@pytest.mark.parametrize("text", RU + EN[1:] + DE + FR)
def test_multi_byte_round_trip(repairer, text, read_as):
    seen = "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in text.encode())
    found, restored, _ = repairer.repair(seen)
    assert found
    if all(bytes([b]).decode(read_as, "ignore") for b in text.encode()) or read_as in ("cp1252", "cp1250"):
        assert restored == text


@pytest.mark.parametrize("pair", [("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251")])
def test_single_byte_round_trip(repairer, pair):
    for text in RU[:2]:
        seen = text.encode(pair[0]).decode(pair[1])
        assert repairer.repair(seen)[:2] == (True, text)
        mixed = RU[1] + "\n" + seen
        assert repairer.repair(mixed)[1] == RU[1] + "\n" + text


def as_seen(text, pair):
    try:
        return text.encode(pair[0]).decode(pair[1])
    except UnicodeError:
        return text


@pytest.mark.parametrize("pair", E.SINGLE_BYTE)
def test_every_single_byte_pair_round_trips(repairer, pair):
    texts = [t for t in [*RU[1:3], *DE, *FR, "La rivière était près de la forêt, déjà."] if as_seen(t, pair) != t]
    assert texts
    for text in texts:
        assert repairer.repair(as_seen(text, pair))[:2] == (True, text)


@pytest.mark.parametrize("text", ["§ 12 ¶ 3 · 4° ± 2 µm ½ × ¼ ÷ ³", "αβγ Σ π ≤ ≥ Ω Θ ∞ √", "* • ¤ ¬ ¦ µ", "Љубав и Њујорк, Ђорђе Ћирић Џон", "Příliš žluťoučký kůň úpěl ďábelské ódy.", "Zażółć gęślą jaźń, a potem wróć do łóżka.", "Árvíztűrő tükörfúrógép, őrült hűség."])
def test_symbols_and_other_alphabets_stay(repairer, text):
    assert repairer.repair(text) == (False, text, [])


@pytest.mark.parametrize("gap", ["\t", "—", "-"])
def test_garbled_words_joined_to_clean_ones(repairer, gap):
    clean = gap.join("Медленно тихий капитан открыл старый дверь".split())
    words = "письмо под мост".split()
    seen = gap.join([clean, *(as_seen(w, ("koi8-r", "cp1251")) for w in words)])
    assert repairer.repair(seen)[:2] == (True, gap.join([clean, *words]))


@pytest.mark.parametrize("text", ["Он держал письмо\xa0ЙНЦДЮ НМХ", "Он держал письмо ЙНЦДЮ\xa0НМХ", "Он держал письмо\xa0ЙНЦДЮ\xa0НМХ"])
def test_garbled_words_behind_a_no_break_space(repairer, text):
    assert repairer.repair(text)[:2] == (True, text.replace("ЙНЦДЮ", "когда").replace("НМХ", "они"))


@pytest.mark.parametrize("pair", E.SINGLE_BYTE)
def test_states_of_a_line(repairer, pair):
    """Every distinct reading that pays for its entry is tried, and each once."""
    for text in [RU[1], RU[2], DE[0], "La rivière était près de la forêt, déjà."]:
        seen = as_seen(text, pair)
        if seen != text:
            active = repairer.active(seen)
            assert text in [repairer.read(k, seen) for k in active]
            single = [tuple(repairer.singles[k].get(c) for c in seen if c >= "\x80") for k in active if repairer.states[k][0] != "utf-8"]
            assert len(single) == len(set(single))


def test_in_places_and_twice(repairer):
    seen = EN[1].replace("“", "â€œ").replace("’", "â€™")
    assert repairer.repair(seen)[1] == EN[1]
    twice = RU[0].encode().decode("latin-1").encode().decode("latin-1")
    assert repairer.repair(twice)[:2] == (True, RU[0])


@pytest.mark.parametrize("text", [None, "", " ", *RU, *EN, *DE, *FR, "12 × 18 cm", "½ · ¾ × ² = ±", "Привет мир", "co­ope­ra­tion", "Þ og Ð", "日本語の題名", "Σ ὀδύσσεια", "عنوان", "SÃO TOMÉ, NÃO", "Ő Ű Č Ř", "—Él dejó la puerta.", "£ 3", "🙂👩‍🚀"])
def test_clean_text_stays(repairer, text):
    assert repairer.repair(text) == (False, text, [])


def test_lost_characters_are_found(repairer):
    assert repairer.repair("T�r")[0]


def test_table(spark):
    bad = RU[0].encode().decode("cp1251")
    data = [(i, random.Random(i).choice(RU + EN + DE), "x", False) for i in range(300)] + [(1000, bad, "x", True), (1001, None, "x", True), (1002, "", "x", True), (None, bad, "x", True), (1000, bad, "x", True), (1003, "a�", "x", True), (1004, (RU[1] + " ") * 3000 + bad, "x", True)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, restored string, garbled boolean")
    got = E.repair_encoding(df)
    assert got.count() == len(data)
    found = {(r["doc_id"], r["complete"]) for r in got.filter("garbled").collect()}
    assert found == {(1000, True), (None, True), (1003, False), (1004, True)}
    assert got.filter("doc_id = 1000").first()["restored"] == RU[0]
    assert got.filter("doc_id = 1004").first()["restored"] == (RU[1] + " ") * 3000 + RU[0]
    assert E.repair_encoding(df.limit(0)).count() == 0


@pytest.mark.parametrize("read_as", ["cp1252", "cp1251", "mac_roman", "koi8-r"])
def test_bounds_leave_out_no_state_that_the_best_path_enters(repairer, read_as):
    """Labelling with the states that can pay for their entry gives what labelling with all of them does."""
    r = random.Random(3)
    every = [k for k in range(len(repairer.states)) if repairer.states[k][0] == "utf-8"]
    for _ in range(25):
        words = r.choice(RU + EN + DE + FR + ["—Él dejó la puerta.", "Річка і гора"]).split()
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(words))
            words[at] = "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in words[at].encode())
        line = " ".join(words)
        active = [k for k in repairer.active(line) if k in every]
        score = lambda spans: sorted((a, b, x) for a, b, _, x in spans)
        assert score(repairer.label(line, active)) == score(repairer.label(line, every))


def test_deeply_garbled_text(repairer):
    seen = RU[0]
    for _ in range(7):
        seen = seen.encode().decode("latin-1")
    assert repairer.repair(seen)[1] == RU[0]


def test_lost_characters_leave_the_rest_to_be_restored(repairer):
    garbled = RU[1].encode().decode("latin-1")
    found, restored, pairs = repairer.repair(f"{garbled}\n{RU[0][:9]}�{RU[0][10:]}")
    assert found and restored == f"{RU[1]}\n{RU[0][:9]}�{RU[0][10:]}" and pairs == ["utf-8 as latin-1"]
    assert repairer.repair("�")[0] and repairer.repair("a��b �")[:2] == (True, "a��b �")


def test_pairs_are_counted_as_by_brute_force(spark):
    from collections import Counter

    texts = [*RU, *EN, *DE, *FR, "", "  ", "日本 он x", "Ab\xa0ab\nя", "🙂 да"]
    letters, _ = E._codes()
    want = Counter()
    for text in texts:
        for token in text.split():
            if E.EXPECTED.fullmatch(token):
                token = f" {token.lower()} "
                want.update(zip(token, token[1:]))
    n = len(letters) + 1
    got = {(letters[k // n - 1], letters[k % n - 1]): v for k, v in enumerate(E.pair_counts(texts)) if v}
    assert got == want
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    assert E.fitted(df, "t") == E.fit(texts) and E.fitted(df.limit(0), "t") == {}
