import random
from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm import splitting as S
from palimp.llm import terms as K


def test_terms_match_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["Дверь", "дверь", "don't", "don’t", "well-worn", "--", "x1y", "Ёж", "a'", "straße"]
    records = {(b, p): r.choice(["", "  ", None, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))]) for b in range(3) for p in range(12)}
    data = [(b, p, t, "z") for (b, p), t in records.items()] + [(0, 0, records[0, 0], "z")] * 3
    df = spark.createDataFrame(data, "book_id bigint, pos int, text string, term string")
    occurs, present = Counter(), Counter()
    held = [t for t in records.values() if t and t.strip()]
    for t in held:
        found = [x.lower().replace("’", "'") for x in regex.findall(K.TERM, t)]
        occurs.update(found)
        present.update(set(found))
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in K.mark_terms(df, ["book_id", "pos"]).collect()}
    assert {t: g[:2] for t, g in got.items()} == {t: (occurs[t], present[t]) for t in occurs}
    for t, g in got.items():
        assert g[2] == ("rare" if g[0] <= 2 else "common" if g[1] > 0.35 * len(held) else None)
    ids = [r["term_id"] for r in K.term_table(df, ["book_id", "pos"]).collect()]
    assert len(set(ids)) == len(ids)
    assert K.mark_terms(df.limit(0), ["book_id", "pos"]).count() == 0


def test_ranges_carry_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "RANGE", 3)
    r = random.Random(6)
    want, packed = Counter(), []
    for _ in range(4):  # blocks, each with sorted rows in batches of any size
        rows = sorted((r.randrange(0, 20), r.randint(1, 9)) for _ in range(r.randint(1, 25)))
        want.update({i: sum(n for j, n in rows if j == i) for i, _ in rows})
        cuts = [0, *sorted(r.sample(range(len(rows) + 1), min(2, len(rows)))), len(rows)]
        batches = [pa.RecordBatch.from_pydict({"term_id": [i for i, _ in rows[x:y]], "n_occurrences": [n for _, n in rows[x:y]], "n_records": [1] * (y - x)}) for x, y in zip(cuts, cuts[1:]) if x < y]
        packed += [row for b in K._arrays(iter(batches)) for row in b.to_pylist()]
    assert all(0 <= p < 3 for row in packed for p in row["at"])
    packed.sort(key=lambda row: row["part"])
    kinds = pa.schema([("part", pa.int64()), ("at", pa.list_(pa.int32())), ("n_occurrences", pa.list_(pa.int64())), ("n_records", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist(packed[x : x + 4], schema=kinds) for x in range(0, len(packed), 4)]
    got = {row["term_id"]: row["n_occurrences"] for b in K._sum_ranges(iter(batches)) for row in b.to_pylist()}
    assert got == dict(want)


def test_identifiers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{'abcdefghij'[i % 10]}{'xyz'[j]}" for j in range(3))) for i in range(40)] + [(1, "b a"), (None, "zz"), (None, "zy")], "k int, text string").repartition(7)
    rows = sorted(K.term_table(df, ["k"]).collect())
    assert [r["term_id"] for r in rows] == list(range(len(rows))) and [r["term"] for r in rows] == sorted(r["term"] for r in rows)
    held = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in rows}
    # key 1 has two texts and the null key too: the smaller counts
    assert held["a"] == held["b"] == (1, 1) and held["zy"] == (1, 1) and "zz" not in held and held["wax"] == (4, 4) and held["wbx"] == (3, 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=0, max_size=6), min_size=1, max_size=12), st.integers(5, 40))
def test_pieces_cover_the_chunk_in_order_under_the_limit(shape, limit):
    r = random.Random(4)
    texts = [" ".join(" ".join(r.choice(["door", "river", "fire", "moth"]) for _ in range(n - 1)) + " end." for n in p).strip() for p in shape]
    pieces = S.split_chunk(list(range(len(texts))), texts, limit)
    words = " ".join(texts).split()
    if len(words) <= limit:
        assert pieces == []
        return
    assert " ".join(p["text"] for p in pieces).split() == words
    assert all(p["word_count"] <= limit and len(p["text"].split()) == p["word_count"] for p in pieces)
    longest = max(len(t.split()) for t in texts)
    sentence = max(len(s.split()) for t in texts for s in S.sentences(t) or [""])
    assert {p["cut_level"] for p in pieces} == {"paragraph" if longest <= limit else "sentence" if sentence <= limit else "word"}
    assert pieces[0]["prev_overlap"] == [] and pieces[-1]["next_overlap"] == []
    for a, b in zip(pieces, pieces[1:]):
        assert a["next_overlap"] == [b["para_idx"][0]] and b["prev_overlap"] == [a["para_idx"][-1]]
        head = a["next_text"].split()
        assert b["text"].split()[: len(head)] == head


def test_cut_prefers_the_deepest_valley():
    topic = lambda words: [words.split() for _ in range(5)]
    units = topic("ship sail sea wind wave deck mast rope crew port") + topic("bread oven flour salt yeast dough crust heat bake slice")
    assert S.cut(units, 70)[0] == (0, 5)


def test_table(spark):
    long = " ".join(["word"] * 200)
    chunks = spark.createDataFrame([(1, "c1", 0, [0, 1], 5, "x")] * 2 + [(1, "c2", 0, [2], None, "x"), (1, None, 0, [0], 1, "x"), (1, "c3", 0, None, 1, "x"), (1, "c4", 0, [1, 7], 400, "x")], "book_id bigint, chunk_id string, chapter_idx int, para_idx array<int>, word_count bigint, text string")
    paragraphs = spark.createDataFrame([(1, 0, 0, "He came. " * 60), (1, 0, 1, "Short one."), (1, 0, 1, "Short one."), (1, 0, 2, long), (1, 0, 3, None)], "book_id bigint, chapter_idx int, para_idx int, text string")
    got = S.split_oversized(chunks, paragraphs).collect()
    assert {(r["chunk_id"], r["cut_level"]) for r in got if r["piece_no"] == 0} == {("c2", "word")}
    assert S.split_oversized(chunks, paragraphs, 100).filter("chunk_id = 'c1' and piece_no = 0").first()["cut_level"] == "sentence"
    first = next(r for r in got if r["piece_no"] == 0)
    assert first["prev_overlap"] == [1] and first["prev_text"] == "Short one."
    assert S.split_oversized(chunks.limit(0), paragraphs.limit(0)).count() == 0
