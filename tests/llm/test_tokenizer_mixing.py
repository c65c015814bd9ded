import base64
import random
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm import mixing as M
from palimp.llm import tokenizer as K

BPE = K.load(K.DEFAULT_RANKS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.DEFAULT_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_public_library(text):
    ranks = {token: rank for token, rank in BPE.ranks.items()}
    encoding = test_equals_the_public_library.__dict__.setdefault("e", tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=ranks, special_tokens={}))
    text = text.encode("utf-8", "replace").decode()
    assert BPE.encode(text) == encoding.encode_ordinary(text)


def test_scan_and_heap_agree(reference):
    r = random.Random(3)
    for _ in range(200):
        raw = "".join(r.choice("abcтеéー語 ") for _ in range(r.randint(2, 250))).encode()
        if raw not in BPE.ranks:
            assert BPE.scan(raw) == BPE.heap(raw)
    long = "x" * 5000 + "дверь" * 900
    assert BPE.encode(long) == reference.encode_ordinary(long)
    assert BPE.encode("<|endoftext|>") == reference.encode_ordinary("<|endoftext|>")


def test_column(spark):
    df = spark.createDataFrame([(1, "He opened the door.", 3), (2, "", 3), (3, None, 3), (None, "a", 3), (1, "He opened the door.", 3)], "doc_id bigint, text string, ids int")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in K.encode_column(df).collect())
    whole = tuple(BPE.encode("He opened the door."))
    assert got == Counter({(1, whole): 2, (2, ()): 1, (3, ()): 1, (None, tuple(BPE.encode("a"))): 1})
    assert K.encode_column(df.limit(0)).count() == 0


def test_plan():
    plan = M.plan_mixture({"a": 1000, "b": 100, "x": 5}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 3)})
    assert plan["b"]["goal"] == 400 and abs(plan["a"]["goal"] - 666) <= 1 and set(plan) == {"a", "b"}
    more = M.plan_mixture({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 4)}, total=2000)
    assert (more["a"]["goal"], more["b"]["goal"]) == (1000, 400)
    assert M.plan_mixture({}, {"a": (1.0, 1)}) == {}


def test_mixture(spark):
    r = random.Random(1)
    words = ["door", "river", "lantern", "quiet"]
    data = [(i, s, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 5)] + [(900, "a", None), (901, None, "door"), (902, "z", "door"), (903, "b", "")]
    docs = spark.createDataFrame(data, "doc_id bigint, source string, text string").withColumnRenamed("source", "source")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.25, 3), ("c", 0.05, 4), ("none", 0.1, 2), (None, 0.5, 1), ("z", None, 1)], "source string, weight double, max_repeats int")
    mix = M.mix_sources(docs, targets).collect()
    used = Counter((m["doc_id"], m["repeat_no"]) for m in mix)
    assert max(used.values()) == 1 and {m["source"] for m in mix} == {"a", "b", "c"}
    assert all(m["repeat_no"] < {"a": 1, "b": 3, "c": 4}[m["source"]] for m in mix)
    total = sum(m["n_tokens"] for m in mix)
    for source, weight in (("a", 0.7), ("b", 0.25), ("c", 0.05)):
        assert abs(sum(m["n_tokens"] for m in mix if m["source"] == source) / total - weight) < 0.01
    first = sorted(mix, key=lambda m: m["slot"])[: len(mix) // 4]
    assert abs(sum(m["n_tokens"] for m in first if m["source"] == "a") / sum(m["n_tokens"] for m in first) - 0.7) < 0.12
    shares = {s["source"]: s for s in M.mixture_shares(M.mix_sources(docs, targets), docs.select("source"), targets).collect()}
    assert shares["none"]["tokens"] == 0 and abs(sum(s["share"] for s in shares.values()) - 1) < 1e-9


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert M.mix_sources(docs, targets).count() == 0 and M.mix_sources(docs, targets.limit(0)).count() == 0
