"""Problems 8, 9 and 10."""

import base64
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, canonical, mixture

DOCS = "doc_id long, text string, source string, form string, tokens int"
V = bpe.Vocabulary.read(bpe.VOCABULARY)


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE = reference()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abe é<|endoftext>0\n", max_size=300)), max_size=8))
def test_bpe_equals_the_public_tokenizer(texts):
    assert bpe.Encoder(V)([*texts, None, ""]) == [REFERENCE.encode_ordinary(t) for t in texts] + [[], []]


def test_bpe_long_words():
    r = random.Random(8)
    for w in ("a" * 5000, "".join(r.choice("abcdefgh") for _ in range(20000)), "é" * 3000):
        assert bpe.merge_long(w.encode(), V) == REFERENCE.encode_ordinary(w)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 3) for i, t, s in rows], DOCS)


def test_bpe_column(spark):
    d = docs(spark, [(1, "It's <|endoftext|> 12", "a"), (2, None, "a"), (3, "", "a"), (4, "x" * 70000, "a")])
    got = {r[0]: r[1] for r in d.select("doc_id", bpe.encoded(spark, d["text"])).collect()}
    assert got == {1: REFERENCE.encode_ordinary("It's <|endoftext|> 12"), 2: [], 3: [], 4: REFERENCE.encode_ordinary("x" * 70000)}
    assert [r[0] for r in d.orderBy("doc_id").select(bpe.encoded(spark, d["text"], count_only=True)).collect()] == [len(got[i]) for i in (1, 2, 3, 4)]
    assert d.where("false").select(bpe.encoded(spark, d["text"])).count() == 0


def plain_form(t):
    like = canonical.CYRILLIC | canonical.GREEK
    out = []
    for c in unicodedata.normalize("NFD", t):
        o = ord(c)
        if unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F:
            continue
        c = chr(o - 0xFEE0) if 0xFF01 <= o <= 0xFF5E else " " if unicodedata.category(c) == "Zs" else c
        out.append(like.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def test_forms(spark):
    texts = ["Straße", "Сafé", "ｆｕｌｌ　width", "a​b­c﻿", "x y z", "Ёлка ёж й", "Ά ΟΚ Νο", "'quo''te'", "tab\tline\nend", "\U0001f469‍\U0001f52c️", "", None, "ệ", "ệ", "Ή \u0397\u0301", "Ἂ\u200b \u0391\u0313\u0300 A\u0313\u0300", "Ў \u0423\u0306"]
    got = {r[0]: r[1] for r in canonical.forms(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: None if t is None else plain_form(t) for i, t in enumerate(texts)}
    assert [len(set(got[i].split(" "))) for i in (14, 15, 16)] == [1, 1, 1] and got[14][0] == "H"
    assert got[1] == "Café" and got[2] == "full width" and got[3] == "abc" and got[12] == got[13]
    again = canonical.forms(docs(spark, [(i, t, "s") for i, t in got.items()])).collect()
    assert {r[0]: r[1] for r in again} == got


def test_look_alikes(spark, scratch):
    rows = [(1, "pay", "s"), (2, "рау", "s"), (3, "pay", "s"), (4, "Pay", "s"), (5, "pay!", "s"), (6, "​  ", "s"), (7, " ", "s"), (8, None, "s"), (9, "ｐay", "s"), (10, "", "s")]
    got = {tuple(r) for r in canonical.found(docs(spark, rows), scratch).collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    assert canonical.found(docs(spark, []), scratch).count() == 0


TARGETS = "source string, target_share double, max_repeat int"


def test_mixture(spark, scratch):
    r = random.Random(9)
    rows = [(i, "word " * r.randrange(1, 60), r.choice(["big"] * 8 + ["mid", "mid", "small"])) for i in range(1500)] + [(9000, None, "small"), (9001, "", "mid"), (9002, "x y", None), (9003, "long " * 4000, "big"), (9004, "z", "extra")]
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.1, 2)], TARGETS)
    sized = mixture.sizes(docs(spark, rows), scratch)
    plan = mixture.plan(sized, t)
    got = mixture.mixture(sized, plan, scratch).collect()
    most = {"big": 1, "mid": 3, "small": 4}
    uses, tokens = {}, {}
    for x in got:
        uses[x["source"], x["doc_id"]] = uses.get((x["source"], x["doc_id"]), 0) + 1
        tokens[x["source"]] = tokens.get(x["source"], 0) + x["tokens"]
    assert all(n <= most[s] for (s, _), n in uses.items()) and set(tokens) == set(most)
    whole = sum(tokens.values())
    assert all(abs(tokens[s] / whole - w / 0.9) < 0.01 for s, w in (("big", 0.4), ("mid", 0.3), ("small", 0.2)))
    assert [x["position"] for x in got] == sorted(x["position"] for x in got) and 0 <= got[0]["position"] and got[-1]["position"] < 1
    rep = {x["source"]: x.asDict() for x in mixture.report(mixture.mixture(sized, plan, scratch), plan).collect()}
    assert set(rep) == {"big", "mid", "small", "absent", "extra", None}
    assert rep["absent"]["tokens"] == 0 and rep["absent"]["target_share"] == 0.1 and rep["big"]["tokens"] == tokens["big"] and rep[None]["uses"] == 0


def test_mixture_follows_its_schedule(spark, scratch):
    rows = [(i, "one two three", "ab"[i % 2]) for i in range(4000)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    sized = mixture.sizes(docs(spark, rows), scratch)
    got = mixture.mixture(sized, mixture.plan(sized, t, {"a": [3, 1], "b": [1, 3]}), scratch).collect()
    early = [x["source"] for x in got if x["position"] < 0.5]
    assert abs(early.count("a") / len(early) - 0.75) < 0.02


def test_mixture_of_nothing(spark, scratch):
    t = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, None)], TARGETS)
    sized = mixture.sizes(docs(spark, []), scratch)
    plan = mixture.plan(sized, t)
    assert mixture.mixture(sized, plan, scratch).count() == 0
    assert [x["tokens"] for x in mixture.report(mixture.mixture(sized, plan, scratch), plan).collect()] == [0]
