import math
import random
import zlib

import numpy as np

from granary.llm import language, queries

SYLLABLES = {"en": ["the", "ing", "th", "wh", "ea", "sh"], "de": ["sch", "ung", "ü", "ein", "ich", "pf"], "fr": ["eau", "que", "é", "oi", "ç", "tre"], "es": ["ción", "ñ", "os", "rr", "ue", "ga"], "xx": ["жы", "ый", "ша", "кро", "ю", "щи"]}


def make(rng, code, n):
    return " ".join("".join(rng.choice(SYLLABLES[code]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, make(rng, code, rng.randrange(5, 80)), code, "s") for i, code in enumerate(rng.choice(list(SYLLABLES)) for _ in range(600))]
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !? ²\n", "de", "s"), (1003, make(rng, "fr", 40_000), None, "s"), (1004, "ü", None, "s")]
    spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [got[i].lang_pred == code for i, _, code, _ in rows if got[i].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "fr"]


def test_nothing_to_learn_from_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    frame = spark.createDataFrame([(1, "abc", None), (None, None, None)], schema)
    assert [(r.lang_pred, r.score) for r in language.identify(frame, language.fit(frame)).collect()] == [("und", 0.0)] * 2
    empty = spark.createDataFrame([], schema)
    assert language.identify(empty, language.fit(empty)).count() == 0
    one = spark.createDataFrame([(1, "abc", "en"), (2, "def", "en")], schema)
    assert {r.lang_pred for r in language.identify(one, language.fit(one)).collect()} == {"en"}


def plain_trigrams(text, buckets):
    """Each trigram's bucket, one character at a time."""
    c = [x if x.isalpha() else " " for x in f"  {text.lower()}  "]
    out = []
    for a, b, d in zip(c, c[1:], c[2:], strict=False):
        if (a, b, d) != (" ", " ", " "):
            h = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(d) * 0xC2B2AE3D & 0xFFFFFFFF)
            out.append((h ^ h >> 15) % buckets)
    return out


def plain_predict(model, text):
    if not any(x.isalpha() for x in text):
        return "und", 0.0
    own = plain_trigrams(text, model.buckets)
    margin = [float(b) + model.scale * sum(float(model.weights[k, m]) for k in own) / len(own) for m, b in enumerate(model.bias)]
    p = [1 / (1 + math.exp(-4 * max(-20, min(20, x)))) for x in margin]
    n = len(model.families)
    f = max(range(n), key=lambda i: p[i]) if n > 1 else 0
    languages = model.families[f][1]
    votes, trust = [0.0] * len(languages), [0.0] * len(languages)
    for a, b, m in model.pairs[f]:
        votes[a if p[m] >= 0.5 else b] += 1
        trust[a] += p[m] / (len(languages) - 1)
        trust[b] += (1 - p[m]) / (len(languages) - 1)
    best = max(range(len(languages)), key=lambda i: votes[i] + 0.5 * trust[i])
    return languages[best], (p[f] if n > 1 else 1.0) * (trust[best] if len(languages) > 1 else 1.0)


def test_predictions_equal_plain_ones_and_models_do_not_depend_on_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(i, make(rng, code, rng.randrange(3, 40)), code) for i, code in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    rows += [(5, "the ing", "en")] * 40 + [(None, "sch ung", "de")] * 40 + [(9, "the", None)]  # repeated rows count once
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = language.fit(frame.coalesce(1), sample=150), language.fit(frame.repartition(5, F.rand(1)), sample=150)
    assert (one.weights == many.weights).all() and (one.bias == many.bias).all() and one.families == many.families
    texts = [t for _, t, _ in rows[:120]] + ["", "12 !", "ü", "The ING-the 5 th", "a\u0301 x" * 30]
    names, scores = one.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        want = plain_predict(one, text)
        assert name == want[0] and abs(score - want[1]) < 1e-4


def test_machines_reach_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    y = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=80) > 0.4, 1, -1).astype(np.float32)
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    loss = lambda w, b: (each * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 0.5e-4 * (w * w).sum()
    w, b = np.zeros(6), 0.0
    for _ in range(20_000):  # plain gradient steps
        short = np.maximum(0, 1 - y * (x @ w + b)) * each * y
        w, b = w + 0.05 * (2 * x.T @ short - 1e-4 * w), b + 0.1 * short.sum()
    own = language.Rows(np.full(80, 6), np.tile(np.arange(6), 80), x.ravel(), 6)
    assert loss(*language._machine(own, y)) < 1.01 * loss(w, b) + 1e-4
