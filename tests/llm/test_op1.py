import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import lm, queries


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\n"]


def corpus(rng):
    languages = [[f"{p}{rng.randrange(60)}{s}" for _ in range(80)] for p, s in (("a", "ung"), ("B", "tion"), ("é", "eau"))]
    rows = [(i, " ".join(rng.choices(w, [1 / (k + 1) for k in range(len(w))], k=rng.randrange(5, 120)))) for i, w in ((i, rng.choice(languages)) for i in range(900))]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "x" * 50_000), (2004, "unseen " * 20_000), (2005, "\x1c Ä\x0bß")]


def test_query_counts_are_exact_and_the_model_beats_counts(spark, tmp_path):
    rows = corpus(random.Random(1))
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, token string, block int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_log_bilinear(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        own = tokens(t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert got[i].score < 0
    own = [got[i] for i, _ in rows[:900] if held[i]]
    assert len(own) > 80 and sum(r.score for r in own) > 0.95 * sum(r.base_score for r in own)


def model_of(setup, counts, bounds):
    share = (np.asarray(counts, float) + 1) / (np.asarray(counts, float) + 1).sum()
    return lm.Model.start(share, np.array(bounds), setup), share


def plain_log10(m, c, target):
    """Each unit's log-probability, one context at a time in double precision."""
    out = []
    for own, w in zip(c.tolist(), target.tolist(), strict=True):
        p = sum(m.C[j].astype(float) * m.R[u].astype(float) for j, u in enumerate(own))
        k = max(x for x in range(len(m.P)) if m.bounds[x] <= w)
        lo, hi = m.bounds[k], m.bounds[k + 1]
        s, t = m.P.astype(float) @ p + m.d, m.Q[lo:hi].astype(float) @ p + m.b[lo:hi]
        out.append((s[k] - np.logaddexp.reduce(s) + t[w - lo] - np.logaddexp.reduce(t)) / math.log(10))
    return np.array(out)


def test_probabilities_add_up_to_one_over_units():
    setup = lm.Setup(words=5, endings=4, rest=2, context=4)
    model, _ = model_of(setup, range(11, 0, -1), [0, 1, 4, 11])
    context = np.array([[1, 2, 3, 4]] * 11, np.int32)
    p = 10 ** model.log10(context, np.arange(11))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_production_looks_back_four_units_and_draws_64_noise_samples():
    setup = lm.Setup()
    assert (setup.context, setup.noise, setup.units) == (4, 64, 4096)
    model, share = model_of(setup, np.ones(setup.units), range(0, 4097, 64))
    c = lm.contexts(np.array([7, 1, 2, 3, 4, 8, 1, 2, 3, 4]), np.array([5, 5]), 0, setup.context)[[4, 9]]
    one, other = model.log10(c, np.array([4, 4]))
    assert abs(one - other) > 1e-5
    trainer = lm.Trainer(model, share, setup, 1)
    assert np.exp(trainer.log_class).sum() == pytest.approx(64, rel=1e-3) and np.exp(trainer.log_unit[:64]).sum() == pytest.approx(16, rel=1e-3)


def test_batched_log_probabilities_equal_plain_ones():
    setup = lm.Setup(words=20, endings=8, rest=4)
    rng = np.random.default_rng(5)
    model, _ = model_of(setup, range(32, 0, -1), [0, 1, 3, 10, 32])
    c, target = rng.integers(0, 32, (3000, 4)).astype(np.int32), rng.integers(0, 32, 3000)
    for scale in (1, 40):  # without and with scores that could overflow
        model.R *= np.float32(scale)
        assert model.log10(c, target) == pytest.approx(plain_log10(model, c, target), abs=2e-3)


def test_contrastive_steps_learn_a_pattern():
    setup = lm.Setup(words=4, endings=3, rest=1, batch=64, noise=8)
    rng = np.random.default_rng(3)
    units = np.cumsum(rng.choice([1, 1, 1, 2], 6000)) % 8
    model, share = model_of(setup, np.bincount(units, minlength=8), [0, 1, 3, 8])
    c = lm.contexts(units, np.array([6000]), 0, setup.context)
    before = model.log10(c, units).mean()
    trainer = lm.Trainer(model, share, setup, 1)
    for _ in range(10):
        trainer.learn(c, units)
    assert model.log10(c, units).mean() > before + 0.3


def test_a_weight_counts_as_so_many_equal_units():
    setup = lm.Setup(words=4, endings=3, rest=1, batch=64, noise=8)
    made = []
    for copies in (1, 3):
        model, share = model_of(setup, range(8, 0, -1), [0, 1, 3, 8])
        trainer = lm.Trainer(model, share, setup, 1)
        c, w = np.array([[0, 1, 2, 3], [4, 5, 6, 7]] * copies, np.int32), np.array([3, 5] * copies)
        trainer.learn(c, w, np.full(2, 3.0) if copies == 1 else None)
        made.append(trainer.m.flat())
        assert trainer.seen == 6
    assert made[0] == pytest.approx(made[1], abs=1e-5)


def test_scores_are_those_of_the_model_and_do_not_depend_on_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = corpus(random.Random(4)) + [(7, "a again"), (7, "a again"), (None, "b b")]
    held, kept = queries.held_out("doc_id", 7), {}
    choose, train = lm.choose_units, lm.train
    monkeypatch.setattr(lm, "choose_units", lambda *a: kept.setdefault("units", choose(*a)))
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", train(*a)))
    setup = lm.Setup(words=60, endings=40, rest=4, classes=8, replica_tokens=8_000, warm_up_tokens=4_000, block_chars=40_000)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens), r.score) for r in lm.score(frame.coalesce(1), held, setup).collect())
    units, model = kept["units"], kept["model"]
    kept.clear()
    many = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens), r.score) for r in lm.score(frame.repartition(6, F.rand(3)), held, setup).collect())
    assert [k for k, _ in one] == [k for k, _ in many] and [s for _, s in one] == pytest.approx([s for _, s in many], rel=1e-9)
    count = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    kinds = Counter()
    room = Counter()

    def unit(w):
        if w.encode() in units.words:
            return units.words[w.encode()]
        bare = re.sub(r"(?:(?!_)\W|_)+$", "", w)
        return units.endings.get(f"{bare[-3:]}\n{w[len(bare) : len(bare) + 1]}")

    for w, n in count.items():
        kinds[unit(w)] += 1
        room[unit(w)] += n
    checked = 0
    scores = dict(one)
    for i, t in rows[:60]:
        own = [unit(w) for w in tokens(t)]
        if None in own:  # a remainder, whose unit is a hash
            continue
        c = np.array([[own[j - d] if j >= d else units.end for d in range(1, 5)] for j in range(len(own))])
        inner = sum(0 if w.encode() in units.words else math.log10((count[w] + 1) / (room[u] + kinds[u] + 1)) for w, u in zip(tokens(t), own, strict=True))
        assert scores[i, len(own)] == pytest.approx(plain_log10(model, c, np.array(own)).sum() + inner, rel=1e-3)
        checked += 1
    assert checked > 10


def test_blocks_agree_with_one_block_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = corpus(random.Random(2))[:200] + [(None, "a b"), (None, "a b"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    never = F.lit(False)
    one, many = (sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6)) for r in lm.score(frame, never, lm.Setup(block_chars=c)).collect()) for c in (10**9, 5000))
    assert one == many and len(one) == 204
    assert lm.score(frame.limit(0), never).count() == 0
    assert lm.score(frame, F.lit(True)).where("n_known > 0").count() == 0
    broken = frame.limit(1).select("doc_id", F.expr("cast(X'61FF62' as string)").alias("text"))
    assert lm.score(broken, never).first().n_tokens == 2
