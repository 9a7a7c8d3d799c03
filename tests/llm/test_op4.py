import random

import numpy as np

from granary.llm import grade, queries


def make(rng, kind, n):
    words = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    if kind == 0:
        for _ in range(3):
            words[rng.randrange(n)] = "vexol" + rng.choice(["ia", "um", "er", "os"])
    return " ".join(w + rng.choice("%&$#") * 3 for w in words) if kind == 1 else " ".join(words)


def test_held_out_grades_and_edge_cases(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, make(rng, i % 3, rng.randrange(20, 200)), i % 3) for i in range(1500)]
    odd = [(5000, None), (5001, ""), (5002, make(rng, 2, 30_000)), (5003, make(rng, 0, 20_000)), (5004, "\x01upper0")]
    spark.createDataFrame([(*r[:2], "c", 1.0) for r in rows + odd], "doc_id long, text string, grade string, tail double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(g == 2), int(g == 0)) for i, _, g in rows] + [(7, 0, 1), (5000, None, 0), (5001, 1, None), (None, 1, 1), (99_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op4_grade(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 and r.kept == (r.p_good >= 0.2) for r in got.values())
    held = [(g, got[i]) for i, _, g in rows if got[i].held_out and i != 7]
    assert len(held) > 200 and np.mean([r.kept == (g == 2) for g, r in held]) > 0.97
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert got[5002].kept and not got[5003].kept


def test_thresholds_are_ordered_and_tails_fall(spark):
    rng = np.random.default_rng(1)
    latent = rng.normal(size=900) * 3
    y = np.digitize(latent + rng.logistic(size=900), [-1.0, 0.5, 2.0])
    w, theta = grade._descend(np.arange(900), np.digitize(latent, np.linspace(-4, 4, 9)), 900, 10, y, np.full(900, 1 / 900), 4, 1e-5, 400)
    assert (np.diff(theta) > 0).all() and (np.diff(w) > -0.5).all()
    tails = grade.Model(np.zeros(0), np.zeros(0), theta).tails(np.array([-1.0, 0.0, 1.0]))
    assert (np.diff(tails, axis=1) < 0).all() and (np.diff(tails, axis=0) > 0).all()


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert all(r.kept for r in grade.rate(docs, grade.fit(docs, none), 2).collect())
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 7)], "doc_id long, grade int")
    assert grade.rate(docs.limit(0), grade.fit(docs, one), 2).count() == 0


def plain_fit(x, y, weight, grades, penalty, rounds=40_000):
    """Weights and thresholds of the same loss over a dense matrix, by plain gradient steps."""
    n, m = x.shape
    w, theta = np.zeros(m), np.linspace(-1, 1, grades - 1)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        latent = x @ w
        upper = np.where(y < grades - 1, sig(theta[np.minimum(y, grades - 2)] - latent), 1.0)
        lower = np.where(y > 0, sig(theta[np.maximum(y - 1, 0)] - latent), 0.0)
        p = upper - lower
        up, down = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        w = w - 0.5 * (x.T @ (up - down) + penalty * w)
        theta = theta - 0.5 * np.array([-up[y == j].sum() + down[y == j + 1].sum() for j in range(grades - 1)])
    return w, theta


def test_regression_equals_a_dense_one():
    rng = np.random.default_rng(4)
    x = (rng.random((200, 6)) < 0.4).astype(float)
    y = np.digitize(x @ np.array([2.0, -1, 0.5, 0, 1, -2]) + rng.logistic(size=200), [-0.5, 1.0])
    weight = np.full(200, 1 / 200)
    rows, cols = np.nonzero(x)
    w, theta = grade._descend(rows, cols, 200, 6, y, weight, 3, 1e-3, 3000)
    want_w, want_theta = plain_fit(x, y, weight, 3, 1e-3)
    assert np.abs(w - want_w).max() < 0.05 and np.abs(theta - want_theta).max() < 0.05


def test_scores_equal_plain_ones_and_models_do_not_depend_on_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, make(rng, i % 3, rng.randrange(10, 60))) for i in range(300)] + [(3, "another text"), (3, "another text"), (400, None)]
    ratings = [(i, i % 3) for i in range(300)] + [(5, 0), (5, 1), (5, 2), (6, 2), (400, 1)]  # of conflicting ones the lowest holds
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, grade int")
    one = grade.fit(docs.coalesce(1), rated.coalesce(1), sample=180)
    many = grade.fit(docs.repartition(5, F.rand(1)), rated.repartition(3, F.rand(2)), sample=180)
    assert (one.at == many.at).all() and np.allclose(one.weights, many.weights) and len(one.at) > 5
    weight, features = dict(zip(one.at.tolist(), one.weights.tolist(), strict=True)), grade.Features()
    got = sorted((r.doc_id, r.expected_grade, r.tail, r.kept) for r in grade.rate(docs, one, tail=2, least=0.4).collect())
    want = []
    for i, t in rows:
        latent = sum(weight.get(b, 0.0) for b in features(t or ""))
        tails = [1 / (1 + np.exp(theta - latent)) for theta in one.thresholds]
        want.append((i, sum(tails), tails[1], tails[1] >= 0.4))
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:3] for g in got], [w[1:3] for w in want]) and [g[3] for g in got] == [w[3] for w in want]
