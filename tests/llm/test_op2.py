import numpy as np

from granary.llm import lattice, queries


def brute(rows, least=0.98):
    unit = {}
    for n, (i, vector, label) in enumerate(rows):
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            v = np.array(vector, float)
            unit[n] = v / np.linalg.norm(v)
    label, links = {n: n for n in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in unit:
        for b in unit:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least_id = {}
    for n in range(len(rows)):
        least_id[find(n)] = min(least_id.get(find(n), 1 << 60), rows[n][0])
    return {rows[n][0]: (links[n], least_id[find(n)], least_id[find(n)] == rows[n][0]) for n in range(len(rows))}


def table():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        base = rng.normal(size=32)
        for k in range(6):
            noisy = base + rng.normal(size=32) * (0.0, 0.0, 0.1, 0.12, 0.3, 1.0)[k]
            rows.append([float(x) for x in (noisy * (1 + k)).astype(np.float32)])
    rows += [[0.0] * 32, None, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0] * 31, [1.0] * 32, [1.0] * 32, [2.0] * 32, [], [1e38] * 32]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[n], int(n) // 12 % 2) for i, n in enumerate(order)]
    return rows + [(1000, [1.0] * 32, None), (1001, [1.0] * 32, 7)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, class string, t int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_lattice(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) > 100


def test_blocks_of_a_large_bucket_count_each_pair_once(spark, monkeypatch):
    from granary.llm import common

    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.02], 1) for i in range(90)]
    plain = common.in_buckets
    monkeypatch.setattr(common, "in_buckets", lambda *a: plain(*a, most=16))
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component) for r in got} == {i: w[:2] for i, w in want.items()}


def test_decoded_points_are_the_nearest():
    rng = np.random.default_rng(1)
    steps = lattice.shortest()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    own = ((x - p) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()
    assert (own[:, None] <= ((x[:, None] - (p[:, None] + steps[None])) ** 2).sum(2) + 1e-9).all()


def test_empty_table_and_null_keys(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert lattice.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = lattice.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], schema)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component) for r in got) == [(False, 1, 4), (False, 1, 4), (True, 0, None)]
