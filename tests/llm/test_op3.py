import random
import re

import numpy as np
import xxhash

from granary.llm import queries, simhash


def brute(rows, distance=3):
    fps = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= distance:
                    label[a] = label[b] = min(label[a], label[b])
    least = {k: min(i for (i, _), x in zip(rows, label, strict=True) if x == k) for k in set(label)}
    return {i: (f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, fps, label, strict=True)}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(300)]
    texts = [None, "", "  \n", "one", "ONE two", "one two", "x" * 200_000, "Ä b\x0bc\x1cd e"]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for k in range(4):  # a chain of slight changes
            texts.append(" ".join(words))
            words[rng.randrange(400)] = f"n{k}"
        texts.append(" ".join(words[:200]))
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_empty_table_and_null_keys(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q")], schema)).collect()
    assert sorted((r.doc_id is None, r.component or 0) for r in got) == [(False, 5), (False, 5), (True, 0), (True, 5)]


def test_large_buckets_are_dealt_in_blocks(spark):
    from granary.llm import common

    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) for a in range(60)} | {base} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    rows = spark.createDataFrame([(f, i, 1, True) for i, f in enumerate(fps)], "fp long, rep long, bucket long, own boolean")
    edges = common.in_buckets(rows, "bucket", "rep", simhash._links(3), "a long, b long", len(fps), most=10)
    got = {r.node: r.component for r in common.components(edges).collect()}
    ball = [i for i, f in enumerate(fps) if (f ^ base).bit_count() <= 1]
    assert got == {i: ball[0] for i in ball}


def test_thresholds_follow_costs_and_keep_the_sum():
    assert simhash.allocate([[0, 1, 5, 50], [0, 9, 90, 900], [0, 1, 2, 3]], 1) == [0, -1, 2]
    for parts in (2, 3, 4):
        got = simhash.allocate([[0, 1, 2, 3, 4]] * parts, 3 - parts + 1)
        assert sum(got) == 3 - parts + 1


def test_components_of_a_long_chain_and_a_star(spark):
    from granary.llm import common

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {200: 200, 201: 200}


def test_crowded_buckets_are_split_and_lose_no_link(spark):
    from granary.llm import common

    rng = np.random.default_rng(2)
    top = int(rng.integers(1 << 14)) << 48  # all agree in the highest bits, so all share a bucket
    fps = [top | int(x) for x in rng.integers(0, 1 << 48, 1500)]
    fps += [f ^ (1 << int(a)) ^ (1 << int(b)) for f, (a, b) in zip(fps, rng.integers(0, 48, (500, 2)), strict=False)]
    rows = common.stored(spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long"))
    got = {r.id: r.component for r in simhash.linked(rows, "id", 3, large=100).collect()}
    x = np.array(fps, np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3).tolist():
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert got == dict(enumerate(label.tolist())) and len(set(label.tolist())) < 1600


def test_dealt_groups_are_of_bounded_size(spark):
    from granary.llm import common

    sizes = lambda t: pa.table({"n": [t.num_rows]})
    import pyarrow as pa

    rows = spark.range(20_000).select("id", F_lit(1).alias("bucket"))
    groups = [r.n for r in common.in_buckets(rows, "bucket", "id", sizes, "n long", 20_000).collect()]
    assert sum(groups) == 200_000 and max(groups) < 5 * 16_384


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x).cast("long")


def test_hubless_groups_of_alike_sets_are_found_whole(spark):
    # a chain: each set is like the next only, and all share a band with a stranger
    sets = {i: set(range(10 * i, 10 * i + 100)) for i in range(40)} | {99: {-1, -2}}
    frame = lambda ids: spark.createDataFrame([(r.id, sorted(sets[r.id])) for r in ids.collect()], "id long, s array<long>")
    from granary.llm import common

    for most in (256, 8):
        bands = spark.createDataFrame([(i, [5, i]) for i in sets], "id long, bands array<long>")
        got = {r.node: r.component for r in common.components(simhash.alike(bands, frame, 0.8, most)).collect()}
        assert got == {i: 0 for i in range(40)}
        assert not simhash.alike(bands, frame, 0.83, most).count()
