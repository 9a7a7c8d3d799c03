import hashlib
import random
import re

from granary.llm import queries, spans


def brute(rows, length):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    first = {}
    for i, w in split.items():
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone |= set(range(s, s + length))
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def corpus(rng, length):
    words = [f"w{i}é" for i in range(40)]
    passage = [[rng.choice(words) for _ in range(rng.randrange(length - 2, 3 * length))] for _ in range(6)]
    texts = [None, "", " \n\t", "a", " ".join(["same"] * 300), "same " * 200, "x" * 100_000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passage)
            cut = rng.randrange(len(p))
            parts += rng.choice([p, p, p[cut:], p[:cut], [rng.choice(words) for _ in range(30)]])
        texts.append("  ".join(parts))
    texts += texts[8:20]
    rng.shuffle(texts)
    return [(i * 13 % 997, t) for i, t in enumerate(texts)]


def test_equals_brute_force(spark, tmp_path):
    rows = corpus(random.Random(4), 50)
    spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, key string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_spans(spark, str(tmp_path)).collect()}
    want = brute(rows, 50)
    assert got == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in want.items()}
    assert sum(g > 0 for _, g, _ in want.values()) > 20


def test_short_windows_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(80)]
    got = spans.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, 6)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    schema = "doc_id long, text string"
    text = " ".join(f"t{i}" for i in range(60))
    got = spans.remove_repeated(spark.createDataFrame([(2, text), (2, text), (None, text), (9, text)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (2, 0), (2, 0), (9, 60)]
    assert spans.remove_repeated(spark.createDataFrame([], schema)).count() == 0


def test_a_line_repeated_within_documents_is_one_row_a_path(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    line = rng.sample(words, 7)
    texts = [" ".join(rng.choices(words, k=rng.randrange(70)) + line * rng.randrange(8, 60) + rng.choices(words, k=rng.randrange(70)) + line[:4] * rng.randrange(30)) for _ in range(40)]
    rows = [(i * 7 % 41, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    paths = spans.paths(df.withColumnRenamed("doc_id", "key"), 50, 10).collect()
    assert len({(r.key, r.whole, r.check) for r in paths}) == len(paths)
    for key, text in rows:
        own = [r for r in paths if r.key == key]
        assert sorted(s + n for r in own for s in r.starts for n in range(r.windows)) == list(range(len(text.split()) - 49))
    assert sum(len(r.starts) for r in paths) > 2 * len(paths)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in spans.remove_repeated(df).collect()}
    assert got == brute(rows, 50)
    assert sum(g > 0 for _, g, _ in got.values()) > 30
