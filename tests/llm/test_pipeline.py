import random

import corpus_pipeline
from test_op3 import brute as brute_simhash
from test_op7 import brute as brute_spans


def test_stages_equal_plain_versions(spark, tmp_path):
    rng = random.Random(9)
    letters = {"en": "thewaslogn", "de": "üchßeinunk"}
    make = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 8))) for _ in range(n))
    passage = make("en", 80)
    rows, labels = [], []
    for i in range(400):
        lang = "de" if i % 4 == 0 else "en"
        text, toxic = make(lang, rng.randrange(40, 160)), i % 7 == 0
        if toxic:
            text = text.replace(" ", " vexolia ", 2).replace(" ", " vexolum ", 5)
        if i % 11 == 0:
            text += " " + passage
        if i % 9 == 1 and rows:
            text = rows[-1][1]
        toxic = "vexol" in text
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "123 456", "en", "s", 7), (1001, None, None, None, None), (1002, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == set(range(400))
    clean = {i for i, t, *_ in rows if i < 400 and "vexol" not in t}
    assert set(kept[1]) == clean
    groups = brute_simhash([(i, kept[1][i].text) for i in sorted(kept[1])])
    assert set(kept[2]) == {c for _, c in groups.values()}
    left = brute_spans([(i, r.text) for i, r in kept[2].items()], 50)
    assert {i: r.text for i, r in kept[3].items()} == {i: (t if gone else kept[2][i].text) for i, (n, gone, t) in left.items() if not gone or gone < n}
    assert any(gone for _, gone, _ in left.values()) and all(r.n_chars == len(r.text) for r in kept[3].values())
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(kept[3]) == set(kept[4])


def test_near_copies_at_four_fifths_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    rows, want = [], set()
    for k in range(120):
        own = [word() for _ in range(200)]
        other = list(own)
        for i in rng.sample(range(0, 200, 8), 4 if k % 2 else 9):
            other[i] = word()
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        a, b = map(shingles, (rows[-2][1], rows[-1][1]))
        want |= {2 * k} | ({2 * k + 1} if len(a & b) < 0.8 * len(a | b) else set())
    assert 160 < len(want) < 200
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    rng = random.Random(8)
    text = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (7, text[2]), (5, text[3]), (5, text[4]), (5, text[4]), (3, text[3]), (9, text[5]), (9, text[5]), (None, None), (4, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = [(None, text[0]), (None, text[1]), (7, text[2]), (3, text[3]), (5, text[4]), (9, text[5]), (4, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_without_any_language_lettered_texts_stay(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "ä", None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 4]


def test_every_stage_keeps_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choices("thewaslogn", k=rng.randrange(2, 8))) for _ in range(n))
    passage = make(70)
    texts = [make(60) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, f"{texts[4]} {passage}"), (None, f"{texts[5]} {passage}"), (3, f"{texts[6]} {passage}"), (3, f"{texts[7]} {passage}"), (4, "")]
    extra = [(i, t, "en", None, len(t), "x", 1, 2.0, 3, b"k") for i, t in rows]  # columns with names that stages make themselves
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, component int, score double, id int, _h binary")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        assert ids == sorted(str(i) for i, t in rows if t), name  # the empty text has no letter
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "component", "score", "id", "_h"]
        if n == 3:
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            # no row without a key loses words or takes any; of rows under one key neither counts against the other
            assert (None, f"{texts[5]} {passage}") in kept and (3, texts[6]) in kept and (3, texts[7]) in kept and (2, f"{texts[4]} {passage}") in kept
    assert all(len(r.ids) == 4 * r.length for r in docs.collect())


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
