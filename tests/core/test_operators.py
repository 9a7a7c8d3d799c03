import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import catalogue
from granary.functions import chat
from granary.operators import gate, mixing, near, tokens, trees
from granary.plans.durable import stored

NODE = "raw string"


# near-duplicates


def greedy(rows, more_than=0.9):
    kept, out = [], []
    for i, t in rows:
        w = (t or "").split()
        s = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if s and any(len(s & o) / len(s | o) > more_than for o in kept):
            continue
        out.append(i)
        if s:
            kept.append(s)
    return out


def test_near_duplicates_equal_the_greedy_rule(spark):
    rng = random.Random(1)
    rows, base = [], None
    for i in range(150):
        if i % 6 == 0 or base is None:
            base = [f"w{rng.randrange(60)}" for _ in range(80)]
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(80)] = f"n{rng.randrange(9)}"
        base = words if rng.random() < 0.5 else base
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, "a b"), (202, "a b"), (203, "a b c"), (204, "a b c"), (205, "")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = greedy(rows)
    assert sorted(r.doc_id for r in got) == want and len(want) < 140


def test_large_groups_are_decided_by_their_first(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            words[rng.randrange(100)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.near_duplicates(frame).collect()) == greedy(rows)


def test_similar_sets_share_a_signature(spark):
    rng = random.Random(3)
    for more_than in (0.9, 0.5):
        rows, i = [], 0
        for _ in range(150):
            own = {rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([1, 3, 10, 40, 300]))}
            gone = rng.randrange(int(len(own) * (1 - more_than) / 2) + 1)
            other = set(sorted(own)[gone:]) | {rng.randrange(-(2**63), 2**63) for _ in range(gone)}
            rows += [(i, sorted(own)), (i + 1, sorted(other))]
            i += 2
        sets = dict(rows)
        made = spark.createDataFrame([*rows, (i, [])], "id long, s array<long>").repartition(3).select("id", near.signatures(F.col("s"), more_than).alias("g"))
        got = {r.id: r.g for r in made.collect()}
        alike = [k for k in range(0, i, 2) if len(set(sets[k]) & set(sets[k + 1])) / len(set(sets[k]) | set(sets[k + 1])) > more_than]
        assert len(alike) > 100 and all(set(got[k]) & set(got[k + 1]) for k in alike) and got[i] == []
        if more_than == 0.9:
            assert sum(map(len, got.values())) < 0.3 * sum(len(s) for s in sets.values())


def test_shuffles_of_near_duplicates_are_a_small_part_of_the_shingles(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:10]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []

    def counted(df, *args):
        out = stored(df, *args)
        if "e" in df.columns or "g" in df.columns:
            dealt.append(out.select(F.sum(F.size("g"))).first()[0] if "g" in df.columns else out.count())
        return out

    monkeypatch.setattr(near, "stored", counted)
    assert sorted(r.doc_id for r in near.near_duplicates(frame).collect()) == greedy(rows)
    assert len(dealt) >= 3 and max(dealt) < 0.3 * 70 * 398  # signatures; all elements were dealt before
    crowd = spark.createDataFrame(rows[:20] + [(100 + i, " ".join(f"w{k}" for k in range(300)) + f" x{i}") for i in range(60)], "doc_id long, text string")
    want = greedy([(r.doc_id, r.text) for r in crowd.collect()])
    assert sorted(r.doc_id for r in near.near_duplicates(crowd, crowded=1).collect()) == want and len(want) == 21


def test_similarity_must_exceed_and_chains_keep_their_third(spark):
    words = [f"w{i}" for i in range(21)]
    ten = spark.createDataFrame([(1, " ".join(words[:21])), (2, " ".join(words[:19] + ["x"] * 0))], "doc_id long, text string")  # 19 and 17 shingles: 17 / 19 < 0.9
    assert near.near_duplicates(ten).count() == 2
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    assert sorted(r.id for r in near.first_independent(nodes, edges).collect()) == [1, 3]


# mixing

def test_a_worker_gets_few_conversations_at_once(spark, monkeypatch):
    @F.pandas_udf("array<string>")
    def bounded(messages: pd.Series) -> pd.Series:
        if sum(len(m["content"]) for own in messages for m in own) > 5_000_000:
            raise ValueError("too much at once")
        return messages.map(lambda own: [m["content"][:20] for m in own])

    monkeypatch.setattr(chat, "normal_parts", bounded)
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), 10_000))
    both = F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role in ("user", "assistant")))
    rows = spark.range(0, 1200, 1, 1).select(F.lit("s").alias("source"), F.lit("f").alias("file"), F.col("id").alias("line"), both.alias("messages"))
    got = mixing.judged(rows, mixing.blocked_hashes(rows.where("line < 600")), 1).groupBy("status").count()
    assert {tuple(r) for r in got.collect()} == {("validation_leakage", 600), ("eligible", 600)}



def test_allocation_and_config():
    s = lambda *w: [mixing.Source(f"s{i}", x) for i, x in enumerate(w)]
    assert mixing.allocate(10, s(1, 1, 1)) == {"s0": 4, "s1": 3, "s2": 3}
    assert mixing.allocate(5, s(3.0, 1.0)) == {"s0": 4, "s1": 1}
    for bad in ((s(), 5), (s(1), 0), (s(1), True), (s(0), 5), (s(float("nan")), 5), (s(True), 5), ([mixing.Source("a", 1)] * 2, 5)):
        with pytest.raises(ValueError):
            mixing.check_config(*bad)


@pytest.mark.parametrize(("quota", "want"), [(8, [1, 1, 0, 0, 0]), (9, [1, 1, 0, 1, 0]), (0, [0] * 5), (100, [1] * 5), (4, [0, 1, 0, 1, 0])])
def test_first_fit_skips_and_goes_on(spark, quota, want):
    pool = spark.createDataFrame([("s", f"{i:03x}", t) for i, t in enumerate([5, 3, 4, 1, 1])], "source string, key string, targets int")
    got = {r.key for r in mixing.first_fit(pool, {"s": quota}).collect()}
    assert [int(f"{i:03x}" in got) for i in range(5)] == want


def plain_select(pools, weights, target):
    sources = [mixing.Source(n, w) for n, w in weights.items()]
    fit = lambda items, quota: _walk(items, quota)
    chosen, left = {}, {}
    for name, quota in mixing.allocate(target, sources).items():
        chosen[name], left[name] = fit(pools[name], quota)
    while True:
        deficit = target - sum(t for own in chosen.values() for _, t in own)
        available = [s for s in sources if left[s.name]]
        if deficit <= 0 or not available:
            break
        progress = 0
        for name, quota in mixing.allocate(deficit, available).items():
            more, left[name] = fit(left[name], quota)
            chosen[name] += more
            progress += len(more)
        if not progress:
            break
    return {(n, d) for n, own in chosen.items() for d, _ in own}


def _walk(items, quota):
    took, rest, used = [], [], 0
    for d, t in items:
        if used + t <= quota:
            took.append((d, t))
            used += t
        else:
            rest.append((d, t))
    return took, rest


@pytest.mark.parametrize("target", [30, 95, 400])
def test_selection_equals_the_plain_loop(spark, target):
    rng = random.Random(target)
    weights = {"a": 3.0, "b": 1.0, "c": 1.0}
    rows = [(rng.choice("aabc"), f"{rng.getrandbits(64):016x}", rng.randrange(1, 6)) for _ in range(60)]
    frame = spark.createDataFrame(rows, "source string, digest string, targets int")
    sources = [mixing.Source(n, w) for n, w in weights.items()]
    keyed = frame.select("*", chat.stable_key(42, F.col("source"), F.col("digest")).alias("k")).collect()
    pools = {n: [(r.digest, r.targets) for r in sorted((r for r in keyed if r.source == n), key=lambda r: r.k)] for n in weights}
    got = mixing.select(frame, sources, target, 42)
    assert {(r.source, r.digest) for r in got.where("selected").collect()} == plain_select(pools, weights, target)
    shares = {r.source: r for r in mixing.report(got, sources).collect()}
    assert sum(r.share for r in shares.values()) == pytest.approx(1) and sum(r.selected_targets for r in shares.values()) <= target


def test_statuses_in_their_order(spark):
    talk = lambda q, a="answer": [("user", q), ("assistant", a)]
    rows = [
        ("x", "f1", 1, talk("one")), ("x", "f1", 2, talk("ONE")), ("y", "f2", 1, talk("one")), ("x", "f1", 3, talk("leak")), ("x", "f1", 4, talk("leak")), ("x", "f1", 5, [("user", "q")]), ("y", "f2", 2, talk("leak", "other answer")), ("y", "f2", 3, None),
    ]
    frame = spark.createDataFrame(rows, f"source string, file string, line int, messages {chat.MESSAGES}")
    held = spark.createDataFrame([(talk("leak"),)], f"messages {chat.MESSAGES}")
    got = {(r.source, r.line): r.status for r in mixing.judged(frame, mixing.blocked_hashes(held), 42).collect()}
    assert got[("x", 2)] == "duplicate" and {got[("x", 1)], got[("y", 1)]} == {"eligible", "cross_source_duplicate"}
    assert got[("x", 3)] == got[("x", 4)] == got[("y", 2)] == "validation_leakage" and got[("x", 5)] == "no_trainable_target" and got[("y", 3)] == "missing_messages"
    bad = spark.createDataFrame([([("user", "q")],)], f"messages {chat.MESSAGES}")
    with pytest.raises(Exception, match="no_trainable_target"):
        mixing.blocked_hashes(bad).collect()


# trees


def node(i, parent, tree="t", role=None, **more):
    import json

    base = {"message_id": i, "message_tree_id": tree, "parent_id": parent, "text": f"text {i}", "role": role or ("prompter" if i.count("-") % 2 == 0 else "assistant"), "lang": "en", "deleted": False, "synthetic": False, "review_count": 3, "review_result": True, "rank": None}
    return (json.dumps(base | more),)


def convert(spark, rows, **rules):
    parsed = trees.parse_nodes(spark.createDataFrame(rows, NODE))
    best, by_tree, candidates = trees.convert(parsed.where("reason is null").drop("reason"), trees.PathRules(**rules))
    return {r.tree_id: r for r in best.collect()}, {r.tree_id: r.reason for r in by_tree.collect()}, {r.leaf_id: r.reason for r in candidates.collect()}


def test_rows_that_are_no_nodes(spark):
    rows = [("[1]",), ("x",), (None,), ('{"message_id": 1}',), ('{"message_id": "a", "message_tree_id": ""}',), ('{"message_id": "a", "message_tree_id": "t", "parent_id": 3}',), node("a", None)]
    got = [r.reason for r in trees.parse_nodes(spark.createDataFrame(rows, NODE)).collect()]
    assert got == ["malformed_record"] * 3 + ["invalid_message_id", "invalid_tree_id", "invalid_parent_id", None]


def test_tree_reasons(spark):
    rows = [
        node("d", None, "dup"), node("d-1", "d", "dup"), node("d-1", "d", "dup"), node("c", None, "cross"), node("c-1", "o", "cross"), node("o", None, "other"), node("o-1", "o", "other"), node("r", None, "roots"), node("r2", None, "roots"),
        node("s", None, "self"), node("s-1", "s-1", "self"), node("l", None, "loop"), node("l-1", "l-2", "loop"), node("l-2", "l-1", "loop"), node("m", None, "miss"), node("m-1", "nowhere", "miss"), node("z-1", "d-1", "child"), node("z", None, "child"),
        node("g", None, "good"), node("g-1", "g", "good"), node("n", None, "none"),
    ]
    _, got, _ = convert(spark, rows)
    assert got == {
        "dup": "duplicate_message_id", "cross": "cross_tree_parent", "other": "cross_tree_parent", "roots": "invalid_root_count", "self": "cycle", "loop": "disconnected", "miss": "missing_parent", "child": "missing_parent", "good": None, "none": "no_valid_candidate",
    }


@pytest.mark.parametrize(
    ("more", "reason"),
    [
        ({}, None), ({"deleted": None}, "malformed_deleted"), ({"deleted": True}, "deleted"), ({"synthetic": 1}, "malformed_synthetic"), ({"synthetic": True}, "synthetic"), ({"text": 5}, "malformed_text"), ({"text": " \n"}, "empty_text"),
        ({"role": "x"}, "malformed_role"), ({"role": "prompter"}, "invalid_role_alternation"), ({"lang": None}, "malformed_language"), ({"lang": "de"}, "mixed_language"), ({"lang": " EN "}, None), ({"text": "x" * 90}, "too_many_chars"),
        ({"review_count": True}, "malformed_review_count"), ({"review_count": -1}, "malformed_review_count"), ({"review_result": 1}, "malformed_review_result"), ({"review_result": False}, "assistant_review_failed"), ({"review_count": 0}, "insufficient_reviews"),
        ({"rank": "1"}, "malformed_rank"), ({"rank": -1}, "malformed_rank"), ({"rank": 6}, "rank_above_max"), ({"rank": 5}, None),
    ],
)
def test_path_reasons(spark, more, reason):
    _, _, got = convert(spark, [node("a", None), node("a-1", "a", **more)], max_chars=80, max_rank=5, max_turns=2)
    assert got == {"a-1": reason}


def test_best_path(spark):
    rows = [node("a", None), node("a-1", "a", rank=1), node("a-2", "a", rank=0), node("a-3", "a"), node("a-2-x", "a-2"), node("a-2-x-y", "a-2-x", rank=2)]
    best, _, got = convert(spark, rows)
    assert set(got) == {"a-1", "a-3", "a-2-x-y"}
    assert best["t"].leaf_id == "a-2-x-y"  # means are equal, and it has more nodes
    assert [m.role for m in spark.createDataFrame([best["t"]]).select(trees.as_messages(F.col("path")).alias("m")).first().m] == ["user", "assistant"] * 2
    rows[1] = node("a-1", "a", rank=0)
    assert convert(spark, rows)[0]["t"].leaf_id == "a-1"
    assert convert(spark, rows, languages=("ru",))[2]["a-1"] == "language_not_selected" and convert(spark, rows, max_turns=2)[2]["a-2-x-y"] == "too_many_turns"
    assert convert(spark, [node("a", None)])[2] == {"a": "non_assistant_leaf"}


# tokens


def plain_example(p, a, length, pad=0, end=2):
    m = length + 1
    if len(a) >= m:
        room = min(len(p), max(1, min(m - 1, max(16, m // 4))))
        a = a[: m - room]
        a[-1] = end
    keep = m - len(a)
    p = p[-keep:] if keep > 0 else []
    ids = (p + a + [pad] * m)[:m]
    labels = [-100 if i < max(0, len(p) - 1) or x == pad else x for i, x in enumerate(ids[1:])]
    return ids[:-1], labels


@pytest.mark.parametrize(("np", "na"), [(5, 5), (100, 5), (5, 100), (100, 100), (0, 5), (0, 100), (64, 1), (1, 64), (64, 65), (3, 61)])
def test_training_examples(spark, np, na):
    p, a = [10 + i for i in range(np)], [1000 + i * (i % 7 != 3) - 1000 * (i % 7 == 3) for i in range(na)]
    frame = spark.createDataFrame([(p, a)], "p array<int>, a array<int>")
    got = tokens.with_training_example(frame, "p", "a", 64).first()
    assert (got.input_ids, got.labels) == plain_example(p, list(a), 64)


def test_preference_examples(spark):
    frame = spark.createDataFrame([(list(range(1, 50)), [100] * 9, [200] * 90)], "p array<int>, c array<int>, r array<int>")
    got = frame.select(tokens.preference_example(F.col("p"), F.col("c"), F.col("r"), 30).alias("x")).first().x
    assert got.prompt_len == 10 and got.input_ids == list(range(1, 11)) + [100] * 9 + [0] * 11 and got.rejected_ids == list(range(1, 11)) + [200] * 20


def test_a_worker_gets_few_texts_at_once(spark, monkeypatch, tmp_path):
    spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")

    @F.arrow_udf("array<int>")
    def bounded(texts: pa.Array) -> pa.Array:
        if texts.nbytes > 5_000_000:
            raise ValueError("too much at once")
        return pa.array([[1, 2]] * len(texts), pa.list_(pa.int32()))

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(catalogue.tokens, "char_ids", lambda text, *args: bounded(text))
    for name, n in (("token_offsets", 1500), ("char_tokens", 1500), ("token_shards", 1)):
        assert catalogue.queries()[name](spark, str(tmp_path)).count() == n
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_texts_are_encoded_alike_in_any_slices(spark):
    texts = ["ab", None, "", "x" * 600_000, "\U0001f600я", "y" * 500_000, "z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for end in (2, None):
        got = {r.i: r.x for r in frame.select("i", tokens.char_ids(F.col("t"), end).alias("x")).collect()}
        assert got == {i: None if t is None else [ord(c) % 48_000 for c in t] + [end] * (end is not None) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "length"), [(1000, 16), (5, 16), (34, 16), (0, 16), (171, 10)])
def test_windows_over_a_stream(spark, n, length, tmp_path):
    rng, rows, at = random.Random(n), [], 0
    while at < n:
        size = min(rng.randrange(0, 60), n - at)
        rows.append((len(rows) * 3, list(range(at + 1, at + size + 1))))
        at += size
    stream = tokens.offsets(spark.createDataFrame(rows, "doc_id long, ids array<int>"), "doc_id", F.size("ids"))
    flat = list(range(1, n + 1))
    items = max(1, n // (length + 1) - 1)
    want = {i: (flat[i * length : i * length + length + 1] + [0] * (length + 1))[: length + 1] for i in range(items)} if n else {}
    assert {r.item: r.tokens for r in tokens.windows(stream, length).collect()} == want
    if n == 1000:
        from granary.sources.readers import token_shards

        assert sorted(tuple(r) for r in tokens.write_shards(stream, str(tmp_path), "train", 300).collect()) == [(0, 300), (1, 300), (2, 300), (3, 100)]
        assert [x for r in token_shards(spark, str(tmp_path), "train").collect() for x in r.ids] == flat


# gate


def test_gate_finds_each_fault(spark):
    import hashlib
    import json

    good = [("user", "q {}"), ("assistant", "a")]
    data, meta = [], []
    for i in range(1, 9):
        messages = [(r, t.format(i)) for r, t in good]
        if i == 2:
            messages = [("assistant", "a")]
        if i == 8:
            messages = [("user", "q 7"), ("assistant", "a")]
        content = json.dumps({"messages": [{"role": r, "content": t} for r, t in messages]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        data.append((i, ["messages", "x"] if i == 3 else ["messages"], messages))
        keys = [k for k in gate.METADATA_KEYS if not (i == 4 and k == "license")]
        meta.append((99 if i == 5 else i, keys, f"id{min(i, 7)}", "xx" if i == 6 else "en", "math", "easy", "human_authored", "curated", "0" if i == 1 else hashlib.sha256(content.encode()).hexdigest()))
    d = spark.createDataFrame(data, f"line int, keys array<string>, messages {chat.MESSAGES}")
    m = spark.createDataFrame(meta, "line int, keys array<string>, id string, language string, category string, difficulty string, origin_type string, review_status string, content_sha256 string")
    train = spark.createDataFrame([([("user", "Q 6"), ("assistant", "A")],)], f"messages {chat.MESSAGES}")
    found = {(r.location, r.error) for r in gate.check(d, m.orderBy(F.col("id"), "line"), train, rows=8, per_category=7, per_language=4).collect()}
    errors = {e for _, e in found}
    for want in ("keys must be exactly messages", "metadata lacks license", "unknown language", "duplicate id", "duplicate content", "duplicate normalised content", "conversation found in training data", "target prompt found in training data"):
        assert want in errors, (want, errors)
    assert any("cannot follow" in e for e in errors) and ("code", "expected 7 rows, found 0") in found
