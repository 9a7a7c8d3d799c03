import random
import re
from collections import Counter

from granary.llm import hosts, queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \n\n \x0b", "é b|c <x>\na\na\n a\n\n", "one two three four five six seven eight nine", "a b c d e a b c d e f g h", "q " * 3000, "\x1c x\x85y\xa0z " * 4]
    texts += [" ".join(rng.choice("abc") + rng.choice(["", "\n"]) for _ in range(rng.randrange(60))) for _ in range(100)]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(100)]
    rows = []
    for i, t in enumerate(texts):
        n, _, _, _, repeated = base(t)
        bad = n < 10 or 100 * repeated > 20 * n
        rows.append((i, t, rng.choice(["bad", "bad", "bad", None, "good"]) if bad else rng.choice(["good"] * 9 + ["bad", None]), "x"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, host string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_host_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    failed = {}
    for i, t, _, _ in rows:
        want = base(t)
        assert tuple(got[i][m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        failed[i] = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i].base_failed == failed[i]
    by_host = {h: [failed[i] for i, _, s, _ in rows if s == h] for h in ("good", "bad")}
    assert sum(by_host["bad"]) / len(by_host["bad"]) > 0.6 > 0.4 > sum(by_host["good"]) / len(by_host["good"])
    for i, _, s, _ in rows:
        assert got[i].kept == (not failed[i] and s in ("good", None)), (i, s)


def test_prior_shrinks_small_hosts_and_empty_tables_pass(spark):
    frame = spark.createDataFrame([("a", 5, 1000), ("b", 10, 1000), ("c", 1, 1)], "host string, failed long, total long")
    alpha, beta = hosts.fit_prior(frame)
    assert (1 + alpha) / (1 + alpha + beta) < 0.5
    assert hosts.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeated_rows_null_keys_and_tied_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(1, good, "a"), (1, good, "a"), (None, good, "a"), (2, bad, "b"), (2, bad, "b"), (3, good, "b"), (4, good, None), (None, bad, None)]
    got = hosts.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.host or "", r.base_failed) for r in got) == sorted((i or 0, h or "", t == bad) for i, t, h in rows)
    rates = {r.host: r.host_rate for r in got}
    assert rates[None] is None and 0 < rates["a"] < rates["b"] < 1
    assert all(r.kept == (not r.base_failed and (r.host_rate or 0) <= 0.5) for r in got)
    for text in (good, bad):  # all hosts alike: the prior is as strong as it gets, and every rate the mean
        got = hosts.judge(spark.createDataFrame([(i, text, f"h{i % 3}") for i in range(9)], "doc_id long, text string, source string")).collect()
        assert len({round(r.host_rate, 6) for r in got}) == 1 and {r.kept for r in got} == {text == good}
