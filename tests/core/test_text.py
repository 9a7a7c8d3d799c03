import re

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T


def python_quality(text):
    if not text or not text.strip() or not 100 <= len(text) <= 1_000_000:
        return 0.0
    words = text.split()
    if len(words) < 20:
        return 0.0
    share = lambda f: sum(map(f, text)) / len(text)
    alpha = share(str.isalpha)
    if alpha < 0.30:
        return 0.0
    score = 1.0
    if alpha > 0.95:
        score *= 0.5
    if share(str.isdigit) > 0.5:
        score *= 0.5
    if share(lambda c: not c.isalnum() and not c.isspace()) > 0.3:
        score *= 0.5
    lines = text.split("\n")
    if 1 - len({x.strip() for x in lines if x.strip()}) / len(lines) > 0.5:
        score *= 0.3
    mean = sum(map(len, words)) / len(words)
    if mean < 2:
        score *= 0.7
    if mean > 15:
        score *= 0.7
    if len(re.split(r"[.!?]+", text)) > 3:
        score *= 1.1
    if len([p for p in text.split("\n\n") if p.strip()]) > 1:
        score *= 1.05
    return min(1.0, score)


TEXTS = [
    None, "", "  \n", "word " * 19 + "x" * 10, "word " * 20, "abc " * 25, "a" * 99, ("abcd " * 20)[:100], ("abcd " * 21)[:101], "12345 " * 40 + "abcdefgh " * 20, "#$% " * 30 + "abc " * 40,
    "same line here\n" * 30, "one two. three four! five six? seven\n\n" * 5, "a b c d e f g h i j k l " * 10, "pneumonoultramicroscopic " * 25, "é²①ⅷ½ word " * 20, "tab\x1fsep\x85nel\xa0nbsp " * 30,
    "x" * 1_000_001, "абв где " * 30, "\r\n line \r\n" * 40, "abcdefghij" * 12 + " y" * 25,
]


def test_quality_equals_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    whole = {r.i: (r.q, r.v.quality, r.w.quality) for r in T.with_verdict(rows.select("i", "text", T.quality(F.col("text")).alias("q"), T.verdict(F.col("text")).alias("w"))).select("i", "q", "w", F.col("verdict").alias("v")).collect()}
    for i, t in enumerate(TEXTS):
        assert whole[i] == (pytest.approx(python_quality(t), abs=1e-15),) * 3, repr(t)[:60]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Привет мир", "ru"), ("Привіт", "uk"), ("hello", "en"), ("", "unknown"), ("123", "unknown"), ("äöüß", "de"), ("abab абаб", "ru"), ("ü", "de"), ("éè", "fr"), ("abcабв", "ru"), ("abcdабв", "en")],
)
def test_language(spark, text, want):
    assert spark.range(1).select(T.language(F.lit(text)).alias("x")).first().x == want


def test_reasons_of_the_filter(spark):
    rules = T.FilterRules(languages=("ru",))
    rows = spark.createDataFrame([("short",), ("good words here, and more. " * 10,), ("хорошие слова тут. " * 10,), (None,)], "text string")
    got = [tuple(r.v) for r in T.with_verdict(rows, rules).select(F.col("verdict").alias("v")).collect()]
    assert [g[0] for g in got] == [False, False, True, False] and [g[2] for g in got] == ["low_quality", "wrong_language:en", "ru", "low_quality"]


def test_stream_gives_the_batch_verdicts(spark, tmp_path):
    from granary.streaming import verdicts

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = verdicts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    stream.select("i", "verdict.*").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, T.with_verdict(rows).select("i", "verdict.*").collect()))
