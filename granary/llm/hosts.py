"""Operator 9: quality rules with host verdicts.

Documents are measured by text rules. Failures are summed by host, each host's failure rate is shrunk towards the others by a
beta prior fitted to all hosts, and hosts whose shrunk rate is too high take their documents with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int = 5) -> np.ndarray:
    """For each text, how many of its words lie in windows that occur twice or more in it."""
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(ids) - window + 1
    out = np.zeros(len(counts), np.int64)
    if n < 1:
        return out
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    with np.errstate(over="ignore"):
        key = (text[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(window):
            key = (key ^ hashes[ids[whole + k]]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = whole[twice]
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.bincount(text[np.cumsum(steps[:-1]) > 0], minlength=len(counts))


def measure_batch(texts: list[bytes]) -> dict[str, np.ndarray]:
    ids, words, counts = common.number_words(texts)
    size = np.fromiter((len(w.decode(errors="replace")) for w in words), np.int64, len(words))
    ends = np.r_[0, np.cumsum(size[ids])][np.r_[0, np.cumsum(counts)]]
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.diff(ends),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(ids, common.word_hashes(words), counts),
    }


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Rows (key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one for each row of df; null and empty texts count zero everywhere."""

    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            got = measure_batch(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b].cast(pa.string()), *(pa.array(got[m]) for m in MEASURES)], ["key", "host", *MEASURES])

    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(host).cast("string").alias("host"))
    kind = df.schema[key].dataType.simpleString()
    return common.arrow_map(plain, work, f"key {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES)).withColumnRenamed("key", key)


def fit_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta from all hosts (rows of failed and total) by the method of moments: the mean rate, and the spread of rates beyond what chance gives."""
    sums = hosts.agg(F.sum("failed").alias("f"), F.sum("total").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("failed") * F.col("failed") / F.col("total")).alias("q")).first()
    if not sums["n"]:
        return 1.0, 1.0
    mean = min(max(sums["f"] / sums["n"], 1e-6), 1 - 1e-6)
    spread = sums["q"] / sums["n"] - mean * mean - mean * (1 - mean) * sums["k"] / sums["n"]
    strength = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 10, most_repeated: float = 0.2, most_failing: float = 0.5) -> DataFrame:
    """measure(df) with base_failed, host_rate and kept.

    base_failed: fewer than least_words words, or a share of repeated words above most_repeated. host_rate: the host's share of failed
    documents, shrunk by the prior. kept: not base_failed, and the host's rate is most_failing at most. A null host is no
    host: its host_rate is null and its documents stand for themselves. Repeated rows count as often as they occur.
    """
    percent = round(100 * most_repeated)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))
    measured = common.stored(measure(df, key, text, host).withColumn("base_failed", failed))
    hosts = measured.where("host is not null").groupBy("host").agg(F.sum(F.col("base_failed").cast("long")).alias("failed"), F.count(F.lit(1)).alias("total"))
    hosts = common.stored(hosts)
    alpha, beta = fit_prior(hosts)
    rates = hosts.select(F.col("host").alias("_host"), ((F.col("failed") + alpha) / (F.col("total") + alpha + beta)).alias("host_rate"))
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= most_failing)
    return measured.join(rates, F.col("host") == F.col("_host"), "left").drop("_host").withColumn("kept", kept)
