"""Operator 4: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... share one set of hashed-text weights and differ in ordered thresholds. A document's expected grade and the
probability of the upper grades follow from both.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import common

_WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 40
PREFIXES = (4, 5, 6)


def _bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % BUCKETS


def _shape(text: str, n_words: int, n_kinds: int) -> list[str]:
    """How much of a text is symbols, capitals, digits and repeated words, in steps, and its length in powers of two."""
    size = max(len(text), 1)
    letters = max(sum(map(len, _WORD.findall(text))), 1)
    upper = sum(1 for c in text if c.isupper())
    symbols = sum(text.count(c) for c in "#*$%&|<>!@{}[]=~^")
    digits = sum(text.count(c) for c in "0123456789")
    step = lambda x: int(min(x, 1) * 20)
    return [f"\x01upper{step(upper / letters)}", f"\x01symbols{step(4 * symbols / size)}", f"\x01digits{step(4 * digits / size)}", f"\x01kinds{step(n_kinds / max(n_words, 1))}", f"\x01words{n_words.bit_length()}", f"\x01lines{step((text.count(chr(10)) + 1) * 10 / max(n_words, 1))}"]


class Features:
    """Buckets of the words and their beginnings, remembered for the words that come again."""

    def __init__(self, most: int = 150_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = (_bucket(word), *(_bucket(f"\x02{word[:n]}") for n in PREFIXES if len(word) >= n))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = got
        return got

    def __call__(self, text: str) -> set[int]:
        words = _WORD.findall(text.lower())
        kinds = set(words)
        out = {b for w in kinds for b in self.word(w)}
        out.update(map(_bucket, _shape(text, len(words), len(kinds))))
        return out


@dataclass
class Model:
    """at: sorted buckets with a weight; thresholds between the grades, ascending."""

    at: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """Probabilities of grade 1 or above, 2 or above, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))


class Scorer:
    """A model applied to texts; words whose buckets have no weight are passed over."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most = model, most
        self.weight = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        got = tuple(b for b in (_bucket(word), *(_bucket(f"\x02{word[:n]}") for n in PREFIXES if len(word) >= n)) if b in self.weight)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = got
        return got

    def latent(self, text: str) -> float:
        words = _WORD.findall(text.lower())
        kinds = set(words)
        known, found = self.known, set()
        for w in kinds:
            got = known.get(w)
            if got is None:
                got = self.word(w)
            if got:
                found.update(got)
        found.update(b for b in map(_bucket, _shape(text, len(words), len(kinds))) if b in self.weight)
        return sum(self.weight[b] for b in sorted(found))


def _descend(rows: np.ndarray, cols: np.ndarray, n: int, m: int, grade: np.ndarray, weight: np.ndarray, grades: int, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by Adam over all rows at once."""
    w, low, gaps = np.zeros(m), -1.0, np.zeros(max(grades - 2, 0))
    size = m + 1 + len(gaps)
    first, second = np.zeros(size), np.zeros(size)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    each = np.arange(n)
    for k in range(1, rounds + 1):
        theta = low + np.r_[0, np.cumsum(np.exp(gaps))]
        latent = np.bincount(rows, w[cols], n)
        below = sig(theta[None, :] - latent[:, None])  # P(grade <= j)
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[each, grade + 1] - edge[each, grade], 1e-9)
        up, down = slope[each, grade + 1] / p * weight, slope[each, grade] / p * weight
        by_theta = np.zeros((n, grades + 1))
        by_theta[each, grade + 1] -= up
        by_theta[each, grade] += down
        g_theta = by_theta.sum(0)[1:grades]
        g_gaps = np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
        g = np.r_[np.bincount(cols, (up - down)[rows], m) + penalty * w, g_theta.sum(), g_gaps]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
        w, low, gaps = w - step[:m], low - step[m], gaps - step[m + 1 :]
    return w, low + np.r_[0, np.cumsum(np.exp(gaps))]


def fit(df: DataFrame, ratings: DataFrame, grades: int = 3, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = 6000, most_features: int = 4000, penalty: float = 1e-4, rounds: int = 250) -> Model:
    """Learns from a sample of at most 1.25 * `sample` rated rows, as many of each grade as far as they go, chosen by the key's hash.

    Of the sample's features the `most_features` keep a weight that tell a grade from the others best (log-likelihood ratio). Rows count
    such that grades have their shares among all ratings. Ratings that are null or outside 0..grades-1 teach nothing; of several
    ratings of one key the lowest holds, and of several texts that of the least hash. The order of the rows does not matter.
    """
    rated = ratings.select(F.col(key).alias("_key"), F.col(grade).cast("int").alias("grade")).where(F.col("_key").isNotNull() & F.col("grade").between(0, grades - 1))
    rated = rated.groupBy("_key").agg(F.min("grade").alias("grade"))
    found = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if len(found) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.linspace(-10, -9, grades - 1))
    each = sample // len(found)
    share = F.create_map(*[x for g, n in found.items() for x in (F.lit(g), F.lit(min(1.0, each / n)))])
    order = F.pmod(F.xxhash64(F.lit(9), F.col("_key").cast("string")), F.lit(1_000_000))
    chosen = rated.withColumn("o", order).where(F.col("o") < F.element_at(share, F.col("grade")) * 1_000_000).orderBy("o", F.col("_key").cast("string")).limit(sample + sample // 4)
    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = plain.join(F.broadcast(chosen), F.col("key") == F.col("_key"))  # of a size that the sample bounds
    rows = rows.groupBy("key", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(batch: pa.RecordBatch):
        features = Features()
        lists = [np.array(sorted(features(t or "")), np.int64) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int64()))], ["key", "grade", "at"])

    kind = df.schema[key].dataType.simpleString()
    got = common.arrow_map(rows.select("text", "key", "grade"), work, f"key {kind}, grade int, at array<long>").toArrow().sort_by([("key", "ascending")])
    grade_of = got.column("grade").to_numpy()
    at = got.column("at").combine_chunks()
    sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = at.flatten().to_numpy(zero_copy_only=False)
    del got, at
    # only features of three rows or more can keep a weight; the others are not numbered, as they are most of all
    ranked = np.sort(flat)
    kinds = ranked[:-2][(ranked[:-2] == ranked[2:])] if len(ranked) > 2 else ranked[:0]
    kinds = kinds[np.r_[True, kinds[1:] != kinds[:-1]]] if len(kinds) else kinds
    del ranked
    row, cols = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), []
    common_ = np.zeros(len(flat), bool)
    for start in range(0, len(flat) if len(kinds) else 0, 1 << 20):
        part = flat[start : start + (1 << 20)]
        place = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1).astype(np.int32)
        there = kinds[place] == part
        common_[start : start + len(part)] = there
        cols.append(place[there])
    row, cols = row[common_], np.concatenate(cols) if cols else np.zeros(0, np.int32)
    del flat, common_
    total = np.bincount(cols, minlength=len(kinds)).astype(float)
    gain = np.zeros(len(kinds))
    for g in found:
        n1 = (grade_of == g).sum()
        share1, share0 = n1 / len(sizes), 1 - n1 / len(sizes)
        inside = np.bincount(cols, (grade_of == g)[row], len(kinds))
        ratio = inside * np.log(np.maximum(inside, 1e-9) / (total * share1)) + (total - inside) * np.log(np.maximum(total - inside, 1e-9) / np.maximum(total * share0, 1e-9))
        gain = np.maximum(gain, ratio)
    keep = np.sort(np.argsort(-gain, kind="stable")[:most_features])
    keep = keep[(gain[keep] > 12) & (total[keep] >= 3)]
    place = np.full(len(kinds), -1)
    place[keep] = np.arange(len(keep))
    some = place[cols] >= 0
    everything = sum(found.values())
    weight = np.zeros(len(sizes))
    for g, n in found.items():
        own = grade_of == g
        weight[own] = n / everything / max(own.sum(), 1)
    w, thresholds = _descend(row[some], place[cols[some]], len(sizes), len(keep), grade_of, weight, grades, penalty, rounds)
    return Model(kinds[keep], w, thresholds)


def rate(df: DataFrame, model: Model, tail: int, least: float = 0.5, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, expected_grade, tail, kept) and the columns to carry, one for each row of df: the probability of grade `tail` or above, and whether it is `least` or more.

    Null texts count as empty. Where nothing was learned every document is taken for the highest grade.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of at most most_features weights
    name = uuid.uuid4().hex

    def work(batch: pa.RecordBatch):
        if name not in _scorers:  # a worker keeps one model's words
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        p = shared.value.tails(np.array([scorer.latent(t.as_py() or "") for t in batch.column("_text")]))
        yield common.beside(batch, {"_grade": pa.array(p.sum(1)), "_tail": pa.array(p[:, tail - 1])})

    got = common.carried(df, key, text, carry, work, {"_grade": ("expected_grade", "double"), "_tail": ("tail", "double")})
    return got.withColumn("kept", F.col("tail") >= least)


_scorers: dict[str, Scorer] = {}


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Grades from the labels of quality and toxicity: 0 toxic, 1 of low quality, 2 good; a null quality or toxicity gives none."""
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1))
    return labels.select(key, grade.alias("grade"))
