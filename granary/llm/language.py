"""Operator 6: hierarchical language identification.

Hashed character trigrams of whole texts. Linear support vector machines tell the language family first; within it a machine
for each two languages votes.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

# Families of language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' lower-case trigrams in a row (runs of other characters are blanks, and blanks alone count for nothing), each text's number of them, and whether it has a letter."""
    low = [f"  {t.lower()}  " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    full = letter[:-2] | letter[1:-1] | letter[2:]
    h = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    upto = np.r_[0, np.cumsum(full)]
    bounds = upto[np.minimum(np.r_[0, ends], len(full))]
    return (h[full] % np.uint32(buckets)).astype(np.int32), np.diff(bounds), np.diff(np.r_[0, np.cumsum(letter)][np.r_[0, ends]]) > 0


@dataclass
class Model:
    """weights: (buckets, machines) of all machines; families: name and languages; pairs: of each family the machines of its language pairs."""

    buckets: int
    scale: float
    families: list[tuple[str, list[str]]]
    pairs: list[list[tuple[int, int, int]]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        own, counts, lettered = trigrams(texts, self.buckets)
        margins = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        some = np.flatnonzero(counts)
        if len(some) and len(self.bias):
            starts = (np.cumsum(counts) - counts)[some]
            for m in range(len(self.bias)):
                margins[some, m] += self.scale * np.add.reduceat(self.weights[:, m][own], starts, dtype=np.float64) / counts[some]
        if not self.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        n = len(self.families)
        high = 1 / (1 + np.exp(-4 * np.clip(margins[:, :n], -20, 20))) if n > 1 else np.ones((len(texts), 1))
        family = high.argmax(1)
        names, score = np.array(["und"] * len(texts), object), high[np.arange(len(texts)), family]
        for f, (_, languages) in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, trust = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages)))
            for a, b, m in self.pairs[f]:
                p = 1 / (1 + np.exp(-4 * np.clip(margins[rows, m], -20, 20)))
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                trust[:, a] += p / (len(languages) - 1)
                trust[:, b] += (1 - p) / (len(languages) - 1)
            best = (votes + 0.5 * trust).argmax(1) if len(rows) else np.zeros(0, int)
            names[rows] = np.array(languages, object)[best]
            if len(languages) > 1:
                score[rows] *= trust[np.arange(len(rows)), best]
        names[~lettered], score[~lettered] = "und", 0.0
        return names.tolist(), np.clip(score, 0, 1)


class Rows:
    """Sparse rows of numbers: of each the columns that are not zero."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        self.sizes, self.cols, self.values, self.width = sizes, cols, values, width
        self.some = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        if len(self.some):
            out[self.some] = np.add.reduceat(w[self.cols] * self.values, self.starts)
        return out

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.cols, np.repeat(v, self.sizes) * self.values, self.width)

    def __getitem__(self, rows: np.ndarray) -> Rows:
        """The rows that a mask keeps."""
        inside = np.repeat(rows, self.sizes)
        return Rows(self.sizes[rows], self.cols[inside], self.values[inside], self.width)


def _machine(x: Rows, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.width), 0.0
    probe = np.random.default_rng(0).normal(size=x.width)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.back(weight * x.dot(probe))
        curve = float(np.linalg.norm(probe))
        probe /= max(curve, 1e-12)
    step = 1 / (2 * (curve + 1) + penalty)
    look_w, look_b, t = w, b, 1.0
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x.dot(look_w) + look_b)) * weight * y
        next_w = look_w + step * (2 * x.back(short) - penalty * look_w)
        next_b = look_b + step * 2 * short.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = next_w + (t - 1) / after * (next_w - w), next_b + (t - 1) / after * (next_b - b)
        w, b, t = next_w, next_b, after
    return w.astype(np.float32), float(b)


def fit(df: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = 4000, buckets: int = 8192, scale: float = 30.0, most_languages: int = 500) -> Model:
    """Learns from a sample of at most `sample` rows with a text and a language, as many of each language as far as they go, chosen by the hash of key and text.

    Rows of equal key, text and language count once. Beyond most_languages languages the most frequent ones are learned. The
    model does not depend on the order or the partitions of the rows.
    """
    rows = df.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).cast("string").alias("lang"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not found:
        return Model(buckets, scale, [], [], np.zeros((buckets, 0), np.float32), np.zeros(0))
    each = max(1, sample // len(found))
    share = F.create_map(*[x for lang, n in found.items() for x in (F.lit(lang), F.lit(min(1.0, 1.25 * each / n)))])
    order = F.xxhash64(F.lit(5), F.col("key").cast("string"), "text")

    def work(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for a, b in common.slices([len(t) for t in texts]):
            own, counts, _ = trigrams(texts[a:b], buckets)
            lists = []
            for part in np.split(own, np.cumsum(counts)[:-1]):
                kinds, n = np.unique(part, return_counts=True)
                lists.append((kinds.astype(np.int16), (n * (scale / max(len(part), 1))).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.array([x for x, _ in lists], pa.list_(pa.int16())), pa.array([x for _, x in lists], pa.list_(pa.float32()))], ["lang", "o", "at", "x"])

    chosen = rows.withColumn("o", order).where(F.pmod("o", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    chosen = chosen.groupBy("lang", "o").agg(F.first("text").alias("text")).select("text", "lang", "o")
    got = common.arrow_map(chosen, work, "lang string, o long, at array<short>, x array<float>").toArrow().sort_by([("o", "ascending"), ("lang", "ascending")])
    lang = np.array(got.column("lang").to_pylist(), object)
    keep = np.concatenate([np.flatnonzero(lang == code)[:each] for code in sorted(found)])
    got = got.take(pa.array(keep))
    at, values = (got.column(c).combine_chunks() for c in ("at", "x"))
    x = Rows(at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), at.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), buckets)
    lang = lang[keep]
    members: dict[str, list[str]] = {}
    for code in sorted(set(lang.tolist())):
        members.setdefault(FAMILY_OF.get(code, code), []).append(code)
    families = sorted(members.items())
    machines = []
    if len(families) > 1:
        machines = [_machine(x, np.where(np.isin(lang, codes), 1.0, -1.0)) for _, codes in families]
    else:
        machines = [(np.zeros(buckets, np.float32), 0.0)]
    pairs = []
    for _, codes in families:
        own = []
        for a, b in combinations(range(len(codes)), 2):
            rows_ = (lang == codes[a]) | (lang == codes[b])
            own.append((a, b, len(machines)))
            machines.append(_machine(x[rows_], np.where(lang[rows_] == codes[a], 1.0, -1.0)))
        pairs.append(own)
    return Model(buckets, scale, families, pairs, np.stack([w for w, _ in machines], 1), np.array([b for _, b in machines]))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, lang_pred, score) and the columns to carry, one for each row of df, from its text alone: a learned language and a score from 0 to 1.

    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few machines of `buckets` numbers, whatever the input

    def work(batch: pa.RecordBatch):
        column = batch.column("_text")
        for a, b in common.slices(common.text_sizes(column)):
            names, score = shared.value.predict([t or "" for t in column[a:b].to_pylist()])
            yield common.beside(batch[a:b], {"_lang": pa.array(names, pa.string()), "_score": pa.array(score)})

    return common.carried(df, key, text, carry, work, {"_lang": ("lang_pred", "string"), "_score": ("score", "double")})
