"""Text features, the quality score, language by letters, and the verdict of the text filter.

A text's measures come from one pass over its code points in Arrow batches, through a table of their classes; what follows from
them are Column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: White space as Python's str.split and str.strip take it.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"

# Letter classes by language, in the order that settles ties.
LETTERS = {
    "ru": "[а-яА-ЯёЁ]",
    "en": "[a-zA-Z]",
    "uk": "[а-яА-ЯёЁіІїЇґҐ]",
    "de": "[äöüÄÖÜß]",
    "fr": "[àâéèêëïîôùûüÿçœæ]",
}
@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the quality score."""

    min_length: int = 100
    max_length: int = 1_000_000
    min_words: int = 20
    min_alpha: float = 0.30
    max_alpha: float = 0.95
    max_digit: float = 0.50
    max_special: float = 0.30
    max_line_repetition: float = 0.50
    min_word_length: float = 2.0
    max_word_length: float = 15.0


@dataclass(frozen=True)
class FilterRules:
    min_quality: float = 0.3
    languages: tuple[str, ...] | None = None
    quality: QualityRules = field(default_factory=QualityRules)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(WORD)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


_RATIOS = ("alpha", "digit", "special")
FEATURES = {"n_chars": "int", "n_words": "int", "alpha_ratio": "double", "digit_ratio": "double", "special_ratio": "double", "line_repetition": "double", "mean_word_length": "double", "sentence_pieces": "int", "paragraphs": "int"}
#: Characters that are measured at once.
_SLICE = 1_000_000
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Of each code point the classes it is in, a bit each: the letters of each language, letters, digits, what is neither letter, number nor space, spaces, sentence ends."""
    if not _table:
        every = [chr(i) for i in range(0x110000)]
        tests = [lambda c, own=re.compile(pattern): own.match(c) is not None for pattern in LETTERS.values()]
        tests += [str.isalpha, str.isdigit, lambda c: not (c.isalnum() or c.isspace()), str.isspace, lambda c: c in ".!?"]
        _table.append(sum(np.fromiter(map(test, every), bool, len(every)).astype(np.uint16) << np.uint16(k) for k, test in enumerate(tests)))
    return _table[0]


def _measured(texts: list[str]) -> dict[str, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    got = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    bounds = np.r_[0, np.cumsum(n)]
    first = np.zeros(len(got) + 1, bool)  # where a text starts
    first[bounds] = True

    def count(x: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][bounds])

    def bit(k: int) -> np.ndarray:
        return (got & np.uint16(1 << k)) > 0

    def runs(x: np.ndarray) -> np.ndarray:
        return count(x & (first[:-1] | ~np.r_[False, x[:-1]])) if len(x) else np.zeros(len(texts), np.int64)

    k = len(LETTERS)
    solid = ~bit(k + 3)
    out = {lang: count(bit(i)) for i, lang in enumerate(LETTERS)} | {"n_chars": n, "n_words": runs(solid)}
    out |= {f"{name}_ratio": count(bit(k + i)) / np.maximum(n, 1) for i, name in enumerate(_RATIOS)}
    lines = [t.split("\n") for t in texts]
    out["line_repetition"] = np.array([1 - len({x.strip() for x in own} - {""}) / len(own) for own in lines], float)
    out["mean_word_length"] = count(solid) / np.maximum(out["n_words"], 1)
    out["sentence_pieces"] = runs(bit(k + 4)) + 1
    out["paragraphs"] = np.array([sum(bool(p) and not p.isspace() for p in t.split("\n\n")) for t in texts], np.int64)
    return out


@F.arrow_udf(StructType([StructField(n, IntegerType() if kind == "int" else DoubleType()) for n, kind in (FEATURES | dict.fromkeys(LETTERS, "int")).items()]))
def measures(texts: pa.Array) -> pa.Array:
    """All features and letter counts of texts; null texts have null features and no letters. Bytes that are no UTF-8 count as the replacement character."""
    own = [(x or b"").decode(errors="replace") for x in texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()).to_pylist()]
    parts, start, total = [], 0, 0
    for i, t in enumerate(own, 1):
        total += len(t)
        if total >= _SLICE or i == len(own):
            parts.append(_measured(own[start:i]))
            start, total = i, 0
    absent = ~np.array(texts.is_valid().to_pylist(), bool)
    columns = {}
    for name, kind in (FEATURES | dict.fromkeys(LETTERS, "int")).items():
        values = np.concatenate([p[name] for p in parts]) if parts else np.zeros(0)
        columns[name] = pa.array(values.astype(np.int32 if kind == "int" else float), mask=absent if name in FEATURES else None)
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def letter_counts(text: Column) -> dict[str, Column]:
    own = measures(text)
    return {lang: own[lang] for lang in LETTERS}


def language(text: Column, least_share: float = 0.3, given: dict[str, Column] | None = None) -> Column:
    """The language with the most letters of its class, ties by the classes' order; unknown without letters or below the share. given: letter counts that are columns already."""
    counts = given or letter_counts(text)
    total, best = sum(counts.values(), F.lit(0)), F.greatest(*counts.values())
    found = F.coalesce(*(F.when(n == best, lang) for lang, n in counts.items()))
    return F.when(total == 0, "unknown").when(best / total < least_share, "unknown").otherwise(found)


def features(text: Column) -> dict[str, Column]:
    """n_chars, n_words, the ratios of letters, digits and special characters, line repetition, mean word length, pieces between sentence ends, and paragraphs."""
    own = measures(text)
    return {n: own[n] for n in FEATURES}


def quality(text: Column, rules: QualityRules | None = None, given: dict[str, Column] | None = None) -> Column:
    """The score from 0 to 1; factors multiply in a fixed order so that doubles agree bit for bit. Null texts score 0. given: features that are columns already."""
    r, f = rules or QualityRules(), given or features(text)
    score = F.lit(1.0)
    for failed, factor in (
        (f["alpha_ratio"] > r.max_alpha, 0.5),
        (f["digit_ratio"] > r.max_digit, 0.5),
        (f["special_ratio"] > r.max_special, 0.5),
        (f["line_repetition"] > r.max_line_repetition, 0.3),
        (f["mean_word_length"] < r.min_word_length, 0.7),
        (f["mean_word_length"] > r.max_word_length, 0.7),
        (f["sentence_pieces"] > 3, 1.1),
        (f["paragraphs"] > 1, 1.05),
    ):
        score = score * F.when(failed, factor).otherwise(1.0)
    none = text.isNull() | is_blank(text) | (f["n_chars"] < r.min_length) | (f["n_chars"] > r.max_length) | (f["n_words"] < r.min_words) | (f["alpha_ratio"] < r.min_alpha)
    return F.when(none, 0.0).otherwise(F.least(F.lit(1.0), score))


def verdict(text: Column, rules: FilterRules | None = None, given: dict[str, Column] | None = None) -> Column:
    """struct(passed, quality, reason); reason is low_quality, wrong_language:x, or the language of a text that passes. given: quality and language that are columns already."""
    r = rules or FilterRules()
    score, lang = (given["quality"], given["language"]) if given else (quality(text, r.quality), language(F.coalesce(text, F.lit(""))))
    low = score < r.min_quality
    wrong = F.lit(False) if r.languages is None else ~lang.isin(*r.languages)
    reason = F.when(low, "low_quality").when(wrong, F.concat(F.lit("wrong_language:"), lang)).otherwise(lang)
    return F.struct((~low & ~wrong).alias("passed"), score.alias("quality"), reason.alias("reason"))


def once(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """df with a struct of columns that is made once for each row: a generator stands between it and what reads it, so the optimizer does not repeat its expressions there."""
    return df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_measures(df: DataFrame, text: str = "text", name: str = "_m") -> DataFrame:
    """df with the struct of a text's measures."""
    return df.withColumn(name, measures(F.col(text)))


def with_language(df: DataFrame, text: str = "text") -> DataFrame:
    """df with language."""
    return with_measures(df, text).withColumn("language", language(F.col(text), given={n: F.col(f"_m.{n}") for n in LETTERS})).drop("_m")


def with_verdict(df: DataFrame, rules: FilterRules | None = None, text: str = "text") -> DataFrame:
    """df with verdict: struct(passed, quality, reason)."""
    r, t = rules or FilterRules(), F.col(text)
    made = lambda names: {n: F.col(f"_m.{n}") for n in names}
    second = once(with_measures(df, text), "_q", quality=quality(t, r.quality, made(FEATURES)), language=language(t, given=made(LETTERS)))
    return second.withColumn("verdict", verdict(t, r, {n: F.col(f"_q.{n}") for n in ("quality", "language")})).drop("_m", "_q")
