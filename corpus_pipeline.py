"""A training corpus in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, grade, language, packing, queries, simhash, spans

#: Documents whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.25
#: Documents whose five-word shingles are alike by so much are near copies.
LEAST_ALIKE = 0.8


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """docs with names for all columns but `own` that no operator makes itself, and the columns that bring the names back."""
    names = {c: c if c in own else f"_column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(now).alias(c) for c, now in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is too uncertain; lang stays as it came.

    Where no document has a language, none can be learned, and only documents without a letter are rejected.
    """
    model = language.fit(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    plain, back = _apart(docs, "doc_id", "text")
    found = language.identify(plain, model, carry=tuple(plain.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are unlikely to be good: toxic and poor ones."""
    model = grade.fit(docs, grade.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    plain, back = _apart(docs, "doc_id", "text")
    return grade.rate(plain, model, tail=2, least=queries.LEAST_GOOD, carry=tuple(plain.columns)).where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: within 3 bits of the fingerprint of five-word shingles, or alike by LEAST_ALIKE on the shingles themselves.

    Different texts with one doc_id, or with none, are judged each for itself; null ids come last, and of equal rows one stays.
    """
    plain, back = _apart(docs, "doc_id", "text")
    return simhash.near_copies(plain, least=LEAST_ALIKE).select(*back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated spans out of the texts; a document goes if none of its words is left. Texts without such spans stay as they are."""
    plain, back = _apart(docs.drop("n_chars"), "doc_id", "text")
    found = spans.remove_repeated(plain, carry=tuple(c for c in plain.columns if c != "doc_id"))
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", changed).select(*back)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2,048 tokens: a row for each piece, with its token ids and its place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", pack),
]

#: The models and the packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = common.stored(docs)
    return docs
