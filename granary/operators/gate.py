"""The quality gate of a validation set: every check gives rows (location, error); none means that the set passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import chat
from granary.operators.tokens import offsets
from granary.plans.durable import stored

# The domains of the metadata, and the keys that it must have.
CATEGORIES = ["math", "code", "explanation", "dialogue", "safety", "tools", "ambiguity", "toxicity", "rewriting", "colloquial"]
LANGUAGES = ["ru", "en"]
DIFFICULTIES = ["easy", "medium", "hard"]
ORIGINS = ["human_authored", "public_benchmark", "adapted_human", "model_draft_human_edited"]
REVIEW_STATUSES = ["curated", "manually_checked"]
METADATA_KEYS = ["id", "line", "language", "category", "difficulty", "expected_behavior", "origin_type", "review_status", "source", "license", "content_sha256"]


def quotas(counted: DataFrame, column: str, domain: list[str], expected: int, by: str | None = None, by_domain: list[str] | None = None) -> DataFrame:
    """Errors for each value of the whole domain (each pair of values with `by`) that does not occur `expected` times."""
    spark = counted.sparkSession
    pairs = [(v, w) for v in domain for w in (by_domain or [None])]
    every = spark.createDataFrame(pairs, f"{column} string, _by string")
    own = counted.select(column, (F.col(by) if by else F.lit(None).cast("string")).alias("_by")).groupBy(column, "_by").count()
    met = every.join(own, (every[column] == own[column]) & every["_by"].eqNullSafe(own["_by"]), "left").select(every[column], every["_by"], F.coalesce("count", F.lit(0)).alias("n"))
    place = F.concat_ws(" x ", F.col("_by"), F.col(column))
    return met.where(F.col("n") != expected).select(place.alias("location"), F.concat(F.lit("expected "), F.lit(expected).cast("string"), F.lit(" rows, found "), F.col("n").cast("string")).alias("error"))


def repeated(rows: DataFrame, column: str | Column, what: str) -> DataFrame:
    value = F.col(column) if isinstance(column, str) else column
    return rows.groupBy(value.alias("v")).count().where("count > 1 and v is not null").select(F.col("v").cast("string").alias("location"), F.lit(f"duplicate {what}").alias("error"))


def _numbered(metadata: DataFrame) -> DataFrame:
    """metadata with position from 1 in the order of its line."""
    own = stored(metadata.withColumn("_id", F.monotonically_increasing_id()))
    keyed = stored(own.select("_id", "line").orderBy("line", "_id").withColumn("_at", F.monotonically_increasing_id()))
    starts = offsets(keyed, "_at", F.lit(1)).select("_id", (F.col("start") + 1).alias("position"))
    return own.join(starts, "_id").drop("_id")


def check(data: DataFrame, metadata: DataFrame, train: DataFrame | None = None, rows: int = 1000, per_category: int = 100, per_language: int = 50) -> DataFrame:
    """All errors of data (line, keys, messages) and metadata (position, keys and the metadata's columns, its claimed line among them), against training conversations (messages).

    line and position are line numbers of the two files. Without a column position rows are numbered by their claimed lines.
    Rows of a wrong structure are not checked further; metadata that lacks a key counts for no quota.
    """
    named = stored(data.withColumn("location", F.concat(F.lit("line "), F.col("line").cast("string"))).withColumn("wrong", chat.structure_errors(F.col("messages"))))
    errors = []
    for table, what in ((data, "data"), (metadata, "metadata")):
        n = table.agg(F.count(F.lit(1)).alias("n"))
        errors.append(n.where(F.col("n") != rows).select(F.lit(what).alias("location"), F.concat(F.lit(f"expected {rows} rows, found "), F.col("n").cast("string")).alias("error")))
    unknown = F.array_sort(F.array_except("keys", F.array(F.lit("messages"))))
    errors.append(named.where((F.size(unknown) > 0) | ~F.array_contains("keys", "messages")).select("location", F.lit("keys must be exactly messages").alias("error")))
    errors.append(named.select("location", F.explode("wrong").alias("error")))
    good = named.where(F.size("wrong") == 0).withColumn("parts", chat.normal_parts("messages"))
    good = stored(good.withColumn("full", chat.full_hash(F.col("parts"))).withColumn("prompts", chat.prompt_hashes(F.col("messages"), F.col("parts"))).withColumn("content", chat.sha256(chat.canonical_json("messages"))))
    if train is not None:
        t = train.select("messages", chat.normal_parts("messages").alias("parts"))
        t = stored(t.select(chat.full_hash(F.col("parts")).alias("full"), chat.prompt_hashes(F.col("messages"), F.col("parts")).alias("prompts")))
        errors.append(good.join(t.select("full").distinct(), "full", "left_semi").select("location", F.lit("conversation found in training data").alias("error")))
        prompts = t.select(F.explode("prompts").alias("p")).distinct()
        errors.append(good.select("location", F.explode("prompts").alias("p")).join(prompts, "p", "left_semi").select("location", F.lit("target prompt found in training data").alias("error")).distinct())
    a = good.select("location", F.col("line").alias("position"), "content")
    b = metadata if "position" in metadata.columns else _numbered(metadata)
    both = stored(a.join(b, "position"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, METADATA_KEYS)), F.col("keys")))
    errors.append(both.where(F.size(missing) > 0).select("location", F.concat(F.lit("metadata lacks "), F.array_join(missing, ", ")).alias("error")))
    full = both.where(F.size(missing) == 0)
    errors.append(full.where("line is null or line <> position").select("location", F.lit("metadata line differs").alias("error")))
    errors.append(full.where("content_sha256 is null or content_sha256 <> content").select("location", F.lit("content_sha256 differs").alias("error")))
    for column, domain in (("language", LANGUAGES), ("category", CATEGORIES), ("difficulty", DIFFICULTIES), ("origin_type", ORIGINS), ("review_status", REVIEW_STATUSES)):
        errors.append(full.where(F.col(column).isNull() | ~F.col(column).isin(*domain)).select("location", F.lit(f"unknown {column}").alias("error")))
    errors += [repeated(full, "id", "id"), repeated(good, "content", "content"), repeated(good, "full", "normalised content")]
    errors += [quotas(full, "category", CATEGORIES, per_category), quotas(full, "category", CATEGORIES, per_language, "language", LANGUAGES)]
    return reduce(DataFrame.union, errors)
