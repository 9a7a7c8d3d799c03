"""Lenient and strict readers. Conversations come out as array of struct(role, content)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import chat
from granary.plans.durable import stored


def lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Rows (file, value) of all lines that are not blank; folders are read with what lies below them."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(r"\S"))


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Rows (file, line, value) with line numbers from 1, however large a file is: it is read in splits, and the lines of the splits before are added."""
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    block = F.col("_metadata.file_block_start")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    rows = stored(rows)  # the ids depend on the tasks that read
    starts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = starts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(base, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return joined.select("file", (F.col("base") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def _conversation(v: Column) -> Column:
    """The messages of a JSON object, or its conversations if it has no such key; null if that is nothing or empty, one null message if it is no list."""
    has = F.coalesce(F.array_contains(F.json_object_keys(F.to_json(v)), "messages"), F.lit(False))
    own = F.when(has, F.try_variant_get(v, "$.messages", "variant")).otherwise(F.try_variant_get(v, "$.conversations", "variant"))
    none = own.isNull() | (F.schema_of_variant(own) == "VOID") | F.to_json(own).isin("[]", "{}", '""', "0", "false")
    wrong = F.array(F.lit(None).cast("struct<role:string,content:string>"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & ~none, F.coalesce(chat.typed_messages(own), wrong))


def conversations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, messages) of JSON lines with messages or else conversations; lines that are no JSON object, or have neither, are passed over one by one.

    Types are kept: a role or content that is no string is null in the message, so that the rules reject it.
    """
    rows = lines(spark, path, "*.jsonl").withColumn("v", F.try_parse_json("value"))
    return rows.select("file", _conversation(F.col("v")).alias("messages")).where("messages is not null")


def conversation_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, messages) of files that hold one JSON array; files that hold anything else give none."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    rows = whole.where(F.schema_of_variant("v").startswith("ARRAY")).select("file", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
    return rows.select("file", _conversation(F.col("v")).alias("messages")).where("messages is not null")


def strict_conversations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, line, keys, messages); a line that is no JSON object raises with its place when the plan runs. Blank lines are passed over."""
    rows = numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    keys = F.json_object_keys("value")
    place = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object"))
    sound = F.when(F.try_parse_json("value").isNull() | keys.isNull(), F.raise_error(place)).otherwise(keys)
    return rows.select("file", "line", sound.alias("keys"), chat.typed_messages(F.try_variant_get(F.try_parse_json("value"), "$.messages", "variant")).alias("messages"))


def preference_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (prompt, chosen, rejected) as JSON strings of lines that have the keys chosen and rejected, null values included."""
    rows = lines(spark, path, "*.jsonl")
    keys = F.json_object_keys("value")
    both = rows.where(F.try_parse_json("value").isNotNull() & F.array_contains(keys, "chosen") & F.array_contains(keys, "rejected"))
    return both.select(*(F.get_json_object("value", f"$.{k}").alias(k) for k in ("prompt", "chosen", "rejected")))


def sampled(texts: DataFrame, n: int, least: int = 100, text: str = "text") -> DataFrame:
    """Of the first n rows those with more than `least` characters: the limit comes before the filter."""
    return texts.limit(n).where(F.length(text) > least)


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, text): each file is one document; bytes that are no UTF-8 are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("path").alias("file"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))


def token_shards(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows (file, ids) of {split}_*.bin, or of *.bin if there are none, in the order of the files' names; ids are unsigned 16-bit numbers."""
    @F.pandas_udf("array<int>")
    def unpacked(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, "uint16").astype("int32"))

    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}_*.bin").load(folder)
    if rows.select("path").isEmpty():
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return rows.select(F.col("path").alias("file"), unpacked("content").alias("ids")).orderBy("file")
