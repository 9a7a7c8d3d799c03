"""Whole builds: a weighted conversation mix from files, a pretraining stream in shards, and the checks before training."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import chat
from granary.operators import gate, mixing, tokens
from granary.plans.durable import stored
from granary.sources import chats, paths, readers, writers


def read_config(path: str) -> tuple[dict, str, list[mixing.Source], int, int]:
    """A mix's configuration, its base folder, sources, target and seed; ValueError before anything is read if it makes no sense."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    base = str((Path(path).parent / config.get("base_dir", ".")).resolve())
    listed = config.get("sources")
    if not isinstance(listed, list) or not listed:
        raise ValueError("sources must be a non-empty list")
    for s in listed:
        own = s.get("paths") if isinstance(s, dict) else None
        if not isinstance(own, list) or not own or not all(isinstance(p, str) and p for p in own) or not isinstance(s.get("name"), str):
            raise ValueError("each source needs a name and a non-empty list of paths")
    sources, target = [mixing.Source(s["name"], s.get("weight")) for s in listed], int(config["target_examples"])
    mixing.check_config(sources, target)
    return config, base, sources, target, int(config.get("seed", 42))


def build_mix(spark: SparkSession, config_path: str, output: str, metadata: str, manifest: str) -> dict:
    """Reads a configured mix's sources, selects and writes it; returns the manifest, with all counters by source."""
    config, base, sources, target, seed = read_config(config_path)
    pool: DataFrame | None = None
    files = {s["name"]: paths.expand(s["paths"], base) for s in config["sources"]}
    for name, own in files.items():
        rows = readers.numbered_lines(spark, own)
        v = F.try_parse_json("value")
        parsed = rows.select(F.lit(name).alias("source"), "file", "line", v.isNull().alias("bad"), chat.typed_messages(F.try_variant_get(v, "$.messages", "variant")).alias("messages"))
        pool = parsed if pool is None else pool.union(parsed)
    pool = stored(pool)
    held = paths.expand(config["validation_paths"], base) if config.get("validation_paths") else []
    empty = spark.createDataFrame([], "h string")
    blocked = stored(mixing.blocked_hashes(readers.strict_conversations(spark, held)) if held else empty)
    judged = stored(mixing.judged(pool.where("not bad").drop("bad"), blocked, seed))
    chosen = stored(mixing.select(judged.where("status = 'eligible'"), sources, target, seed))
    counters = judged.groupBy("source").pivot("status").count().na.fill(0).collect()
    invalid = {r["source"]: r["count"] for r in pool.where("bad").groupBy("source").count().collect()}
    by_source = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} | {"invalid_json": invalid.get(r["source"], 0)} for r in counters}
    quotas = mixing.allocate(target, sources)
    report = {
        r["source"]: r.asDict() | {"requested_targets": quotas[r["source"]], "target_deficit": quotas[r["source"]] - r["selected_targets"], "filter_stats": by_source.get(r["source"], {})} for r in mixing.report(chosen, sources).collect()
    }  # a row a source
    got = sum(r["selected_targets"] for r in report.values())
    facts = {"version": 1, "config": config, "requested_targets": target, "selected_targets": got, "target_deficit": target - got, "validation_hashes": blocked.count(), "statuses": by_source, "sources": report}
    below = F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), f"^{re.escape(base.rstrip('/'))}/", "")
    return writers.write_mix(mixing.mixed_order(chosen, seed).withColumn("file", below), output, metadata, manifest, facts)


def pack_corpus(docs: DataFrame, encode: Column, folder: str, size: int, split: str = "train", order: str = "doc_id", most: int | None = None) -> DataFrame:
    """Documents over 100 characters, `most` of them in their order if that is set, encoded and written after the shards that are there: rows (shard, tokens)."""
    own = docs.where(F.length("text") > 100)
    own = own.orderBy(order).limit(most) if most is not None else own
    stream = tokens.offsets(stored(own.select(order, encode.alias("ids"))), order, F.size("ids"))
    return tokens.write_shards(stream, folder, split, size, first=paths.next_shard(folder, split))


def pack_files(spark: SparkSession, files: list[str], encode: Callable[[Column], Column], folder: str, size: int, split: str = "train") -> DataFrame:
    """pack_corpus over text files, each a document, in the order of their names."""
    docs = stored(readers.documents(spark, files).orderBy("file").withColumn("doc_id", F.monotonically_increasing_id()))
    return pack_corpus(docs, encode(F.col("text")), folder, size, split)


def prepare_sources(spark: SparkSession, mirror: str, folder: str, quotas: dict[str, int], seed: int = 42) -> dict:
    """Reads the sources of the registry from a local mirror, adapts each, fills its quota of targets and writes conversations and the manifest. A quota that can't be met raises."""
    made = {}
    for k, (name, quota) in enumerate(quotas.items()):
        rows = chats.adapted(chats.mirrored(spark, mirror, name.split("-")[0]), name)
        made[name] = chats.with_quota(rows, quota, seed + k, name)
    return writers.write_sources(made, folder, seed, {k: v for k, v in chats.REGISTRY.items() if k != "trees"})


def gate_files(spark: SparkSession, data: str, metadata: str, train: list[str], **limits: int) -> DataFrame:
    """The errors of a validation set in files; training files may have bad lines, the set's own may not."""
    about = readers.numbered_lines(spark, metadata).where(F.col("value").rlike(r"\S"))
    v = F.try_parse_json("value")
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string")).alias(key)
    line = F.when(F.schema_of_variant(F.try_variant_get(v, "$.line", "variant")) == "BIGINT", F.try_variant_get(v, "$.line", "long")).alias("line")
    named = about.select(F.col("line").alias("position"), F.json_object_keys("value").alias("keys"), line, *(text(k) for k in gate.METADATA_KEYS if k != "line"))
    own = readers.conversations(spark, train) if train else None
    return gate.check(readers.strict_conversations(spark, data), named, own, **limits)


def preflight_files(spark: SparkSession, data: str, tokenizer: str, length: int = 1024, prompt_ids: tuple[str, str] = ("<|tool_call|>", "<|eos|>")) -> dict:
    """preflight over the training examples of a file of conversations, encoded by a tokenizer file that has the chat's special tokens."""
    from tokenizers import Tokenizer

    ids = [Tokenizer.from_file(tokenizer).token_to_id(t) for t in (*prompt_ids, "<|pad|>")]
    if None in ids:
        raise ValueError("the tokenizer lacks special tokens of the chat template")
    call, end, pad = ids
    encode, ending = tokens.encoder(tokenizer), tokens.encoder(tokenizer, end=end)
    each = readers.conversations(spark, data).where(~chat.malformed(F.col("messages"))).select(F.explode(chat.examples(F.col("messages"))).alias("e"))
    starts = F.when(F.col("e.completion.role") == "tool_call", F.concat(F.lit("<|tool_call|>\n"), F.col("e.completion.content"))).otherwise(F.col("e.completion.content"))
    rows = stored(each.select(F.col("e.completion.role").alias("role"), encode(chat.template(F.col("e.prompt"), True)).alias("p"), ending(starts).alias("a")))
    return preflight(tokens.with_training_example(rows, "p", "a", length, pad, end), call, pad)


def preflight(examples: DataFrame, tool_call_id: int, pad: int = 0) -> dict:
    """Counts of targets by role of rows (role, input_ids, labels); ValueError if there is no tool call, if one learns nothing, its prompt or padding, or does not start with the tool-call token."""
    first = F.array_position(F.transform("labels", lambda x: x != tokens.IGNORE), True)
    padded = F.exists(F.arrays_zip("input_ids", "labels"), lambda x: (x.input_ids == pad) & (x.labels != tokens.IGNORE))
    calls = F.col("role") == "tool_call"
    found = examples.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.count_if(calls).alias("tool_call"), F.count_if(calls & (first == 0)).alias("untrained"),
        F.count_if(calls & (first > 0) & (F.try_element_at("labels", F.greatest(first, F.lit(1)).cast("int")) != tool_call_id)).alias("wrong_start"), F.count_if(padded).alias("padded"),
    ).first().asDict()
    for key, wrong in (("tool_call", found["tool_call"] == 0), ("untrained", found["untrained"] > 0), ("wrong_start", found["wrong_start"] > 0), ("padded", found["padded"] > 0)):
        if wrong:
            raise ValueError(f"preflight: {key} = {found[key]}")
    return found


def sampling_mask(logits: DataFrame, top_k: int = 0, top_p: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """Rows (step, token, p) that a sampler may draw, of rows (step, token, logit): the k largest, then the fewest whose shares exceed top_p; p adds up to 1 in each step."""
    by = Window.partitionBy("step").orderBy(F.desc("x"), "token")
    scaled = logits.withColumn("x", F.col("logit") / temperature)
    if top_k > 0:
        scaled = scaled.withColumn("r", F.rank().over(Window.partitionBy("step").orderBy(F.desc("x")))).where(F.col("r") <= top_k)
    whole = Window.partitionBy("step")
    share = F.exp(F.col("x") - F.max("x").over(whole))
    kept = scaled.withColumn("w", share).withColumn("before", (F.sum("w").over(by) - F.col("w")) / F.sum("w").over(whole)).where((F.col("before") <= top_p) | (F.lit(top_p) >= 1.0))
    return kept.select("step", "token", (F.col("w") / F.sum("w").over(whole)).alias("p"))
