"""Writers of conversations and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from granary.functions import chat
from granary.operators import trees


def write_conversations(df: DataFrame, path: str) -> None:
    """JSON lines with the key messages, in as many files part-*.jsonl as df has partitions; readers.conversations reads them."""
    df.select("messages").write.mode("overwrite").json(path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):  # Spark names them .json, which stands for a whole array here
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".json"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{name}l"))


def write_routes(df: DataFrame, path: str, roleplay_path: str, rules: chat.ChatRules | None = None) -> DataFrame:
    """Conversations that pass to one place and roleplay to another; returns rows (route, count, share) with each route's share of all."""
    from granary.plans.durable import stored

    routed = stored(df.select("messages", chat.route(F.col("messages"), rules).alias("route")))
    write_conversations(routed.where("route = 'pass'"), path)
    write_conversations(routed.where("route = 'roleplay'"), roleplay_path)
    counts = routed.groupBy("route").count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("route", "count", (F.col("count") / F.col("total")).alias("share"))  # one row


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _streamed(rows: DataFrame, output: str, metadata: str, about: Callable[[int, Row], dict]) -> dict:
    """rows in their order, their column j to one file and what about makes of each to another, a partition at a time; the number of rows and the hashes of both files."""
    hashes, n = [hashlib.sha256(), hashlib.sha256()], 0
    for path in (output, metadata):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(output, "wb") as data, open(metadata, "wb") as beside:
        for n, r in enumerate(rows.toLocalIterator(), 1):
            for file, h, text in ((data, hashes[0], r["j"]), (beside, hashes[1], _canonical(about(n, r)))):
                line = text.encode() + b"\n"
                file.write(line)
                h.update(line)
    return {"records": n, "files": {"output_sha256": hashes[0].hexdigest(), "metadata_sha256": hashes[1].hexdigest()}}


def write_trees(best: DataFrame, by_tree: DataFrame, candidates: DataFrame, rows: DataFrame, outputs: tuple[str, str, str], source: dict, configuration: dict) -> dict:
    """The best paths of trees.convert as canonical JSON lines, a file of metadata with ids, provenance and hashes, and a manifest with the counts of all rejections; rows: the nodes with their reason.

    source: dataset, revision, config and split. The three outputs must differ.
    """
    output, metadata, manifest = outputs
    if len(set(outputs)) < 3:
        raise ValueError("the three outputs must differ")
    named = best.select("tree_id", "leaf_id", "language", chat.canonical_json(trees.as_messages(F.col("path"))).alias("j"), F.transform("path", lambda n: n.message_id).alias("ids")).orderBy("tree_id", "leaf_id")

    def about(n: int, r: Row) -> dict:
        return {
            "id": path_id(source, r["tree_id"], r["leaf_id"]), "line": n, "message_tree_id": r["tree_id"], "leaf_message_id": r["leaf_id"], "message_ids": r["ids"], "language": r["language"],
            "content_sha256": hashlib.sha256(r["j"].encode()).hexdigest(), "provenance": source,
        }

    made = _streamed(named, output, metadata, about)
    reasons = lambda df: {r["reason"]: r["count"] for r in df.where("reason is not null").groupBy("reason").count().orderBy("reason").collect()}
    total = rows.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("reason").isNull()).alias("parsed_rows")).first().asDict()
    paths = candidates.agg(F.count(F.lit(1)).alias("candidate_paths"), F.count_if(F.col("reason").isNull()).alias("valid_candidate_paths")).first().asDict()
    found = {
        "converter_version": 1, "source": source, "configuration": configuration | {"rank_policy": "complete_then_mean_then_depth_then_leaf_id"},
        "counts": total | {"trees_seen": by_tree.count()} | paths | {"output_records": made["records"]}, "rejections": {"rows": reasons(rows), "trees": reasons(by_tree), "candidates": reasons(candidates)}, "files": made["files"],
    }
    Path(manifest).parent.mkdir(parents=True, exist_ok=True)
    Path(manifest).write_text(_canonical(found) + "\n", encoding="utf-8")
    return found


def write_sources(made: dict[str, tuple[DataFrame, dict[str, int]]], folder: str, seed: int, registry: dict) -> dict:
    """The conversations of each source to a folder of its name, and sources.manifest.json with seed, registry and the counts of each."""
    for name, (rows, _) in made.items():
        write_conversations(rows.orderBy("key"), f"{folder}/{name}")
    found = {"seed": seed, "sources": registry, "stats": {name: counts for name, (_, counts) in made.items()}}
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "sources.manifest.json").write_text(json.dumps(found, ensure_ascii=False, indent=2), encoding="utf-8")
    return found


def write_mix(mix: DataFrame, output: str, metadata: str, manifest: str, facts: dict) -> dict:
    """A mix (messages, source, targets, digest, file, line, mix_key) in its order as one file of canonical JSON lines, one of metadata, and a manifest with the hashes of both.

    Rows stream through the driver one partition at a time; nothing is held whole. The three paths must differ.
    """
    if len({output, metadata, manifest}) < 3:
        raise ValueError("the three outputs must differ")
    rows = mix.select(chat.canonical_json("messages").alias("j"), "source", "targets", "digest", "file", "line", "mix_key").orderBy("mix_key")

    def about(n: int, r: Row) -> dict:
        return {"line": n, "source": r["source"], "trainable_targets": r["targets"], "content_sha256": hashlib.sha256(r["j"].encode()).hexdigest(), "normalized_sha256": r["digest"], "source_file": r["file"], "source_line": r["line"]}

    made = _streamed(rows, output, metadata, about)
    found = facts | {"records": made["records"]} | made["files"]
    Path(manifest).write_text(json.dumps(found, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return found


def path_id(source: dict, tree: str, leaf: str) -> str:
    """oasst1- and the first 24 digits of the hash of what names a path of a message tree."""
    identity = {"source": source, "tree_id": tree, "leaf_id": leaf}
    return "oasst1-" + hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
