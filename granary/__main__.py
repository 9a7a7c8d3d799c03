"""python -m granary COMMAND: filter, mix, trees, verdicts, gate, preflight, sources or corpus over files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.functions import chat
from granary.functions import text as T
from granary.operators import tokens, trees
from granary.plans import corpus
from granary.plans.durable import stored
from granary.sources import chats, readers, writers


#: Targets that each source is to give.
QUOTAS = {"ultrachat": 22_000, "wildchat-dialogue": 6_500, "wildchat-casual": 8_500, "russian": 6_000, "tools": 6_000}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="granary", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="conversation rules: JSON lines that pass, and roleplay apart")
    for name in ("--input", "--output", "--roleplay-output"):
        f.add_argument(name, required=True)
    f.add_argument("--max-turns", type=int, default=20)
    f.add_argument("--max-system-len", type=int, default=500)
    f.add_argument("--min-assistant-len", type=int, default=10)
    f.add_argument("--stats", action="store_true")
    m = sub.add_parser("mix", help="a weighted mix from a configuration")
    for name in ("--config", "--output", "--metadata-output", "--manifest-output"):
        m.add_argument(name, required=True)
    t = sub.add_parser("trees", help="best paths of message trees as conversations")
    for name in ("--input", "--output"):
        t.add_argument(name, required=True)
    for name in ("--metadata-output", "--manifest-output"):
        t.add_argument(name, help="with both, --output is one file of canonical lines")
    t.add_argument("--revision", default=chats.REGISTRY["trees"]["revision"])
    t.add_argument("--split", default="train")
    t.add_argument("--languages", default="ru,en")
    for name in ("--max-turns", "--max-chars", "--max-rank"):
        t.add_argument(name, type=int)
    t.add_argument("--min-reviews", type=int, default=1)
    v = sub.add_parser("verdicts", help="the text filter over text files, a document each")
    for name in ("--input", "--output"):
        v.add_argument(name, required=True)
    v.add_argument("--min-quality", type=float, default=0.3)
    v.add_argument("--languages")
    g = sub.add_parser("gate", help="the quality gate of a validation set; 1 if it finds an error")
    for name in ("--data", "--metadata"):
        g.add_argument(name, required=True)
    g.add_argument("--train", action="append", default=[])
    g.add_argument("--expected-count", type=int, default=1000)
    g.add_argument("--expected-per-category", type=int, default=100)
    g.add_argument("--expected-per-language-category", type=int, default=50)
    p = sub.add_parser("preflight", help="masks and tool-call targets of training examples")
    for name in ("--dataset", "--tokenizer"):
        p.add_argument(name, required=True)
    p.add_argument("--seq-len", type=int, default=1024)
    s = sub.add_parser("sources", help="public sources from a local mirror to conversations, each up to its quota of targets")
    for name in ("--mirror", "--output-dir"):
        s.add_argument(name, required=True)
    s.add_argument("--seed", type=int, default=42)
    for name, quota in QUOTAS.items():
        s.add_argument(f"--{name.removeprefix('wildchat-')}-targets", type=int, default=quota, dest=name)
    c = sub.add_parser("corpus", help="texts to shards of token ids")
    c.add_argument("--input", required=True, action="append")
    for name in ("--tokenizer", "--output-dir"):
        c.add_argument(name, required=True)
    c.add_argument("--shard-size", type=int, default=100_000_000)
    c.add_argument("--split", default="train")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "filter" and a.output == a.roleplay_output:
        parser().error("--output and --roleplay-output must differ")
    spark = spark or SparkSession.builder.appName("granary").getOrCreate()
    if a.command == "filter":
        rules = chat.ChatRules(max_turns=a.max_turns, max_system_length=a.max_system_len, min_answer_length=a.min_assistant_len)
        rows = readers.conversations(spark, a.input)
        for r in writers.write_routes(rows, a.output, a.roleplay_output, rules).orderBy("route").collect():
            print(f"{r['route']}: {r['count']} ({r['share']:.1%})")
        if a.stats:
            counts = rows.select(F.explode(chat.reasons(F.col("messages"), rules)).alias("reason")).groupBy("reason").count()
            for r in counts.orderBy(F.desc("count"), "reason").collect():
                print(f"  {r['reason']}: {r['count']}")
    elif a.command == "mix":
        print(json.dumps(corpus.build_mix(spark, a.config, a.output, a.metadata_output, a.manifest_output), ensure_ascii=False, indent=2, sort_keys=True))
    elif a.command == "trees":
        rules = trees.PathRules(trees.parse_languages(a.languages), a.max_turns, a.max_chars, a.max_rank, a.min_reviews)
        nodes = stored(trees.parse_nodes(readers.lines(spark, a.input).withColumnRenamed("value", "raw")))
        best, by_tree, candidates = trees.convert(nodes.where("reason is null").drop("reason"), rules)
        if a.metadata_output and a.manifest_output:
            source = {"dataset": chats.REGISTRY["trees"]["dataset"], "revision": a.revision, "config": None, "split": a.split}
            how = {"languages": list(rules.languages), "max_turns": a.max_turns, "max_chars": a.max_chars, "min_reviews": a.min_reviews, "max_rank": a.max_rank}
            made = writers.write_trees(best, by_tree, candidates, nodes, (a.output, a.metadata_output, a.manifest_output), source, how)
            print(json.dumps(made["counts"]))
            return 0
        writers.write_conversations(best.orderBy("tree_id", "leaf_id").select(trees.as_messages(F.col("path")).alias("messages")), a.output)
        for r in by_tree.groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).count().orderBy("reason").collect():
            print(f"{r['reason']}: {r['count']}")
    elif a.command == "gate":
        limits = {"rows": a.expected_count, "per_category": a.expected_per_category, "per_language": a.expected_per_language_category}
        errors = corpus.gate_files(spark, a.data, a.metadata, a.train, **limits).orderBy("location", "error").collect()  # a validation set is of the size that is expected
        for r in errors:
            print(f"ERROR: {r['location']}: {r['error']}", file=sys.stderr)
        return int(bool(errors))
    elif a.command == "preflight":
        print(json.dumps(corpus.preflight_files(spark, a.dataset, a.tokenizer, a.seq_len)))
    elif a.command == "sources":
        made = corpus.prepare_sources(spark, a.mirror, a.output_dir, {name: getattr(a, name) for name in QUOTAS}, a.seed)
        print(json.dumps(made["stats"], indent=2))
    elif a.command == "corpus":
        Path(a.output_dir).mkdir(parents=True, exist_ok=True)
        made = corpus.pack_files(spark, a.input, tokens.encoder(a.tokenizer), a.output_dir, a.shard_size, a.split)
        for r in made.orderBy("shard").collect():
            print(f"{r['shard']}: {r['tokens']}")
    else:
        rules = T.FilterRules(a.min_quality, tuple(a.languages.split(",")) if a.languages else None)
        T.with_verdict(readers.documents(spark, a.input), rules).select("file", "verdict.*").write.mode("overwrite").json(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
