import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.__main__ import main
from granary.functions import chat
from granary.operators import tokens
from granary.plans import corpus
from granary.sources import chats, paths, readers, writers

A = "A long enough and useful answer to the question."


def talk(q, a=A):
    return {"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}]}


def test_mix_from_files(spark, tmp_path, capsys):
    (tmp_path / "cfg").mkdir()
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(talk(f"a{i}")) for i in range(8)] + ["oops", json.dumps({"x": 1}), json.dumps(talk("held")), json.dumps(talk("a1"))]))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(talk(f"b{i}")) for i in range(2)))
    (tmp_path / "v.jsonl").write_text(json.dumps(talk("held", "else")) + "\n")
    config = {"version": 1, "base_dir": "..", "seed": 42, "target_examples": 9, "validation_paths": ["v.jsonl"], "sources": [{"name": "a", "paths": ["a*.jsonl"], "weight": 1}, {"name": "b", "paths": ["b.jsonl"], "weight": 2.0}]}
    (tmp_path / "cfg" / "c.json").write_text(json.dumps(config))
    out = [str(tmp_path / n) for n in ("out.jsonl", "meta.jsonl", "manifest.json")]
    assert main(["mix", "--config", str(tmp_path / "cfg" / "c.json"), "--output", out[0], "--metadata-output", out[1], "--manifest-output", out[2]], spark) == 0
    m = json.load(open(out[2]))
    assert (m["records"], m["target_deficit"], m["sources"]["b"]["selected_records"]) == (9, 0, 2)
    assert m["statuses"]["a"]["invalid_json"] == 1 and m["statuses"]["a"]["validation_leakage"] == 1 and m["statuses"]["a"]["duplicate"] == 1 and m["statuses"]["a"]["missing_messages"] == 1
    assert m["sources"]["a"]["requested_targets"] == 3 and m["sources"]["a"]["target_deficit"] == -4 and m["sources"]["b"]["target_deficit"] == 4 and m["sources"]["a"]["filter_stats"]["duplicate"] == 1
    assert {json.loads(x)["source_file"] for x in open(out[1])} == {"a.jsonl", "b.jsonl"}
    config["sources"][1]["name"] = "a"
    (tmp_path / "cfg" / "bad.json").write_text(json.dumps(config))
    with pytest.raises(ValueError):
        corpus.read_config(str(tmp_path / "cfg" / "bad.json"))


def test_sources_command(spark, tmp_path, capsys):
    def put(name, config, rows):
        own = chats.REGISTRY[name]
        at = tmp_path / "mirror" / own["dataset"] / own["revision"] / (config or "default") / own["split"]
        at.mkdir(parents=True)
        (at / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))

    two = lambda q, a=A: [{"role": "user", "content": q}, {"role": "assistant", "content": a}]
    put("ultrachat", None, [{"messages": two(f"u{i % 4}")} for i in range(6)] + [{"messages": two("u", 5)}, {"messages": 7}])
    put("wildchat", None, [{"conversation": two("w"), "toxic": True}, {"conversation": [{**m, "toxic": False} for m in two("w2") + two("w3", A + " And more.")], "toxic": False}, {"conversation": [{**two("w4")[0], "toxic": True}, two("w4")[1]]}])
    put("russian", None, [{"conversation": None, "instruction": "do", "answer": A}, {"instruction": None, "answer": A}, {"instruction": 5, "answer": A}])
    call = [{"from": "human", "value": "q"}, {"from": "gpt", "value": '<tool_call>{"z": 1.0, "a": 2}</tool_call>'}]
    for k, config in enumerate(chats.REGISTRY["tools"]["configs"]):
        put("tools", config, [{"tools": '[{"type": "f", "a": 1.0}]', "conversations": [*call, {"from": "gpt", "value": f"done {k}"}]}, {"tools": "[]", "conversations": call}])
    args = ["sources", "--mirror", str(tmp_path / "mirror"), "--output-dir", str(tmp_path / "out")]
    quotas = [x for name, n in (("ultrachat", 4), ("dialogue", 2), ("casual", 2), ("russian", 1), ("tools", 6)) for x in (f"--{name}-targets", str(n))]
    assert main([*args, *quotas], spark) == 0
    stats = json.loads((tmp_path / "out" / "sources.manifest.json").read_text())["stats"]
    assert stats["ultrachat"] == {"seen": 8, "rejected": 2, "duplicate": 2, "records": 4, "targets": 4}
    assert stats["wildchat-dialogue"]["records"] == 1 and stats["wildchat-casual"]["records"] == 1 and stats["russian"] == {"seen": 3, "rejected": 2, "duplicate": 0, "records": 1, "targets": 1}
    assert stats["tools"] == {"seen": 6, "rejected": 3, "duplicate": 0, "records": 3, "targets": 6}
    tools = readers.conversations(spark, str(tmp_path / "out" / "tools")).first().messages
    assert tools[0].content == 'Available tools:\n[{"type":"f","a":1.0}]' and tools[2].content == '{"z":1.0,"a":2}'
    with pytest.raises(ValueError, match="russian: 1 of 2"):
        main([*args, *quotas[:-3], "2", *quotas[-2:]], spark)


def test_gate_preflight_and_corpus_commands(spark, tmp_path, capsys):
    record = talk("question")
    content = hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    about = {"id": "1", "line": 1, "language": "en", "category": "math", "difficulty": "easy", "expected_behavior": "x", "origin_type": "human_authored", "review_status": "curated", "source": "s", "license": "l", "content_sha256": content}
    (tmp_path / "d.jsonl").write_text(json.dumps(record) + "\n")
    (tmp_path / "m.jsonl").write_text(json.dumps(about) + "\n")
    (tmp_path / "t.jsonl").write_text(json.dumps(record) + "\nbad\n")
    args = ["gate", "--data", f"{tmp_path}/d.jsonl", "--metadata", f"{tmp_path}/m.jsonl", "--expected-count", "1", "--expected-per-category", "0", "--expected-per-language-category", "0"]
    assert main(args, spark) == 1
    found = capsys.readouterr().err.splitlines()
    assert found == ["ERROR: en x math: expected 0 rows, found 1", "ERROR: math: expected 0 rows, found 1"]
    main([*args, "--train", f"{tmp_path}/t.jsonl"], spark)
    assert "ERROR: line 1: conversation found in training data" in capsys.readouterr().err
    (tmp_path / "m.jsonl").write_text(json.dumps(about | {"line": 2, "difficulty": None}) + "\n")
    main(args, spark)
    assert {"ERROR: line 1: metadata line differs", "ERROR: line 1: unknown difficulty"} <= set(capsys.readouterr().err.splitlines())

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens(chat.SPECIAL_TOKENS)
    t.save(f"{tmp_path}/tokenizer.json")
    calls = {"messages": [*talk("q")["messages"][:1], {"role": "tool_call", "content": '{"n": 1}'}, {"role": "tool_result", "content": "r"}, {"role": "assistant", "content": A}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(calls) + "\n" + json.dumps(record))
    main(["preflight", "--dataset", f"{tmp_path}/c.jsonl", "--tokenizer", f"{tmp_path}/tokenizer.json", "--seq-len", "64"], spark)
    assert json.loads(capsys.readouterr().out) == {"examples": 3, "assistant": 2, "tool_call": 1, "untrained": 0, "wrong_start": 0, "padded": 0}
    with pytest.raises(ValueError, match="tool_call = 0"):
        main(["preflight", "--dataset", f"{tmp_path}/d.jsonl", "--tokenizer", f"{tmp_path}/tokenizer.json"], spark)
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"text {k} " * 40)
    main(["corpus", "--input", f"{tmp_path}/0.txt", "--input", f"{tmp_path}/1.txt", "--tokenizer", f"{tmp_path}/tokenizer.json", "--output-dir", f"{tmp_path}/shards", "--shard-size", "100"], spark)
    ids = [x for k in range(2) for x in t.encode(f"text {k} " * 40).ids]
    assert [x for r in readers.token_shards(spark, f"{tmp_path}/shards", "train").collect() for x in r.ids] == ids


def test_filter_and_trees_commands(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(x) for x in (talk("q"), talk("q", "no"), talk("q", f"*bows*\n{A}"))))
    main(["filter", "--input", str(tmp_path / "in.jsonl"), "--output", f"{tmp_path}/o", "--roleplay-output", f"{tmp_path}/r", "--stats"], spark)
    assert capsys.readouterr().out.splitlines() == ["pass: 1 (33.3%)", "rejected: 1 (33.3%)", "roleplay: 1 (33.3%)", "  too_short: 1"]
    node = lambda i, p, r: {"message_id": i, "message_tree_id": "t", "parent_id": p, "text": i, "role": r, "lang": "en", "deleted": False, "synthetic": False, "review_count": 1, "review_result": True, "rank": None}
    (tmp_path / "t.jsonl").write_text(json.dumps(node("a", None, "prompter")) + "\n" + json.dumps(node("b", "a", "assistant")))
    main(["trees", "--input", str(tmp_path / "t.jsonl"), "--output", f"{tmp_path}/trees"], spark)
    assert capsys.readouterr().out == "selected: 1\n" and spark.read.json(f"{tmp_path}/trees").count() == 1
    out = [f"{tmp_path}/{n}" for n in ("t.out", "t.meta", "t.manifest")]
    main(["trees", "--input", str(tmp_path / "t.jsonl"), "--output", out[0], "--metadata-output", out[1], "--manifest-output", out[2]], spark)
    line, about, manifest = open(out[0]).read(), json.loads(open(out[1]).read()), json.loads(open(out[2]).read())
    assert line == '{"messages":[{"content":"a","role":"user"},{"content":"b","role":"assistant"}]}\n'
    source = {"dataset": "OpenAssistant/oasst1", "revision": "fdf72ae0827c1cda404aff25b6603abec9e3399b", "config": None, "split": "train"}
    assert about == {"id": writers.path_id(source, "t", "b"), "line": 1, "message_tree_id": "t", "leaf_message_id": "b", "message_ids": ["a", "b"], "language": "en", "content_sha256": hashlib.sha256(line[:-1].encode()).hexdigest(), "provenance": source}
    assert manifest["counts"] == {"input_rows": 2, "parsed_rows": 2, "trees_seen": 1, "candidate_paths": 1, "valid_candidate_paths": 1, "output_records": 1}
    assert manifest["files"]["output_sha256"] == hashlib.sha256(line.encode()).hexdigest() and manifest["rejections"] == {"rows": {}, "trees": {}, "candidates": {}}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.txt").write_text("some good words here. " * 20)
    main(["verdicts", "--input", f"{tmp_path}/docs", "--output", f"{tmp_path}/v"], spark)
    assert spark.read.json(f"{tmp_path}/v").first().reason == "en"


def test_packing_appends_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (95 + i)) for i in range(12)], "doc_id long, text string")
    count = lambda rows: sum(r.tokens for r in rows.collect())
    ids = tokens.char_ids(F.col("text"))
    assert count(corpus.pack_corpus(docs, ids, str(tmp_path), 300)) == sum(96 + i for i in range(6, 12))
    assert paths.next_shard(str(tmp_path), "train") == 3
    assert count(corpus.pack_corpus(docs, ids, str(tmp_path), 300, most=2)) == 102 + 103 and paths.next_shard(str(tmp_path), "train") == 4


def test_preflight(spark):
    schema = "role string, input_ids array<int>, labels array<int>"
    good = [("assistant", [5, 6, 0], [-100, 7, -100]), ("tool_call", [5, 8, 0], [-100, 9, -100])]
    assert corpus.preflight(spark.createDataFrame(good, schema), 9)["tool_call"] == 1
    for bad, what in ((good[:1], "tool_call"), ([("tool_call", [5], [-100])], "untrained"), ([("tool_call", [5, 6], [-100, 8])], "wrong_start"), ([*good, ("assistant", [0], [4])], "padded")):
        with pytest.raises(ValueError, match=what):
            corpus.preflight(spark.createDataFrame(bad, schema), 9)


def test_sampler(spark):
    rows = spark.createDataFrame([(0, t, x) for t, x in enumerate([3.0, 2.0, 1.0, 0.0])], "step int, token int, logit double")
    got = lambda **how: {r.token: r.p for r in corpus.sampling_mask(rows, **how).collect()}
    assert set(got()) == {0, 1, 2, 3} and set(got(top_k=2)) == {0, 1} and set(got(top_p=0.5)) == {0} and set(got(top_p=0.7)) == {0, 1}
    assert sum(got(top_k=3, top_p=0.95, temperature=2.0).values()) == pytest.approx(1)


def test_paths(tmp_path):
    for name in ("b.jsonl", "a.json", "c.txt", "d/e.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    assert [paths.shown(p, str(tmp_path)) for p in paths.json_files(str(tmp_path))] == ["b.jsonl", "d/e.jsonl", "a.json"]
    assert paths.json_files(str(tmp_path / "c.txt")) == [] and len(paths.json_files(str(tmp_path / "a.json"))) == 1
    assert [paths.shown(p, str(tmp_path)) for p in paths.expand(["**/*.jsonl", "b.jsonl", "d"], str(tmp_path))] == ["b.jsonl", "d/e.jsonl"]
    assert paths.shown("/x/y", str(tmp_path)) == "/x/y"
    with pytest.raises(ValueError):
        paths.expand(["*.none"], str(tmp_path))
    assert paths.next_shard(str(tmp_path), "train") == 0 and chat.SPECIAL_TOKENS[:3] == ["<|pad|>", "<|bos|>", "<|eos|>"]


def test_tables_need_a_shared_folder_on_a_cluster_and_can_be_discarded(spark):
    from types import SimpleNamespace

    from granary.plans import durable

    none = SimpleNamespace(isDefined=lambda: False)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(RuntimeError, match="checkpoint"):
        durable.shared_dir(fake)
    table = durable.stored(spark.range(5))
    at = table._stored_at.removeprefix("file://")
    import os

    assert table.count() == 5 and os.path.isdir(at)
    durable.discard(table, spark.range(1))
    assert not os.path.exists(at)
