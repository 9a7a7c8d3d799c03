import json

import pytest
from pyspark.sql import functions as F

from granary.functions import chat
from granary.operators import mixing
from granary.sources import chats, readers, writers

A = "A long enough and useful answer to the question."


@pytest.fixture
def folder(tmp_path):
    m = lambda q: [{"role": "user", "content": q}, {"role": "assistant", "content": A}]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"messages": m("one")}), "", "not json", "[1]", json.dumps({"conversations": m("two")}), json.dumps({"other": 1})]))
    (tmp_path / "deep" / "b.jsonl").write_text(json.dumps({"messages": m("three"), "chosen": None, "rejected": "r"}) + "\n" + json.dumps({"chosen": "c"}))
    (tmp_path / "c.json").write_text(json.dumps([{"messages": m("four")}, {"conversations": m("five")}]))
    (tmp_path / "d.json").write_text(json.dumps({"messages": m("six")}))
    return tmp_path


def asked(df):
    return sorted(r.messages[0].content for r in df.collect())


def test_lenient_readers(spark, folder):
    assert asked(readers.conversations(spark, str(folder))) == ["one", "three", "two"]
    assert asked(readers.conversation_arrays(spark, str(folder))) == ["five", "four"]
    assert [tuple(r) for r in readers.preference_pairs(spark, str(folder)).collect()] == [(None, None, "r")]
    assert sorted((r.line, r.value[:8]) for r in readers.numbered_lines(spark, str(folder / "a.jsonl")).collect())[2] == (3, "not json")


def test_readers_keep_types(spark, tmp_path):
    bad = [{"role": "user", "content": 5}], [{"role": "user", "content": {"a": 1}}], [{"role": 1, "content": "x"}], [7], [{"role": "user"}], "text", {"a": 1}, [{"role": "user", "content": "q"}, {"role": "assistant", "content": A}]
    rows = [{"messages": m} for m in bad] + [{"messages": m} for m in (None, [], "", {}, 0)] + [{"messages": None, "conversations": bad[-1]}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = readers.conversations(spark, str(tmp_path))
    assert sorted(r.r for r in got.select(F.array_join(chat.reasons(F.col("messages")), ",").alias("r")).collect()) == [""] + ["malformed_messages"] * 7
    strict = readers.strict_conversations(spark, str(tmp_path)).select("line", chat.mixable(F.col("messages")).alias("m")).orderBy("line").collect()
    assert [r.m for r in strict] == ["empty_content", "empty_content", "invalid_role", "malformed_message", "empty_content", "missing_messages", "missing_messages", None] + ["missing_messages"] * 6


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"".join(b"line %d\r\n" % i for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert rows.count() == 5000 and rows.where("value <> concat('line ', line - 1)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_samples_are_limited_before_they_are_filtered(spark):
    rows = spark.createDataFrame([("short",), ("x" * 200,), ("y" * 200,)], "text string").coalesce(1)
    assert readers.sampled(rows, 2).count() == 1


def test_strict_reader_names_the_line(spark, folder):
    with pytest.raises(Exception, match="a.jsonl:3"):
        readers.strict_conversations(spark, str(folder / "a.jsonl")).collect()
    assert readers.strict_conversations(spark, str(folder / "deep")).count() == 2


def test_documents_drop_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("aé".encode() + b"\xff\xfeb\n")
    assert [r.text for r in readers.documents(spark, str(tmp_path)).collect()] == ["aéb\n"]


def test_tool_conversations(spark):
    call, response = '<tool_call>{"name": "f", "n": [1, 2]}</tool_call>', '<tool_response> {"r": 1}</tool_response>'
    base = [("system", "old"), ("human", " q "), ("gpt", call), ("tool", response), ("gpt", " done ")]
    tools = '[{"name": "f", "é": 1}]'
    rows = [
        (1, tools, base), (2, "[]", base), (3, "x", base), (4, None, base), (5, tools, [("human", "q"), ("gpt", "a")]), (6, tools, [*base, ("robot", "x")]), (7, tools, [*base, ("tool", "no tag")]), (8, tools, [*base, ("gpt", "<tool_call>{</tool_call>")]),
        (9, tools, [*base, ("gpt", " ")]), (10, tools, base[2:]), (11, tools, [*base, ("gpt", "x" * 8000)]), (12, tools, None),
    ]
    frame = spark.createDataFrame(rows, "id int, tools string, conversations array<struct<from:string,value:string>>")
    got = {r.id: r.messages for r in chats.tool_messages(frame).collect()}
    assert [i for i in sorted(got) if got[i]] == [1]
    assert [tuple(m) for m in got[1]] == [("system", 'Available tools:\n[{"name":"f","é":1}]'), ("user", "q"), ("tool_call", '{"name":"f","n":[1,2]}'), ("tool_result", '{"r":1}'), ("assistant", "done")]


def test_adapters_and_quota(spark):
    m = lambda q, a=A: [("human", q), ("gpt", a)]
    frame = spark.createDataFrame([(m(f"q{i}"),) for i in range(6)] + [(m("q0"),), (m("q9", "short"),), (m("x")[:1],)], f"messages {chat.MESSAGES}")
    found = chats.general(frame)
    assert found.count() == 7 and found.select("digest").distinct().count() == 6
    assert chats.until_quota(found, 4, 42, "s").count() == 4
    with pytest.raises(ValueError, match="6 of 7"):
        chats.until_quota(found, 7, 42, "s")
    rows = spark.createDataFrame([(None, " do ", A), (None, "do", " "), (None, None, A), ([("user", "u"), ("assistant", A)], "do", A)], f"conversation {chat.MESSAGES}, instruction string, answer string")
    assert asked(chats.instructions(rows)) == ["do", "u"]
    wild = spark.createDataFrame([([("user", "hi", False), ("assistant", A, False)], False), ([("user", "hey", True), ("assistant", A, False)], None)], "conversation array<struct<role:string,content:string,toxic:boolean>>, toxic boolean")
    assert asked(chats.wildchat(wild, "casual")) == ["hi"] and chats.wildchat(wild, "dialogue").count() == 0


def test_writers(spark, tmp_path):
    m = lambda q, a=A: [("user", q), ("assistant", a)]
    frame = spark.createDataFrame([(m("one"),), (m("two", f"{A}\n*bows*"),), (m("three", "no"),)], f"messages {chat.MESSAGES}")
    counts = {r.route: r["count"] for r in writers.write_routes(frame, f"{tmp_path}/pass", f"{tmp_path}/play").collect()}
    assert counts == {"pass": 1, "roleplay": 1, "rejected": 1} and asked(readers.conversations(spark, f"{tmp_path}/pass")) == ["one"] and asked(spark.read.json(f"{tmp_path}/play")) == ["two"]
    rows = frame.withColumn("source", F.lit("s")).withColumn("file", F.lit("f")).withColumn("line", F.length(F.col("messages")[0].content)).withColumn("digest", chat.full_hash(chat.normal_parts("messages")))
    mix = mixing.mixed_order(rows.withColumn("targets", F.lit(1)).withColumn("selected", F.lit(True)), 42)
    paths = [f"{tmp_path}/{n}" for n in ("out.jsonl", "meta.jsonl", "manifest.json")]
    facts = writers.write_mix(mix, *paths, {"version": 1})
    lines = [json.loads(x) for x in open(paths[0])]
    about = [json.loads(x) for x in open(paths[1])]
    assert facts["records"] == len(lines) == 3 and [a["line"] for a in about] == [1, 2, 3] and json.load(open(paths[2])) == facts
    keys = [r.mix_key for r in mix.orderBy("mix_key").collect()]
    assert keys == sorted(keys) and all(a["normalized_sha256"] for a in about)
    with pytest.raises(ValueError):
        writers.write_mix(mix, paths[0], paths[0], paths[2], {})
    assert writers.path_id({"revision": "r"}, "t", "l").startswith("oasst1-") and len(writers.path_id({}, "t", "l")) == 31


def test_token_shards_fall_back_to_all_shards(spark, tmp_path):
    from granary.sources import readers

    (tmp_path / "b.bin").write_bytes(bytes([3, 0]))
    (tmp_path / "a.bin").write_bytes(bytes([1, 0, 2, 0]))
    assert [r.ids for r in readers.token_shards(spark, str(tmp_path), "train").collect()] == [[1, 2], [3]]
    (tmp_path / "train_0.bin").write_bytes(bytes([9, 0]))
    assert [r.ids for r in readers.token_shards(spark, str(tmp_path), "train").collect()] == [[9]]
