"""Adapters of chat schemas, each to (digest, messages, targets) of the conversations that its rules let through."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import chat
from granary.functions.text import is_blank, strip
from granary.plans.durable import stored
from granary.sources import readers

# Public datasets by source, with the revision, split and licence that they are pinned to; the last one holds message trees.
REGISTRY = {
    "ultrachat": {"dataset": "HuggingFaceH4/ultrachat_200k", "revision": "8049631c405ae6576f93f445c6b8166f76f5505a", "configs": [None], "split": "train_sft", "license": "MIT"},
    "wildchat": {"dataset": "allenai/WildChat-1M", "revision": "7d6490e462285cf85d91eabea0f9a954fbddcd1f", "configs": [None], "split": "train", "license": "ODC-BY-1.0"},
    "russian": {"dataset": "attn-signs/russian-easy-instructions", "revision": "77a180e009a0c9994b58264caa0353531764f1e8", "configs": [None], "split": "train", "license": "Apache-2.0"},
    "tools": {"dataset": "NousResearch/hermes-function-calling-v1", "revision": "dae3e1d28cfbcf4b915c04ea1e072030529b4bda", "configs": ["func_calling", "func_calling_singleturn", "glaive_func_calling"], "split": "train", "license": "Apache-2.0"},
    "trees": {"dataset": "OpenAssistant/oasst1", "revision": "fdf72ae0827c1cda404aff25b6603abec9e3399b", "configs": [None], "split": "train", "license": "Apache-2.0"},
}


def mirrored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows (value) of a source of REGISTRY, each a JSON object as a string, from a local mirror: {folder}/{dataset}/{revision}/{config, or default}/{split}, Parquet files or JSON lines; configurations are united."""
    source = REGISTRY[name]
    out: DataFrame | None = None
    for config in source["configs"]:
        at = f"{folder}/{source['dataset']}/{source['revision']}/{config or 'default'}/{source['split']}"
        parquet = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        try:
            whole = parquet.parquet(at)
            own = whole.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in whole.columns)), {"ignoreNullFields": "false"}).alias("value"))
        except AnalysisException as error:  # no Parquet file there
            if error.getCondition() not in ("UNABLE_TO_INFER_SCHEMA",):
                raise
            own = readers.lines(spark, at).select("value")
        out = own if out is None else out.union(own)
    return out


def _field(value: Column, path: str, kind: str, sql: str) -> Column:
    own = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(own) == kind, F.try_variant_get(value, path, sql))


def _first_messages(v: Column, key: str) -> Column:
    """Messages under a key, whose roles may be called role or from, and contents content or value."""
    a, b = (chat.typed_messages(F.try_variant_get(v, f"$.{key}", "variant"), *names) for names in (("role", "content"), ("from", "value")))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.when(x.a.isNotNull(), F.struct(F.coalesce(x.a.role, x.b.role).alias("role"), F.coalesce(x.a.content, x.b.content).alias("content"))))


def adapted(rows: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Rows (messages) for rows of JSON objects of a source (ultrachat, wildchat-dialogue, wildchat-casual, russian, tools): null where its rules reject the row."""
    v = F.try_parse_json(value)
    if name == "tools":
        turns = F.transform(chat.typed_messages(F.try_variant_get(v, "$.conversations", "variant"), "from", "value"), lambda m: F.struct(m.role.alias("from"), m.content.alias("value")))
        own = stored(rows.select(F.monotonically_increasing_id().alias("id"), _field(v, "$.tools", "STRING", "string").alias("tools"), turns.alias("conversations")))
        return tool_messages(own).select("messages")
    if name.startswith("wildchat-"):
        category = name.removeprefix("wildchat-")
        each = F.try_variant_get(v, "$.conversation", "array<variant>")
        toxic = F.coalesce(_field(v, "$.toxic", "BOOLEAN", "boolean"), F.lit(False)) | F.coalesce(F.exists(each, lambda m: F.coalesce(_field(m, "$.toxic", "BOOLEAN", "boolean"), F.lit(False))), F.lit(False))
        made = rows.select(_first_messages(v, "conversation").alias("m"), toxic.alias("toxic"))
        return made.select(F.when(chat.wildchat(F.col("m"), F.col("toxic"))[category], chat.normalised(F.col("m"))).alias("messages"))
    if name == "russian":
        made = rows.select(chat.instruction_messages(_first_messages(v, "conversation"), _field(v, "$.instruction", "STRING", "string"), _field(v, "$.answer", "STRING", "string")).alias("m"))
    elif name == "ultrachat":
        made = rows.select(chat.normalised(_first_messages(v, "messages")).alias("m"))
    else:
        raise ValueError(f"unknown source {name}")
    return made.select(F.when(chat.general_quality(F.col("m")), F.col("m")).alias("messages"))


def with_quota(rows: DataFrame, quota: int, seed: int, name: str) -> tuple[DataFrame, dict[str, int]]:
    """Of rows (messages, null where rejected) what until_quota takes, and the counts of all rows: seen, rejected, duplicate, records and targets taken."""
    rows = stored(rows)
    good = rows.where("messages is not null").select(chat.sha256(chat.spaced_json("messages")).alias("digest"), "messages", chat.targets(F.col("messages")).alias("targets"))
    taken = until_quota(good, quota, seed, name)
    seen = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("messages").isNull()).alias("rejected")).first().asDict()
    kinds = good.select("digest").distinct().count()
    records = taken.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("targets"), F.lit(0)).alias("targets")).first().asDict()
    return taken, seen | {"duplicate": seen["seen"] - seen["rejected"] - kinds} | records


def _kept(rows: DataFrame, messages: Column, good: Column) -> DataFrame:
    own = rows.select(messages.alias("messages")).where(F.coalesce(good, F.lit(False)))
    return own.select(chat.sha256(chat.spaced_json("messages")).alias("digest"), "messages", chat.targets(F.col("messages")).alias("targets"))


def general(rows: DataFrame) -> DataFrame:
    """Rows with messages array<struct<role, content>>, roles by any of their names."""
    own = rows.withColumn("messages", chat.normalised(F.col("messages")))
    return _kept(own, F.col("messages"), chat.general_quality(F.col("messages")))


def share_gpt(conversations: Column) -> Column:
    """array<struct<from, value>> as messages."""
    return F.transform(conversations, lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content")))


def wildchat(rows: DataFrame, category: str) -> DataFrame:
    """Rows (conversation array<struct<role, content, toxic>>, toxic), as category dialogue or casual; a conversation can be both."""
    toxic = F.coalesce(F.col("toxic"), F.lit(False)) | F.exists("conversation", lambda m: F.coalesce(m.toxic, F.lit(False)))
    plain = F.transform("conversation", lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    own = rows.select(chat.normalised(plain).alias("messages"), chat.wildchat(plain, toxic)[category].alias("good"))
    return _kept(own, F.col("messages"), F.col("good"))


def instructions(rows: DataFrame) -> DataFrame:
    """Rows (conversation, instruction, answer): the conversation, or else the two texts."""
    own = rows.select(chat.instruction_messages(F.col("conversation"), F.col("instruction"), F.col("answer")).alias("messages"))
    return _kept(own, F.col("messages"), chat.general_quality(F.col("messages")))


def tool_messages(rows: DataFrame, most_chars: int = 8000) -> DataFrame:
    """rows (id, tools JSON, conversations array<struct<from, value>>) with messages, null where they are no tool conversation.

    The tools become the system message, tagged calls and responses compact JSON. Any unknown sender, blank text or tag that is
    missing or holds no JSON spoils the conversation.
    """
    turns = rows.select("id", F.posexplode("conversations").alias("at", "m")).select("id", "at", F.col("m.from").alias("sender"), F.col("m.value").alias("value"))
    is_call = (F.col("sender") == "gpt") & F.col("value").contains("<tool_call>")
    tag = F.when(F.col("sender") == "tool", "tool_response").otherwise("tool_call")
    role = F.when(F.col("sender") == "human", "user").when(F.col("sender") == "tool", "tool_result").when(is_call, "tool_call").when(F.col("sender") == "gpt", "assistant")
    content = F.when((F.col("sender") == "tool") | is_call, chat.tagged_json(F.coalesce("value", F.lit("")), tag)).otherwise(strip(F.col("value")))
    made = turns.select("id", "at", "sender", F.struct(role.alias("role"), content.alias("content")).alias("m"), (F.col("value").isNull() | is_blank(F.col("value"))).alias("blank"))
    spoilt = F.col("blank") | (F.col("sender") != "system") & (F.col("m.role").isNull() | F.col("m.content").isNull()) | F.col("sender").isNull()
    whole = made.groupBy("id").agg(F.max(spoilt).alias("spoilt"), F.array_sort(F.collect_list(F.when(F.col("sender") != "system", F.struct("at", "m")))).alias("own"))
    listed = F.schema_of_variant(F.try_parse_json("tools")).startswith("ARRAY") & (F.json_array_length("tools") > 0)
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("Available tools:\n"), F.col("_tools")).alias("content"))
    messages = F.concat(F.array(system), F.transform("own", lambda x: x.m))
    joined = rows.withColumn("_tools", chat.compact_json("tools")).join(whole, "id", "left").withColumn("messages", messages)
    good = F.coalesce(listed, F.lit(False)) & ~F.col("spoilt") & F.exists("messages", lambda m: m.role == "user") & F.exists("messages", lambda m: m.role == "tool_call") & (chat.total_chars(F.col("messages")) <= most_chars)
    return joined.withColumn("messages", F.when(good, F.col("messages"))).drop("spoilt", "own", "_tools")


def until_quota(rows: DataFrame, quota: int, seed: int, name: str) -> DataFrame:
    """Distinct conversations (digest, messages, targets) in pseudo-random order until their targets reach the quota; the last one may overshoot. Raises ValueError if they fall short."""
    from granary.operators.mixing import _running

    own = stored(rows.groupBy("digest").agg(F.first("messages").alias("messages"), F.first("targets").alias("targets")))
    keyed = own.withColumn("source", F.lit(name)).withColumn("key", chat.stable_key(seed, name, F.col("digest")))
    summed = _running(keyed.select("source", "key", "targets"))
    chosen = stored(keyed.join(summed.where(F.col("running") - F.col("targets") < quota).select("key"), "key", "left_semi").drop("source"))
    got = chosen.agg(F.coalesce(F.sum("targets"), F.lit(0))).first()[0]
    if got < quota:
        raise ValueError(f"{name}: {got} of {quota} targets")
    return chosen
