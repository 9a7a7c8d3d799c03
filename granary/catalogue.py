"""Queries over the driver's tables and the SQL they are held against.

Where the tables would never reach a rule's branch, the queries take other limits than the defaults, in both forms alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary import streaming
from granary.functions import chat
from granary.functions import text as T
from granary.operators import gate, mixing, near, tokens, trees
from granary.plans import corpus
from granary.plans.durable import SMALL, shared_dir, stored
from granary.sources import readers, writers
from granary.sources.chats import tool_messages, until_quota

RULES = chat.ChatRules(max_turns=4, max_system_length=100, min_answer_length=200, max_word_share=0.08)
SEED = 42
SOURCES = [mixing.Source("s0", 3.0), mixing.Source("s1", 2.0), mixing.Source("s2", 1.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in the order of turns, and a source."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    messages = F.transform("t", lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return turns.select("conv_id", messages.alias("messages"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("source"))


# Each query with its SQL; the SQL's common parts first.
_MESSAGES = """messages as (
  select conv_id, list({'role': role, 'content': text} order by turn) as messages, list(role order by turn) as roles, list(text order by turn) as texts, 's' || (conv_id % 3) as source
  from conversations group by conv_id
)"""
_TURNS = "turns as (select conv_id, turn, role, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as bare from conversations)"
_COUNTS = """counts as (
  select doc_id, text, len(regexp_extract_all(text, '[а-яА-ЯёЁ]')) as ru, len(regexp_extract_all(text, '[a-zA-Z]')) as en, len(regexp_extract_all(text, '[а-яА-ЯёЁіІїЇґҐ]')) as uk,
    len(regexp_extract_all(text, '[äöüÄÖÜß]')) as de, len(regexp_extract_all(text, '[àâéèêëïîôùûüÿçœæ]')) as fr
  from documents
),
languages as (
  select doc_id, text, case when ru + en + uk + de + fr = 0 then 'unknown' when greatest(ru, en, uk, de, fr) / (ru + en + uk + de + fr) < 0.3 then 'unknown'
    when ru >= greatest(en, uk, de, fr) then 'ru' when en >= greatest(uk, de, fr) then 'en' when uk >= greatest(de, fr) then 'uk' when de >= fr then 'de' else 'fr' end as language
  from counts
)"""
_FEATURES = r"""features as (
  select doc_id, text, length(text) as n_chars, len(regexp_extract_all(text, '\S+')) as n_words,
    case when length(text) = 0 then 0.0::double else len(regexp_extract_all(text, '\p{L}')) / length(text) end as alpha_ratio,
    case when length(text) = 0 then 0.0::double else len(regexp_extract_all(text, '\p{Nd}')) / length(text) end as digit_ratio,
    case when length(text) = 0 then 0.0::double else len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / length(text) end as special_ratio,
    1 - len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda l: l <> ''))) / len(string_split(text, chr(10))) as line_repetition,
    case when len(regexp_extract_all(text, '\S+')) = 0 then 0.0::double else length(regexp_replace(text, '\s+', '', 'g')) / len(regexp_extract_all(text, '\S+')) end as mean_word_length,
    len(regexp_split_to_array(text, '[.!?]+')) as sentence_pieces,
    len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))) as paragraphs
  from documents
),
scores as (
  select *, case when not regexp_matches(text, '\S') or n_chars < 100 or n_chars > 1000000 or n_words < 20 or alpha_ratio < 0.30 then 0.0::double
    else least(1.0::double, 1.0::double * (case when alpha_ratio > 0.95 then 0.5 else 1.0 end)::double * (case when digit_ratio > 0.5 then 0.5 else 1.0 end)::double * (case when special_ratio > 0.3 then 0.5 else 1.0 end)::double
      * (case when line_repetition > 0.5 then 0.3 else 1.0 end)::double * (case when mean_word_length < 2 then 0.7 else 1.0 end)::double * (case when mean_word_length > 15 then 0.7 else 1.0 end)::double
      * (case when sentence_pieces > 3 then 1.1 else 1.0 end)::double * (case when paragraphs > 1 then 1.05 else 1.0 end)::double) end as quality
  from features
)"""
_VERDICTS = f"""{_COUNTS}, {_FEATURES}, verdicts as (
  select doc_id, quality, case when quality < 0.8 then 'low_quality' when language not in ('en', 'ru') then 'wrong_language:' || language else language end as reason
  from scores join languages using (doc_id)
)"""
_RULES = T.FilterRules(min_quality=0.8, languages=("en", "ru"))

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query(f"with {_COUNTS} select doc_id, language from languages")
def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_language(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "language")


@query(f"with {_FEATURES} select * exclude (text) from features")
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.with_measures(table(spark, sf_dir, "documents"))
    return own.select("doc_id", *((F.col(f"_m.{n}").cast("long") if n in ("n_chars", "n_words", "sentence_pieces", "paragraphs") else F.col(f"_m.{n}")).alias(n) for n in T.FEATURES))


@query(f"with {_FEATURES} select doc_id, quality from scores")
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.with_measures(table(spark, sf_dir, "documents"))
    return own.select("doc_id", T.quality(F.col("text"), None, {n: F.col(f"_m.{n}") for n in T.FEATURES}).alias("quality"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_verdict(table(spark, sf_dir, "documents").select("doc_id", "text"), _RULES).select("doc_id", "verdict.*")


@query(f"with {_VERDICTS} select doc_id, reason in ('en', 'ru') as passed, quality, reason from verdicts")
def doc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"with {_VERDICTS} select reason, count(*) as n, avg(quality) > 0.5 as mostly_good from verdicts group by reason")
def doc_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), (F.avg("quality") > 0.5).alias("mostly_good"))


@query("select doc_id, row_number() over (partition by text order by doc_id) = 1 as kept from documents")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts stays; the minimum is taken over hashes of two kinds, so copies meet as aggregates only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = stored(docs.groupBy("h").agg(F.min("doc_id").alias("first")))  # stored, so that Spark may split the join on a text of very many copies
    return docs.join(first, "h").select("doc_id", (F.col("doc_id") == F.col("first")).alias("kept"))


def _near_sql(table: str) -> str:
    """CTEs to `stay`: ids of a table (doc_id, text) that stay when each, in order, goes if a smaller one that stays is too similar."""
    return rf"""words as (select doc_id, regexp_extract_all(text, '\S+') as w from {table}),
shingles as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 3),
elements as (select doc_id, len(s) as n, unnest(s) as e from shingles),
common_ as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from elements a join elements b on a.e = b.e and a.doc_id < b.doc_id and least(a.n, b.n) > greatest(a.n, b.n) * 0.9 group by all),
edges as (select a, b from common_ where o / (na + nb - o) > 0.9),
nodes as (select id, row_number() over (order by id) as i from (select a as id from edges union select b from edges)),
lower_ones as (select n.i, n.id, coalesce(list(e.a) filter (where e.a is not null), []) as low from nodes n left join edges e on e.b = n.id group by all),
walk as (select 0::bigint as i, []::bigint[] as kept union all select n.i, case when list_has_any(kept, low) then kept else list_append(kept, n.id) end from walk w join lower_ones n on n.i = w.i + 1),
stay as (select doc_id from {table} where doc_id not in (select id from nodes) or doc_id in (select unnest(arg_max(kept, i)) from walk))"""


@query(f"with recursive {_near_sql('documents')} select doc_id from stay")
def doc_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    f"""with recursive {_COUNTS}, {_FEATURES}, passed as (select doc_id, text, quality, language from scores join languages using (doc_id, text) where quality >= 0.3), {_near_sql("passed")}
select doc_id, quality, language from passed semi join stay using (doc_id)"""
)
def doc_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.filter_and_dedup(table(spark, sf_dir, "documents"))


@query("select doc_id, toxic = 1 as toxic from documents left join labels using (doc_id) where coalesce(toxic, 0) = 0 or quality = 1")
def toxic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.where((F.coalesce("toxic", F.lit(0)) == 0) | (F.col("quality") == 1)).select("doc_id", (F.col("toxic") == 1).alias("toxic"))


@query(
    rf"""with words as (select doc_id, regexp_extract_all(lower(text), '\S+') as w from documents), items as (select regexp_extract_all(lower(text), '\S+') as w from benchmark),
grams as (select doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) as g from words where len(w) >= 8),
known as (select distinct unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) as g from items where len(w) >= 8)
select doc_id, count(distinct g) as shared from grams semi join known using (g) group by doc_id"""
)
def benchmark_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share eight words in a row with a benchmark item, and how many such runs."""

    def grams(df: DataFrame, *keys: str) -> DataFrame:
        # a generator between keeps the split from being repeated inside the array functions
        w = df.select(*keys, F.explode(F.array(T.words(F.lower("text")))).alias("w")).where(F.size("w") >= 8)
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
        return w.select(*keys, F.explode(runs).alias("g"))

    known = grams(table(spark, sf_dir, "benchmark")).distinct()
    found = grams(table(spark, sf_dir, "documents"), "doc_id").join(known, "g", "left_semi")
    return found.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


_STRUCTURE = f"""with {_TURNS}, targets as (select * from turns where role in ('assistant', 'tool_call')), answers as (select * from turns where role = 'assistant')
select c.conv_id, not exists (select 1 from targets t where t.conv_id = c.conv_id and length(bare) >= 200) as too_short, c.n > 4 as too_long,
  exists (select 1 from targets t where t.conv_id = c.conv_id and bare = '') as empty_assistant,
  (select count(*) - count(distinct bare) from answers a where a.conv_id = c.conv_id and bare <> '') > 0 as duplicate,
  exists (select 1 from turns t where t.conv_id = c.conv_id and role = 'system' and length(text) > 100) as system_too_long
from (select conv_id, count(*) as n from turns group by conv_id) c"""


@query(_STRUCTURE)
def conv_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return chats(spark, sf_dir).select(
        "conv_id", chat.too_short(m, 200).alias("too_short"), (F.size(m) > 4).alias("too_long"), chat.empty_target(m).alias("empty_assistant"), chat.repeated_answers(m).alias("duplicate"), chat.long_system(m, 100).alias("system_too_long")
    )


_JAILBREAK_SQL = "|".join(f"(?:{p})" for p in chat.JAILBREAKS)


@query(f"with {_TURNS} select conv_id, bool_or(role = 'user' and regexp_matches(lower(bare), $re$(?i){_JAILBREAK_SQL}$re$)) as jailbreak from turns group by conv_id")
def conv_jailbreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.jailbreak(F.col("messages")).alias("jailbreak"))


def _sterile_sql() -> str:
    rest = "lower(bare)"
    for phrase in chat.STERILE_PHRASES:
        quoted = phrase.replace("'", "''")
        rest = f"replace({rest}, '{quoted}', ' ')"
    has = " or ".join("contains(lower(bare), '{}')".format(p.replace("'", "''")) for p in chat.STERILE_PHRASES)
    plain = rf"trim(regexp_replace(regexp_replace({rest}, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"with {_TURNS} select conv_id, bool_or(role = 'assistant' and ({has}) and length({plain}) < 400) as sterile from turns group by conv_id"


@query(_sterile_sql())
def conv_sterile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.sterile(F.col("messages"), 400).alias("sterile"))


_ROLEPLAY_SQL = "|".join(f"(?:{p})" for p in chat.ROLEPLAY)


@query(f"with {_TURNS} select conv_id, bool_or(role = 'assistant' and regexp_matches(bare, $re$(?im){_ROLEPLAY_SQL}$re$)) as roleplay from turns group by conv_id")
def conv_roleplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.roleplay(F.col("messages")).alias("roleplay"))


_BAD = r"""words as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '\S+')) as w from turns where role = 'assistant' and length(text) > 100),
shares as (select conv_id, turn, max(c) / sum(c) as share, sum(c) as n from (select conv_id, turn, w, count(*) as c from words group by all) group by conv_id, turn),
bad as (select conv_id from shares where n > 20 and share > 0.08 union select conv_id from turns where role = 'assistant' and contains(text, repeat(chr(10), 4)))"""
_REASONS = f"""with {_TURNS}, {_BAD}, structure as ({_STRUCTURE.replace("with " + _TURNS + ", ", "with ")}),
sterile as ({_sterile_sql().replace("with " + _TURNS + " ", "").replace("< 400", "< 80")}),
jailbreak as (select conv_id, bool_or(role = 'user' and regexp_matches(lower(bare), $re$(?i){_JAILBREAK_SQL}$re$)) as jailbreak from turns group by conv_id),
reasons as (
  select conv_id, list_filter([case when too_short then 'too_short' end, case when too_long then 'too_long' end, case when empty_assistant then 'empty_assistant' end, case when sterile then 'sterile' end,
    case when jailbreak then 'jailbreak' end, case when duplicate then 'duplicate' end, case when system_too_long then 'system_too_long' end, case when conv_id in (select conv_id from bad) then 'bad_formatting' end], lambda x: x is not null) as r
  from structure join sterile using (conv_id) join jailbreak using (conv_id)
)"""


@query(f"{_REASONS} select conv_id, array_to_string(r, ',') as reasons, case when len(r) > 0 then 'rejected' else 'pass' end as route from reasons")
def conv_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return chats(spark, sf_dir).select("conv_id", F.array_join(chat.reasons(m, RULES), ",").alias("reasons"), chat.route(m, RULES).alias("route"))


@query(f"{_REASONS} select reason, count(*) as n from (select unnest(r) as reason from reasons) group by reason")
def conv_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select(F.explode(chat.reasons(F.col("messages"), RULES)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_MESSAGES}, bodies as (select *, case when roles[1] = 'system' then roles[2:] else roles end as b from messages)
select conv_id, len(b) > 0 and len(b) % 2 = 0 and b = list_transform(range(len(b)), lambda i: case when i % 2 = 0 then 'user' else 'assistant' end)
  and len(list_filter(texts, lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g') = '')) = 0 as kept from bodies"""
)
def conv_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.normalised(F.col("messages")).isNotNull().alias("kept"))


_ERRORS_SQL = """with turns as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)
select conv_id, count(*) filter (where role = 'system' and i > 0)
  + count(*) filter (where (role = 'system' and before is not null) or (role = 'user' and before is not null and before not in ('system', 'assistant')) or (role = 'assistant' and (before is null or before not in ('user', 'tool_result'))))
  + (count(*) filter (where role = 'assistant') = 0)::int as errors
from turns group by conv_id"""


@query(_ERRORS_SQL)
def gate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", F.size(chat.structure_errors(F.col("messages"))).cast("long").alias("errors"))


@query(
    f"""with {_MESSAGES} select conv_id, i - 1 as target, len(list_slice(messages, 1, i - 1)) as prompt_size, texts[i] as completion
from (select *, unnest(range(2, len(messages) + 1)) as i from messages) where roles[i] in ('assistant', 'tool_call') and texts[i] <> ''"""
)
def conv_sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chats(spark, sf_dir).select("conv_id", F.explode(chat.examples(F.col("messages"))).alias("e"))
    return made.select("conv_id", F.size("e.prompt").cast("long").alias("target"), F.size("e.prompt").cast("long").alias("prompt_size"), F.col("e.completion.content").alias("completion"))


@query("select conv_id, '<|bos|>' || string_agg('<|' || role || '|>' || chr(10) || text, '' order by turn) || '<|eos|>' as text from conversations group by conv_id")
def conv_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.template(F.col("messages")).alias("text"))


_PARTS = r"""parts as (
  select conv_id, turn, role, role || ':' || trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'https?://\S+', '<url>', 'g'), '\s+', ' ', 'g')) as part,
    row_number() over (partition by conv_id order by turn) as i
  from conversations
)"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).withColumn("parts", chat.normal_parts("messages"))


@query(f"with {_PARTS} select conv_id, sha256(string_agg(part, chr(10) order by turn)) as digest from parts group by conv_id")
def conv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("conv_id", chat.full_hash(F.col("parts")).alias("digest"))


@query(
    f"""with {_PARTS} select distinct t.conv_id, sha256(string_agg(p.part, chr(10) order by p.turn)) as h
from parts t join parts p on p.conv_id = t.conv_id and p.i < t.i where t.role in ('assistant', 'tool_call') and t.i > 1 group by t.conv_id, t.i"""
)
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("conv_id", F.explode(chat.prompt_hashes(F.col("messages"), F.col("parts"))).alias("h"))


@query(
    f"""with {_PARTS} select distinct t.conv_id, sha256(p.part) as h from parts t join parts p on p.conv_id = t.conv_id and p.i = t.i - 1
where t.role in ('assistant', 'tool_call') and p.role in ('user', 'tool_result')"""
)
def request_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("conv_id", F.explode(chat.request_hashes(F.col("messages"), F.col("parts"))).alias("h"))


_DIGESTS = f"""{_PARTS}, digests as (
  select conv_id, 's' || (conv_id % 3) as source, sha256(string_agg(part, chr(10) order by turn)) as digest, count(*) filter (where role in ('assistant', 'tool_call')) as targets from parts group by conv_id
)"""


@query(f"with {_DIGESTS} select conv_id, sha256('42:' || source || ':' || digest) as key, row_number() over (partition by source order by sha256('42:' || source || ':' || digest)) as place from digests")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _hashed(spark, sf_dir).select("conv_id", "source", chat.stable_key(SEED, F.col("source"), chat.full_hash(F.col("parts"))).alias("key"))
    return own.select("conv_id", "key", F.row_number().over(Window.partitionBy("source").orderBy("key")).cast("long").alias("place"))


@query(
    f"""with {_DIGESTS}, copies as (select digest, s.source from digests d, (select 's' || range as source from range(3)) s where d.source <> s.source)
select digest, arg_min(source, sha256('42:owner:' || digest || ':' || source)) as owner from copies group by digest"""
)
def cross_source_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that two of three sources hold, and who keeps them."""
    own = _hashed(spark, sf_dir).select(chat.full_hash(F.col("parts")).alias("digest"), F.col("source").alias("left_out"))
    copies = own.select("digest", "left_out", F.explode(F.array(*(F.lit(s.name) for s in SOURCES))).alias("source")).where("source <> left_out")
    return copies.groupBy("digest").agg(F.min_by("source", chat.stable_key(SEED, F.concat(F.lit("owner:"), F.col("digest")), F.col("source"))).alias("owner"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of even ids twice, leaked if they share a key with those whose id divides by 10."""
    own = chats(spark, sf_dir)
    twice = own.union(own.where("conv_id % 2 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000_000))
    rows = twice.select("source", F.lit("f").alias("file"), F.col("conv_id").alias("line"), "messages")
    return mixing.judged(rows, mixing.blocked_hashes(own.where("conv_id % 10 = 0 and exists(messages, m -> m.role = 'assistant')")), SEED)


_JUDGED = f"""{_DIGESTS}, targets as (select * from parts where role in ('assistant', 'tool_call')),
keys as (
  select conv_id, digest as h from digests union select t.conv_id, sha256(string_agg(p.part, chr(10) order by p.turn)) from targets t join parts p on p.conv_id = t.conv_id and p.i < t.i group by t.conv_id, t.i
  union select t.conv_id, sha256(p.part) from targets t join parts p on p.conv_id = t.conv_id and p.i = t.i - 1 where p.role in ('user', 'tool_result')
),
blocked as (select distinct h from keys where conv_id % 10 = 0 and conv_id in (select conv_id from targets)),
leaked as (select distinct conv_id from keys semi join blocked using (h)),
twice as (select conv_id, conv_id as line, source, digest, targets from digests union all select conv_id, conv_id + 1000000000, source, digest, targets from digests where conv_id % 2 = 0),
firsts as (select source, digest, min(line) as first from twice where targets > 0 and conv_id not in (select conv_id from leaked) group by all),
owners as (select digest, arg_min(source, sha256('42:owner:' || digest || ':' || source)) as owner from firsts group by digest),
judged as (
  select t.source, case when targets = 0 then 'no_trainable_target' when conv_id in (select conv_id from leaked) then 'validation_leakage' when line <> first then 'duplicate' when t.source <> owner then 'cross_source_duplicate' else 'eligible' end as status, targets, digest
  from twice t left join firsts using (source, digest) left join owners using (digest)
)"""


@query(f"with {_JUDGED} select source, status, count(*) as records, sum(targets)::bigint as targets from judged group by all")
def mix_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("source", "status").agg(F.count(F.lit(1)).alias("records"), F.sum("targets").cast("long").alias("targets"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of a third of all eligible targets."""
    eligible = stored(_judged(spark, sf_dir).where("status = 'eligible'").select("source", "digest", "targets"))
    goal = (eligible.agg(F.sum("targets")).first()[0] or 0) // 3
    return mixing.select(eligible, SOURCES, max(1, goal), SEED)


# No source runs dry at a third of all targets, so one walk settles the mix.
_SELECTED = f"""{_JUDGED},
eligible as (select source, digest, targets, sha256('42:' || source || ':' || digest) as key from judged where status = 'eligible'),
weights as (select * from (values ('s0', 3.0::double), ('s1', 2.0::double), ('s2', 1.5::double)) t(source, weight)),
goal as (select greatest(1, coalesce(sum(targets), 0)::bigint // 3) as target from eligible),
shares as (select source, weight, target * weight / 6.5 as x, target from weights, goal),
quotas as (select source, weight, floor(x)::bigint + (row_number() over (order by floor(x) - x, source) <= target - sum(floor(x)) over ())::bigint as quota from shares),
queue as (select *, row_number() over (partition by source order by key) as i from eligible),
walk as (
  select source, quota, 0::bigint as i, 0::bigint as used, false as taken from quotas
  union all select w.source, quota, q.i, (used + case when used + q.targets <= quota then q.targets else 0 end)::bigint, used + q.targets <= quota from walk w join queue q on q.source = w.source and q.i = w.i + 1
),
chosen as (select q.source, q.digest, q.targets from queue q join walk w using (source, i) where taken)"""


@query(f"with recursive {_SELECTED} select source, digest, targets, sha256('42:mixed:' || digest) as mix_key from chosen")
def source_mix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(_selected(spark, sf_dir), SEED).select("source", "digest", "targets", "mix_key")


@query(
    f"""with recursive {_SELECTED}, sums as (select source, count(*) as eligible_records, sum(targets)::bigint as eligible_targets from eligible group by source),
taken as (select source, count(*) as selected_records, sum(targets)::bigint as selected_targets from chosen group by source)
select source, weight, coalesce(eligible_records, 0) as eligible_records, coalesce(eligible_targets, 0) as eligible_targets, coalesce(selected_records, 0) as selected_records, coalesce(selected_targets, 0) as selected_targets,
  coalesce(selected_targets / (select sum(selected_targets)::double from taken), 0.0) as share from weights left join sums using (source) left join taken using (source)"""
)
def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_selected(spark, sf_dir), SOURCES)


@query(
    """with raw as (select source, count(*)::double as w from documents where source is not null group by source), shares as (select source, 1000 * w / sum(w) over () as x from raw),
given as (select source, x, floor(x)::bigint as g from shares), left_over as (select 1000 - sum(g) as r from given)
select source, g + (row_number() over (order by g - x, source) <= r)::int as quota from given, left_over"""
)
def source_mix_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 documents shared out by the sources' sizes."""
    sizes = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("weight"))
    return mixing.allocate_rows(stored(sizes), 1000)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a tree: its turns as a chain, and every answer but the first twice; faults by the id's remainders."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    by = Window.partitionBy("conv_id").orderBy("turn")
    chain = turns.withColumn("i", F.row_number().over(by)).withColumn("parent", F.lag("turn").over(by))
    name = lambda c, t, tail="": F.concat(c.cast("string"), F.lit("-"), t.cast("string"), F.lit(tail))
    conv, turn = F.col("conv_id"), F.col("turn")

    def rows(df: DataFrame, tail: str, rank: Column) -> DataFrame:
        return df.select(
            F.when((conv % 13 == 5) & (F.col("i") == 2), F.lit("twin")).otherwise(name(conv, turn, tail)).alias("message_id"), conv.cast("string").alias("tree_id"),
            F.when((conv % 11 == 3) & (F.col("i") == 2), F.lit("gone")).when((conv % 7 == 6) & (F.col("i") == 2), name(conv, turn, tail)).otherwise(name(conv, F.col("parent"))).alias("parent_id"),
            F.col("text"), F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), F.lit("en").alias("lang"),
            (turn % 7 == 6).alias("deleted"), F.lit(False).alias("synthetic"), F.length("text").cast("long").alias("review_count"), F.lit(True).alias("review_result"),
            rank.cast("long").alias("rank"), F.lit(False).alias("rank_bad"),
        )

    extra = chain.where("role = 'assistant' and i > 2")
    return rows(chain, "", F.length("text") % 3).union(rows(extra, "b", F.when(turn % 2 == 0, F.length("text") % 2)))


_TREE_RULES = trees.PathRules(languages=("en",), max_turns=6, max_rank=1, min_reviews=60)
_TREES = """with recursive chain as (
  select conv_id, turn, role, text, row_number() over w as i, lag(turn) over w as parent from conversations where role <> 'system' window w as (partition by conv_id order by turn)
),
extended as (
  select *, '' as tail, length(text) % 3 as rank from chain union all select *, 'b', case when turn % 2 = 0 then length(text) % 2 end from chain where role = 'assistant' and i > 2
),
nodes as (
  select case when conv_id % 13 = 5 and i = 2 then 'twin' else conv_id || '-' || turn || tail end as id, conv_id::varchar as tree,
    case when conv_id % 11 = 3 and i = 2 then 'gone' when conv_id % 7 = 6 and i = 2 then conv_id || '-' || turn || tail when parent is not null then conv_id || '-' || parent end as parent,
    case when role = 'user' then 'prompter' else role end as role, text, turn % 7 = 6 as deleted, length(text) as reviews, rank
  from extended
),
ids as (select id, count(*) as n from nodes group by id),
first_trouble as (
  select tree, arg_min(case when parent = id then 'cycle' else 'missing_parent' end, id) as r from nodes n
  where parent = id or (parent is not null and not exists (select 1 from ids where ids.id = n.parent and ids.n = 1)) group by tree
),
sound as (
  select tree, case when max(n) > 1 then 'duplicate_message_id' when count(*) filter (where parent is null) <> 1 then 'invalid_root_count' else any_value(r) end as reason
  from nodes join ids using (id) left join first_trouble using (tree) group by tree
),
walk as (
  select tree, id, [{'role': role, 'deleted': deleted, 'size': length(text), 'reviews': reviews, 'rank': rank}] as path from nodes semi join (select tree from sound where reason is null) using (tree) where parent is null
  union all select n.tree, n.id, list_append(path, {'role': n.role, 'deleted': n.deleted, 'size': length(n.text), 'reviews': n.reviews, 'rank': n.rank}) from walk w join nodes n on n.parent = w.id and n.tree = w.tree
),
leaves as (select * from walk w where not exists (select 1 from nodes n where n.parent = w.id and n.tree = w.tree)),
judged as (
  select tree, id as leaf_id, len(path) as n, list_filter(path, lambda x: x.role = 'assistant') as answers,
    case when len(list_filter(path, lambda x: x.deleted)) > 0 then 'deleted'
      when list_transform(path, lambda x: x.role) <> list_transform(range(len(path)), lambda i: case when i % 2 = 0 then 'prompter' else 'assistant' end) then 'invalid_role_alternation'
      when path[-1].role <> 'assistant' then 'non_assistant_leaf' when len(path) > 6 then 'too_many_turns'
      else list_filter(list_transform(path, lambda x: case when x.role = 'assistant' and x.reviews < 60 then 'insufficient_reviews' when x.role = 'assistant' and x.rank > 1 then 'rank_above_max' end), lambda x: x is not null)[1] end as reason
  from leaves
),
best as (
  select tree, arg_min(leaf_id, {'a': len(list_filter(answers, lambda x: x.rank is null)) > 0, 'b': coalesce(list_sum(list_transform(answers, lambda x: x.rank)) / len(list_filter(answers, lambda x: x.rank is not null)), 9e18), 'c': -n, 'd': leaf_id}) as leaf_id
  from judged where reason is null group by tree
)"""


@query(f"{_TREES} select tree as tree_id, leaf_id, n from best join judged using (tree, leaf_id)")
def tree_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.convert(_nodes(spark, sf_dir), _TREE_RULES)[0].select("tree_id", "leaf_id", F.size("path").cast("long").alias("n"))


@query(
    f"""{_TREES} select 'tree' as kind, coalesce(reason, case when leaf_id is null then 'no_valid_candidate' else 'selected' end) as reason, count(*) as n from sound left join best using (tree) group by all
union all select 'candidate', coalesce(reason, 'valid'), count(*) from judged group by all"""
)
def tree_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, by_tree, candidates = trees.convert(_nodes(spark, sf_dir), _TREE_RULES)
    kinds = by_tree.select(F.lit("tree").alias("kind"), F.coalesce("reason", F.lit("selected")).alias("reason")).union(candidates.select(F.lit("candidate"), F.coalesce("reason", F.lit("valid"))))
    return kinds.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, len(t) as n, list_sum(t)::bigint as total, t[1] as first from (select doc_id, list_append(list_transform(string_split(text, ''), lambda c: unicode(c) % 48000), 2) as t from documents where text <> '')")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ids pass a generator, so that each array function reads them instead of making them again
    ids = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.explode(F.array(tokens.char_ids(F.col("text")))).alias("t"))
    return stored(ids.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("t")[0].alias("first")), at_once=SMALL)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").where("length(text) > 100").select("doc_id", tokens.char_ids(F.col("text")).alias("ids")), at_once=SMALL)
    return tokens.offsets(docs, "doc_id", F.size("ids"))


_STREAM = """docs as (select doc_id, text, sum(length(text) + 1) over (order by doc_id rows unbounded preceding) - length(text) - 1 as start from documents where length(text) > 100)"""


@query(f"with {_STREAM} select doc_id, start::bigint as start, (start // 100000)::bigint as shard, length(text) + 1 as n from docs")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select("doc_id", "start", F.floor(F.col("start") / 100_000).cast("long").alias("shard"), F.size("ids").cast("long").alias("n"))


@query(
    f"""with {_STREAM}, flat as (select start + i - 1 as g, case when i <= length(text) then unicode(text[i]) % 48000 else 2 end as token from (select text, start, unnest(range(1, length(text) + 2)) as i from docs)),
size as (select greatest(1, count(*) // 257 - 1) as n from flat),
placed as (select g // 256 as item, g, token from flat union all select g // 256 - 1, g, token from flat where g % 256 = 0 and g > 0)
select item::bigint as item, sum(token * (g - item * 256 + 1))::bigint as weighted, count(*) as filled from placed, size where item < n group by item"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 tokens and one more, as sums weighted by place."""
    made = tokens.windows(_stream(spark, sf_dir), 256)
    weighted = F.aggregate(F.transform("tokens", lambda t, i: t.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("item", weighted.alias("weighted"), F.size("tokens").cast("long").alias("filled"))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chats(spark, sf_dir).select("conv_id", F.explode(chat.examples(F.col("messages"))).alias("e"))
    ids = T.once(made, "x", p=tokens.char_ids(chat.template(F.col("e.prompt"), True), None), a=tokens.char_ids(F.col("e.completion.content")))
    return ids.select("conv_id", F.size("e.prompt").alias("target"), "x.p", "x.a")


_EXAMPLES = f"""{_MESSAGES}, examples as (
  select conv_id, i - 1 as target, string_split('<|bos|>' || array_to_string(list_transform(list_slice(messages, 1, i - 1), lambda m: '<|' || m.role || '|>' || chr(10) || m.content), '') || '<|assistant|>' || chr(10), '') as p, string_split(texts[i], '') as a
  from (select *, unnest(range(2, len(messages) + 1)) as i from messages) where roles[i] in ('assistant', 'tool_call') and texts[i] <> ''
),
ids as (select conv_id, target, list_transform(p, lambda c: unicode(c) % 48000) as p, list_append(list_transform(a, lambda c: unicode(c) % 48000), 2) as a from examples)"""


@query(
    f"""with {_EXAMPLES}, cut as (select *, least(len(p), greatest(1, least(512, greatest(16, 513 // 4)))) as room from ids),
answers as (select conv_id, target, p, case when len(a) >= 513 then list_append(a[1:513 - room - 1], 2) else a end as a from cut),
kept as (select *, greatest(0, least(len(p), 513 - len(a))) as keep from answers),
joined as (select conv_id, target, keep, list_concat(case when keep > 0 then p[len(p) - keep + 1:] else [] end, a) as x from kept),
padded as (select conv_id, target, keep, list_concat(x, list_transform(range(513 - len(x)), lambda i: 0)) as x from joined)
select conv_id, target, len(x) - 1 as n, list_sum(x[1:512])::bigint as input_sum, list_sum(list_transform(range(1, 513), lambda i: case when i - 1 < greatest(0, keep - 1) or x[i + 1] = 0 then -100 else x[i + 1] end))::bigint as label_sum from padded"""
)
def sft_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.once(tokens.with_training_example(_framed(spark, sf_dir), "p", "a", 512), "x", input_ids=F.col("input_ids"), labels=F.col("labels"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return stored(made.select("conv_id", F.col("target").cast("long").alias("target"), F.size("x.input_ids").cast("long").alias("n"), total("x.input_ids").alias("input_sum"), total("x.labels").alias("label_sum")), at_once=SMALL)


@query(
    f"""with {_EXAMPLES}, heads as (select conv_id, target, p[1:512 // 3] as h, a, list_reverse(a) as r from ids), pairs as (select conv_id, target, h, list_concat(h, a)[1:512] as c, list_concat(h, r)[1:512] as d from heads)
select conv_id, target, len(h) as prompt_len, list_sum(c)::bigint as chosen_sum, list_sum(list_transform(range(1, len(d) + 1), lambda i: i * d[i]))::bigint as rejected_sum from pairs"""
)
def dpo_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer against itself backwards."""
    made = stored(stored(_framed(spark, sf_dir), at_once=SMALL).select("conv_id", "target", tokens.preference_example(F.col("p"), F.col("a"), F.reverse("a"), 512).alias("x")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = F.transform("x.rejected_ids", lambda t, i: t.cast("long") * (i + 1))
    return made.select("conv_id", F.col("target").cast("long").alias("target"), F.col("x.prompt_len").cast("long").alias("prompt_len"), total("x.input_ids").alias("chosen_sum"), total(weighted).alias("rejected_sum"))


_QUOTA_LANGUAGES = ["en", "de", "it"]


@query(
    """with domain as (select unnest(['en', 'de', 'it']) as language), sources as (select unnest(['src0', 'src1', 'none']) as source),
whole as (select language as location, count(doc_id) as n from domain left join documents on lang = language group by language),
pairs as (select s.source || ' x ' || language as location, count(doc_id) as n from domain cross join sources s left join documents d on lang = language and d.source = s.source group by all)
select location, 'expected 5 rows, found ' || n as error from (select * from whole union all select * from pairs) where n <> 5"""
)
def gate_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), "source")
    return gate.quotas(docs, "category", _QUOTA_LANGUAGES, 5).union(gate.quotas(docs, "category", _QUOTA_LANGUAGES, 5, "source", ["src0", "src1", "none"]))


@query("select sha256(text) as location, 'duplicate content' as error from documents group by text having count(*) > 1")
def gate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.repeated(table(spark, sf_dir, "documents"), F.sha2("text", 256), "content")


@query("select event_id, case when event_id % 4 = 0 then 'extra,messages' when event_id % 4 = 1 then '' else 'messages' end as keys, event_id % 4 > 1 as exact from events")
def gate_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of JSON records made from events, and whether they are exactly what a record must have."""
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, '{"messages":[],"extra":1}').when(kind == 1, "{}").otherwise('{"messages":[]}')
    keys = F.array_sort(F.json_object_keys(raw))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(keys, ",").alias("keys"), (F.array_join(keys, ",") == "messages").alias("exact"))


@query("select range as step, round(case when range < 100 then 3e-4 * range / 100 else 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * (range - 100) / 900)) end, 12) as rate from range(1200)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1200).select(F.col("id").alias("step"), F.round(tokens.learning_rate(F.col("id"), 100, 1000, 3e-4, 3e-5), 12).alias("rate"))


@query("select event_id, round(ln(1 + exp(-m)), 6) as loss, case when m > 0 then 1.0::double else 0.0::double end as accuracy, round(m, 6) as margin from (select event_id, 0.1 * ((value - 50) - (event_id % 17 - 8)) as m from events)")
def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokens.preference_loss(F.col("value"), F.col("event_id") % 17, F.lit(50), F.lit(8), 0.1)
    return table(spark, sf_dir, "events").select("event_id", made.alias("x")).select("event_id", F.round("x.loss", 6).alias("loss"), F.col("x.accuracy").alias("accuracy"), F.round("x.margin", 6).alias("margin"))


@query(
    r"""with turns as (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as bare from conversations),
made as (
  select conv_id, turn, role, bare = '' as blank,
    case when role = 'assistant' then '{"n":' || length(text) || '}' else bare end as content
  from turns where role <> 'system'
),
whole as (
  select conv_id, 'system:Available tools:' || chr(10) || '[{"name":"f"}]' || chr(10) || string_agg(case when role = 'assistant' then 'tool_call' else role end || ':' || content, chr(10) order by turn) as messages,
    sum(length(content)) + length('Available tools:' || chr(10) || '[{"name":"f"}]') as n, bool_or(role not in ('user', 'assistant')) as odd
  from made group by conv_id
)
select conv_id, case when n <= 8000 and not odd and conv_id not in (select conv_id from turns where role <> 'assistant' and bare = '') then messages end as messages
from whole where conv_id in (select conv_id from turns where role = 'user') and conv_id in (select conv_id from turns where role = 'assistant')"""
)
def tool_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations dressed as tool calls, through the adapter."""
    own = chats(spark, sf_dir).where(F.exists("messages", lambda m: m.role == "user") & F.exists("messages", lambda m: m.role == "assistant"))
    sender = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    value = lambda m: F.when(m.role == "assistant", F.concat(F.lit('<tool_call>{"n": '), F.length(m.content).cast("string"), F.lit("}</tool_call>"))).otherwise(m.content)
    rows = own.select(F.col("conv_id").alias("id"), F.lit('[{"name": "f"}]').alias("tools"), F.transform("messages", lambda m: F.struct(sender(m.role).alias("from"), value(m).alias("value"))).alias("conversations"))
    return tool_messages(rows).select(F.col("id").alias("conv_id"), F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n").alias("messages"))


_CANONICAL = """canonical as (
  select conv_id, sha256('{"messages":[' || string_agg('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}', ',' order by turn) || ']}') as canonical,
    sha256('[' || string_agg('{"content": ' || to_json(text) || ', "role": ' || to_json(role) || '}', ', ' order by turn) || ']') as spaced, count(*) filter (where role in ('assistant', 'tool_call')) as targets
  from conversations group by conv_id
)"""


@query(f"with {_CANONICAL} select conv_id, canonical, spaced from canonical")
def conv_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", chat.sha256(chat.canonical_json("messages")).alias("canonical"), chat.sha256(chat.spaced_json("messages")).alias("spaced"))


@query(f"with {_CANONICAL} select canonical as digest from canonical")
def conv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    writers.write_conversations(chats(spark, sf_dir), path)
    return readers.conversations(spark, path).select(chat.sha256(chat.canonical_json("messages")).alias("digest"))


@query(f"""with {_CANONICAL}, own as (select distinct spaced as digest, targets, sha256('42:s:' || spaced) as key from canonical),
summed as (select digest, targets, sum(targets) over (order by key) - targets as before from own)
select digest, targets from summed where before < (select greatest(1, sum(targets)::bigint // 2) from own)""")
def quota_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct conversations in pseudo-random order up to half of all targets."""
    rows = chats(spark, sf_dir).select(chat.sha256(chat.spaced_json("messages")).alias("digest"), "messages", chat.targets(F.col("messages")).cast("long").alias("targets"))
    rows = stored(rows)
    half = (rows.dropDuplicates(["digest"]).agg(F.sum("targets")).first()[0] or 0) // 2
    return until_quota(rows, max(1, half), SEED, "s").select("digest", "targets")


@query(
    """select conv_id, turn, case turn % 3 when 0 then '{"n":' || length(text) || ',"t":[1,2]}' when 1 then '[{"n":' || length(text) || '},{"m":1.5}]' end as value from conversations"""
)
def tagged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON between tags: one value, two in upper and lower case, and one that is broken."""
    n = F.length("text").cast("string")
    one, two = F.concat(F.lit('a <call>{"n": '), n, F.lit(', "t": [1, 2]}</call> b')), F.concat(F.lit('<call>{"n":'), n, F.lit('}</call><CALL>\n{"m": 1.50} </CALL>'))
    text = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, two).otherwise(F.concat(one, F.lit("<call>{</call>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.tagged_json(text, F.lit("call")).alias("value"))


def _general_sql(max_turns: int) -> str:
    """CTEs to `general`: whether a normalised conversation passes as one of a general source."""
    cut = lambda sql: sql.replace(f"with {_TURNS}, ", "").replace(f"with {_TURNS} ", "")
    structure = cut(_STRUCTURE).replace("targets as (", "with targets as (", 1).replace(">= 200", ">= 10").replace("c.n > 4", f"c.n > {max_turns}").replace("> 100)", "> 1000)")
    return rf"""turns as (select conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') as bare, bare as text from conversations), {_BAD.replace("0.08", "0.3")}, structure as ({structure}),
sterile as ({cut(_sterile_sql()).replace("< 400", "< 80")}),
jailbreak as (select conv_id, bool_or(role = 'user' and regexp_matches(lower(bare), $re$(?i){_JAILBREAK_SQL}$re$)) as jailbreak from turns group by conv_id),
play as (select conv_id, bool_or(role = 'assistant' and regexp_matches(bare, $re$(?im){_ROLEPLAY_SQL}$re$)) as roleplay from turns group by conv_id),
lists as (select conv_id, list(role order by turn) as roles, list(text order by turn) as texts, sum(length(text)) as chars, count(*) filter (where role = 'assistant') as answers, arg_min(text, turn) filter (where role = 'user') as first from turns group by conv_id),
bodies as (select *, case when roles[1] = 'system' then roles[2:] else roles end as b from lists),
normal as (select *, len(b) > 0 and len(b) % 2 = 0 and b = list_transform(range(len(b)), lambda i: case when i % 2 = 0 then 'user' else 'assistant' end) and not list_contains(texts, '') as ok from bodies),
general as (
  select conv_id, ok and chars <= 8000 and not (too_short or too_long or empty_assistant or sterile or jailbreak or duplicate or system_too_long or roleplay) and conv_id not in (select conv_id from bad) as good, answers, first, chars
  from normal join structure using (conv_id) join sterile using (conv_id) join jailbreak using (conv_id) join play using (conv_id)
)"""


@query(f"with {_general_sql(12)} select conv_id, good from general")
def conv_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chats(spark, sf_dir).select("conv_id", chat.normalised(F.col("messages")).alias("m"))
    return own.select("conv_id", F.coalesce(chat.general_quality(F.col("m")), F.lit(False)).alias("good"))


_BLOCKED_SQL = " or ".join(f"contains(lower(first), '{term}')" for term in chat.CASUAL_BLOCKLIST)


@query(
    f"""with {_general_sql(10)}
select conv_id, conv_id % 5 <> 0 and good and answers >= 2 as dialogue, conv_id % 5 <> 0 and good and answers <= 2 and length(first) <= 300 and chars <= 3000 and not ({_BLOCKED_SQL}) as casual from general"""
)
def conv_wildchat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two uses of a conversation, a fifth of them toxic."""
    own = chats(spark, sf_dir).select("conv_id", chat.wildchat(F.col("messages"), F.col("conv_id") % 5 == 0).alias("w"))
    return own.select("conv_id", "w.dialogue", "w.casual")


@query(
    r"""with firsts as (select conv_id, case when conv_id % 3 <> 0 then arg_min(text, turn) filter (where role = 'user') end as q, case when conv_id % 7 <> 0 then arg_max(text, turn) filter (where role = 'assistant') end as a from conversations group by conv_id)
select conv_id, 'user:' || regexp_replace(q, '^\s+|\s+$', '', 'g') || chr(10) || 'assistant:' || regexp_replace(a, '^\s+|\s+$', '', 'g') as messages from firsts"""
)
def conv_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request and an answer as two messages, without either none."""
    turns = table(spark, sf_dir, "conversations")
    own = turns.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    made = own.select("conv_id", chat.instruction_messages(F.lit(None).cast(chat.MESSAGES), F.when(F.col("conv_id") % 3 != 0, F.col("q")), F.when(F.col("conv_id") % 7 != 0, F.col("a"))).alias("m"))
    return made.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n").alias("messages"))


@query(
    f"""with {_STREAM}, flat as (select start + i - 1 as g, case when i <= length(text) then unicode(text[i]) % 48000 else 2 end as token from (select text, start, unnest(range(1, length(text) + 2)) as i from docs))
select (g // 100000)::bigint as shard, count(*) as tokens, sum(token * (g % 100000 + 1))::bigint as weighted from flat group by shard"""
)
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 100,000 tokens, as sums weighted by place."""
    parts = tokens.shards(_stream(spark, sf_dir), 100_000)
    weighted = F.aggregate(F.transform("ids", lambda t, i: t.cast("long") * (F.col("at") + i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return parts.select("shard", F.size("ids").alias("n"), weighted.alias("w")).groupBy("shard").agg(F.sum("n").alias("tokens"), F.sum("w").alias("weighted"))


@query(
    """with scaled as (select event_id // 8 as step, event_id % 8 as token, value / 10 / 0.7 as x from events), top as (select *, rank() over (partition by step order by x desc) as r from scaled),
shares as (select *, exp(x - max(x) over (partition by step)) as w from top where r <= 5),
summed as (select *, (sum(w) over (partition by step order by x desc, token rows unbounded preceding) - w) / sum(w) over (partition by step) as before from shares)
select step, token, round(w / sum(w) over (partition by step), 9) as p from summed where before <= 0.9"""
)
def sampling_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sampler may draw, with the values of events as logits of eight tokens a step."""
    logits = table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("step"), (F.col("event_id") % 8).alias("token"), (F.col("value") / 10).alias("logit"))
    return corpus.sampling_mask(logits, 5, 0.9, 0.7).withColumn("p", F.round("p", 9))


@query(
    """with own as (select event_id // 16 as item, event_id, value, row_number() over (partition by event_id // 16 order by event_id) - 1 as i from events)
select item, round(sum(case when i >= item % 5 and event_id % 7 not in (0, 2) then -value else 0 end), 6) as log_p from own group by item"""
)
def completion_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability sums of answers, with the values of events as what is predicted."""
    own = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 16").alias("item")).agg(F.array_sort(F.collect_list(F.struct("event_id", (-F.col("value")).alias("p"), (F.col("event_id") % 7).alias("t")))).alias("x"))
    return own.select("item", F.round(tokens.completion_log_probability(F.col("x.p"), F.col("x.t"), F.col("item") % 5 + 1), 6).alias("log_p"))


@query(
    """select case (conv_id + turn) % 6 when 1 then 'malformed_record' when 2 then 'invalid_message_id' when 3 then 'invalid_tree_id' when 4 then 'invalid_parent_id' when 5 then 'malformed_record' end as reason, count(*) as n from conversations group by reason"""
)
def node_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes from JSON of right and wrong types."""
    kind, turn = (F.col("conv_id") + F.col("turn")) % 6, F.col("turn").cast("string")
    record = lambda message, tree, parent: F.concat(F.lit('{"message_id":'), message, F.lit(f',"message_tree_id":{tree},"parent_id":{parent}}}'))
    quoted = F.concat(F.lit('"'), turn, F.lit('"'))
    raw = F.when(kind == 1, F.lit("no json")).when(kind == 2, record(turn, '"t"', "null")).when(kind == 3, record(quoted, '""', "null")).when(kind == 4, record(quoted, '"t"', "7")).when(kind == 5, F.lit("[1]")).otherwise(record(quoted, '"t"', "null"))
    return trees.parse_nodes(table(spark, sf_dir, "conversations").select(raw.alias("raw"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_GATE_ERRORS = ["keys must be exactly messages", "conversation found in training data", "target prompt found in training data", "metadata lacks license", "metadata line differs", "content_sha256 differs", "unknown language"]


@query(
    f"""with {_PARTS}, own as (select conv_id, row_number() over (order by conv_id) as line from conversations group by conv_id),
wrong as ({_ERRORS_SQL}),
hashes as (select conv_id, sha256(string_agg(part, chr(10) order by turn)) as h from parts group by conv_id),
prompts as (select t.conv_id, t.i, sha256(string_agg(p.part, chr(10) order by p.turn)) as h from parts t join parts p on p.conv_id = t.conv_id and p.i < t.i where t.role in ('assistant', 'tool_call') and t.i > 1 group by t.conv_id, t.i),
good as (select * from own join wrong using (conv_id) where errors = 0)
select 'line ' || line as location, 'keys must be exactly messages' as error from own where line % 10 = 3
union all select 'line ' || line, 'conversation found in training data' from good join hashes using (conv_id) where h in (select h from hashes where conv_id % 10 = 0)
union all select distinct 'line ' || line, 'target prompt found in training data' from good join prompts using (conv_id) where h in (select h from prompts where conv_id % 10 = 0)
union all select 'line ' || line, 'metadata lacks license' from good where line % 10 = 4
union all select 'line ' || line, 'metadata line differs' from good where line % 10 = 5
union all select 'line ' || line, 'content_sha256 differs' from good where line % 10 = 1
union all select 'line ' || line, 'unknown language' from good where line % 10 = 6"""
)
def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all conversations and metadata with faults by the line, against a tenth of them as training data."""
    own = stored(chats(spark, sf_dir).select("conv_id", "messages"))
    numbered = stored(tokens.offsets(own, "conv_id", F.lit(1)).withColumn("line", F.col("start") + 1))
    fault = F.col("line") % 10
    data = numbered.select("line", F.when(fault == 3, F.array(F.lit("messages"), F.lit("x"))).otherwise(F.array(F.lit("messages"))).alias("keys"), "messages")
    keys = F.array(*map(F.lit, gate.METADATA_KEYS))
    about = numbered.select(
        F.col("line").alias("position"), F.when(fault == 4, F.array_remove(keys, "license")).otherwise(keys).alias("keys"), (F.col("line") + (fault == 5).cast("int")).alias("line"), F.col("line").cast("string").alias("id"), F.when(fault == 6, "xx").otherwise("en").alias("language"),
        F.lit("math").alias("category"), F.lit("easy").alias("difficulty"), F.lit("human_authored").alias("origin_type"), F.lit("curated").alias("review_status"), F.when(fault == 1, "0").otherwise(chat.sha256(chat.canonical_json("messages"))).alias("content_sha256"),
    )
    found = gate.check(data, about, own.where("conv_id % 10 = 0").select("messages"))
    return found.where(F.col("error").isin(*_GATE_ERRORS))


@query(f"with {_VERDICTS} select doc_id, quality, reason from verdicts")
def verdict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text filter over documents as a stream, all that is there in one run."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    stream = streaming.verdicts(spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque?").select("doc_id", "text"), _RULES)  # a pattern, as a single file is no folder
    made = stream.select("doc_id", "verdict.quality", "verdict.reason")
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
