"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, grade, hosts, language, lattice, lm, packing, simhash, spans, wrappers
from granary.llm.common import documents, held_out


def op1_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability by counts and by the model, learned outside the held-out fold."""
    held = held_out("doc_id", 7)
    found = lm.score(documents(spark, sf_dir), held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Documents that are less likely to be good are rejected; low, so that good ones stay.
LEAST_GOOD = 0.2


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it is the one to keep."""
    found = lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that near-copies lead to."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade (0 toxic, 1 poor, 2 good), its probability of being good, and the verdict, learned from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    ratings = grade.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = grade.fit(docs, ratings.where(~held_out("doc_id", 5)))
    return grade.rate(docs, model, tail=2, least=LEAST_GOOD).select("doc_id", held_out("doc_id", 5).alias("held_out"), "expected_grade", F.col("tail").alias("p_good"), "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2,048 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(~held_out("doc_id", 4)))
    return language.identify(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 50 words that a smaller document has."""
    found = spans.remove_repeated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rule measures and the verdict of its text and host."""
    return hosts.judge(documents(spark, sf_dir)).select("doc_id", *hosts.MEASURES, "base_failed", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back, with digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(documents(spark, sf_dir), ranks), ranks)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_log_bilinear": op1_log_bilinear,
        "op2_lattice": op2_lattice,
        "op3_simhash": op3_simhash,
        "op4_grade": op4_grade,
        "op5_packing": op5_packing,
        "op6_language": op6_language,
        "op7_spans": op7_spans,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_host_rules": op9_host_rules,
        "op10_wrappers": op10_wrappers,
    }


# Each word of each document with its place, from 1.
_WORDS = r"""
words as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)
)"""

_OP7 = f"""
with {_WORDS},
windows as (
  select doc_id, pos, string_agg(word, ' ') over w as words, count(*) over w as n
  from words window w as (partition by doc_id order by pos rows between current row and 49 following)
),
repeated as (
  select doc_id, pos from (select doc_id, pos, min(doc_id) over (partition by md5(words)) as low from windows where n = 50) where low < doc_id
),
marked as (
  select w.doc_id, w.pos, w.word, max(case when r.pos is not null then w.pos end) over (partition by w.doc_id order by w.pos) as latest
  from words w left join repeated r using (doc_id, pos)
)
select d.doc_id, count(m.pos) as n_words, count(m.pos) filter (where m.latest is not null and m.pos - m.latest < 50) as n_removed,
  sha256(coalesce(string_agg(m.word, ' ' order by m.pos) filter (where m.latest is null or m.pos - m.latest >= 50), '')) as kept_sha256
from documents d left join marked m using (doc_id) group by d.doc_id
"""

_OP9 = rf"""
with {_WORDS},
windows as (
  select doc_id, pos, string_agg(word, ' ') over w as words, count(*) over w as n
  from words window w as (partition by doc_id order by pos rows between current row and 4 following)
),
repeated as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, words) as c from windows where n = 5) where c > 1),
covered as (
  select w.doc_id, w.pos, w.word, max(case when r.pos is not null then w.pos end) over (partition by w.doc_id order by w.pos) as latest
  from words w left join repeated r using (doc_id, pos)
),
counted as (
  select doc_id, count(*) as n_words, sum(length(word))::bigint as word_chars, count(*) filter (where latest is not null and pos - latest < 5) as n_repeat_words
  from covered group by doc_id
),
lines as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
),
measured as (
  select d.doc_id, d.source, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from documents d left join counted using (doc_id) left join lines using (doc_id)
),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured),
hosts as (select source, sum(base_failed::int)::double as failed, count(*)::double as total from judged where source is not null group by source),
sums as (select sum(failed) as f, sum(total) as n, count(*) as k, sum(failed * failed / total) as q from hosts),
means as (select *, least(greatest(f / n, 1e-6), 1 - 1e-6) as m from sums),
prior as (select m, least(greatest(m * (1 - m) / greatest(q / n - m * m - m * (1 - m) * k / n, 1e-9) - 1, 2.0), 1e6) as s from means),
rates as (select source, (failed + m * s) / (total + s) as rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(rate, 0) <= 0.5 as kept
from judged left join rates using (source)
"""


# All pairs and all that can be reached: for small tables.
_OP2 = """
with recursive vectors as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98
),
reached as (select vec_id as a, vec_id as b from vectors union select r.a, l.b from reached r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reached group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0) as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join least on least.a = e.vec_id left join counts on counts.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lattice": _OP2, "op7_spans": _OP7, "op9_host_rules": _OP9}
