"""Removal of near-duplicates in input order, by the Jaccard similarity of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from granary.functions import text as T
from granary.plans.durable import SMALL, discard, stored

#: Elements that are signed at once.
_SLICE = 500_000


def _sizes(most: int, wide: float = 1.4) -> np.ndarray:
    """Where groups of set sizes begin, up to the group that holds `most`: each spans a factor of `wide`."""
    own = [1]
    while own[-1] <= most:
        own.append(max(own[-1] + 1, int(own[-1] * wide)))
    return np.array(own, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(values: np.ndarray, n: np.ndarray, more_than: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (their sorted elements, one set after the other, and their sizes), and how many each has."""
    begins = _sizes(int(n.max(initial=1) / max(more_than, 1e-6)) + 1)
    group = lambda size: np.searchsorted(begins, size, "right") - 1
    low, high = group(n), group((n / max(more_than, 1e-6)).astype(np.int64))
    spans = np.where(n > 0, high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), spans)
    own = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
    parts = ((begins[own + 1] - 1) * 2 * (1 - more_than) / (1 + more_than) + 1e-6).astype(np.int64) + 1
    size, base = n[row], np.cumsum(parts) - parts
    job = np.repeat(np.arange(len(row)), size)
    e = values[np.arange(len(job)) + np.repeat((np.cumsum(n) - n)[row] - np.cumsum(size) + size, size)].astype(np.uint64) ^ np.uint64(1 << 63)
    part = base[job] + (((e >> np.uint64(32)) * parts[job].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(np.bincount(part, minlength=int(parts.sum())))
    sums = np.r_[np.uint64(0), np.cumsum(_mixed(e))]
    place = np.arange(len(ends)) - np.repeat(base, parts)
    which = (np.repeat(own, parts) << 40 | place).astype(np.uint64)
    out = _mixed(sums[ends] - sums[np.r_[0, ends[:-1]]] + _mixed(which + np.uint64(0x9E3779B97F4A7C15)))
    return out.view(np.int64), np.bincount(row, weights=parts, minlength=len(n)).astype(np.int64)


def signatures(s: Column, more_than: float) -> Column:
    """Numbers of a sorted set of hashes of which two sets of a similarity above more_than share one at least.

    Of sets of at most h elements fewer than 2 * h * (1 - more_than) / (1 + more_than) + 1 are in one of the two only. Cut into more
    ranges of hashes than that, they agree in a whole range. h is the end of a group of sizes; a set signs for its own group
    and for those of the larger sets that may be similar.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def sign(sets: pa.Array) -> pa.Array:
        n = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values, at, done = sets.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)], []
        start = 0
        for i in range(1, len(n) + 1):
            if at[i] - at[start] >= _SLICE or i == len(n):
                done.append(_signed(values[at[start] : at[i]], n[start:i], more_than))
                start = i
        ends = np.cumsum(np.concatenate([c for _, c in done])) if done else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)))

    return sign(s)


def prefixes(sets: DataFrame, more_than: float) -> DataFrame:
    """Rows (id, n, e): the elements of rows (id, s) through which sets of a similarity above more_than must meet.

    Two such sets share one of their first n - ceil(more_than * n) + 1 elements from rare to frequent; elements of one set alone are left out.
    """
    elements = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("e"))
    counts = elements.groupBy("e").count()
    ranked = elements.join(counts.where("count > 1"), "e", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("c"), "e"))).alias("r"))
    first = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * more_than) + 1).cast("int"))
    return ranked.select("id", "n", F.explode(F.filter(first, lambda x: x.c > 1)).alias("x")).select("id", "n", F.col("x.e").alias("e"))


def _verified(candidates: DataFrame, sets: DataFrame, more_than: float) -> DataFrame:
    both = candidates.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) > more_than).select("a", "b")


def similar_pairs(met: DataFrame, sets: DataFrame, more_than: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets with a similarity above more_than, among those that meet in rows (id, n, e)."""
    a, b = met.toDF("a", "na", "e"), met.toDF("b", "nb", "e")
    near = (F.least("na", "nb") > F.greatest("na", "nb") * more_than) & (F.col("a") < F.col("b"))
    return _verified(a.join(b, "e").where(near).select("a", "b").distinct(), sets, more_than)


def without_led(met: DataFrame, sets: DataFrame, more_than: float, crowded: int = 20) -> tuple[DataFrame, list[DataFrame]]:
    """met less the sets that are decided by comparing with the smallest ids only, and the ids that go.

    A set with the smallest id at each of its elements has no smaller neighbour and stays; the sets that it meets go if they are
    similar. That is a row for each element, where all pairs of a group of m near-copies would be m * m / 2. It is repeated
    while pairs would be over `crowded` times the rows and a round decides a twentieth of them.
    """
    gone: list[DataFrame] = []
    while True:
        size = met.groupBy("e").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).first()
        if not size["rows"] or size["pairs"] <= crowded * size["rows"]:
            return met, gone
        leaders = stored(met.groupBy("e").agg(F.min(F.struct("id", "n")).alias("l")))
        led = stored(met.join(leaders, "e").select("id", "n", "e", F.col("l.id").alias("lead"), F.col("l.n").alias("ln")))
        stay = stored(led.groupBy("id").agg(F.min("lead").alias("low")).where("low = id").select("id"))
        close = F.least("n", "ln") > F.greatest("n", "ln") * more_than
        pairs = led.where(close & (F.col("lead") < F.col("id"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        out = stored(_verified(pairs.join(stay, F.col("a") == F.col("id"), "left_semi"), sets, more_than).select(F.col("b").alias("id")).distinct())
        gone.append(out)
        left = stored(met.join(stay.union(out), "id", "left_anti"))
        slow = left.count() > 0.95 * size["rows"]
        met = left
        if slow:
            return met, gone


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that stay when each, in order, goes if a smaller one that stays is its neighbour: rounds keep all whose smaller neighbours are decided. Each round's ids are a table, read as one in the end."""
    spark, gone_at = nodes.sparkSession, []
    edges = stored(edges)
    while edges.limit(1).count():
        low = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        gone = stored(edges.join(low, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct())
        gone_at.append(gone._stored_at)
        left = stored(edges.join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti"))
        discard(edges)
        edges = left
    return nodes.join(spark.read.schema(gone.schema).parquet(*gone_at), "id", "left_anti") if gone_at else nodes


def _shingled(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, text) as rows (id, s.s): the sorted hashes of all shingles, none for texts of fewer words."""
    w = F.col("w.w")
    made = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    own = T.once(docs, "w", w=T.words(F.coalesce("text", F.lit("")))).select("id", "w")
    return T.once(own, "s", s=F.when(F.size(w) >= size, F.array_sort(F.array_distinct(made))).otherwise(F.array().cast("array<bigint>"))).select("id", "s")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", more_than: float = 0.9, size: int = 3, crowded: int = 20) -> DataFrame:
    """Keys of the documents that stay, in the order of the keys; texts of fewer words than a shingle always stay.

    Equal sets of shingles are one node, held by the smallest key: the others go with it whatever becomes of it. Only signatures
    are dealt out, a sixth of the shingles; texts are read again for those that share one. Where that would be over
    `crowded` pairs a row, these meet through their rare shingles instead.
    """
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    base = stored(_shingled(given, size).select("id", F.size("s.s").alias("n"), F.xxhash64("s.s").alias("h"), signatures(F.col("s.s"), more_than).alias("g")), at_once=SMALL)
    classes = stored(base.where("n > 0").groupBy("h", "n").agg(F.min_by("g", "id").alias("g"), F.min("id").alias("id")).select("id", "n", "g"))
    signs = classes.select("id", "n", F.explode("g").alias("e"))
    met = stored(signs.join(signs.groupBy("e").count().where("count > 1"), "e", "left_semi").select("id", "n", "e"))
    sets = stored(_shingled(given.join(met.select("id").distinct(), "id", "left_semi"), size).select("id", F.col("s.s").alias("s")))
    pairs = met.groupBy("e").count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).first()
    if pairs["rows"] and pairs["pairs"] > crowded * pairs["rows"]:
        met = stored(prefixes(sets, more_than))
    met, gone = without_led(met, sets, more_than, crowded)
    left = classes.select("id")
    for out in gone:
        left = left.join(out, "id", "left_anti")
    stay = first_independent(left, similar_pairs(met, sets, more_than))
    return base.where("n = 0").select("id").union(stay).withColumnRenamed("id", key)


def filter_and_dedup(docs: DataFrame, rules: T.FilterRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that pass the text filter and are no near-duplicates of an earlier one that passes: key, quality, language."""
    passed = stored(T.with_verdict(docs.select(key, text), rules, text).withColumnRenamed("verdict", "v").where("v.passed"), at_once=SMALL)
    return passed.join(near_duplicates(passed, key, text), key, "left_semi").select(key, F.col("v.quality").alias("quality"), F.col("v.reason").alias("language"))
