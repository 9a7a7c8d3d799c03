"""Deterministic weighted mixes of conversations: leakage, duplicates, owners, quotas and first-fit selection."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import chat
from granary.plans.durable import SMALL, stored


@dataclass(frozen=True)
class Source:
    name: str
    weight: float


def check_config(sources: list[Source], target: int) -> None:
    """Raises ValueError for a mix that makes no sense, before anything is read."""
    if not sources:
        raise ValueError("a mix needs sources")
    names = [s.name for s in sources]
    if len(set(names)) < len(names) or not all(names):
        raise ValueError("source names must be distinct and not empty")
    if isinstance(target, bool) or not isinstance(target, int) or target <= 0:
        raise ValueError("target_examples must be a positive integer")
    for s in sources:
        if isinstance(s.weight, bool) or not isinstance(s.weight, int | float) or not math.isfinite(s.weight) or s.weight <= 0:
            raise ValueError(f"source {s.name!r}: the weight must be a positive finite number")


def allocate(total: int, sources: list[Source]) -> dict[str, int]:
    """Largest remainders: whole shares first, what is left to the largest fractions, ties by name."""
    weights = sum(s.weight for s in sources)
    shares = {s.name: total * s.weight / weights for s in sources}
    given = {name: int(x) for name, x in shares.items()}
    for name in sorted(shares, key=lambda n: (given[n] - shares[n], n))[: total - sum(given.values())]:
        given[name] += 1
    return given


def allocate_rows(sizes: DataFrame, total: int) -> DataFrame:
    """The same over rows (source, weight) of a stored table, however many sources there are: rows (source, quota)."""
    weights = sizes.agg(F.sum(F.col("weight").cast("double")).alias("w"))
    shares = sizes.join(F.broadcast(weights)).select("source", (F.lit(total) * F.col("weight") / F.col("w")).alias("x"))  # one row
    whole = shares.withColumn("given", F.floor("x").cast("long"))
    left = total - (whole.agg(F.coalesce(F.sum("given"), F.lit(total))).first()[0])
    more = stored(whole.orderBy(F.col("given") - F.col("x"), "source").limit(left).select("source", F.lit(1).alias("more")))
    return whole.join(more, "source", "left").select("source", (F.col("given") + F.coalesce("more", F.lit(0))).alias("quota"))


def blocked_hashes(held_out: DataFrame) -> DataFrame:
    """All leakage keys (h) of held-out conversations; a malformed one raises when the plan runs."""
    ok = F.coalesce(F.raise_error(F.concat(F.lit("held-out conversation: "), chat.mixable(F.col("messages")))).cast("boolean"), F.lit(True))
    sound = held_out.where(F.when(chat.mixable(F.col("messages")).isNull(), True).otherwise(ok))
    parts = sound.select("messages", chat.normal_parts("messages").alias("parts"))
    return parts.select(F.explode(leakage_keys()).alias("h")).distinct()


def leakage_keys() -> Column:
    """Full, prompt and request hashes of the columns messages and parts."""
    m, p = F.col("messages"), F.col("parts")
    return F.array_distinct(F.concat(F.array(chat.full_hash(p)), chat.prompt_hashes(m, p), chat.request_hashes(m, p)))


def judged(rows: DataFrame, blocked: DataFrame, seed: int) -> DataFrame:
    """rows (source, file, line, messages) with digest, targets and status: a reason, validation_leakage, duplicate, cross_source_duplicate or eligible.

    Leakage comes before duplicates. Of equal conversations in a source the first by (file, line) stays; of sources that share one
    the owner is drawn by a hash. Both are minima over aggregated keys, so copies never meet in one task as rows.
    """
    parts = rows.withColumn("reason", chat.mixable(F.col("messages"))).withColumn("parts", chat.normal_parts("messages"))
    keyed = stored(parts.withColumn("digest", chat.full_hash(F.col("parts"))).withColumn("keys", leakage_keys()).withColumn("targets", chat.targets(F.col("messages"))).drop("parts"), at_once=SMALL)
    sound = keyed.where("reason is null")
    leaked = sound.select("source", "file", "line", F.explode("keys").alias("h")).join(blocked, "h", "left_semi").select("source", "file", "line").distinct().withColumn("leaked", F.lit(True))
    flagged = stored(keyed.drop("keys").join(leaked, ["source", "file", "line"], "left"), at_once=SMALL)
    clean = flagged.where("reason is null and leaked is null")
    first = clean.groupBy("source", "digest").agg(F.min(F.struct("file", "line")).alias("first"))
    owner_key = chat.stable_key(seed, F.concat(F.lit("owner:"), F.col("digest")), F.col("source"))
    owners = first.groupBy("digest").agg(F.min_by("source", owner_key).alias("owner"))
    marked = flagged.join(first.join(owners, "digest"), ["source", "digest"], "left")
    status = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("leaked"), "validation_leakage")
        .when(F.struct("file", "line") != F.col("first"), "duplicate")
        .when(F.col("source") != F.col("owner"), "cross_source_duplicate")
        .otherwise("eligible")
    )
    return marked.withColumn("status", status).drop("reason", "leaked", "first", "owner")


def _running(pool: DataFrame) -> DataFrame:
    """pool (source, key, targets) with the running sum of targets by key in each source: within buckets of the key's first digits, plus what the buckets before have."""
    bucketed = pool.withColumn("bucket", F.substring("key", 1, 3))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("targets").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return bucketed.withColumn("inner", F.sum("targets").over(within)).join(sums, ["source", "bucket"]).withColumn("running", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def first_fit(pool: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Rows (source, key) taken when each source's pool (source, key, targets) is walked by key and whatever still fits its quota is taken.

    All up to the first that does not fit is a prefix of the running sum. Then less than one conversation's targets is left,
    and as every further one takes at least one target, the rest is a few smallest keys for each source.
    """
    spark = pool.sparkSession
    rows = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    summed = stored(_running(pool).join(F.broadcast(rows), "source"))
    prefix = summed.where("running <= quota")
    used = {r["source"]: r["u"] for r in prefix.groupBy("source").agg(F.max("running").alias("u")).collect()}
    extra: list[tuple[str, str]] = []
    for name, quota in quotas.items():
        left, after = quota - used.get(name, 0), ""
        while left > 0:
            more = summed.where((F.col("source") == name) & (F.col("running") > quota) & (F.col("targets") <= left) & (F.col("key") > after)).orderBy("key").limit(left).select("key", "targets").collect()
            if not more:
                break
            for r in more:
                after = r["key"]
                if r["targets"] <= left:
                    extra.append((name, r["key"]))
                    left -= r["targets"]
    return prefix.select("source", "key").union(spark.createDataFrame(extra, "source string, key string"))


def select(eligible: DataFrame, sources: list[Source], target: int, seed: int) -> DataFrame:
    """eligible (source, digest, targets, ...) with selected, after quotas, first fit and as many redistributions of the deficit as make progress."""
    check_config(sources, target)
    keyed = stored(eligible.withColumn("key", chat.stable_key(seed, F.col("source"), F.col("digest"))))
    pool, taken, quotas = keyed.select("source", "key", "targets"), None, allocate(target, sources)
    while True:
        got = stored(first_fit(pool, quotas))
        taken = got if taken is None else stored(taken.union(got))
        used = keyed.join(taken, ["source", "key"], "left_semi").agg(F.coalesce(F.sum("targets"), F.lit(0)).alias("t")).first()["t"]
        if used >= target or not got.limit(1).count():
            break
        pool = stored(keyed.select("source", "key", "targets").join(taken, ["source", "key"], "left_anti"))
        left = {r["source"] for r in pool.select("source").distinct().collect()}
        available = [s for s in sources if s.name in left]
        if not available:
            break
        quotas = allocate(target - used, available)
    return keyed.join(taken.withColumn("_t", F.lit(True)), ["source", "key"], "left").withColumn("selected", F.coalesce("_t", F.lit(False))).drop("_t", "key")


def mixed_order(selected: DataFrame, seed: int) -> DataFrame:
    """The mix in its pseudo-random order, as the column mix_key to sort by."""
    return selected.where("selected").withColumn("mix_key", chat.stable_key(seed, "mixed", F.col("digest")))


def report(selected: DataFrame, sources: list[Source]) -> DataFrame:
    """By source: eligible and selected records and targets, and the share of all selected targets (0 without any)."""
    spark = selected.sparkSession
    every = spark.createDataFrame([(s.name, float(s.weight)) for s in sources], "source string, weight double")
    sums = selected.groupBy("source").agg(
        F.count(F.lit(1)).alias("eligible_records"), F.sum("targets").alias("eligible_targets"),
        F.count_if("selected").alias("selected_records"), F.sum(F.when(F.col("selected"), F.col("targets")).otherwise(0)).alias("selected_targets"),
    )
    total = sums.agg(F.sum("selected_targets").alias("_total"))
    share = F.when(F.coalesce("_total", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("selected_targets", F.lit(0)) / F.col("_total"))
    return every.join(sums, "source", "left").join(F.broadcast(total)).withColumn("share", share).drop("_total").na.fill(0)
