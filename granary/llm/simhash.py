"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints over word shingles. Bits that go together are grouped into the same partition; a dynamic programme gives
each partition its own threshold (-1 leaves it out) such that the thresholds add up to distance - partitions + 1, so any two
fingerprints within the distance agree up to the threshold in one partition at least. Fingerprints are probed there with
all variants within the threshold, and the whole fingerprints verified.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

BITS = 64
#: What shuffling a row costs, in verified pairs; what the dynamic programme weighs probes by.
ROW_COST = 1000


def shingle_hashes(texts: list[bytes], shingle: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in a row, and each text's number of them."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= shingle:
            own = [b" ".join(words)] if words else []
        else:
            own = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        before = len(hashes)
        hashes += [digest(x, 42) for x in own]
        counts.append(len(hashes) - before)
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def fingerprint_batch(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts as unsigned 64-bit numbers; zero for a text without words."""
    return fingerprints_of(*shingle_hashes(texts, shingle))


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(counts), np.uint64), 0
    some = np.flatnonzero(counts)
    if len(some):
        ones = np.zeros((len(some), BITS), np.int64)
        ends = np.cumsum(counts[some])
        raw, step = hashes.astype(">u8"), 1 << 16
        for at in range(0, len(raw), step):  # bits of so many shingles at a time
            bits = np.unpackbits(raw[at : at + step].view(np.uint8)).reshape(-1, BITS)
            first = np.searchsorted(ends, at, "right")
            last = np.searchsorted(ends, at + len(bits) - 1, "right")
            starts = np.maximum(np.r_[0, ends][first : last + 1] - at, 0)
            ones[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (key, fp long), one for each row of df. A text of fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint zero."""

    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            fp = fingerprint_batch(texts[a:b], shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fp)], [key, "fp"])

    return common.arrow_map(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


#: Two texts whose shingles are alike by 0.8 differ in all bands in 7 of a million cases, by 0.5 they share one in 61 of 100.
BANDS, BAND_ROWS = 30, 5


def bands_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS numbers for each text, each a hash of BAND_ROWS minima of its shingles under different orders; zeros for a text without words."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.cumsum(counts[some]) - counts[some]
        short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        orders = np.random.default_rng(11).integers(0, 1 << 32, (BANDS, BAND_ROWS, 2), np.uint32)
        for k in range(BANDS):
            got = np.zeros(len(some), np.uint64)
            for turn, mask in orders[k]:
                got = (got ^ np.minimum.reduceat((short ^ mask) * (turn | np.uint32(1)), starts)) * np.uint64(0x9E3779B97F4A7C15)
                got ^= got >> np.uint64(29)
            out[some, k] = got
    return out.view(np.int64)


def signatures(df: DataFrame, key: str, text: str = "text", shingle: int = 5) -> DataFrame:
    """Rows (key, fp long, bands array<long>), one for each row of df; bands is null for a text without words."""

    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            hashes, counts = shingle_hashes(texts[a:b], shingle)
            bands = [x if n else None for x, n in zip(bands_of(hashes, counts), counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fingerprints_of(hashes, counts).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], [key, "fp", "bands"])

    return common.arrow_map(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long, bands array<long>")


def shingle_sets(df: DataFrame, key: str, text: str = "text", shingle: int = 5) -> DataFrame:
    """Rows (key, s array<long>): the distinct shingles' hashes of each row of df."""

    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            hashes, counts = shingle_hashes(texts[a:b], shingle)
            sets = [np.unique(x) for x in np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.list_(pa.int64()))], [key, "s"])

    return common.arrow_map(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, s array<long>")


def bit_counts(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set: 4,096 sums, whatever the number of rows."""

    def work(batch: pa.RecordBatch):
        total = np.zeros((BITS, BITS))
        x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(">i8")
        for at in range(0, len(x), 1 << 15):
            bits = np.unpackbits(x[at : at + (1 << 15)].view(np.uint8)).reshape(-1, BITS).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "both": [total.astype(np.int64).ravel()]}, schema=pa.schema({"n": pa.int64(), "both": pa.list_(pa.int64())}))

    parts = common.arrow_map(fps.select(column), work, "n long, both array<long>")
    sums = parts.select("n", F.posexplode("both").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r["at"]] = r["c"]
    return (sums[0]["n"] if sums else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the 64 bits (0: the highest) of about equal width: each grows from the two most correlated bits left by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        if k == parts - 1:
            out.append(sorted(left))
            break
        sub = corr[np.ix_(left, left)]
        a, b = divmod(int(sub.argmax()), len(left))
        own = [left[a], left[b]] if a != b else left[:2]
        rest = [x for x in left if x not in own]
        while len(own) < width:
            best = max(rest, key=lambda x: corr[x, own].sum())
            own.append(best)
            rest.remove(best)
        out.append(sorted(own))
        left = rest
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (from -1 up) of the partitions that add up to total at the least summed cost; costs[i][t + 1] is what threshold t costs in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(own, -1):
                if spent + t not in after or cost + c < after[spent + t][0]:
                    after[spent + t] = (cost + c, [*chosen, t])
        best = after
    return best[total][1]


def _values(fp, bits: list[int]):
    """Column: the bits of a fingerprint's partition, kept in place."""
    mask = sum(1 << (BITS - 1 - b) for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask).cast("long"))


def plan(reps: DataFrame, distance: int, most_parts: int | None = None) -> tuple[int, list[tuple[list[int], int]]]:
    """Number of fingerprints, and the partitions with their thresholds that cost least, over all splits into 1 to distance + 1 partitions.

    The cost of threshold t in a partition: a shuffled row for each fingerprint and probe, and the pairs that would be verified.
    Those are counted exactly for t = 0 over all fingerprints, and scaled by what independent bits would give beyond.
    """
    n, both = bit_counts(reps)
    if n < 2:
        return n, [(bits, 0) for bits in group_bits(n, both, distance + 1)]
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    chosen: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, (most_parts or distance + 1) + 1):
        split = group_bits(n, both, parts)
        kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _values(F.col("fp"), b).alias("value")) for i, b in enumerate(split)])).alias("x")
        equal = {r["part"]: r["pairs"] for r in reps.select(kinds).groupBy("x.part", "x.value").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
        costs = []
        for i, bits in enumerate(split):
            within = np.zeros(distance + 2)
            within[0] = 1  # chances of 0, 1, ... differing bits if bits were independent
            for b in bits:
                within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
                within[0] *= 1 - differ[b]
            ratio = np.cumsum(within) / max(within[0], 1e-300)
            own = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                own.append(ROW_COST * n * float(probes) + min(n * n / 2, max(equal.get(i, 0.0), n * n / 2 * within[0]) * ratio[t]))
            costs.append(own)
        thresholds = allocate(costs, distance - parts + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True))
        if chosen is None or cost < chosen[0]:
            chosen = (cost, list(zip(split, thresholds, strict=True)))
    return n, chosen[1]


def _links(distance: int):
    def work(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        rep = table.column("rep").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        blk, lo, hi = (table.column(c).to_numpy() for c in ("blk", "lo", "hi"))
        bucket = table.column("bucket").to_numpy()
        n = len(fp)
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        ends = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
        nodes, node = np.unique(rep, return_inverse=True)
        forest = common.Forest(len(nodes))
        rows, lag = np.arange(n), 1
        while True:
            rows = rows[rows + lag < ends[rows]]
            if not len(rows):
                break
            other = rows + lag
            near = np.bitwise_count(fp[rows] ^ fp[other]) <= distance
            near &= (own[rows] | own[other]) & ((lo[rows] == hi[rows]) | (blk[rows] != blk[other]))
            forest.join(node[rows[near]], node[other[near]])
            lag += 1
        tied = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return pa.table({"a": nodes[tied], "b": nodes[forest.root[tied]]})

    return work


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Rows (key, fp, component): all documents whose fingerprints are reachable by steps of at most `distance` bits share the smallest key among them.

    Every row of df gives a row, repeated ones too. Texts with equal fingerprints are one node however many they are, and
    the links within a bucket leave as a spanning forest, so copies never become pairs. A null key is no name for a component:
    a row with one gets its component from the others, null if there are none.
    """
    return linked(common.stored(fingerprints(df, key, text, shingle)), key, distance)


#: A bucket of over so many fingerprints is split by their other bits before pairs are compared.
LARGE = 2048


def linked(prints: DataFrame, key: str, distance: int = 3, large: int = LARGE) -> DataFrame:
    """The same of rows (key, fp) of a stored table.

    Fingerprints of a bucket agree in its bits, so two of them within the distance agree in one of distance + 1 parts of the
    others: a bucket of over `large` rows is dealt into the buckets of those parts, and no link is lost.
    """
    reps = common.stored(prints.groupBy("fp").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies")))
    named = reps.where("rep is not null").select("fp", "rep")
    n, parts = plan(named, distance)
    buckets = []
    for i, (bits, threshold) in enumerate(parts):
        for r in range(threshold + 1):
            for flips in combinations(bits, r):
                flip = sum(1 << (BITS - 1 - b) for b in flips)
                buckets.append((i, bits, flip - (1 << BITS) if flip >= 1 << (BITS - 1) else flip, r == 0))
    kinds = F.array(*[F.struct(F.xxhash64(F.lit(i), _values(F.col("fp"), bits).bitwiseXOR(F.lit(flip).cast("long"))).alias("bucket"), F.lit(own).alias("own"), F.lit(i).alias("part")) for i, bits, flip, own in buckets])
    rows = common.stored(named.select("fp", "rep", F.explode(kinds).alias("_x")).select("fp", "rep", "_x.*"))
    crowded = common.large_buckets(rows, "bucket", large)
    more = crowded.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    if more:
        finer = F.array(F.col("bucket"))
        for i, (bits, _) in enumerate(parts):
            rest = [b for b in range(BITS) if b not in bits]
            split = F.array(*[F.xxhash64(F.col("bucket"), F.lit(j), _values(F.col("fp"), rest[j :: distance + 1])) for j in range(distance + 1)])
            finer = F.when(F.col("_n").isNotNull() & (F.col("part") == i), split).otherwise(finer)
        rows = rows.join(crowded, F.col("bucket") == F.col("_bucket"), "left").select("fp", "rep", "own", F.explode(finer).alias("bucket"))
    edges = common.stored(common.in_buckets(rows.select("fp", "rep", "bucket", "own"), "bucket", "rep", _links(distance), "a long, b long", n * len(buckets) + more * distance))
    tied = common.components(edges)
    found = reps.join(tied, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component"))
    return prints.join(found, F.col("fp") == F.col("_fp")).select(key, "fp", "component")


def _jaccard(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike by `least` or more."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= (least - 1e-9) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _forest(least: float):
    """Links within a bucket as a spanning forest, by exact Jaccard similarity of sets; rows of one group count as linked already."""

    def work(table: pa.Table) -> pa.Table:
        ids, group = table.column("id").to_numpy(), table.column("group").to_numpy()
        blk, lo, hi, bucket = (table.column(c).to_numpy() for c in ("blk", "lo", "hi", "bucket"))
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        starts = np.r_[np.flatnonzero(new), len(ids)]
        out_a, out_b = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = table.slice(a, b - a).column("s").combine_chunks()
            sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            item = np.unique(own.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
            member = np.repeat(np.arange(b - a), sizes)
            order = np.argsort(item, kind="stable")
            owners, ends = member[order], np.cumsum(np.bincount(item))
            begins, bounds = np.r_[0, ends[:-1]], np.r_[0, np.cumsum(sizes)]
            kinds, node = np.unique(group[a:b], return_inverse=True)
            forest = common.Forest(len(kinds))
            apart = blk[a:b, None] != blk[None, a:b] if lo[a] != hi[a] else None
            for i in range(b - a):
                there = item[bounds[i] : bounds[i + 1]]
                n = ends[there] - begins[there]
                at = np.repeat(begins[there] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owners[at], minlength=b - a)
                near = shared >= (least - 1e-9) * (sizes[i] + sizes - shared)
                near[: i + 1] = False
                if apart is not None:
                    near &= apart[i]
                for j in np.flatnonzero(near).tolist():
                    x, y = forest._find(int(node[i])), forest._find(int(node[j]))
                    if x != y:
                        forest.root[max(x, y)] = min(x, y)
                        out_a.append(int(ids[a + i]))
                        out_b.append(int(ids[a + j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return work


def alike(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float, most: int = 256) -> DataFrame:
    """Links (a, b) that connect all rows (id long, bands array<long>) that share a band and whose sets are alike by `least` or more; stored.

    sets_of gives rows (id, s) for a table of ids. Pairs are compared exactly, but never all made: in each band's bucket
    the members are first compared with the smallest id, and with the one whose hash is least. Buckets that this leaves in
    several groups are worked through whole, as blocks of sets in a task, and only a spanning forest comes out.
    """
    met = common.stored(bands.select("id", F.posexplode("bands").alias("b", "v")).select("id", F.xxhash64("b", "v").alias("e")))
    twice = common.stored(met.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min_by("id", F.xxhash64("id")).alias("other")).where("n > 1").drop("n"))
    seen = common.stored(met.join(twice, "e"))
    pairs = seen.select(F.explode(F.array("first", "other")).alias("a"), F.col("id").alias("b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = common.stored(sets_of(seen.select("id").distinct()))
    links = common.stored(_jaccard(sets, pairs, least))
    groups = common.stored(common.components(links))
    rows = seen.select("id", F.col("e").alias("bucket")).join(groups, F.col("id") == F.col("node"), "left").select("id", "bucket", F.coalesce("component", "id").alias("group"))
    rows = common.stored(rows)
    open_ = common.stored(rows.groupBy(F.col("bucket").alias("_b")).agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y"))
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if total:
        whole = rows.join(open_.select("_b"), F.col("bucket") == F.col("_b"), "left_semi").join(sets, "id")
        more = common.in_buckets(whole.select("id", "bucket", "group", "s"), "bucket", "id", _forest(least), "a long, b long", total, most)
        links = common.stored(links.union(more))
    common.discard(met, twice, seen, sets, groups, rows, open_)
    return links


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 3, least: float = 0.8) -> DataFrame:
    """df less all but one row of each group of near copies: the one with the smallest key, of equal ones that with the least hash; its columns stay.

    Linked are texts whose fingerprints differ by at most `distance` bits, and those whose shingles are alike by `least` or
    more, found by bands of minima (a pair at 0.8 is missed in 7 of a million cases) and counted on the shingles. Rows are told
    apart by key and text: texts under one key, or under none, are judged each for itself, null keys come last, and of equal
    rows one stays. Null and empty texts, and all without words, are alike. An empty table stays one.
    """
    marked = df.withColumn("_h", F.xxhash64(F.col(text))).withColumn("_k", F.xxhash64(F.col(key), F.col(text), F.lit(1)))
    name = F.struct("_h", "_k", F.col(key).alias("_key"))
    signed = common.stored(signatures(marked.select(name.alias("n"), F.col(text).alias("t")), "n", "t", shingle).select("n.*", "fp", "bands"))
    low = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_k").alias("k"))).alias("low")
    nodes = common.stored(signed.groupBy(F.col("_h").alias("id")).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), low))
    common.discard(signed)

    def sets_of(ids: DataFrame) -> DataFrame:
        few = ids.join(nodes.select(F.col("id").alias("_i"), "low.k"), F.col("id") == F.col("_i")).select("id", "k")
        texts = marked.join(few, (F.col("_h") == F.col("id")) & (F.col("_k") == F.col("k"))).select("id", F.col(text).alias("t"))
        return shingle_sets(texts.dropDuplicates(["id"]), "id", "t", shingle)

    bits = linked(nodes.select("id", "fp"), "id", distance).where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    tied = common.components(bits.union(alike(nodes.where("bands is not null").select("id", "bands"), sets_of, least)))
    grouped = nodes.join(tied, F.col("id") == F.col("node"), "left").select("id", "low", F.coalesce("component", "id").alias("group"))
    stay = common.stored(grouped.groupBy("group").agg(F.min(F.struct("low", "id")).alias("m")).select(F.col("m.id").alias("_h"), F.col("m.low.k").alias("_k")))
    return marked.join(stay, ["_h", "_k"], "left_semi").dropDuplicates(["_h", "_k"]).select(*df.columns)
