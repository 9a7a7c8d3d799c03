"""What the operators of this folder share: Arrow maps, durable tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.durable import discard, shared_dir, stored

__all__ = ["discard", "shared_dir", "stored"]

#: Characters of text that one step of a Python operator holds as Python objects.
SLICE_CHARS = 1_500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(key: str, folds: int) -> Column:
    """True for the rows that no model may learn from: crc32 of the id's text modulo folds is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == 2, F.lit(False))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn applied to each Arrow batch of df."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(over, schema)


def beside(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch without its text but with more columns."""
    names = [n for n in batch.schema.names if n != "_text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], [*names, *columns])


def carried(df: DataFrame, key: str, text: str, carry: tuple[str, ...], fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], made: dict[str, tuple[str, str]]) -> DataFrame:
    """fn over batches of df's key, the columns to carry and _text; made: of each column that fn adds, its name in the result and its type. A text that is carried is sent once."""
    names = list(dict.fromkeys((key, *carry)))
    sent = [F.col(n).alias(f"_c{i}") for i, n in enumerate(names)]
    plain = df.select(*sent) if text in names else df.select(*sent, F.col(text).alias("_text"))
    place = names.index(text) if text in names else -1

    def with_text(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        if place < 0:
            return fn(batch)
        return fn(pa.RecordBatch.from_arrays([*batch.columns, batch.column(place)], [*batch.schema.names, "_text"]))

    schema = ", ".join([f"_c{i} {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names)] + [f"{m} {kind}" for m, (_, kind) in made.items()])
    out = arrow_map(plain, with_text, schema)
    return out.toDF(*names, *(name for name, _ in made.values()))


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        return [x for chunk in column.chunks for x in binary(chunk)]
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def text_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text, 0 for null."""
    return pc.binary_length(column).fill_null(0).to_pylist()


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to most at least, the last one excepted."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def large_buckets(rows: DataFrame, bucket: str, most: int) -> DataFrame:
    """Rows (_bucket, _n) of the buckets of over `most` rows, stored: at most a row for each `most` rows."""
    sizes = rows.groupBy(F.col(bucket).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    return stored(sizes.where(F.col("_n") > most))


def in_buckets(rows: DataFrame, bucket: str, spread: str, work: Callable[[pa.Table], pa.Table], schema: str, total: int, most: int = 2048) -> DataFrame:
    """work applied to groups of whole buckets of rows, sorted by (bucket, lo, hi); every two rows of a bucket meet in one group at least.

    A bucket of over `most` rows is dealt by `spread` into blocks of about that many, and each pair of blocks (lo, hi) becomes a
    bucket of its own: a row goes to as many of them as there are blocks, so no task holds more than two blocks of a bucket. work
    gets the added columns blk, lo and hi and pairs rows of equal (bucket, lo, hi) where lo = hi or their blk differ. total:
    the number of rows. The number of groups follows from the rows once they are dealt, so a group holds about 8 * most.
    """
    large = large_buckets(rows, bucket, most)
    blocks = F.coalesce(F.ceil(F.col("_n") / most), F.lit(1))
    more = large.agg(F.coalesce(F.sum(F.col("_n") * (blocks - 1)), F.lit(0)).alias("more")).first()["more"]
    dealt = (
        rows.join(large, F.col(bucket) == F.col("_bucket"), "left")
        .withColumn("_blocks", blocks)
        .withColumn("blk", F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
        .withColumn("lo", F.least("blk", "_other"))
        .withColumn("hi", F.greatest("blk", "_other"))
        .drop("_n", "_bucket", "_blocks", "_other")
    )
    groups = max(1, -(-(total + more) // (8 * most)))

    def sorted_work(table: pa.Table) -> pa.Table:
        return work(table.sort_by([(bucket, "ascending"), ("lo", "ascending"), ("hi", "ascending")]))

    return dealt.groupBy(F.pmod(F.xxhash64(bucket, "lo", "hi"), F.lit(groups)).alias("_group")).applyInArrow(sorted_work, schema)


class Forest:
    """Union of row numbers, for pairs that come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self._find(x), self._find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
        while True:
            above = self.root[self.root]
            if (above == self.root).all():
                break
            self.root = above


class Numbering(dict):
    """Numbers its keys from 0 in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def number_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of all texts' words in a row their numbers, the distinct words by number, and each text's number of words."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number = Numbering()
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    return ids, list(number), counts


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component) with the smallest reachable node, for every node of an edge.

    Alternating large-star and small-star steps; each aggregates minima before a shuffle, so that a node with very many
    neighbours is one row for each task, and joins that Spark may split on skew. Each round is a written table.
    Null ends and loops are left out.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    pairs = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # stored, so that Spark may split a node of many edges in the join
        # large-star: the neighbours above u, and u's own lower neighbours by their own turn, hang on the lowest
        large = stored(both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select("u", "m").union(joined.where("v <> m").select("v", "m")).toDF("u", "v").distinct()
        after = stored(small)
        discard(pairs, lowest, large, least)
        # done when every node hangs on one node that hangs on none
        roots = after.select(F.col("v").alias("u")).distinct()
        open_ = after.join(roots, "u", "left_semi").limit(1).count() or after.groupBy("u").count().where("count > 1").limit(1).count()
        pairs = after
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())
