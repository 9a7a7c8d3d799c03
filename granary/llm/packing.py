"""Operator 5: best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token pieces no longer than a sequence. Pieces are dealt into shards; each shard evolves on several islands,
whose elites migrate to the next island between epochs. A crossover injects whole well-filled bins of one parent into the
other, dissolves the bins that hold the same documents again, and best-fits the documents displaced. Bins of a shard that stay
poorly filled are packed once more with those of the other shards.
"""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import common

CAPACITY = 2048
_encoders: dict[tuple[str, str], tuple[tiktoken.Encoding, Tokenizer]] = {}


def _encoder(tokenizer_path: str, ranks_path: str) -> tuple[tiktoken.Encoding, Tokenizer]:
    at = (tokenizer_path, ranks_path)
    if at not in _encoders:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[at] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(tokenizer_path)
    return _encoders[at]


def pieces(df: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids): each document's token ids and the end id, in pieces of at most `capacity`; ids are little-endian unsigned 32-bit numbers.

    The vocabulary's ranks encode; a text with one of the tokenizer's special tokens goes through the tokenizer itself. Only
    documents over the capacity are cut, so that all pieces but the first are full. Null and empty texts are the end id alone.
    """

    def work(batch: pa.RecordBatch):
        quick, whole = _encoder(tokenizer_path, ranks_path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in common.slices([len(t) for t in texts]):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, t in enumerate(texts[a:b], a):
                if any(s in t for s in special):
                    own = np.array(whole.encode(t, add_special_tokens=False).ids, "<u4")
                else:
                    own = np.array(quick.encode_ordinary(t), "<u4")
                own = np.r_[own, np.array([end], "<u4")].astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(row)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    ids.append(own[x:y].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["key", "piece", "start", "length", "ids"])

    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return common.arrow_map(plain, work, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


class Bins:
    """Bins under construction: best_fit puts an item where the least room is left."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: there are bins with room r

    def add(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        if room:
            self.by_room[room].append(len(self.bins) - 1)
            self.rooms |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        sizes, by_room, bins = self.sizes, self.by_room, self.bins
        for item in items:
            size = sizes[item]
            above = self.rooms >> size
            if not above:
                self.add([item], self.capacity - size)
                continue
            room = size + (above & -above).bit_length() - 1
            own = by_room[room]
            k = own.pop()
            if not own:
                self.rooms ^= 1 << room
            bins[k].append(item)
            if room > size:
                by_room[room - size].append(k)
                self.rooms |= 1 << (room - size)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Fewer bins first, then fuller ones: minus the number of bins, plus the mean square of how full they are."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1) - len(bins)


def crossover(giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The taker's bins with a part of the giver's well-filled bins put in whole; bins that hold one of their items are dissolved and the rest of their items best-fitted."""
    full = [b for b in giver if sum(sizes[i] for i in b) >= capacity - capacity // 500]
    injected = rng.sample(full, rng.randint(len(full) // 4, max(len(full) // 4, 3 * len(full) // 4))) if full else []
    inside = {i for b in injected for i in b}
    child = Bins(sizes, capacity)
    for b in injected:
        child.add(list(b), capacity - sum(sizes[i] for i in b))
    displaced = []
    for b in taker:
        if inside.isdisjoint(b):
            child.add(list(b), capacity - sum(sizes[i] for i in b))
        else:
            displaced += [i for i in b if i not in inside]
    poor = set(sorted(range(len(child.bins)), key=lambda k: sum(sizes[i] for i in child.bins[k]))[: 1 + len(child.bins) // 20])
    again = Bins(sizes, capacity)  # mutation: the emptiest bins are dissolved too
    for k, b in enumerate(child.bins):
        if k in poor:
            displaced += b
        else:
            again.add(b, capacity - sum(sizes[i] for i in b))
    noise = rng.choice([0, 0.02, 0.1, 0.3])
    displaced.sort(key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    again.best_fit(displaced)
    return again.bins


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int, population: int) -> tuple[float, list[list[int]]]:
    """The best packing of an island after some generations, from the elites that came and new starts; it ends early where no packing can have fewer bins."""
    rng = random.Random(seed)
    pool = list(elites)
    while len(pool) < population:  # best fit from large to small, the order more and more disturbed
        noise = 0.02 * len(pool)
        start = Bins(sizes, capacity)
        start.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())))
        pool.append(start.bins)
    ranked = sorted(((fitness(b, sizes, capacity), k, b) for k, b in enumerate(pool)), reverse=True)
    least = -(-sum(sizes) // capacity)
    for g in range(generations):
        if len(ranked[0][2]) <= least:
            break
        a, b = rng.sample(ranked[: max(2, population)], 2)
        child = crossover(a[2], b[2], sizes, capacity, rng)
        ranked.append((fitness(child, sizes, capacity), population + g, child))
        ranked = sorted(ranked, reverse=True)[:population]
    return ranked[0][0], ranked[0][2]


_STATE = "shard long, island int, fitness double, bin array<int>"


def _epoch(capacity: int, generations: int, population: int, epoch: int):
    def work(items: pa.Table, came: pa.Table) -> pa.Table:
        if not items.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "island": pa.array([], pa.int32()), "fitness": pa.array([], pa.float64()), "bin": pa.array([], pa.list_(pa.int32()))})
        items = items.sort_by([("item", "ascending")])
        sizes = items.column("length").to_pylist()
        shard, island = items.column("shard")[0].as_py(), items.column("island")[0].as_py()
        elites = []
        for bin_of in came.column("bin").to_pylist():
            bins: list[list[int]] = [[] for _ in range(max(bin_of) + 1)]
            for item, b in enumerate(bin_of):
                bins[b].append(item)
            elites.append(bins)
        best, bins = evolve(sizes, capacity, hash((shard, island, epoch)), elites, generations, population)
        bin_of = np.zeros(len(sizes), np.int32)
        for k, own in enumerate(bins):
            bin_of[own] = k
        return pa.table({"shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "fitness": [best], "bin": pa.array([bin_of.tolist()], pa.list_(pa.int32()))})

    return work


def _place(items: pa.Table, best: pa.Table) -> pa.Table:
    items = items.sort_by([("item", "ascending")])
    length = items.column("length").to_numpy()
    bin_of = np.array(best.column("bin")[0].as_py())
    order = np.argsort(bin_of, kind="stable")
    ends = np.cumsum(length[order])
    new = np.r_[True, np.diff(bin_of[order]) > 0]
    base = (ends - length[order])[new][np.cumsum(new) - 1]
    offset, filled = np.zeros(len(order), np.int64), np.bincount(bin_of, length).astype(np.int64)
    offset[order] = ends - length[order] - base
    return pa.table({"item": items.column("item"), "length": items.column("length"), "shard": items.column("shard"), "bin": pa.array(bin_of.astype(np.int64)), "offset": pa.array(offset), "filled": pa.array(filled[bin_of])})


def _round(items: DataFrame, capacity: int, shard_size: int, islands: int, epochs: int, generations: int, population: int, salt: int) -> DataFrame:
    """Rows (item, length, shard, bin, offset, filled) of a packing of items (item, length)."""
    shards = max(1, -(-items.count() // shard_size))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "item"), F.lit(shards)))
    apart = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = items.sparkSession.createDataFrame([], _STATE)
    for epoch in range(epochs):
        came = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).union(state) if epoch else state
        state = common.stored(apart.groupBy("shard", "island").cogroup(came.groupBy("shard", "island")).applyInArrow(_epoch(capacity, generations, population, epoch), _STATE))
    best = state.groupBy("shard").agg(F.max_by("bin", F.struct("fitness", "island")).alias("bin"))
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(_place, "item long, length long, shard long, bin long, offset long, filled long")


def place(lengths: DataFrame, capacity: int = CAPACITY, shard_size: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 40, population: int = 6) -> DataFrame:
    """Rows (item, sequence_id, offset) for items (item long, length long from 1 to capacity): no sequence over capacity, offsets gapless from 0.

    Items of full length are sequences of their own. Item numbers must be distinct. An empty table gives no rows.
    """
    how = (capacity, shard_size, islands, epochs, generations, population)
    full = lengths.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = common.stored(_round(lengths.where(F.col("length") < capacity), *how, 1))
    good = F.col("filled") >= capacity - capacity // 100
    rest = first.where(~good).select("item", "length")
    second = _round(rest, *how, 2)
    number = lambda k: (F.lit(k << 60).cast("long") + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id")
    return full.union(first.where(good).select("item", number(1), "offset")).union(second.select("item", number(2), "offset"))


def pack(df: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """pieces(df) placed in sequences: rows (key, piece, start, length, ids_crc32, sequence_id, offset), and ids if they are to be kept.

    Every row of df is packed, repeated rows and null keys too.
    """
    cut = pieces(df, tokenizer_path, ranks_path, capacity, end, key, text).withColumn("ids_crc32", F.crc32("ids"))
    cut = common.stored((cut if keep_ids else cut.drop("ids")).withColumn("_item", F.monotonically_increasing_id()))
    placed = place(cut.select(F.col("_item").alias("item"), "length"), capacity)
    return cut.join(placed, F.col("_item") == F.col("item")).drop("_item", "item")
