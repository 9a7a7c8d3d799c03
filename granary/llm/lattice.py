"""Operator 2: near-duplicate embeddings by lattice hashing.

In each of several tables a random projection takes a unit vector to eight dimensions, where the nearest point of the E8
lattice is its cell. Vectors lie in their own cell; each also probes the neighbouring cells that its own residual leans to.
Pairs that meet are verified by their cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of the lattice of integer vectors with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    row = np.arange(len(x))
    near[row, worst] += np.where(near.sum(1) % 2 != 0, np.where(off[row, worst] >= 0, 1, -1), 0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of its two halves, integer and half-integer, the nearer point."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a cell to its neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    return np.array(out + [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


class Tables:
    """The cells of unit vectors of one dimension in every table: own (n, tables), probed (n, tables, probes), as 64-bit numbers."""

    def __init__(self, dimension: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dimension])
        self.projections = rng.normal(0, scale, (tables, dimension, 8))
        self.mix = rng.integers(1, 1 << 62, 8) | 1
        self.steps, self.probes = shortest(), probes
        self.moves = (2 * self.steps).astype(np.int64) @ self.mix

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, probed = [], []
        for projection in self.projections:
            x = unit @ projection
            point = decode(x)
            code = np.rint(2 * point).astype(np.int64) @ self.mix
            lean = (x - point) @ self.steps.T
            best = np.argsort(-lean, axis=1, kind="stable")[:, : self.probes]
            own.append(code)
            probed.append(code[:, None] + self.moves[best])
        return np.stack(own, 1), np.stack(probed, 1)


#: Of unit vectors at random, the share of pairs that are in one cell at scale 1; it falls with the eighth power of the scale.
STRANGERS = 3.5e-5
#: So many strangers may be in a cell on average before cells are made finer.
CROWD = 64


def tuned(n: int, least: float, probes: int = 3, recall: float = 0.98, pairs: int = 4000) -> tuple[int, float]:
    """Tables and scale for n vectors: cells so fine that the strangers in one do not grow with n, and as many tables as find `recall` of simulated pairs right at the cosine `least`.

    A projection of a unit vector has the same law whatever its dimension, so one simulation holds for all.
    """
    scale = max(1.0, (n * STRANGERS / CROWD) ** (1 / 8))
    rng = np.random.default_rng(5)
    a, b = (_unit(rng.normal(size=(pairs, 64))) for _ in range(2))
    b = _unit(b - (a * b).sum(1, keepdims=True) * a)
    b = least * a + np.sqrt(max(0.0, 1 - least * least)) * b
    met, tables = np.zeros(pairs, bool), 0
    while met.mean() < recall and tables < 200:
        own, probed = Tables(64, 1, probes, scale, tables).cells(a)
        other, asked = Tables(64, 1, probes, scale, tables).cells(b)
        met |= ((own == other) | (probed == other[:, :, None]).any(2) | (asked == own[:, :, None]).any(2)).any(1)
        tables += 1
    return max(4, tables), scale


def _unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)  # first by the largest component, as squares of extreme ones overflow
    vectors = vectors / top
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _rows(tables: int, probes: int, scale: float, seed: int):
    def work(batch: pa.RecordBatch):
        sizes = np.array(batch.column(1).value_lengths().to_pylist())
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            own, probed = Tables(size, tables, probes, scale, seed).cells(_unit(_matrix(part.column(1))))
            for t in range(tables):
                for p in range(-1, probes):
                    code = own[:, t] if p < 0 else probed[:, t, p]
                    n = len(code)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, t, np.int32)), pa.array(code), pa.array(np.full(n, p < 0))], ["class", "t", "code", "own"])

    return work


def _compare(tables: int, probes: int, scale: float, seed: int, least: float):
    def work(table: pa.Table) -> pa.Table:
        spans: dict[int, list[int]] = {}
        sizes = np.array(table.column("embedding").combine_chunks().value_lengths().to_pylist())
        out_class, out_links, out_root = [], [], []
        for size in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == size))
            kind, copies = part.column("class").to_numpy(), part.column("copies").to_numpy()
            own, t = part.column("own").to_numpy(zero_copy_only=False), part.column("t").to_numpy()
            bucket, blk, lo, hi = (part.column(c).to_numpy() for c in ("bucket", "blk", "lo", "hi"))
            unit = _unit(_matrix(part.column("embedding")))
            index = Tables(size, tables, probes, scale, seed)
            nodes, first, node = np.unique(kind, return_index=True, return_inverse=True)
            cells, probed = index.cells(unit[first])
            links, forest = np.zeros(len(nodes), np.int64), common.Forest(len(nodes))
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            starts = np.flatnonzero(new)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(kind)], strict=True):
                if b - a < 2:
                    continue
                owners = np.flatnonzero(own[a:b]) + a
                for step in range(a, b, 64):  # so few at a time that all pairs of a block may link without much memory
                    rows = np.arange(step, min(b, step + 64))
                    i, j = np.nonzero(unit[rows] @ unit[owners].T >= least - 1e-9)
                    x, y = rows[i], owners[j]
                    # an owner meets each other owner once; a prober meets the owners
                    keep = (node[x] != node[y]) & (~own[x] | (kind[x] < kind[y])) & ((lo[x] == hi[x]) | (blk[x] != blk[y]))
                    x, y = x[keep], y[keep]
                    exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                    x, y = x[exact], y[exact]
                    if not len(x):
                        continue
                    forest.join(node[x], node[y])
                    u, v, at = node[x], node[y], int(t[a])
                    met = np.zeros(len(u), bool)  # in an earlier table, or here by the other's probe
                    for k in range(at):
                        met |= (cells[u, k] == cells[v, k]) | (probed[u, k] == cells[v, k][:, None]).any(1) | (probed[v, k] == cells[u, k][:, None]).any(1)
                    met |= ~own[x] & (kind[x] > kind[y]) & (probed[v, at] == cells[u, at][:, None]).any(1)
                    np.add.at(links, u[~met], copies[y[~met]])
                    np.add.at(links, v[~met], copies[x[~met]])
            some = np.flatnonzero((links > 0) | (forest.root != np.arange(len(nodes))))
            out_class.append(nodes[some])
            out_links.append(links[some])
            out_root.append(nodes[forest.root[some]])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"class": cat(out_class), "links": cat(out_links), "root": cat(out_root)})

    return work


def near_duplicates(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int | None = None, probes: int = 3, scale: float | None = None, seed: int = 11) -> DataFrame:
    """Rows (key, n_links, component), one for each row of df: how many other vectors are linked directly, and the smallest key reachable.

    Vectors link within equal labels and lengths at a cosine of `least` or more. A null label, a null vector, a zero one and
    one with a null or non-finite component link with nothing. Equal vectors are one class however many there are and count
    with their number; pairs of classes are counted where the tables first bring them together and never leave as rows.
    A row whose key is null links to nothing and has component null. tables and scale follow from the number of vectors of the
    most frequent label unless they are given, so that neither cells nor the share of links missed grows with the input.
    """
    values = F.col(vector)
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(
        F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0), F.lit(False)
    )
    rows = df.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.transform(values, lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"), usable.alias("usable"))
    good = rows.where("usable").select("_key", "_label", "embedding")
    named = good.select("_key", F.xxhash64("_label", "embedding").alias("h1"), F.hash("_label", "embedding").alias("h2"), "_label", "embedding")
    classes = common.stored(named.groupBy("h1", "h2", "_label", "embedding").agg(F.min("_key").alias("class"), F.count(F.lit(1)).alias("copies")))
    sizes = classes.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n, most = sizes["n"] or 0, sizes["most"] or 0
    if tables is None or scale is None:
        made = tuned(most, least, probes)
        tables, scale = tables or made[0], scale or made[1]
    cells = common.arrow_map(classes.select("class", "embedding"), _rows(tables, probes, scale, seed), "class long, t int, code long, own boolean")
    met = cells.join(classes.select("class", "copies", "_label", "embedding"), "class").withColumn("bucket", F.xxhash64("t", "code", "_label", F.size("embedding"))).drop("code", "_label")
    found = common.stored(common.in_buckets(met, "bucket", "class", _compare(tables, probes, scale, seed, least), "class long, links long, root long", n * tables * (probes + 1)))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    tied = common.components(found.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    settled = classes.join(links, "class", "left").join(tied.withColumnRenamed("node", "class"), "class", "left")
    per_class = settled.select("h1", "h2", F.col("_label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    linked = named.join(per_class, (named.h1 == per_class.h1) & (named.h2 == per_class.h2) & (F.col("_label") == F.col("_l")) & (F.col("embedding") == F.col("_e")))
    rest = rows.where("not usable").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component"))
    return linked.select("_key", "n_links", "component").union(rest).withColumnRenamed("_key", key)
