"""Operator 1: language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts of every token of the training rows are exact and cover all of them. The neural part predicts units: the most frequent
tokens, and kinds of the others by how they end; within a kind a token has its share of the kind's counts. A context is the
sum of the last units' vectors, each weighted by its distance. A unit's probability is its class's, normalised over the
classes, times its own, normalised over the class: both are products of the context with vectors, made for a batch at once,
so the number of units may be large. Classes are ranges of units from frequent to rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import common

#: Stands for the end of a text; no word has a line feed.
END = "\n"


@dataclass
class Setup:
    """words, endings, rest: numbers of units that are tokens, endings of tokens, and hashed remainders; context: units looked back at.

    noise: noise samples of classes a batch; inner_noise: of units in each class. block_chars: characters whose vocabulary is
    counted together; replica_tokens: what one replica learns from; warm_up_tokens: about so many, chosen by hash as whole
    texts, give the replicas their common start; all rows are learned from after that.
    """

    words: int = 3000
    endings: int = 1000
    rest: int = 96
    classes: int = 64
    width: int = 16
    context: int = 4
    noise: int = 64
    inner_noise: int = 16
    batch: int = 2048
    rate: float = 0.4
    block_chars: int = 16_000_000
    replica_tokens: int = 2_500_000
    warm_up_tokens: int = 300_000
    warm_up_passes: int = 3

    @property
    def units(self) -> int:
        return self.words + self.endings + self.rest


@dataclass
class Model:
    """R: vectors of context units; C: weights by distance; P, d: vectors and biases of classes; Q, b: of units in their classes; bounds: each class's first unit, and the number of units."""

    R: np.ndarray
    C: np.ndarray
    P: np.ndarray
    d: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    bounds: np.ndarray

    LEARNED = "RCPdQb"

    @classmethod
    def start(cls, share: np.ndarray, bounds: np.ndarray, setup: Setup) -> Model:
        rng = np.random.default_rng(17)
        draw = lambda size, *shape: rng.normal(0, size, shape).astype(np.float32)
        mass = np.add.reduceat(share, bounds[:-1])
        near = np.linspace(1, 0.6, setup.context, dtype=np.float32)[:, None] * np.ones((1, setup.width), np.float32)
        inner = share / np.repeat(mass, np.diff(bounds))
        return cls(draw(0.3, len(share), setup.width), near, draw(0.1, len(mass), setup.width), np.log(mass).astype(np.float32), draw(0.1, len(share), setup.width), np.log(inner).astype(np.float32), bounds)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.LEARNED])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (getattr(self, k) for k in self.LEARNED):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out, self.bounds)

    def predicted(self, context: np.ndarray) -> np.ndarray:
        weighted = self.C[:, None] * self.R
        p = weighted[0].take(context[:, 0], 0)
        for j in range(1, context.shape[1]):
            p += weighted[j].take(context[:, j], 0)
        return p

    @staticmethod
    def _log_share(p: np.ndarray, vectors: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Logarithms of the softmax over rows of vectors, at each row's own."""
        s = p @ vectors.T
        s += bias
        got = s[np.arange(len(s)), own]
        if np.abs(s).max() > 60:  # else no exponential can overflow
            most = s.max(1)
            s -= most[:, None]
            got = got - most
        np.exp(s, out=s)
        return got - np.log(s.sum(1))

    def log10(self, context: np.ndarray, target: np.ndarray, rows: int = 1 << 15) -> np.ndarray:
        """Normalised log-probabilities of units after their contexts."""
        out = np.empty(len(target))
        kind = (np.searchsorted(self.bounds, target, "right") - 1).astype(np.uint16)
        for a in range(0, len(target), rows):
            own, c = target[a : a + rows], kind[a : a + rows]
            p = self.predicted(context[a : a + rows])
            got = np.concatenate([self._log_share(p[x : x + 2048], self.P, self.d, c[x : x + 2048]) for x in range(0, len(p), 2048)])
            order = np.argsort(c, kind="stable")
            ends = np.cumsum(np.bincount(c, minlength=len(self.P)))
            p = p.take(order, 0)
            for k in np.flatnonzero(np.diff(np.r_[0, ends])).tolist():
                lo, hi = self.bounds[k], self.bounds[k + 1]
                if hi - lo < 2:
                    continue
                for x in range(ends[k - 1] if k else 0, ends[k], 2048):
                    y = min(x + 2048, ends[k])
                    at = order[x:y]
                    got[at] += self._log_share(p[x:y], self.Q[lo:hi], self.b[lo:hi], own[at] - lo)
            out[a : a + rows] = got
        return out / np.log(10)


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their values, for indices in order."""
    starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[starts], np.add.reduceat(values, starts, axis=0)


def _scatter(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for indices in any order."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    return _sums(index[order], values.take(order, 0))


class Trainer:
    """Noise-contrastive estimation of classes, and of units within their classes, against noise drawn by the training shares; steps shrink by AdaGrad."""

    def __init__(self, model: Model, share: np.ndarray, setup: Setup, seed: int):
        self.m, self.setup, self.rng = model, setup, np.random.default_rng(seed)
        self.steps = {k: np.full(len(getattr(model, k)), 1e-3, np.float32) for k in "RPdQb"} | {"C": np.float32(1.0)}
        first, last = model.bounds[:-1], model.bounds[1:]
        self.cum = np.cumsum(share.astype(np.float64))
        self.below = np.r_[0, self.cum][first]
        self.mass = self.cum[last - 1] - self.below
        self.log_class = np.log(self.mass * setup.noise).astype(np.float32)
        self.log_unit = np.log(share / np.repeat(self.mass, last - first) * setup.inner_noise).astype(np.float32)
        self.seen = 0.0

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        acc = self.steps[name]
        acc[rows] += (grad * grad).mean(1) if grad.ndim > 1 else grad * grad
        step = self.setup.rate / np.sqrt(acc[rows])
        getattr(self.m, name)[rows] += grad * (step[:, None] if grad.ndim > 1 else step)

    def learn(self, context: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None) -> None:
        """One pass over units after their contexts; a unit of weight n counts as n times the same."""
        for a in range(0, len(target), self.setup.batch):
            own = slice(a, a + self.setup.batch)
            self._batch(context[own], target[own], None if weight is None else weight[own])

    def _batch(self, context: np.ndarray, target: np.ndarray, weight: np.ndarray | None) -> None:
        m, k, inner = self.m, self.setup.noise, self.setup.inner_noise
        order = np.argsort(target.astype(np.uint16), kind="stable")
        c, w = context.take(order, 0), target[order]
        n = np.full(len(w), 1 / len(w), np.float32) if weight is None else (weight[order] / weight.sum()).astype(np.float32)
        self.seen += len(w) if weight is None else float(weight.sum())
        ends = np.searchsorted(w, m.bounds[1:])
        kind = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        p = m.predicted(c)
        # classes against noise classes
        z = np.searchsorted(self.cum, self.rng.random(k) * self.cum[-1]).clip(0, len(self.cum) - 1)
        z = np.sort(np.searchsorted(m.bounds, z, "right") - 1)
        up = self._share(np.einsum("ij,ij->i", p, m.P.take(kind, 0)) + (m.d - self.log_class)[kind], n)
        down = -self._share(-(p @ m.P[z].T + (m.d - self.log_class)[z]), n[:, None])
        by_p = up[:, None] * m.P.take(kind, 0) + down @ m.P[z]
        grad_p, grad_d = np.zeros_like(m.P), np.zeros_like(m.d)
        for at, one, rows in ((*_sums(kind, np.concatenate([up[:, None] * p, up[:, None]], 1)), kind), (*_sums(z, np.concatenate([down.T @ p, down.sum(0)[:, None]], 1)), z)):
            grad_p[at] += one[:, :-1]
            grad_d[at] += one[:, -1]
        moved = np.union1d(kind, z)
        # units against noise units of their class
        draw = self.below[:, None] + self.rng.random((len(ends), inner)) * self.mass[:, None]
        zu = np.searchsorted(self.cum, draw.ravel()).reshape(draw.shape).clip(m.bounds[:-1, None], m.bounds[1:, None] - 1)
        qw, qz = m.Q.take(w, 0), m.Q[zu]
        offset = m.b - self.log_unit
        up = self._share(np.einsum("ij,ij->i", p, qw) + offset[w], n)
        score, starts = np.empty((len(w), inner), np.float32), np.r_[0, ends]
        there = [x for x in np.flatnonzero(np.diff(starts)).tolist() if m.bounds[x + 1] - m.bounds[x] > 1]
        alone = np.diff(m.bounds)[kind] < 2  # a class of one unit has nothing to tell apart
        up[alone] = 0
        score[alone] = -100
        for x in there:
            own = slice(starts[x], starts[x + 1])
            np.matmul(p[own], qz[x].T, out=score[own])
            score[own] += offset[zu[x]]
        down = -self._share(np.negative(score, out=score), n[:, None])
        by_p += up[:, None] * qw
        grad_z = np.zeros((len(ends), inner, p.shape[1] + 1), np.float32)
        for x in there:
            own = slice(starts[x], starts[x + 1])
            by_p[own] += down[own] @ qz[x]
            grad_z[x, :, :-1] = down[own].T @ p[own]
            grad_z[x, :, -1] = down[own].sum(0)
        grad = np.zeros((len(m.Q), p.shape[1] + 1), np.float32)
        at, one = _sums(w, np.concatenate([up[:, None] * p, up[:, None]], 1))
        grad[at] += one
        atz, one = _scatter(zu.ravel(), grad_z.reshape(-1, grad_z.shape[2]))
        grad[atz] += one
        units = np.flatnonzero(grad.any(1))
        # contexts: summed by unit first, so that the products are made once a unit
        by_c, by_r = np.empty_like(m.C), np.zeros_like(m.R)
        for j in range(len(m.C)):
            rows, one = _scatter(c[:, j], by_p)
            by_c[j] = np.einsum("ij,ij->j", one, m.R[rows])
            by_r[rows] += one * m.C[j]
        self._move("P", moved, grad_p[moved])
        self._move("d", moved, grad_d[moved])
        self._move("Q", units, grad[units, :-1])
        self._move("b", units, grad[units, -1])
        rows = np.flatnonzero(by_r.any(1))
        self._move("R", rows, by_r[rows])
        self.steps["C"] += np.float32((by_c * by_c).mean())
        m.C += by_c * np.float32(0.1 * self.setup.rate / np.sqrt(self.steps["C"]))

    @staticmethod
    def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n / (1 + exp(x)), in place."""
        with np.errstate(over="ignore"):  # an infinite exponential makes the share 0, as it should
            np.exp(x, out=x)
        x += 1
        return np.divide(n, x, out=x)


def contexts(units: np.ndarray, counts: np.ndarray, end: int, look_back: int) -> np.ndarray:
    """The units before each unit, nearest first; before a text's first there are ends."""
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(len(units))
    out = np.full((len(units), look_back), end, np.int32)
    for j in range(look_back):
        ok = at - j - 1 >= first
        out[ok, j] = units[at[ok] - j - 1]
    return out


def _split(texts: list[bytes], number: common.Numbering) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts' tokens in a row, and each text's number of tokens; the end is a token."""
    mark, rows = END.encode(), []
    for t in texts:
        words = t.lower().split()
        words.append(mark)
        rows.append(words)
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(map(number.__getitem__, common.chain.from_iterable(rows)), np.int32, int(counts.sum())), counts


def _blocks(setup: Setup, kind: pa.DataType):
    """Blocks of a task's rows: each row with the numbers of its tokens, and the block's distinct tokens with their counts in the training rows, which may be zero."""
    schema = pa.schema([("block", pa.int64()), ("key", kind), ("held", pa.bool_()), ("ids", pa.binary()), ("k", pa.int32()), ("token", pa.binary()), ("c", pa.int64())])

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars = TaskContext.get().partitionId() << 24, 0
        number, counts = common.Numbering(), np.zeros(1 << 16, np.int64)

        def words() -> pa.RecordBatch:
            n = len(number)
            return batch(n, block=pa.array(np.full(n, block)), k=pa.array(np.arange(n, dtype=np.int32)), token=pa.array(list(number), pa.binary()), c=pa.array(counts[:n]))

        for got in batches:
            texts, held = common.binary(got.column(1)), got.column(2).to_numpy(zero_copy_only=False)
            for a, b in common.slices([len(t) for t in texts]):
                ids, sizes = _split(texts[a:b], number)
                if len(number) > len(counts):
                    counts = np.r_[counts, np.zeros(len(number), np.int64)]
                counts += np.bincount(ids[np.repeat(~held[a:b], sizes)], minlength=len(counts))
                ends = pa.py_buffer(np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32).tobytes())
                own = pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(ids.tobytes())])
                yield batch(b - a, block=pa.array(np.full(b - a, block)), key=got.column(0)[a:b], held=got.column(2)[a:b], ids=own)
                chars += sum(map(len, texts[a:b]))
                if chars >= setup.block_chars:
                    yield words()
                    block, chars = block + 1, 0
                    number, counts = common.Numbering(), np.zeros(1 << 16, np.int64)
        if number:
            yield words()

    return work


def _ending(token: Column) -> Column:
    """The last three characters without the marks behind them, and the first of those marks."""
    bare = F.regexp_replace(token, r"[^\p{L}\p{N}]+$", "")
    return F.concat(F.substring(bare, -3, 3), F.lit("\n"), F.substring(token, F.length(bare) + 1, F.lit(1)))


@dataclass
class Units:
    """Which unit a token is: its own, its ending's, or a hashed remainder's (rest has their units); the tokens and distinct tokens of each; the classes' bounds. Units are numbered from frequent to rare, those that are tokens marked in is_word."""

    words: dict[bytes, int]
    endings: dict[str, int]
    rest: list[int]
    counts: np.ndarray
    kinds: np.ndarray
    is_word: np.ndarray
    bounds: np.ndarray

    @property
    def end(self) -> int:
        return self.words[END.encode()]

    @property
    def share(self) -> np.ndarray:
        return (self.counts + 1) / (self.counts + 1).sum()

    def inner(self, unit: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the share that tokens of count c have in their unit, one unseen token included."""
        return np.where(self.is_word[unit], 0.0, np.log10((c + 1) / (self.counts[unit] + self.kinds[unit] + 1)))


def _with_units(tokens: DataFrame, words: dict[bytes, int], endings: dict[str, int], rest: list[int]) -> DataFrame:
    """tokens with a column unit; the maps are of bounded size and joined by broadcast."""
    spark = tokens.sparkSession
    word_rows = spark.createDataFrame([(bytearray(w), k) for w, k in words.items()], "_word binary, _w int")
    ending_rows = spark.createDataFrame(list(endings.items()), "_ending string, _e int")
    other = F.element_at(F.array(*map(F.lit, rest)), F.pmod(F.xxhash64("token"), F.lit(len(rest))).cast("int") + 1)
    out = tokens.withColumn("_end", _ending(F.col("token").cast("string"))).join(F.broadcast(word_rows), F.col("token") == F.col("_word"), "left").join(F.broadcast(ending_rows), F.col("_end") == F.col("_ending"), "left")
    return out.withColumn("unit", F.coalesce("_w", "_e", other)).drop("_word", "_w", "_ending", "_e", "_end")


def choose_units(tokens: DataFrame, setup: Setup) -> Units:
    """The most frequent tokens, then the most frequent endings of the rest, of rows (token, c); the end is always a unit. What comes to the driver is bounded by the number of units."""
    spark, mark = tokens.sparkSession, END.encode()
    top = tokens.where((F.col("c") > 0) & (F.col("token") != F.lit(bytearray(mark)))).orderBy(F.desc("c"), "token").limit(setup.words - 1).collect()
    words = {mark: 0} | {bytes(r["token"]): k for k, r in enumerate(top, 1)}
    word_rows = spark.createDataFrame([(bytearray(w),) for w in words], "_word binary")
    others = tokens.where("c > 0").join(F.broadcast(word_rows), F.col("token") == F.col("_word"), "left_anti")
    found = others.groupBy(_ending(F.col("token").cast("string")).alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(setup.endings).collect()
    endings = {r["e"]: setup.words + k for k, r in enumerate(found)}
    rest = list(range(setup.words + setup.endings, setup.units))
    counts, kinds = np.zeros(setup.units), np.zeros(setup.units)
    for r in _with_units(tokens.where("c > 0"), words, endings, rest).groupBy("unit").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        counts[r["unit"]], kinds[r["unit"]] = r["c"], r["n"]
    order = np.argsort(-counts, kind="stable")
    place = np.empty(setup.units, np.int64)
    place[order] = np.arange(setup.units)
    weight = np.cumsum(np.sqrt(counts[order] + 1))
    kind = np.minimum((setup.classes * (weight - weight[0] / 2) / weight[-1]).astype(np.int64), setup.classes - 1)
    bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(kind) > 0]), setup.units]
    named = lambda own: {x: int(place[k]) for x, k in own.items()}
    return Units(named(words), named(endings), place[rest].tolist(), counts[order], kinds[order], order < setup.words, bounds)


def _measured(shared, kind: pa.DataType):
    """Of a block's rows, what the counts give, and their units as unsigned 16-bit numbers."""

    def work(key: tuple, rows: pa.Table, vocabulary: pa.Table) -> pa.Table:
        units, total = shared.value
        at = vocabulary.column("k").to_numpy()
        unit, c = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        unit[at], c[at] = vocabulary.column("unit").to_numpy(), vocabulary.column("c").to_numpy()
        base, inner, known = np.log10((c + 1) / total), units.inner(unit, c), (c > 0).astype(np.int64)
        out: dict[str, list] = {n: [] for n in ("n_tokens", "n_known", "base_score", "inner_score")}
        own = []
        parts = rows.column("ids").to_pylist()
        for a, b in common.slices([len(x) for x in parts]):
            ids = np.frombuffer(b"".join(parts[a:b]), np.int32)
            sizes = np.array([len(x) // 4 for x in parts[a:b]])
            starts = np.cumsum(sizes) - sizes
            out["n_tokens"].append(sizes)
            for name, values in (("n_known", known), ("base_score", base), ("inner_score", inner)):
                out[name].append(np.add.reduceat(values[ids], starts))
            raw = unit.astype(np.uint16)[ids].tobytes()
            own += [raw[2 * x : 2 * (x + n)] for x, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        made = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
        return pa.table({"key": rows.column("key"), "held": rows.column("held"), **made, "units": pa.array(own, pa.binary())})

    return work


def _unit_rows(column: list[bytes], most: int = 300_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows of units: from and to which row, their units, each row's number of them."""
    for a, b in common.slices([len(x) // 2 for x in column], most):
        yield a, b, np.frombuffer(b"".join(column[a:b]), np.uint16), np.array([len(x) // 2 for x in column[a:b]])


def _combined(batch: pa.RecordBatch):
    """Rows of equal h as one, with their number."""
    h = batch.column(0).to_numpy()
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(n), batch.column(1).take(pa.array(first))], ["h", "n", "units"])


def train(rows: DataFrame, units: Units, setup: Setup) -> Model:
    """Learns from all rows (h long, units binary), where h names a row's key and units.

    Rows are dealt to replicas by h, and a replica goes through its rows in the order of h, so the model does not depend on how
    the input is partitioned. Repeated rows are counted before they are dealt, and weigh as many times. All replicas begin
    with the warm start; their models are averaged by the tokens they saw, in a tree of means. What returns to the driver is
    one model, whatever the input. Numbers of units fit 16 bits.
    """
    spark = rows.sparkSession
    share, bounds = units.share, units.bounds
    start = Model.start(share, bounds, setup)
    total = rows.agg(F.sum(F.length("units")).alias("n")).first()["n"] or 0
    if not total:
        return start
    total //= 2

    def learn(trainer: Trainer, table: pa.Table, passes: int) -> None:
        h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
        kinds, first, node = np.unique(h, return_index=True, return_inverse=True)
        weight = np.bincount(node, n)
        texts = table.column("units").take(pa.array(first)).to_pylist()
        for _ in range(passes):
            for a, b, own, counts in _unit_rows(texts):
                each = np.repeat(weight[a:b], counts) if (weight[a:b] > 1).any() else None
                trainer.learn(contexts(own, counts, units.end, setup.context), own.astype(np.int64), each)

    def warm(table: pa.Table) -> pa.Table:
        trainer = Trainer(start.filled(start.flat()), share, setup, 1)
        learn(trainer, table, setup.warm_up_passes)
        steps = np.concatenate([np.atleast_1d(trainer.steps[k]).ravel() for k in "RPdQbC"])
        return pa.table({"flat": [trainer.m.flat().tobytes()], "steps": [steps.tobytes()]})

    combined = common.arrow_map(rows.select("h", "units"), _combined, "h long, n long, units binary")
    some = combined.where(F.pmod("h", F.lit(max(1, total // setup.warm_up_tokens))) == 0)
    began = some.groupBy(F.lit(0).alias("_g")).applyInArrow(warm, "flat binary, steps binary").collect()
    first = start.filled(np.frombuffer(began[0]["flat"], np.float32)) if began else start
    steps = np.frombuffer(began[0]["steps"], np.float32) if began else None
    replicas = max(1, round(total / setup.replica_tokens))
    shared = spark.sparkContext.broadcast((first, steps, units, setup))  # of the units' size

    def replica(table: pa.Table) -> pa.Table:
        model, steps_, units_, setup_ = shared.value
        own = Trainer(model.filled(model.flat()), units_.share, setup_, 2)
        if steps_ is not None:
            at = 0
            for k in "RPdQb":
                size = len(own.steps[k])
                own.steps[k] = steps_[at : at + size].copy()
                at += size
            own.steps["C"] = steps_[at]
        learn(own, table, 1)
        return pa.table({"at": table.column("at")[:1], "n": [own.seen], "flat": [own.m.flat().tobytes()]})

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n, at = table.column("n").to_numpy(), table.column("at")[0].as_py() // 64
        flat = sum(np.frombuffer(x, np.float32).astype(np.float64) * w for x, w in zip(table.column("flat").to_pylist(), n, strict=True)) / n.sum()
        return pa.table({"at": [at], "n": [n.sum()], "flat": [flat.astype(np.float32).tobytes()]})

    models = combined.withColumn("at", F.pmod(F.xxhash64("h"), F.lit(replicas)))
    models = common.stored(models.groupBy("at").applyInArrow(replica, "at long, n double, flat binary"))
    while replicas > 1:
        means = common.stored(models.groupBy(F.floor(F.col("at") / 64)).applyInArrow(mean, "at long, n double, flat binary"))
        common.discard(models)
        models, replicas = means, -(-replicas // 64)
    last = models.collect()
    common.discard(models)
    return first.filled(np.frombuffer(last[0]["flat"], np.float32))


def score(df: DataFrame, held: Column, setup: Setup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, n_known, train_tokens, base_score, score), one for each row of df, learned from the rows where held is false.

    n_known: tokens that occur in training. base_score: log10 probability by counts with one added. score: the model's. Null
    and empty texts are their end alone. With nothing to learn from, every token is unseen and all units are as likely.
    Repeated rows each count and each get a row; null keys stay null. Texts are read once, and not shuffled: each task numbers
    the tokens of its rows in blocks of about block_chars characters, a block's distinct tokens meet the counts by a join,
    and go back to the block's rows, so no task holds more vocabulary than one block has. Results do not depend on partitions.
    """
    setup = setup or Setup()
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(df.schema[key].dataType), df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    blocks = common.stored(rows.mapInArrow(_blocks(setup, kind), f"block long, key {name}, held boolean, ids binary, k int, token binary, c long"))
    met = blocks.where("token is not null").select("block", "k", "token", "c")
    tokens = common.stored(met.groupBy("token").agg(F.sum("c").alias("c")))
    sums = tokens.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    units = choose_units(tokens, setup)
    shared = df.sparkSession.sparkContext.broadcast((units, float(sums["n"] + sums["v"] + 1)))
    known = common.stored(_with_units(tokens, units.words, units.endings, units.rest))
    vocabulary = met.select("block", "k", "token").join(known, "token").select("block", "k", "unit", "c")
    numbered = blocks.where("ids is not null").select(F.col("block").alias("_block"), "key", "held", "ids")
    measured = numbered.groupBy("_block").cogroup(vocabulary.groupBy("block")).applyInArrow(_measured(shared, kind), f"key {name}, held boolean, n_tokens long, n_known long, base_score double, inner_score double, units binary")
    measured = common.stored(measured)
    common.discard(blocks, tokens, known)
    model = train(measured.where("not held").select(F.xxhash64("key", "units").alias("h"), "units"), units, setup)
    trained = df.sparkSession.sparkContext.broadcast((model, units.end, setup))

    def work(batch: pa.RecordBatch):
        model_, end, setup_ = trained.value
        inner = batch.column(4).to_numpy()
        for a, b, own, counts in _unit_rows(batch.column(5).to_pylist()):
            got = np.add.reduceat(model_.log10(contexts(own, counts, end, setup_.context), own.astype(np.int64)), np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(4)), pa.array(got + inner[a:b])], ["key", "n_tokens", "n_known", "base_score", "score"])

    plain = measured.select("key", "n_tokens", "n_known", "base_score", "inner_score", "units")
    scored = common.arrow_map(plain, work, f"key {name}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(sums["n"]).cast("long")).withColumnRenamed("key", key)
