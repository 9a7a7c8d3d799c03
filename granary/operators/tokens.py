"""Token arrays: encoders, training examples with masks, preference pairs, and streams cut into windows and shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from granary.functions.text import once
from granary.plans.durable import SMALL, stored

IGNORE = -100
#: Code points that are encoded at once.
_SLICE = 500_000


def char_ids(text: Column, end: int | None = 2, vocabulary: int = 48_000) -> Column:
    """Code points modulo the vocabulary, and the end id: the encoder where there is no tokenizer. Null texts stay null."""

    def coded(texts: list[str], tail: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) + tail for t in texts], np.int64)
        flat = np.full(int(sizes.sum()), end or 0, np.int32)
        place = np.ones(len(flat), bool)
        if tail:
            place[np.cumsum(sizes) - 1] = False
        flat[place] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % np.uint32(vocabulary)
        return flat, sizes

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
        done, own, total = [], [], 0
        for i in range(len(raw)):
            own.append((raw[i].as_py() or b"").decode(errors="replace"))
            total += len(own[-1])
            if total >= _SLICE or i + 1 == len(raw):
                done.append(coded(own, int(end is not None)))
                own, total = [], 0
        flat = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int32)
        ends = np.cumsum(np.concatenate([n for _, n in done])) if done else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat), mask=pa.array(~np.array(texts.is_valid().to_pylist(), bool)))

    return encode(text)


_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    """A tokenizer file, loaded once in each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def encoder(tokenizer_path: str, start: int | None = None, end: int | None = None):
    """A function from text to ids by a tokenizer file, with start and end ids where they are not there already."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        def framed(ids: list[int]) -> list[int]:
            if start is not None and ids[:1] != [start]:
                ids = [start, *ids]
            return [*ids, end] if end is not None and ids[-1:] != [end] else ids

        return pd.Series([framed(e.ids) for e in _tokenizer(tokenizer_path).encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return encode


def decoder(tokenizer_path: str):
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([_tokenizer(tokenizer_path).decode(list(x) if x is not None else [], skip_special_tokens=True) for x in ids])

    return decode


def with_training_example(df: DataFrame, prompt: str, answer: str, length: int, pad: int = 0, end: int = 2) -> DataFrame:
    """df (prompt and answer as ids) with input_ids and labels of `length` ids: the prompt's tail before the answer, labels one ahead, the prompt and padding ignored.

    An answer that would not leave room is cut so that some of the prompt stays, and ends with the end id. Each array is made
    once a row and then read by the next step.
    """
    m, p, a = length + 1, F.col(prompt), F.col(answer)
    room = F.least(F.size(p), F.greatest(F.lit(1), F.least(F.lit(m - 1), F.greatest(F.lit(16), F.lit(m // 4)))))
    cut = F.concat(F.slice(a, F.lit(1), m - room - 1), F.array(F.lit(end)))
    first = once(df, "_a", x=F.when(F.size(a) >= m, cut).otherwise(a))
    keep = F.greatest(F.lit(0), F.least(F.size(p), m - F.size("_a.x")))
    tail = F.when(keep > 0, F.slice(p, F.size(p) - keep + 1, F.greatest(keep, F.lit(1)))).otherwise(F.slice(p, 1, 0))
    ids = F.concat(tail, "_a.x", F.array_repeat(F.lit(pad), F.greatest(F.lit(0), m - keep - F.size("_a.x"))))
    second = once(first, "_i", x=ids, masked=F.greatest(F.lit(0), keep - 1))
    labels = F.transform(F.slice("_i.x", 2, length), lambda x, i: F.when((i < F.col("_i.masked")) | (x == pad), IGNORE).otherwise(x))
    return second.withColumn("input_ids", F.slice("_i.x", 1, length)).withColumn("labels", labels).drop("_a", "_i")


def preference_example(prompt: Column, chosen: Column, rejected: Column, length: int, pad: int = 0) -> Column:
    """struct(input_ids, rejected_ids, prompt_len): both answers after the prompt's head, cut and padded to `length`."""
    head = F.slice(prompt, 1, length // 3)

    def padded(answer: Column) -> Column:
        ids = F.slice(F.concat(head, answer), 1, length)
        return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))

    return F.struct(padded(chosen).alias("input_ids"), padded(rejected).alias("rejected_ids"), F.size(head).alias("prompt_len"))


def offsets(df: DataFrame, order: str, length: Column) -> DataFrame:
    """df with start: the sum of lengths before each row in the order of a distinct number.

    Only orders and lengths are sorted, in ranges that follow from their size; each range sums its own in one pass, and the
    sums of the ranges before, a row for each, are added. What else df has is joined to that by the order.
    """
    kind = df.schema[order].dataType.simpleString()

    def work(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), pa.array(ends), pa.array(np.full(len(n), part, np.int32))], ["_order", "_in", "_end", "_part"])
            before = int(ends[-1]) if len(ends) else before

    slim = df.select(F.col(order).alias("_order"), F.coalesce(length.cast("long"), F.lit(0)).alias("_length")).orderBy("_order")
    summed = stored(slim.mapInArrow(work, f"_order {kind}, _in long, _end long, _part int"), at_once=SMALL)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = summed.groupBy("_part").agg(F.max("_end").alias("n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    starts = summed.join(F.broadcast(base), F.col("_part") == F.col("_p")).select("_order", (F.col("_base") + F.col("_in")).alias("start"))
    return df.join(starts, F.col(order) == F.col("_order")).drop("_order")


def windows(stream: DataFrame, length: int, ids: str = "ids", pad: int = 0) -> DataFrame:
    """Rows (item, tokens): of a stream (start, ids) the windows tokens[item * length : item * length + length + 1], padded; their number is tokens div (length + 1), less one, one at least."""
    total = stream.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()[0]
    n = max(1, total // (length + 1) - 1)
    end = F.col("start") + F.size(ids) - 1  # the stream's last place in this row
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - length) / length).cast("long"))
    parts = stream.where(F.size(ids) > 0).withColumn("item", F.explode(F.sequence(first, F.floor(end / length).cast("long")))).where(F.col("item") < n)
    low = F.greatest(F.col("start"), F.col("item") * length)
    high = F.least(end, F.col("item") * length + length)
    cut = F.slice(ids, (low - F.col("start") + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
    pieces = parts.select("item", F.struct(low.alias("at"), cut.alias("x")).alias("p")).where(F.size("p.x") > 0)
    joined = pieces.groupBy("item").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.x)).alias("t"))
    return joined.select("item", F.concat("t", F.array_repeat(F.lit(pad), length + 1 - F.size("t"))).alias("tokens"))


def shards(stream: DataFrame, size: int, ids: str = "ids") -> DataFrame:
    """Rows (shard, at, ids): the slices of a stream (start, ids), each with its place in a shard of `size` tokens."""
    some = stream.where(F.size(ids) > 0)
    end = F.col("start") + F.size(ids)
    parts = some.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
    low = F.greatest(F.col("start"), F.col("shard") * size)
    high = F.least(end, (F.col("shard") + 1) * size)
    return parts.select(F.col("shard").cast("long").alias("shard"), (low - F.col("shard") * size).alias("at"), F.slice(ids, (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def write_shards(stream: DataFrame, folder: str, split: str, size: int, ids: str = "ids", first: int = 0) -> DataFrame:
    """Writes the stream as {split}_{shard:04d}.bin of unsigned 16-bit numbers in a folder that executors share, and returns (shard, tokens). Ids of 65,536 and above raise.

    Slices of documents are sorted, not tokens, and a shard is written as they come: a task holds a batch of them only.
    """

    def work(batches):
        import os

        shard, file, n, done = None, None, 0, []
        path = lambda: f"{folder}/{split}_{shard:04d}.bin"
        temporary = lambda: f"{path()}.tmp{os.getpid()}"

        def close() -> None:
            if file is not None:
                file.close()
                os.replace(temporary(), path())
                done.append((shard, n))

        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != shard:
                    close()
                    shard, n = k, 0
                    file = open(temporary(), "wb")  # noqa: SIM115
                values = own.values.to_numpy(zero_copy_only=False)
                if values.max() > 65_535 or values.min() < 0:
                    raise ValueError("a token does not fit 16 bits")
                file.write(values.astype("<u2").tobytes())
                n += len(values)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([x for _, x in done], pa.int64())], ["shard", "tokens"])

    placed = shards(stream, size, ids).withColumn("shard", F.col("shard") + first)
    return placed.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(work, "shard long, tokens long")


def completion_log_probability(log_p: Column, targets: Column, prompt_len: Column, pad: int = 0, end: int = 2) -> Column:
    """The sum of the log-probabilities of an answer's tokens, of arrays of what is predicted after each token but the last: from the prompt's end on, without padding and end ids."""
    each = F.transform(F.arrays_zip(log_p.alias("p"), targets.alias("t")), lambda x, i: F.when((i >= prompt_len - 1) & ~x.t.isin(pad, end), x.p).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def learning_rate(step: Column, warm_up: int, total: int, most: float, least: float) -> Column:
    """Linear warm-up, then a cosine down to the least rate; not clamped past the end."""
    progress = (step - warm_up) / F.lit(max(1, total - warm_up))
    return F.when(step < warm_up, F.lit(most) * step / F.lit(warm_up)).otherwise(F.lit(least) + F.lit(0.5) * (most - least) * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def preference_loss(chosen: Column, rejected: Column, base_chosen: Column, base_rejected: Column, beta: float) -> Column:
    """struct(loss, accuracy, margin) of preference optimisation, from the log-probabilities of the model and of its base."""
    margin = F.lit(beta) * ((chosen - base_chosen) - (rejected - base_rejected))
    return F.struct(F.log1p(F.exp(-margin)).alias("loss"), F.when(margin > 0, 1.0).otherwise(0.0).alias("accuracy"), margin.alias("margin"))
