"""Operator 7: removal of long repeated spans by de Bruijn compaction.

A window of `length` consecutive words is an edge of a de Bruijn graph over the corpus. Edges are dealt by their minimizer (the
k-mer in the window with the least hash), and the consecutive edges of a document with the same minimizer form a path; equal
paths of a document, which repeated lines make by the hundred, are one row with all the places where they start. A Spark join on
the minimizer brings all paths through it together: paths of equal words are one class, and where there is one class the path
does not branch and is settled by its earliest document as a whole. Only where paths branch are they opened into single edges,
once for each class, at the source coordinates of its earliest document, and joined edge by edge. Minimizers only bring paths
together; that paths or edges are equal is verified by 128-bit BLAKE2b digests of the very words at their coordinates.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

_BASE = np.uint64(0x9E3779B97F4A7C13)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a row of words, equal for equal words wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)]
        self.back = _powers(_UNBASE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.back[start] ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def digests(words: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each span of a row of words two 64-bit halves of a digest of the words."""
    out = [blake2b(b" ".join(words[a:b]), digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def paths_batch(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each text's different paths: the text, the number of windows, the minimizer and the digest of all words; then where each path's starts begin in the row of starts, and these."""
    ids, words, counts = common.number_words(texts)
    none = (*(np.zeros(0, d) for d in (np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    n = len(ids)
    if n < length:
        return none
    span = Spans(common.word_hashes(words)[ids])
    mers = span(np.arange(n - k + 1), np.arange(k, n + 1))
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(start):
        return none
    view = np.lib.stride_tricks.sliding_window_view(mers, length - k + 1)
    least = np.concatenate([view[start[a : a + 65536]].argmin(1) for a in range(0, len(start), 65536)]) + start
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1]) | (text[start[1:]] != text[start[:-1]])]
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(start)])
    at = start[first]
    flat = list(map(words.__getitem__, ids.tolist()))
    text, whole = text[at], digests(flat, at, at + windows + length - 1)
    order = np.lexsort((whole[:, 1], whole[:, 0], text))  # stable: the starts of a path ascend
    text, whole = text[order], whole[order]
    one = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]).any(1)])
    return text[one], windows[order[one]], mers[least[first[order[one]]]], whole[one], np.r_[one, len(order)], at[order] - begin[text]


def paths(df: DataFrame, length: int, k: int) -> DataFrame:
    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            text, windows, minimizer, whole, offsets, starts = paths_batch(texts[a:b], length, k)
            keys = batch.column(0)[a:b].take(pa.array(text))
            places = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(starts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, places, pa.array(windows.astype(np.int16)), pa.array(minimizer.view(np.int64)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy())], ["key", "starts", "windows", "minimizer", "whole", "check"])

    return common.arrow_map(df.where("key is not null").select("key", "text"), work, "key long, starts array<int>, windows short, minimizer long, whole long, check long")


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _spread(marks: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of marked paths begin and end, each path at all its starts."""
    starts = np.array([s for m in marks for s in m["starts"]], np.int64)
    windows = np.array([m["windows"] for m in marks for _ in m["starts"]], np.int64)
    return starts, starts + windows + length - 1


def _finish(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    words = text.split()
    if not len(starts):
        return len(words), 0, b" ".join(words)
    gone = _covered(len(words), starts, ends)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


_SETTLED = "n_words long, n_removed long, kept string"


def _settle(length: int):
    """Removes the paths that an earlier document has as a whole; opens the others that were marked into windows, and leaves their texts for the last step."""
    edge = pa.struct([("minimizer", pa.int64()), ("edge", pa.int64()), ("check", pa.int64()), ("starts", pa.list_(pa.int32()))])
    span = pa.struct([("starts", pa.list_(pa.int32())), ("windows", pa.int32())])

    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            out: dict[str, list] = {"key": batch.column(0)[a:b].to_pylist(), "n_words": [], "n_removed": [], "kept": [], "gone": [], "edges": []}
            for text, marks in zip(texts[a:b], batch.column(2)[a:b].to_pylist(), strict=True):
                gone = [m for m in marks or () if not m["open"]]
                opened = [m for m in marks or () if m["open"]]
                if opened:
                    words = text.split()
                    places = [(m, n) for m in opened for n in range(m["windows"])]
                    first = np.array([m["starts"][0] + n for m, n in places], np.int64)
                    edges = digests(words, first, first + length)
                    out["edges"].append([{"minimizer": m["minimizer"], "edge": y[0], "check": y[1], "starts": [s + n for s in m["starts"]]} for (m, n), y in zip(places, edges.tolist(), strict=True)])
                    out["gone"].append([{"starts": m["starts"], "windows": m["windows"]} for m in gone])
                    result = (len(words), 0, text)
                else:
                    result = _finish(text, *_spread(gone, length))
                    out["edges"].append(None)
                    out["gone"].append(None)
                for name, value in zip(("n_words", "n_removed", "kept"), result, strict=True):
                    out[name].append(value)
            kept = pa.array(out["kept"], pa.binary()).view(pa.string())  # not validated: broken UTF-8 stays as it came
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), kept, pa.array(out["gone"], pa.list_(span)), pa.array(out["edges"], pa.list_(edge)), batch.column(3)[a:b]], ["key", "n_words", "n_removed", "kept", "gone", "edges", "more"])

    return work


def _close(length: int):
    def work(batch: pa.RecordBatch):
        texts = common.binary(batch.column(1))
        for a, b in common.slices([len(t) for t in texts]):
            done = []
            for text, gone, starts in zip(texts[a:b], batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist(), strict=True):
                first, end = _spread(gone, length)
                single = np.array(starts or [], np.int64)
                done.append(_finish(text, np.r_[first, single], np.r_[end, single + length]))
            n, removed, kept = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string()), batch.column(4)[a:b]], ["key", "n_words", "n_removed", "kept", "more"])

    return work


def remove_repeated(df: DataFrame, length: int = 50, k: int = 10, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, n_words, n_removed, kept) and the columns to carry, one for each row of df: the words left, joined by one space.

    A word goes if a window of `length` words over it also starts in a row with a smaller key; windows are taken from the input.
    Null and empty texts have no words. A row with a null key neither loses words nor makes others lose any. Repeated rows
    (equal key and text) do not count against each other; keys are integers and name one text.
    """
    more = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(carry))) if carry else F.struct(F.lit(0).alias("_0"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), more.alias("more"))
    kind = rows.schema["more"].dataType.simpleString()
    every = common.stored(paths(rows, length, k))
    # stored, so that the joins below read both sides from exchanges and Spark may split a frequent minimizer
    twice = common.stored(every.groupBy("minimizer").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("minimizer"))
    runs = common.stored(every.join(twice, "minimizer", "left_semi"))
    classes = common.stored(runs.groupBy("minimizer", "whole", "check").agg(F.min("key").alias("low"), F.max("key").alias("high")))
    through = classes.groupBy("minimizer").agg(F.count(F.lit(1)).alias("classes"), F.min("low").alias("lowest"), F.max("high").alias("highest")).where("lowest < highest").select("minimizer", "classes")
    through = common.stored(through)
    shared = common.stored(classes.join(through, "minimizer").where("classes > 1 or low < high"))
    met = runs.join(shared, ["minimizer", "whole", "check"]).where("key > low or classes > 1")
    marks = met.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("starts", F.col("windows").cast("int").alias("windows"), "minimizer", (F.col("key") == F.col("low")).alias("open"))).alias("marks"))
    named, plain = rows.where("key is not null"), rows.where("key is null")  # without a key they would all meet in one task
    joined = named.join(marks.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").select("key", "text", "marks", "more")
    joined = joined.union(plain.select("key", "text", F.lit(None).cast(joined.schema["marks"].dataType), "more"))
    some = common.stored(common.arrow_map(joined, _settle(length), f"key long, {_SETTLED}, gone array<struct<starts array<int>, windows int>>, edges array<struct<minimizer long, edge long, check long, starts array<int>>>, more {kind}"))
    edges = some.where("edges is not null").select("key", F.explode("edges").alias("e")).select("key", "e.*")
    common.discard(every, twice, runs, classes, through, shared)
    earliest = common.stored(edges.groupBy("minimizer", "edge", "check").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").drop("high"))
    later = edges.join(earliest, ["minimizer", "edge", "check"]).where("key > low").groupBy(F.col("key").alias("_key")).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    pending = some.where("edges is not null").join(later.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").select("key", "kept", "gone", "starts", "more")
    closed = common.arrow_map(pending, _close(length), f"key long, {_SETTLED}, more {kind}")
    out = some.where("edges is null").select("key", "n_words", "n_removed", "kept", "more").union(closed)
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept", *(F.col(f"more._{i}").alias(c) for i, c in enumerate(carry)))
