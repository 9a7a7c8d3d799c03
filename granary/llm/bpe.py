"""Operator 8: byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary entry gets its id from one
probe. Tier two takes the misses: a heap of ranked neighbour merges over a doubly linked list of byte pieces.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from granary.llm import common

# The pre-token pattern for texts whose characters the built-in engine classes as the library's does, and characters that it does not.
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNLIKE = r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧‰-⁞]"

_full, _fast, _unlike = regex.compile(public_tokenizers.PATTERN), re.compile(FAST_PATTERN), re.compile(UNLIKE)


def pre_tokens(text: str) -> list[str]:
    return (_full if _unlike.search(text) else _fast).findall(text)


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings (hash and displace): n keys onto 0..n-1, one displacement a bucket."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        lo, hi = self._halves(keys)
        bucket = (lo % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        groups = [order[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)  # a displacement, or -1 - slot for a bucket of one key
        self.slot_key: list[int] = [0] * n
        alone: list[int] = []
        for g in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[g]
            if len(own) < 2:
                alone += [g] * len(own)
                continue
            start = 0
            while True:
                d = np.arange(start, start + 128)
                at = self._slot(hi[own][None, :], d[:, None])
                fits = ~taken[at].any(1)
                for k in np.flatnonzero(fits).tolist():
                    if len(set(at[k].tolist())) == len(own):
                        break
                else:
                    start += 128
                    continue
                break
            taken[at[k]] = True
            self.shift[g] = start + k
            for key, slot in zip(own.tolist(), at[k].tolist(), strict=True):
                self.slot_key[slot] = key
        for g, slot in zip(alone, np.flatnonzero(~taken).tolist(), strict=True):
            self.shift[g] = -1 - slot
            self.slot_key[slot] = int(groups[g][0])

    @staticmethod
    def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2)
        return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint64)

    def _slot(self, hi: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hi + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        return np.where(d < 0, -1 - d, (x % np.uint64(self.n)).astype(np.int64))

    def lookup(self, keys: list[bytes]) -> list[int]:
        """For each key, the position in the key list of the only entry that it can equal."""
        if not keys or not self.n:
            return []
        lo, hi = self._halves(keys)
        at = self._slot(hi, self.shift[(lo % np.uint64(self.buckets)).astype(np.int64)])
        return [self.slot_key[s] for s in at.tolist()]


class TwoTierBpe:
    """Encoder and decoder for a file of ranks (base64 of a token's bytes, a space, its rank, on each line)."""

    #: Encoded misses that are kept; the older half goes when they are as many.
    MEMO = 360_000

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = list(self.ranks)
        self.ids = list(self.ranks.values())
        most = max(self.ids, default=-1) + 1
        self.width, self.first = np.full(most, -1, np.int32), np.zeros(most, np.int32)
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.width[self.ids] = own = np.fromiter(map(len, self.tokens), np.int32, len(self.tokens))
        self.first[self.ids] = np.cumsum(own) - own
        self.hash = PerfectHash(self.tokens)
        self._young: dict[bytes, tuple[int, ...]] = {}
        self._old: dict[bytes, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: neighbours merge, lowest rank first and leftmost among equals, until no pair is in the vocabulary."""
        rank, n = self.ranks.get, len(word)
        end, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, stop = heappop(heap)
            if end[i] != mid or end[mid] != stop:
                continue
            end[i], end[mid] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, stop, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(word[h:stop])) is not None:
                heappush(heap, (r, h, i, stop))
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct pre-tokens: the perfect hash answers for whole entries, the heap for the rest."""
        out: list[tuple[int, ...]] = []
        tokens, ids = self.tokens, self.ids
        for word, k in zip(words, self.hash.lookup(words), strict=True):
            if tokens[k] == word:
                out.append((ids[k],))
                continue
            got = self._young.get(word) or self._old.get(word)
            if got is None:
                got = self.merge(word)
                if len(word) <= 64:
                    self._young[word] = got
                    if len(self._young) >= self.MEMO // 2:
                        self._old, self._young = self._young, {}
            out.append(got)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's number of ids."""
        split = [pre_tokens(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        number = common.Numbering()
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ids = self.resolve([t.encode() for t in number])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return out, np.diff(bounds)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one array, and each text's number of bytes."""
        n = self.width[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.buffer[np.repeat(self.first[ids] - (ends - n), n) + np.arange(total, dtype=np.int32)]
        return out, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]])


_loaded: dict[str, TwoTierBpe] = {}


def load(ranks_path: str) -> TwoTierBpe:
    """The encoder for a vocabulary file, built once in each worker."""
    if ranks_path not in _loaded:
        _loaded[ranks_path] = TwoTierBpe(ranks_path)
    return _loaded[ranks_path]


def encode(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>), one for each row of df, whatever its other columns; a null text counts as empty, an empty one has no ids. Repeated rows stay."""

    def work(batch: pa.RecordBatch):
        bpe = load(ranks_path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in common.slices([len(t) for t in texts], 2 * common.SLICE_CHARS):
            ids, counts = bpe.encode_batch(texts[a:b])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return common.arrow_map(df.select(key, text), work, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """df's key and ids with a binary column decoded: the bytes that the ids stand for; null ids count as none. An id outside the vocabulary is an error."""

    def work(batch: pa.RecordBatch):
        bpe = load(ranks_path)
        column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        for a, b in common.slices(sizes.tolist(), common.SLICE_CHARS // 6):
            part = column[a:b]
            own, counts = bpe.decode_batch(part.flatten().to_numpy(zero_copy_only=False), sizes[a:b])
            ends = pa.py_buffer(np.r_[0, np.cumsum(counts)].astype(np.int32).tobytes())
            got = pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], part, got], [key, ids, "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return common.arrow_map(df.select(key, ids), work, f"`{key}` {kind}, `{ids}` array<int>, decoded binary")
