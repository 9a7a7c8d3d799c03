import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from granary.llm import packing, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_pieces_equal_the_tokenizer(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " ", "a <|endoftext|> b", "é" * 3000, "hello world " * 4000, "x" * 9000]
    texts += [" ".join(rng.choice(["the", "ein", "ñandú", "q" * 9, "\n\n"]) for _ in range(rng.randrange(1500))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, piece string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_packing(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(JSON)
    want = {}
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    total = sum(r.length for r in got)
    assert check(got, 2048) <= -(-total // 2048) + 2


def test_packing_is_dense_over_shards(spark):
    rng = random.Random(5)
    lengths = [(i, min(100, int(rng.expovariate(1 / 30)) + 1)) for i in range(1200)]
    frame = spark.createDataFrame(lengths, "item long, length long")
    got = packing.place(frame, capacity=100, shard_size=300).join(frame, "item").collect()
    assert sorted(r.item for r in got) == list(range(1200))
    assert check(got, 100) <= 1.01 * sum(n for _, n in lengths) / 100 + 1


def test_crossover_keeps_every_item_once_and_best_fit_fits_best():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    first = packing.Bins(sizes, 100)
    first.best_fit(sorted(range(200), key=lambda i: -sizes[i]))
    a = first.bins
    start = packing.Bins(sizes, 100)
    start.best_fit(list(range(200)))
    for bins in (a, start.bins, *(packing.crossover(a, start.bins, sizes, 100, rng) for _ in range(20))):
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    bins = packing.Bins([50, 70, 30, 20], 100)
    bins.best_fit([0, 1, 2, 3])
    assert bins.bins == [[0, 3], [1, 2]]
    fitted = packing.evolve([60, 40, 50, 50, 99], 100, 1, [], 3, 3)[1]
    assert len(fitted) == 3


def test_generations_gain_bins_over_best_fit():
    gained = 0
    for seed in range(8):
        rng = random.Random(seed)
        sizes = [rng.randrange(15, 60) for _ in range(240)]
        start = packing.Bins(sizes, 100)
        start.best_fit(sorted(range(240), key=lambda i: -sizes[i]))
        evolved = packing.evolve(sizes, 100, seed, [], 60, 6)[1]
        assert len(evolved) <= len(start.bins)
        gained += len(start.bins) - len(evolved)
    assert gained > 0


def test_empty_tables_null_keys_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.pack(spark.createDataFrame([], schema), JSON, ranks).count() == 0
    got = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], schema), JSON, ranks, keep_ids=True).collect()
    assert len(got) == 3 and check(got, 2048) == 1 and all(len(r.ids) == 4 * r.length for r in got)
