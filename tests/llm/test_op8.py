import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from granary.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello  world\n\n\n x", "the the the", "x" * 5000, "ab" * 3000 + " é", "²³ ½ 12٣ ǅ ʰ", "\x1c\x1d tab\t\tend  ", "emoji 👩‍👩‍👧 Ω≈ç", "<|endoftext|>", "don't I'LL we've", "　 wide nbsp"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library_and_goes_round(spark, tmp_path):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é\n'.1²x\t the") for _ in range(rng.randrange(200))) for _ in range(200)] + ["again", "again"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, str(tmp_path)).collect()}
    own = library()
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_byte_bpe(spark, str(tmp_path)).count() == 0


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 10, 1000):
        keys = [str(i).encode() for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert h.lookup(keys) == list(range(n)) and sorted(h.slot_key) == list(range(n))


def test_repeated_rows_and_null_keys_stay(spark):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(rows, ranks), ranks).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == [(0, b""), (0, b"a b"), (1, b"a b"), (1, b"a b"), (1, b"c")]
