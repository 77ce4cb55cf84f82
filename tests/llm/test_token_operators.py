import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, random_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partloom.llm import counts, packing, rans
from partloom.llm.tokens import CachedEncoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoder_equals_library(path):
    own, ids, r = CachedEncoder(path, capacity=50), library(path), random.Random(1)
    parts = [" ", "  ", "\n", " \n", "a", "The", "'s", "é", "ñ", "é", "1", "23", "<|endoftext|>", "<|startoftext|>", "\t", "\x1c", "\x85", "\xa0", "!", "?!", " the", "Σ", "ΑΣ", "漢字", "😀", "\r\n", "don't", "İ"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert own.encode(text).tolist() == ids(text), repr(text)
    assert own.encode(None).tolist() == []


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_counts_over_edge_cases(spark):
    ids = library(BYTE)
    docs = frame(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids(r.text))) for r in docs.collect())
    assert Counter(rows_of(counts.count_tokens(docs, BYTE))) == want
    assert counts.count_tokens(empty(spark), BYTE).count() == 0


def test_counts_cache_is_used_and_appended(spark, tmp_path):
    cache, version = f"file://{tmp_path}/cache", counts.tokenizer_digest(BYTE)
    docs = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "a b")], "doc_id long, text string")
    counts.count_tokens(docs.where("doc_id = 1"), BYTE, cache).collect()
    # a stored count is believed, so it shows that nothing is encoded anew
    spark.createDataFrame([(version, "c d e", 99)], "tokenizer string, t string, n_tokens long").select("tokenizer", F.unhex(F.sha2("t", 256)).alias("digest"), "n_tokens").write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, BYTE, cache).collect()}
    assert got == {1: 2, 2: 99, 3: 2}
    assert spark.read.parquet(cache).count() == 2


@pytest.mark.parametrize("n", [0, 1, 63, 1000, 300_000])
@pytest.mark.parametrize("kinds", [1, 7, 50_000])
def test_rans_round_trip(n, kinds):
    ids = np.random.default_rng(n + kinds).zipf(1.3, n).clip(1, kinds).astype("<u4") - 1
    lengths = [n] if n else []
    data = rans.file_bytes(ids, [5] * len(lengths), lengths)
    reader = rans.Reader(lambda o, k: data[o : o + k])
    assert np.array_equal(reader.range(0, n), ids)
    if n > 10:
        assert np.array_equal(reader.range(n // 2, n // 3), ids[n // 2 : n // 2 + n // 3])


def test_rans_damage_is_found():
    ids = np.arange(5000, dtype="<u4") % 97
    data = bytearray(rans.file_bytes(ids, [1], [5000]))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        rans.Reader(lambda o, k: bytes(data[o : o + k])).range(0, 5000)


def test_token_files_against_library(spark, monkeypatch):
    ids = library(BYTE)
    docs = frame(spark)
    got = rows_of(rans.read_token_files(rans.write_token_files(docs, BYTE, 0)))
    ordered = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in ordered:
        own = ids(r.text) + [0]
        want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(((a, b, c, zlib.crc32(d)) for a, b, c, d in got), key=lambda x: x[1]) == want
    assert rans.read_token_files(rans.write_token_files(empty(spark), BYTE, 0)).count() == 0


def check_packing(rows, capacity):
    """rows: (key, start, length, sequence, offset); every sequence is gapless and within capacity."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[4], r[2]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_edge_cases(spark):
    ids = library(WORD)
    docs = frame(spark)
    got = packing.pack_documents(docs).collect()
    check_packing([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], 4096)
    want = Counter()
    for r in docs.collect():
        own = ids(r.text) + [2]
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            want[r.doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(own)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_wastes_little_and_keeps_columns(spark):
    r = random.Random(3)
    lengths = [r.randint(1, 100) for _ in range(3000)] + [25] * 2000 + [100] * 50
    pieces = spark.createDataFrame([(i, 0, n, "p", 1) for i, n in enumerate(lengths)], "doc_id long, start long, length int, offset string, more int")
    got = packing.pack(pieces, 100).collect()
    assert len(got) == len(lengths) and got[0].more == 1
    n = check_packing([(x.doc_id, x.start, x.length, x.sequence_id, x.offset) for x in got], 100)
    assert sum(lengths) / (n * 100) > 0.96
    assert {x.sequence_id for x in got} == set(range(n))


def best_fit(sizes, capacity):
    """Bins that best-fit decreasing needs."""
    rooms = []
    for s in sorted(sizes.tolist(), reverse=True):
        i = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - s)
    return len(rooms)


def test_patterns_cover_demand_exactly():
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 200, 25))
        demand = r.integers(1, 500, len(sizes)).astype(float)
        plan = packing.integral_plan(sizes, demand, 200)
        assert (sum(k * p for k, p in plan) == demand).all()
        assert all((p * sizes).sum() <= 200 for _, p in plan)
        assert sum(k for k, _ in plan) <= 1.02 * best_fit(np.repeat(sizes, demand.astype(int)), 200) + 3


def test_queries_return_the_contract_columns(spark):
    docs = random_docs(spark, 30)
    assert packing.pack_documents(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
