"""The registered queries over the smallest tables, against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from test_text_operators import KINDS, base_rules, base_spans
from tokenizers import Tokenizer

from partloom.llm import queries
from partloom.llm.tokens import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SMALL).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, texts):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = run(spark, "op1_cutting_stock_packing")
    own = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    covered = {i: 0 for i in texts}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert covered[r.doc_id] == r.start and r.doc_tokens == len(own[r.doc_id])
        assert r.ids_crc32 == crc(own[r.doc_id][r.start : r.start + r.length])
        covered[r.doc_id] += r.length
    assert all(covered[i] == len(own[i]) for i in texts)


def test_media(spark, texts):
    for r in run(spark, "op4_png_media"):
        data = texts[r.doc_id].encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and len(r.feature) == 16


def test_token_files_and_counts(spark, texts):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    files, counts, start = {r.doc_id: r for r in run(spark, "op6_rans_token_files")}, {r.doc_id: r for r in run(spark, "op9_digest_cache_counts")}, 0
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(texts[i].encode()), len(ids), len(ids) > 1024)
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids) + 1, crc([*ids, 0]))
        start += len(ids) + 1


def test_quality_and_privacy(spark, texts):
    good = {r.doc_id: r for r in run(spark, "op3_divergence_quality")}
    private = {r.doc_id: r for r in run(spark, "op8_disclosure_sanitisation")}
    for i, t in texts.items():
        r, p = good[i], private[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t)
        spans = base_spans(t)
        told = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)
        assert p.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [p.n_email, p.n_ip, p.n_card, p.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert [s for s in p.spans.split(",") if s and not s.startswith("term:")] == [s for s in told.split(",") if s]


@pytest.mark.parametrize("name", ["op2_license_paragraphs", "op5_cross_entropy_difference", "op7_pivotal_mixing", "op10_bagminhash_dedup"])
def test_one_row_for_each_document(spark, texts, name):
    assert sorted(r.doc_id for r in run(spark, name)) == sorted(texts)
