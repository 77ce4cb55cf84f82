"""Operators against plain versions of themselves, and in the cases that grow: hot keys, long texts, awkward lengths."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, empty, frame, random_docs, rows, words
from test_corpus_operators import copies, plain_classes
from test_text_operators import base_spans
from tokenizers import Tokenizer

from partloom.llm import counts, licenses, mixing, near_dups, packing, privacy, quality, rans
from partloom.llm.tokens import CachedEncoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


# --- packing ---------------------------------------------------------------------------------

@pytest.mark.parametrize("lengths", [[1500], [2100], list(range(2049, 2300)), [3000, 40]])
def test_packing_fills_awkward_lengths(spark, lengths):
    n = 10_000
    pieces = spark.createDataFrame([(i, 0, lengths[i % len(lengths)], "x", 1) for i in range(n)], "doc_id long, start long, length int, room string, used int").repartition(4)
    got = packing.pack(pieces).collect()
    total, by, parts = sum(lengths[i % len(lengths)] for i in range(n)), defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0 and (r.room, r.used) == ("x", 1)
        by[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.part, r.length))
    for at in (*by.values(), *parts.values()):  # gapless in the sequence, and in the piece
        end = 0
        for a, k in sorted(at):
            assert a == end
            end += k
        assert end <= 4096
    assert {i: sum(k for _, k in p) for i, p in parts.items()} == {i: lengths[i % len(lengths)] for i in range(n)}
    assert total / (4096 * len(by)) >= 0.97


def test_cut_documents_keep_every_id(spark):
    ids = Tokenizer.from_file(WORD)
    r = random.Random(4)
    docs = spark.createDataFrame([(i if i % 5 else None, words(r.randint(650, 900), i, 50)) for i in range(60)], "doc_id long, text string").repartition(3)
    got, want = packing.pack_documents(docs).collect(), Counter()
    for x in docs.collect():
        own = ids.encode(x.text, add_special_tokens=False).ids + [2]
        want[x.doc_id] += len(own)
    assert Counter({i: sum(r.length for r in got if r.doc_id == i) for i in want}) == want
    own = {x.doc_id: np.array(ids.encode(x.text, add_special_tokens=False).ids + [2], "<u4") for x in docs.collect()}
    cut = [r for r in got if r.length < r.doc_tokens and r.doc_id is not None]
    assert cut and all(r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got if r.doc_id is not None)


# --- tokens ----------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoder_equals_library_on_many_texts(path):
    own, library, r = CachedEncoder(path, capacity=5000), Tokenizer.from_file(path), random.Random(11)
    parts = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "\x1c", "\x85", "\xa0", "a", "The", " the", "'s", "'ll", "é", "ñ", "1", "23", "456", "<|endoftext|>", "<|startoftext|>", ".", ",", "..", "!", "?!", "Σ", "ΑΣ", "漢字", "😀", "\r\n", "don't", "İ", "ß", "under", "stand", "-", "_", "\x02", "\x03", "word.", "word,", "(x)", "https://a.b/c?d=e"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(60_000)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == e.ids, repr(text)


def test_counts_of_a_known_corpus_encode_nothing(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    docs = random_docs(spark, 60, seed=2, most=30)
    first = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, BYTE, cache).collect()}
    more = docs.unionByName(spark.createDataFrame([(900, "quite new", "en", "s", 0), (901, "quite new", "en", "s", 0)], docs.schema))
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(more, BYTE, cache).collect()}
    assert {i: got[i] for i in first} == first and got[900] == got[901] == 2
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == more.select("text").distinct().count()


def test_token_files_split_a_hot_doc_id(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 50}") for i in range(600)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    listed = rans.write_token_files(docs, BYTE, 0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert listed.count() >= 3  # two thirds of the rows have no id and still lie in several files
    got = rans.read_token_files(listed).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())


# --- licences --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return licenses.LicenseModel([words(12, i) for i in range(200)])


SAID = {
    "You may obtain a copy of the book at any store.": "none",
    "He lost his driver's license yesterday.": "none",
    "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 3.0.": "unknown",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 2.5 International License.": "unknown",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY 2.0.": "unknown",
    "Licensed under the Microsoft Public License.": "unknown",
    "Copyright 2019 Foo Inc. Released under the MIT License. See LICENSE.": "MIT",
    "This software is licensed under a proprietary license agreement.": "unknown",
}


def test_licences_near_misses(spark, model):
    docs = spark.createDataFrame([(i, f"some words\n{t}\nmore words") for i, t in enumerate(SAID)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan(docs, model).collect()}
    assert {t: got[i] for i, t in enumerate(SAID)} == SAID


def test_licence_scan_equals_plain_classifier(spark, model):
    r = random.Random(7)
    pool = [n for k in licenses.NOTICES for n in licenses.NOTICES[k]] + licenses.PROSE + [words(9, i) for i in range(20)]
    lines = []
    for _ in range(400):
        w = " ".join(r.sample(pool, r.choice([1, 1, 1, 2]))).split(" ")
        if r.random() < 0.5:
            w = [x for x in w if r.random() > 0.15]
        lines.append(" ".join(w))
    texts = ["\n".join(r.choice([*lines, "", "é 😀 licence"]) for _ in range(r.randint(1, 6))) for _ in range(150)]
    docs = spark.createDataFrame([(i % 90 or None, t) for i, t in enumerate(texts)] + [(7, None)], "doc_id long, text string").repartition(4)
    want, got = defaultdict(list), defaultdict(list)
    for x in docs.collect():
        own = [(i, *model.classify(p)) for i, p in enumerate((x.text or "").split("\n"))]
        want[x.doc_id].append([y for y in own if y[1] != "none"])
    for x in licenses.scan(docs, model).collect():
        got[x.doc_id].append([(y.paragraph, y.family, y.probability, y.similarity) for y in x.licences])
    names = lambda found: {i: sorted([y[:2] for y in one] for one in some) for i, some in found.items()}
    assert names(got) == names(want)
    flat = lambda found: sorted((str(i), *y) for i, some in found.items() for one in some for y in one)
    assert all(abs(a - b) < 1e-5 for x, y in zip(flat(got), flat(want)) for a, b in zip(x[3:], y[3:]))


def test_licence_model_on_what_it_has_not_seen(model):
    told = model.held_out
    assert told["strange_accepted"] < 0.02  # families that were left out as a whole
    learnt = [(f, k) for k, name in enumerate(model.classes[1:], 1) for n in licenses.NOTICES[name] for f in licenses._variants(n, 5)]
    right = defaultdict(list)
    for (_, k), p in zip(learnt, model.probabilities(learnt)):
        right[model.classes[k]].append(p.argmax() == k)
    assert all(np.mean(v) >= 0.6 for v in right.values()), {k: np.mean(v) for k, v in right.items()}


def test_licence_sample_keeps_no_notice_as_ordinary(spark):
    notice = licenses.NOTICES["MIT"][2]
    docs = spark.createDataFrame([(i, f"{words(15, i)}\n{notice}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    trained = licenses.LicenseModel(licenses.ordinary_paragraphs(docs))
    assert trained.classify(notice)[0] == "MIT"
    assert licenses.ordinary_paragraphs(empty(spark)) == []


# --- personal data ---------------------------------------------------------------------------

def plain_personal(texts, alpha=privacy.ALPHA, prior=privacy.PRIOR):
    """Spans of every text, terms by the pointwise mutual information of documents."""
    term = re.compile(r"[^\W_]+")
    spans = [base_spans(t) for t in texts]
    entities = [{(k, t[a:e]) for a, k, e in s} for t, s in zip(texts, spans)]
    lowered = [{w.lower() for w in term.findall(t)} for t in texts]
    rest = []
    for t, s in zip(texts, spans):
        c = list(t)
        for a, _, e in s:
            c[a:e] = " " * (e - a)
        rest.append("".join(c))
    left = [{w.lower() for w in term.findall(x)} if s else set() for x, s in zip(rest, spans)]
    n_entity, n_term, n_both = Counter(x for e in entities for x in e), Counter(w for ws in lowered for w in ws), Counter()
    for e, ws in zip(entities, left):
        n_both.update((x, w) for x in e for w in ws if len(w) >= 3 and re.search(r"[^\W\d_]", w))
    total = len(texts)
    flagged = set()
    for (x, w), n in n_both.items():
        share = n_entity[x] / total
        given = (n + prior * share) / (n_term[w] + prior)
        if math.log(given / share) >= math.log(1 / share) / alpha - 1e-9:
            flagged.add((x, w))
    out = []
    for t, s, e, r in zip(texts, spans, entities, rest):
        bad = {w for x, w in flagged if x in e}
        out.append(sorted(s + [(m.start(), 4, m.end()) for m in term.finditer(r) if m[0].lower() in bad]))
    return out


def test_personal_terms_against_plain_counts(spark):
    r = random.Random(9)
    names = ["Zanzibar", "Ottokar", "Ulrike", "quokka", "Nimrod"]
    mails = ["jo@ex.com", "a.b@c.de", "10.0.0.7", "+49 30 1234567"]
    texts = []
    for i in range(120):
        w = words(r.randint(5, 40), i, 60).split(" ")
        for j in range(len(mails)):
            if r.random() < 0.1:
                w.insert(r.randrange(len(w)), mails[j])
                if r.random() < 0.8:
                    w += [names[j], names[j].upper()]
        if r.random() < 0.05:
            w.append(names[4])
        texts.append(" ".join(w))
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans] for x in privacy.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want = plain_personal(texts)
    assert sum(k == 4 for s in want for _, k, _ in s) > 5
    assert [got[i] for i in range(len(texts))] == want


def test_personal_time_follows_the_number_of_matches(spark):
    def seconds(n):
        text = " ".join(f"u{i}@ex{i % 97}.com" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        clean = privacy.sanitise(docs).first().text
        assert clean == " ".join(["[EMAIL]"] * n)
        return time.time() - began

    seconds(100)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 10 * small + 10  # ten times the matches: about ten times what goes beyond the fixed cost


def test_redaction_equals_plain_cutting(spark):
    r = random.Random(3)
    parts = ["a b", "x@y.zz", "4111111111111111", "255.1.2.3", "+1 (017) 555-7713", " ", "é😀", "\n", "1.1.1.1@a.b", "+4111111111111111"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    found = privacy.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in docs.join(found, "doc_id").select("doc_id", "text", "spans", privacy.redacted(docs.text, found.spans).alias("out")).collect():
        out, at = "", 0
        for s in x.spans:
            if s.start >= at:
                out += x.text[at : s.start] + privacy.LABELS[s.kind]
            at = max(at, s.end)
        assert x.out == out + x.text[at:]


# --- near duplicates -------------------------------------------------------------------------

def test_registers_are_hit_alike():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    for m in (96, 3000):
        got = near_dups.bag_signatures(keys, np.ones(20_000, np.int64), np.zeros(20_000, np.int64), 1, m)
        assert np.isfinite(got).all() and abs(got.mean() * 20_000 * m / m - 1) < 0.2


def test_hot_buckets_and_byte_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT", 8)
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 20_000)
    texts = copies(150, 3, 80, 2) + copies(20, 4, 60, 2) + [words(n, 900 + n) for n in range(30)]
    pairs = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(spark.createDataFrame(pairs, "doc_id long, text string").repartition(4), rounds=1).collect()}
    assert got == plain_classes(pairs)


def test_recall_on_the_documents(spark):
    """Of all links that plain comparison finds among the smallest documents, the classes hold all."""
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicate_classes(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == plain_classes(pairs)


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    base = words(200, 1)
    docs = spark.createDataFrame([(7, base), (7, base), (7, base), (8, base), (9, base), (7, words(50, 2)), (None, base), (None, words(60, 3)), (None, words(60, 3))], "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in near_dups.keep_first(docs).collect()), key=str)
    assert kept == sorted([(7, base), (7, words(50, 2)), (None, words(60, 3))], key=str)


# --- mixing ----------------------------------------------------------------------------------

def test_rounding_is_fair_and_keeps_the_mass(spark):
    sized = [(i, "s", 1 + i % 9, 0.3 + (i % 7) / 5.0) for i in range(60)]
    df = spark.createDataFrame(sized, "doc_id long, source string, size long, expected double")
    runs = 60
    every = df.crossJoin(spark.range(runs).withColumnRenamed("id", "run")).selectExpr("doc_id + 1000 * run AS doc_id", "concat(source, run) AS source", "size", "expected")
    mean, mass = Counter(), Counter()
    for r in mixing.pivotal_copies(every, 5).collect():
        mean[r.doc_id % 1000] += r.copies / runs
        mass[r.source] += r.copies * r.size
    want = sum(k * e for _, _, k, e in sized)
    assert all(abs(m - want) <= 9 for m in mass.values())
    for i, _, _, e in sized:
        f = e % 1
        assert abs(mean[i] - e) <= 4.5 * math.sqrt(max(f * (1 - f), 0.01) / runs)


# --- pipeline --------------------------------------------------------------------------------

CLASH = ["row", "doc", "spans", "copies", "copy", "__doc", "__hash", "__spans", "__copies", "kept", "class_id", "text_hash", "piece", "sequence_id"]


def clashing(spark, some):
    schema = SCHEMA.replace("spans string, ", "").replace("class_id string, ", "") + "".join(f", {c} string" for c in CLASH)
    cut = [r[:7] + r[9:] for r in some]
    return spark.createDataFrame([(*r, *("z" for _ in CLASH)) for r in cut], schema).repartition(3)


def test_pipeline_stages_bear_all_cases(spark):
    import corpus_pipeline as P

    long_ones = [(None, words(300, 50 + i), "en", "a") for i in range(3)] + [(20, words(300, 60), "en", "b"), (20, words(300, 61), "en", "b")]
    more = [(i, t, lang, s, len(t), 5, 6, "x", "y", 1, "z", 2, 3) for i, t, lang, s in long_ones]
    docs, none = clashing(spark, rows() + more), clashing(spark, [])
    rated = {(r.doc_id, r.n_words): r.kept for r in quality.rate(docs).collect()}
    good = P.keep_good(spark, docs, "")
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in docs.collect() if rated[r.doc_id, len((r.text or "").split())])
    single = P.drop_near_duplicates(spark, docs, "")
    classes = plain_classes(list(enumerate(r.text for r in docs.collect())))
    assert single.columns == docs.columns and single.count() == len(set(classes.values()))
    safe = P.remove_personal_data(spark, docs, "")
    assert safe.columns == docs.columns and Counter(map(str, safe.collect())) == Counter(map(str, docs.collect()))
    sized = docs.where("text is not null")
    mixed = P.mix_sources(spark, docs, "")
    drawn, had = Counter((r.doc_id, r.text) for r in mixed.collect()), Counter((r.doc_id, r.text) for r in sized.collect())
    assert mixed.columns == docs.columns and all(n <= 2 * had[k] for k, n in drawn.items())
    packed = P.pack(spark, docs, "")
    assert Counter(r.doc_id for r in packed.collect() if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_mix_stage_draws_what_the_mix_takes(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(None if i < 20 else i, words(30, i % 10 if i < 20 else i), "en", f"s{i % 2}", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    taken = sum(r.copies * r.size for r in mixing.mix(docs).collect())
    got = P.mix_sources(spark, docs, "").collect()
    assert abs(sum(len(r.text.split()) for r in got) - taken) <= 120  # the last document of each source is rounded by chance


def test_stages_bear_the_common_cases(spark):
    import corpus_pipeline as P

    docs = frame(spark)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
