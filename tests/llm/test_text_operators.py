import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, random_docs, words
from pyspark.sql import functions as F

from partloom.llm import licenses, privacy, quality, scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(x):
    x = x or ""
    w = WORD.findall(x)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marks = [0] * len(w)
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            marks[k : k + 8] = [1] * 8
    lines = [s for s in x.split("\n") if WORD.search(s)]
    n = sum(marks)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def told(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_quality_base_rules(spark):
    docs = frame(spark)
    got = quality.rate(docs).collect()
    assert Counter((r.doc_id, *told(r)) for r in got) == Counter((r.doc_id, *base_rules(r.text)) for r in docs.collect())
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.rate(empty(spark)).count() == 0


def test_quality_repeats_and_symbols(spark):
    r = random.Random(2)
    texts = []
    for i in range(60):
        phrase = words(r.randint(5, 12), i)
        texts.append("\n".join(r.choice([phrase, words(12, i + 100), "# $ |<>", "", " \t"]) for _ in range(r.randint(1, 12))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    got = {x.doc_id: told(x) for x in quality.rate(docs).collect()}
    assert got == {i: base_rules(t) for i, t in enumerate(texts)}


def test_quality_distance_and_verdict(spark):
    clean = [(i, "The " + words(300, i).replace("w", "a") + ".", "en") for i in range(40)]
    junk = [(99, "### $$$ " * 200 + words(60, 77).replace("w", "%"), "en")]
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40)) and not got[99].kept
    a, b = [1.0, 3.0, 0.0], [2.0, 0.0, 5.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    p, q = [x / 4 for x in a], [x / 7 for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    want = math.sqrt(sum(x * math.log(x / z) for x, z in zip(p, m) if x) / 2 + sum(y * math.log(y / z) for y, z in zip(q, m) if y) / 2)
    assert abs(row.select(quality.distance(row.a, row.b).alias("d")).first().d - want) < 1e-12


KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(x):
    x, out = x or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_privacy_base_spans(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.zz", "%", ".", "..", "1", "23", "4111111111111111", "4111 1111-1111 1111", "255.1.2.3", "256.1.2.3", "0000001", "+1 (017) 555-7713", "+", "-", " ", "  ", "é", "😀", "\n", "(", ")"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += ["9" * 20000, "1 " * 20000, "a" * 20000, "a." * 20000 + "@b.c", "x@" + "a." * 9000 + "z", "1." * 20000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x for x in privacy.find_personal(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].spans if s.kind < 4] == base_spans(t), repr(t)[:200]


def test_privacy_edge_cases_and_rows(spark):
    docs = frame(spark)
    assert Counter(r.doc_id for r in privacy.find_personal(docs).collect()) == Counter(r.doc_id for r in docs.collect())
    clean = privacy.sanitise(docs)
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == Counter(map(tuple, docs.collect()))
    assert privacy.find_personal(empty(spark)).count() == 0


def test_privacy_terms_that_reveal(spark):
    rows = [(i, f"{words(30, i)} zanzibar{i} mail jo@ex.com today {words(30, i + 50)}".replace(f"zanzibar{i}", "zanzibar"), 0) for i in range(4)]
    rows += [(i, words(60, i) + " mail", 0) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clean = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert "jo@ex.com" not in clean[0].text and "zanzibar" not in clean[0].text and "[TERM]" in clean[0].text
    assert " mail " in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[12].text == rows[6][1]


def test_licences(spark):
    ordinary = [words(12, i) for i in range(200)]
    model = licenses.LicenseModel(ordinary)
    rows = [
        (1, "Intro\nReleased under the MIT License.\nmore"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, words(50, 3)),
        (6, None),
        (7, ""),
        (8, "Die Sache mit der Katze"),
        (9, "This software is licensed under a proprietary license agreement."),
        (1, "no licence here at all"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    family = sorted((r.doc_id, r.family) for r in got)
    assert family == sorted([(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (4, "CC-BY-NC-4.0"), (5, "none"), (6, "none"), (7, "none"), (8, "none"), (9, "unknown"), (1, "none")])
    held = [(f, k) for k, name in enumerate(model.classes[1:], 1) for n in licenses.NOTICES[name] for f in licenses._variants(n, 7)]
    right = (model.probabilities(held).argmax(axis=1) == [k for _, k in held]).mean()
    assert right > 0.85  # held-out variants of eleven classes
    assert licenses.scan(empty(spark), model).count() == 0
    edge = frame(spark)
    assert Counter(r.doc_id for r in licenses.scan(edge, model).collect()) == Counter(r.doc_id for r in edge.collect())


@pytest.mark.parametrize("size", [20, None])
def test_scoring_against_plain_counts(spark, size):
    """With a listed vocabulary, and with that of the query: words that five rows hold."""
    docs = random_docs(spark, 40, seed=6, most=60)
    rows = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in scoring.cross_entropy_difference(docs, labels, size).collect()}
    frequency = Counter(w for ws in rows.values() for w in ws)
    in_rows = Counter(w for ws in rows.values() for w in set(ws))
    vocab = [w for w, n in in_rows.items() if n >= scoring.LEAST_ROWS] if size is None else [w for w, _ in sorted(frequency.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]
    assert 0 < len(vocab) < len(frequency)
    numbers = {w: i for i, w in enumerate(vocab)}
    n = len(vocab)
    pairs = {i: list(zip([n + 1] + [numbers.get(w, n) for w in ws], [numbers.get(w, n) for w in ws])) for i, ws in rows.items()}

    def loss(own, others):
        c = Counter(p for i in others for p in pairs[i])
        before, now, total = Counter(), Counter(), sum(c.values())
        for (a, b), k in c.items():
            before[a] += k
            now[b] += k
        return [-math.log((c[p] + scoring.PRIOR * (now[p[1]] + 1) / (total + n + 1)) / (before[p[0]] + scoring.PRIOR)) for p in own]

    for i, ws in rows.items():
        good = [j for j in rows if j < 30 and j % 2 and j != i]
        want = [sum(x) / len(x) if x else 0.0 for x in (loss(pairs[i], good), loss(pairs[i], [j for j in rows if j != i]))]
        assert got[i].n_words == len(ws)
        assert abs(got[i].target_loss - want[0]) < 1e-9 and abs(got[i].background_loss - want[1]) < 1e-9
        assert abs(got[i].difference - (want[0] - want[1])) < 1e-9


def test_counts_as_bytes_come_back():
    for values in ([], [0], [254, 255, 256, 0, 1 << 40], [7] * 1000, [1 << 33] * 3):
        x = np.array(values, np.int64)
        assert scoring._recounted(scoring._counted(x)).tolist() == values


def test_scoring_edge_cases(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter(r.doc_id for r in scoring.cross_entropy_difference(docs, none).collect()) == Counter(r.doc_id for r in docs.collect())
    assert scoring.cross_entropy_difference(empty(spark), none).count() == 0


def test_scoring_knows_words_beyond_the_most_frequent(spark):
    common = [f"c{i}" for i in range(3000)]
    rows = [(i, " ".join(common), 0) for i in range(10)]
    rows += [(100 + i, f"c0 {'tundra' if i % 2 else 'savanna'} c1", 0) for i in range(12)]
    rows += [(200, "c0 tundra c1", 0), (201, "c0 savanna c1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(1, 12, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.difference for r in scoring.cross_entropy_difference(docs, labels).collect()}
    assert got[200] < got[201] - 0.1  # "tundra" and "savanna" come after 3,002 words more frequent or equal


def test_scoring_stores_few_batches_in_a_file(spark, monkeypatch):
    """Writers and readers of a file hold all its rows, and a batch is a row of several MB."""
    rows = [(i, words(i % 7, i)) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    want = sorted(scoring.cross_entropy_difference(docs, labels).collect())
    files, written = [], scoring.written

    def noted(df, name, *rest):
        table = written(df, name, *rest)
        if name == "batches":
            files.extend(r["count"] for r in table.groupBy(F.input_file_name()).count().collect())
        return table

    monkeypatch.setattr(scoring, "written", noted)
    monkeypatch.setattr(scoring, "_TOKENS", 1000)
    got = sorted(scoring.cross_entropy_difference(docs, labels).collect())
    assert sum(files) >= 10 and max(files) <= 2  # one task wrote them all
    assert len(got) == len(want) == 5000 and all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=0, atol=1e-9) for a, b in zip(got, want))


def test_scoring_a_batch_takes_little_memory(spark, monkeypatch):
    r = random.Random(4)
    texts = ["" if i % 9 == 0 else " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(1, 300))) for i in range(3000)]
    marked = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, target boolean").coalesce(1)
    (row,) = scoring.batches_of(marked, lambda h: h % 5 != 0).collect()
    batch = scoring._Batch(row.asDict())
    counts = [2 * c.astype(float) for c in batch.own_counts()]
    totals = int(counts[0][batch.n_pairs :].sum()), int(counts[1][batch.n_pairs :].sum())
    tracemalloc.start()
    got = batch.losses(counts, totals, 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(batch.times) > 300_000 and peak < 24 * len(batch.times)  # no three arrays of all its entries
    for entries in (1, 1 << 40):
        monkeypatch.setattr(scoring, "_ENTRIES", entries)
        assert all((a == b).all() for a, b in zip(got, batch.losses(counts, totals, 2000)))


def test_privacy_judges_entities_of_one_context(spark):
    rows = [(0, f"{words(60, 1)} zanzibar wrote one@ex.com mail {words(60, 2)}", 0)]
    rows += [(i, words(60, i) + " wrote mail", 0) for i in range(10, 310)]
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert "zanzibar" not in clean[0] and " wrote " in clean[0] and " mail " in clean[0]


def test_privacy_terms_far_away_and_repeated(spark):
    rows = [(i, f"Zanzibar {words(80, i)} mail jo@ex.com today {words(80, i + 50)} (ZANZIBAR) zanzibars", 0) for i in range(4)]
    rows += [(i, words(60, i) + " mail", 0) for i in range(10, 300)]
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    for i in range(4):
        assert clean[i].startswith("[TERM] ") and "([TERM])" in clean[i] and " mail " in clean[i]
    assert clean[12] == rows[6][1]


def test_quality_has_a_reference_for_every_language(spark):
    rows = [(i, words(40, i), f"l{i:03}") for i in range(260)]
    rows += [(1000, "aa bb cc dd", "zz"), (1001, "ee ff gg hh", "zz")]
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 262 and got[1000].common_distance > 0.1 and got[1001].common_distance > 0.1
