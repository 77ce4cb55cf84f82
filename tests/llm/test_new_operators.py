"""Toxicity, source divergence and clustered layout against plain Python, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, empty, frame, random_docs

from partloom.llm import divergence, layout, toxicity

SMALL = "/root/testdata/sf0.001"


# --- source divergence -----------------------------------------------------------------------


def plain_audit(rows, least, listed):
    docs = [(lang or "", source or "", [t for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        held = Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for _, s, _ in own}
        for _, s, ts in own:
            counts[s].update(t for t in ts if held[t] >= least)
        prob = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        total = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: prob(c[t], total[s]) for t in kept} for s, c in counts.items()}
        q = {t: prob(sum(c[t] for c in counts.values()), sum(total.values())) for t in kept}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted([(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s])
            terms = sorted([(-far(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]])[:listed]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(docs, least=10, listed=10):
    return sorted(tuple(r) for r in divergence.audit(docs, least, listed).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_plain_counting(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["Äpfel", "the", "THE", "ÉTÉ", "x9y", "a-b", "été", "日本", "zeta"] + [f"w{i}" for i in range(12)]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    rows = [(t, r.choice(["en", "de", None, ""]), r.choice(["a", "b", "Z", "é", None])) for t in texts] + [(None, "en", "only nulls"), ("rare", "xx", "alone"), ("rare", "yy", "p"), ("", "yy", "q")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for least, listed in ((10, 10), (1, 3)):
        assert audited(docs, least, listed) == plain_audit(rows, least, listed)


def test_audit_of_odd_tables(spark):
    assert audited(empty(spark)) == []
    docs = frame(spark)
    assert audited(docs, 1, 5) == plain_audit([(r.text, r.lang, r.source) for r in docs.collect()], 1, 5)


def test_probabilities_of_large_counts_are_exact(spark):
    n = [(c, t) for t in (1, 7, 10**9 + 7, 10**13 + 1) for c in (0, 1, t // 3, t - 1, t)]
    got = spark.createDataFrame(n, "c long, t long").select("c", "t", divergence.probability(divergence.F.col("c"), divergence.F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.t for r in got)


# --- clustered layout ------------------------------------------------------------------------


def plain_layout(rows, size):
    """rows: (doc_id, text, source, lang), all different doc_ids."""
    bytes_of = lambda s: None if s is None else s.encode()
    values = [
        [bytes_of(r[2]) for r in rows], [bytes_of(r[3]) for r in rows], [-1 if r[1] is None else len(r[1].encode()) for r in rows],
        [None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 365 for r in rows],
    ]
    spots = []
    for column in values:
        key = lambda v: (v is not None, v if v is not None else 0)
        ordered = sorted(column, key=key)
        first = {}
        for i, v in enumerate(ordered):
            first.setdefault(v, i)
        spots.append([8 * first[v] // len(rows) for v in column])
    cells = list(zip(*spots, strict=True))
    z = [sum(((c[v] >> b) & 1) << (4 * b + v) for b in range(3) for v in range(4)) for c in cells]
    order = sorted(range(len(rows)), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    file = {i: p // size for p, i in enumerate(order)}
    held = defaultdict(list)
    for i, f in file.items():
        held[f].append(cells[i])
    bounds = {f: [(min(c[v] for c in cs), max(c[v] for c in cs)) for v in range(4)] for f, cs in held.items()}
    out = []
    for p, i in enumerate(order):
        near = [(x, x) for x in cells[i][:2]] + [(x - 1, x + 1) for x in cells[i][2:]]
        inside = lambda c: all(a <= x <= b for x, (a, b) in zip(c, near, strict=True))  # noqa: B023, E731
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(bounds[f], near, strict=True)) for f in bounds)
        out.append((rows[i][0], z[i], p, file[i], touched, sum(any(map(inside, cs)) for cs in held.values()), ",".join(str(x) for b in bounds[file[i]] for x in b)))
    return out


COLUMNS = ("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


@pytest.mark.parametrize("size", [7, 60, 100_000])
def test_layout_equals_plain_counting(spark, size):
    r = random.Random(size)
    rows = [(i * 7 % 1009, None if r.random() < 0.02 else "é" * int(r.expovariate(0.02)), r.choice(["hot", "hot", "b", "Z", "é", None]), r.choice(["en", "en", "de", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(6)
    got = sorted(tuple(x) for x in layout.clustered(docs, size).select(*COLUMNS).collect())
    assert got == sorted(plain_layout(rows, size))


def test_layout_of_odd_tables(spark):
    assert layout.clustered(empty(spark)).count() == 0
    docs = frame(spark)
    found = layout.clustered(docs, 4).collect()
    assert sorted(x.position for x in found) == list(range(docs.count())) and all(x.files_touched >= x.files_matching >= 1 for x in found)
    one = layout.clustered(docs.where("doc_id = 7"), 2).collect()
    assert sorted((x.z, x.position, x.file, x.files_touched, x.files_matching, x.file_bounds) for x in one)[0][3:5] == (1, 1)
    same = spark.createDataFrame([(None, "t", "en", "s", 1)] * 50, "doc_id long, text string, lang string, source string, z int")
    assert sorted(x.position for x in layout.clustered(same, 9).collect()) == list(range(50))


def test_layout_does_not_depend_on_partitions(spark):
    docs = random_docs(spark, 300, seed=2).unionByName(random_docs(spark, 40, seed=2))
    a, b = ({tuple(x) for x in layout.clustered(docs.repartition(n), 50).collect()} for n in (2, 9))
    assert a == b


# --- toxicity --------------------------------------------------------------------------------


def _speech(n, seed):
    """Texts of invented words; toxic ones hold two or more insults, each spelled in its own way."""
    r = random.Random(seed)
    stock = ["".join(r.choice(["ta", "ne", "so", "li", "mur", "en", "ba"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    insults = ["blockhead", "dimwit", "nitwit"]
    out = []
    for i in range(n):
        words = [r.choice(stock) for _ in range(r.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(3):
                w = r.choice(insults)
                words.insert(r.randrange(len(words)), w + r.choice(["", "s", "y", "o"]))
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = _speech(800, 1)
    return toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])


def _score(model, text):
    return toxicity.highest(np.array([model.word(w) for w in toxicity.words_of(text)]), model.bias)


def test_unseen_texts_and_misspellings(model):
    rows = _speech(1200, 1)[800:]
    right = [(_score(model, t) >= toxicity.LEAST_SCORE) == bool(y) for _, t, y in rows]
    assert sum(right) >= 0.98 * len(right)
    plain = "ta neso limur enba sotali " * 6
    assert _score(model, plain) < 0.3 and _score(model, "") < 0.3
    for spelled in ("blockheadd", "dimwitz", "nitwitt", "xblockhead"):
        assert _score(model, plain + spelled) > _score(model, plain)
    assert _score(model, plain * 400 + " dimwit nitwits " + plain * 400) >= 0.3  # 24,000 words, two of them insults


def test_training_is_repeatable_and_needs_both_classes(model):
    again = toxicity.train([t for _, t, _ in _speech(800, 1)], [y for _, _, y in _speech(800, 1)])
    assert np.array_equal(model.value, again.value) and model.bias == again.bias
    assert toxicity.train(["a b"], [1]) is None and toxicity.train([], []) is None and toxicity.train(["", None], [0, 1]) is None


def test_scores_of_odd_tables(spark, model):
    docs = frame(spark)
    rows = toxicity.score(docs, model).collect()
    assert Counter(x.doc_id for x in rows) == Counter(x.doc_id for x in docs.collect())
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    assert {x.held_out for x in rows if x.doc_id is not None} == {True, False} and not any(x.held_out for x in rows if x.doc_id is None)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows if x.doc_id is not None)
    assert toxicity.score(empty(spark), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted, share = toxicity.fit(docs, labels)
    assert fitted is None and all(x.score == share for x in toxicity.score(docs, fitted, share).collect())


def test_held_out_labels_teach_nothing(spark):
    rows = _speech(400, 5)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (toxicity.fit(docs, x)[0] for x in (labels, turned))
    assert np.array_equal(a.value, b.value) and a.bias == b.bias


def test_registered_queries_over_the_smallest_tables(spark):
    from partloom.llm import queries

    ids = sorted(x.doc_id for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    for name in ("op11_subword_toxicity", "op13_clustered_layout"):
        assert sorted(x.doc_id for x in queries.queries()[name](spark, SMALL).collect()) == ids
    assert SCHEMA and set(queries.oracle_sql()) == {"op12_source_divergence", "op13_clustered_layout"}
