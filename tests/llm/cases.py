"""Documents with what operators must bear: nulls, empty and very long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, length int, spans string, class_id string, start int, ids string, node int, __salt int"


def words(n, seed, stock=400):
    r = random.Random(seed)
    return " ".join("w%d" % min(int(r.expovariate(1) * stock / 6), stock) for _ in range(n))


def rows():
    long_text = words(30_000, 5, 5000)
    base = words(200, 1)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \t\n ", "en", "a"),
        (3, base, "en", "a"),
        (4, base, "en", "b"),
        (5, " ".join(near), None, "b"),
        (6, long_text, "de", None),
        (7, "one two", "en", "c"),
        (7, "one two", "en", "c"),
        (7, "another text under the same id", "en", "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (8, words(300, 9), "fr", "c"),
        (9, "é😀 \x1c mixed spaces  twice\r\nlines", "fr", "a"),
    ]
    return [(i, t, lang, s, len(t or ""), 5, 6, "x", "y", 1, "z", 2, 3) for i, t, lang, s in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_docs(spark, n, seed=0, most=400):
    r = random.Random(seed)
    return spark.createDataFrame([(i, words(r.randint(0, most), seed * 1000 + i), "en", f"s{r.randint(0, 3)}", 0) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
