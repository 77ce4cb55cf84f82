"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into a fixed number of rows), a
window of words the mean of its words, and a linear softmax of two classes reads that mean.  Vectors
and softmax learn together.  A misspelling that training never saw shares n-grams with what it did
see, and so stands near it.  A document scores as its highest window does, so a long text is not
averaged clean; training selects windows in the same way.

Training takes a bounded sample of labelled texts (``SAMPLE`` different texts of at most
``SAMPLE_BYTES``); scoring covers every row and every word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, documents, written

#: Rows of embeddings; lengths of n-grams; dimensions.
ROWS, GRAMS, SIZE = 1 << 17, (3, 4, 5), 8
#: Words of a window; windows begin at every half of it.  Short ones are not averaged clean by what surrounds an insult.
WINDOW = 8
#: Different texts of label 0 and of label 1 that training takes, and the most bytes of a text among them.
SAMPLE, SAMPLE_BYTES = (2500, 1250), 1 << 14
#: Epochs of training, documents of a step, the first rate, and the constant that a mean is multiplied by.
EPOCHS, BATCH, RATE, GAIN = 16, 16, 0.7, 20.0
#: Epochs while there are few rows, and the most that a step may move the softmax.
MOST_EPOCHS, MOST_STEP = 60, 0.5
#: A row is predicted toxic from this score on.
LEAST_SCORE = 0.3
#: Words whose value a worker remembers.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Rows of the word itself and of its n-grams, ends marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % ROWS for g in {marked, *grams}]


def window_starts(n: int) -> range:
    """Where the windows of a text of n words begin; the last one may be short, but by no more than half."""
    return range(0, max(1, n - WINDOW // 2), WINDOW // 2)


@dataclass
class Model:
    """value: of each row of embeddings, its product with the difference of the softmax's two columns; bias: their biases' difference.

    The mean of a mean being linear, a window's log-odds are the mean of its words' values plus the bias.
    """

    value: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.value[subwords(word)].mean())


class _Words(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = self.model.word(word)
        return value


def highest(values: np.ndarray, bias: float) -> float:
    """Softmax of class 1 in the highest window; a text without words scores as a zero vector does."""
    mean = 0.0
    if len(values):
        sums = np.concatenate(([0.0], np.cumsum(values)))
        starts = np.array(window_starts(len(values)))
        ends = np.minimum(starts + WINDOW, len(values))
        mean = float(((sums[ends] - sums[starts]) / (ends - starts)).max())
    return float(1 / (1 + np.exp(-np.clip(mean + bias, -60, 60))))


def _gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at ``starts`` and have ``counts`` places, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model | None:
    """The model of the texts; None unless both classes have a text with words.

    Plain stochastic gradient descent, so n-grams that many documents of a class share move most.
    With c the difference of the softmax's columns, the gradient of a row of embeddings is a number
    times c, and only that number is summed over words.
    """
    number: dict[str, int] = {}
    bags, owner, taken = [], [], []
    for text, label in zip(texts, labels, strict=True):
        ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
        if len(ids):
            starts = window_starts(len(ids))
            bags += [ids[s : s + WINDOW] for s in starts]
            owner += [len(taken)] * len(starts)
            taken.append(label)
    if len(set(taken)) < 2:
        return None
    y = np.array(taken, dtype=np.float64)
    entry, sizes = np.concatenate(bags), np.array([len(b) for b in bags])
    at, first = np.cumsum(sizes) - sizes, np.flatnonzero(np.diff(np.array(owner), prepend=-1))
    last = np.append(first[1:], len(bags))
    # words x subwords; rows that no word has are left out
    lists = [np.array(subwords(w), np.int32) for w in number]
    counts = np.array([len(x) for x in lists])
    used, sub = np.unique(np.concatenate(lists), return_inverse=True)
    word_at = np.cumsum(counts) - counts

    r = np.random.default_rng(seed)
    vectors, softmax, bias = r.normal(0, 0.1, (len(used), SIZE)), r.normal(0, 1, (SIZE, 2)), np.zeros(2)
    epochs = min(MOST_EPOCHS, max(EPOCHS, EPOCHS * sum(SAMPLE) // len(y)))
    for epoch in range(epochs):
        c = softmax[:, 1] - softmax[:, 0]
        values = np.add.reduceat((vectors @ c)[sub], word_at) / counts
        odds = np.add.reduceat(values[entry], at) / sizes
        # the highest window of each document stands for it in this epoch
        chosen = np.array([a + int(np.argmax(odds[a:b])) for a, b in zip(first, last, strict=True)])
        rate = RATE * (1 - epoch / epochs)
        order = r.permutation(len(y))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            n = sizes[chosen[docs]]
            words, where = np.unique(entry[_gathered(at[chosen[docs]], n)], return_inverse=True)
            spots = sub[_gathered(word_at[words], counts[words])]
            rows, spot = np.unique(spots, return_inverse=True)
            of = np.cumsum(counts[words]) - counts[words]
            c = softmax[:, 1] - softmax[:, 0]
            own = vectors[rows]
            values = np.add.reduceat((own @ c)[spot], of) / counts[words]
            odds = GAIN * np.add.reduceat(values[where], np.cumsum(n) - n) / n + bias[1] - bias[0]
            wrong = (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - y[docs]) / len(docs)
            per_word = np.bincount(where, weights=np.repeat(GAIN * wrong / n, n), minlength=len(words)) / counts[words]
            per_row = np.bincount(spot, weights=np.repeat(per_word, counts[words]), minlength=len(rows))
            pooled = per_row @ own
            vectors[rows] = own - rate * (per_row[:, None] * c[None, :])
            pooled *= min(1.0, MOST_STEP / max(1e-12, rate * float(np.linalg.norm(pooled))))
            softmax -= rate * np.stack([-pooled, pooled], axis=1)
            # each step also holds a text without words, which is not toxic
            shift = wrong.sum() + 1 / (1 + np.exp(-np.clip(bias[1] - bias[0], -60, 60))) / len(docs)
            bias -= rate * np.array([-shift, shift])
    value = np.zeros(ROWS, np.float32)
    value[used] = GAIN * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return Model(value, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of training; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """A model of the labelled rows that are not held out, and the share of label 1 among those it takes.

    A doc_id, or a text, that is labelled both ways counts as 1; null labels and null ids teach
    nothing.  The different texts of least hash are taken, ``SAMPLE`` of each label: their hashes
    come to the driver first (those below a bound that leaves about half as many again), then
    these texts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    small = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & ~held_out(F.col("doc_id")))
    texts = small.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"))
    texts = written(texts.select("toxic", "h", F.pmod("h", F.lit(1 << 30)).alias("place")), "labelled-texts")
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, int] = {}
    for label, most in enumerate(SAMPLE):
        bound = (1 << 30) * (1.5 * most + 100) / max(1, sizes.get(label, 0))
        near = texts.where((F.col("toxic") == label) & (F.col("place") < bound)).select("place", "h").collect()
        chosen |= {h: label for _, h in sorted(tuple(r) for r in near)[:most]}
    wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "h long, toxic int")
    with bounded_batches(docs.sparkSession):
        found = small.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    found.sort(key=lambda r: r.h)
    return train([r.text for r in found], [r.toxic for r in found]), sum(r.toxic for r in found) / max(1, len(found))


def score(docs: DataFrame, model: Model | None, otherwise: float = 0.0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; columns of other names are ignored.

    Null and blank texts score as an average of no words (the bias alone).  Without a model every
    row scores ``otherwise``.  Equal texts score alike; repeated rows and ids stay rows of their own.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    kept = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt = kept.value
        words = _Words(learnt) if learnt else None

        def one(text: str | None) -> float:
            if words is None:
                return otherwise
            return highest(np.array(list(map(words.__getitem__, words_of(text))), dtype=np.float64), learnt.bias)

        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [one(t) for t in batch["text"]]})

    kind = dict(narrow.dtypes)["doc_id"]
    rated = narrow.mapInPandas(rate, f"doc_id {kind}, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op11_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over all documents."""
    docs = documents(spark, sf_dir)
    model, share = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, share)
