"""Cross-entropy difference: matched target and background bigram models score each document.

Both models share the vocabulary, the smoothing and the order.  The vocabulary grows with the data:
it has every word that at least LEAST_ROWS rows hold; only rarer ones are one unknown word, and a
text begins after a boundary.  Target counts come from the documents whose label marks good quality,
background counts from all documents.  A document's own counts are taken out of both models while it
is scored, so texts that were counted as target have no advantage over others.

Words are 64-bit hashes.  Rows are worked on in batches of about _TOKENS words.  A batch asks for
the corpus counts of its distinct bigrams, contexts and words, each once, and brings its own counts
along: they are dealt by hash, added up, and sent back in the order of the question.  So a bigram
that every document holds comes once from each batch, what is gathered grows with the input, and a
worker holds one batch, one share of the counts, and a bitmap of fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written

#: Rows that hold a word of the vocabulary, at least.
LEAST_ROWS = 5
#: Rows are counted by slots of words, 2^SLOT_BITS: a word that shares its slot may be known with fewer rows, never the reverse.
SLOT_BITS = 26
#: Weight of the unigram distribution in each context, in words.
PRIOR = 256.0
#: Target doc_ids, at most, that are sent to all workers (some 32 MB of them), so that texts stay where they are.
SENT = 1 << 22
#: Keys whose counts are added up in one group, about.
SHARE = 1 << 20
UNKNOWN, BOUNDARY = -2, -1
_DISTINCT = 200_000  # words that a task counts before it hands them on
_TOKENS = 1_000_000
_TEXTS = 500  # texts that are hashed together
_ENTRIES = 100_000  # bigrams of rows that are scored together
_IN_FILE = 2  # batches in a file: readers and writers hold whole files of such long rows


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _hashed(words: list[bytes]) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def _texts(column) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and word hashes of each text, for runs of texts of an Arrow column."""
    for i in range(0, len(column), _TEXTS):
        split = [_words(t) for t in column.slice(i, _TEXTS).to_pylist()]
        ends = np.cumsum([len(s) for s in split])
        yield i, np.split(_hashed([w for s in split for w in s]), ends[:-1])


def vocabulary(docs: DataFrame, size: int) -> list[bytes]:
    """The most frequent words of all documents, ties by the words themselves."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(seen: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_words(text))
                if len(seen) >= _DISTINCT:
                    yield told(seen)
                    seen = Counter()
        if seen:
            yield told(seen)

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


_COUNTS = ("n_rows", "n_all", "n_target")


def word_counts(marked: DataFrame) -> DataFrame:
    """word, rows that hold it, and its occurrences in all and in target texts, of rows of (text, target)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []
        waiting = 0

        def told():
            rows = np.concatenate(held, axis=1)
            held.clear()
            words, at = np.unique(rows[0], return_inverse=True)
            sums = [np.bincount(at, weights=r, minlength=len(words)).astype(np.int64) for r in rows[1:]]
            return pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, sums)], ["word", *_COUNTS])

        for batch in batches:
            targets = np.array(batch.column(1).to_pylist(), np.int64)
            for first, texts in _texts(batch.column(0)):
                lengths = np.array([len(h) for h in texts])
                if not lengths.sum():
                    continue
                words, at = np.unique(np.concatenate(texts), return_inverse=True)
                pairs, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(words) + at, return_counts=True)
                row, word = pairs // len(words), pairs % len(words)
                sums = [np.bincount(word, w, len(words)).astype(np.int64) for w in (np.ones(len(n)), n, n * targets[first + row])]
                held.append(np.stack([words, *sums]))
                waiting += len(words)
                if waiting >= _TOKENS:
                    yield told()
                    waiting = 0
        if held:
            yield told()

    counted = marked.select("text", "target").mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _known_slots(words: DataFrame) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """``words`` with ``known``, and the same as a function of hashes that holds a bitmap of fixed size."""
    slot = F.col("word").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    slots = written(words.groupBy(slot.alias("slot")).agg(F.sum("n_rows").alias("n")).where(F.col("n") >= LEAST_ROWS).select("slot"), "word-slots")
    bits = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    packed = slots.groupBy(F.shiftright("slot", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    for r in packed.collect():  # 4 KB for each of 2^SLOT_BITS / 32,768 places
        bits[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = words.sparkSession.sparkContext.broadcast(bits)

    def known(h: np.ndarray) -> np.ndarray:
        at = h & ((1 << SLOT_BITS) - 1)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return words.withColumn("slot", slot).join(slots.withColumn("known", F.lit(True)), "slot", "left"), known


def _known_listed(words: DataFrame, listed: list[bytes]) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """As ``_known_slots``, for the vocabulary ``listed``."""
    hashes = _hashed(listed)
    table = words.sparkSession.createDataFrame([(int(h), True) for h in hashes], "word long, known boolean")
    return words.join(table, "word", "left"), lambda h: np.isin(h, hashes)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _ints(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each in as few bytes as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 3, 4, 8) if int(values.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _read(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").reshape(-1)


def _counted(values: np.ndarray) -> bytes:
    """Whole numbers of which most are small: a byte each, 255 for those that follow in full, after how many there are."""
    large = values >= 255
    return int(len(values)).to_bytes(8, "little") + np.where(large, 255, values).astype(np.uint8).tobytes() + _ints(values[large])


def _recounted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = _read(data[8 + n :])
    return out


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending whole numbers as their steps."""
    return _ints(np.diff(ascending, prepend=0))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_read(data))


_BATCH = "batch long, n_keys long, doc_ids array<long>, targets binary, lengths binary, words binary, pairs binary, entries binary, times binary"


def batches_of(marked: DataFrame, known: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Batches of the rows (doc_id, text, target): whose rows, how many words each has, the batch's distinct
    words, its distinct bigrams (place of the first word * words + place of the second), and for each row the
    distinct bigrams (row * bigrams + place) and how often it has them."""
    names = [c.split(" ")[0] for c in _BATCH.split(", ")]

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = TaskContext.get().partitionId() << 33
        doc_ids, targets, held, waiting = [], [], [], 0

        def told():
            lengths = np.array([len(h) for h in held], np.int64)
            now = np.concatenate(held)
            now = np.where(known(now), now, UNKNOWN)
            starts = (np.cumsum(lengths) - lengths)[lengths > 0]
            words, at = np.unique(np.concatenate([now, [BOUNDARY]]), return_inverse=True)
            first = np.concatenate([[0], at[:-2]]) if len(now) else at[:0]
            first[starts] = at[-1]
            pairs, place = np.unique(first * len(words) + at[:-1], return_inverse=True)
            entries, times = np.unique(np.repeat(np.arange(len(held)), lengths) * max(1, len(pairs)) + place, return_counts=True)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6)
            values = (
                number, len(pairs) + len(words), doc_ids, np.array(targets, bool).tobytes(), lengths.astype("<u4").tobytes(), words.astype("<i8").tobytes(),
                _packed(pairs), _packed(entries), _ints(times),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                doc_ids += batch.column(0).slice(first, len(texts)).to_pylist()
                targets += batch.column(2).slice(first, len(texts)).to_pylist()
                held += texts
                waiting += sum(map(len, texts))
                if waiting >= _TOKENS or len(held) >= _TOKENS // 50:
                    yield told()
                    doc_ids, targets, held, waiting = [], [], [], 0
                    number += 1
        if held:
            yield told()

    return marked.select("doc_id", "text", "target").mapInArrow(gather, _BATCH)


class _Batch:
    """What a row of ``batches_of`` holds; keys are those of its bigrams and of its words."""

    def __init__(self, row: dict):
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.target = np.frombuffer(row["targets"], bool)
        words = np.frombuffer(row["words"], "<i8")
        pairs, entries = _unpacked(row["pairs"]), _unpacked(row["entries"])
        self.n_words, self.n_pairs = len(words), len(pairs)
        self.first, self.second = pairs // max(1, len(words)), pairs % max(1, len(words))
        self.doc, self.pair = entries // max(1, len(pairs)), entries % max(1, len(pairs))
        self.times = _read(row["times"])
        own = _hash(words.astype(np.int64).view(np.uint64))
        self.keys = np.concatenate([_hash(own[self.first] * _MIX[0] + own[self.second]), _hash(own ^ _MIX[1])])

    def dealt(self, shares: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of keys by share, and where each share ends."""
        share = (self.keys >> np.uint64(32)).astype(np.int64) * shares >> 32
        return np.argsort(share, kind="stable"), np.cumsum(np.bincount(share, minlength=shares))

    def own_counts(self) -> list[np.ndarray]:
        """Of each key the counts in all and in target rows, then those as a context, which bigrams have none of."""
        out, contexts = [], []
        for weights in (self.times, self.times * self.target[self.doc]):
            pairs = np.bincount(self.pair, weights, self.n_pairs)
            out.append(np.concatenate([pairs, np.bincount(self.second, pairs, self.n_words)]).astype(np.int64))
            contexts.append(np.concatenate([np.zeros(self.n_pairs), np.bincount(self.first, pairs, self.n_words)]).astype(np.int64))
        return out + contexts

    def losses(self, counts: list[np.ndarray], totals: tuple[int, int], n: int) -> list[np.ndarray]:
        """Background and target loss of each row, from the corpus counts of the keys; its own counts are taken out.

        Rows are scored in runs of about _ENTRIES entries, as each of the many steps makes a new array of them.
        """
        starts = np.searchsorted(self.doc, np.arange(len(self.lengths) + 1))
        out, first = [np.zeros(len(self.lengths)) for _ in totals], 0
        while first < len(self.lengths):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + _ENTRIES, "right")) - 1)
            for sums, told in zip(out, self._losses(first, last, slice(starts[first], starts[last]), counts, totals, n)):
                sums[first:last] = told
            first = last
        return out

    def _losses(self, first: int, last: int, own: slice, counts: list[np.ndarray], totals: tuple[int, int], n: int) -> Iterator[np.ndarray]:
        """``losses`` of the rows from ``first`` to ``last``, whose entries are ``own``."""
        p, pair, times, doc = self.n_pairs, self.pair[own], self.times[own], self.doc[own]
        a, b, row = self.first[pair], self.second[pair], doc - first

        def within(word: np.ndarray) -> np.ndarray:
            """How often the entry's row has the entry's word."""
            _, at = np.unique(row * self.n_words + word, return_inverse=True)
            return np.bincount(at, times)[at]

        own_a, own_b = (within(x) if len(x) else np.zeros(0) for x in (a, b))
        for count, as_context, total, gone in zip(counts[:2], counts[2:], totals, (np.ones(len(self.target), bool), self.target)):
            less = gone[doc]
            unigram = (count[p:][b] - own_b * less + 1) / (total + n + 1 - self.lengths[doc] * less)
            context, both = as_context[p:][a] - own_a * less, count[:p][pair] - times * less
            yield np.bincount(row, times * (np.log(context + PRIOR) - np.log(both + PRIOR * unigram)), last - first)


#: Of a key, its counts in all and in target rows, and those as a context.
_SUMS = ("n_all", "n_target", "c_all", "c_target")


def corpus_counts(batches: DataFrame, shares: int) -> DataFrame:
    """batch, share, and as binary the sums _SUMS: the corpus counts of the keys of a batch that fall in a share, in the batch's order."""

    def ask(rows: Iterator) -> Iterator:
        import pyarrow as pa

        def asked(row: dict):
            held = _Batch(row)
            order, ends = held.dealt(shares)
            columns = [held.keys, *held.own_counts()]
            del held
            starts = np.concatenate([[0], ends[:-1]])
            full = np.flatnonzero(ends > starts)
            cut = [pa.array([put(c[order[starts[i] : ends[i]]]) for i in full], pa.binary()) for c, put in zip(columns, (np.ndarray.tobytes, *[_counted] * 4))]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["batch"]] * len(full), pa.int64()), *cut], ["share", "batch", "keys", *_SUMS])

        for part in rows:
            for i in range(part.num_rows):  # nothing of a row is kept when the next comes
                yield asked(part.slice(i, 1).to_pylist()[0])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        lengths = np.array([len(k) // 8 for k in group["keys"]])
        _, at = np.unique(np.frombuffer(b"".join(group["keys"]), "<u8"), return_inverse=True)
        out = {"batch": group["batch"], "share": group["share"]}
        for c in _SUMS:
            sums = np.bincount(at, np.concatenate([_recounted(x) for x in group[c]]))[at].astype(np.int64)
            out[c] = [_counted(x) for x in np.split(sums, np.cumsum(lengths)[:-1])]
        return pd.DataFrame(out)

    sums = ", ".join(f"{c} binary" for c in _SUMS)
    asked = batches.mapInArrow(ask, f"share int, batch long, keys binary, {sums}")
    return asked.groupBy("share").applyInPandas(answer, f"batch long, share int, {sums}")


def _scored(batches: DataFrame, answers: DataFrame, shares: int, totals: tuple[int, int], n: int) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (sums) of every row."""

    def score(batch, answer):
        import pyarrow as pa

        (row,) = batch.to_pylist()
        held = _Batch(row)
        order, _ = held.dealt(shares)
        by_share = np.argsort(answer["share"].to_numpy())
        counts = []
        for c in _SUMS:
            told, count = answer[c].to_pylist(), np.zeros(len(held.keys))
            if told:
                count[order] = np.concatenate([_recounted(told[i]) for i in by_share])
            counts.append(count)
        background, target = held.losses(counts, totals, n)
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(held.lengths), pa.array(target), pa.array(background)], ["doc_id", "n_words", "target_loss", "background_loss"])

    both = batches.groupBy("batch").cogroup(answers.groupBy("batch"))
    return both.applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, difference of every row of ``docs``.

    Losses are means per word in nats; difference = target_loss - background_loss, so a low one
    means a text more like the target.  Target: doc_ids whose label ``quality`` is 1 in any row.
    Texts without words (null ones too) have losses 0.  Without any target document the target
    model is uniform over words.  ``size``: only so many most frequent words are known.  Repeated
    rows come out as often as they went in and leave the counts one by one; null ids stay null and
    are never targets; an empty table gives no rows; other columns are ignored.
    """
    good = written(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "targets").withColumn("target", F.lit(True))
    if good.count() <= SENT:  # else both sides are dealt by doc_id, texts too
        good = F.broadcast(good)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = texts.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = written(word_counts(marked), "word-counts")
    told, known = _known_slots(counted) if size is None else _known_listed(counted, vocabulary(docs, size))
    sizes = told.agg(F.count_if("known").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS[1:]]).first()
    dropped(counted)
    batches = written(batches_of(marked, known), "batches", _IN_FILE)
    shares = max(1, -(-(batches.agg(F.sum("n_keys")).first()[0] or 0) // SHARE))
    answers = written(corpus_counts(batches, shares), "corpus-counts")
    scored = written(_scored(batches, answers, shares, (sizes["n_all"], sizes["n_target"]), sizes["n"]), "scored")
    for table in (batches, answers):
        dropped(table)
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0)).alias(c)
    return scored.select("doc_id", "n_words", mean("target_loss"), mean("background_loss")).withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op5_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    """Losses of all documents under the model of good ones and that of all."""
    from .store import documents

    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
