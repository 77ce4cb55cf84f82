"""Packing documents into fixed-length sequences by cutting-stock column generation.

Pieces of the full length fill a sequence alone.  All other pieces fall into some hundred length
classes, chosen from the length histogram, which has no more rows than a sequence has places.
The pieces of each class are the demand of a cutting-stock problem: a linear program over patterns (how many
pieces of each class share a sequence) is solved on the driver, with new patterns priced by a
knapsack dynamic program over the dual values; the solution is rounded down, the rest filled
greedily, and every piece finds its pattern and slot through its rank within its class.  Ranks
come from counts per class and hash bucket, so a class that holds a third of all pieces is spread
over many tasks.

Where patterns of whole pieces leave room, as with many pieces of one awkward length, the worst
filled sequences are taken apart: their pieces, end to end, are one line of ids, the rooms of all
other sequences are another one of the same places, and each room gets the part of the first line
that lies at its place.  So a piece is cut only where a room ends, and no id is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import before, likely, written
from .tokens import encoder, slices, tokenizer_path

CAPACITY = 4096
#: Places that a sequence must have left to be filled with parts of cut pieces.
LEAST_ROOM = 64
_END = (1 << 63) - 1
#: Length classes of the linear program.
CLASSES = 112


def class_bounds(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Greatest length of each class, ascending, for ``counts[n]`` pieces of length n.

    Rounding lengths up to these bounds wastes least where the classes are as dense as the root of
    the counts; each bound is a length that is present.
    """
    present = np.flatnonzero(counts)
    if len(present) <= classes:
        return present
    # a gap between present lengths costs as much as its width
    weight = np.sqrt(counts[present] * np.diff(present, prepend=0))
    share = np.cumsum(weight) / weight.sum()
    last = np.searchsorted(share, np.arange(1, classes + 1) / classes - 1e-12)
    return present[np.unique(np.minimum(last, len(present) - 1))]


class Knapsack:
    """Unbounded knapsack by dynamic programming: the most value of pieces within each capacity."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, capacity: int):
        self.sizes, self.values, self.capacity = sizes, values, capacity
        use = np.flatnonzero(values > 1e-12)
        s, v = sizes[use], values[use]
        upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if k := upto[c]:
                got = best[c - s[:k]] + v[:k]
                i = got.argmax()
                if got[i] > best[c] + 1e-15:
                    best[c], choice[c] = got[i], use[i]
        self.best, self.choice = best, choice

    def with_class(self) -> np.ndarray:
        """Value of the best pattern that holds each class at least once."""
        return self.values + self.best[self.capacity - self.sizes]

    def pattern(self, first: int) -> np.ndarray:
        counts, c = np.zeros(len(self.sizes), np.int64), self.capacity - int(self.sizes[first])
        counts[first] = 1
        while c > 0:
            if self.choice[c] < 0:
                c -= 1
            else:
                counts[self.choice[c]] += 1
                c -= int(self.sizes[self.choice[c]])
        return counts


def _sharpened(inverse: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A Newton step towards the inverse, against rounding errors; einsum starts no threads of its own."""
    return 2 * inverse - np.einsum("ij,jk->ik", np.einsum("ij,jk->ik", inverse, matrix), inverse)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the linear program uses each.

    ``sizes`` ascend; ``demand`` is positive.  One pricing gives the best pattern that holds each
    class, and all that still lower the cost come in, best first.  Ends when the value is within
    ``gap`` of the lower bound that the knapsack value gives, or after ``rounds`` pricings; either
    way the solution covers the demand exactly.
    """
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = demand * np.diag(inverse)
    anchor, pull, bound = sizes / capacity, 0.95, (demand * sizes).sum() / capacity
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        if x.sum() <= bound * (1 + gap):
            break
        # duals pulled towards the sizes, which are near the optimal ones where pieces fit well
        priced = Knapsack(sizes, pull * anchor + (1 - pull) * duals, capacity)
        bound = max(bound, (demand * (pull * anchor + (1 - pull) * duals)).sum() / priced.best[capacity])
        found = 0
        for i in np.argsort(-(duals / anchor), kind="stable"):
            pattern = priced.pattern(i)
            if (inverse.sum(axis=0) * pattern).sum() <= 1 + 1e-6:
                continue
            found += 1
            direction = (inverse * pattern).sum(axis=1)
            up = direction > 1e-6
            ratios = np.where(up, x / np.where(up, direction, 1), np.inf)
            least = ratios.min()
            out = int(np.where(ratios <= least + 1e-9, direction, 0).argmax())  # of equal ratios the stablest pivot
            step = ratios[out]
            x = np.maximum(x - step * direction, 0)
            x[out] = step
            patterns[:, out] = pattern
            pivot = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, pivot)
            inverse[out] = pivot
        inverse = _sharpened(inverse, patterns)
        x = np.maximum((inverse * demand).sum(axis=1), 0)
        if not found:
            if pull == 0:
                break
            pull = pull / 2 if pull > 0.02 else 0.0
    return patterns.T.round().astype(np.int64), x


def integral_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that use exactly ``demand``: rounded down, then the rest best-fit decreasing."""
    patterns, x = solve_patterns(sizes, demand, capacity)
    plan, rest = [], demand.astype(np.int64).copy()
    for p, k in zip(patterns, np.floor(x + 1e-6).astype(np.int64)):
        if p.any():
            k = int(min(k, (rest[p > 0] // p[p > 0]).min()))
            if k > 0:
                plan.append((k, p.copy()))
                rest -= k * p
    order = np.argsort(-(x - np.floor(x)), kind="stable")
    for i in order:  # then each pattern once more, as far as pieces are left for a well-filled one
        p = np.minimum(patterns[i], rest)
        if p.any() and (p * sizes).sum() >= 0.98 * capacity:
            plan.append((1, p))
            rest = rest - p
    while rest.any():
        p, room = np.zeros_like(rest), capacity
        for i in range(len(sizes) - 1, -1, -1):
            k = int(min(rest[i], room // sizes[i]))
            p[i] += k
            room -= k * int(sizes[i])
        k = int((rest[p > 0] // p[p > 0]).min())
        plan.append((k, p))
        rest = rest - k * p
    return plan


def _lookup(plan: list[tuple[int, np.ndarray]], n: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """For each class: rank at which a run of sequences begins, pieces per sequence, first sequence, first slot."""
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    used, sequence = np.zeros(n, np.int64), 0
    for times, pattern in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            runs[i].append((int(used[i]), int(pattern[i]), sequence, slot))
            used[i] += times * pattern[i]
            slot += int(pattern[i])
        sequence += times
    return [tuple(np.array(c, np.int64) for c in zip(*r)) if r else () for r in runs], sequence


def _place(pieces: DataFrame, capacity: int, key: tuple[str, ...]) -> DataFrame:
    """``pieces`` (lengths of 1 to ``capacity``) with sequence_id and offset, none of them cut."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    n = int(histogram.sum())
    histogram[capacity] = 0
    bounds = class_bounds(histogram)
    if len(bounds):
        edges = np.concatenate([[0], np.cumsum(histogram)[bounds]])
        plan = integral_plan(bounds, np.diff(edges).astype(float), capacity)
        table, sequences = _lookup(plan, len(bounds))
    else:
        table, sequences = [], 0
    spark = pieces.sparkSession
    # one row for each length at most, and one for each run of sequences of a pattern: few whatever the input
    lengths = np.flatnonzero(histogram)
    kinds = [(int(x), int(k)) for x, k in zip(lengths, np.searchsorted(bounds, lengths))] + [(capacity, len(bounds))]
    runs = [(k, *map(int, r)) for k, t in enumerate(table) for r in zip(t[0], np.append(t[0][1:], _END), *t[1:])]
    runs.append((len(bounds), 0, _END, 1, sequences, 0))  # full pieces are a class of their own
    kinds = spark.createDataFrame(kinds, "length long, __class int")
    runs = spark.createDataFrame(runs, "__class int, __begin long, __end long, __each long, __first long, __lead long")
    marked = pieces.join(F.broadcast(kinds), "length")
    buckets = max(1, n // 2000)
    # whole keys and lengths are dealt, and what is equal in both is interchangeable
    marked = marked.withColumn("__bucket", F.pmod(F.xxhash64(*key, "length"), F.lit(buckets)))
    counts = before(marked.groupBy("__class", "__bucket").agg(F.count("*").alias("n")), "__bucket", ["n"], ["__class"]).select("__class", "__bucket", "before_n")
    place = Window.partitionBy("__class", "__bucket").orderBy(*key, "length")
    ranked = marked.withColumn("__in", F.row_number().over(place) - 1).join(counts, ["__class", "__bucket"]).withColumn("__rank", F.col("before_n") + F.col("__in"))
    seated = ranked.join(F.broadcast(runs), (ranked["__class"] == runs["__class"]) & (F.col("__rank") >= F.col("__begin")) & (F.col("__rank") < F.col("__end")))
    turn = F.col("__rank") - F.col("__begin")
    placed = seated.select(*pieces.columns, (F.col("__first") + F.floor(turn / F.col("__each"))).alias("sequence_id"), (F.col("__lead") + turn % F.col("__each")).alias("__slot"))
    line = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(line), F.lit(0)).cast("long").alias("offset"))


def _donors(counts: np.ndarray, capacity: int, least: int) -> tuple[int, int]:
    """(u, m): sequences of fewer than u ids, and m of those with u, are taken apart; ``counts[u]`` sequences have u ids.

    As many as the others have room for, in rooms of at least ``least`` places.
    """
    used = np.arange(capacity + 1)
    rooms = np.where(capacity - used >= least, capacity - used, 0)
    free, given = int((counts * rooms).sum()), 0
    for u in range(1, capacity + 1):
        if not rooms[u]:
            return u, 0
        if counts[u]:
            m = min(int(counts[u]), (free - given) // (u + int(rooms[u])))
            given, free = given + m * u, free - m * int(rooms[u])
            if m < counts[u]:
                return u, m
    return capacity + 1, 0


def _refilled(placed: DataFrame, capacity: int, least: int) -> DataFrame:
    """The stored ``placed`` with ``part``, the ids of a piece before its row: rooms are filled with cut pieces.

    ``length`` is then that of the part; a piece may come out as several rows.
    """
    used = written(placed.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("used")), "sequences")
    counts = np.zeros(capacity + 1, np.int64)
    for r in used.groupBy("used").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[r["used"]] = r["n"]
    below, some = _donors(counts, capacity, least)
    whole = placed.withColumn("part", F.lit(0).cast("long"))
    if not counts[:below].sum() + some:
        return whole
    at = before(used.withColumn("edge", (F.col("used") == below).cast("long")), "sequence_id", ["edge"])
    gives = (F.col("used") < below) | ((F.col("used") == below) & (F.col("before_edge") < some))
    room = F.lit(capacity) - F.col("used")
    dealt = at.select("sequence_id", "used", gives.alias("gives")).withColumn("given", F.when(F.col("gives"), F.col("used")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("room", F.when(~F.col("gives") & (room >= least), room).otherwise(F.lit(0)))
    lines = written(before(dealt, "sequence_id", ["given", "room"]), "lines")
    taken = lines.where("gives").select("sequence_id", F.col("before_given").alias("__base"))
    stay = whole.join(taken.select("sequence_id"), "sequence_id", "left_anti").select(*whole.columns)
    cells = lambda a, n: F.explode(F.sequence(F.floor(a / capacity), F.floor((a + n - 1) / capacity)))
    loose = whole.join(taken, "sequence_id").withColumn("__p", F.col("__base") + F.col("offset")).withColumn("__cell", cells(F.col("__p"), F.col("length")))
    rooms = lines.where("room > 0").select(F.col("sequence_id").alias("__to"), F.col("used").alias("__used"), F.col("room").alias("__room"), F.col("before_room").alias("__r")).withColumn("__cell", cells(F.col("__r"), F.col("__room")))
    low, high = F.greatest("__p", "__r"), F.least(F.col("__p") + F.col("length"), F.col("__r") + F.col("__room"))
    # two that overlap meet in the cell where their common part begins, and only there
    met = loose.join(rooms, "__cell").withColumn("__low", low).withColumn("__high", high).where((F.col("__low") < F.col("__high")) & (F.floor(F.col("__low") / capacity) == F.col("__cell")))
    changed = {
        "length": F.col("__high") - F.col("__low"),
        "sequence_id": F.col("__to"),
        "offset": F.col("__used") + F.col("__low") - F.col("__r"),
        "part": F.col("__low") - F.col("__p"),
    }
    return stay.unionByName(met.select(*[changed[c].cast("long").alias(c) if c in changed else F.col(c) for c in whole.columns]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "start"), least: int | None = LEAST_ROOM) -> DataFrame:
    """``pieces`` (a column ``length`` of 1 to ``capacity``, and any others) with sequence_id, offset and part.

    Offsets leave no gap within a sequence; ids of sequences are from 0, some unused.  Rooms of
    ``least`` places or more are filled by cutting pieces: a piece may come out as several rows,
    each with the ids before it in the piece (``part``) and its own ``length``; null: cut none.
    Input columns named sequence_id, offset or part give way to the results.  Rows with equal
    ``key`` are placed one by one, null keys too.  Null or empty pieces (length null or below 1)
    are not placed and left out; an empty table gives no rows.  ``pieces`` is read twice: pass a
    stored table.
    """
    pieces = pieces.drop("sequence_id", "offset", "part").where(F.col("length") >= 1)
    keys = [f"k{i}" for i in range(len(key))]
    own = pieces.select(F.struct(*pieces.columns).alias("row"), F.col("length").cast("long").alias("length"), *[F.col(k).alias(n) for k, n in zip(key, keys)])
    placed = _place(own, capacity, tuple(keys))
    done = placed.withColumn("part", F.lit(0).cast("long")) if least is None else _refilled(written(placed, "placed"), capacity, least)
    given = pieces.schema["length"].dataType
    columns = [F.col("length").cast(given).alias(c) if c == "length" else F.col("row").getField(c).alias(c) for c in pieces.columns]
    return done.select(*columns, "sequence_id", "offset", "part")


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the encoded documents: piece (a number of its own, once stored), doc_id, start, length, doc_tokens and ids (binary, uint16 or uint32).

    A document's ids end with ``end_id``; null text has only that one.  All pieces but the last
    have ``capacity`` ids.  Repeated rows are cut one by one, null ids stay null; an empty table
    gives no pieces.  Ids take two bytes where the tokenizer's all do.
    """
    closing = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        known, width = encoder(tokenizer, 200_000), 4 * capacity
        encode, narrow = known.encode_bytes, max(known.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + closing
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    kept = np.frombuffer(part, "<u4").astype("<u2").tobytes() if narrow else part
                    rows.append((number, doc_id, at // 4, len(part) // 4, len(ids) // 4, zlib.crc32(part), kept))
                    number += 1
            columns = zip(*rows) if rows else [()] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, _PIECES)], list(_PIECES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in _PIECES))


_PIECES = ("piece", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids")


def _checksums(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``parts`` (piece, length, part, ...) of cut pieces with the CRC-32 of their ids."""

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sums = []
            for ids, size, part, length in zip(*(batch.column(c).to_pylist() for c in ("ids", "whole", "part", "length"))):
                each = len(ids) // size
                sums.append(zlib.crc32(np.frombuffer(ids[each * part : each * (part + length)], f"<u{each}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "ids_crc32" else pa.array(sums, pa.int64()) for c in out.names], out.names)

    out = parts.schema
    # ids of pieces that were not cut stay where they are
    joined = parts.join(likely(pieces.select("piece", "ids"), parts, "piece"), "piece")
    return joined.mapInArrow(check, out)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Contract of operator 1 over ``docs``: one row for each piece, whose ids are given as their CRC-32.

    Null texts have their end id only; repeated rows are packed one by one; an empty table gives
    no rows; other columns are ignored.
    """
    pieces = written(cut_documents(docs, tokenizer_path("word_bpe_49k.json"), 2), "pieces")
    packed = written(pack(pieces.drop("ids").withColumn("whole", F.col("length")), key=("doc_id", "start", "ids_crc32")), "packed")
    cut = F.col("length") < F.col("whole")
    parts = written(packed.where(cut), "cut-pieces")
    every = packed.where(~cut).unionByName(_checksums(parts, pieces))
    return every.select("doc_id", (F.col("start") + F.col("part")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_cutting_stock_packing(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all documents."""
    from .store import documents

    return pack_documents(documents(spark, sf_dir))
