"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size.  Its
whole part is taken for sure; the fractions are rounded together: two fractional documents meet,
and words move from one to the other, in a random direction that leaves both expectations as they
are, until one of them is integral.  The words of the source do not change in such a step, so its
total stays at the target up to one last document, which is rounded by chance.  Documents meet
within chunks (source, size class, salt) in descending size; each chunk leaves one fractional
document at most, and the chunks' residuals meet along a reduction tree over the salts, then over
the size classes.  Nothing depends on how rows are partitioned, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
#: Chunks that meet in one node of the reduction tree, as a power of two.
FAN_BITS = 4
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources in code point order, null last, have the weights in turn; together they share
    ``share`` of all words.  No target exceeds ``ceiling`` times its source's size: what is above
    goes to the others by weight.  One row per source meets in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = by_source.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).alias("__w"), (F.sum("source_size").over(every) * share).alias("__all")
    ).withColumn("__cap", F.col("source_size") * ceiling)
    full = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    level = weighed.withColumn(
        "__level",
        (F.col("__all") - F.coalesce(F.sum("__cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("__w").over(full.rowsBetween(0, Window.unboundedFollowing)),
    ).withColumn("__open", F.col("__cap") / F.col("__w") > F.col("__level"))
    water = F.max(F.when(F.col("__open"), F.col("__level"))).over(every)  # the first open source's; levels fall from there on
    return level.select("source", "source_size", F.when(F.col("__open"), F.col("__w") * water).otherwise(F.col("__cap")).alias("target"))


def _meet(keys: Sequence[str]):
    """A function for mapInArrow over rows sorted by ``keys``: runs of equal keys round their fractions.

    Only the one fractional document of the present run is held.
    """

    def rounds(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, held_key = None, None
        for batch in batches:
            names = batch.schema.names
            frac, size, u = (batch.column(c).to_pylist() for c in ("__frac", "size", "__u"))
            own = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * len(frac)
            done: list[int] = []
            for i, key in enumerate(own):
                f = frac[i]
                if f <= _EPS or f >= 1 - _EPS or not size[i]:
                    frac[i] = float(f >= 1 - _EPS)
                    done.append(i)
                    continue
                if held is not None and held_key != key:
                    yield from _closed(held, held[2], frac, done)
                    held = None
                if held is None:
                    held, held_key = (None, i, f, size[i]), key
                    continue
                row, j, g, s = held
                up = min((1 - g) * s, f * size[i])  # words that the held document can get
                down = min(g * s, (1 - f) * size[i])
                moved = up if u[i] * (up + down) < down else -down
                g, f = g + moved / s, f - moved / size[i]
                if f <= _EPS or f >= 1 - _EPS:
                    frac[i] = float(f > 0.5)
                    done.append(i)
                    if g <= _EPS or g >= 1 - _EPS:
                        yield from _closed(held, float(g > 0.5), frac, done)
                        held = None
                    else:
                        held = (row, j, g, s)
                else:
                    yield from _closed(held, float(g > 0.5), frac, done)
                    held = (None, i, f, size[i])
            if held is not None and held[0] is None:
                held = (_row(batch, names, held[1], held[2]), None, *held[2:])
            elif held is not None:
                held = (_row(held[0], names, 0, held[2]), None, *held[2:])
            if done:
                yield _rows(batch, names, sorted(done), frac)
        if held is not None:
            yield held[0]  # a batch of its own since the last batch's end

    def _closed(held, value, frac, done):
        if held[0] is None:
            frac[held[1]] = value
            done.append(held[1])
        else:
            yield _row(held[0], held[0].schema.names, 0, value)

    def _row(batch, names, i, value):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([value]) if n == "__frac" else batch.column(n).slice(i, 1) for n in names], names)

    def _rows(batch, names, at, frac):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([frac[i] for i in at]) if n == "__frac" else batch.column(n).take(pa.array(at)) for n in names], names)

    return rounds


def pivotal_copies(sized: DataFrame, seed: int = 20240229, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, source, size, and more) with ``expected`` copies to the same rows with ``copies``.

    Chance comes from ``key``.  Rows of size 0, or of null expectation, get none.  Equal rows are rounded one by one.
    ``sized`` is read once per pass: pass a stored table.
    """
    total = sized.count()
    salts = 1 << max(0, (total // 4096).bit_length())
    rows = (
        sized.withColumn("expected", F.when(F.col("size") > 0, F.coalesce("expected", F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("__base", F.floor(F.col("expected") + _EPS).cast("long"))
        .withColumn("__frac", F.greatest(F.col("expected") - F.col("__base"), F.lit(0.0)))
        .withColumn("__octave", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 2).cast("int"))
        .withColumn("__salt", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(salts)).cast("long"))
    )
    columns, parts, bits = rows.columns, [], 0
    level = 0
    while True:
        over_sizes = (1 << bits) >= salts and level > 0
        keys = ["source"] if over_sizes else ["source", "__octave", "__salt"]
        chance = F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        dealt = rows.withColumn("__salt", F.shiftrightunsigned("__salt", FAN_BITS) if level else F.col("__salt")).withColumn("__u", chance)
        dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, F.desc("size"), *key)
        schema = dealt.schema
        met = written(dealt.mapInArrow(_meet(keys), schema), f"mix-{level}")
        whole = F.col("__frac").isin(0.0, 1.0)
        if over_sizes:
            last = F.when(whole, F.col("__frac")).otherwise((F.col("__u") < F.col("__frac")).cast("double"))
            parts.append(met.withColumn("__frac", last).select(*columns))
            break
        parts.append(met.where(whole).select(*columns))
        rows = met.where(~whole).select(*columns)
        if level:
            bits += FAN_BITS
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("copies", F.col("__base") + F.col("__frac").cast("long")).drop("expected", "__base", "__frac", "__octave", "__salt")


def _numbered_nulls(sizes: DataFrame) -> DataFrame:
    """``sizes`` without __part and __place; __tie of a row of null id also tells its number among the rows equal to it.

    Numbers run from 0 whatever the partitions, so the rows drawn are the same.  A window holds
    what one partition has of a text, or one row of each partition.
    """
    same = ["source", "size", "__tie"]
    nulls = sizes.where("doc_id is null")
    parts = nulls.groupBy(*same, "__part").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.partitionBy(*same).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__tie").alias("__t"), F.col("__part").alias("__p"), base.alias("__base"))
    own = F.row_number().over(Window.partitionBy(*same, "__part").orderBy("__place"))
    met = nulls.withColumn("__own", own).join(bases, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("__tie") == F.col("__t")) & (F.col("__part") == F.col("__p")))
    tied = met.withColumn("__tie", F.xxhash64("__tie", F.col("__base") + F.col("__own")))
    kept = [c for c in sizes.columns if c not in ("__part", "__place")]
    return sizes.where("doc_id is not null").select(*kept).unionByName(tied.select(*kept))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of ``docs``, and its columns ``carry``.

    A null text has size 0 and no copies; null sources form one source; null and repeated ids are
    drawn row by row, the same ones however the rows are partitioned.  An empty table gives no rows.
    """
    # repeated ids are told apart by text, null ones by their number among equal rows, so that they too are dealt over all chunks
    sizes = _numbered_nulls(written(docs.select(
        *carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("__tie"),
        F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place"),
    ), "mix-sizes"))
    targets = source_targets(sizes, weights, share, ceiling)
    joined = sizes.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return pivotal_copies(written(joined.withColumn("expected", F.try_divide("target", F.col("source_size").cast("double"))), "mix-expected"), key=("doc_id", "__tie")).drop("__tie")


def op7_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all documents."""
    from .store import documents

    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")
