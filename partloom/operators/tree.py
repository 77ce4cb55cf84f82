"""Indented trees: rows (doc_id, seq, level, ...) whose parents follow from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm, strip_lookup_suffix
from ..plans.tables import stored


def _blank_rule(rows: DataFrame, blank: str) -> DataFrame:
    if blank not in ("keep", "skip", "reset"):
        raise ValueError(blank)
    if blank == "skip":
        return rows.where(norm(F.col("code")) != "")
    if blank == "reset":
        return rows.withColumn("level", F.when(norm(F.col("code")) == "", F.lit(0)).otherwise(F.col("level")))
    return rows


def _levels(rows: DataFrame) -> int:
    """Greatest level; indents are columns of a sheet, so there are few."""
    return (rows.agg(F.max("level")).first()[0] or 0) + 1


def _last_at(level: int) -> Column:
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("level") == level, F.col("seq")), ignorenulls=True).over(before)


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(None).cast("long")


def level_parents(rows: DataFrame, blank: str = "keep") -> DataFrame:
    """``rows`` with parent_seq: the nearest row before with a smaller level.

    ``blank`` says what a row without code does: keep (a node like others), skip (left out), or
    reset (as of level 0, so that nothing before it is an ancestor of what follows).
    """
    rows = _blank_rule(rows, blank)
    n = _levels(rows)
    marked = rows.select("*", *[_last_at(i).alias(f"__l{i}") for i in range(n)])
    chosen = F.lit(None).cast("long")
    for own in range(1, n):
        chosen = F.when(F.col("level") == own, _greatest([F.col(f"__l{i}") for i in range(own)])).otherwise(chosen)
    return marked.withColumn("parent_seq", chosen).drop(*[f"__l{i}" for i in range(n)])


def strict_parents(rows: DataFrame) -> DataFrame:
    """``rows`` with parent_seq: the last row exactly one level up, unless a still higher row came after it."""
    n = _levels(rows)
    marked = rows.select("*", *[_last_at(i).alias(f"__l{i}") for i in range(n)])
    chosen = F.lit(None).cast("long")
    for own in range(1, n):
        up = F.col(f"__l{own - 1}")
        higher = _greatest([F.col(f"__l{i}") for i in range(own - 1)]) if own > 1 else F.lit(None).cast("long")
        chosen = F.when(F.col("level") == own, F.when(higher.isNull() | (up > higher), up)).otherwise(chosen)
    return marked.withColumn("parent_seq", chosen).drop(*[f"__l{i}" for i in range(n)])


def root_row(rows: DataFrame) -> DataFrame:
    """For each document its first row of least level with a code."""
    named = rows.where(norm(F.col("code")) != "")
    return named.groupBy("doc_id").agg(F.min_by(F.struct("seq", "code", "rev"), F.struct("level", "seq")).alias("r")).select("doc_id", "r.*")


def ancestors(parents: DataFrame) -> DataFrame:
    """doc_id, seq, ancestor_seq, distance: every row with each row above it, itself at distance 0.

    Chains are doubled, so it takes log(depth) joins.
    """
    up = parents.select("doc_id", "seq", "parent_seq")
    known = up.select("doc_id", "seq", F.col("seq").alias("ancestor_seq"), F.lit(0).alias("distance"))
    jump, length = up.where("parent_seq is not null").select("doc_id", "seq", F.col("parent_seq").alias("to")), 1
    while not jump.isEmpty():
        more = known.join(jump.select("doc_id", F.col("seq").alias("ancestor_seq"), "to"), ["doc_id", "ancestor_seq"]).select("doc_id", "seq", F.col("to").alias("ancestor_seq"), (F.col("distance") + length).alias("distance"))
        known = stored(known.unionByName(more), "ancestors")
        jump = stored(jump.alias("a").join(jump.select("doc_id", F.col("seq").alias("to"), F.col("to").alias("next")), ["doc_id", "to"]).select("doc_id", "seq", F.col("next").alias("to")), "jumps")
        length *= 2
    return known


def occurrences(rows: DataFrame) -> DataFrame:
    """code, occurrences: product of quantities down the tree, summed per code and per code without lookup suffix.

    A null or non-positive quantity counts as 1.
    """
    parents = stored(level_parents(rows, "skip"), "parents")
    factor = F.when(F.col("qty") > 0, F.col("qty")).otherwise(F.lit(1.0))
    weights = parents.select("doc_id", F.col("seq").alias("ancestor_seq"), factor.alias("f"))
    total = ancestors(parents).join(weights, ["doc_id", "ancestor_seq"]).groupBy("doc_id", "seq").agg(F.collect_list("f").alias("fs"))
    product = total.select("doc_id", "seq", F.aggregate(F.sort_array("fs"), F.lit(1.0), lambda a, x: a * x).alias("n"))
    coded = parents.join(product, ["doc_id", "seq"]).select(norm(F.col("code")).alias("code"), "n")
    short = coded.withColumn("s", strip_lookup_suffix(F.col("code"))).where("s <> code").select(F.col("s").alias("code"), "n")
    return coded.unionByName(short).groupBy("code").agg(F.sum("n").alias("occurrences"))


def effective_children(rows: DataFrame, blank: str = "keep") -> DataFrame:
    """code, most (over its occurrences), total: direct children with a positive quantity."""
    parents = stored(level_parents(rows, blank), "parents")
    counts = parents.where((F.col("qty") > 0) & F.col("parent_seq").isNotNull()).groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count("*").alias("n"))
    joined = parents.where(norm(F.col("code")) != "").join(counts, ["doc_id", "seq"], "left")
    return joined.groupBy(norm(F.col("code")).alias("code")).agg(F.max(F.coalesce("n", F.lit(0))).alias("most"), F.sum(F.coalesce("n", F.lit(0))).alias("total"))
