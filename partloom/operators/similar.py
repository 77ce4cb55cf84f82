"""Near spellings of codes, exactly and without holding every code against every other.

Two codes whose matching blocks make up a share of their letters have a common subsequence of that
many letters, so of short codes every subsequence of the least length that will do is a join key.
Of longer codes the rarest three-letter pieces are keys: what few letters more or less can spoil is
bounded, so codes alike share one of them.  The ratio itself is only asked of what these joins find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters in a piece of a long code.
PIECE = 3
#: Letters that may be left out of a short code; its keys grow with this power of its length.
LEFT_OUT = 2
#: Codes up to this length are held against one another by what is left of two edits.
EDITED = 20


def least_common(a, b, percent: int):
    """Letters that codes of lengths a and b must have in common for a ratio of ``percent``."""
    return (percent * (a + b) + 199) // 200 if isinstance(a, int) else F.floor((percent * (a + b) + 199) / 200)


def short_length(percent: int) -> int:
    """The greatest length up to which no pair of codes asks for more than LEFT_OUT letters left out."""
    n = 1
    while all(n + 1 - least_common(n + 1, m, percent) <= LEFT_OUT for m in range(1, n + 2) if m >= least_common(n + 1, m, percent)):
        n += 1
    return n


def _without(c: Column, count: int) -> Column:
    """All texts that ``c`` becomes when ``count`` letters (0 to 2) are left out."""
    drop = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    none, n = F.array().cast("array<string>"), F.length(c)
    if count == 0:
        return F.array(c)
    if count == 1:
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: drop(c, i))).otherwise(none)
    twice = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: drop(drop(c, i), j))))
    return F.when(n >= 2, twice).otherwise(none)


def _short_pairs(codes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    most = short_length(percent)

    def keyed(df: DataFrame, c: str, own: str, its: str) -> DataFrame:
        sized = df.withColumn(own, F.length(c)).where(F.col(own).between(1, most)).withColumn(its, F.explode(F.sequence(F.lit(1), F.lit(most))))
        need = sized.withColumn("__m", least_common(F.col(own), F.col(its), percent)).where((F.col("__m") <= F.col(own)) & (F.col("__m") <= F.col(its)))
        gone = F.col(own) - F.col("__m")
        left = F.when(gone == 0, _without(F.col(c), 0)).when(gone == 1, _without(F.col(c), 1)).otherwise(_without(F.col(c), 2))
        return need.select(c, own, its, F.explode(F.array_distinct(left)).alias("__key"))

    return keyed(codes, "code", "__a", "__b").join(keyed(known, "other", "__b", "__a"), ["__a", "__b", "__key"]).select("code", "other").distinct()


def _pieces(c: Column) -> Column:
    """The pieces of a text, each with its number among equal ones, so that none occurs twice."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c) - (PIECE - 1)), lambda i: F.substring(c, i, F.lit(PIECE)))
    return F.transform(cut, lambda p, i: F.concat(p, F.size(F.filter(F.slice(cut, F.lit(1), i + 1), lambda q: q == p)).cast("string")))


def long_pairs(codes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(code, other) of which one is longer than short codes and which differ in few enough pieces for ``percent``."""
    most = short_length(percent)
    least = -(-(most + 1) * percent // (200 - percent))
    both = codes.select(F.col("code").alias("text")).unionByName(known.select(F.col("other").alias("text"))).distinct()
    cut = both.where(F.length("text") >= least).select("text", F.explode(_pieces(F.col("text"))).alias("piece"))
    n = F.length("text")
    differ = F.floor((100 - percent) * (n + F.floor(n * (200 - percent) / percent)) / 100)
    rare = cut.join(cut.groupBy("piece").agg(F.count("*").alias("n")), "piece").withColumn("__r", F.row_number().over(Window.partitionBy("text").orderBy("n", "piece")))
    keys = rare.where(F.col("__r") <= differ * PIECE + 1).select("text", "piece")
    of = lambda df, c: df.select(c).join(keys.withColumnRenamed("text", c), c)
    a, b = F.length("code"), F.length("other")
    found = of(codes, "code").join(of(known, "other"), "piece").where((F.greatest(a, b) > most) & (F.least(a, b) >= least_common(a, b, percent))).select("code", "other").distinct()
    x, y = _pieces(F.col("code")), _pieces(F.col("other"))
    return found.where(F.size(F.array_intersect(x, y)) >= F.greatest(F.size(x), F.size(y)) - PIECE * F.floor((100 - percent) * (a + b) / 100))


def close_matches(codes: DataFrame, known: DataFrame, n: int | None = 3, percent: int = 90) -> DataFrame:
    """code, other, ratio: of each code the ``n`` (null: all) known ones of greatest ratio, at least ``percent`` of one; ties by the greater text.

    ``codes`` (code), ``known`` (other); null and empty texts match nothing, repeated ones count once.
    A ratio of less than 80 percent is refused: too little would then be left of a code to look for.
    """
    from .reports import sequence_ratio

    if not 80 <= percent <= 100:
        raise ValueError(f"percent must lie between 80 and 100, not {percent}")
    a, b = codes.select("code").where("code <> ''").distinct(), known.select("other").where("other <> ''").distinct()
    pairs = _short_pairs(a, b, percent).unionByName(long_pairs(a, b, percent))
    rated = pairs.withColumn("ratio", sequence_ratio("other", "code")).where(F.col("ratio") >= percent / 100)
    if n is None:
        return rated
    best = Window.partitionBy("code").orderBy(F.desc("ratio"), F.desc("other"))
    return rated.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= n).drop("__r")


def edit_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, other) of equal ``keys`` whose ends (column ``end``) are within two edits or nearly so.

    ``left`` (keys, code, end), ``right`` (keys, other, end), codes of at most EDITED letters.  A
    superset: two edits leave a common text when each side may leave out two letters.
    """
    left_out = F.array_distinct(F.concat(*[_without(F.col("end"), k) for k in range(LEFT_OUT + 1)]))
    cut = lambda df, c: df.where(F.length(c) <= EDITED).select(*keys, c, F.explode(left_out).alias("__left"))
    return cut(left, "code").join(cut(right, "other"), [*keys, "__left"]).select(*keys, "code", "other").distinct()


def near_codes(codes: DataFrame, known: DataFrame) -> DataFrame:
    """code, other, d, ratio: known spellings within two edits (d), or of a ratio of .92 (d is 3), of the one pool that applies to a code.

    ``codes`` and ``known`` (code), in upper case.  The pool is what has the same leading digits; if
    there is none, what begins with the same ten (of shorter codes: eight) letters; if there is
    none, the three closest of all by a ratio of at least .90.
    """
    from ..functions.keys import leading_root
    from .reports import sequence_ratio

    wanted, has = codes.select("code").where("code <> ''").distinct(), known.select(F.col("code").alias("other")).where("other <> ''").distinct()

    def keyed(df: DataFrame, c: str) -> DataFrame:
        start = F.when(F.length(c) >= 10, F.substring(c, 1, 10)).otherwise(F.substring(c, 1, 8))
        both = F.array(F.struct(F.lit(1).alias("kind"), leading_root(F.col(c)).alias("key")), F.struct(F.lit(2).alias("kind"), start.alias("key")))
        one = df.select(c, F.explode(F.filter(both, lambda k: k["key"].isNotNull())).alias("k")).select(c, "k.kind", "k.key")
        return one.withColumn("end", F.substring(F.col(c), F.length("key") + 1, F.length(c)))

    asked, there = keyed(wanted, "code"), keyed(has, "other")
    pooled = asked.join(there.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    first = pooled.groupBy("code").agg(F.min("kind").alias("kind"))
    own = pooled.join(first, ["code", "kind"])
    far = long_pairs(own.select("code").distinct(), has, 90).join(own.select("code", "kind", "key"), "code").join(there.select("other", "kind", "key"), ["other", "kind", "key"], "left_semi")
    inside = edit_pairs(own, there, ["kind", "key"]).select("code", "other").unionByName(far.select("code", "other")).distinct()
    outside = close_matches(wanted.join(first, "code", "left_anti"), has).select("code", "other")
    rated = inside.unionByName(outside).where("code <> other").withColumn("d", F.expr("levenshtein(code, other, 2)")).withColumn("ratio", sequence_ratio("code", "other"))
    return rated.where((F.col("d") >= 0) | (F.col("ratio") >= 0.92)).select("code", "other", F.when(F.col("d") >= 0, F.col("d")).otherwise(3).alias("d"), "ratio")


def variants(codes: DataFrame, known: DataFrame) -> DataFrame:
    """code, variant (other, root, code_end, other_end): the least known code of the same leading digits and another end.

    Of each root only the least code and the least one of another end than that are kept.
    """
    from ..functions.keys import leading_root, norm

    ends = lambda df, c: df.select(F.col("code").alias(c), leading_root(F.col("code")).alias("root"), F.regexp_extract(norm(F.col("code")), "^[0-9]{6,}(.*)$", 1).alias(f"{c}_end")).where("root is not null").distinct()
    by_end = ends(known, "other").groupBy("root", "other_end").agg(F.min("other").alias("other"))
    one = by_end.groupBy("root").agg(F.min(F.struct("other", "other_end")).alias("one"))
    two = by_end.join(one, "root").where(F.col("other_end") != F.col("one.other_end")).groupBy("root").agg(F.min(F.struct("other", "other_end")).alias("two"))
    j = ends(codes, "code").join(one.join(two, "root", "left"), "root")
    pick = F.when(F.col("one.other_end") != F.col("code_end"), F.col("one")).otherwise(F.col("two"))
    return j.withColumn("p", pick).where("p is not null").select("code", F.struct(F.col("p.other").alias("other"), "root", "code_end", F.col("p.other_end").alias("other_end")).alias("variant"))


def nearest_children(codes: DataFrame, others: DataFrame, least: int = 6) -> DataFrame:
    """parent, code, other, distance, digits: for each code the nearest other code of its parent.

    ``codes`` (parent, code), ``others`` (parent, other).  Nearest is what one edit makes of it, else
    what has the longest common beginning of digits, of ``least`` or more (distance is null then);
    ties by the least text.  A parent's others are looked up by key, not one by one.
    """
    cut = lambda df, c: df.select("parent", c, F.explode(F.array_distinct(F.concat(_without(F.col(c), 0), _without(F.col(c), 1)))).alias("__key"))
    edited = cut(codes, "code").join(cut(others, "other"), ["parent", "__key"]).select("parent", "code", "other").distinct().withColumn("distance", F.expr("levenshtein(code, other, 1)"))
    one = edited.where("distance >= 0").groupBy("parent", "code").agg(F.min(F.struct("distance", "other")).alias("one"))
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    starts = lambda c: F.when(F.length(bare(c)) >= least, F.transform(F.sequence(F.lit(least), F.length(bare(c))), lambda i: F.substring(bare(c), F.lit(1), i)))
    index = others.select("parent", "other", F.explode(starts(F.col("other"))).alias("start")).groupBy("parent", "start").agg(F.min("other").alias("other"))
    asked = codes.select("parent", "code", F.explode(starts(F.col("code"))).alias("start")).join(index, ["parent", "start"])
    two = asked.groupBy("parent", "code").agg(F.max_by(F.struct("other", F.length("start").alias("digits")), F.length("start")).alias("two"))
    j = codes.select("parent", "code").distinct().join(one, ["parent", "code"], "left").join(two, ["parent", "code"], "left").where("one is not null or two is not null")
    return j.select("parent", "code", F.coalesce("one.other", "two.other").alias("other"), F.col("one.distance").alias("distance"), F.when(F.col("one").isNull(), F.col("two.digits")).alias("digits"))
