"""Multidimensional clustered layout of the documents, and how many files a neighbourhood query meets.

Rows are ordered by an interleaved key of four coordinates (octiles of source, language, length and
date) and cut into files.  A query is the neighbourhood of a coordinate cell, so what it meets
depends on the cell alone, and cells are bounded by the grid, not by the input:

* files touched, by complement counting: of the files that cover the cell's source and language,
  take away those whose lengths all miss the query, those whose dates do, and put back those that
  miss by both.  Each count is read from a two-dimensional cumulative histogram of file corners.
* files matching: the rows of a cell stand next to each other, so a cell is an interval of files; a
  query holds at most nine cells, and the files in their intervals are counted in order.

Nothing that grows with the rows goes through one task, to the driver or into a broadcast: only the
borders of the octiles (at most 28 values) are collected, and tables of cells are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import documents, written

#: Coordinates from 0 to PARTS - 1, a power of two; rows of a file; how far lengths and dates of a query may be.
PARTS, FILE_ROWS, NEAR = 8, 2000, 1
#: In the order of bounds; the key takes their digits in the opposite order.
VALUES = ("source", "lang", "length", "date")
_BITS = PARTS.bit_length() - 1
#: A row number in a sorted partition is the part of monotonically_increasing_id below this bit.
_PLACE = 33


def in_order(df: DataFrame, *order: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``position``, from 0 by ``order``, and for each of ``sums`` its ``before_<c>`` over all earlier rows.

    Rows are dealt into ranges of the order, as many as shuffle partitions, and numbered within them
    in the task that sorts them; then each range is moved by what lies before it.  One task adds up
    the sizes of the ranges, a row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__m"))
    placed = written(numbered, "in-order").select("*", F.shiftright("__m", _PLACE).alias("__range"))
    within = Window.partitionBy("__range").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__n_{c}") for c in sums])
    zero = F.lit(0).cast("long")
    moved = sizes.select("__range", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"__before{c}") for c in ("__n", *[f"__n_{c}" for c in sums])])
    found = placed.join(F.broadcast(written(moved, "ranges")), "__range")
    return found.select(
        *df.columns,
        (F.col("__before__n") + F.col("__m").bitwiseAND((1 << _PLACE) - 1)).alias("position"),
        *[(F.col(f"__before__n_{c}") + F.coalesce(F.sum(c).over(within), zero)).alias(f"before_{c}") for c in sums],
    )


def valued(docs: DataFrame) -> DataFrame:
    """doc_id, the four values, and two columns that only break ties: a hash of all that is read, and a row number."""
    length = F.coalesce(F.octet_length("text").cast("long"), F.lit(-1).cast("long"))
    date = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(365))
    return docs.select("doc_id", "source", "lang", length.alias("length"), date.alias("date"), F.xxhash64("text", "source", "lang").alias("__tie"), F.monotonically_increasing_id().alias("__row"))


def borders(rows: DataFrame) -> list[list[tuple[int, object]]]:
    """For each of VALUES the (coordinate, least value of it), but for coordinate 0; coordinates that no row has are left out.

    Distinct values are counted map-side, put in order, and their counts added up; at most
    PARTS - 1 of each of the four come back to the driver.
    """
    whole = lambda i: i >= 2  # noqa: E731  lengths and dates
    none = F.lit(None)
    entries = [F.struct(F.lit(i).alias("v"), (F.col(c) if whole(i) else none).cast("long").alias("k"), (none if whole(i) else F.col(c)).cast("string").alias("s")) for i, c in enumerate(VALUES)]
    counts = rows.select(F.explode(F.array(*entries)).alias("x")).groupBy("x.v", "x.k", "x.s").agg(F.count("*").alias("n"))
    summed = written(in_order(counts, "v", "k", "s", sums=("n",)), "smaller")
    n = summed.where(F.col("v") == 0).agg(F.sum("n")).collect()[0][0]
    if not n:
        return [[] for _ in VALUES]
    smaller = F.col("before_n") - F.col("v") * F.lit(n)  # each value has all n rows once
    placed = summed.select("v", "position", "k", "s", F.call_function("div", smaller * PARTS, F.lit(n)).alias("c")).where(F.col("c") > 0)
    first = placed.groupBy("v", "c").agg(F.min(F.struct("position", "k", "s")).alias("x")).collect()
    return [[(r.c, r.x.k if whole(i) else r.x.s) for r in sorted(first, key=lambda r: r.c) if r.v == i] for i in range(len(VALUES))]


def coordinate(value: Column, edges: list[tuple[int, object]]) -> Column:
    """The coordinate of a value among its borders; null is smaller than all."""
    found = F.when(F.lit(False), F.lit(0))
    for c, least in reversed(edges):
        found = found.when(value >= F.lit(least), F.lit(c))
    return found.otherwise(F.lit(0)).cast("int")


def interleaved(coordinates: dict[str, Column]) -> Column:
    """Binary digits of the coordinates, highest first, each round from the last of VALUES to the first."""
    z = F.lit(0).cast("long")
    for bit in reversed(range(_BITS)):
        for name in reversed(VALUES):
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(coordinates[name], bit).bitwiseAND(F.lit(1)).cast("long"))
    return z


def touched(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """z, files_touched: complement counting over the corners of the files.

    A file misses by length below or above, and by date below or above.  Ends are mirrored so that
    each kind of miss is a count of corners up to a place: x is the greatest length, or PARTS - 1
    less the least.  Histograms have at most 4 * PARTS^4 places, whatever the number of files.
    """
    top = PARTS - 1
    below, above = (lambda c: F.col(f"{c}_most")), (lambda c: F.lit(top) - F.col(f"{c}_least"))
    kinds = [(x, y) for x in (below, above) for y in (below, above)]
    span = lambda c: F.explode(F.sequence(f"{c}_least", f"{c}_most"))
    corners = F.array(*[F.struct(F.lit(k).alias("kind"), x("length").alias("x"), y("date").alias("y")) for k, (x, y) in enumerate(kinds)])
    covered = bounds.select("*", span("source").alias("source")).select("*", span("lang").alias("lang")).select("source", "lang", F.explode(corners).alias("e"))
    histogram = covered.groupBy("source", "lang", "e.kind", "e.x", "e.y").agg(F.count("*").alias("n"))
    upward = histogram.select("source", "lang", "kind", F.explode(F.sequence("x", F.lit(top))).alias("x"), "y", "n")
    upward = upward.select("source", "lang", "kind", "x", F.explode(F.sequence("y", F.lit(top))).alias("y"), "n")
    cumulative = upward.groupBy("source", "lang", "kind", "x", "y").agg(F.sum("n").alias("n"))
    # a query misses by `below` corners up to its least place less 1, by `above` ones up to the mirror of its greatest place plus 1
    ends = lambda c: (F.col(c) - NEAR - 1, F.lit(top) - (F.col(c) + NEAR + 1))
    (lx, hx), (ly, hy), every = ends("length"), ends("date"), F.lit(top)
    reads = [(0, every, every, 1), (0, lx, every, -1), (2, hx, every, -1), (0, every, ly, -1), (1, every, hy, -1), (0, lx, ly, 1), (1, lx, hy, 1), (2, hx, ly, 1), (3, hx, hy, 1)]
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("x"), y.alias("y"), F.lit(sign).alias("sign")) for k, x, y, sign in reads]))
    asked = cells.select("z", "source", "lang", wanted.alias("r")).select("z", "source", "lang", "r.*")
    return asked.join(cumulative, ["source", "lang", "kind", "x", "y"]).groupBy("z").agg(F.sum(F.col("sign") * F.col("n")).alias("files_touched"))


def matching(cells: DataFrame) -> DataFrame:
    """z, files_matching: files in the intervals of the cells of a query; neighbours in order share one file at most."""
    steps = [F.struct(F.lit(i).alias("l"), F.lit(j).alias("d")) for i in range(-NEAR, NEAR + 1) for j in range(-NEAR, NEAR + 1)]
    asked = cells.select("z", "source", "lang", "length", "date", F.explode(F.array(*steps)).alias("t"))
    asked = asked.select("z", "source", "lang", (F.col("length") + F.col("t.l")).alias("length"), (F.col("date") + F.col("t.d")).alias("date"))
    held = cells.select("source", "lang", "length", "date", F.struct(F.col("z").alias("at"), "lo", "hi").alias("held"))
    lists = asked.join(held, ["source", "lang", "length", "date"]).groupBy("z").agg(F.sort_array(F.collect_list("held")).alias("held"))
    zero = F.lit(0).cast("long")

    def more(state: Column, x: Column) -> Column:
        return F.struct((state["n"] + x["hi"] - x["lo"] + 1 - F.when(state["last"] == x["lo"], 1).otherwise(0)).alias("n"), x["hi"].alias("last"))

    total = F.aggregate("held", F.struct(zero.alias("n"), F.lit(-1).cast("long").alias("last")), more, lambda state: state["n"])
    return lists.select("z", total.alias("files_matching"))


def clustered(docs: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching, file_bounds of every row of ``docs``.

    Null values are smallest (a null doc_id has no date and stands first in its cell); a null text has
    length -1, an empty one 0.  Rows that repeat a doc_id stand in the order of a hash of their
    columns; like rows share a run of positions.  An empty table gives no rows.  Other columns are not read.
    """
    rows = written(valued(docs), "layout-values")
    edges = borders(rows)
    spots = {c: coordinate(F.col(c), e) for c, e in zip(VALUES, edges, strict=True)}
    coordinates = rows.select("doc_id", "__tie", "__row", *[x.alias(c) for c, x in spots.items()])
    keyed = coordinates.select("*", interleaved({c: F.col(c) for c in VALUES}).alias("z"))
    placed = in_order(keyed, "z", "doc_id", "__tie", "__row")
    placed = placed.select("doc_id", "z", "position", F.call_function("div", F.col("position"), F.lit(file_rows)).alias("file"), *VALUES)

    ends = [f(c).alias(f"{c}_{k}") for c in VALUES for f, k in ((F.min, "least"), (F.max, "most"))]
    bounds = written(placed.groupBy("file").agg(*ends), "file-bounds")
    cells = written(placed.groupBy("z", *VALUES).agg(F.min("file").alias("lo"), F.max("file").alias("hi")), "cells")
    answers = written(touched(cells, bounds).join(matching(cells), "z"), "answers")  # at most PARTS^4 rows
    told = F.concat_ws(",", *[F.col(f"{c}_{k}") for c in VALUES for k in ("least", "most")])
    described = bounds.select("file", told.alias("file_bounds"))
    found = placed.join(F.broadcast(answers), "z").join(described, "file")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def op13_clustered_layout(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over all documents."""
    return clustered(documents(spark, sf_dir))


SQL = """
WITH digits AS (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN -1 ELSE octet_length(encode(text)) END AS length, string_split(CAST(doc_id AS VARCHAR), '') AS d FROM documents),
crcs AS (SELECT doc_id, source, lang, length, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(d, lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b:
  list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295) % 365 AS BIGINT) AS date FROM digits),
n AS (SELECT count(*) AS n FROM documents),
c AS (SELECT doc_id, 8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // n AS s, 8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // n AS l,
  8 * (rank() OVER (ORDER BY length) - 1) // n AS e, 8 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // n AS d FROM crcs, n),
zs AS (SELECT doc_id, s, l, e, d, d // 4 * 2048 + e // 4 * 1024 + l // 4 * 512 + s // 4 * 256 + d // 2 % 2 * 128 + e // 2 % 2 * 64 + l // 2 % 2 * 32 + s // 2 % 2 * 16 + d % 2 * 8 + e % 2 * 4 + l % 2 * 2 + s % 2 AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM zs),
f AS (SELECT *, position // 2000 AS file FROM p),
b AS (SELECT file, min(s) AS s0, max(s) AS s1, min(l) AS l0, max(l) AS l1, min(e) AS e0, max(e) AS e1, min(d) AS d0, max(d) AS d1 FROM f GROUP BY file),
cells AS (SELECT DISTINCT z, s, l, e, d FROM f),
held AS (SELECT DISTINCT z, s, l, e, d, file FROM f),
touch AS (SELECT z, count(*) AS n FROM cells JOIN b ON s BETWEEN s0 AND s1 AND l BETWEEN l0 AND l1 AND e0 <= e + 1 AND e1 >= e - 1 AND d0 <= d + 1 AND d1 >= d - 1 GROUP BY z),
matched AS (SELECT a.z, count(DISTINCT h.file) AS n FROM cells a JOIN held h ON h.s = a.s AND h.l = a.l AND abs(h.e - a.e) <= 1 AND abs(h.d - a.d) <= 1 GROUP BY a.z)
SELECT f.doc_id, CAST(f.z AS BIGINT) AS z, f.position, CAST(f.file AS BIGINT) AS file, touch.n AS files_touched, matched.n AS files_matching, concat_ws(',', s0, s1, l0, l1, e0, e1, d0, d1) AS file_bounds
FROM f JOIN b ON b.file = f.file JOIN touch ON touch.z = f.z JOIN matched ON matched.z = f.z
"""
