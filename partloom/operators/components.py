"""Strongly connected parts of the list graph, and a witness for each cycle into their least code.

Every step is a join and an aggregation over stored tables; nothing is bounded in length and no
group of codes meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored


def _inner_edges(edges: DataFrame) -> DataFrame:
    """Edges whose parent is a child and whose child is a parent."""
    # joined by shuffles: small files of codes are large in the driver's memory
    held = edges.join(edges.select(F.col("child").alias("parent")).distinct().hint("merge"), "parent", "left_semi").join(edges.select(F.col("parent").alias("child")).distinct().hint("merge"), "child", "left_semi")
    return held.select("parent", "child")


def trimmed(graph: DataFrame) -> DataFrame:
    """The edges (parent, child) left when codes without a parent or without a child are taken away again and again."""
    edges = stored(graph.select("parent", "child").distinct(), "cyclic")
    n = edges.count()
    while n:
        edges = stored(_inner_edges(_inner_edges(edges)), "cyclic")  # two rounds a table
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def least_ancestors(edges: DataFrame) -> DataFrame:
    """code, least: the least code that leads to each code, itself included.

    A code takes the least of its own mark, those of its parents, and that of the code it is marked with,
    so marks move by doubling steps where codes grow along a path.
    """
    codes = edges.select(F.col("parent").alias("code")).unionByName(edges.select(F.col("child").alias("code"))).distinct()
    marks = stored(codes.select("code", F.col("code").alias("least")), "marks")
    while True:
        by_code = marks.select(F.col("code").alias("at"), F.col("least").alias("mark"))
        from_parents = edges.join(by_code, edges["parent"] == F.col("at")).select(F.col("child").alias("code"), F.col("mark").alias("least"))
        jumped = marks.join(by_code, marks["least"] == F.col("at")).select("code", F.col("mark").alias("least"))
        was = F.max("was")
        every = marks.select("code", "least", F.col("least").alias("was")).unionByName(from_parents.unionByName(jumped).withColumn("was", F.lit(None).cast("string")))
        step = stored(every.groupBy("code").agg(F.min("least").alias("least"), was.alias("was")), "marks")
        marks = step.select("code", "least")
        if step.where("least <> was").isEmpty():
            return marks


def _parents(inner: DataFrame, codes: DataFrame) -> DataFrame:
    return inner.join(codes.select(F.col("code").alias("child"), "head"), ["child", "head"]).select(F.col("parent").alias("code"), "head").distinct()


def leading_back(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """code, head: the codes that lead back to the code they are marked with, inside its marks."""
    a, b = marks.select(F.col("code").alias("parent"), F.col("least").alias("head")), marks.select(F.col("code").alias("child"), F.col("least").alias("other"))
    inner = stored(edges.join(a, "parent").join(b, "child").where("head = other").select("parent", "child", "head"), "inner-edges")
    seen = frontier = stored(marks.where("code = least").select("code", F.col("least").alias("head")), "back")
    while True:
        one = _parents(inner, frontier)  # two steps a table
        frontier = stored(one.unionByName(_parents(inner, one)).distinct().join(seen, ["code", "head"], "left_anti"), "back")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def strong_components(graph: DataFrame) -> DataFrame:
    """code, head: every code on a cycle with the least code of its strongly connected part.

    Codes off all cycles are trimmed first.  Of what the least code of a mark leads to, that which
    leads back to it is one part; parts are taken away and the rest goes round again.
    """
    edges, parts = trimmed(graph), None
    loops = edges.where("parent = child").select(F.col("parent").alias("code"))
    while not edges.isEmpty():
        part = stored(leading_back(edges, least_ancestors(edges)), "part")
        parts = part if parts is None else parts.unionByName(part)
        gone = part.select("code")
        edges = trimmed(edges.join(gone.withColumnRenamed("code", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("code", "child"), "child", "left_anti"))
    if parts is None:
        return edges.select(F.col("parent").alias("code"), F.col("child").alias("head"))
    wide = parts.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    return stored(parts.join(wide, "head", "left_semi").select("code", "head").unionByName(loops.select("code", F.col("code").alias("head"))).groupBy("code").agg(F.min("head").alias("head")), "components")


def cycle_witnesses(graph: DataFrame) -> DataFrame:
    """head, length, path (codes, the first one repeated at the end): shortest cycles of the graph, of any length.

    For each part of two codes or more, every edge into its least code closes one: the shortest way
    from there to the edge, the least of equally short ones.  Every loop of a code to itself is one too.
    """
    parts = strong_components(graph)
    edges = graph.select("parent", "child").distinct()
    a, b = parts.select(F.col("code").alias("parent"), "head"), parts.select(F.col("code").alias("child"), F.col("head").alias("other"))
    inner = stored(edges.join(a, "parent").join(b, "child").where("head = other").select("parent", "child", "head"), "inner-edges")
    onward = inner.where("child <> head and parent <> child")
    seen = frontier = stored(parts.where("code = head").select("code", "head", F.array("code").alias("path")), "ways")
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("code", "parent").join(onward, ["parent", "head"]).groupBy(F.col("child").alias("code"), "head").agg(F.min("path").alias("path"))
        frontier = stored(step.join(seen, ["code", "head"], "left_anti").select("code", "head", F.concat("path", F.array("code")).alias("path")), "ways")
        seen = seen.unionByName(frontier)
    closing = inner.where("child = head and parent <> child").select(F.col("parent").alias("code"), "head")
    long = closing.join(seen, ["code", "head"]).select("head", F.concat("path", F.array("head")).alias("path"))
    loops = edges.where("parent = child").select(F.col("parent").alias("head"), F.array("parent", "child").alias("path"))
    return long.unionByName(loops).select("head", (F.size("path") - 1).alias("length"), "path")


def simple_cycles(graph: DataFrame) -> DataFrame:
    """head, length, path: every cycle of the graph that meets no code twice, once, from its least code; of any length.

    Ways go from the least code of each strongly connected part, inside it; then that code is taken away and
    the rest falls into parts again.  There may be exponentially many cycles in a dense part: that is the job.
    """
    edges = stored(graph.select("parent", "child").distinct(), "cycle-edges")
    found = edges.where("parent = child").select(F.col("parent").alias("head"), F.array("parent", "child").alias("path"))
    edges = edges.where("parent <> child")
    while True:
        parts = strong_components(edges)
        a, b = parts.select(F.col("code").alias("parent"), "head"), parts.select(F.col("code").alias("child"), F.col("head").alias("other"))
        inner = stored(edges.join(a, "parent").join(b, "child").where("head = other").select("parent", "child", "head"), "inner-edges")
        if inner.isEmpty():
            return found.select("head", (F.size("path") - 1).alias("length"), "path")
        onward = inner.where("child <> head")
        ways = seen = stored(parts.where("code = head").select("head", "code", F.array("code").alias("path")), "ways")
        while not ways.isEmpty():
            step = ways.withColumnRenamed("code", "parent").join(onward, ["parent", "head"]).where(~F.array_contains("path", F.col("child")))
            ways = stored(step.select("head", F.col("child").alias("code"), F.concat("path", F.array("child")).alias("path")), "ways")
            seen = seen.unionByName(ways)
        closing = inner.where("child = head").select(F.col("parent").alias("code"), "head")
        found = found.unionByName(stored(seen.join(closing, ["code", "head"]).select("head", F.concat("path", F.array("head")).alias("path")), "cycles"))
        edges = onward.where("parent <> head").select("parent", "child")
