"""The graph of component lists: degrees, roots, reach, aliases, where-used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..plans.tables import ranked, stored
from .components import strong_components
from .resolve import header_index


def list_graph(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Distinct parent, child over all lines, whatever their kind or quantity."""
    parents = header_index(headers).select("bom_id", F.col("code").alias("parent"))
    return lines.join(parents.hint("merge"), "bom_id").select("parent", norm(F.col("internal_code")).alias("child")).where("child <> ''").distinct()


def base_aliases(headers: DataFrame) -> DataFrame:
    """base, full: codes ``BASE-NN`` whose base belongs to exactly one of them."""
    h = header_index(headers).select("code").distinct().withColumn("base", F.regexp_extract("code", r"^(.+)-[0-9]{2}$", 1)).where("base <> ''")
    return h.groupBy("base").agg(F.count("*").alias("n"), F.min("code").alias("full")).where("n = 1").select("base", "full")


def with_aliases(graph: DataFrame, headers: DataFrame) -> DataFrame:
    """Children that are no header themselves get the one header that their base stands for."""
    own = header_index(headers).select(F.col("code").alias("child")).distinct().withColumn("own", F.lit(True))
    j = graph.join(own, "child", "left").join(base_aliases(headers).withColumnRenamed("base", "child"), "child", "left")
    return j.select("parent", F.when(F.col("own").isNull(), F.coalesce("full", "child")).otherwise(F.col("child")).alias("child")).distinct()


def degrees(graph: DataFrame, headers: DataFrame, most: int | None = 5000) -> DataFrame:
    """pn, is_header, indegree, outdegree by descending degrees; the report has ``most`` rows."""
    ins = graph.groupBy(F.col("child").alias("pn")).agg(F.count("*").alias("indegree"))
    outs = graph.groupBy(F.col("parent").alias("pn")).agg(F.count("*").alias("outdegree"))
    own = header_index(headers).select(F.col("code").alias("pn")).distinct().withColumn("is_header", F.lit(True))
    j = ins.join(outs, "pn", "full").join(own, "pn", "full")
    j = j.select("pn", F.coalesce("is_header", F.lit(False)).alias("is_header"), F.coalesce("indegree", F.lit(0)).alias("indegree"), F.coalesce("outdegree", F.lit(0)).alias("outdegree"))
    return j.orderBy(F.desc("indegree"), F.desc("outdegree"), "pn").limit(most) if most else j


def roots(graph: DataFrame, headers: DataFrame) -> DataFrame:
    """Header codes that are nobody's child."""
    return header_index(headers).select("code").distinct().join(graph.select(F.col("child").alias("code")).distinct().hint("merge"), "code", "left_anti")


def reach(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """start, code: all codes reachable from each start, itself included.

    Each level is a table of its own, held against all before it; none is written twice.  The graph is
    read from a table at every level, and no level is sent to the driver.
    """
    graph = stored(graph.select("parent", "child"), "graph").hint("merge")
    seen = frontier = stored(starts.select(F.col("code").alias("start"), "code").distinct(), "reach")
    while True:
        step = frontier.hint("merge").join(graph, F.col("code") == F.col("parent")).select("start", F.col("child").alias("code")).distinct()
        frontier = stored(step.join(seen.hint("merge"), ["start", "code"], "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def reach_counts(graph: DataFrame, headers: DataFrame, starts: DataFrame) -> DataFrame:
    """code, reachable: how many header codes each of ``starts`` (code) leads to, itself included.

    Codes of one strongly connected part are one node.  Headers are numbered by code, and every node has the
    headers below it as words of 64 bits, only those with a bit; nodes whose children are done send theirs to their
    parents.  So a level moves words along edges, and no pair of a start and a code is ever a row.
    Nothing here is broadcast: such tables are packed well, so the size of their files says little.
    """
    parts = strong_components(graph)

    def node(df: DataFrame, column: str, name: str) -> DataFrame:
        own = parts.select(F.col("code").alias(column), F.col("head").alias("__head"))
        return df.join(own.hint("merge"), column, "left").withColumn(name, F.coalesce("__head", column)).drop("__head")

    edges = node(node(graph.select("parent", "child"), "parent", "above"), "child", "below")
    edges = stored(edges.where("above <> below").select("above", "below").distinct(), "node-edges")
    ends = stored(node(starts.select("code").distinct(), "code", "node"), "starts")
    numbered = ranked(header_index(headers).select("code").distinct(), [F.asc("code")]).select("code", (F.col("rank") - 1).alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n") % 64)
    bits = stored(node(numbered, "code", "node").select("node", F.floor(F.col("n") / 64).alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "reach-bits")
    while True:
        waiting = edges.select(F.col("above").alias("below")).distinct().withColumn("waits", F.lit(True))
        marked = stored(edges.join(waiting.hint("merge"), "below", "left"), "marked-edges")
        ready, edges = marked.where("waits is null"), marked.where("waits").select("above", "below")
        if ready.isEmpty():
            break
        sent = ready.hint("merge").join(bits.withColumnRenamed("node", "below"), "below").select(F.col("above").alias("node"), "word", "bits")
        # what was sent everywhere is only kept for starts
        wanted = marked.select(F.col("above").alias("node")).unionByName(ends.select("node")).distinct()
        bits = stored(bits.join(wanted.hint("merge"), "node", "left_semi").unionByName(sent).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "reach-bits")
    counted = ends.join(bits.hint("merge"), "node", "left").groupBy("code").agg(F.sum(F.bit_count("bits")).alias("n"))
    return counted.select("code", F.coalesce("n", F.lit(0)).alias("reachable"))


def rank_roots(graph: DataFrame, headers: DataFrame, folder_base: str = "") -> DataFrame:
    """code, folder_match, reachable (headers), outdegree, rank, score."""
    graph = stored(graph.select("parent", "child"), "graph")
    r = stored(roots(graph, headers), "roots")
    reached = reach_counts(graph, headers, r)
    outs = graph.groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("outdegree"))
    j = r.join(reached, "code", "left").join(outs, "code", "left").select("code", (F.col("code") == folder_base).cast("int").alias("folder_match"), F.coalesce("reachable", F.lit(0)).alias("reachable"), F.coalesce("outdegree", F.lit(0)).alias("outdegree"))
    scored = j.withColumn("score", F.col("folder_match") * 1000000 + F.col("reachable") * 1000 + F.col("outdegree"))
    return ranked(scored, [F.desc("folder_match"), F.desc("reachable"), F.desc("outdegree"), F.asc("code")])


def where_used(edges: DataFrame) -> DataFrame:
    """code, n_parents, parents."""
    return edges.select("parent", "child").distinct().groupBy(F.col("child").alias("code")).agg(F.count("*").alias("n_parents"), F.array_join(F.sort_array(F.collect_set("parent")), ";").alias("parents"))


def part_master(lines: DataFrame, key) -> DataFrame:
    """code, description, manufacturer, manufacturer_code: of each the longest text, the earliest on ties."""
    order = lambda c: F.struct(F.length(F.trim(c)), -F.col("seq"))
    best = lambda c: F.max_by(F.trim(F.col(c)), order(F.coalesce(c, F.lit("")))).alias(c)
    return lines.withColumn("code", key).where("code <> ''").groupBy("code").agg(best("description"), best("manufacturer"), best("manufacturer_code"))
