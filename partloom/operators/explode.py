"""Explosion of component lists from a root, along all paths.

One frontier of open lists per level, joined with the adjacency (lines with the list that their
child resolves to); each level is a stored table, so lineage stays short and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_pn, norm, unit
from ..plans.tables import stored
from .components import strong_components
from .resolve import header_index, resolve


@dataclass(frozen=True)
class Policy:
    explode_documents: bool = False
    explode_unknown: bool = False
    #: lines of unknown kind whose description or type speaks of a procedure have a switch of their own
    explode_procedural: bool = False
    fallback: bool = True
    use_max_rev: bool = True
    root_strict_rev: bool = True
    #: pdf: keys hold the revision, lines without quantity are leaves of quantity zero
    pdf: bool = False
    kind: str = "decimal(38,12)"


@dataclass
class Explosion:
    """Tables of one explosion; ``visited`` has a row for each line met on each path.

    visited: depth, dfs_key, path, parent_code, parent_rev, child_code, child_rev, line_qty, qty
    (cumulative), unit, state (EDGE, CYCLE, MISSING_QTY, NON_POSITIVE), bom_id, next_bom_id, outcome.
    """

    visited: DataFrame
    headers: DataFrame
    pdf: bool = False

    def edges(self) -> DataFrame:
        if self.pdf:  # a line without quantity is a leaf of quantity zero
            met = self.visited.where(F.col("state").isin("EDGE", "MISSING_QTY"))
            return met.withColumn("qty", F.when(F.col("state") == "EDGE", F.col("qty")).otherwise(F.lit(0).cast(self.visited.schema["qty"].dataType)))
        return self.visited.where("state = 'EDGE'")

    def totals(self) -> DataFrame:
        """code, qty, visits, max_depth: a closing line of a cycle counts, but is no edge."""
        met = self.visited.where(F.col("state").isin("EDGE", "CYCLE"))
        return met.groupBy(F.col("child_code").alias("code")).agg(F.sum("qty").alias("qty"), F.count("*").alias("visits"), F.max("depth").alias("max_depth"))

    def totals_by_rev(self) -> DataFrame:
        met = self.visited.where(F.col("state").isin("EDGE", "CYCLE"))
        return met.groupBy(F.col("child_code").alias("code"), F.col("child_rev").alias("rev")).agg(F.sum("qty").alias("qty"))

    def units(self) -> DataFrame:
        """code, uom (first in path order that is not empty), other (any unit but pieces)."""
        met = self.visited.where("unit <> ''")
        return met.groupBy(F.col("child_code").alias("code")).agg(F.min_by("unit", "dfs_key").alias("uom"), F.bool_or(F.col("unit") != "NR").alias("other"))

    def missing(self) -> DataFrame:
        return self.visited.where("state = 'MISSING_QTY'")

    def cycles(self) -> DataFrame:
        return self.visited.where("state = 'CYCLE'")

    def exploded(self) -> DataFrame:
        """code, rev of the lists that were entered."""
        entered = self.visited.select("bom_id").unionByName(self.visited.where("state = 'EDGE' and next_bom_id is not null").select(F.col("next_bom_id").alias("bom_id"))).distinct()
        return entered.join(header_index(self.headers), "bom_id").select("code", F.col("revision").alias("rev")).distinct()

    def missing_lists(self) -> DataFrame:
        """Codes met as an edge whose list could not be chosen though some list has the code."""
        known = header_index(self.headers).select(F.col("code").alias("child_code")).distinct()
        return self.visited.where("state = 'EDGE' and next_bom_id is null").select("child_code").distinct().join(known, "child_code", "left_semi").select(F.col("child_code").alias("code"))


# Parts of descriptions and types of procedures.
PROCEDURE_WORDS, PROCEDURE_TYPES = ("PROCEDURA", "PRESCRIZ", "ISTRUZ", "OPERATIV"), ("DOC", "PROC", "PRESCR")


def eligible_lines(lines: DataFrame, policy: Policy) -> DataFrame:
    procedural = F.rlike(norm(F.col("description")), F.lit("|".join(PROCEDURE_WORDS))) | F.rlike(norm(F.col("type")), F.lit("|".join(PROCEDURE_TYPES)))
    kind = F.col("kind")
    unknown = F.when(procedural, F.lit(policy.explode_procedural)).otherwise(F.lit(policy.explode_unknown))
    fits = F.when(kind == "DOCUMENT_REF", F.lit(policy.explode_documents)).when(kind == "UNKNOWN", unknown).otherwise(kind == "MATERIAL")
    return lines.where((norm(F.col("internal_code")) != "") & fits)


def _resolved_lines(lines: DataFrame, headers: DataFrame, revs: DataFrame | None, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Eligible lines with child key, own quantity and the list that the child resolves to; the distinct (code, rev) of their children."""
    chosen = eligible_lines(lines, policy).withColumn("child_code", norm(F.col("internal_code")))
    if revs is not None:
        chosen = chosen.join(revs.select(F.col("code").alias("child_code"), F.col("rev").alias("structure_rev")), "child_code", "left")
    else:
        chosen = chosen.withColumn("structure_rev", F.lit(None).cast("string"))
    if policy.pdf:
        rev = F.coalesce(F.nullif("structure_rev", F.lit("")), norm(F.col("rev")))
        chosen = chosen.withColumn("child_rev", rev).withColumn("child_code", canonical_pn(F.col("internal_code"), rev))
    else:
        chosen = chosen.withColumn("child_rev", F.coalesce("structure_rev", F.lit("")))
    # a table: the lines are read three times from here, and their own plan is a long one
    chosen = stored(chosen.select("bom_id", "line_no", "child_code", "child_rev", F.col("qty").cast(policy.kind).alias("line_qty"), unit(F.col("unit")).alias("unit")), "chosen-lines")
    wanted = stored(chosen.select(F.col("child_code").alias("code"), F.col("child_rev").alias("rev")).distinct(), "wanted-lists")
    solved = resolve(wanted, headers, policy.fallback, policy.use_max_rev).select(F.col("code").alias("child_code"), F.col("rev").alias("child_rev"), F.col("bom_id").alias("next_bom_id"), "outcome")
    return chosen.join(solved.hint("merge"), ["child_code", "child_rev"], "left"), wanted


def adjacency(lines: DataFrame, headers: DataFrame, revs: DataFrame | None, policy: Policy) -> DataFrame:
    """Eligible lines with their parent, child key, own quantity and the list that the child resolves to."""
    out, _ = _resolved_lines(lines, headers, revs, policy)
    parents = header_index(headers).select("bom_id", F.col("code").alias("parent_code"), F.col("revision").alias("parent_rev"))
    return out.join(parents.hint("merge"), "bom_id").select("bom_id", "parent_code", "parent_rev", "line_no", "child_code", "child_rev", "line_qty", "unit", "next_bom_id", "outcome")


def _start(spark: SparkSession, headers: DataFrame, root_code: str, root_rev: str, policy: Policy) -> DataFrame:
    """The list of the root; other codes decide nothing but why there is none."""
    root = spark.createDataFrame([(root_code, root_rev)], "code string, rev string")
    # tables of few rows: all lists are read once, and what is joined with the root is seen to be small
    own = stored(headers.join(F.broadcast(root.select(norm(F.col("code")).alias("code"))), "code", "left_semi"), "root-lists")
    return stored(resolve(root, own, policy.fallback and not (root_rev and policy.root_strict_rev), policy.use_max_rev), "start")


def explode(spark: SparkSession, lines: DataFrame, headers: DataFrame, root_code: str, root_rev: str = "", revs: DataFrame | None = None, policy: Policy = Policy()) -> Explosion:
    """All lines on all paths from the list of (``root_code``, ``root_rev``).

    A root that no list resolves gives empty tables.  A child that is already on the path closes a
    cycle and is not entered.
    """
    headers = stored(header_index(headers), "headers")
    edges = stored(adjacency(lines, headers, revs, policy), "adjacency")
    start = _start(spark, headers, root_code, root_rev, policy)
    frontier = start.where("bom_id is not null").select(
        F.col("bom_id"), F.lit(1).cast(policy.kind).alias("multiplier"), F.array("code").alias("path"), F.array().cast("array<int>").alias("dfs_key")
    )
    levels, depth = [], 0
    while True:
        depth += 1
        met = frontier.join(edges, "bom_id")
        on_path = F.array_contains("path", F.col("child_code"))
        missing = F.when(on_path & F.lit(policy.pdf), "CYCLE_WITHOUT_QTY").otherwise("MISSING_QTY")
        state = F.when(F.col("line_qty").isNull(), missing).when(F.col("line_qty") <= 0, "NON_POSITIVE").when(on_path, "CYCLE").otherwise("EDGE")
        rows = met.select(
            F.lit(depth).alias("depth"), F.concat("dfs_key", F.array(F.col("line_no").cast("int"))).alias("dfs_key"), F.concat("path", F.array("child_code")).alias("path"),
            "parent_code", "parent_rev", "child_code", "child_rev", "line_qty", (F.col("multiplier") * F.col("line_qty")).cast(policy.kind).alias("qty"), "unit", state.alias("state"), "bom_id", "next_bom_id", "outcome",
        )
        level = stored(rows, f"level-{depth}")
        levels.append(level)
        frontier = level.where("state = 'EDGE' and next_bom_id is not null").select(F.col("next_bom_id").alias("bom_id"), F.col("qty").alias("multiplier"), "path", "dfs_key")
        if frontier.isEmpty():
            break
    visited = levels[0]
    for level in levels[1:]:
        visited = visited.unionByName(level)
    return Explosion(visited, headers, policy.pdf)


@dataclass
class Sums:
    """What an explosion adds up to, without its paths; ``met`` has a row for each line, level and way through a cyclic part.

    met: depth, child_code, child_rev, unit, state, bom_id, next_bom_id, qty (summed), visits, dfs_key (the least).
    """

    met: DataFrame
    headers: DataFrame

    def totals(self) -> DataFrame:
        """code, qty, visits, max_depth, as ``Explosion.totals``."""
        counted = self.met.where(F.col("state").isin("EDGE", "CYCLE"))
        return counted.groupBy(F.col("child_code").alias("code")).agg(F.sum("qty").alias("qty"), F.sum("visits").alias("visits"), F.max("depth").alias("max_depth"))

    def totals_by_rev(self) -> DataFrame:
        counted = self.met.where(F.col("state").isin("EDGE", "CYCLE"))
        return counted.groupBy(F.col("child_code").alias("code"), F.col("child_rev").alias("rev")).agg(F.sum("qty").alias("qty"))

    def units(self) -> DataFrame:
        """code, uom (of the first line in path order that has one), other (any unit but pieces)."""
        named = self.met.where("unit <> ''")
        return named.groupBy(F.col("child_code").alias("code")).agg(F.min_by("unit", "dfs_key").alias("uom"), F.bool_or(F.col("unit") != "NR").alias("other"))

    def exploded(self) -> DataFrame:
        """code, rev of the lists that were entered."""
        entered = self.met.select("bom_id").unionByName(self.met.where("state = 'EDGE' and next_bom_id is not null").select(F.col("next_bom_id").alias("bom_id"))).distinct()
        return entered.join(header_index(self.headers), "bom_id").select("code", F.col("revision").alias("rev")).distinct()


def explode_sums(spark: SparkSession, lines: DataFrame, headers: DataFrame, root_code: str, root_rev: str = "", revs: DataFrame | None = None, policy: Policy = Policy()) -> Sums:
    """``explode`` added up: ways into one list are one row of a level, however many there are.

    Only codes of one strongly connected part can come back on a path, so a path is kept only inside such
    a part, from where it was entered; left behind, it is forgotten.  Rows of a level are at most
    the lists outside of cyclic parts plus the simple paths inside them.  Products are summed before
    they are multiplied on, which gives the same totals while quantities have at most 12 decimals.
    """
    headers = stored(header_index(headers), "headers")
    edges = stored(adjacency(lines, headers, revs, policy), "adjacency")
    start = _start(spark, headers, root_code, root_rev, policy)
    start = start.where("bom_id is not null").select("code", "bom_id")
    entered = edges.where("next_bom_id is not null").select(F.col("child_code").alias("parent"), F.col("next_bom_id").alias("bom_id")).unionByName(start.withColumnRenamed("code", "parent")).distinct()
    parts = strong_components(entered.join(edges, "bom_id").select("parent", F.col("child_code").alias("child")))
    parts = stored(parts.select(F.col("code").alias("child_code"), F.col("head").alias("child_part")), "parts")
    none, one = F.array().cast("array<string>"), F.lit(1).cast("long")
    frontier = start.join(parts.withColumnRenamed("child_code", "code"), "code", "left").select(
        "bom_id", F.col("child_part").alias("part"), F.when(F.col("child_part").isNotNull(), F.array("code")).otherwise(none).alias("way"), F.lit(1).cast(policy.kind).alias("multiplier"), one.alias("ways"), F.array().cast("array<int>").alias("key")
    )
    levels, depth = [], 0
    while True:
        depth += 1
        seen = frontier.join(edges, "bom_id").join(parts, "child_code", "left")
        on_path = F.array_contains("way", F.col("child_code"))
        missing = F.when(on_path & F.lit(policy.pdf), "CYCLE_WITHOUT_QTY").otherwise("MISSING_QTY")
        state = F.when(F.col("line_qty").isNull(), missing).when(F.col("line_qty") <= 0, "NON_POSITIVE").when(on_path, "CYCLE").otherwise("EDGE")
        onward = F.when(F.col("child_part").isNull(), none).when(F.col("child_part") == F.col("part"), F.concat("way", F.array("child_code"))).otherwise(F.array("child_code"))
        rows = seen.select(
            "child_code", "child_rev", "unit", "bom_id", "next_bom_id", F.col("child_part").alias("part"), onward.alias("way"), state.alias("state"), "ways",
            (F.col("multiplier") * F.col("line_qty")).cast(policy.kind).alias("qty"), F.concat("key", F.array(F.col("line_no").cast("int"))).alias("key"),
        )
        summed = rows.groupBy("child_code", "child_rev", "unit", "bom_id", "next_bom_id", "part", "way", "state").agg(F.sum("qty").cast(policy.kind).alias("qty"), F.sum("ways").alias("visits"), F.min("key").alias("dfs_key"))
        level = stored(summed.withColumn("depth", F.lit(depth)), f"sums-{depth}")
        levels.append(level.drop("part", "way"))
        further = level.where("state = 'EDGE' and next_bom_id is not null")
        frontier = further.groupBy(F.col("next_bom_id").alias("bom_id"), "part", "way").agg(F.sum("qty").cast(policy.kind).alias("multiplier"), F.sum("visits").alias("ways"), F.min("dfs_key").alias("key"))
        if further.isEmpty():
            break
    met = levels[0]
    for level in levels[1:]:
        met = met.unionByName(level)
    return Sums(met, headers)


@dataclass
class Reach:
    """What an explosion meets, without paths; ``met`` has a row for each (child_code, child_rev) of its edges."""

    met: DataFrame
    headers: DataFrame


#: A frontier of more lists is joined by shuffles: small files of lists are large in the driver's memory.
_FEW = 100_000


def explode_reach(spark: SparkSession, lines: DataFrame, headers: DataFrame, root_code: str, root_rev: str = "", revs: DataFrame | None = None, policy: Policy = Policy()) -> Reach:
    """The distinct children of the edges of ``explode``: a list is entered once, however many paths lead to it.

    Where a path comes back to a code that leads to one list only, the way between can be left out
    and what follows is met all the same.  So a way remembers just the root and codes asked for in
    several revisions; a list is entered once for each set of those.
    """
    headers = stored(header_index(headers), "headers")
    resolved, wanted = _resolved_lines(lines, headers, revs, policy)
    several = wanted.groupBy(F.col("code").alias("child_code")).agg(F.count("*").alias("n")).where("n > 1").select("child_code", F.lit(True).alias("several"))
    edges = resolved.where("line_qty > 0").select("bom_id", "child_code", "child_rev", "next_bom_id")
    # most structures name one revision for a code; all lines are joined only where some name more
    marked = edges.withColumn("several", F.lit(None).cast("boolean")) if several.isEmpty() else edges.join(several.hint("merge"), "child_code", "left")
    edges = stored(marked.select("bom_id", "child_code", "child_rev", "next_bom_id", F.coalesce("several", F.lit(False)).alias("several")), "reach-edges")
    start = _start(spark, headers, root_code, root_rev, policy)
    onward = edges.where("next_bom_id is not null")
    frontier = stored(start.where("bom_id is not null").select("bom_id", F.array("code").alias("way")), "reached")
    seen, n = frontier, frontier.count()
    met = lambda at, lines: at.join(lines, "bom_id").where(~F.array_contains("way", F.col("child_code")))
    while n:
        way = F.when(F.col("several"), F.array_sort(F.concat("way", F.array("child_code")))).otherwise(F.col("way"))
        step = met(frontier if n <= _FEW else frontier.hint("merge"), onward).select(F.col("next_bom_id").alias("bom_id"), way.alias("way")).distinct()
        frontier = stored(step.join(seen.hint("merge"), ["bom_id", "way"], "left_anti"), "reached")
        n = frontier.count()
        seen = seen.unionByName(frontier)
    return Reach(met(seen.hint("merge"), edges).select("child_code", "child_rev").distinct(), headers)


def explode_totals(edges: DataFrame, root: DataFrame) -> DataFrame:
    """code, qty, visits, max_depth by levels of summed codes, without paths.

    ``edges`` (parent, child, qty) must be free of cycles: the rows of a level are at most the
    codes, however many paths there are.  Raises if a level beyond the number of codes is reached.
    """
    edges = stored(edges.groupBy("parent", "child").agg(F.sum("qty").alias("qty"), F.count("*").alias("ways")), "edges")
    frontier, levels, depth, most = root.select(F.col("code").alias("parent"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("paths")), [], 0, None
    while True:
        depth += 1
        step = frontier.join(edges, "parent").groupBy("child").agg(F.sum(F.col("n") * F.col("qty")).cast("long").alias("qty"), F.sum(F.col("paths") * F.col("ways")).cast("long").alias("visits"))
        level = stored(step.withColumn("depth", F.lit(depth)), f"totals-{depth}")
        if level.isEmpty():
            break
        if depth > 64:
            most = most or edges.select("child").distinct().count()
            if depth > most:
                raise ValueError("the structure has a cycle")
        levels.append(level)
        frontier = level.select(F.col("child").alias("parent"), F.col("qty").alias("n"), F.col("visits").alias("paths"))
    if not levels:
        return edges.where("false").select(F.col("child").alias("code"), F.lit(0).cast("long").alias("qty"), F.lit(0).cast("long").alias("visits"), F.lit(0).alias("max_depth"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.groupBy(F.col("child").alias("code")).agg(F.sum("qty").alias("qty"), F.sum("visits").alias("visits"), F.max("depth").alias("max_depth"))
