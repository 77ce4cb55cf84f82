"""Tables for people: explosion, totals, nodes without occurrence, code search, matching of names to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import alnum, match_score, norm, rev_in_text


def explosion_view(edges: DataFrame, master: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with description and manufacturer of the part master and the part's unit."""
    m = master.select(F.col("code").alias("child_code"), "description", "manufacturer")
    u = units.select(F.col("code").alias("child_code"), "uom")
    j = edges.join(m, "child_code", "left").join(u, "child_code", "left")
    return j.select("depth", "parent_code", "child_code", "child_rev", "qty", F.coalesce("uom", F.lit("")).alias("uom"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("manufacturer", F.lit("")).alias("manufacturer"))


def totals_view(totals: DataFrame, units: DataFrame, master: DataFrame) -> DataFrame:
    j = totals.select("code", "qty").join(units.select("code", "uom"), "code", "left").join(master.select("code", "description"), "code", "left")
    return j.select(F.col("code").alias("pn"), "qty", F.coalesce("uom", F.lit("")).alias("uom"), F.coalesce("description", F.lit("")).alias("description"))


def structure_only(rows_with_parents: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaves of the structure, other than its roots, that the explosion does not hold."""
    r = rows_with_parents.select("doc_id", "seq", "parent_seq", norm(F.col("code")).alias("code"))
    inner = r.where("parent_seq is not null").select("doc_id", F.col("parent_seq").alias("seq")).distinct()
    leaves = r.where("parent_seq is not null and code <> ''").join(inner, ["doc_id", "seq"], "left_anti")
    return leaves.join(edges.select(F.col("child_code").alias("code")).distinct(), "code", "left_anti").select("seq", "code")


def find_code(lines: DataFrame, headers: DataFrame, needle: str) -> DataFrame:
    hit = lines.where(norm(F.col("internal_code")) == needle.strip().upper())
    return hit.join(headers.select("bom_id", F.col("code").alias("header"), "revision"), "bom_id").select("bom_id", "header", "revision", "line_no", "description")


def subtree(edges: DataFrame, code: str) -> DataFrame:
    """Distinct parent, child on paths through ``code``, at or below it."""
    below = F.array_position("path", code)
    return edges.where((below > 0) & (below < F.size("path"))).select(F.col("parent_code").alias("parent"), F.col("child_code").alias("child")).distinct()


def digit_prefixes(c: Column, least: int) -> Column:
    """All different beginnings, of ``least`` digits or more, of the digit runs of a text."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r) >= least)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(least), F.length(r)), lambda n: F.substring(r, F.lit(1), n)))))


def prefix_index(targets: DataFrame, least: int) -> DataFrame:
    """prefix, key, best: of the targets (target, rev, keys) under each beginning and key the least (target, rev).

    One row for each beginning and key, however many targets share it; a longest common prefix
    is then the longest beginning that is found, and no two codes are ever held against each other.
    """
    each = targets.select("target", "rev", F.explode(F.array_distinct("keys")).alias("key"), digit_prefixes(F.col("target"), least).alias("p"))
    return each.select("key", F.explode("p").alias("prefix"), F.struct("target", "rev").alias("best")).groupBy("prefix", "key").agg(F.min("best").alias("best"))


#: Keys of targets whatever their revision, and of those that have one; no revision is spelled so.
_ANY, _SOME = "*", "+"


def match_targets(files: DataFrame, targets: DataFrame, least: int = 6) -> DataFrame:
    """path, target, match_len, strength, score: the best target of each file name.

    A target with the file's revision is strong, one of no revision, or any for a file without, medium; the
    longest common beginning of digits counts next, then the least target.  A path is taken once.
    """
    own = alnum(F.col("rev"))
    index = prefix_index(targets.select("target", "rev", F.array(own, F.lit(_ANY)).alias("keys")), least)
    rev = alnum(rev_in_text(F.col("name")))
    keys = F.when(rev == "", F.array(F.struct(F.lit(_ANY).alias("key"), F.lit("MEDIUM").alias("strength")))).otherwise(
        F.array(F.struct(rev.alias("key"), F.lit("STRONG").alias("strength")), F.struct(F.lit("").alias("key"), F.lit("MEDIUM").alias("strength")))
    )
    asked = files.select("path", F.explode(keys).alias("k"), digit_prefixes(F.col("name"), least).alias("p")).select("path", "k.key", "k.strength", F.explode("p").alias("prefix"))
    found = asked.hint("merge").join(index.hint("merge"), ["prefix", "key"])  # both grow with the names: neither may be sent to every task
    n = F.length("prefix")
    best = F.min(F.struct((F.col("strength") != "STRONG").alias("weak"), (-n).alias("n"), F.col("best.target").alias("target"), F.col("best.rev").alias("rev"), "strength"))
    kept = found.groupBy("path").agg(best.alias("b")).select("path", "b.target", (-F.col("b.n")).alias("match_len"), "b.strength")
    return kept.withColumn("score", match_score(F.col("strength"), F.col("match_len")))


def verify_headers(headers: DataFrame, targets: DataFrame, least: int = 6) -> DataFrame:
    """bom_id, matched, reason, target, match_len; reasons by precedence MATCH, NO_NUMERIC_MATCH, REV_MISSING, REV_MISMATCH."""
    some = F.when(F.col("rev") != "", F.array("rev", F.lit(_ANY), F.lit(_SOME))).otherwise(F.array("rev", F.lit(_ANY)))
    index = prefix_index(targets.select("target", "rev", some.alias("keys")), least)
    hr = alnum(F.col("revision"))
    keys = F.array_distinct(F.array(hr, F.lit(""), F.lit(_ANY), F.lit(_SOME)))
    asked = headers.select("bom_id", hr.alias("hr"), keys.alias("keys"), digit_prefixes(F.col("code"), least).alias("p"))
    asked = asked.select("bom_id", "hr", F.explode("keys").alias("key"), "p").select("bom_id", "hr", "key", F.explode("p").alias("prefix"))
    fits = ~F.col("key").isin(_ANY, _SOME)
    a = asked.hint("merge").join(index.hint("merge"), ["prefix", "key"]).groupBy("bom_id").agg(
        F.min(F.when(fits, F.struct((-F.length("prefix")).alias("n"), F.col("best.target").alias("target")))).alias("b"), F.bool_or((F.col("key") == _SOME) & (F.col("hr") == "")).alias("absent")
    )
    out = headers.select("bom_id").join(a.withColumn("seen", F.lit(True)).hint("merge"), "bom_id", "left")
    reason = F.when(F.col("b").isNotNull(), "MATCH").when(F.col("seen").isNull(), "NO_NUMERIC_MATCH").when(F.col("absent"), "REV_MISSING").otherwise("REV_MISMATCH")
    return out.select("bom_id", F.col("b").isNotNull().alias("matched"), reason.alias("reason"), F.coalesce("b.target", F.lit("")).alias("target"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("match_len"))
