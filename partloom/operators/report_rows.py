"""Whole rows of the reports on resolution, diagnosis, chain breaks and children, from the findings that decide them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import looks_like_document, norm
from .reconcile import child_differences, judged_children
from .resolve import header_index, link_rows
from .similar import nearest_children


def _blank() -> Column:
    return F.lit("")


def trace_rows(traced: DataFrame, edges: DataFrame, headers: DataFrame) -> DataFrame:
    """The 13 columns of a resolution trace: those of ``reports.traces``, the parents that asked (a row for each), and the list taken.

    ``suspicious`` names every list of the same digits as ``code rev revision @ list``, joined by `` | ``.
    """
    asked = edges.select(F.lit("EXPLODE_CHILD").alias("context"), F.col("child_code").alias("expected_code"), F.col("child_rev").alias("expected_rev"), F.col("parent_code").alias("source_parent_code"), F.col("parent_rev").alias("source_parent_rev")).distinct()
    index = header_index(headers)
    taken = index.groupBy(F.col("code").alias("selected_code"), F.col("revision").alias("selected_rev")).agg(F.min_by("bom_id", "bom_seq").alias("selected_bom_id"))
    said = F.concat("code", F.lit(" rev "), "revision", F.lit(" @ "), "bom_id")
    near = traced.select("expected_code", F.explode("suspicious").alias("code")).distinct().join(index, "code").groupBy("expected_code").agg(F.array_join(F.array_sort(F.collect_set(said)), " | ").alias("near"))
    j = traced.join(asked, ["context", "expected_code", "expected_rev"], "left").join(taken, ["selected_code", "selected_rev"], "left").join(near, "expected_code", "left")
    filled = lambda c: F.coalesce(c, _blank()).alias(c)
    return j.select(
        "context", "expected_code", "expected_rev", filled("source_parent_code"), filled("source_parent_rev"), "n_candidates", filled("selected_bom_id"),
        "selected_code", "selected_rev", "outcome", "note", "suggestion", F.coalesce("near", _blank()).alias("suspicious"),
    )


def diagnosis_rows(diagnosis: DataFrame, classes: DataFrame) -> DataFrame:
    """The diagnosis with classification (ROOT, CASCADE or empty), root_chain_break (1, 0), cascade_depth and not_reached_by_root, as text."""
    c = classes.select("code", "kind", "root", "depth")
    by = F.when(F.col("kind") == "CASCADE", F.col("root"))
    flag = F.when(F.col("kind") == "ROOT", "1").when(F.col("kind") == "CASCADE", "0")
    return diagnosis.join(c, "code", "left").select(
        *diagnosis.columns, F.coalesce("kind", _blank()).alias("classification"), F.coalesce(flag, _blank()).alias("root_chain_break"),
        F.coalesce(F.col("depth").cast("string"), _blank()).alias("cascade_depth"), F.coalesce(by, _blank()).alias("not_reached_by_root"),
    )


def break_rows(reasons: DataFrame, diagnosis: DataFrame, effective: DataFrame) -> DataFrame:
    """The nine columns of a chain break's root: its revision and place by its diagnosis, if it has one, its effective children, impact, reason and suggestion."""
    d = diagnosis.select("code", "rev", "parent", "parent_rev", "pos")
    j = reasons.join(d, "code", "left").join(effective.select("code", F.col("most").alias("children")), "code", "left")
    filled = lambda c: F.coalesce(c, _blank()).alias(c)
    return j.select("code", filled("rev"), filled("parent"), filled("parent_rev"), filled("pos"), F.coalesce("children", F.lit(0)).alias("children"), "impacted", "reason", "suggestion")


def mismatch_rows(parents: DataFrame, headers: DataFrame, lines: DataFrame, reached: DataFrame, unexploded_codes: DataFrame) -> DataFrame:
    """The twelve columns of a difference between a parent's children in the structure and in its list, a row for each list.

    Missing children name the extra one that is one edit away, if any; extra children that are near
    a missing one (one edit, or six digits) are rows of their own, with their positions.  ``parent_seq`` is the parent's last row.
    """
    d = child_differences(parents, headers, lines)
    missing = d.where("side = 'MISSING_IN_BOM'").select("parent", F.col("child").alias("other"))
    extra = d.where("side = 'EXTRA_IN_BOM'").select("parent", F.col("child").alias("code"))
    judged = judged_children(parents, headers, lines, reached, unexploded_codes)
    rows = parents.select(norm(F.col("code")).alias("parent"), "seq").groupBy("parent").agg(F.max("seq").alias("parent_seq"))
    links = link_rows(parents, headers).where("status = 'OK'").select(F.col("code").alias("parent"), F.col("rev").alias("parent_rev"), "bom_id").distinct().join(rows, "parent")
    place = F.when(F.col("cascade"), "CASCADE").otherwise("ROOT").alias("place")
    similar = nearest_children(missing.withColumnRenamed("other", "code"), extra.withColumnRenamed("code", "other")).where("distance is not null").select("parent", F.col("code").alias("child"), "other", "distance")
    optional = F.col("optional")
    lacking = judged.join(similar, ["parent", "child"], "left").select(
        "parent", F.when(optional | F.col("cascade"), "WARN").otherwise("ERROR").alias("severity"), F.when(optional, "CHILD_MISSING_IN_BOM_OPTIONAL").otherwise("CHILD_MISSING_IN_BOM").alias("category"), place,
        F.col("child").alias("structure_child"), _blank().alias("list_child"), F.coalesce(F.concat(F.lit("the list has "), "other", F.lit(", edits: "), F.col("distance").cast("string")), _blank()).alias("suggestion"),
        F.when(optional, "quantity 0 in the structure").otherwise("").alias("note"),
    )
    near = nearest_children(extra, missing).where(~looks_like_document(F.col("other")))
    said = F.when(F.col("distance").isNotNull(), F.concat(F.lit("write "), "other", F.lit(", edits: "), F.col("distance").cast("string"))).otherwise(F.concat(F.lit("may be "), "other", F.lit(", digits alike: "), F.col("digits").cast("string")))
    typos = near.join(judged.select("parent", "cascade").distinct(), "parent").select(
        "parent", F.when(F.col("cascade"), "WARN").otherwise("ERROR").alias("severity"), F.lit("TYPO_SUSPECT_CHILD_MISMATCH").alias("category"), place,
        _blank().alias("structure_child"), F.col("code").alias("list_child"), said.alias("suggestion"), _blank().alias("note"),
    )
    at = lines.where("kind <> 'DOCUMENT_REF'").groupBy("bom_id", norm(F.col("internal_code")).alias("list_child")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda n: n.cast("string")), ";").alias("positions"))
    return lacking.unionByName(typos).join(links, "parent").join(at, ["bom_id", "list_child"], "left").select(
        "severity", "category", "place", "parent", "parent_rev", "parent_seq", "bom_id", "structure_child", "list_child", F.coalesce("positions", _blank()).alias("positions"), "suggestion", "note",
    )
