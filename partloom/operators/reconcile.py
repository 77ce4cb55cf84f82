"""Explosion, structure and external totals held against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import alnum, looks_like_document, norm
from .resolve import header_index, link_rows, rev_conflicts
from .similar import near_codes, variants

TOLERANCE = 1e-4


def load_totalization(cells: DataFrame) -> DataFrame:
    """pn, qty, n_rows, samples: valid rows summed by part number; up to five of their sheet rows.

    Valid: the code holds a letter, the quantity is a positive number and no formula.
    """
    from ..functions.keys import quantity

    q = F.when(F.startswith(F.col("qty").cast("string"), F.lit("=")), None).otherwise(quantity(F.col("qty"), "decimal(38,12)"))
    rows = cells.select("sheet_row", norm(F.col("code")).alias("pn"), q.alias("qty")).where(F.rlike("pn", F.lit("[A-Z]")) & (F.col("qty") > 0))
    # the five least rows of each code are cut down in every task before they meet
    first = F.row_number().over(Window.partitionBy("pn").orderBy("sheet_row"))
    few = rows.select("pn", "sheet_row").withColumn("__r", first).where("__r <= 5").groupBy("pn").agg(F.sort_array(F.collect_list("sheet_row")).alias("samples"))
    return rows.groupBy("pn").agg(F.sum("qty").alias("qty"), F.count("*").alias("n_rows")).join(few, "pn")


def _note(status: Column) -> Column:
    said = {"SKIPPED_NON_NR": "unit is not a piece", "ERROR_EXTRA_IN_TOTAL": "not in the explosion", "ERROR_MISSING_IN_TOTAL": "not in the totals", "WARN_QTY_MISMATCH": "quantities differ"}
    out = F.lit("")
    for name, text in said.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def validate_totals(bom: DataFrame, total: DataFrame, units: DataFrame) -> DataFrame:
    """pn, uom, qty_bom, qty_total, status, note over the union of part numbers.

    ``bom`` and ``total`` (pn, qty); ``units`` (pn, uom, other: any unit but pieces).  Part numbers
    of all three are brought to letters and digits, and what then is one part is summed.
    """
    summed = lambda df, name: df.groupBy(alnum(F.col("pn")).alias("pn")).agg(F.sum("qty").alias(name))
    u = units.groupBy(alnum(F.col("pn")).alias("pn")).agg(F.min_by("uom", F.struct(F.length("pn"), "pn")).alias("uom"), F.bool_or("other").alias("other"))
    j = summed(bom, "qty_bom").join(summed(total, "qty_total"), "pn", "full").join(u, "pn", "left")
    piece = F.coalesce("uom", F.lit("NR")) == "NR"
    status = (
        F.when(F.coalesce("other", F.lit(False)), "SKIPPED_NON_NR")
        .when(F.col("qty_bom").isNull(), "ERROR_EXTRA_IN_TOTAL")
        .when(F.col("qty_total").isNull(), F.when((F.col("qty_bom") > 0) & piece, "ERROR_MISSING_IN_TOTAL").otherwise("OK"))
        .when(F.abs(F.col("qty_bom") - F.col("qty_total")) > TOLERANCE, "WARN_QTY_MISMATCH")
        .otherwise("OK")
    )
    return j.select("pn", F.when(F.coalesce("other", F.lit(False)), F.coalesce(F.nullif("uom", F.lit("")), F.lit("?"))).otherwise(F.coalesce("uom", F.lit(""))).alias("uom"), "qty_bom", "qty_total", status.alias("status"), _note(status).alias("note"))


def introduced(exploded_codes: DataFrame, rows: DataFrame) -> DataFrame:
    """Codes of the explosion that the structure does not have."""
    return exploded_codes.select("code").distinct().join(rows.select(norm(F.col("code")).alias("code")).distinct(), "code", "left_anti")


def unexploded(rows: DataFrame, headers: DataFrame, exploded: DataFrame) -> DataFrame:
    """Codes of the structure that have a component list which was never entered."""
    codes = rows.select(norm(F.col("code")).alias("code")).where("code <> ''").distinct()
    return codes.join(header_index(headers).select("code").distinct(), "code", "left_semi").join(exploded.select("code").distinct(), "code", "left_anti")


def rev_differences(rows: DataFrame, exploded: DataFrame) -> DataFrame:
    """code, structure_rev, exploded_rev where both are given and differ."""
    named = rows.select(norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("structure_rev")).distinct()
    return named.join(exploded.select("code", F.col("rev").alias("exploded_rev")), "code").where("structure_rev <> '' and exploded_rev <> '' and structure_rev <> exploded_rev")


def completeness(rows: DataFrame, headers: DataFrame, totals: DataFrame, exploded: DataFrame) -> DataFrame:
    """kind, code: INTRODUCED, UNEXPLODED, REV_CONFLICT and REV_MISMATCH findings in one table."""
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "code").distinct()
    return (
        tag(introduced(totals, rows), "INTRODUCED")
        .unionByName(tag(unexploded(rows, headers, exploded), "UNEXPLODED"))
        .unionByName(tag(rev_conflicts(rows), "REV_CONFLICT"))
        .unionByName(tag(rev_differences(rows, exploded), "REV_MISMATCH"))
    )


def child_differences(parents: DataFrame, headers: DataFrame, lines: DataFrame) -> DataFrame:
    """parent, child, side (MISSING_IN_BOM, EXTRA_IN_BOM): children of linked parents, documents left out.

    ``parents``: structure rows with parent_seq.
    """
    links = link_rows(parents, headers).where("status = 'OK'").select("doc_id", F.col("seq").alias("parent_seq"), F.col("code").alias("parent"), "bom_id")
    own = parents.select("doc_id", "parent_seq", norm(F.col("code")).alias("child")).where(~looks_like_document(F.col("child")) & (F.col("child") != ""))
    left = own.join(links, ["doc_id", "parent_seq"]).select("parent", "child").distinct()
    listed = lines.where("kind <> 'DOCUMENT_REF'").select("bom_id", norm(F.col("internal_code")).alias("child")).where(~looks_like_document(F.col("child")) & (F.col("child") != ""))
    right = listed.join(links.select("bom_id", "parent").distinct(), "bom_id").select("parent", "child").distinct()
    keys = ["parent", "child"]
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("MISSING_IN_BOM")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("EXTRA_IN_BOM")))


def digit_prefix(a: Column, b: Column) -> Column:
    from ..functions.keys import common_prefix

    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return common_prefix(bare(a), bare(b))


def typo_suspects(differences: DataFrame) -> DataFrame:
    """parent, missing, extra, distance: the nearest extra child within one edit, else by six common digits."""
    m = differences.where("side = 'MISSING_IN_BOM'").select("parent", F.col("child").alias("missing"))
    e = differences.where("side = 'EXTRA_IN_BOM'").select("parent", F.col("child").alias("extra"))
    j = m.join(e, "parent").withColumn("distance", F.expr("levenshtein(missing, extra, 1)"))
    near = j.where((F.col("distance") >= 0) | (digit_prefix(F.col("missing"), F.col("extra")) >= 6)).withColumn("distance", F.when(F.col("distance") >= 0, F.col("distance")).otherwise(2))
    return near.groupBy("parent", "missing").agg(F.min(F.struct("distance", "extra")).alias("b")).select("parent", "missing", "b.extra", "b.distance")


def judged_children(parents: DataFrame, headers: DataFrame, lines: DataFrame, reached: DataFrame, unexploded_codes: DataFrame) -> DataFrame:
    """parent, child, optional, cascade, extra (a similar child of the list, or null) of structure children that the parent's list lacks."""
    from .tree import ancestors

    d = child_differences(parents, headers, lines)
    missing, typos = d.where("side = 'MISSING_IN_BOM'"), typo_suspects(d)
    qty = parents.select(norm(F.col("code")).alias("child"), "seq", "qty").groupBy("child").agg(F.max_by("qty", "seq").alias("q"))
    chain = ancestors(parents).where("distance > 0").join(parents.select("doc_id", F.col("seq").alias("ancestor_seq"), norm(F.col("code")).alias("above")), ["doc_id", "ancestor_seq"])
    under = chain.join(unexploded_codes.select(F.col("code").alias("above")), "above", "left_semi").join(parents.select("doc_id", "seq", norm(F.col("code")).alias("parent")), ["doc_id", "seq"]).select("parent").distinct().withColumn("under", F.lit(True))
    j = missing.join(qty, "child", "left").join(typos.select("parent", F.col("missing").alias("child"), "extra"), ["parent", "child"], "left")
    j = j.join(reached.select(F.col("code").alias("parent")).distinct().withColumn("hit", F.lit(True)), "parent", "left").join(under, "parent", "left")
    return j.select("parent", "child", (F.coalesce("q", F.lit(0.0)) == 0).alias("optional"), (F.col("hit").isNull() | F.coalesce("under", F.lit(False))).alias("cascade"), "extra")


def parent_child_mismatches(parents: DataFrame, headers: DataFrame, lines: DataFrame, reached: DataFrame, unexploded_codes: DataFrame) -> DataFrame:
    """parent, child, severity, category, place (ROOT or CASCADE), similar.

    ``reached``: codes of the explosion's parents and its root.  A parent is CASCADE if it was not
    reached, or if some code above it was not exploded.
    """
    j = judged_children(parents, headers, lines, reached, unexploded_codes)
    return j.select(
        "parent", "child", F.when(F.col("optional") | F.col("cascade"), "WARN").otherwise("ERROR").alias("severity"),
        F.when(F.col("extra").isNotNull(), "TYPO_SUSPECT_CHILD_MISMATCH").when(F.col("optional"), "CHILD_MISSING_IN_BOM_OPTIONAL").otherwise("CHILD_MISSING_IN_BOM").alias("category"),
        F.when(F.col("cascade"), "CASCADE").otherwise("ROOT").alias("place"), F.coalesce("extra", F.lit("")).alias("similar"),
    )


def diagnose_unexploded(codes: DataFrame, effective: DataFrame, reached: DataFrame, occurring: DataFrame, exploded: DataFrame, revs: DataFrame, traced: DataFrame | None = None, missing_lists: DataFrame | None = None) -> DataFrame:
    """code, rev, reason, candidate, parent, parent_rev, pos, note of each unexploded code; the first rule that fits decides.

    ``effective`` (code, total): direct children of positive quantity; ``reached`` (code): children
    of the explosion; ``occurring`` (code, parent, parent_rev, pos, seq): lines of all lists in
    order; ``exploded`` (code); ``revs`` (code, rev) of the structure; ``traced``: resolution
    traces; ``missing_lists`` (code): lists that exist and could not be chosen.
    """
    spark = codes.sparkSession
    done = exploded.select("code").distinct().withColumn("done", F.lit(True))
    at = occurring.join(done.select(F.col("code").alias("parent"), F.col("done").alias("parent_done")), "parent", "left")
    place = F.struct("seq", "parent", "parent_rev", "pos")
    open_place = F.min(F.when(F.col("parent_done").isNull(), place))
    first = at.groupBy("code").agg(F.min(place).alias("first"), open_place.alias("open"))
    known = occurring.select("code").distinct()
    wanted = codes.select("code").distinct()
    variant = variants(wanted, known)
    typo = near_codes(wanted, known).groupBy("code").agg(F.min(F.struct("d", (-F.col("ratio")).alias("ratio"), "other")).alias("typo"))
    j = wanted.join(effective.select("code", "total"), "code", "left").join(reached.select("code").distinct().withColumn("hit", F.lit(True)), "code", "left")
    j = j.join(done, "code", "left").join(first, "code", "left").join(variant, "code", "left").join(typo, "code", "left").join(revs.select("code", "rev"), "code", "left")
    none = spark.createDataFrame([], "code string, unselectable boolean, asked string, taken string, fell boolean, ambiguous boolean")
    if traced is not None:
        child = traced.where("context = 'EXPLODE_CHILD'")
        bits = child.groupBy(F.col("expected_code").alias("code")).agg(
            F.min(F.when((F.col("outcome") == "FALLBACK") & (F.col("expected_rev") != ""), F.struct("expected_rev", "selected_rev"))).alias("m"),
            F.bool_or(F.col("outcome") == "FALLBACK").alias("fell"), F.bool_or(F.col("outcome") == "AMBIGUOUS").alias("ambiguous"),
        )
        lists = missing_lists.select("code").distinct().withColumn("unselectable", F.lit(True)) if missing_lists is not None else none.select("code", "unselectable")
        none = bits.join(lists, "code", "full").select("code", "unselectable", F.col("m.expected_rev").alias("asked"), F.col("m.selected_rev").alias("taken"), "fell", "ambiguous")
    j = j.join(none, "code", "left")
    hit, occurs, entered = F.col("hit").isNotNull(), F.col("first").isNotNull(), F.col("done").isNotNull()
    reason = (
        F.when(F.coalesce("total", F.lit(0)) == 0, "INFO_PBS_ONLY_ZERO_QTY_CHILDREN")
        .when(hit & ~entered, "REACHED_SELECTION_FAIL")
        .when(~hit & occurs, "NOT_REACHED_CHAIN_BREAK")
        .when(occurs, "REV_LOOKUP_FAIL")
        .when(F.col("variant").isNotNull(), "CODE_VARIANT")
        .when(F.col("typo").isNotNull(), "LIKELY_TYPO")
        .otherwise("MISSING_LINK")
    )
    d = j.withColumn("reason", reason)
    same = F.col("reason").isin("INFO_PBS_ONLY_ZERO_QTY_CHILDREN", "REACHED_SELECTION_FAIL", "NOT_REACHED_CHAIN_BREAK", "REV_LOOKUP_FAIL")
    candidate = F.when(same, F.col("code")).when(F.col("reason") == "CODE_VARIANT", F.col("variant.other")).when(F.col("reason") == "LIKELY_TYPO", F.col("typo.other"))
    elsewhere = first.select(F.col("code").alias("candidate"), F.col("first").alias("of_candidate"))
    d = d.withColumn("candidate", F.coalesce(candidate, F.lit(""))).join(elsewhere, "candidate", "left")
    own = F.when(F.col("reason") == "NOT_REACHED_CHAIN_BREAK", F.coalesce("open", "first")).when(F.col("reason") != "INFO_PBS_ONLY_ZERO_QTY_CHILDREN", F.col("of_candidate"))
    d = d.withColumn("place", own)
    said = F.concat_ws(
        "; ", F.when(F.col("unselectable"), "a list exists, none can be chosen"), F.when(F.col("asked").isNotNull(), F.concat(F.lit("revision "), "asked", F.lit(" asked, "), "taken", F.lit(" taken"))),
        F.when(F.col("fell"), "fallback"), F.when(F.col("ambiguous"), "several lists"),
    )
    note = (
        F.when(F.col("reason") == "INFO_PBS_ONLY_ZERO_QTY_CHILDREN", "no direct child of positive quantity")
        .when(F.col("reason") == "NOT_REACHED_CHAIN_BREAK", F.concat(F.lit("under "), F.col("place.parent"), F.when(F.col("open").isNotNull(), ", which is not exploded").otherwise(", which is exploded")))
        .when(F.col("reason").isin("REACHED_SELECTION_FAIL", "REV_LOOKUP_FAIL"), F.when(said == "", "met as a child, never entered").otherwise(said))
        .when(F.col("reason") == "CODE_VARIANT", F.concat(F.lit("same digits "), F.col("variant.root"), F.lit(", "), F.col("variant.code_end"), F.lit(" against "), F.col("variant.other_end")))
        .when(F.col("reason") == "LIKELY_TYPO", F.format_string("%d letters differ, ratio %.2f", F.col("typo.d"), -F.col("typo.ratio")))
        .otherwise("no list has it")
    )
    return d.select(
        "code", F.coalesce("rev", F.lit("")).alias("rev"), "reason", "candidate", F.coalesce("place.parent", F.lit("")).alias("parent"), F.coalesce("place.parent_rev", F.lit("")).alias("parent_rev"),
        F.coalesce(F.col("place.pos").cast("string"), F.lit("")).alias("pos"), note.alias("note"),
    )


def chain_breaks(parents: DataFrame, effective: DataFrame, reached: DataFrame, exploded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots of broken chains (code, impacted) and (code, kind ROOT / CASCADE, root, depth).

    A root has effective children, was reached and not exploded; whatever hangs below it cascades,
    from its nearest root, at its least depth.
    """
    from .tree import ancestors

    roots = effective.where("most >= 1").join(reached.select("code").distinct(), "code", "left_semi").join(exploded.select("code").distinct(), "code", "left_anti").select("code")
    coded = parents.select("doc_id", "seq", norm(F.col("code")).alias("code"))
    up = ancestors(parents).join(coded.select("doc_id", F.col("seq").alias("ancestor_seq"), F.col("code").alias("root")), ["doc_id", "ancestor_seq"])
    hit = up.join(roots.select(F.col("code").alias("root")), "root", "left_semi").groupBy("doc_id", "seq").agg(F.min(F.struct("distance", "root")).alias("n"))
    best = hit.join(coded, ["doc_id", "seq"]).where("code <> ''").groupBy("code").agg(F.min(F.struct(F.col("n.distance"), "doc_id", "seq", F.col("n.root"))).alias("b"))
    classes = best.select("code", F.when(F.col("b.distance") == 0, "ROOT").otherwise("CASCADE").alias("kind"), F.col("b.root").alias("root"), F.col("b.distance").alias("depth"))
    impact = classes.where("kind = 'CASCADE'").groupBy(F.col("root").alias("code")).agg(F.count_distinct("code").alias("impacted"))
    return roots.join(impact, "code", "left").select("code", F.coalesce("impacted", F.lit(0)).alias("impacted")), classes


def infer_quantities(missing: DataFrame, edges: DataFrame, totals: DataFrame, occurrences: DataFrame, safe: DataFrame | None = None, by_code: DataFrame | None = None, root: str = "", default_steps: tuple = (1.0, 0.5, 0.25, 0.1, 0.01)) -> DataFrame:
    """parent, child, unit, n_lines, n_parents, total, occurrences, value, status, confidence for lines without a quantity.

    ``missing`` and ``edges`` (parent, child, unit); ``totals`` (code, qty).  How often the parent
    occurs is said by the structure (``occurrences``), else by the explosion's edges (``safe``), both
    (code, occurrences), else by its totals (``by_code``: code, qty), else it is once for the root;
    each by the code, then without its lookup suffix.  Two parents or two lines of a pair are
    ambiguous; without a positive total or occurrence nothing can be said; else total /
    occurrences, put on the unit's steps.
    """
    from ..functions.keys import quantized, strip_lookup_suffix

    every = edges.select("parent", "child").unionByName(missing.select("parent", "child"))
    parents = every.groupBy("child").agg(F.count_distinct("parent").alias("n_parents"))
    pairs = missing.groupBy("parent", "child").agg(F.count("*").alias("n_lines"), F.max("unit").alias("unit"))
    positive = lambda df, c: df.select("code", F.col(c).cast("double").alias("v")).where("v > 0")
    tables = [("t", positive(totals, "qty"), "child"), ("o", positive(occurrences, "occurrences"), "parent")]
    tables += [("s", positive(safe, "occurrences"), "parent")] if safe is not None else []
    tables += [("c", positive(by_code, "qty"), "parent")] if by_code is not None else []
    j = pairs.join(parents, "child").withColumn("short_child", strip_lookup_suffix(F.col("child"))).withColumn("short_parent", strip_lookup_suffix(F.col("parent")))
    for name, table, key in tables:
        for i, k in ((1, key), (2, f"short_{key}")):
            j = j.join(table.select(F.col("code").alias(k), F.col("v").alias(f"{name}{i}")), k, "left")
    total = F.coalesce("t1", "t2")
    times = F.coalesce(*[F.col(f"{name}{i}") for name, _, _ in tables[1:] for i in (1, 2)], F.when(F.col("parent") == root, F.lit(1.0)))
    k = j.withColumn("total", total).withColumn("occurrences", times).withColumn("raw", F.col("total") / F.col("occurrences"))
    raw = F.col("raw")
    k = k.withColumn("put", F.when(norm(F.col("unit")) == "NR", quantized(raw, [1.0])).otherwise(quantized(raw, list(default_steps))))
    ok = F.col("put.status") == "OK_STEP"
    status = F.when((F.col("n_parents") >= 2) | (F.col("n_lines") >= 2), "AMBIGUOUS").when(raw.isNull(), "NOT_CALCULABLE").when(ok, "INFERRED").otherwise("CHECK")
    sure = F.when(~status.isin("INFERRED", "CHECK"), 0.0).when(~ok, 0.4).when(norm(F.col("unit")) == "NR", 0.9).when(F.col("unit") != "", 0.8).otherwise(0.7)
    return k.select("parent", "child", "unit", "n_lines", "n_parents", "total", "occurrences", F.when(status.isin("INFERRED", "CHECK"), F.col("put.value")).alias("value"), status.alias("status"), sure.alias("confidence"))
