"""Which component list applies to a (code, revision): strict, by fallback, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import digit_root, norm, rev_order


def header_index(headers: DataFrame) -> DataFrame:
    return headers.select("bom_id", "bom_seq", norm(F.col("code")).alias("code"), norm(F.col("revision")).alias("revision")).where("code <> ''")


def max_revision(headers: DataFrame) -> DataFrame:
    """code, n (component lists), bom_id and revision of the highest revision; the first of equal ones."""
    best = Window.partitionBy("code").orderBy(rev_order(F.col("revision")).desc(), F.col("bom_seq"))
    h = header_index(headers).withColumn("__r", F.row_number().over(best)).withColumn("n", F.count("*").over(Window.partitionBy("code")))
    return h.where("__r = 1").select("code", "n", "bom_id", "revision")


def same_root(wanted: DataFrame, headers: DataFrame) -> DataFrame:
    """code, candidates: sorted header codes of the same digit root but another code."""
    w = wanted.select("code", digit_root(F.col("code")).alias("root")).where("root <> ''").distinct()
    h = header_index(headers).select(F.col("code").alias("other"), digit_root(F.col("code")).alias("root")).where("root <> ''").distinct()
    return w.join(h, "root").where("code <> other").groupBy("code").agg(F.sort_array(F.collect_set("other")).alias("candidates"))


def _root_ends(headers: DataFrame) -> DataFrame:
    """root, least, most: the ends of the header codes of each digit root: one row, not all its pairs."""
    return header_index(headers).select("code", digit_root(F.col("code")).alias("root")).where("root <> ''").groupBy("root").agg(F.min("code").alias("least"), F.max("code").alias("most"))


def resolve(wanted: DataFrame, headers: DataFrame, fallback: bool = True, use_max_rev: bool = True) -> DataFrame:
    """One row for each distinct (code, rev) of ``wanted``.

    code, rev, bom_id (null: none), selected_rev, n_candidates, outcome (OK, FALLBACK, AMBIGUOUS,
    SUSPICIOUS_HEADER_MISMATCH, MISSING_FILE), rev_mismatch.
    """
    w = wanted.select(norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("rev")).where("code <> ''").distinct()
    strict = header_index(headers).groupBy("code", "revision").agg(F.min_by("bom_id", "bom_seq").alias("strict_id")).withColumnRenamed("revision", "rev")
    top = max_revision(headers).select("code", "n", F.col("bom_id").alias("top_id"), F.col("revision").alias("top_rev"))
    # joined once by the root; codes without one are spread by keys of their own, which no root equals
    j = w.join(strict, ["code", "rev"], "left").join(top, "code", "left").withColumn("root", F.coalesce(F.nullif(digit_root(F.col("code")), F.lit("")), F.concat(F.lit("#"), "code"))).join(_root_ends(headers), "root", "left")
    n, known = F.coalesce("n", F.lit(0)), F.col("rev") != ""
    hit, none = known & F.col("strict_id").isNotNull(), F.when(F.expr("least <> code or most <> code"), "SUSPICIOUS_HEADER_MISMATCH").otherwise("MISSING_FILE")
    several = n > 1
    outcome = (
        F.when(hit, "OK")
        .when(known & F.lit(not fallback), none)
        .when(n == 0, none)
        .when(~known & (n == 1), "OK")
        .when(several & F.lit(not use_max_rev or not fallback), "AMBIGUOUS")
        .otherwise("FALLBACK")
    )
    o = j.withColumn("outcome", outcome)
    chosen = F.when(hit, F.col("strict_id")).when(F.col("outcome").isin("OK", "FALLBACK"), F.col("top_id"))
    rev = F.when(hit, F.col("rev")).when(F.col("outcome").isin("OK", "FALLBACK"), F.col("top_rev"))
    return o.select("code", "rev", chosen.alias("bom_id"), rev.alias("selected_rev"), n.alias("n_candidates"), "outcome", (known & (F.col("outcome") == "FALLBACK")).alias("rev_mismatch"))


def link_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of a structure with their component list: seq, code, rev, status OK / MISSING / AMBIGUOUS, n."""
    index = header_index(headers).groupBy("code", F.col("revision").alias("rev")).agg(F.count("*").alias("n"), F.min_by("bom_id", "bom_seq").alias("bom_id"))
    r = rows.select("doc_id", "seq", norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("rev")).where("code <> ''")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "MISSING").when(n == 1, "OK").otherwise("AMBIGUOUS")
    return r.join(index, ["code", "rev"], "left").select("doc_id", "seq", "code", "rev", status.alias("status"), n.alias("n"), F.when(n == 1, F.col("bom_id")).alias("bom_id"))


def link_candidates(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """code, rev, status, candidate, revision, bom_id: the lists that an AMBIGUOUS link could mean, and those of the same digit root for a MISSING one."""
    links = link_rows(rows, headers).select("code", "rev", "status").distinct()
    index = header_index(headers).select(F.col("code").alias("candidate"), "revision", "bom_id", digit_root(F.col("code")).alias("root"))
    equal = links.where("status = 'AMBIGUOUS'").join(index, (F.col("code") == F.col("candidate")) & (F.col("rev") == F.col("revision")))
    open_links = links.where("status = 'MISSING'").withColumn("own", digit_root(F.col("code"))).where("own <> ''")
    near = open_links.join(index, (F.col("own") == F.col("root")) & (F.col("code") != F.col("candidate")))
    columns = ["code", "rev", "status", "candidate", "revision", "bom_id"]
    return equal.select(*columns).unionByName(near.select(*columns))


def structure_revs(rows: DataFrame) -> DataFrame:
    """code, rev: the last non-empty revision of each code."""
    named = rows.select("seq", norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("rev")).where("code <> '' and rev <> ''")
    return named.groupBy("code").agg(F.max_by("rev", "seq").alias("rev"))


def rev_conflicts(rows: DataFrame) -> DataFrame:
    """doc_id, seq, code, previous, rev: where a code's non-empty revision differs from the one before."""
    named = rows.select("doc_id", "seq", norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("rev")).where("code <> '' and rev <> ''")
    before = F.lag("rev").over(Window.partitionBy("doc_id", "code").orderBy("seq"))
    return named.withColumn("previous", before).where("previous <> rev").select("doc_id", "seq", "code", "previous", "rev")
