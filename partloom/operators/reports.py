"""Traces, audits, summaries and the smaller reports on lists, links and explosions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.keys import digit_root, norm, strip_lookup_suffix
from ..plans.tables import stored
from .components import simple_cycles
from .resolve import header_index, resolve, same_root


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters; no built-in function has it.

    Only asked for pairs that a blocking key has found, so few rows come here.
    """
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def traces(wanted: DataFrame, headers: DataFrame, fallback: bool = True, use_max_rev: bool = True) -> DataFrame:
    """context, expected_code, expected_rev, selected_code, selected_rev, n_candidates, suspicious, outcome, note, suggestion.

    ``wanted``: (context, code, rev) of the lists that were asked for; ``suspicious`` are codes of
    the same digit root, sorted.  One row for each distinct question.
    """
    w = wanted.select("context", norm(F.col("code")).alias("code"), norm(F.col("rev")).alias("rev")).where("code <> ''").distinct()
    # tables: questions and headers are read several times, and come from long plans
    w, headers = stored(w, "questions"), stored(header_index(headers), "headers")
    solved = resolve(w, headers, fallback, use_max_rev)
    near = same_root(w, headers).withColumnRenamed("candidates", "suspicious")
    j = w.join(solved, ["code", "rev"]).join(near, "code", "left")
    outcome = F.col("outcome")
    note = F.when(outcome == "FALLBACK", F.concat(F.lit("revision "), F.when(F.col("rev") == "", "-").otherwise(F.col("rev")), F.lit(" asked, "), "selected_rev", F.lit(" taken"))).when(outcome == "AMBIGUOUS", "several lists of this code").otherwise("")
    advice = F.when(outcome == "MISSING_FILE", "add the list").when(outcome == "SUSPICIOUS_HEADER_MISMATCH", "check the code in the list's header").when(outcome.isin("AMBIGUOUS", "FALLBACK"), "name the revision").otherwise("")
    empty = F.array().cast("array<string>")
    return j.select(
        "context", F.col("code").alias("expected_code"), F.col("rev").alias("expected_rev"), F.when(F.col("bom_id").isNotNull(), F.col("code")).otherwise("").alias("selected_code"),
        F.coalesce("selected_rev", F.lit("")).alias("selected_rev"), "n_candidates", F.coalesce("suspicious", empty).alias("suspicious"), "outcome", note.alias("note"), advice.alias("suggestion"),
    )


def wanted_lists(edges: DataFrame, root_code: str, root_rev: str = "") -> DataFrame:
    """(context, code, rev) of an explosion: its root and every child that it met."""
    asked = edges.select(F.lit("EXPLODE_CHILD").alias("context"), F.col("child_code").alias("code"), F.col("child_rev").alias("rev")).distinct()
    return asked.unionByName(edges.sparkSession.createDataFrame([("ROOT", root_code, root_rev)], "context string, code string, rev string"))


def rev_fallbacks(traced: DataFrame) -> DataFrame:
    """pn, requested, selected where another revision than the one asked for was taken."""
    hit = traced.where("outcome = 'FALLBACK' and expected_rev <> ''")
    return hit.select(F.col("expected_code").alias("pn"), F.col("expected_rev").alias("requested"), F.col("selected_rev").alias("selected")).distinct()


def break_reasons(roots: DataFrame, traced: DataFrame) -> DataFrame:
    """code, impacted, reason, suggestion of chain-break roots, from the trace that tells most: a child's, one that failed."""
    best = Window.partitionBy("expected_code").orderBy(F.col("context") != "EXPLODE_CHILD", F.col("outcome") == "OK", "context", "expected_rev")
    one = traced.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(F.col("expected_code").alias("code"), "outcome", "note", "suggestion")
    said = F.col("outcome")
    reason = (
        F.when(said.isNull(), "unknown")
        .when(said == "SUSPICIOUS_HEADER_MISMATCH", "alias mismatch")
        .when(said == "AMBIGUOUS", "no sub-bom resolved (ambiguous)")
        .when(said == "REV_MISMATCH", "rev mismatch / selection blocked")
        .when(said == "MISSING_FILE", "no sub-bom resolved (missing file)")
        .when(F.col("note") != "", F.substring("note", 1, 80))
        .otherwise("no sub-bom resolved")
    )
    return roots.join(one, "code", "left").select("code", "impacted", reason.alias("reason"), F.coalesce(F.nullif("suggestion", F.lit("")), F.lit("check the list's header and the linking rule")).alias("suggestion"))


def top_roots(roots: DataFrame, most: int = 10) -> DataFrame:
    """The chain-break roots of greatest impact; a report for people has ``most`` of them."""
    return roots.orderBy(F.desc("impacted"), "code").limit(most)


def completeness_summary(rows: DataFrame, findings: DataFrame, exploded: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: structure_codes, flat_codes, introduced, unexploded, rev_mismatches, cycles."""
    kinds = findings.agg(F.count_if(F.col("kind") == "INTRODUCED").alias("introduced"), F.count_if(F.col("kind") == "UNEXPLODED").alias("unexploded"), F.count_if(F.col("kind") == "REV_MISMATCH").alias("rev_mismatches"))
    codes = rows.select(norm(F.col("code")).alias("code")).where("code <> ''").agg(F.count_distinct("code").alias("structure_codes"))
    done, rings = exploded.agg(F.count_distinct("code").alias("n")), cycles.agg(F.count("*").alias("cycles"))
    # four tables of one row each
    return codes.crossJoin(kinds).crossJoin(done).crossJoin(rings).select("structure_codes", (F.col("introduced") + F.col("n")).alias("flat_codes"), "introduced", "unexploded", "rev_mismatches", "cycles")


def safe_occurrences(edges: DataFrame, root_code: str) -> DataFrame:
    """code, occurrences: summed quantities of edges by child, also under the code without lookup suffix; the root has one."""
    own = edges.where("qty is not null").select(F.col("child_code").alias("code"), F.col("qty").cast("double").alias("n"))
    short = own.withColumn("s", strip_lookup_suffix(F.col("code"))).where("s <> code").select(F.col("s").alias("code"), "n")
    root = edges.sparkSession.createDataFrame([(root_code, 1.0)], "code string, n double")
    return own.unionByName(short).unionByName(root).groupBy("code").agg(F.sum("n").alias("occurrences"))


def structure_targets(rows: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """target, rev: the part lists that a structure expects; a given list of them wins over codes that end with PRTL."""
    chosen = listed if listed is not None else rows.where(F.endswith(norm(F.col("code")), F.lit("PRTL")))
    return chosen.select(F.trim("code").alias("target"), norm(F.col("rev")).alias("rev")).where("target <> ''").distinct()


def files_to_open(matches: DataFrame, medium: bool = True) -> DataFrame:
    """Matched files worth opening: strong ones, and medium ones if wanted."""
    return matches.where(F.col("strength").isin("STRONG", "MEDIUM") if medium else F.col("strength") == "STRONG")


def missing_targets(targets: DataFrame, verified: DataFrame) -> DataFrame:
    """target, rev, root of targets that no header was matched with, in order of root, revision and code."""
    left = targets.join(verified.where("matched").select("target").distinct(), "target", "left_anti").distinct()
    return left.select("target", "rev", digit_root(F.col("target")).alias("root")).orderBy("root", "rev", "target")


def list_summary(targets: DataFrame, matches: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: expected, opened, parsed, validated, mismatched, missing."""
    expected = targets.distinct().agg(F.count("*").alias("expected"))
    opened = files_to_open(matches).agg(F.count_distinct("path").alias("opened"))
    parsed = verified.agg(F.count("*").alias("parsed"), F.count_distinct(F.when(F.col("matched"), F.col("target"))).alias("validated"), F.count_if(~F.col("matched")).alias("mismatched"))
    one = expected.crossJoin(opened).crossJoin(parsed)  # three tables of one row each
    return one.withColumn("missing", F.greatest(F.col("expected") - F.col("validated"), F.lit(0).cast("long")))


def header_audit(files: DataFrame, matches: DataFrame, headers: DataFrame, verified: DataFrame) -> DataFrame:
    """For every file (path, bom_id) how its name matched, what its header says and whether that was verified."""
    m = matches.select("path", F.col("target").alias("name_target"), "match_len", "strength", "score")
    h = headers.select("bom_id", F.col("code").alias("header_code"), F.col("revision").alias("header_rev"))
    v = verified.select("bom_id", "matched", "reason", F.col("target").alias("header_target"), F.col("match_len").alias("header_match_len"))
    # by shuffles: these tables grow with the files, and what Spark expects of their size is far too little
    j = files.select("path", "bom_id").join(m.hint("merge"), "path", "left").join(h.hint("merge"), "bom_id", "left").join(v.hint("merge"), "bom_id", "left")
    return j.na.fill("", ["name_target", "header_code", "header_rev", "header_target"]).na.fill(0, ["match_len", "header_match_len"]).na.fill({"strength": "NO_MATCH", "reason": "NOT_OPENED", "matched": False, "score": 0.0})


def manufacturer_coverage(lines: DataFrame) -> DataFrame:
    """One row: lines, with a manufacturer, with its code, and both in percent."""
    filled = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "")
    a = lines.agg(F.count("*").alias("lines"), filled("manufacturer").alias("named"), filled("manufacturer_code").alias("coded"))
    share = lambda c: F.coalesce(F.round(100 * F.col(c) / F.nullif("lines", F.lit(0)), 6), F.lit(0.0)).alias(f"{c}_percent")
    return a.select("lines", "named", "coded", share("named"), share("coded"))


def root_candidates(roots: DataFrame, graph: DataFrame, headers: DataFrame) -> DataFrame:
    """code, rev, indegree, parents, revs: lists that may be the root, one row for each of their revisions."""
    # only parents of the roots are gathered, not those of the whole graph.  All of this grows with the headers, so it is joined
    # by shuffles; tables between keep the sorts of these joins, which have one key, out of one task
    wanted = stored(roots.select("code").distinct(), "wanted-roots").hint("merge")
    into = stored(graph.select(F.col("child").alias("code"), "parent").join(wanted, "code", "left_semi").distinct(), "root-parents")
    parents = into.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("parent")), ";").alias("parents"), F.count("parent").alias("indegree"))
    own = stored(header_index(headers).join(wanted, "code", "left_semi").select("code", F.col("revision").alias("rev")).distinct(), "root-revisions")
    revs = own.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("rev")), ";").alias("revs"))
    j = own.join(revs.hint("merge"), "code").join(parents.hint("merge"), "code", "left")
    return j.select("code", "rev", F.coalesce("indegree", F.lit(0)).alias("indegree"), F.coalesce("parents", F.lit("")).alias("parents"), "revs")


def alias_suspects(aliases: DataFrame, graph: DataFrame, headers: DataFrame) -> DataFrame:
    """base, full, base_is_header, full_is_header, base_indegree, full_indegree of codes that may stand for one another."""
    own = header_index(headers).select("code").distinct().withColumn("is", F.lit(True))
    ins = graph.groupBy(F.col("child").alias("code")).agg(F.count_distinct("parent").alias("n"))
    j = aliases
    for side in ("base", "full"):
        j = j.join(own.select(F.col("code").alias(side), F.col("is").alias(f"{side}_h")), side, "left").join(ins.select(F.col("code").alias(side), F.col("n").alias(f"{side}_n")), side, "left")
    flag, degree = (lambda s: F.coalesce(f"{s}_h", F.lit(False)).alias(f"{s}_is_header")), (lambda s: F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s}_indegree"))
    return j.select("base", "full", flag("base"), flag("full"), degree("base"), degree("full"))


def missing_edge_rows(missing: DataFrame, lines: DataFrame) -> DataFrame:
    """parent_code, parent_rev, child_code, pos, unit, kind, bom_id: each line without a quantity that an explosion met, once."""
    met = missing.select("parent_code", "parent_rev", "child_code", "unit", "bom_id", F.element_at("dfs_key", -1).alias("pos")).distinct()
    own = lines.select("bom_id", F.col("line_no").alias("pos"), "kind").distinct()
    return met.join(own, ["bom_id", "pos"]).select("parent_code", "parent_rev", "child_code", "pos", "unit", "kind", "bom_id")


def graph_cycles(graph: DataFrame) -> DataFrame:
    """head, length, path: every simple cycle of the list graph, from its least code; of any length."""
    return simple_cycles(graph).select("head", "length", F.array_join("path", " > ").alias("path"))


def code_tree(parents: DataFrame) -> DataFrame:
    """code, child: which codes stand below which anywhere in the structure (rows with parent_seq)."""
    coded = parents.select("doc_id", "seq", "parent_seq", norm(F.col("code")).alias("child"))
    up = coded.select("doc_id", F.col("seq").alias("parent_seq"), F.col("child").alias("code"))
    return coded.join(up, ["doc_id", "parent_seq"]).where("code <> '' and child <> ''").select("code", "child").distinct()


def structure_index(rows: DataFrame) -> DataFrame:
    """code, occurrences, first_seq, seqs: where each code stands, in order."""
    r = rows.select(norm(F.col("code")).alias("code"), "seq").where("code <> ''")
    return r.groupBy("code").agg(F.count("*").alias("occurrences"), F.min("seq").alias("first_seq"), F.sort_array(F.collect_list("seq")).alias("seqs"))


def master_lookup(codes: DataFrame, master: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """``codes`` (code) with description and manufacturer by canonical code, else by the code as it stands; and up to 20 misses."""
    m = master.select("code", "description", "manufacturer")
    c = m.select(F.col("code").alias("__key"), F.struct("description", "manufacturer").alias("a"))
    raw = m.select(F.col("code").alias("__raw"), F.struct("description", "manufacturer").alias("b"))
    j = codes.withColumn("__key", canonical).withColumn("__raw", F.trim("code")).join(c, "__key", "left").join(raw, "__raw", "left").withColumn("m", F.coalesce("a", "b"))
    return j.where("m is not null").select("code", "m.description", "m.manufacturer"), j.where("m is null").select("code").distinct().orderBy("code").limit(20)


def severity_counts(mismatches: DataFrame) -> DataFrame:
    """severity, place, n of parent and child mismatches."""
    return mismatches.groupBy("severity", "place").agg(F.count("*").alias("n"))


#: Lines of a block whose hashes are hashed together, and blocks of a block of blocks.
HASHED_TOGETHER = 1024


def lines_hash(lines: DataFrame) -> DataFrame:
    """source_hash of import lines (external_id, key, parent_external_id): a tree of SHA-256 over blocks of the order.

    Lines stand in blocks by the number that ends their external id, blocks in blocks of blocks; each
    holds the hashes below it in order.  The digest does not depend on partitions, and the last row
    gathers one hash for a million lines.
    """
    number = F.regexp_extract("external_id", "([0-9]+)$", 1).try_cast("long")
    sums = lines.select(F.coalesce(number, F.lit(0)).alias("n"), F.col("external_id").alias("at"), F.sha2(F.concat_ws("|", "external_id", "key", F.coalesce("parent_external_id", F.lit(""))), 256).alias("h"))
    together = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "at", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    for _ in range(2):
        block = F.floor(F.col("n") / HASHED_TOGETHER)
        sums = sums.groupBy(block.alias("block")).agg(together).select(F.col("block").alias("n"), F.lit("").alias("at"), "h")
    return sums.agg(together).withColumnRenamed("h", "source_hash")


def export_release(lines: DataFrame, name: str, filename: str, stamp: Column) -> DataFrame:
    """The one row of an import file's release: name, source_filename, source_hash (``lines_hash``), parsed_at, status."""
    return lines_hash(lines).select(F.lit(name).alias("name"), F.lit(filename).alias("source_filename"), "source_hash", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("parsed_at"), F.lit("draft").alias("status"))


def check_release(release: DataFrame, lines: DataFrame) -> DataFrame:
    """level, check, n of a release (name, parsed_at) and its lines (release_id)."""
    one = release.agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("unnamed"), F.count_if(~F.rlike(F.coalesce("parsed_at", F.lit("")), F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"))).alias("stamps"), F.max("name").alias("name"))
    wrong = lines.crossJoin(F.broadcast(one.select("name"))).agg(F.count_if(F.trim(F.coalesce("release_id", F.lit(""))) != F.col("name")).alias("wrong"))  # one name
    j = one.crossJoin(wrong)
    row = lambda level, check, n: F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), n.cast("long").alias("n"))
    found = F.array(row("ERROR", "RELEASE_ROWS", F.when(F.col("rows") == 1, 0).otherwise(F.greatest("rows", F.lit(1)))), row("ERROR", "RELEASE_NAME", F.col("unnamed")), row("WARN", "STAMP_FORMAT", F.col("stamps")), row("WARN", "RELEASE_ID", F.col("wrong")))
    return j.select(F.explode(found).alias("x")).select("x.*")
