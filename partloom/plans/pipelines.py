"""The two analyses end to end: structure with component lists, and component lists alone.

Each takes tables and returns a bundle of tables and an ``issues`` table; nothing is collected but
counts that decide what is reported.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_pn, norm
from ..operators import graph as G
from ..operators import reconcile as C
from ..operators import reports as P
from ..operators import resolve as R
from ..operators import tree as T
from ..operators import views as V
from ..operators.explode import Explosion, Policy, explode
from ..operators.sinks import check_export, export_lines, tree_text

ISSUES = "level string, code string, message string"


@dataclass
class Analysis:
    explosion: Explosion | None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    issues: DataFrame | None = None

    def has_errors(self) -> bool:
        return not self.issues.where("level = 'ERROR'").isEmpty()


def _issue(df: DataFrame, level: str, code: str, message) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))


#: Text columns of a line beside its key, quantity and kind.
LINE_TEXTS = ("description", "val", "rat", "tol", "refdes", "tecn", "notes", "manufacturer", "manufacturer_code")


def canonicalised(df: DataFrame, column: str, aliases: DataFrame | None) -> DataFrame:
    """``df`` with the codes of ``column`` reduced to letters and digits and replaced by their internal code, if they have one.

    ``aliases`` (external_code, internal_code): of several internal codes the least counts; empty codes stay.
    """
    from ..functions.keys import alnum

    reduced = df.withColumn(column, alnum(F.col(column)))
    if aliases is None:
        return reduced
    named = aliases.select(alnum(F.col("external_code")).alias(column), alnum(F.col("internal_code")).alias("__inner")).where(F.col(column) != "").groupBy(column).agg(F.min("__inner").alias("__inner"))
    return reduced.join(named, column, "left").withColumn(column, F.coalesce("__inner", column)).select(*df.columns)


def normalised_lines(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Typed lines from text columns, other columns kept: key texts with single blanks, quantity, unit, kind, and codes by their internal alias.

    A text column that ``raw`` lacks is empty; ``um`` stands in for ``unit``.
    """
    from ..functions.keys import line_kind, quantity

    blank = F.lit("")
    has = set(raw.columns)
    own = lambda c: F.coalesce(F.col(c).cast("string"), blank) if c in has else blank
    key = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    unit_text = F.coalesce(F.nullif(own("um"), blank), own("unit"))
    texts = raw.withColumns({c: key(own(c)) for c in ("pos", "type", "rev")} | {c: F.trim(own(c)) for c in LINE_TEXTS} | {"unit": norm(key(unit_text)), "qty": quantity(F.col("qty"))})
    lines = canonicalised(texts, "internal_code", aliases)
    return lines.withColumn("kind", line_kind(F.col("type"), F.col("description"), F.col("unit"), F.col("qty"))).drop("um")


def normalised_headers(headers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Headers with their codes by internal alias, texts trimmed."""
    return canonicalised(headers, "code", aliases).withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("revision", "title") if c in headers.columns})


def structure_by_alias(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Structure rows with their codes by internal alias; all else as it was."""
    return canonicalised(rows, "code", aliases)


def analyse_structure(spark: SparkSession, rows: DataFrame, headers: DataFrame, lines: DataFrame, totalization: DataFrame | None = None, policy: Policy = Policy()) -> Analysis:
    """Links, explosion, findings and reports for an indented structure and its component lists."""
    root = T.root_row(rows).first()
    if root is None:
        return Analysis(None, {}, spark.createDataFrame([("ERROR", "NO_ROOT", "the structure has no row with a code")], ISSUES))
    e = explode(spark, lines, headers, norm_text(root["code"]), norm_text(root["rev"]), R.structure_revs(rows), policy)
    units, totals, done = e.units(), e.totals(), e.exploded()
    parents, effective = T.level_parents(rows), T.effective_children(rows)
    reached = e.edges().select(F.col("child_code").alias("code"))
    open_codes = C.unexploded(rows, headers, done)
    occurring = occurrences_in_lists(lines, headers)
    traced = P.traces(P.wanted_lists(e.edges(), norm_text(root["code"]), norm_text(root["rev"])), headers, policy.fallback, policy.use_max_rev)
    roots, classes = C.chain_breaks(parents, effective, reached, done)
    export = export_lines(rows, "PBS")
    above = e.edges().select(F.col("parent_code").alias("code")).unionByName(spark.createDataFrame([(norm_text(root["code"]),)], "code string"))
    tables = {
        "links": R.link_rows(rows, headers),
        "edges": e.edges(),
        "totals": V.totals_view(totals, units, G.part_master(lines, norm(F.col("internal_code")))),
        "tree": tree_text(rows),
        "completeness": C.completeness(rows, headers, totals, done),
        "diagnosis": C.diagnose_unexploded(open_codes, T.effective_children(rows, "reset"), reached, occurring, done, R.structure_revs(rows), traced, e.missing_lists()),
        "traces": traced,
        "rev_fallbacks": P.rev_fallbacks(traced),
        "missing_lists": e.missing_lists(),
        "chain_break_roots": P.break_reasons(roots, traced),
        "chain_breaks": classes,
        "mismatches": C.parent_child_mismatches(T.level_parents(rows, "skip"), headers, lines, above, open_codes),
        "export": export,
        "export_check": check_export(export),
    }
    if totalization is not None:
        loaded = C.load_totalization(totalization)
        pair = lambda df: df.select(F.col("parent_code").alias("parent"), F.col("child_code").alias("child"), "unit")
        tables["totalization"] = loaded
        tables["validation"] = C.validate_totals(totals.withColumnRenamed("code", "pn"), loaded, units.withColumnRenamed("code", "pn"))
        tables["inference"] = C.infer_quantities(pair(e.missing()), pair(e.edges()), loaded.withColumnRenamed("pn", "code"), T.occurrences(rows), P.safe_occurrences(e.edges(), norm_text(root["code"])), totals, norm_text(root["code"]))
    issues = (
        _issue(e.cycles(), "ERROR", "CYCLE", F.array_join("path", " -> "))
        .unionByName(_issue(tables["links"].where("status <> 'OK'"), "WARN", "LINK", F.concat_ws(" ", "code", "rev", "status")))
        .unionByName(_issue(tables["export_check"].where("n > 0"), "ERROR", "EXPORT", F.col("check")))
        .unionByName(_issue(e.missing(), "WARN", "MISSING_QTY", F.concat_ws(" > ", "parent_code", "child_code")))
    )
    return Analysis(e, tables, issues)


def occurrences_in_lists(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """code, parent, parent_rev, pos, seq: where every code stands in the component lists."""
    own = R.header_index(headers).select("bom_id", F.col("code").alias("parent"), F.col("revision").alias("parent_rev"))
    return lines.join(own, "bom_id").select(norm(F.col("internal_code")).alias("code"), "parent", "parent_rev", F.col("line_no").alias("pos"), "seq").where("code <> ''")


def norm_text(value: str | None) -> str:
    return (value or "").strip().upper()


def analyse_lists(spark: SparkSession, headers: DataFrame, lines: DataFrame, folder_base: str = "") -> Analysis:
    """Roots, ranking and explosion for component lists without a structure; keys hold the revision."""
    keyed = headers.withColumn("code", canonical_pn(F.col("code"), F.col("revision")))
    children = lines.withColumn("internal_code", canonical_pn(F.col("internal_code"), F.col("rev")))
    graph = G.with_aliases(G.list_graph(children, keyed), keyed)
    ranking = G.rank_roots(graph, keyed, folder_base)
    first = ranking.where("rank = 1").first()
    tables = {"graph": graph, "degrees": G.degrees(graph, keyed), "ranking": ranking, "aliases": G.base_aliases(keyed)}
    if first is None:
        return Analysis(None, tables, spark.createDataFrame([("ERROR", "NO_ROOT", "every list is a child of another")], ISSUES))
    e = explode(spark, lines, keyed, first["code"], "", None, Policy(explode_documents=True, explode_unknown=True, root_strict_rev=False, pdf=True))
    tables |= {"edges": e.edges(), "totals": e.totals(), "missing": e.missing()}
    issues = _issue(e.cycles(), "ERROR", "CYCLE", F.array_join("path", " -> ")).unionByName(_issue(e.missing(), "WARN", "MISSING_QTY", F.concat_ws(" > ", "parent_code", "child_code")))
    return Analysis(e, tables, issues)
