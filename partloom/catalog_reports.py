"""Queries of reports, traces and file headers, by name, and their SQL; ``catalog`` offers them with its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as B
from .adapters import lists, view, with_views
from .functions import keys as K
from .operators import explode as X
from .operators import graph as G
from .operators import report_rows as RR
from .operators import reports as P
from .operators import resolve as R
from .operators import tree as T
from .operators import views as V
from .sources import grids as I
from .sources import headers as H

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _over(spark, d, sql: str, *tables: str):
    """``sql`` over sample tables, as Spark reads it."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in tables})


# --- explosion by page policy, traces --------------------------------------------------------

_PAGES = with_views("bom_headers", "bom_lines", "page_revs", recursive=True) + """,
hk AS (SELECT code || '-' || revision AS key, code, revision, bom_id, bom_seq FROM bom_headers), hs AS (SELECT key, arg_min(bom_id, bom_seq) AS bid FROM hk GROUP BY key),
adj AS (SELECT l.bom_id, h.key AS parent_code, l.line_no, l.internal_code || CASE WHEN r.rev IS NULL THEN '' ELSE '-' || r.rev END AS child_code, COALESCE(r.rev, '') AS child_rev, l.qty, hs.bid AS next_bom_id,
 CASE WHEN hs.bid IS NOT NULL THEN 'OK' WHEN l.internal_code IN (SELECT code FROM bom_headers) THEN 'SUSPICIOUS_HEADER_MISMATCH' ELSE 'MISSING_FILE' END AS outcome
 FROM bom_lines l JOIN hk h ON h.bom_id = l.bom_id LEFT JOIN page_revs r ON r.code = l.internal_code LEFT JOIN hs ON hs.key = l.internal_code || '-' || r.rev),
walk AS (SELECT 1 AS depth, ['E0000001-A', a.child_code] AS path, a.parent_code, a.child_code, a.child_rev, a.qty, a.next_bom_id, a.outcome, CASE WHEN a.qty IS NULL THEN CASE WHEN a.child_code = 'E0000001-A' THEN 'CYCLE_WITHOUT_QTY' ELSE 'MISSING_QTY' END WHEN a.qty <= 0 THEN 'NON_POSITIVE' WHEN a.child_code = 'E0000001-A' THEN 'CYCLE' ELSE 'EDGE' END AS state FROM adj a JOIN hs ON hs.bid = a.bom_id WHERE hs.key = 'E0000001-A'
 UNION ALL SELECT w.depth + 1, list_append(w.path, a.child_code), a.parent_code, a.child_code, a.child_rev, w.qty * a.qty, a.next_bom_id, a.outcome, CASE WHEN a.qty IS NULL THEN CASE WHEN list_contains(w.path, a.child_code) THEN 'CYCLE_WITHOUT_QTY' ELSE 'MISSING_QTY' END WHEN a.qty <= 0 THEN 'NON_POSITIVE' WHEN list_contains(w.path, a.child_code) THEN 'CYCLE' ELSE 'EDGE' END FROM walk w JOIN adj a ON a.bom_id = w.next_bom_id WHERE w.state = 'EDGE') """
PAGE_POLICY = X.Policy(explode_documents=True, explode_unknown=True, explode_procedural=True, root_strict_rev=False, pdf=True)


def _paged(spark, d) -> X.Explosion:
    lines, headers = lists(spark, d)
    keyed = headers.withColumn("code", K.canonical_pn(F.col("code"), F.col("revision")))
    return X.explode(spark, lines, keyed, B.ROOT + "-A", "", view(spark, d, "page_revs"), PAGE_POLICY)


@_query(_PAGES + "SELECT depth, array_to_string(path, '>') AS path, parent_code, child_code, child_rev, CASE WHEN state = 'EDGE' THEN CAST(qty AS BIGINT) ELSE 0 END AS qty, state, outcome FROM walk WHERE state IN ('EDGE', 'MISSING_QTY')")
def explode_edges_pdf(spark, d):
    """Keys hold the revision; lines without quantity are leaves of quantity zero."""
    return _paged(spark, d).edges().select("depth", F.array_join("path", ">").alias("path"), "parent_code", "child_code", "child_rev", F.col("qty").cast("bigint").alias("qty"), "state", "outcome")


@_query(_PAGES + "SELECT parent_code, child_code, count(*) AS n FROM walk WHERE state = 'MISSING_QTY' GROUP BY ALL")
def missing_edges_pdf(spark, d):
    return _paged(spark, d).missing().groupBy("parent_code", "child_code").agg(F.count("*").alias("n"))


_TRACES = B._WALK + """, top AS (SELECT code, count(*) AS n, max(revision) AS revision FROM bom_headers GROUP BY code),
ask AS (SELECT DISTINCT 'EXPLODE_CHILD' AS context, child_code AS code, child_rev AS rev FROM walk WHERE state = 'EDGE' UNION ALL SELECT 'ROOT', 'E0000001', ''),
tr AS (SELECT a.context, a.code, a.rev, s.bid IS NOT NULL AS hit, COALESCE(top.n, 0) AS n, top.revision, CASE WHEN s.bid IS NOT NULL THEN 'OK' WHEN top.n IS NULL THEN 'MISSING_FILE' WHEN a.rev = '' AND top.n = 1 THEN 'OK' ELSE 'FALLBACK' END AS outcome FROM ask a LEFT JOIN strict s ON s.code = a.code AND s.revision = a.rev AND a.rev <> '' LEFT JOIN top ON top.code = a.code),
tc AS (SELECT context, code AS expected_code, rev AS expected_rev, CASE WHEN n > 0 THEN code ELSE '' END AS selected_code, CASE WHEN hit THEN rev WHEN n > 0 THEN revision ELSE '' END AS selected_rev, n AS n_candidates, '' AS suspicious, outcome,
 CASE WHEN outcome = 'FALLBACK' THEN 'revision ' || CASE WHEN rev = '' THEN '-' ELSE rev END || ' asked, ' || revision || ' taken' ELSE '' END AS note, CASE outcome WHEN 'MISSING_FILE' THEN 'add the list' WHEN 'FALLBACK' THEN 'name the revision' ELSE '' END AS suggestion FROM tr) """


def _traced(spark, d, e: X.Explosion | None = None):
    if e is not None:
        return P.traces(P.wanted_lists(e.edges(), B.ROOT), e.headers)
    reach = B._reached(spark, d)
    return P.traces(P.wanted_lists(reach.met, B.ROOT), reach.headers)


@_query(_TRACES + "SELECT * FROM tc")
def resolution_traces(spark, d):
    return _traced(spark, d).withColumn("suspicious", F.array_join("suspicious", "|"))


@_query(_TRACES + "SELECT DISTINCT expected_code AS pn, expected_rev AS requested, selected_rev AS selected FROM tc WHERE outcome = 'FALLBACK' AND expected_rev <> ''")
def rev_fallbacks(spark, d):
    return P.rev_fallbacks(_traced(spark, d))


@_query(B._STRICT_WALK + "SELECT DISTINCT child_code AS code FROM walk WHERE state = 'EDGE' AND next_bom_id IS NULL AND child_code IN (SELECT code FROM bom_headers)")
def missing_sub_lists(spark, d):
    return B._strict(spark, d).missing_lists()


_REASONS = B._BREAKS + """, tq AS (SELECT DISTINCT child_code AS code, child_rev AS rev FROM walk WHERE state = 'EDGE'), nh AS (SELECT code, count(*) AS n FROM bom_headers GROUP BY code),
to1 AS (SELECT q.code, q.rev, CASE WHEN s.bid IS NOT NULL THEN 'OK' WHEN q.rev <> '' OR nh.n IS NULL THEN 'MISSING_FILE' WHEN nh.n = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS outcome FROM tq q LEFT JOIN strict s ON s.code = q.code AND s.revision = q.rev AND q.rev <> '' LEFT JOIN nh ON nh.code = q.code),
tb AS (SELECT code, arg_min(outcome, (outcome = 'OK', rev)) AS outcome FROM to1 GROUP BY code), im AS (SELECT root, count(DISTINCT code) AS n FROM cl WHERE dist > 0 GROUP BY root),
rs AS (SELECT rt.code, CAST(COALESCE(im.n, 0) AS BIGINT) AS impacted, CASE tb.outcome WHEN 'MISSING_FILE' THEN 'no sub-bom resolved (missing file)' WHEN 'AMBIGUOUS' THEN 'no sub-bom resolved (ambiguous)' WHEN 'OK' THEN 'no sub-bom resolved' ELSE 'unknown' END AS reason, CASE tb.outcome WHEN 'MISSING_FILE' THEN 'add the list' WHEN 'AMBIGUOUS' THEN 'name the revision' ELSE 'check the list''s header and the linking rule' END AS suggestion FROM rt LEFT JOIN im ON im.root = rt.code LEFT JOIN tb ON tb.code = rt.code) """


def _reasons(spark, d, e: X.Explosion | None = None):
    e = e or B._strict(spark, d)
    traced = P.traces(P.wanted_lists(e.edges(), B.ROOT, "A"), view(spark, d, "bom_headers"), False)
    return P.break_reasons(B._breaks(spark, d, e)[0], traced)


@_query(_REASONS + "SELECT * FROM rs")
def chain_break_reasons(spark, d):
    return _reasons(spark, d)


@_query(_REASONS + "SELECT code, impacted FROM rs ORDER BY impacted DESC, code LIMIT 10")
def top_chain_breaks(spark, d):
    return P.top_roots(_reasons(spark, d)).select("code", "impacted")


# --- summaries -------------------------------------------------------------------------------

@_query(B._walk_with_structure() + """, fi AS (SELECT 'I' AS k, code FROM met WHERE code NOT IN (SELECT code FROM pbs_rows) UNION SELECT 'U', code FROM pbs_rows WHERE code <> '' AND code IN (SELECT code FROM bom_headers) AND code NOT IN (SELECT code FROM done) UNION SELECT 'R', p.code FROM pbs_rows p JOIN done ON done.code = p.code WHERE p.rev <> '' AND done.rev <> '' AND p.rev <> done.rev)
SELECT (SELECT count(DISTINCT code) FROM pbs_rows WHERE code <> '') AS structure_codes, (SELECT count(*) FROM fi WHERE k = 'I') + (SELECT count(DISTINCT code) FROM done) AS flat_codes, (SELECT count(*) FROM fi WHERE k = 'I') AS introduced, (SELECT count(*) FROM fi WHERE k = 'U') AS unexploded, (SELECT count(*) FROM fi WHERE k = 'R') AS rev_mismatches, (SELECT count(*) FROM walk WHERE state = 'CYCLE') AS cycles""")
def completeness_summary(spark, d):
    rows, h = view(spark, d, "pbs_rows"), view(spark, d, "bom_headers")
    e = B._exploded(spark, d)
    return P.completeness_summary(rows, B.C.completeness(rows, h, e.totals(), e.exploded()), e.exploded(), e.cycles())


@_query(B._WALK + "SELECT code, CAST(SUM(n) AS DOUBLE) AS occurrences FROM (SELECT child_code AS code, qty AS n FROM walk WHERE state = 'EDGE' UNION ALL SELECT 'E0000001', 1) GROUP BY code")
def safe_occurrences(spark, d):
    return P.safe_occurrences(B._exploded(spark, d).edges(), B.ROOT)


@_query(B._MISMATCH + "SELECT severity, place, count(*) AS n FROM pcm GROUP BY ALL")
def mismatch_severity_counts(spark, d):
    return P.severity_counts(B.parent_child_mismatch(spark, d))


@_query(with_views("bom_lines") + ", a AS (SELECT count(*) AS lines, count(*) FILTER (WHERE trim(manufacturer) <> '') AS named, count(*) FILTER (WHERE trim(manufacturer_code) <> '') AS coded FROM bom_lines) SELECT *, round(100 * named / lines, 6) AS named_percent, round(100 * coded / lines, 6) AS coded_percent FROM a")
def manufacturer_coverage(spark, d):
    return P.manufacturer_coverage(view(spark, d, "bom_lines"))


_TARGETS = "SELECT code AS target, rev, substr(code, 2) AS root FROM structure_revs"


@_query(B._VERIFIED + f", tg AS ({_TARGETS}) SELECT * FROM tg WHERE target NOT IN (SELECT target FROM vh WHERE matched)")
def missing_targets(spark, d):
    targets = view(spark, d, "structure_revs").select(F.col("code").alias("target"), "rev")
    return P.missing_targets(targets, B._verified_headers(spark, d))


@_query(B._MATCHES + "SELECT path, strength FROM fm WHERE strength = 'STRONG'")
def files_to_open_strong(spark, d):
    return P.files_to_open(V.match_targets(*B._named(spark, d)), medium=False).select("path", "strength")


@_query(with_views("raw_codes") + "SELECT DISTINCT trim(code) AS target, upper(trim(suffix)) AS rev FROM raw_codes WHERE upper(trim(code)) LIKE '%PRTL'")
def structure_targets(spark, d):
    return P.structure_targets(view(spark, d, "raw_codes").select("code", F.col("suffix").alias("rev")))


@_query(B._VERIFIED + ", " + B._MATCHES.removeprefix("WITH ") + ", tg AS (SELECT DISTINCT code, rev FROM structure_revs) SELECT (SELECT count(*) FROM tg) AS expected, (SELECT count(DISTINCT path) FROM fm) AS opened, count(*) AS parsed, count(DISTINCT CASE WHEN matched THEN target END) AS validated, count(*) FILTER (WHERE NOT matched) AS mismatched, greatest((SELECT count(*) FROM tg) - count(DISTINCT CASE WHEN matched THEN target END), 0) AS missing FROM vh")
def list_summary(spark, d):
    targets = view(spark, d, "structure_revs").select(F.col("code").alias("target"), "rev")
    return P.list_summary(targets, V.match_targets(*B._named(spark, d)), B._verified_headers(spark, d))


_AUDIT = "SELECT '/f/' || CAST(p_partkey * 7 + 3100000 AS STRING) || CASE WHEN p_size % 5 = 0 THEN ' REV B.pdf' ELSE ' REV A.pdf' END AS path, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'BE' || lpad(CAST(p_partkey AS STRING), 7, '0') || '-A' END AS bom_id FROM part"


@_query(B._VERIFIED + ", " + B._MATCHES.removeprefix("WITH ") + f""", au AS ({_AUDIT}) SELECT au.path, au.bom_id, COALESCE(fm.target, '') AS name_target, COALESCE(fm.match_len, 0) AS match_len, COALESCE(fm.strength, 'NO_MATCH') AS strength, round(COALESCE(fm.score, 0), 6) AS score, COALESCE(h.code, '') AS header_code, COALESCE(h.revision, '') AS header_rev,
COALESCE(vh.matched, FALSE) AS matched, COALESCE(vh.reason, 'NOT_OPENED') AS reason, COALESCE(vh.target, '') AS header_target, COALESCE(vh.match_len, 0) AS header_match_len FROM au LEFT JOIN fm ON fm.path = au.path LEFT JOIN bom_headers h ON h.bom_id = au.bom_id LEFT JOIN vh ON vh.bom_id = au.bom_id""")
def header_audit(spark, d):
    files = _over(spark, d, _AUDIT, "part")
    return P.header_audit(files, V.match_targets(*B._named(spark, d)), view(spark, d, "bom_headers"), B._verified_headers(spark, d)).withColumn("score", F.round("score", 6))


# --- graph and tree --------------------------------------------------------------------------

@_query(B._FOREST + """, rt AS (SELECT DISTINCT code FROM bom_headers WHERE code NOT IN (SELECT child FROM g)) SELECT DISTINCT h.code, h.revision AS rev, CAST(0 AS BIGINT) AS indegree, '' AS parents, (SELECT string_agg(DISTINCT revision, ';' ORDER BY revision) FROM bom_headers b WHERE b.code = h.code) AS revs FROM bom_headers h WHERE h.code IN (SELECT code FROM rt)""")
def root_candidates(spark, d):
    h, g = view(spark, d, "bom_headers"), B._forest(spark, d)
    return P.root_candidates(G.roots(g, h), g, h)


@_query(B._GRAPH + """, hs AS (SELECT DISTINCT code || CASE WHEN CAST(substr(code, 2) AS BIGINT) % 3 = 0 THEN '-01' ELSE '' END AS code FROM bom_headers), al AS (SELECT regexp_extract(code, '^(.+)-[0-9][0-9]$', 1) AS base, min(code) AS "full" FROM hs WHERE code LIKE '%-__' GROUP BY 1 HAVING count(*) = 1)
SELECT base, "full", base IN (SELECT code FROM hs) AS base_is_header, "full" IN (SELECT code FROM hs) AS full_is_header, (SELECT count(DISTINCT parent) FROM g WHERE child = base) AS base_indegree, (SELECT count(DISTINCT parent) FROM g WHERE child = "full") AS full_indegree FROM al""")
def alias_suspects(spark, d):
    h = view(spark, d, "bom_headers")
    renamed = h.withColumn("code", F.concat("code", F.when(F.substring("code", 2, 7).cast("int") % 3 == 0, "-01").otherwise("")))
    return P.alias_suspects(G.base_aliases(renamed), B._graph(spark, d), renamed)


# All simple cycles, each from its least code.
@_query(B._GRAPH + """, r AS (SELECT [parent, child] AS p FROM g WHERE child >= parent UNION ALL SELECT list_append(r.p, g.child) FROM r JOIN g ON g.parent = r.p[len(r.p)] WHERE r.p[1] <> r.p[len(r.p)] AND (g.child = r.p[1] OR (g.child > r.p[1] AND NOT list_contains(r.p, g.child))))
SELECT p[1] AS head, CAST(len(p) - 1 AS INTEGER) AS length, array_to_string(p, ' > ') AS path FROM r WHERE p[1] = p[len(p)]""")
def graph_cycles(spark, d):
    return P.graph_cycles(B._graph(spark, d))


@_query(with_views("pbs_rows") + ", p AS (" + B._parents("pbs_rows") + ") SELECT DISTINCT q.code, p.code AS child FROM p JOIN p q ON q.seq = p.parent_seq WHERE p.code <> '' AND q.code <> ''")
def code_tree(spark, d):
    return P.code_tree(T.level_parents(view(spark, d, "pbs_rows")))


@_query(with_views("pbs_rows") + "SELECT code, count(*) AS occurrences, min(seq) AS first_seq, array_to_string(list(seq ORDER BY seq), ',') AS seqs FROM pbs_rows WHERE code <> '' GROUP BY code")
def structure_index(spark, d):
    return P.structure_index(view(spark, d, "pbs_rows")).withColumn("seqs", F.array_join("seqs", ","))


_ASKED = "SELECT CASE p_partkey % 3 WHEN 0 THEN lower('E' || lpad(CAST(p_partkey AS STRING), 7, '0')) WHEN 1 THEN 'E' || lpad(CAST(p_partkey AS STRING), 7, '0') ELSE 'Q' || CAST(p_partkey AS STRING) END AS code FROM part"


@_query(with_views("bom_headers", "bom_lines") + f""", q AS ({_ASKED}), r AS (SELECT internal_code AS code, trim(description) AS description, trim(manufacturer) AS manufacturer, row_number() OVER (PARTITION BY internal_code ORDER BY length(trim(description)) DESC, seq) AS a, row_number() OVER (PARTITION BY internal_code ORDER BY length(trim(manufacturer)) DESC, seq) AS b FROM bom_lines),
m AS (SELECT code, max(CASE WHEN a = 1 THEN description END) AS description, max(CASE WHEN b = 1 THEN manufacturer END) AS manufacturer FROM r GROUP BY code) SELECT q.code, m.description, m.manufacturer FROM q JOIN m ON m.code = upper(q.code)""")
def master_lookup(spark, d):
    master = G.part_master(view(spark, d, "bom_lines"), K.norm(F.col("internal_code")))
    return P.master_lookup(_over(spark, d, _ASKED, "part"), master, K.canonical_pn(F.col("code")))[0]


@_query(with_views("bom_headers", "bom_lines") + f", q AS ({_ASKED}) SELECT DISTINCT code FROM q WHERE upper(code) NOT IN (SELECT internal_code FROM bom_lines) ORDER BY code LIMIT 20")
def master_misses(spark, d):
    master = G.part_master(view(spark, d, "bom_lines"), K.norm(F.col("internal_code")))
    return P.master_lookup(_over(spark, d, _ASKED, "part"), master, K.canonical_pn(F.col("code")))[1]


# --- whole rows of reports -------------------------------------------------------------------

@_query(_TRACES + """, wp AS (SELECT DISTINCT child_code, child_rev, parent_code, parent_rev FROM walk WHERE state = 'EDGE') SELECT tc.context, tc.expected_code, tc.expected_rev, COALESCE(wp.parent_code, '') AS source_parent_code, COALESCE(wp.parent_rev, '') AS source_parent_rev, tc.n_candidates, COALESCE(s.bid, '') AS selected_bom_id,
tc.selected_code, tc.selected_rev, tc.outcome, tc.note, tc.suggestion, tc.suspicious FROM tc LEFT JOIN wp ON tc.context = 'EXPLODE_CHILD' AND wp.child_code = tc.expected_code AND wp.child_rev = tc.expected_rev LEFT JOIN strict s ON s.code = tc.selected_code AND s.revision = tc.selected_rev""")
def resolution_trace_rows(spark, d):
    e = B._exploded(spark, d)
    return RR.trace_rows(_traced(spark, d, e), e.edges(), view(spark, d, "bom_headers"))


def _diagnosed_sql() -> str:
    """The diagnosis as a table ``dx``, beside the chain breaks of the same explosion."""
    walk, whole = B._walk_with_structure(), B._SQL["unexploded_diagnosis"]
    ctes, last = whole[len(walk) :].rsplit("\nSELECT dg.code", 1)
    return B._BREAKS.replace(B._STRICT_WALK, walk) + ctes + ", dx AS (SELECT dg.code" + last + ") "


@_query(_diagnosed_sql() + """SELECT dx.*, CASE WHEN cl.code IS NULL THEN '' WHEN cl.dist = 0 THEN 'ROOT' ELSE 'CASCADE' END AS classification, CASE WHEN cl.code IS NULL THEN '' WHEN cl.dist = 0 THEN '1' ELSE '0' END AS root_chain_break,
COALESCE(CAST(cl.dist AS VARCHAR), '') AS cascade_depth, CASE WHEN cl.dist > 0 THEN cl.root ELSE '' END AS not_reached_by_root FROM dx LEFT JOIN cl ON cl.code = dx.code""")
def unexploded_diagnosis_rows(spark, d):
    rows = view(spark, d, "pbs_rows")
    e = B._exploded(spark, d)
    classes = B.C.chain_breaks(T.level_parents(rows), T.effective_children(rows), e.edges().select(F.col("child_code").alias("code")), e.exploded())[1]
    return RR.diagnosis_rows(B._diagnosed(spark, d, e), classes)


@_query(_REASONS + B._SIGHT + """, sv AS (SELECT code, arg_max(rev, seq) AS rev FROM pbs_rows WHERE code <> '' AND rev <> '' GROUP BY code), cn AS (SELECT pq.code, max(ch.n) AS n FROM pq JOIN ch ON ch.parent_seq = pq.seq GROUP BY pq.code)
SELECT rs.code, CASE WHEN un.code IS NULL THEN '' ELSE COALESCE(sv.rev, '') END AS rev, CASE WHEN un.code IS NULL OR eff.n IS NULL THEN '' ELSE COALESCE(fst.parent, '') END AS parent, CASE WHEN un.code IS NULL OR eff.n IS NULL THEN '' ELSE COALESCE(fst.parent_rev, '') END AS parent_rev,
CASE WHEN un.code IS NULL OR eff.n IS NULL THEN '' ELSE COALESCE(CAST(fst.pos AS VARCHAR), '') END AS pos, COALESCE(cn.n, 0) AS children, rs.impacted, rs.reason, rs.suggestion FROM rs LEFT JOIN un ON un.code = rs.code LEFT JOIN eff ON eff.code = rs.code LEFT JOIN fst ON fst.code = rs.code LEFT JOIN sv ON sv.code = rs.code LEFT JOIN cn ON cn.code = rs.code""")
def chain_break_rows(spark, d):
    from .plans.pipelines import occurrences_in_lists

    rows, h, lines, e = view(spark, d, "pbs_rows"), view(spark, d, "bom_headers"), view(spark, d, "bom_lines"), B._strict(spark, d)
    open_codes, reached = B.C.unexploded(rows, h, e.exploded()), e.edges().select(F.col("child_code").alias("code"))
    diagnosis = B.C.diagnose_unexploded(open_codes, T.effective_children(rows, "reset"), reached, occurrences_in_lists(lines, h), e.exploded(), R.structure_revs(rows))
    return RR.break_rows(_reasons(spark, d, e), diagnosis, T.effective_children(rows))


@_query(B._MISMATCH + """, lk AS (SELECT DISTINCT ln.parent, s.rev AS parent_rev, ln.bid AS bom_id FROM ln JOIN s ON s.seq = ln.seq), fr AS (SELECT code AS parent, max(seq) AS parent_seq FROM s GROUP BY code),
l1 AS (SELECT parent, child, min(extra) AS extra FROM lv WHERE lev <= 1 GROUP BY ALL), l2 AS (SELECT parent, extra, min(CASE WHEN lev <= 1 THEN child END) AS one, min(CASE WHEN left(substr(child, 2), 6) = left(substr(extra, 2), 6) THEN child END) AS six FROM lv GROUP BY ALL),
rr AS (SELECT mm.parent, CASE WHEN optional OR cascade THEN 'WARN' ELSE 'ERROR' END AS severity, CASE WHEN optional THEN 'CHILD_MISSING_IN_BOM_OPTIONAL' ELSE 'CHILD_MISSING_IN_BOM' END AS category, CASE WHEN cascade THEN 'CASCADE' ELSE 'ROOT' END AS place, mm.child AS structure_child, '' AS list_child, COALESCE('the list has ' || l1.extra || ', edits: 1', '') AS suggestion, CASE WHEN optional THEN 'quantity 0 in the structure' ELSE '' END AS note FROM mm LEFT JOIN l1 ON l1.parent = mm.parent AND l1.child = mm.child
UNION ALL SELECT l2.parent, CASE WHEN c.cascade THEN 'WARN' ELSE 'ERROR' END, 'TYPO_SUSPECT_CHILD_MISMATCH', CASE WHEN c.cascade THEN 'CASCADE' ELSE 'ROOT' END, '', l2.extra, CASE WHEN one IS NOT NULL THEN 'write ' || one || ', edits: 1' ELSE 'may be ' || six || ', digits alike: 6' END, '' FROM l2 JOIN (SELECT DISTINCT parent, cascade FROM mm) c ON c.parent = l2.parent WHERE one IS NOT NULL OR six IS NOT NULL)
SELECT severity, category, place, rr.parent, parent_rev, parent_seq, lk.bom_id, structure_child, list_child, COALESCE((SELECT string_agg(CAST(line_no AS VARCHAR), ';' ORDER BY line_no) FROM bom_lines b WHERE b.bom_id = lk.bom_id AND b.internal_code = rr.list_child AND b.kind <> 'DOCUMENT_REF'), '') AS positions, suggestion, note FROM rr JOIN lk ON lk.parent = rr.parent JOIN fr ON fr.parent = rr.parent""")
def parent_child_mismatch_rows(spark, d):
    rows, h, lines, e = B._findings(spark, d)
    return RR.mismatch_rows(T.level_parents(rows, "skip"), h, lines, e.edges().select(F.col("parent_code").alias("code")), B.C.unexploded(rows, h, e.exploded()))


# --- import file -----------------------------------------------------------------------------

_RELEASES = "SELECT CASE WHEN r_regionkey = 1 THEN '' ELSE 'R1' END AS name, CASE WHEN r_regionkey = 2 THEN '2024/01/02' ELSE '2024-01-02 03:04:05' END AS parsed_at FROM region"
_RELEASED = "SELECT CASE WHEN s_suppkey % 6 = 0 THEN 'R0' ELSE ' R1' END AS release_id FROM supplier"


@_query(f"""WITH r AS ({_RELEASES}), l AS ({_RELEASED}) SELECT 'ERROR' AS level, 'RELEASE_ROWS' AS "check", (SELECT CASE WHEN count(*) = 1 THEN 0 ELSE greatest(count(*), 1) END FROM r) AS n UNION ALL SELECT 'ERROR', 'RELEASE_NAME', (SELECT count(*) FROM r WHERE trim(name) = '')
UNION ALL SELECT 'WARN', 'STAMP_FORMAT', (SELECT count(*) FROM r WHERE NOT regexp_full_match(parsed_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')) UNION ALL SELECT 'WARN', 'RELEASE_ID', (SELECT count(*) FROM l WHERE trim(release_id) <> (SELECT max(name) FROM r))""")
def release_check_failing(spark, d):
    """A release of several rows, one without a name, one with another stamp, and lines of another release."""
    return P.check_release(_over(spark, d, _RELEASES, "region"), _over(spark, d, _RELEASED, "supplier"))


@_query(with_views("pbs_rows") + """, p AS (SELECT a.seq, a.code, a.rev, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level = a.level - 1) AS up, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level < a.level - 1) AS higher, row_number() OVER (ORDER BY a.seq) AS k FROM pbs_rows a),
x AS (SELECT p.k, 'PBS__line__' || lpad(CAST(p.k AS STRING), 6, '0') AS id, p.code || '|' || p.rev AS key, COALESCE('PBS__line__' || lpad(CAST(q.k AS STRING), 6, '0'), '') AS up FROM p LEFT JOIN p q ON q.seq = CASE WHEN p.higher IS NULL OR p.up > p.higher THEN p.up END),
b AS (SELECT k // 1024 AS k, sha256(string_agg(sha256(id || '|' || key || '|' || up), '' ORDER BY k, id)) AS h FROM x GROUP BY k // 1024), c AS (SELECT k // 1024 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM b GROUP BY k // 1024)
SELECT 'PBS' AS name, 'pbs.xlsx' AS source_filename, sha256(string_agg(h, '' ORDER BY k)) AS source_hash, '2024-01-02 03:04:05' AS parsed_at, 'draft' AS status FROM c""")
def export_release(spark, d):
    from .operators.sinks import export_lines

    return P.export_release(export_lines(view(spark, d, "pbs_rows"), "PBS"), "PBS", "pbs.xlsx", F.lit("2024-01-02 03:04:05").cast("timestamp"))


# --- headers ---------------------------------------------------------------------------------

_CELLS = """SELECT CAST(p_partkey AS STRING) AS file_id, 1 AS row, 1 AS col, 'P/N: X' || CAST(p_size AS STRING) AS value FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT CAST(p_partkey AS STRING), 2, 2, ' part no' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS STRING), 2, 2 + p_size % 11, 'C' || CAST(p_size AS STRING) FROM part WHERE p_size % 11 > 0
UNION ALL SELECT CAST(p_partkey AS STRING), 4, 3, CASE WHEN p_size % 4 = 0 THEN 'REV: B' WHEN p_size % 4 = 1 THEN 'Rev.' ELSE 'other' END FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 4, 5, 'D1' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT CAST(p_partkey AS STRING), 70, 1, 'PN Z9' FROM part"""
_NAMED = "SELECT CAST(p_partkey AS STRING) AS file_id, CASE WHEN p_size % 2 = 0 THEN 'LIST ' || CAST(p_partkey + 3000000 AS STRING) || ' REV E.xls' ELSE 'LIST.xls' END AS name FROM part"


@_query(f"""WITH c AS (SELECT file_id, row, col, trim(value) AS t FROM ({_CELLS}) WHERE row <= 60 AND col <= 30 AND trim(value) <> ''), m AS (SELECT *, regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') AS label, lead(t) OVER w AS nt, lead(col) OVER w AS nc FROM c WINDOW w AS (PARTITION BY file_id, row ORDER BY col)),
k AS (SELECT *, COALESCE(nullif(regexp_extract(t, '(?i)\\bP\\s*/\\s*N\\b\\s*[:\\-]?\\s*([A-Z0-9\\-_.]+)', 1), ''), nullif(regexp_extract(t, '(?i)\\bPN\\b\\s*[:\\-]?\\s*([A-Z0-9\\-_.]+)', 1), '')) AS ic, nullif(regexp_extract(t, '(?i)\\bREV(?:ISION)?\\b\\s*[:\\-]?\\s*([A-Z0-9]+)\\b', 1), '') AS ir, CASE WHEN nc - col <= 8 THEN nt END AS near FROM m),
v AS (SELECT *, COALESCE(ic, CASE WHEN label IN ('PN', 'PARTNUMBER', 'PARTNO') THEN near END) AS cv, CASE WHEN label LIKE 'REV%' THEN COALESCE(ir, near) END AS rv, chr(CAST(64 + CASE WHEN ic IS NULL THEN nc ELSE col END AS INTEGER)) || row AS cc, chr(CAST(64 + CASE WHEN ir IS NULL THEN nc ELSE col END AS INTEGER)) || row AS rc FROM k),
fc AS (SELECT file_id, cv, CASE WHEN ic IS NOT NULL THEN 'sheet_inline' ELSE 'sheet_label_right' END AS s, cc FROM v WHERE cv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY row, col) = 1), fr AS (SELECT file_id, rv, CASE WHEN ir IS NOT NULL THEN 'sheet_inline' ELSE 'sheet_label_right' END AS s, rc FROM v WHERE rv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY row, col) = 1),
n AS (SELECT file_id, nullif(regexp_extract(name, '\\b([0-9]{{6,}})\\b', 1), '') AS nc, nullif(regexp_extract(name, '(?i)\\bREV\\s+([A-Z0-9]+)\\b', 1), '') AS nr FROM ({_NAMED}))
SELECT n.file_id, COALESCE(fc.cv, nc, '') AS code, CASE WHEN fc.cv IS NOT NULL THEN fc.s WHEN nc IS NOT NULL THEN 'filename_fallback' ELSE 'missing_in_sheet' END AS code_source, COALESCE(fc.cc, '') AS code_cell, COALESCE(fr.rv, nr, '') AS rev, CASE WHEN fr.rv IS NOT NULL THEN fr.s WHEN nr IS NOT NULL THEN 'filename_fallback' ELSE 'missing_in_sheet' END AS rev_source, COALESCE(fr.rc, '') AS rev_cell FROM n LEFT JOIN fc ON fc.file_id = n.file_id LEFT JOIN fr ON fr.file_id = n.file_id""")
def sheet_headers(spark, d):
    return H.sheet_headers(_over(spark, d, _CELLS, "part"), _over(spark, d, _NAMED, "part"))


_PAGE_TEXT = """SELECT CAST(p_partkey AS STRING) AS file_id, 1 AS page, CASE WHEN p_size % 7 = 0 THEN 'nothing here' ELSE 'Codice / Code   E' || CAST(p_partkey + 100000 AS STRING) || ' 01     Revisione / Revision   0' || CAST(p_size % 10 AS STRING) END AS text FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 2, 'Descrizione / Description ' || CASE WHEN p_size % 3 = 0 THEN 'E' || CAST(p_partkey + 200000 AS STRING) || ' 01-03 frame' WHEN p_size % 3 = 1 THEN 'E' || CAST(p_partkey AS STRING) || '-7 frame' ELSE 'frame' END FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 3, 'Printing Date 01/02/2024' FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 2, 'Data di Stampa / 03/04/2023' FROM part WHERE p_size % 2 = 0"""
#: A code that a dash and a digit follow is cut out first, so the rest needs no look-ahead.
_ROOT = "upper(regexp_extract(regexp_replace({0}, '(?i)\\bE[0-9]+-[0-9]', ' ', 'g'), '(?i)\\b(E[0-9]+)\\b', 1))"
_PAGE_HEADERS = f"""WITH x AS ({_PAGE_TEXT}), j AS (SELECT file_id, string_agg(text, chr(10) ORDER BY page, text) AS t FROM x WHERE page <= 2 GROUP BY file_id),
h AS (SELECT file_id, trim(regexp_extract(t, '(?i)(?:Codice\\s*/\\s*Code|Codice|Code)\\s+([A-Z0-9 _.\\-]+?)\\s+(?:Revisione\\s*/\\s*Revision|Revisione|Revision)\\s+([A-Z0-9]+)', 1)) AS code, trim(regexp_extract(t, '(?i)(?:Codice\\s*/\\s*Code|Codice|Code)\\s+([A-Z0-9 _.\\-]+?)\\s+(?:Revisione\\s*/\\s*Revision|Revisione|Revision)\\s+([A-Z0-9]+)', 2)) AS rev,
 trim(regexp_extract(t, '(?i)(?:Descrizione\\s*/\\s*Description|Descrizione|Description)\\s+(.+)', 1)) AS title, regexp_extract(t, '(?i)(?:Data di Stampa|Printing Date)\\s*/?\\s*([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1) AS day FROM j),
p AS (SELECT file_id, code, rev, title, CASE WHEN day = '' THEN '' ELSE right(day, 4) || '-' || substr(day, 4, 2) || '-' || left(day, 2) END AS printed, COALESCE(nullif({_ROOT.format('title')}, ''), {_ROOT.format('code')}) AS root_code, CASE WHEN code = '' THEN 'NO_CODE' ELSE '' END AS error FROM h) """


def _page_headers(spark, d):
    return H.page_headers(_over(spark, d, _PAGE_TEXT, "part"))


@_query(_PAGE_HEADERS + "SELECT * FROM p")
def page_headers(spark, d):
    return _page_headers(spark, d)


@_query(_PAGE_HEADERS + "SELECT file_id, CASE WHEN code = '' THEN root_code ELSE regexp_replace(code, '\\s+', '-', 'g') END AS parsed, CASE WHEN code = '' THEN root_code ELSE regexp_extract(code, '^(E[0-9]+)') || '-' || rev END AS key FROM p")
def list_keys(spark, d):
    code = F.col("code")
    h = _page_headers(spark, d)
    return h.select("file_id", F.when(code == "", F.col("root_code")).otherwise(F.regexp_replace(code, r"\s+", "-")).alias("parsed"), H.list_key(code, F.col("rev"), F.col("root_code")).alias("key"))


_FOLDERS = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'e' || lpad(CAST(p_partkey AS STRING), 7, '0') || ' 01-0' || CAST(p_size % 10 AS STRING) WHEN 1 THEN 'x E' || lpad(CAST(p_partkey AS STRING), 8, '0') || '1_' || CAST(p_size AS STRING) ELSE 'folder ' || CAST(p_size AS STRING) END AS name FROM part"


@_query(f"WITH f AS ({_FOLDERS}), g AS (SELECT id, regexp_extract(upper(name), '(E[0-9]{{7,8}})\\s*0?1\\s*[-_ ]\\s*([0-9]{{1,2}})', 1) AS base, regexp_extract(upper(name), '(E[0-9]{{7,8}})\\s*0?1\\s*[-_ ]\\s*([0-9]{{1,2}})', 2) AS rev FROM f) SELECT * FROM g WHERE base <> ''")
def folder_hints(spark, d):
    return _over(spark, d, _FOLDERS, "part").select("id", H.folder_hint(F.col("name")).alias("h")).where("h is not null").select("id", "h.base", "h.rev")


_TOKENS = "SELECT p_partkey AS id, element_at(array('Q.tà', 'qt?!', 'Quantità tot.', 'Pos.', 'Rif. riga', 'Cod. Materiale', 'REV.', 'Revisioni', 'Descrizione / Description', 'U.M.', 'unità di misura', 'Tipo', 'Notes', 'Codice costruttore', 'Manufacturer code', 'Trade name', 'Rag.Soc./Comp.Name', 'Ditta', 'Nr', '', '???', 'Prezzo', 'unit price', 'Manufacturer'), CAST(p_partkey % 24 AS INTEGER) + 1) AS token FROM part"
_DUCK_TOKENS = _TOKENS.replace("element_at(array(", "list_extract([").replace("'Manufacturer'), CAST", "'Manufacturer'], CAST")
_KNOWN = " ".join(f"WHEN t IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in H.HEADER_NAMES.items())


@_query(f"""WITH x AS (SELECT id, token, regexp_replace(strip_accents(lower(trim(token))), '[^a-z0-9]+', '', 'g') AS t FROM ({_DUCK_TOKENS}))
SELECT id, t AS plain, CASE WHEN t = '' THEN NULL {_KNOWN} WHEN (t LIKE 'qt%' AND length(t) <= 7) OR (t LIKE '%quant%' AND length(t) <= 10) THEN 'qty' WHEN t LIKE '%revis%' THEN 'rev' WHEN t LIKE '%descr%' THEN 'desc' WHEN t LIKE '%cod%' OR t LIKE '%material%' THEN 'code' WHEN t LIKE '%pos%' OR t LIKE '%riga%' OR t LIKE '%item%' THEN 'pos'
WHEN t LIKE '%um%' OR t LIKE '%unit%' OR t LIKE '%uom%' THEN 'um' WHEN t LIKE '%tipo%' OR t LIKE '%type%' THEN 'type' WHEN t LIKE '%note%' THEN 'notes' WHEN t LIKE '%costrutt%' OR (t LIKE '%manufactur%' AND t LIKE '%code%') OR t LIKE '%trade%' THEN 'manufacturer_code' WHEN t LIKE '%manufactur%' OR t LIKE '%produtt%' OR t LIKE '%ditta%' OR t LIKE '%company%' THEN 'manufacturer' END AS name FROM x""")
def header_names(spark, d):
    return _over(spark, d, _TOKENS, "part").select("id", H.header_token(F.col("token")).alias("plain"), H.header_name(F.col("token")).alias("name"))


_LINES = "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Stato: bozza' WHEN 1 THEN 'Page 3 of 9' WHEN 2 THEN p_name || ' firma digitale release' ELSE p_name END AS said, CASE p_size % 3 WHEN 0 THEN 'E12' WHEN 1 THEN 'E1234567-01' ELSE 'e1234567' END AS code FROM part"


@_query(f"""WITH x AS ({_LINES}) SELECT id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(said, '(?i)THIS DOCUMENT CONTAINS|AUTORE|ORIGINATOR|STATO|STAGE|DATA RILASCIO|RILASCIO|RELEASE|PROPRIETA|CONFIDENZIALE') THEN 'footer_contamination' END, CASE WHEN regexp_matches(said, '(?i)firma digitale|digital signature') THEN 'signature_contamination' END,
CASE WHEN regexp_matches(said, '(?i)\\b(Pagina|Page|Sheet)\\s*[0-9]+\\b') THEN 'page_marker_contamination' END, CASE WHEN NOT regexp_full_match(trim(code), '[A-Z0-9][A-Z0-9._\\-/]{{4,}}') THEN 'weak_code_pattern' END], lambda y: y IS NOT NULL)), ',') AS flags FROM x""")
def row_flags(spark, d):
    return _over(spark, d, _LINES, "part").select("id", F.array_join(H.row_flags([F.col("said")], F.col("code")), ",").alias("flags"))


@_query("SELECT p_partkey AS id, CASE WHEN p_partkey > 702 THEN chr(65 + CAST((p_partkey - 703) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN p_partkey > 26 THEN chr(65 + CAST((p_partkey - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(65 + CAST((p_partkey - 1) % 26 AS INTEGER)) AS letters FROM part WHERE p_partkey BETWEEN 1 AND 16384")
def column_letters(spark, d):
    """As far as a sheet has columns."""
    return spark.read.parquet(f"{d}/part.parquet").where("p_partkey BETWEEN 1 AND 16384").select(F.col("p_partkey").alias("id"), H.column_letters(F.col("p_partkey")).alias("letters"))


_SAID = "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'e' || CAST(p_partkey AS STRING) || ' rev ' || CAST(p_size AS STRING) ELSE ' E' || CAST(p_partkey AS STRING) END AS header, CASE WHEN p_size % 2 = 0 THEN 'Qty mancante: parent=P' || CAST(p_partkey AS STRING) || ' rev A -> child=C' || CAST(p_size AS STRING) || ' (pos=0010)' ELSE 'other' END AS warning FROM part"


@_query(f"WITH x AS ({_SAID}) SELECT id, CASE WHEN upper(trim(header)) LIKE '% REV %' THEN split_part(upper(trim(header)), ' REV ', 1) ELSE upper(trim(header)) END AS code, CASE WHEN upper(trim(header)) LIKE '% REV %' THEN split_part(upper(trim(header)), ' REV ', 2) ELSE '' END AS rev, nullif(regexp_extract(warning, '(?i)parent=(.+?)\\s+rev\\s+(.+?)\\s*->\\s*child=(.+?)\\s*\\(pos=(.*?)\\)', 1), '') AS parent, nullif(regexp_extract(warning, '(?i)parent=(.+?)\\s+rev\\s+(.+?)\\s*->\\s*child=(.+?)\\s*\\(pos=(.*?)\\)', 3), '') AS child FROM x")
def said_headers(spark, d):
    x = _over(spark, d, _SAID, "part").select("id", H.header_parts(F.col("header")).alias("h"), H.warned_line(F.col("warning")).alias("w"))
    return x.select("id", "h.code", "h.rev", "w.parent", "w.child")


_TOTAL_CELLS = "SELECT CAST(p_size AS STRING) AS file_id, CAST(p_partkey % 9 AS INTEGER) + 1 AS row, CAST(p_partkey % 5 AS INTEGER) + 1 AS col, CASE p_partkey % 8 WHEN 0 THEN 'Internal  Code' WHEN 1 THEN 'Q.ty' WHEN 2 THEN 'Item' WHEN 3 THEN 'Totale pezzi' WHEN 4 THEN 'Part number' ELSE 'x' END AS value FROM part"


@_query(f"""WITH c AS (SELECT file_id, row, col, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS h FROM ({_TOTAL_CELLS})), a AS (SELECT file_id, row, min(col) FILTER (WHERE h LIKE '%internal code%') AS sc, min(col) FILTER (WHERE regexp_matches(h, 'q\\.ty|q ty|q\\.t y')) AS sq, min(col) FILTER (WHERE regexp_matches(h, 'pn|part|code|codice|item|articolo')) AS wc, min(col) FILTER (WHERE regexp_matches(h, 'q\\.ty|qty|qta|quantity|quantità|quantita|totale')) AS wq FROM c GROUP BY ALL),
b AS (SELECT file_id, row, COALESCE(sc, wc) AS code_col, COALESCE(sq, wq) AS qty_col, CASE WHEN sc IS NULL THEN 10 ELSE 100 END + CASE WHEN sq IS NULL THEN 10 ELSE 100 END AS score FROM a) SELECT * FROM b WHERE code_col IS NOT NULL AND qty_col IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, row) = 1""")
def totals_header(spark, d):
    return H.totals_header(_over(spark, d, _TOTAL_CELLS, "part"))


_TOTAL_FILES = "SELECT CASE page_id % 3 WHEN 0 THEN '/p/TOTALIZZ ' || CAST(page_id AS STRING) || '.xlsx' WHEN 1 THEN '/p/totalizzazione.xls' ELSE '/p/a.xls' END AS path FROM pages"


@_query(f"SELECT min(path) AS path FROM ({_TOTAL_FILES}) WHERE regexp_matches(upper(path), '/TOTALIZZ[^/]*\\.XLS')")
def totals_file(spark, d):
    return H.totals_file(_over(spark, d, _TOTAL_FILES, "pages"))


_STRUCTURE = """SELECT CAST(p_size AS STRING) AS file_id, 3 AS row, CAST(x.k AS INTEGER) AS col, CASE x.k WHEN 1 THEN 'Codice' WHEN 3 THEN 'descrizione' WHEN 7 THEN 'Rev.' ELSE CASE WHEN p_size % 10 = 0 THEN 'n' ELSE 'Q t y' END END AS value FROM (SELECT DISTINCT p_size FROM part) s CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 7 UNION ALL SELECT 8) x
UNION ALL SELECT CAST(p_size AS STRING), CAST(p_partkey AS INTEGER) + 3, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END, ' E ' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT CAST(p_size AS STRING), CAST(p_partkey AS INTEGER) + 3, CAST(3 + p_partkey % 4 AS INTEGER), p_name FROM part WHERE p_partkey % 6 <> 0
UNION ALL SELECT CAST(p_size AS STRING), CAST(p_partkey AS INTEGER) + 3, 7, 'B' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT CAST(p_size AS STRING), CAST(p_partkey AS INTEGER) + 3, 8, CASE WHEN p_partkey % 4 = 0 THEN '2,5' ELSE 'x' END FROM part"""


@_query(f"""WITH c AS ({_STRUCTURE}) SELECT p.file_id AS doc_id, CAST(p.row AS BIGINT) AS seq, COALESCE((SELECT arg_min(trim(value), col) FROM c q WHERE q.file_id = p.file_id AND q.row = p.row AND col BETWEEN 1 AND 2), '') AS code, arg_min(trim(p.value), p.col) AS description, COALESCE((SELECT max(value) FROM c q WHERE q.file_id = p.file_id AND q.row = p.row AND col = 7), '') AS rev,
COALESCE((SELECT max(TRY_CAST(replace(value, ',', '.') AS DOUBLE)) FROM c q WHERE q.file_id = p.file_id AND q.row = p.row AND col = 8), 0) AS qty, min(p.col) - 3 AS level FROM c p WHERE p.row > 3 AND p.col BETWEEN 3 AND 6 AND CAST(p.file_id AS INTEGER) % 10 <> 0 GROUP BY p.file_id, p.row""")
def structure_sheet_rows(spark, d):
    """Blocks are inferred from the header; sheets whose header lacks a column give no rows."""
    cells = _over(spark, d, _STRUCTURE, "part")
    return I.indented_rows(cells, H.structure_blocks(cells).where("error = ''"))


@_query(f"WITH c AS ({_STRUCTURE}) SELECT DISTINCT file_id, 3 AS header_row, 1 AS code0, 2 AS code1, 3 AS desc0, 6 AS desc1, 7 AS rev_col, CASE WHEN CAST(file_id AS INTEGER) % 10 = 0 THEN NULL ELSE 8 END AS qty_col, CASE WHEN CAST(file_id AS INTEGER) % 10 = 0 THEN 'MISSING_COLUMNS' ELSE '' END AS error FROM c WHERE row = 3 AND value = 'Codice'")
def structure_blocks(spark, d):
    return H.structure_blocks(_over(spark, d, _STRUCTURE, "part"))


_PARSED = "SELECT CAST(p_size AS STRING) AS file_id, CAST(p_partkey % 4 AS INTEGER) + 1 AS page, CASE WHEN p_partkey % 97 = 0 THEN 'Page 1' ELSE p_name END AS said, CASE WHEN p_partkey % 89 = 0 THEN 'x' ELSE 'E' || lpad(CAST(p_partkey AS STRING), 7, '0') END AS code FROM part WHERE p_partkey % 4 <> p_size % 5"


@_query(f"""WITH r AS (SELECT *, said = 'Page 1' OR code = 'x' AS odd FROM ({_PARSED})), p AS (SELECT DISTINCT CAST(p_size AS STRING) AS file_id, k AS page FROM part CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)), a AS (SELECT p.file_id, count(DISTINCT p.page) AS n_pages FROM p GROUP BY 1), b AS (SELECT file_id, count(*) AS n_rows, count(DISTINCT page) AS pages_with_rows, count(*) FILTER (WHERE odd) AS suspicious FROM r GROUP BY 1)
SELECT a.file_id, n_pages, COALESCE(n_rows, 0) AS n_rows, COALESCE(pages_with_rows, 0) AS pages_with_rows, COALESCE(suspicious, 0) AS suspicious, COALESCE(pages_with_rows, 0) / n_pages AS coverage, COALESCE(n_rows, 0) > 0 AND COALESCE(suspicious, 0) = 0 AND COALESCE(pages_with_rows, 0) = n_pages AS complete FROM a LEFT JOIN b ON b.file_id = a.file_id""")
def page_report(spark, d):
    rows = _over(spark, d, _PARSED, "part").select("file_id", "page", H.row_flags([F.col("said")], F.col("code")).alias("flags"))
    pages = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("string").alias("file_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("page"))
    return H.page_report(rows, pages)


_WORDS = """SELECT CAST(p_size AS STRING) AS file_id, 1 AS page, CAST((p_partkey // 50) * 12 + p_partkey % 2 AS DOUBLE) AS top, CAST(10 AS DOUBLE) AS x0, CASE WHEN p_partkey % 3 = 0 THEN 'foot' ELSE lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') END AS text FROM part
UNION ALL SELECT CAST(p_size AS STRING), 1, CAST((p_partkey // 50) * 12 AS DOUBLE), CAST(60 + p_partkey % 50 AS DOUBLE), 'W' || CAST(p_partkey AS STRING) FROM part"""
_LABELS = "SELECT DISTINCT CAST(p_size AS STRING) AS file_id, c.col, CAST(c.x0 AS DOUBLE) AS x0 FROM part CROSS JOIN (SELECT 'pos' AS col, 10 AS x0 UNION ALL SELECT 'code', 50 UNION ALL SELECT 'qty', 120) c"


@_query(f"""WITH w AS ({_WORDS}), g AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY file_id, page ORDER BY top) > 3 THEN 1 ELSE 0 END AS b FROM w), l AS (SELECT file_id, page, text, x0, top, sum(b) OVER (PARTITION BY file_id, page ORDER BY top RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS line FROM g),
p AS (SELECT *, CASE WHEN x0 < 30 THEN 'pos' WHEN x0 < 85 THEN 'code' ELSE 'qty' END AS col FROM l) SELECT file_id, page, CAST(line AS BIGINT) AS line, col, string_agg(text, ' ' ORDER BY x0, text) AS text FROM p WHERE (file_id, page, line) IN (SELECT (file_id, page, line) FROM l WHERE regexp_full_match(text, '[0-9]{{4}}')) GROUP BY file_id, page, line, col""")
def words_by_layout(spark, d):
    words = _over(spark, d, _WORDS.replace("//", "div"), "part")
    return H.words_by_layout(words, _over(spark, d, _LABELS, "part")).withColumn("line", F.col("line").cast("bigint"))


@_query(B._WALK + "SELECT 'explode_edges' AS report, array_to_string(path, '>') AS path, repeat('  ', depth - 1) || child_code || ' x ' || CAST(CAST(qty AS BIGINT) AS VARCHAR) AS line FROM walk WHERE state = 'EDGE'")
def edge_lines(spark, d):
    """The explosion as indented text."""
    from .operators.sinks import edge_text

    e = B._exploded(spark, d).edges()
    named = edge_text(e.withColumn("qty", F.col("qty").cast("bigint")))
    return named.join(e.select("dfs_key", F.array_join("path", ">").alias("path")), "dfs_key").select(F.lit("explode_edges").alias("report"), "path", "line")


@_query(with_views("pbs_rows") + "SELECT doc_id, seq, repeat('  ', level - (SELECT min(level) FROM pbs_rows)) || trim(code || CASE WHEN rev <> '' THEN ' REV ' || rev ELSE '' END) AS line FROM pbs_rows")
def tree_lines(spark, d):
    """The structure as indented text."""
    from .operators.sinks import tree_text

    return tree_text(view(spark, d, "pbs_rows"))
