"""All queries of the product-structure operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .adapters import lists, view, with_views
from .functions import keys as K
from .operators import explode as X
from .operators import graph as G
from .operators import reconcile as C
from .operators import resolve as R
from .operators import tree as T
from .operators import views as V
from .sources import files as S
from .sources import grids as I

ROOT = "E0000001"
POLICY = X.Policy(explode_unknown=True, root_strict_rev=False)
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import catalog_reports as more
    from . import catalog_sources as sources

    return _QUERIES | more.QUERIES | sources.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_reports as more
    from . import catalog_sources as sources

    return _SQL | more.SQL | sources.SQL


# --- explosion -------------------------------------------------------------------------------

_WALK = with_views("bom_headers", "bom_lines", "structure_revs", recursive=True) + """,
hdr AS (SELECT DISTINCT code, revision, bom_id FROM bom_headers),
strict AS (SELECT code, revision, arg_min(bom_id, bom_seq) AS bid FROM bom_headers GROUP BY code, revision),
best AS (SELECT * FROM (SELECT code, bom_id AS tid, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY revision DESC, bom_seq) AS rn FROM bom_headers) WHERE rn = 1),
lines AS (SELECT l.*, COALESCE(r.rev, '') AS child_rev FROM bom_lines l LEFT JOIN structure_revs r ON r.code = l.internal_code WHERE l.kind <> 'DOCUMENT_REF'),
adj AS (SELECT l.bom_id, h.code AS parent_code, h.revision AS parent_rev, l.line_no, l.internal_code AS child_code, l.child_rev, l.qty,
  CASE WHEN upper(l.unit) IN ('PZ', 'NR') THEN 'NR' WHEN upper(l.unit) = 'MT' THEN 'M' ELSE upper(l.unit) END AS unit, COALESCE(s.bid, t.tid) AS next_bom_id,
  CASE WHEN s.bid IS NOT NULL THEN 'OK' WHEN t.n IS NULL THEN 'MISSING_FILE' WHEN l.child_rev = '' AND t.n = 1 THEN 'OK' ELSE 'FALLBACK' END AS outcome
  FROM lines l JOIN hdr h ON h.bom_id = l.bom_id LEFT JOIN strict s ON s.code = l.internal_code AND s.revision = l.child_rev AND l.child_rev <> '' LEFT JOIN best t ON t.code = l.internal_code),
walk AS (
  SELECT 1 AS depth, ['E0000001', a.child_code] AS path, lpad(CAST(line_no AS STRING), 2, '0') AS k, a.parent_code, a.parent_rev, a.child_code, a.child_rev, a.qty AS line_qty, a.qty AS qty, a.unit, a.bom_id, a.next_bom_id, a.outcome,
    CASE WHEN a.qty IS NULL THEN 'MISSING_QTY' WHEN a.qty <= 0 THEN 'NON_POSITIVE' WHEN a.child_code = 'E0000001' THEN 'CYCLE' ELSE 'EDGE' END AS state
  FROM adj a JOIN best b ON b.tid = a.bom_id WHERE b.code = 'E0000001'
  UNION ALL
  SELECT w.depth + 1, list_append(w.path, a.child_code), w.k || '.' || lpad(CAST(a.line_no AS STRING), 2, '0'), a.parent_code, a.parent_rev, a.child_code, a.child_rev, a.qty, w.qty * a.qty, a.unit, a.bom_id, a.next_bom_id, a.outcome,
    CASE WHEN a.qty IS NULL THEN 'MISSING_QTY' WHEN a.qty <= 0 THEN 'NON_POSITIVE' WHEN list_contains(w.path, a.child_code) THEN 'CYCLE' ELSE 'EDGE' END
  FROM walk w JOIN adj a ON a.bom_id = w.next_bom_id WHERE w.state = 'EDGE')
"""


def _exploded(spark, d) -> X.Explosion:
    return X.explode(spark, *lists(spark, d), ROOT, "", view(spark, d, "structure_revs"), POLICY)


def _reached(spark, d) -> X.Reach:
    return X.explode_reach(spark, *lists(spark, d), ROOT, "", view(spark, d, "structure_revs"), POLICY)


def _summed(spark, d) -> X.Sums:
    return X.explode_sums(spark, *lists(spark, d), ROOT, "", view(spark, d, "structure_revs"), POLICY)


def _whole(c):
    return F.col(c).cast("bigint")


@_query(with_views("bom_edges", recursive=True) + """, w AS (SELECT child AS code, qty, 1 AS depth FROM bom_edges WHERE parent = 'E0000001' UNION ALL SELECT e.child, w.qty * e.qty, w.depth + 1 FROM w JOIN bom_edges e ON e.parent = w.code)
SELECT code, CAST(SUM(qty) AS BIGINT) AS qty, count(*) AS visits, max(depth) AS max_depth FROM w GROUP BY code""")
def explode_totals(spark, d):
    return X.explode_totals(view(spark, d, "bom_edges"), spark.createDataFrame([(ROOT,)], "code string"))


@_query(_WALK + "SELECT depth, array_to_string(path, '>') AS path, parent_code, child_code, child_rev, CAST(qty AS BIGINT) AS qty, unit, outcome FROM walk WHERE state = 'EDGE'")
def explode_edges(spark, d):
    return _exploded(spark, d).edges().select("depth", F.array_join("path", ">").alias("path"), "parent_code", "child_code", "child_rev", _whole("qty").alias("qty"), "unit", "outcome")


@_query(_WALK + "SELECT array_to_string(path, ' -> ') AS path, CAST(qty AS BIGINT) AS qty FROM walk WHERE state = 'CYCLE'")
def explode_cycles(spark, d):
    return _exploded(spark, d).cycles().select(F.array_join("path", " -> ").alias("path"), _whole("qty").alias("qty"))


@_query(_WALK + "SELECT parent_code, parent_rev, child_code, unit, count(*) AS n FROM walk WHERE state = 'MISSING_QTY' GROUP BY ALL")
def explode_missing_qty(spark, d):
    return _exploded(spark, d).missing().groupBy("parent_code", "parent_rev", "child_code", "unit").agg(F.count("*").alias("n"))


@_query(_WALK + "SELECT child_code AS code, CAST(SUM(qty) AS BIGINT) AS qty, count(*) AS visits, max(depth) AS max_depth FROM walk WHERE state IN ('EDGE', 'CYCLE') GROUP BY child_code")
def explode_qty_by_code(spark, d):
    return _summed(spark, d).totals().withColumn("qty", _whole("qty"))


@_query(_WALK + "SELECT child_code AS code, child_rev AS rev, CAST(SUM(qty) AS BIGINT) AS qty FROM walk WHERE state IN ('EDGE', 'CYCLE') GROUP BY ALL")
def explode_qty_by_code_rev(spark, d):
    return _summed(spark, d).totals_by_rev().withColumn("qty", _whole("qty"))


@_query(_WALK + "SELECT child_code AS code, arg_min(unit, k) AS uom FROM walk WHERE unit <> '' GROUP BY child_code")
def explode_uom_first(spark, d):
    return _summed(spark, d).units().select("code", "uom")


@_query(_WALK + "SELECT DISTINCT child_code AS code FROM walk WHERE unit <> '' AND unit <> 'NR'")
def non_nr_codes(spark, d):
    return _summed(spark, d).units().where("other").select("code")


@_query(_WALK + ", e AS (SELECT bom_id FROM walk UNION SELECT next_bom_id FROM walk WHERE state = 'EDGE') SELECT DISTINCT h.code, h.revision AS rev FROM e JOIN hdr h ON h.bom_id = e.bom_id")
def exploded_assemblies(spark, d):
    return _summed(spark, d).exploded()


@_query(_WALK + "SELECT outcome, count(*) AS n, count(DISTINCT child_code) AS codes FROM walk WHERE state = 'EDGE' GROUP BY outcome")
def resolution_outcomes(spark, d):
    return _exploded(spark, d).edges().groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("child_code").alias("codes"))


@_query(_WALK + "SELECT DISTINCT parent_code AS parent, child_code AS child FROM walk WHERE state = 'EDGE' AND list_contains(path, 'E0000003') AND child_code <> 'E0000003' AND list_position(path, 'E0000003') < len(path)")
def subtree_edges(spark, d):
    return V.subtree(_exploded(spark, d).edges(), "E0000003")


@_query(with_views("bom_edges") + "SELECT child AS code, count(DISTINCT parent) AS n_parents, string_agg(DISTINCT parent, ';' ORDER BY parent) AS parents FROM bom_edges GROUP BY child")
def where_used(spark, d):
    return G.where_used(view(spark, d, "bom_edges"))


# --- resolution ------------------------------------------------------------------------------

@_query(_WALK + """, wanted AS (SELECT DISTINCT internal_code AS code, child_rev AS rev FROM lines)
SELECT w.code, w.rev, CASE WHEN w.rev <> '' AND s.bid IS NOT NULL THEN s.bid ELSE t.tid END AS bom_id, COALESCE(t.n, 0) AS n_candidates,
CASE WHEN w.rev <> '' AND s.bid IS NOT NULL THEN 'OK' WHEN t.n IS NULL THEN 'MISSING_FILE' WHEN w.rev = '' AND t.n = 1 THEN 'OK' ELSE 'FALLBACK' END AS outcome
FROM wanted w LEFT JOIN strict s ON s.code = w.code AND s.revision = w.rev LEFT JOIN best t ON t.code = w.code""")
def resolve_child_bom(spark, d):
    wanted = X.eligible_lines(view(spark, d, "bom_lines"), POLICY).select(F.col("internal_code").alias("code")).join(view(spark, d, "structure_revs"), "code", "left")
    return R.resolve(wanted, view(spark, d, "bom_headers")).select("code", "rev", "bom_id", "n_candidates", "outcome")


@_query(with_views("bom_headers") + "SELECT code, count(*) AS n, max(revision) AS revision FROM bom_headers GROUP BY code")
def max_rev_pick(spark, d):
    return R.max_revision(view(spark, d, "bom_headers")).select("code", "n", "revision")


@_query(with_views("bom_headers", "pbs_rows") + ", i AS (SELECT code, revision, count(*) AS n FROM bom_headers GROUP BY ALL) SELECT p.seq, p.code, p.rev, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status FROM pbs_rows p LEFT JOIN i ON i.code = p.code AND i.revision = p.rev WHERE p.code <> ''")
def link_pbs_bom(spark, d):
    return R.link_rows(view(spark, d, "pbs_rows"), view(spark, d, "bom_headers")).select("seq", "code", "rev", "status")


# Every fifth list is there twice, and some codes end in X.
_TWICE = "SELECT bom_id, bom_seq, code || CASE WHEN CAST(substr(code, 2) AS BIGINT) % 4 = 0 THEN 'X' ELSE '' END AS code, revision FROM bom_headers UNION ALL SELECT bom_id || '+', bom_seq + 5, code, revision FROM bom_headers WHERE CAST(substr(code, 2) AS BIGINT) % 5 = 0 AND CAST(substr(code, 2) AS BIGINT) % 4 <> 0"


@_query(with_views("bom_headers", "pbs_rows") + f""", h AS ({_TWICE}), p AS (SELECT DISTINCT code, rev FROM pbs_rows WHERE code <> ''), i AS (SELECT code, revision, count(*) AS n FROM h GROUP BY ALL)
SELECT p.code, p.rev, 'AMBIGUOUS' AS status, h.code AS candidate, h.revision, h.bom_id FROM p JOIN i ON i.code = p.code AND i.revision = p.rev AND i.n > 1 JOIN h ON h.code = p.code AND h.revision = p.rev
UNION ALL SELECT p.code, p.rev, 'MISSING', h.code, h.revision, h.bom_id FROM p JOIN h ON regexp_extract(h.code, '[0-9]+') = regexp_extract(p.code, '[0-9]+') AND h.code <> p.code WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.code = p.code AND i.revision = p.rev)""")
def link_candidates(spark, d):
    h = spark.sql(_TWICE.replace("FROM bom_headers", "FROM {h}"), h=view(spark, d, "bom_headers"))
    return R.link_candidates(view(spark, d, "pbs_rows"), h)


@_query(_WALK + "SELECT DISTINCT parent_code, parent_rev, child_code, l.line_no AS pos, w.unit, l.kind, w.bom_id FROM walk w JOIN bom_lines l ON l.bom_id = w.bom_id AND l.line_no = CAST(right(w.k, 2) AS INTEGER) WHERE state = 'MISSING_QTY'")
def missing_edge_rows(spark, d):
    from .operators.reports import missing_edge_rows as rows

    return rows(_exploded(spark, d).missing(), view(spark, d, "bom_lines"))


_VARIANT = "(SELECT code || CASE WHEN CAST(substr(code, 2) AS BIGINT) % 4 = 0 THEN 'X' ELSE '' END AS code, revision, bom_id, bom_seq FROM bom_headers)"


@_query(with_views("bom_headers", "pbs_rows") + f", h AS {_VARIANT}, w AS (SELECT DISTINCT code, regexp_extract(code, '[0-9]{{6,}}') AS r FROM pbs_rows WHERE code <> '') SELECT w.code, string_agg(DISTINCT h.code, ';' ORDER BY h.code) AS candidates FROM w JOIN h ON regexp_extract(h.code, '[0-9]{{6,}}') = w.r AND h.code <> w.code GROUP BY w.code")
def suspicious_same_root(spark, d):
    h = view(spark, d, "bom_headers").withColumn("code", F.concat("code", F.when(F.substring("code", 2, 7).cast("int") % 4 == 0, "X").otherwise("")))
    return R.same_root(view(spark, d, "pbs_rows").where("code <> ''"), h).select("code", F.array_join("candidates", ";").alias("candidates"))


@_query(with_views("pbs_rows") + "SELECT * FROM (SELECT seq, code, lag(rev) OVER (PARTITION BY code ORDER BY seq) AS previous, rev FROM pbs_rows WHERE code <> '' AND rev <> '') WHERE previous <> rev")
def rev_conflicts(spark, d):
    return R.rev_conflicts(view(spark, d, "pbs_rows")).select("seq", "code", "previous", "rev")


@_query(with_views("pbs_rows") + "SELECT code, arg_max(rev, seq) AS rev FROM pbs_rows WHERE code <> '' AND rev <> '' GROUP BY code")
def structure_last_rev(spark, d):
    return R.structure_revs(view(spark, d, "pbs_rows"))


# --- structure trees -------------------------------------------------------------------------

def _parents(rows: str) -> str:
    return f"SELECT a.seq, a.level, a.code, (SELECT max(b.seq) FROM {rows} b WHERE b.seq < a.seq AND b.level < a.level) AS parent_seq FROM {rows} a"


@_query(with_views("pbs_rows") + _parents("pbs_rows"))
def pbs_parent(spark, d):
    return T.level_parents(view(spark, d, "pbs_rows")).select("seq", "level", "code", "parent_seq")


@_query(with_views("pbs_rows") + ", s AS (SELECT * FROM pbs_rows WHERE code <> '') " + _parents("s"))
def pbs_parent_skip_blank(spark, d):
    return T.level_parents(view(spark, d, "pbs_rows"), "skip").select("seq", "level", "code", "parent_seq")


@_query(with_views("pbs_rows") + ", s AS (SELECT seq, CASE WHEN code = '' THEN 0 ELSE level END AS level, code FROM pbs_rows) " + _parents("s"))
def pbs_parent_reset_blank(spark, d):
    return T.level_parents(view(spark, d, "pbs_rows"), "reset").select("seq", "level", "code", "parent_seq")


@_query(with_views("pbs_rows") + """, p AS (SELECT a.seq, a.level, a.code, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level = a.level - 1) AS up, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level < a.level - 1) AS higher FROM pbs_rows a)
SELECT 'PBS__line__' || lpad(CAST(row_number() OVER (ORDER BY seq) AS STRING), 6, '0') AS external_id, seq, code, CASE WHEN higher IS NULL OR up > higher THEN up END AS parent_seq FROM p""")
def pbs_export_lines(spark, d):
    from .operators.sinks import export_lines

    return export_lines(view(spark, d, "pbs_rows"), "PBS").select("external_id", "seq", "code", "parent_seq")


@_query(with_views("pbs_rows") + "SELECT doc_id, seq, code, rev FROM pbs_rows WHERE code <> '' ORDER BY level, seq LIMIT 1")
def pbs_root(spark, d):
    return T.root_row(view(spark, d, "pbs_rows"))


_UP = """, s AS (SELECT * FROM pbs_rows WHERE code <> ''), par AS (SELECT a.seq, a.code, CASE WHEN a.qty > 0 THEN a.qty ELSE 1 END AS f, (SELECT max(b.seq) FROM s b WHERE b.seq < a.seq AND b.level < a.level) AS parent_seq FROM s a)"""


@_query(with_views("pbs_rows", recursive=True) + _UP + ", w AS (SELECT seq, code, f AS n FROM par WHERE parent_seq IS NULL UNION ALL SELECT p.seq, p.code, w.n * p.f FROM w JOIN par p ON p.parent_seq = w.seq) SELECT code, CAST(SUM(n) AS BIGINT) AS occurrences FROM w GROUP BY code")
def pbs_occurrences(spark, d):
    return T.occurrences(view(spark, d, "pbs_rows")).withColumn("occurrences", _whole("occurrences"))


@_query(with_views("pbs_rows") + ", p AS (" + _parents("pbs_rows") + "), q AS (SELECT p.*, r.qty FROM p JOIN pbs_rows r ON r.seq = p.seq), c AS (SELECT parent_seq, count(*) AS n FROM q WHERE qty > 0 AND parent_seq IS NOT NULL GROUP BY parent_seq) SELECT q.code, max(COALESCE(n, 0)) AS most, CAST(sum(COALESCE(n, 0)) AS BIGINT) AS total FROM q LEFT JOIN c ON c.parent_seq = q.seq WHERE q.code <> '' GROUP BY q.code")
def effective_children(spark, d):
    return T.effective_children(view(spark, d, "pbs_rows"))


# --- graph -----------------------------------------------------------------------------------

_GRAPH = with_views("bom_headers", "bom_lines", recursive=True) + ", g AS (SELECT DISTINCT h.code AS parent, l.internal_code AS child FROM bom_lines l JOIN bom_headers h ON h.bom_id = l.bom_id)"


def _graph(spark, d):
    return G.list_graph(view(spark, d, "bom_lines"), view(spark, d, "bom_headers"))


@_query(_GRAPH + ", i AS (SELECT child AS pn, count(*) AS n FROM g GROUP BY child), o AS (SELECT parent AS pn, count(*) AS n FROM g GROUP BY parent), k AS (SELECT pn FROM i UNION SELECT pn FROM o UNION SELECT code FROM bom_headers) SELECT k.pn, k.pn IN (SELECT code FROM bom_headers) AS is_header, COALESCE(i.n, 0) AS indegree, COALESCE(o.n, 0) AS outdegree FROM k LEFT JOIN i ON i.pn = k.pn LEFT JOIN o ON o.pn = k.pn ORDER BY indegree DESC, outdegree DESC, k.pn LIMIT 5000")
def graph_degrees(spark, d):
    return G.degrees(_graph(spark, d), view(spark, d, "bom_headers"))


_FOREST = with_views("bom_headers", "forest_lines", recursive=True) + ", g AS (SELECT DISTINCT h.code AS parent, l.internal_code AS child FROM forest_lines l JOIN bom_headers h ON h.bom_id = l.bom_id)"


def _forest(spark, d):
    return G.list_graph(view(spark, d, "forest_lines"), view(spark, d, "bom_headers"))


@_query(_FOREST + " SELECT DISTINCT code FROM bom_headers WHERE code NOT IN (SELECT child FROM g)")
def root_inference(spark, d):
    return G.roots(_forest(spark, d), view(spark, d, "bom_headers"))


@_query(_GRAPH + ", r AS (SELECT 'E0000002' AS code UNION SELECT g.child FROM r JOIN g ON g.parent = r.code) SELECT count(*) AS reachable FROM r WHERE code IN (SELECT code FROM bom_headers)")
def reachable_count(spark, d):
    got = G.reach(_graph(spark, d), spark.createDataFrame([("E0000002",)], "code string"))
    # joined by shuffles, as the codes would go through the driver to be broadcast
    return got.join(R.header_index(view(spark, d, "bom_headers")).select("code").distinct().hint("merge"), "code", "left_semi").agg(F.count("*").alias("reachable"))


@_query(_FOREST + """, rt AS (SELECT DISTINCT code FROM bom_headers WHERE code NOT IN (SELECT child FROM g)),
r AS (SELECT code AS start, code FROM rt UNION SELECT r.start, g.child FROM r JOIN g ON g.parent = r.code), n AS (SELECT start, count(*) AS reachable FROM r WHERE code IN (SELECT code FROM bom_headers) GROUP BY start), o AS (SELECT parent, count(*) AS outdegree FROM g GROUP BY parent), k AS (SELECT rt.code, CAST(rt.code = 'E0000011' AS INTEGER) AS folder_match, reachable, COALESCE(outdegree, 0) AS outdegree FROM rt JOIN n ON n.start = rt.code LEFT JOIN o ON o.parent = rt.code)
SELECT *, folder_match * 1000000 + reachable * 1000 + outdegree AS score, row_number() OVER (ORDER BY folder_match DESC, reachable DESC, outdegree DESC, code) AS rank FROM k""")
def root_ranking(spark, d):
    return G.rank_roots(_forest(spark, d), view(spark, d, "bom_headers"), "E0000011")


@_query(with_views("bom_headers") + ", h AS (SELECT DISTINCT code || CASE WHEN CAST(substr(code, 2) AS BIGINT) % 3 = 0 THEN '-01' ELSE '' END AS code FROM bom_headers UNION SELECT code || '-02' FROM bom_headers WHERE CAST(substr(code, 2) AS BIGINT) % 6 = 0), b AS (SELECT code, regexp_extract(code, '^(.+)-[0-9][0-9]$', 1) AS base FROM h) SELECT base, min(code) AS \"full\" FROM b WHERE base <> '' GROUP BY base HAVING count(*) = 1")
def base_full_alias(spark, d):
    h = view(spark, d, "bom_headers")
    n = F.substring("code", 2, 7).cast("int")
    more = h.where(n % 6 == 0).withColumn("code", F.concat("code", F.lit("-02")))
    return G.base_aliases(h.withColumn("code", F.concat("code", F.when(n % 3 == 0, "-01").otherwise(""))).unionByName(more))


# Each thirteenth list also names itself.
@_query(_GRAPH + ", x AS (SELECT * FROM g UNION SELECT DISTINCT code, code FROM bom_headers WHERE CAST(substr(code, 2) AS BIGINT) % 13 = 0) SELECT parent FROM x WHERE parent = child")
def self_child_edges(spark, d):
    h, lines = view(spark, d, "bom_headers"), view(spark, d, "bom_lines")
    own = h.where(F.substring("code", 2, 7).cast("int") % 13 == 0).select("bom_id", F.col("code").alias("internal_code"))
    return G.list_graph(lines.select("bom_id", "internal_code").unionByName(own), h).where("parent = child").select("parent")


@_query(with_views("bom_headers", "bom_lines") + """, l AS (SELECT internal_code AS code, trim(description) AS description, trim(manufacturer) AS manufacturer, seq FROM bom_lines),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY length(description) DESC, seq) AS a, row_number() OVER (PARTITION BY code ORDER BY length(manufacturer) DESC, seq) AS b FROM l) SELECT code, max(CASE WHEN a = 1 THEN description END) AS description, max(CASE WHEN b = 1 THEN manufacturer END) AS manufacturer FROM r GROUP BY code""")
def part_master_best_of(spark, d):
    return G.part_master(view(spark, d, "bom_lines"), K.norm(F.col("internal_code"))).select("code", "description", "manufacturer")


@_query(with_views("bom_headers", "bom_lines") + "SELECT l.bom_id, h.code AS header, h.revision, l.line_no, l.description FROM bom_lines l JOIN bom_headers h ON h.bom_id = l.bom_id WHERE l.internal_code = 'E0000012'")
def find_code(spark, d):
    return V.find_code(view(spark, d, "bom_lines"), view(spark, d, "bom_headers"), "e0000012 ")


# --- codes and scalars -----------------------------------------------------------------------

@_query(with_views("raw_codes") + """, c AS (SELECT id, upper(trim(code)) AS c, suffix AS s FROM raw_codes)
SELECT id, CASE WHEN regexp_matches(c, '^[A-Z]{1,3}[0-9]{4,}[ _/.-]+[0-9]{2}$') THEN regexp_extract(c, '^([A-Z]{1,3}[0-9]{4,})', 1) || '-' || CASE WHEN s <> '' THEN s ELSE right(c, 2) END
WHEN regexp_matches(c, '^[A-Z]{1,3}[0-9]{7,}[0-9]{2}$') THEN left(c, length(c) - 2) || '-' || CASE WHEN s <> '' THEN s ELSE right(c, 2) END
ELSE regexp_replace(c, '[ _/.-]+', '-', 'g') || CASE WHEN s <> '' THEN '-' || s ELSE '' END END AS pn FROM c""")
def canonical_pn(spark, d):
    return view(spark, d, "raw_codes").select("id", K.canonical_pn(F.col("code"), F.col("suffix")).alias("pn"))


@_query(with_views("raw_codes") + "SELECT id, regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') AS plain, regexp_extract(code, '[0-9]{6,}') AS root, regexp_extract(upper(trim(code)), '^[0-9]{6,}') AS leading, regexp_replace(code, '(.)PRTL$', '\\1') AS short FROM raw_codes")
def numeric_roots(spark, d):
    c = F.col("code")
    return view(spark, d, "raw_codes").select("id", K.alnum(c).alias("plain"), K.digit_root(c).alias("root"), F.coalesce(K.leading_root(c), F.lit("")).alias("leading"), K.strip_lookup_suffix(c).alias("short"))


@_query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'NR' WHEN 1 THEN 'M' WHEN 2 THEN 'GR' WHEN 3 THEN 'L' WHEN 4 THEN 'ROLL' ELSE '' END AS uom FROM part")
def uom_normalize(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" pcs", "mt", "g ", "LT", "roll", "")]), F.col("p_size") % 6 + 1)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), K.unit(raw).alias("uom"))


@_query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'DOCUMENT_REF' WHEN p_size % 3 = 0 THEN 'UNKNOWN' ELSE 'MATERIAL' END AS kind FROM part")
def line_classification(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    qty = K.quantity(F.when(F.col("p_size") % 3 == 0, F.lit("-")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5"))))
    return p.select(F.col("p_partkey").alias("id"), K.line_kind(F.lit(""), F.when(F.col("p_size") % 5 == 0, "assembly drawing").otherwise("part"), F.lit("NR"), qty).alias("kind"))


@_query("SELECT p_partkey AS id, CASE WHEN abs(floor(v + 0.5) - v) <= 0.02 THEN floor(v + 0.5) WHEN abs(floor(v / 0.5 + 0.5) * 0.5 - v) <= 0.02 THEN floor(v / 0.5 + 0.5) * 0.5 ELSE round_even(v, 3) END AS value FROM (SELECT p_partkey, p_size / 8.0 AS v FROM part)")
def quantize_steps(spark, d):
    v = F.col("p_size") / F.lit(8.0)
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), K.quantized(v, [1.0, 0.5])["value"].alias("value"))


# --- totals and findings ---------------------------------------------------------------------

_STATUS = with_views("totals", "bom_totals", "units") + """, v AS (SELECT COALESCE(b.pn, t.pn) AS pn, b.qty AS qb, t.qty AS qt FROM bom_totals b FULL JOIN totals t ON t.pn = b.pn),
s AS (SELECT v.pn, u.uom, qb AS qty_bom, qt AS qty_total, CASE WHEN u.other THEN 'SKIPPED_NON_NR' WHEN qb IS NULL THEN 'ERROR_EXTRA_IN_TOTAL' WHEN qt IS NULL THEN CASE WHEN qb > 0 THEN 'ERROR_MISSING_IN_TOTAL' ELSE 'OK' END WHEN qb <> qt THEN 'WARN_QTY_MISMATCH' ELSE 'OK' END AS status FROM v LEFT JOIN units u ON u.pn = v.pn) """


def _statuses(spark, d):
    return C.validate_totals(view(spark, d, "bom_totals"), view(spark, d, "totals"), view(spark, d, "units"))


@_query(_STATUS + """SELECT *, CASE status WHEN 'SKIPPED_NON_NR' THEN 'unit is not a piece' WHEN 'ERROR_EXTRA_IN_TOTAL' THEN 'not in the explosion' WHEN 'ERROR_MISSING_IN_TOTAL' THEN 'not in the totals' WHEN 'WARN_QTY_MISMATCH' THEN 'quantities differ' ELSE '' END AS note FROM s""")
def totalization_validation(spark, d):
    return _statuses(spark, d)


@_query(_STATUS + "SELECT status, count(*) AS n FROM s GROUP BY status")
def totalization_status_counts(spark, d):
    return _statuses(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@_query(_STATUS + "SELECT pn, qty_total FROM s WHERE status = 'ERROR_EXTRA_IN_TOTAL'")
def totalization_extra(spark, d):
    return _statuses(spark, d).where("status = 'ERROR_EXTRA_IN_TOTAL'").select("pn", "qty_total")


@_query(_STATUS + "SELECT pn, qty_bom FROM s WHERE status = 'ERROR_MISSING_IN_TOTAL'")
def totalization_missing_nr(spark, d):
    return _statuses(spark, d).where("status = 'ERROR_MISSING_IN_TOTAL'").select("pn", "qty_bom")


@_query(_STATUS + "SELECT pn, qty_bom - qty_total AS delta FROM s WHERE status = 'WARN_QTY_MISMATCH'")
def totalization_qty_delta(spark, d):
    return _statuses(spark, d).where("status = 'WARN_QTY_MISMATCH'").select("pn", (F.col("qty_bom") - F.col("qty_total")).alias("delta"))


@_query(_STATUS + "SELECT pn, uom, qty_bom FROM s WHERE status = 'SKIPPED_NON_NR' AND qty_bom IS NOT NULL")
def non_nr_estimates(spark, d):
    return _statuses(spark, d).where("status = 'SKIPPED_NON_NR' and qty_bom is not null").select("pn", "uom", "qty_bom")


_CELLS = "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS sheet_row, 'E' || CAST(l_partkey AS STRING) AS pn, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linenumber <> 3"


@_query(f"WITH c AS ({_CELLS}) SELECT pn, CAST(SUM(q) AS BIGINT) AS qty, count(*) AS n_rows, array_to_string(list_slice(list(sheet_row ORDER BY sheet_row), 1, 5), ',') AS samples FROM c GROUP BY pn")
def totalization_load(spark, d):
    return C.load_totalization(_cells(spark, d)).select("pn", _whole("qty").alias("qty"), "n_rows", F.array_join("samples", ",").alias("samples"))


def _cells(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.when(F.col("l_linenumber") == 3, "=A1").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",0")))
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("sheet_row"), F.concat(F.lit(" e"), F.col("l_partkey").cast("string")).alias("code"), q.alias("qty"))


@_query(f"WITH c AS ({_CELLS}) SELECT pn, count(*) AS n_rows, CAST(SUM(q) AS BIGINT) AS qty_sum FROM c GROUP BY pn HAVING count(*) > 1")
def totalization_duplicates(spark, d):
    return C.load_totalization(_cells(spark, d)).where("n_rows > 1").select("pn", "n_rows", _whole("qty").alias("qty_sum"))


def _walk_with_structure() -> str:
    return _WALK.replace("WITH RECURSIVE ", "WITH RECURSIVE " + with_views("pbs_rows").removeprefix("WITH ") + ",\n", 1) + """, done AS (SELECT DISTINCT h.code, h.revision AS rev FROM (SELECT bom_id FROM walk UNION SELECT next_bom_id FROM walk WHERE state = 'EDGE') e JOIN hdr h ON h.bom_id = e.bom_id),
met AS (SELECT DISTINCT child_code AS code FROM walk WHERE state IN ('EDGE', 'CYCLE')) """


@_query(_walk_with_structure() + "SELECT code FROM met WHERE code NOT IN (SELECT code FROM pbs_rows)")
def introduced_not_in_pbs(spark, d):
    return C.introduced(_summed(spark, d).totals(), view(spark, d, "pbs_rows"))


@_query(_walk_with_structure() + "SELECT DISTINCT code FROM pbs_rows WHERE code <> '' AND code IN (SELECT code FROM bom_headers) AND code NOT IN (SELECT code FROM done)")
def unexploded_assemblies(spark, d):
    return C.unexploded(view(spark, d, "pbs_rows"), view(spark, d, "bom_headers"), _summed(spark, d).exploded())


@_query(_walk_with_structure() + """SELECT 'INTRODUCED' AS kind, code FROM met WHERE code NOT IN (SELECT code FROM pbs_rows)
UNION SELECT 'UNEXPLODED', code FROM pbs_rows WHERE code <> '' AND code IN (SELECT code FROM bom_headers) AND code NOT IN (SELECT code FROM done)
UNION SELECT 'REV_CONFLICT', code FROM (SELECT code, rev, lag(rev) OVER (PARTITION BY code ORDER BY seq) AS p FROM pbs_rows WHERE code <> '' AND rev <> '') WHERE p <> rev
UNION SELECT 'REV_MISMATCH', p.code FROM pbs_rows p JOIN done ON done.code = p.code WHERE p.rev <> '' AND done.rev <> '' AND p.rev <> done.rev""")
def config_completeness(spark, d):
    e = _summed(spark, d)
    return C.completeness(view(spark, d, "pbs_rows"), view(spark, d, "bom_headers"), e.totals(), e.exploded())


@_query(_WALK + ", u AS (SELECT child_code AS code, arg_min(unit, k) AS uom FROM walk WHERE unit <> '' GROUP BY child_code) SELECT t.code AS pn, t.qty, COALESCE(u.uom, '') AS uom FROM (SELECT child_code AS code, CAST(SUM(qty) AS BIGINT) AS qty FROM walk WHERE state IN ('EDGE', 'CYCLE') GROUP BY child_code) t LEFT JOIN u ON u.code = t.code")
def totals_view(spark, d):
    e = _summed(spark, d)
    master = G.part_master(view(spark, d, "bom_lines"), K.norm(F.col("internal_code")))
    return V.totals_view(e.totals(), e.units(), master).select("pn", _whole("qty").alias("qty"), "uom")


# --- findings --------------------------------------------------------------------------------

_STRICT_WALK = (
    _walk_with_structure()
    .replace("COALESCE(s.bid, t.tid) AS next_bom_id", "CASE WHEN s.bid IS NOT NULL THEN s.bid WHEN l.child_rev = '' AND t.n = 1 THEN t.tid END AS next_bom_id")
    .replace("FROM adj a JOIN best b ON b.tid = a.bom_id WHERE b.code = 'E0000001'", "FROM adj a JOIN strict b ON b.bid = a.bom_id WHERE b.code = 'E0000001' AND b.revision = 'A'")
    .replace("WHERE state = 'EDGE') e", "WHERE state = 'EDGE' AND next_bom_id IS NOT NULL) e")
)
_BREAKS = _STRICT_WALK + ", pr AS (" + _parents("pbs_rows") + """), pq AS (SELECT pr.*, r.qty FROM pr JOIN pbs_rows r ON r.seq = pr.seq), ch AS (SELECT parent_seq, count(*) AS n FROM pq WHERE qty > 0 AND parent_seq IS NOT NULL GROUP BY parent_seq),
rt AS (SELECT DISTINCT pq.code FROM pq JOIN ch ON ch.parent_seq = pq.seq WHERE pq.code <> '' AND pq.code IN (SELECT child_code FROM walk WHERE state = 'EDGE') AND pq.code NOT IN (SELECT code FROM done)),
anc AS (SELECT seq, seq AS a, 0 AS dist FROM pr UNION ALL SELECT anc.seq, pr.parent_seq, dist + 1 FROM anc JOIN pr ON pr.seq = anc.a WHERE pr.parent_seq IS NOT NULL),
hit AS (SELECT anc.seq, min(dist) AS dist, arg_min(pr.code, dist) AS root FROM anc JOIN pr ON pr.seq = anc.a WHERE pr.code IN (SELECT code FROM rt) GROUP BY anc.seq),
cl AS (SELECT code, dist, root FROM (SELECT pr.code, dist, root, row_number() OVER (PARTITION BY pr.code ORDER BY dist, hit.seq) AS k FROM hit JOIN pr ON pr.seq = hit.seq WHERE pr.code <> '') WHERE k = 1) """
_DIFFERENCES = with_views("pbs_rows", "bom_headers", "bom_lines") + """, s AS (SELECT * FROM pbs_rows WHERE code <> ''), par AS (SELECT a.seq, a.code, (SELECT max(b.seq) FROM s b WHERE b.seq < a.seq AND b.level < a.level) AS parent_seq FROM s a),
ix AS (SELECT code, revision, count(*) AS n, min(bom_id) AS bid FROM bom_headers GROUP BY code, revision), ln AS (SELECT s.seq, s.code AS parent, ix.bid FROM s JOIN ix ON ix.code = s.code AND ix.revision = s.rev WHERE ix.n = 1),
own AS (SELECT DISTINCT ln.parent, par.code AS child FROM par JOIN ln ON ln.seq = par.parent_seq), listed AS (SELECT DISTINCT ln.parent, b.internal_code AS child FROM bom_lines b JOIN ln ON ln.bid = b.bom_id WHERE b.kind <> 'DOCUMENT_REF'),
ms AS (SELECT * FROM own EXCEPT SELECT * FROM listed), ex AS (SELECT * FROM listed EXCEPT SELECT * FROM own) """


def _put(v: str) -> str:
    tries = " ".join(f"WHEN abs(floor({v} / {x} + 0.5) * {x} - {v}) <= 0.02 THEN floor({v} / {x} + 0.5) * {x}" for x in ("1.0::DOUBLE", "0.5::DOUBLE", "0.25::DOUBLE", "0.1::DOUBLE", "0.01::DOUBLE"))
    return f"CASE WHEN unit = 'NR' THEN CASE WHEN abs(floor({v} + 0.5) - {v}) <= 0.02 THEN floor({v} + 0.5) ELSE round_even({v}, 3) END {tries} END"


_INFERENCE = _walk_with_structure() + _UP + f""", oc AS (SELECT seq, code, f AS n FROM par WHERE parent_seq IS NULL UNION ALL SELECT p.seq, p.code, oc.n * p.f FROM oc JOIN par p ON p.parent_seq = oc.seq), occ AS (SELECT code, sum(n) AS n FROM oc GROUP BY code),
pe AS (SELECT parent_code AS parent, child_code AS child, unit, state FROM walk WHERE state IN ('EDGE', 'MISSING_QTY')), np AS (SELECT child, count(DISTINCT parent) AS np FROM pe GROUP BY child), mi AS (SELECT parent, child, count(*) AS nl, max(unit) AS unit FROM pe WHERE state = 'MISSING_QTY' GROUP BY parent, child),
tot AS (SELECT {"'E' || lpad(CAST(l_partkey AS STRING), 7, '0')"} AS code, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey),
sfe AS (SELECT child_code AS code, CAST(SUM(qty) AS DOUBLE) AS n FROM walk WHERE state = 'EDGE' GROUP BY child_code), qbc AS (SELECT child_code AS code, CAST(SUM(qty) AS DOUBLE) AS n FROM walk WHERE state IN ('EDGE', 'CYCLE') GROUP BY child_code),
v0 AS (SELECT mi.*, np.np, CAST(tot.q AS DOUBLE) AS total, COALESCE(occ.n, CASE WHEN mi.parent = 'E0000001' THEN COALESCE(sfe.n, 0) + 1 ELSE sfe.n END, qbc.n, CASE WHEN mi.parent = 'E0000001' THEN 1 END) AS times FROM mi JOIN np ON np.child = mi.child LEFT JOIN tot ON tot.code = mi.child AND tot.q > 0 LEFT JOIN occ ON occ.code = mi.parent AND occ.n > 0 LEFT JOIN sfe ON sfe.code = mi.parent AND sfe.n > 0 LEFT JOIN qbc ON qbc.code = mi.parent AND qbc.n > 0), v AS (SELECT *, total / times AS raw FROM v0),
w2 AS (SELECT *, CASE WHEN np >= 2 OR nl >= 2 THEN 'AMBIGUOUS' WHEN raw IS NULL THEN 'NOT_CALCULABLE' WHEN unit = 'NR' AND abs(floor(raw + 0.5) - raw) > 0.02 THEN 'CHECK' ELSE 'INFERRED' END AS status, {_put("raw")} AS put FROM v)
SELECT parent, child, unit, nl AS n_lines, np AS n_parents, total, CAST(times AS DOUBLE) AS occurrences, CASE WHEN status IN ('INFERRED', 'CHECK') THEN put END AS value, status, CAST(CASE WHEN status = 'CHECK' THEN 0.4 WHEN status <> 'INFERRED' THEN 0.0 WHEN unit = 'NR' THEN 0.9 WHEN unit <> '' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM w2"""

def _findings(spark, d):
    rows, h, lines = view(spark, d, "pbs_rows"), view(spark, d, "bom_headers"), view(spark, d, "bom_lines")
    return rows, h, lines, _exploded(spark, d)


_SIGHT = """, occ0 AS (SELECT l.internal_code AS code, h.code AS parent, h.revision AS parent_rev, l.line_no AS pos, l.seq FROM bom_lines l JOIN bom_headers h ON h.bom_id = l.bom_id),
dn AS (SELECT DISTINCT code FROM done), fst AS (SELECT code, arg_min(parent, (seq, parent, parent_rev, pos)) AS parent, arg_min(parent_rev, (seq, parent, parent_rev, pos)) AS parent_rev, arg_min(pos, (seq, parent, parent_rev, pos)) AS pos FROM occ0 GROUP BY code),
opn AS (SELECT code, arg_min(parent, (seq, parent, parent_rev, pos)) AS parent, arg_min(parent_rev, (seq, parent, parent_rev, pos)) AS parent_rev, arg_min(pos, (seq, parent, parent_rev, pos)) AS pos FROM occ0 WHERE parent NOT IN (SELECT code FROM dn) GROUP BY code),
rw AS (SELECT seq, CASE WHEN code = '' THEN 0 ELSE level END AS level, code, qty FROM pbs_rows), rp AS (SELECT a.code, a.qty, (SELECT max(b.seq) FROM rw b WHERE b.seq < a.seq AND b.level < a.level) AS up FROM rw a),
eff AS (SELECT q.code, count(*) AS n FROM rp JOIN rw q ON q.seq = rp.up WHERE rp.qty > 0 AND q.code <> '' GROUP BY q.code),
un AS (SELECT DISTINCT code FROM pbs_rows WHERE code <> '' AND code IN (SELECT code FROM bom_headers) AND code NOT IN (SELECT code FROM dn)), hitc AS (SELECT DISTINCT child_code AS code, child_rev FROM walk WHERE state = 'EDGE') """


@_query(_walk_with_structure() + _SIGHT + """, bits AS (SELECT w.code, bool_or(o.fell) AS fell, min(CASE WHEN o.fell AND w.child_rev <> '' THEN w.child_rev || ' asked, ' || o.top || ' taken' END) AS m FROM hitc w JOIN (SELECT DISTINCT x.code, x.child_rev, (SELECT max(revision) FROM bom_headers b WHERE b.code = x.code) AS top,
 (x.child_rev, x.code) NOT IN (SELECT (revision, code) FROM bom_headers) AND NOT (x.child_rev = '' AND (SELECT count(*) FROM bom_headers b WHERE b.code = x.code) = 1) AND x.code IN (SELECT code FROM bom_headers) AS fell FROM hitc x) o ON o.code = w.code AND o.child_rev = w.child_rev GROUP BY w.code),
dg AS (SELECT un.code, COALESCE(sr.rev, '') AS rev, CASE WHEN COALESCE(eff.n, 0) = 0 THEN 'INFO_PBS_ONLY_ZERO_QTY_CHILDREN' WHEN un.code IN (SELECT code FROM hitc) THEN 'REACHED_SELECTION_FAIL' WHEN fst.code IS NOT NULL THEN 'NOT_REACHED_CHAIN_BREAK' ELSE 'MISSING_LINK' END AS reason
 FROM un LEFT JOIN eff ON eff.code = un.code LEFT JOIN fst ON fst.code = un.code LEFT JOIN (SELECT code, arg_max(rev, seq) AS rev FROM pbs_rows WHERE code <> '' AND rev <> '' GROUP BY code) sr ON sr.code = un.code)
SELECT dg.code, dg.rev, reason, CASE WHEN reason = 'MISSING_LINK' THEN '' ELSE dg.code END AS candidate,
 CASE reason WHEN 'NOT_REACHED_CHAIN_BREAK' THEN COALESCE(opn.parent, fst.parent) WHEN 'REACHED_SELECTION_FAIL' THEN fst.parent ELSE '' END AS parent, CASE reason WHEN 'NOT_REACHED_CHAIN_BREAK' THEN COALESCE(opn.parent_rev, fst.parent_rev) WHEN 'REACHED_SELECTION_FAIL' THEN fst.parent_rev ELSE '' END AS parent_rev,
 CASE reason WHEN 'NOT_REACHED_CHAIN_BREAK' THEN CAST(COALESCE(opn.pos, fst.pos) AS VARCHAR) WHEN 'REACHED_SELECTION_FAIL' THEN CAST(fst.pos AS VARCHAR) ELSE '' END AS pos,
 CASE reason WHEN 'INFO_PBS_ONLY_ZERO_QTY_CHILDREN' THEN 'no direct child of positive quantity' WHEN 'NOT_REACHED_CHAIN_BREAK' THEN 'under ' || COALESCE(opn.parent, fst.parent) || CASE WHEN opn.code IS NOT NULL THEN ', which is not exploded' ELSE ', which is exploded' END
 WHEN 'REACHED_SELECTION_FAIL' THEN CASE WHEN bits.m IS NULL AND NOT COALESCE(bits.fell, FALSE) THEN 'met as a child, never entered' ELSE concat_ws('; ', 'revision ' || bits.m, CASE WHEN bits.fell THEN 'fallback' END) END ELSE 'no list has it' END AS note
FROM dg LEFT JOIN fst ON fst.code = dg.code LEFT JOIN opn ON opn.code = dg.code LEFT JOIN bits ON bits.code = dg.code""")
def unexploded_diagnosis(spark, d):
    return _diagnosed(spark, d, _exploded(spark, d))


def _diagnosed(spark, d, e: X.Explosion):
    from .operators import reports as P
    from .plans.pipelines import occurrences_in_lists

    rows, h, lines = view(spark, d, "pbs_rows"), view(spark, d, "bom_headers"), view(spark, d, "bom_lines")
    traced = P.traces(P.wanted_lists(e.edges(), ROOT), h)
    return C.diagnose_unexploded(C.unexploded(rows, h, e.exploded()), T.effective_children(rows, "reset"), e.edges().select(F.col("child_code").alias("code")), occurrences_in_lists(lines, h), e.exploded(), R.structure_revs(rows), traced, e.missing_lists())


def _strict(spark, d) -> X.Explosion:
    return X.explode(spark, view(spark, d, "bom_lines"), view(spark, d, "bom_headers"), ROOT, "A", view(spark, d, "structure_revs"), X.Policy(explode_unknown=True, fallback=False))


def _breaks(spark, d, e: X.Explosion | None = None):
    rows, e = view(spark, d, "pbs_rows"), e or _strict(spark, d)
    return C.chain_breaks(T.level_parents(rows), T.effective_children(rows), e.edges().select(F.col("child_code").alias("code")), e.exploded())


@_query(_BREAKS + "SELECT rt.code, CAST(COALESCE(i.n, 0) AS BIGINT) AS impacted FROM rt LEFT JOIN (SELECT root, count(DISTINCT code) AS n FROM cl WHERE dist > 0 GROUP BY root) i ON i.root = rt.code")
def chain_break_roots(spark, d):
    return _breaks(spark, d)[0]


@_query(_BREAKS + "SELECT code, CASE WHEN dist = 0 THEN 'ROOT' ELSE 'CASCADE' END AS kind, root, dist AS depth FROM cl")
def chain_break_classification(spark, d):
    return _breaks(spark, d)[1]


_MISMATCH = _walk_with_structure() + _DIFFERENCES[_DIFFERENCES.index(", s AS (") :] + """, qt AS (SELECT code AS child, arg_max(qty, seq) AS q FROM pbs_rows GROUP BY code), un AS (SELECT DISTINCT code FROM pbs_rows WHERE code <> '' AND code IN (SELECT code FROM bom_headers) AND code NOT IN (SELECT code FROM done)),
anc AS (SELECT seq, parent_seq AS a FROM par WHERE parent_seq IS NOT NULL UNION SELECT anc.seq, par.parent_seq FROM anc JOIN par ON par.seq = anc.a WHERE par.parent_seq IS NOT NULL),
udr AS (SELECT DISTINCT x.code AS parent FROM anc JOIN par u ON u.seq = anc.a JOIN par x ON x.seq = anc.seq WHERE u.code IN (SELECT code FROM un)), rch AS (SELECT DISTINCT parent_code AS parent FROM walk WHERE state = 'EDGE'),
lv AS (SELECT ms.parent, ms.child, ex.child AS extra, levenshtein(ms.child, ex.child) AS lev FROM ms JOIN ex ON ex.parent = ms.parent), ty AS (SELECT parent, child, arg_min(extra, (CASE WHEN lev <= 1 THEN lev ELSE 2 END, extra)) AS extra FROM lv WHERE lev <= 1 OR left(substr(child, 2), 6) = left(substr(extra, 2), 6) GROUP BY ALL),
mm AS (SELECT ms.parent, ms.child, COALESCE(qt.q, 0) = 0 AS optional, rch.parent IS NULL OR udr.parent IS NOT NULL AS cascade, ty.extra FROM ms LEFT JOIN qt ON qt.child = ms.child LEFT JOIN rch ON rch.parent = ms.parent LEFT JOIN udr ON udr.parent = ms.parent LEFT JOIN ty ON ty.parent = ms.parent AND ty.child = ms.child),
pcm AS (SELECT parent, child, CASE WHEN optional OR cascade THEN 'WARN' ELSE 'ERROR' END AS severity, CASE WHEN extra IS NOT NULL THEN 'TYPO_SUSPECT_CHILD_MISMATCH' WHEN optional THEN 'CHILD_MISSING_IN_BOM_OPTIONAL' ELSE 'CHILD_MISSING_IN_BOM' END AS category, CASE WHEN cascade THEN 'CASCADE' ELSE 'ROOT' END AS place, COALESCE(extra, '') AS "similar" FROM mm) """


@_query(_MISMATCH + 'SELECT parent, child, severity, category, place, "similar" FROM pcm')
def parent_child_mismatch(spark, d):
    rows, h, lines, e = _findings(spark, d)
    reached = e.edges().select(F.col("parent_code").alias("code"))
    return C.parent_child_mismatches(T.level_parents(rows, "skip"), h, lines, reached, C.unexploded(rows, h, e.exploded()))


@_query(_DIFFERENCES + "SELECT parent, missing, extra, CAST(k / 10000000 AS INTEGER) AS distance FROM (SELECT ms.parent, ms.child AS missing, ex.child AS extra, CASE WHEN levenshtein(ms.child, ex.child) <= 1 THEN levenshtein(ms.child, ex.child) ELSE 2 END * 10000000 AS k, row_number() OVER (PARTITION BY ms.parent, ms.child ORDER BY CASE WHEN levenshtein(ms.child, ex.child) <= 1 THEN levenshtein(ms.child, ex.child) ELSE 2 END, ex.child) AS r FROM ms JOIN ex ON ex.parent = ms.parent WHERE levenshtein(ms.child, ex.child) <= 1 OR left(substr(ms.child, 2), 6) = left(substr(ex.child, 2), 6)) WHERE r = 1")
def typo_suspects(spark, d):
    rows, h, lines, _ = _findings(spark, d)
    return C.typo_suspects(C.child_differences(T.level_parents(rows, "skip"), h, lines))


@_query(_INFERENCE)
def qty_inference(spark, d):
    rows, _, _, e = _findings(spark, d)
    pair = lambda df: df.select(F.col("parent_code").alias("parent"), F.col("child_code").alias("child"), "unit")
    totals = view(spark, d, "totals").withColumnRenamed("pn", "code")
    from .operators import reports as P

    return C.infer_quantities(pair(e.missing()), pair(e.edges()), totals, T.occurrences(rows), P.safe_occurrences(e.edges(), ROOT), e.totals(), ROOT)


@_query(_walk_with_structure() + ", pr AS (" + _parents("pbs_rows") + ") SELECT seq, code FROM pr WHERE parent_seq IS NOT NULL AND code <> '' AND seq NOT IN (SELECT parent_seq FROM pr WHERE parent_seq IS NOT NULL) AND code NOT IN (SELECT child_code FROM walk WHERE state = 'EDGE')")
def pbs_only_nodes(spark, d):
    rows, _, _, e = _findings(spark, d)
    return V.structure_only(T.level_parents(rows), e.edges())


@_query(_WALK + """, u AS (SELECT child_code AS code, arg_min(unit, k) AS uom FROM walk WHERE unit <> '' GROUP BY child_code), r AS (SELECT internal_code AS code, trim(description) AS description, trim(manufacturer) AS manufacturer, row_number() OVER (PARTITION BY internal_code ORDER BY length(trim(description)) DESC, seq) AS a, row_number() OVER (PARTITION BY internal_code ORDER BY length(trim(manufacturer)) DESC, seq) AS b FROM bom_lines),
m AS (SELECT code, max(CASE WHEN a = 1 THEN description END) AS description, max(CASE WHEN b = 1 THEN manufacturer END) AS manufacturer FROM r GROUP BY code)
SELECT w.depth, w.parent_code, w.child_code, w.child_rev, CAST(w.qty AS BIGINT) AS qty, COALESCE(u.uom, '') AS uom, m.description, m.manufacturer FROM walk w LEFT JOIN u ON u.code = w.child_code LEFT JOIN m ON m.code = w.child_code WHERE w.state = 'EDGE'""")
def explosion_view(spark, d):
    _, _, lines, e = _findings(spark, d)
    return V.explosion_view(e.edges(), G.part_master(lines, K.norm(F.col("internal_code"))), e.units()).withColumn("qty", _whole("qty"))


_CHECK_SQL = """SELECT 'ERROR' AS level, 'DUPLICATE_ID' AS "check", (SELECT count(*) FROM (SELECT external_id FROM x GROUP BY external_id HAVING count(*) > 1)) AS n UNION ALL SELECT 'ERROR', 'UNKNOWN_PARENT', (SELECT count(*) FROM x WHERE parent_external_id IS NOT NULL AND parent_external_id NOT IN (SELECT external_id FROM x WHERE external_id IS NOT NULL))
UNION ALL SELECT 'ERROR', 'EMPTY_ID', (SELECT count(*) FROM x WHERE COALESCE(external_id, '') = '') UNION ALL SELECT 'ERROR', 'NO_LINES', (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM x)"""
_IMPORT = "SELECT CASE WHEN s_suppkey % 23 = 0 THEN '' WHEN s_suppkey % 9 = 0 THEN 'L' || CAST(s_suppkey - 1 AS STRING) ELSE 'L' || CAST(s_suppkey AS STRING) END AS external_id, CASE WHEN s_suppkey % 11 = 0 THEN 'X' || CAST(s_suppkey AS STRING) WHEN s_suppkey > 1 THEN 'L' || CAST(s_suppkey - 1 AS STRING) END AS parent_external_id, s_name AS code FROM supplier"


@_query(f"WITH x AS ({_IMPORT}) " + _CHECK_SQL)
def pbs_export_check_failing(spark, d):
    """An import file with doubled, empty and unknown ids."""
    from .operators.sinks import check_export

    return check_export(spark.sql(_IMPORT.replace("FROM supplier", "FROM {supplier}"), supplier=spark.read.parquet(f"{d}/supplier.parquet")))


@_query(with_views("pbs_rows") + """, p AS (SELECT a.seq, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level = a.level - 1) AS up, (SELECT max(b.seq) FROM pbs_rows b WHERE b.seq < a.seq AND b.level < a.level - 1) AS higher, row_number() OVER (ORDER BY a.seq) AS k FROM pbs_rows a),
x AS (SELECT 'PBS__line__' || lpad(CAST(p.k AS STRING), 6, '0') AS external_id, 'PBS__line__' || lpad(CAST(q.k AS STRING), 6, '0') AS parent_external_id FROM p LEFT JOIN p q ON q.seq = CASE WHEN p.higher IS NULL OR p.up > p.higher THEN p.up END) """ + _CHECK_SQL)
def pbs_export_check(spark, d):
    from .operators.sinks import check_export, export_lines

    return check_export(export_lines(view(spark, d, "pbs_rows"), "PBS"))


# --- sources ---------------------------------------------------------------------------------

@_query("SELECT CAST(conv_id AS STRING) AS file_id, min(turn) AS first_turn, count(*) AS turns FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) WHERE g > 0 GROUP BY conv_id, g")
def continuation_merge(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("row"), "role", F.lit("x").alias("mark"))
    got = I.assembled_records(c, F.col("role") == "user", {"mark": ","})
    return got.select("file_id", F.col("row").alias("first_turn"), F.size(F.split("mark", ",")).cast("bigint").alias("turns"))


@_query("WITH v AS (SELECT l_returnflag AS file_id, l_extendedprice AS x FROM lineitem), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY file_id ORDER BY x) > 20 THEN 1 ELSE 0 END AS b FROM v), c AS (SELECT file_id, x, sum(b) OVER (PARTITION BY file_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS k FROM g) SELECT file_id, CAST(k AS BIGINT) AS cluster, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY file_id, k")
def x_cluster(spark, d):
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("file_id"), F.col("l_extendedprice").alias("x"))
    return I.cluster_values(v, "x", 20.0, ["file_id"]).groupBy("file_id", F.col("cluster").cast("bigint").alias("cluster")).agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@_query("SELECT CAST(n_nationkey AS STRING) AS word_id, n_regionkey AS col FROM nation")
def word_to_column(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    words = n.select(F.lit("f").alias("file_id"), F.col("n_nationkey").cast("string").alias("word_id"), (F.col("n_regionkey") * 10.0 + 1).alias("x0"), (F.col("n_regionkey") * 10.0 + 5).alias("x1"))
    edges = spark.read.parquet(f"{d}/region.parquet").select(F.lit("f").alias("file_id"), F.col("r_regionkey").alias("col"), (F.col("r_regionkey") * 10.0).alias("x0"), (F.col("r_regionkey") * 10.0 + 10).alias("x1"))
    return I.words_to_columns(words, edges).select("word_id", "col")


_PATHS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/p/PBS REV ' || chr(65 + CAST(page_id % 7 AS INTEGER)) || '.xlsx' WHEN 1 THEN '/p/a/PRT LIST ' || CAST(page_id AS STRING) || '.xls' WHEN 2 THEN '/p/.git/BOM.pdf' WHEN 3 THEN '/p/x/y/BOM ' || CAST(page_id AS STRING) || '.pdf' ELSE '/p/a/b/c/d/e/BOM.pdf' END AS path FROM pages"


def _files(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return spark.sql(_PATHS.replace("FROM pages", "FROM {pages}"), pages=p).withColumn("modification_time", F.timestamp_seconds(F.col("page_id")))


@_query(f"WITH f AS ({_PATHS}) SELECT path, CASE page_id % 5 WHEN 0 THEN 'PBS' WHEN 1 THEN 'BOM_EXCEL' ELSE 'BOM_PDF' END AS kind FROM f WHERE page_id % 5 IN (0, 1, 3)")
def discovery_classify(spark, d):
    return S.classify(_files(spark, d), "/p")


@_query(f"WITH f AS ({_PATHS}) SELECT path, CAST(1 AS BIGINT) AS rank_ties FROM f WHERE page_id % 5 = 0 ORDER BY page_id % 7 DESC, page_id DESC LIMIT 1")
def choose_pbs(spark, d):
    return S.choose_structure(_files(spark, d).where("page_id % 5 = 0"))


@_query(f"WITH f AS (SELECT upper(regexp_extract(path, '([^/]*)$', 1)) AS n FROM ({_PATHS})) SELECT CASE WHEN bool_or(regexp_matches(n, '\\.XLS[XM]?$') AND regexp_matches(n, 'PARTL|PBS|MDP')) THEN 'PBS_EXCEL' WHEN bool_or(n LIKE '%.PDF') AND NOT bool_or(regexp_matches(n, '\\.XLS[XM]?$')) THEN 'PDF_ONLY' ELSE 'PBS_EXCEL' END AS mode FROM f")
def mode_detect(spark, d):
    return S.mode(_files(spark, d))


@_query(f"WITH f AS (SELECT upper(regexp_extract(path, '([^/]*)$', 1)) AS n FROM ({_PATHS}) WHERE path LIKE '%.pdf') SELECT CASE WHEN bool_or(regexp_matches(n, '\\.XLS[XM]?$') AND regexp_matches(n, 'PARTL|PBS|MDP')) THEN 'PBS_EXCEL' WHEN bool_or(n LIKE '%.PDF') AND NOT bool_or(regexp_matches(n, '\\.XLS[XM]?$')) THEN 'PDF_ONLY' ELSE 'PBS_EXCEL' END AS mode FROM f")
def mode_detect_pages_only(spark, d):
    """The mode of a folder that has page files only."""
    return S.mode(_files(spark, d).where("path like '%.pdf'"))


_NAMES = "SELECT '/f/' || CAST(p_partkey * 7 + 3100000 AS STRING) || CASE WHEN p_size % 5 = 0 THEN ' REV B.pdf' ELSE ' REV A.pdf' END AS name FROM part"
_TARGETS = "SELECT CAST(p_partkey * 7 + 3100000 AS STRING) || 'PRTL' AS target, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END AS rev FROM part WHERE p_size % 3 = 0"
#: Length of the common prefix of two columns in SQL.
_PREFIX = "(SELECT COALESCE(max(i), 0) FROM range(1, 20) t(i) WHERE i <= length({a}) AND i <= length({b}) AND left({a}, i) = left({b}, i))"
_MATCHES = f"""WITH f AS ({_NAMES}), t AS ({_TARGETS}), fd AS (SELECT *, regexp_extract(name, '[0-9]+') AS x, regexp_extract(upper(name), 'REV\\s*[-_ .]*([A-Z0-9]+)', 1) AS fr FROM f), td AS (SELECT *, regexp_extract(target, '[0-9]+') AS y FROM t),
m AS (SELECT name AS path, target, rev, fr, list_max(list_transform(range(1, least(length(x), length(y)) + 1), lambda i: CASE WHEN left(x, i) = left(y, i) THEN i ELSE 0 END)) AS match_len FROM fd JOIN td ON left(x, 6) = left(y, 6)),
r AS (SELECT *, CASE WHEN rev <> '' AND rev <> fr THEN 'NO_MATCH' WHEN rev <> '' THEN 'STRONG' ELSE 'MEDIUM' END AS strength FROM m), fm AS (SELECT path, target, match_len, strength, CASE strength WHEN 'STRONG' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + least(match_len, 12) / 100.0::DOUBLE AS score FROM r WHERE strength <> 'NO_MATCH' QUALIFY row_number() OVER (PARTITION BY path ORDER BY strength DESC, match_len DESC, target, rev) = 1) """


def _named(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    files = spark.sql(_NAMES.replace("FROM part", "FROM {part}"), part=part).withColumn("path", F.col("name"))
    return files, spark.sql(_TARGETS.replace("FROM part", "FROM {part}"), part=part)


@_query(_MATCHES + "SELECT path, target, match_len, strength, round(score, 6) AS score FROM fm")
def filename_match_top1(spark, d):
    return V.match_targets(*_named(spark, d)).withColumn("score", F.round("score", 6))


_VERIFIED = with_views("bom_headers", "structure_revs") + """, hj AS (SELECT h.bom_id, h.code, h.revision AS hr, t.code AS target, t.rev AS tr, CASE WHEN substr(h.code, 2) = substr(t.code, 2) THEN 7 ELSE 6 END AS n FROM bom_headers h JOIN structure_revs t ON left(substr(h.code, 2), 6) = left(substr(t.code, 2), 6)),
ft AS (SELECT bom_id, max(n) AS match_len, arg_min(target, (-n, target)) AS target FROM hj WHERE tr = '' OR tr = hr GROUP BY bom_id), sn AS (SELECT bom_id, bool_or(tr <> '' AND hr = '') AS absent FROM hj GROUP BY bom_id),
vh AS (SELECT h.bom_id, ft.bom_id IS NOT NULL AS matched, CASE WHEN ft.bom_id IS NOT NULL THEN 'MATCH' WHEN sn.bom_id IS NULL THEN 'NO_NUMERIC_MATCH' WHEN sn.absent THEN 'REV_MISSING' ELSE 'REV_MISMATCH' END AS reason, COALESCE(ft.target, '') AS target, COALESCE(ft.match_len, 0) AS match_len FROM bom_headers h LEFT JOIN ft ON ft.bom_id = h.bom_id LEFT JOIN sn ON sn.bom_id = h.bom_id) """


def _verified_headers(spark, d):
    return V.verify_headers(view(spark, d, "bom_headers"), view(spark, d, "structure_revs").select(F.col("code").alias("target"), "rev"))


@_query(_VERIFIED + "SELECT * FROM vh")
def header_verification(spark, d):
    return _verified_headers(spark, d)


# --- grids of cells and lines ----------------------------------------------------------------

@_query("""WITH l AS (SELECT CAST(conv_id AS STRING) AS file_id, turn, CASE WHEN role = 'user' THEN '0010 u' ELSE 'more' END AS t FROM conversations), g AS (SELECT *, sum(CASE WHEN t = '0010 u' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY turn) AS k FROM l)
SELECT file_id, CAST(k AS BIGINT) AS record, string_agg(t, ' ' ORDER BY turn) AS text FROM g WHERE k > 0 GROUP BY file_id, k""")
def text_line_records(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    lines = c.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", "0010 u").otherwise("more").alias("text"))
    return I.line_records(lines).select("file_id", "record", "text")


_SHEET = "SELECT CAST(p_size % 10 AS STRING) AS file_id, CAST(p_partkey % 4 AS INTEGER) + 1 AS row, CAST(p_partkey % 7 AS INTEGER) + 1 AS col, CASE p_partkey % 6 WHEN 0 THEN ' pos ' WHEN 1 THEN 'Description' WHEN 2 THEN 'QTY' WHEN 3 THEN 'rev.' WHEN 4 THEN 'note' ELSE 'other' END AS value FROM part WHERE p_partkey % 11 < 3"


@_query(f"""WITH s AS ({_SHEET}), a AS (SELECT file_id, row, CASE upper(trim(value)) WHEN 'POS' THEN 'pos' WHEN 'DESCRIPTION' THEN 'description' WHEN 'QTY' THEN 'qty' WHEN 'REV.' THEN 'rev' WHEN 'NOTE' THEN 'notes' END AS c FROM s),
k AS (SELECT file_id, row, count(DISTINCT c) AS score, count(DISTINCT CASE WHEN c IN ('pos', 'description', 'qty') THEN c END) AS must FROM a WHERE c IS NOT NULL GROUP BY file_id, row)
SELECT file_id, row, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN must = 3 THEN 0 ELSE 1 END, CASE WHEN must = 3 THEN 0 ELSE -score END, row) AS r FROM k WHERE must = 3 OR score >= 3) WHERE r = 1""")
def header_alias_score(spark, d):
    cells = spark.sql(_SHEET.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{d}/part.parquet"))
    return I.header_rows(cells, I.alias_table(spark), ["pos", "description", "qty"])


@_query("""SELECT CAST(p_partkey AS STRING) AS file_id, k AS part, CASE WHEN k = 1 THEN '0001' ELSE '0002' END AS pos,
CASE WHEN p_size % 3 = 0 THEN CASE WHEN k = 1 THEN 'a' ELSE '' END WHEN p_size % 2 = 0 AND k = 1 THEN 'a' WHEN p_size % 2 = 0 THEN 'b c' ELSE 'a b c' END AS notes
FROM part CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) n WHERE k = 1 OR p_size % 2 = 0""")
def cell_expand(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(1).alias("row"), F.when(F.col("p_size") % 2 == 0, "0001\n0002").otherwise("0001").alias("pos"), F.when(F.col("p_size") % 3 == 0, "a").otherwise("a\nb\nnull\nc").alias("notes"))
    return I.expanded_cells(rows, ["pos", "notes"], ["notes"]).select("file_id", "part", "pos", "notes")


_SHORT = "SELECT p_brand AS file_id, p_partkey AS row, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS STRING) || ',5' WHEN p_size % 3 = 0 THEN lpad(CAST(p_size AS STRING), 2, '0') ELSE CAST(p_size AS STRING) END AS qty_text, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) ELSE 'Q' END AS rev, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'NR' END AS um FROM part"


@_query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row) AS k FROM ({_SHORT})), f AS (SELECT *, regexp_matches(trim(qty_text), '^[0-9]{{1,3}}$') AS short FROM r WHERE k <= 500),
c AS (SELECT file_id, count(*) FILTER (WHERE short) AS checked, count(*) FILTER (WHERE short AND (trim(qty_text) = trim(rev) OR trim(um) = '')) AS suspect FROM f GROUP BY file_id) SELECT *, CASE WHEN checked > 0 THEN suspect / checked >= 0.35 ELSE FALSE END AS misaligned FROM c""")
def misaligned_qty(spark, d):
    return I.misaligned_quantities(spark.sql(_SHORT.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{d}/part.parquet")))


_PARSED = "SELECT p_brand AS file_id, CASE p_partkey % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'grid' ELSE 'text' END AS parser, CASE WHEN p_size % 9 = 0 AND p_partkey % 3 = 0 THEN '' ELSE 'C' || CAST(p_size AS STRING) END AS internal_code, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS qty FROM part"
_SCORES = f"""WITH p AS ({_PARSED}), s AS (SELECT file_id, parser, count(*) AS n, avg(CASE WHEN internal_code <> '' THEN 1.0 ELSE 0.0 END) AS coverage, count(*) - count(DISTINCT internal_code) AS duplicates, count(qty) AS q FROM p GROUP BY file_id, parser),
k AS (SELECT file_id, parser, n, coverage, duplicates, n * coverage + 0.25 * q - 0.5 * duplicates AS score FROM s) """


def _parsed(spark, d):
    return spark.sql(_PARSED.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{d}/part.parquet"))


@_query(_SCORES + "SELECT file_id, parser, n, duplicates, round(score, 6) AS score FROM k")
def parser_scores(spark, d):
    return I.parser_scores(_parsed(spark, d)).select("file_id", "parser", "n", "duplicates", F.round("score", 6).alias("score"))


@_query(_SCORES + """, f AS (SELECT file_id, arg_min(parser, r) AS parser, arg_min(score, r) AS score FROM (SELECT *, CASE parser WHEN 'tables' THEN 1 WHEN 'text' THEN 2 ELSE 3 END AS r FROM k) GROUP BY file_id),
b AS (SELECT file_id, arg_max(parser, score) AS parser, max(score) AS score FROM k WHERE coverage >= 1 GROUP BY file_id) SELECT f.file_id, CASE WHEN b.score - f.score >= 1.5 THEN b.parser ELSE f.parser END AS parser FROM f LEFT JOIN b ON b.file_id = f.file_id""")
def parser_arbitration(spark, d):
    return I.chosen_parser(I.parser_scores(_parsed(spark, d)), ["tables", "text", "grid"])


@_query(f"""WITH p AS ({_PARSED}), a AS (SELECT DISTINCT file_id, internal_code AS c FROM p WHERE parser = 'tables'), b AS (SELECT DISTINCT file_id, internal_code AS c FROM p WHERE parser = 'grid'), n AS (SELECT file_id, count(*) AS n FROM a GROUP BY file_id), m AS (SELECT file_id, count(*) AS n FROM b GROUP BY file_id),
s AS (SELECT a.file_id, count(*) AS n FROM a JOIN b ON a.file_id = b.file_id AND a.c = b.c GROUP BY a.file_id) SELECT n.file_id, CAST(COALESCE(s.n, 0) AS INTEGER) AS shared, COALESCE(s.n, 0) / n.n AS share_a, COALESCE(s.n, 0) / m.n AS share_b FROM n JOIN m ON m.file_id = n.file_id LEFT JOIN s ON s.file_id = n.file_id""")
def parser_overlap(spark, d):
    p = _parsed(spark, d)
    return I.parser_overlap(p.where("parser = 'tables'"), p.where("parser = 'grid'"))
