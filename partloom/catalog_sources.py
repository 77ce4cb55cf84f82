"""Queries of the page and sheet extractors, by name, and their SQL.

Views render known records as cells, lines and words; the SQL gives the records that must come back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .adapters import view, with_views
from .catalog_reports import _over
from .operators.reconcile import load_totalization
from .plans import pipelines as L
from .sources import arbitration as A
from .sources import page_grids as W
from .sources import records as R
from .sources import sheets as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- tables to records -----------------------------------------------------------------------

# Orders as rows of tables: two positions in one row, documents, rows that are no lines, rows without a code.
_TABLE_ROWS = """SELECT CAST(o_orderkey % 97 AS STRING) AS file_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS page, o_orderkey + 2 AS row, CAST(o_orderkey % 6 AS INTEGER) AS kind,
'C' || lpad(CAST(o_custkey AS STRING), 6, '0') AS code, CAST(o_orderkey % 90 + 1 AS STRING) AS pos, o_orderpriority AS note FROM orders"""
_TABLE_CELLS = f"""WITH r AS ({_TABLE_ROWS}), b AS (SELECT *,
CASE kind WHEN 0 THEN pos || chr(10) || '7' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE pos END AS c_pos, CASE kind WHEN 1 THEN 'Disegno' WHEN 2 THEN 'Motor' ELSE '' END AS c_type,
CASE kind WHEN 0 THEN code || chr(10) || 'Z' || code WHEN 3 THEN ' ' ELSE code END AS c_code, CASE kind WHEN 0 THEN 'A' || chr(10) || 'null' ELSE 'B' END AS c_rev,
CASE kind WHEN 0 THEN 'one' || chr(10) || 'two' || chr(10) || 'three' WHEN 1 THEN 'draw' || chr(10) || 'ing' ELSE ' text ' END AS c_desc,
CASE kind WHEN 0 THEN '1' || chr(10) || '2,5' || chr(10) || '9' ELSE '4' END AS c_qty FROM r),
k AS (SELECT CAST(n_nationkey AS INTEGER) AS col FROM nation WHERE n_nationkey < 8)
SELECT file_id, page, 1 AS table_no, row, col, CASE WHEN page = 1 THEN CASE col WHEN 0 THEN c_pos WHEN 1 THEN c_type WHEN 2 THEN c_code WHEN 3 THEN c_rev WHEN 4 THEN c_desc WHEN 5 THEN 'NR' WHEN 6 THEN c_qty ELSE note END
ELSE CASE col WHEN 0 THEN c_pos WHEN 1 THEN c_qty WHEN 2 THEN c_code WHEN 3 THEN c_desc WHEN 4 THEN c_type WHEN 5 THEN 'second' WHEN 6 THEN 'MT' ELSE 'no column' END END AS value FROM b JOIN k ON 1 = 1
UNION ALL SELECT f.file_id, f.page, 1, 1, k.col, CASE f.page WHEN 1 THEN CASE col WHEN 0 THEN 'Pos' WHEN 1 THEN 'Tipo' WHEN 2 THEN 'Codice' || chr(10) || 'Code' WHEN 3 THEN 'Rev.' WHEN 4 THEN 'Descrizione' WHEN 5 THEN 'U.M.' WHEN 6 THEN 'Q.ty' ELSE 'Note' END
WHEN 2 THEN CASE col WHEN 0 THEN 'Item' WHEN 1 THEN 'Quantity' WHEN 2 THEN 'Material' WHEN 3 THEN 'Description' WHEN 4 THEN 'Type' WHEN 5 THEN 'Code' WHEN 6 THEN 'Unit' ELSE '-' END
ELSE CASE col WHEN 0 THEN 'Pos' WHEN 1 THEN 'Code' ELSE '' END END FROM (SELECT DISTINCT file_id, page FROM r WHERE page <> 3) f JOIN k ON 1 = 1
UNION ALL SELECT DISTINCT file_id, page, 1, 0, 0, 'Lista' FROM r"""


def _table_sql(most_page: int) -> str:
    return f"""WITH r AS ({_TABLE_ROWS} WHERE o_orderkey % 4 < {most_page} AND o_orderkey % 6 NOT IN (2, 3)), p AS (SELECT r.*, n.k FROM r JOIN (SELECT 1 AS k UNION ALL SELECT 2) n ON n.k = 1 OR r.kind = 0)
SELECT file_id, page, row, k AS part, CASE WHEN kind = 1 THEN '' WHEN k = 2 THEN '0007' ELSE lpad(pos, 4, '0') END AS pos, CASE WHEN kind = 1 THEN 'Disegno' END AS type, CASE WHEN k = 2 THEN 'Z' ELSE '' END || code AS internal_code,
CASE WHEN page > 1 THEN '' WHEN kind = 0 THEN CASE WHEN k = 1 THEN 'A' ELSE '' END ELSE 'B' END AS rev, CASE WHEN kind = 1 THEN 'draw ing' WHEN kind > 0 THEN 'text' WHEN k = 1 THEN 'one' ELSE 'two' || chr(10) || 'three' END AS description,
CASE WHEN kind = 0 AND k = 2 THEN '' WHEN page = 1 THEN 'NR' ELSE 'MT' END AS um, CASE WHEN kind = 1 THEN NULL WHEN kind = 0 THEN CASE WHEN k = 1 THEN '1' ELSE '2,5' END ELSE '4' END AS qty,
CASE WHEN page = 1 THEN CASE WHEN kind = 0 AND k = 2 THEN '' ELSE note END END AS notes FROM p"""


_LINE = ("pos", "type", "internal_code", "rev", "description", "um", "qty")


def _tables(spark, d, carry: bool):
    found = R.table_records(_over(spark, d, _TABLE_CELLS, "orders", "nation"), carry)
    return found.select("file_id", "page", "row", "part", *_LINE, "notes")


@_query(_table_sql(2))
def table_records(spark, d):
    """Tables with a header of their own."""
    return _tables(spark, d, False)


@_query(_table_sql(4))
def table_records_carried(spark, d):
    """Later pages take the columns of the last header."""
    return _tables(spark, d, True)


# --- text lines to records -------------------------------------------------------------------

_TEXT_ROWS = """SELECT CAST(o_orderkey % 61 AS STRING) AS file_id, CAST(o_orderkey / 5000 AS INTEGER) + 1 AS page, o_orderkey AS k, CAST(o_orderkey % 7 AS INTEGER) AS kind, 'E' || lpad(CAST(o_custkey AS STRING), 7, '0') AS code,
lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS pos, CAST(o_orderkey % 40 AS STRING) AS q FROM orders"""
_TEXT_ROWS = _TEXT_ROWS.replace("CAST(o_orderkey / 5000 AS INTEGER)", "CAST(floor(o_orderkey / 5000) AS INTEGER)")
_TEXT_LINES = f"""WITH r AS ({_TEXT_ROWS}) SELECT file_id, page, k * 3 + 1 AS line_no, '  ' || pos || '  ' || CASE kind WHEN 0 THEN code || ' 01 A long bolt NR ' || q WHEN 1 THEN 'old ' || code || ' B bolt PZ ' || q || ',5' WHEN 2 THEN code || ' washer plate ' || q
WHEN 3 THEN code || ' 02 longer text' WHEN 4 THEN 'no code NR 5' WHEN 5 THEN code || ' C kit 12 boxes of 3 sets' ELSE code END AS text FROM r
UNION ALL SELECT file_id, page, k * 3 + 2, 'joined KG 1.5 (approx)' FROM r WHERE kind = 3 UNION ALL SELECT file_id, page, k * 3 + 2, ' ' FROM r WHERE kind = 2
UNION ALL SELECT DISTINCT file_id, 0, CAST(1 AS BIGINT), 'See Disegno F' || lpad(file_id, 7, '0') || ' 03 D cover sheet 4' FROM r UNION ALL SELECT DISTINCT file_id, 0, CAST(2 AS BIGINT), 'Motorino F' || lpad(file_id, 7, '0') || ' is none' FROM r
UNION ALL SELECT DISTINCT file_id, 0, CAST(3 AS BIGINT), 'DD F' || lpad(file_id, 7, '0') || ' plan' FROM r"""


@_query(f"""WITH r AS ({_TEXT_ROWS}) SELECT file_id, page, k * 3 + 1 AS line_no, pos, CAST(NULL AS VARCHAR) AS type, CASE WHEN kind = 0 THEN code || ' 01' ELSE code END AS internal_code,
CASE kind WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 3 THEN '02' WHEN 5 THEN 'C' ELSE '' END AS rev,
CASE kind WHEN 0 THEN 'long bolt' WHEN 1 THEN 'bolt' WHEN 2 THEN 'washer plate' WHEN 3 THEN 'longer text joined' WHEN 5 THEN 'kit 12 boxes' ELSE '' END AS description,
CASE kind WHEN 0 THEN 'NR' WHEN 1 THEN 'PZ' WHEN 3 THEN 'KG' WHEN 5 THEN 'of' ELSE '' END AS um, CASE kind WHEN 0 THEN q WHEN 1 THEN q || ',5' WHEN 2 THEN q WHEN 3 THEN '1.5' WHEN 5 THEN '3' END AS qty FROM r WHERE kind <> 4
UNION ALL SELECT DISTINCT file_id, 0, CAST(1 AS BIGINT), '', 'Disegno', 'F' || lpad(file_id, 7, '0') || ' 03', 'D', 'cover sheet 4', '', NULL FROM r
UNION ALL SELECT DISTINCT file_id, 0, CAST(3 AS BIGINT), '', 'DD', 'F' || lpad(file_id, 7, '0'), '', 'plan', '', NULL FROM r""")  # fmt: skip
def text_records(spark, d):
    return R.text_records(_over(spark, d, _TEXT_LINES, "orders")).select("file_id", "page", "line_no", *_LINE)


# --- ruled pages to records ------------------------------------------------------------------

# Orders as lines of pages: up to 20 lines of 24 points on a page; even pages have neither rules nor a header.
_GRID_ROWS = """SELECT CAST(CAST(floor(o_orderkey / 40) AS INTEGER) AS STRING) AS file_id, CAST(floor(o_orderkey % 40 / 20) AS INTEGER) + 1 AS page, CAST(260 + 24 * (o_orderkey % 20) AS DOUBLE) AS top, CAST(o_orderkey % 5 AS INTEGER) AS kind,
'E' || lpad(CAST(o_custkey AS STRING), 7, '0') AS code, lpad(CAST(o_orderkey % 40 * 10 + 10 AS STRING), 4, '0') AS pos, CAST(o_orderkey % 9 + 1 AS STRING) AS q, o_orderkey AS k FROM orders"""
_GRID_WORDS = f"""WITH r AS ({_GRID_ROWS}) SELECT file_id, page, text, x AS x0, x + 8 AS x1, top + d AS top, top + d + 9 AS bottom FROM (
SELECT file_id, page, pos AS text, CAST(12 AS DOUBLE) AS x, top, 0.5 AS d FROM r UNION ALL SELECT file_id, page, code, 52, top, 0 FROM r WHERE kind <> 3
UNION ALL SELECT file_id, page, 'A', 122, top, 1 FROM r WHERE kind <> 1 UNION ALL SELECT file_id, page, 'first', 152, top, 0 FROM r UNION ALL SELECT file_id, page, 'text', 180, top, 0 FROM r
UNION ALL SELECT file_id, page, 'second', 152, top, 11 FROM r WHERE kind = 2 UNION ALL SELECT file_id, page, 'B', 122, top, 11 FROM r WHERE kind = 2 UNION ALL SELECT file_id, page, q, 342, top, 11 FROM r WHERE kind = 2
UNION ALL SELECT file_id, page, 'NR', 302, top, 0 FROM r UNION ALL SELECT file_id, page, q, 342, top, 0 FROM r WHERE kind <> 2
UNION ALL SELECT DISTINCT file_id, page, 'Rilascio', 152, 790, 0 FROM r UNION ALL SELECT DISTINCT file_id, page, '0001', 12, 120, 0 FROM r
UNION ALL SELECT DISTINCT file_id, page, 'Pos', 12, 200, 0 FROM r WHERE page = 1 UNION ALL SELECT DISTINCT file_id, page, 'Codice', 52, 200, 0 FROM r WHERE page = 1 UNION ALL SELECT DISTINCT file_id, page, 'Rev.', 122, 201, 0 FROM r WHERE page = 1
UNION ALL SELECT DISTINCT file_id, page, 'Descrizione', 152, 200, 0 FROM r WHERE page = 1 UNION ALL SELECT DISTINCT file_id, page, 'U.M.', 302, 200, 0 FROM r WHERE page = 1 UNION ALL SELECT DISTINCT file_id, page, 'Q.ty', 342, 200, 0 FROM r WHERE page = 1) w"""
_GRID_RULES = f"""SELECT f.file_id, f.page, e.x + d.d AS x, CAST(100 AS DOUBLE) AS top, CAST(790 AS DOUBLE) AS bottom FROM (SELECT DISTINCT file_id, page FROM ({_GRID_ROWS}) r WHERE page = 1) f
JOIN (SELECT CASE n_nationkey WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 120 WHEN 3 THEN 150 WHEN 4 THEN 300 WHEN 5 THEN 340 ELSE 380 END AS x FROM nation WHERE n_nationkey < 7) e ON 1 = 1 JOIN (SELECT -0.5 AS d UNION ALL SELECT 0.5) d ON 1 = 1"""
_GRID_PAGES = f"SELECT DISTINCT file_id, page, CAST(842 AS DOUBLE) AS height FROM ({_GRID_ROWS}) r"
# A second page goes on where the first had lines and it has enough words, codes and positions of its own.
_GRID_STATE = f"""r AS ({_GRID_ROWS}), c AS (SELECT file_id, page, count(*) AS rows, sum(CASE WHEN kind = 3 THEN 0 ELSE 1 END) AS codes,
sum(5 + CASE WHEN kind = 3 THEN -1 ELSE 0 END + CASE WHEN kind = 1 THEN 0 ELSE 1 END + CASE WHEN kind = 2 THEN 2 ELSE 0 END) AS words FROM r GROUP BY file_id, page),
ok AS (SELECT file_id, page, CASE WHEN page = 1 OR (words >= 18 AND codes >= 3 AND rows >= 2 AND file_id IN (SELECT file_id FROM c WHERE page = 1)) THEN 'OK' ELSE 'FEW_RULES' END AS status FROM c)"""


def _grid(spark, d, keep=lambda df: df):
    words, rules, pages = (keep(_over(spark, d, sql, "orders", "nation")) for sql in (_GRID_WORDS, _GRID_RULES, _GRID_PAGES))
    return W.grid_records(words, rules, pages)


@_query(f"""WITH {_GRID_STATE} SELECT r.file_id, r.page, pos, CAST(NULL AS VARCHAR) AS type, code AS internal_code, CASE WHEN kind = 1 THEN '' ELSE 'A' END AS rev, CASE WHEN kind = 2 THEN 'first text second' ELSE 'first text' END AS description, 'NR' AS um, q AS qty
FROM r JOIN ok ON ok.file_id = r.file_id AND ok.page = r.page WHERE status = 'OK' AND kind <> 3""")
def grid_records(spark, d):
    return _grid(spark, d)[0].select("file_id", "page", *_LINE)


@_query(f"WITH {_GRID_STATE} SELECT file_id, page, status FROM ok")
def grid_pages(spark, d):
    return _grid(spark, d)[1]


# --- arbitration -----------------------------------------------------------------------------

# What five extractors find: f % 8 tells which of them has lines, and how good they are.
_FOUND = """SELECT CAST(o_orderkey % 240 AS STRING) AS file_id, CAST(o_orderkey % 240 % 8 AS INTEGER) AS f, CAST(o_orderkey % 2 + 1 AS INTEGER) AS page, o_orderkey AS record, s.stage,
CASE WHEN s.stage = 'grid-layout' AND o_orderkey % 240 % 8 = 7 THEN 'G' ELSE 'C' END || lpad(CAST(o_custkey AS STRING), 6, '0') AS internal_code,
CASE WHEN o_orderkey % 240 % 8 = 7 THEN '2' ELSE 'A' END AS rev, 'NR' AS um, CASE WHEN o_orderkey % 240 % 8 = 7 THEN '2' ELSE '1000' END AS qty, CASE WHEN s.stage = 'grid-layout' THEN 'maker' END AS manufacturer
FROM orders o JOIN (SELECT 'tables' AS stage UNION ALL SELECT 'tables-aggressive' UNION ALL SELECT 'text' UNION ALL SELECT 'grid-layout' UNION ALL SELECT 'layout') s
ON (s.stage = 'tables' AND o_orderkey % 240 % 8 IN (0, 5, 6, 7)) OR (s.stage = 'tables-aggressive' AND o_orderkey % 240 % 8 IN (0, 1)) OR (s.stage = 'text' AND o_orderkey % 240 % 8 IN (1, 2))
OR (s.stage = 'grid-layout' AND (o_orderkey % 240 % 8 IN (0, 3, 5, 6) OR (o_orderkey % 240 % 8 = 7 AND CAST(floor(o_orderkey / 240) AS BIGINT) % 5 < 2))) OR (s.stage = 'layout' AND o_orderkey % 240 % 8 IN (3, 4))"""


def _staged(spark, d):
    found = _over(spark, d, _FOUND.replace("FROM orders o", "FROM (SELECT * FROM orders) o"), "orders")
    text = F.lit(None).cast("string")
    rows = found.select("file_id", "f", "page", "record", "stage", text.alias("pos"), text.alias("type"), "internal_code", "rev", F.lit("").alias("description"), "um", "qty", text.alias("notes"), "manufacturer", text.alias("manufacturer_code"))
    of = lambda stage: lambda files: rows.where(F.col("stage") == stage).join(files, "file_id", "left_semi")
    files = _over(spark, d, "SELECT DISTINCT CAST(o_orderkey % 240 AS STRING) AS file_id, CAST(o_orderkey % 240 % 8 AS INTEGER) AS f FROM orders", "orders")
    status = F.when((F.col("f") == 6) & (F.col("page") == 2), "FEW_RULES").otherwise("OK")
    pages = files.select("file_id", "f", F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).select("file_id", "page", status.alias("status"))
    grid = lambda wanted: (of("grid-layout")(wanted), pages.join(wanted, "file_id", "left_semi"))
    return A.staged_records(files, {name: of(name) for name in A.PLAIN}, grid, of("layout"), files.where("f in (5, 6)"))


@_query(f"""WITH v AS ({_FOUND}), files AS (SELECT DISTINCT CAST(o_orderkey % 240 AS STRING) AS file_id, CAST(o_orderkey % 240 % 8 AS INTEGER) AS f FROM orders),
b AS (SELECT file_id, count(*) AS n FROM v WHERE (stage = 'tables') OR (stage = 'tables-aggressive' AND f = 1) OR (stage = 'text' AND f = 2) GROUP BY file_id),
g AS (SELECT file_id, count(*) AS n FROM v WHERE stage = 'grid-layout' AND f IN (3, 4, 5, 6, 7) GROUP BY file_id), y AS (SELECT file_id, count(*) AS n FROM v WHERE stage = 'layout' AND f = 4 GROUP BY file_id),
bc AS (SELECT DISTINCT file_id, internal_code AS c FROM v WHERE stage = 'tables'), gc AS (SELECT DISTINCT file_id, internal_code AS c FROM v WHERE stage = 'grid-layout'),
o AS (SELECT bc.file_id, count(gc.c) / count(*) AS o FROM bc LEFT JOIN gc ON gc.file_id = bc.file_id AND gc.c = bc.c GROUP BY bc.file_id),
j AS (SELECT files.file_id, f, COALESCE(b.n, 0) AS bn, COALESCE(g.n, 0) AS gn, y.n AS yn, COALESCE(o.o, CASE WHEN g.n > 0 THEN 0.0 ELSE 1.0 END) AS o FROM files LEFT JOIN b ON b.file_id = files.file_id LEFT JOIN g ON g.file_id = files.file_id LEFT JOIN y ON y.file_id = files.file_id LEFT JOIN o ON o.file_id = files.file_id),
k AS (SELECT *, CASE WHEN f = 6 THEN 3 + 10 + 10 + 3 + 2 ELSE 0 END + CASE WHEN gn = 0 THEN 10 ELSE 0 END + CASE WHEN bn > 0 THEN 12 * greatest(0, 0.55 - o) + 14 * greatest(0, (bn - gn) / bn - 0.15) ELSE 0 END AS penalty FROM j)
SELECT file_id, CASE f WHEN 0 THEN 'tables' WHEN 1 THEN 'tables-aggressive' WHEN 2 THEN 'text' WHEN 3 THEN 'grid-layout' WHEN 4 THEN 'layout' WHEN 5 THEN 'grid-layout' ELSE 'tables' END AS parser,
CASE f WHEN 4 THEN yn WHEN 3 THEN gn WHEN 5 THEN gn ELSE bn END AS n_rows,
CASE WHEN f < 3 THEN 'first_with_lines' WHEN f = 3 THEN 'grid_has_rows_tables_empty' WHEN f = 4 THEN 'grid_empty' WHEN f = 5 THEN 'quality_score_adjusted_strong_gain' WHEN f = 6 THEN 'tables_preferred_parse_incomplete' ELSE 'tables_preferred_low_overlap_row_loss' END AS reason,
CASE WHEN f > 2 THEN bn END AS base_rows, CASE WHEN f > 2 THEN gn END AS grid_rows, CASE WHEN f > 2 THEN round(CASE WHEN gn > 0 THEN 2.2 * gn ELSE -100 END - penalty - CASE WHEN bn > 0 THEN bn ELSE -100 END, 6) END AS gain, CASE WHEN f > 2 THEN round(o, 6) END AS overlap FROM k""")
def staged_arbitration(spark, d):
    report = _staged(spark, d)[1]
    return report.select("file_id", "parser", "n_rows", "reason", "base_rows", "grid_rows", F.round("gain", 6).alias("gain"), F.round("overlap", 6).alias("overlap"))


@_query(f"""WITH v AS ({_FOUND}) SELECT file_id, page, record, internal_code, stage AS parser FROM v WHERE (f IN (0, 6, 7) AND stage = 'tables') OR (f = 1 AND stage = 'tables-aggressive') OR (f = 2 AND stage = 'text')
OR (f IN (3, 5) AND stage = 'grid-layout') OR (f = 4 AND stage = 'layout')""")
def staged_records(spark, d):
    return _staged(spark, d)[0].select("file_id", "page", "record", "internal_code", "parser")


# --- component and totals sheets -------------------------------------------------------------

# Orders as rows of sheets, each other row filled; a gap of 40 rows after the twentieth, a header again at the seventeenth.
_SHEET_ROWS = """SELECT CAST(o_orderkey % 50 AS STRING) AS file_id, CAST(o_orderkey % 50 AS INTEGER) AS f, CAST(floor(o_orderkey / 50) AS INTEGER) AS n, CAST(o_custkey AS STRING) AS cust FROM orders"""
_SHEET_CELLS = f"""WITH r AS ({_SHEET_ROWS}), k AS (SELECT CAST(n_nationkey AS INTEGER) + 1 AS col FROM nation WHERE n_nationkey < 7), b AS (SELECT *, CASE WHEN n >= 20 THEN 40 ELSE 0 END + 10 + 2 * n AS row, n % 3 = 0 AND (n > 0 OR f % 7 <> 0) AS starts FROM r)
SELECT file_id, row, col, CASE WHEN n = 16 THEN CASE col WHEN 1 THEN 'POS' WHEN 3 THEN 'Descrizione' ELSE NULL END WHEN starts THEN CASE col WHEN 1 THEN CAST(n AS STRING) WHEN 2 THEN 'C' || cust WHEN 3 THEN 'part' WHEN 4 THEN '1.000,5' WHEN 5 THEN 'NR' WHEN 6 THEN 'R' || CAST(n AS STRING) ELSE '' END
ELSE CASE col WHEN 2 THEN 'ignored' WHEN 3 THEN ' more' || CAST(n AS STRING) WHEN 4 THEN '7' WHEN 6 THEN 'S' || CAST(n AS STRING) WHEN 7 THEN 'v' END END AS value FROM b JOIN k ON 1 = 1
UNION ALL SELECT f.file_id, 5, k.col, CASE k.col WHEN 1 THEN 'Pos.' WHEN 2 THEN 'Internal  code' WHEN 3 THEN 'Description' WHEN 4 THEN 'Q.ty' WHEN 5 THEN 'UM' WHEN 6 THEN 'RefDes' ELSE 'Value' END FROM (SELECT DISTINCT file_id FROM r) f JOIN k ON 1 = 1"""


@_query(f"""WITH r AS (SELECT * FROM ({_SHEET_ROWS}) WHERE n < 20 AND n <> 16), s AS (SELECT * FROM r WHERE n % 3 = 0 AND (n > 0 OR f % 7 <> 0)),
j AS (SELECT s.file_id, s.n, any_value(s.cust) AS cust, string_agg(' more' || CAST(c.n AS STRING), '' ORDER BY c.n) AS more, string_agg(', S' || CAST(c.n AS STRING), '' ORDER BY c.n) AS refs, string_agg('v', ' ' ORDER BY c.n) AS val
FROM s LEFT JOIN r c ON c.file_id = s.file_id AND c.n > s.n AND c.n < s.n + 3 GROUP BY s.file_id, s.n)
SELECT file_id, 10 + 2 * n AS row, lpad(CAST(n AS STRING), 4, '0') AS pos, 'C' || cust AS internal_code, 'part' || COALESCE(more, '') AS description, CAST(1000.5 AS DOUBLE) AS qty, 'NR' AS um, 'R' || CAST(n AS STRING) || COALESCE(refs, '') AS refdes, COALESCE(val, '') AS val, CAST(NULL AS VARCHAR) AS notes FROM j""")
def sheet_records(spark, d):
    records = S.sheet_records(_over(spark, d, _SHEET_CELLS, "orders", "nation"))[0]
    return records.select("file_id", "row", "pos", "internal_code", "description", "qty", "um", "refdes", "val", "notes")


@_query(f"SELECT file_id, 10 + 2 * n AS row FROM ({_SHEET_ROWS}) WHERE f % 7 = 0 AND n < 3")
def sheet_orphans(spark, d):
    return S.sheet_records(_over(spark, d, _SHEET_CELLS, "orders", "nation"))[1]


# Totals with hidden rows, formulas, codes without letters, and rows after a gap of 35.
_TOTAL_ROWS = f"SELECT file_id, n, n + 3 + CASE WHEN n >= 25 THEN 35 ELSE 0 END AS row, CASE WHEN n % 9 = 4 THEN cust ELSE 'E' || CAST(CAST(cust AS BIGINT) % 9 AS STRING) END AS code, CASE WHEN n % 13 = 6 THEN '=A1' ELSE CAST(n % 4 AS STRING) END AS q FROM ({_SHEET_ROWS}) x"
_TOTAL_CELLS = f"""WITH t AS ({_TOTAL_ROWS}) SELECT file_id, 'Totalizzazione' AS sheet, row, 2 AS col, code AS value FROM t UNION ALL SELECT file_id, 'Totalizzazione', row, 5, q FROM t UNION ALL SELECT file_id, 'Other', row, 2, 'X1' FROM t
UNION ALL SELECT DISTINCT file_id, 'Totalizzazione', 2, 2, 'Internal code' FROM t UNION ALL SELECT DISTINCT file_id, 'Totalizzazione', 2, 5, 'Q.ty' FROM t"""


@_query(f"""WITH t AS ({_TOTAL_ROWS}), v AS (SELECT * FROM t WHERE n < 25 AND n % 11 <> 5 AND n % 13 <> 6 AND n % 4 > 0 AND n % 9 <> 4)
SELECT code AS pn, CAST(sum(CAST(q AS BIGINT)) AS BIGINT) AS qty, count(*) AS n_rows, array_to_string(list_slice(list(row ORDER BY row), 1, 5), ',') AS samples FROM v GROUP BY code""")
def sheet_totals(spark, d):
    hidden = _over(spark, d, _TOTAL_ROWS, "orders").where("n % 11 = 5").select("file_id", "row")
    loaded = load_totalization(S.totals_cells(_over(spark, d, _TOTAL_CELLS, "orders"), hidden))
    return loaded.select("pn", F.col("qty").cast("bigint").alias("qty"), "n_rows", F.array_join("samples", ",").alias("samples"))


# --- structures with merged headers ----------------------------------------------------------

# Parts as rows of structures: in files of an odd number the header's cells are merged, and values stand at their second column or later.
_MERGED_CELLS = """WITH r AS (SELECT CAST(p_partkey % 20 AS STRING) AS file_id, p_partkey % 2 = 1 AS odd, CAST(floor(p_partkey / 20) AS INTEGER) AS n, p_partkey AS k, CAST(p_size % 3 AS INTEGER) AS l FROM part), b AS (SELECT *, n + 4 + CASE WHEN n >= 60 THEN 25 ELSE 0 END AS row FROM r)
SELECT file_id, row, CASE WHEN odd THEN 7 ELSE 1 END AS col, 'E' || CAST(k AS STRING) AS value FROM b WHERE n % 7 <> 3 UNION ALL SELECT file_id, row, CASE WHEN odd THEN 3 ELSE 3 + l END, ' text ' FROM b WHERE n % 5 <> 2 UNION ALL SELECT file_id, row, CASE WHEN odd THEN 1 ELSE 6 END, 'A' FROM b
UNION ALL SELECT file_id, row, CASE WHEN odd THEN 5 ELSE 7 END, '2,5' FROM b WHERE l > 0
UNION ALL SELECT DISTINCT file_id, 3, CASE WHEN odd THEN 6 ELSE 1 END, 'Codice' FROM r UNION ALL SELECT DISTINCT file_id, 3, CASE WHEN odd THEN 2 ELSE 3 END, 'Description' FROM r UNION ALL SELECT DISTINCT file_id, 3, CASE WHEN odd THEN 1 ELSE 6 END, 'Rev.' FROM r UNION ALL SELECT DISTINCT file_id, 3, CASE WHEN odd THEN 5 ELSE 7 END, 'QTY' FROM r"""
_SPANS = "SELECT DISTINCT CAST(p_partkey % 20 AS STRING) AS file_id, 3 AS row0, 3 AS row1, 2 AS col0, 4 AS col1 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT DISTINCT CAST(p_partkey % 20 AS STRING), 2, 3, 6, 8 FROM part WHERE p_partkey % 2 = 1"


@_query("""WITH r AS (SELECT CAST(p_partkey % 20 AS STRING) AS doc_id, p_partkey % 2 = 1 AS odd, CAST(floor(p_partkey / 20) AS INTEGER) AS n, p_partkey AS k, CAST(p_size % 3 AS INTEGER) AS l FROM part)
SELECT doc_id, CAST(n + 4 AS BIGINT) AS seq, CASE WHEN n % 7 <> 3 THEN 'E' || CAST(k AS STRING) ELSE '' END AS code, CASE WHEN n % 5 <> 2 THEN 'text' ELSE '' END AS description, 'A' AS rev, CASE WHEN l > 0 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS qty,
CASE WHEN n % 5 = 2 THEN 0 WHEN odd THEN 1 ELSE l END AS level FROM r WHERE n < 60 AND (n % 7 <> 3 OR n % 5 <> 2)""")
def structure_merged(spark, d):
    return S.structure_rows(_over(spark, d, _MERGED_CELLS, "part"), _over(spark, d, _SPANS, "part"))


# --- lines and structures by internal code ---------------------------------------------------

# Every third part has an alias, some two of them; raw lines as extractors give them.
_ALIASES = """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'x-' ELSE ' X ' END || CAST(p_partkey AS STRING) AS external_code, 'I' || CAST(p_partkey + 1 AS STRING) AS internal_code FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'X' || CAST(p_partkey AS STRING), 'I' || CAST(p_partkey + 2 AS STRING) FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT '', 'I0' FROM part WHERE p_partkey = 1"""
_RAW_LINES = """SELECT p_partkey AS line_no, ' 00' || CAST(p_size AS STRING) || '  a ' AS pos, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'x ' || CAST(p_partkey AS STRING) END AS internal_code, ' ' || p_name AS description,
CASE p_partkey % 5 WHEN 0 THEN '1,5' WHEN 1 THEN ' 2 ' WHEN 2 THEN '-' WHEN 3 THEN 'x' END AS qty, CASE p_partkey % 4 WHEN 0 THEN 'pz' WHEN 1 THEN ' doc ' ELSE '' END AS um, CASE WHEN p_size = 7 THEN 'Disegno' WHEN p_size = 8 THEN ' a  b' ELSE NULL END AS type,
p_brand AS manufacturer, CAST(NULL AS STRING) AS notes FROM part"""


@_query(rf"""WITH al AS (SELECT regexp_replace(upper(external_code), '[^A-Z0-9]', '', 'g') AS k, min(internal_code) AS i FROM ({_ALIASES}) WHERE external_code <> '' GROUP BY 1), r AS ({_RAW_LINES}),
c AS (SELECT *, regexp_replace(upper(internal_code), '[^A-Z0-9]', '', 'g') AS k, TRY_CAST(replace(trim(qty), ',', '.') AS DOUBLE) AS q, trim(COALESCE(type, '')) AS t, upper(trim(um)) AS u FROM r)
SELECT line_no, trim(regexp_replace(pos, '\s+', ' ', 'g')) AS pos, COALESCE(al.i, c.k) AS internal_code, trim(description) AS description, q AS qty, u AS unit,
CASE WHEN t = 'Disegno' OR u = 'DOC' THEN 'DOCUMENT_REF' WHEN q IS NULL THEN 'UNKNOWN' ELSE 'MATERIAL' END AS kind, regexp_replace(t, '\s+', ' ', 'g') AS type, '' AS val, '' AS rat, '' AS tol, '' AS refdes, '' AS tecn, '' AS notes, manufacturer, '' AS manufacturer_code, '' AS rev
FROM c LEFT JOIN al ON al.k = c.k""")
def normalised_lines(spark, d):
    lines = L.normalised_lines(_over(spark, d, _RAW_LINES, "part"), _over(spark, d, _ALIASES, "part"))
    return lines.select("line_no", "pos", "internal_code", "description", "qty", "unit", "kind", "type", "val", "rat", "tol", "refdes", "tecn", "notes", "manufacturer", "manufacturer_code", "rev")


@_query(with_views("pbs_rows") + f""", al AS (SELECT 'E' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS k, 'Y' || CAST(s_suppkey AS STRING) AS i FROM supplier WHERE s_suppkey % 2 = 0)
SELECT seq, level, COALESCE(al.i, code) AS code, rev, qty FROM pbs_rows LEFT JOIN al ON al.k = code""")
def structure_by_alias(spark, d):
    aliases = _over(spark, d, "SELECT 'e ' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS external_code, 'y-' || CAST(s_suppkey AS STRING) AS internal_code FROM supplier WHERE s_suppkey % 2 = 0", "supplier")
    return L.structure_by_alias(view(spark, d, "pbs_rows"), aliases).select("seq", "level", "code", "rev", "qty")
