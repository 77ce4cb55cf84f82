"""Deterministic product-structure views over the sample tables, in SQL that Spark and DuckDB both read.

Each view is a SELECT over the sample tables, written with their names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .plans.tables import stored


def _code(key: str) -> str:
    return f"('E' || lpad(CAST({key} AS STRING), 7, '0'))"


_PAIRS = """
SELECT a.p_partkey AS parent, b.p_partkey AS child, 1 AS slot FROM {part} a JOIN {part} b ON b.p_partkey = 2 * a.p_partkey WHERE a.p_partkey >= 1
UNION ALL SELECT a.p_partkey, b.p_partkey, 2 FROM {part} a JOIN {part} b ON b.p_partkey = 2 * a.p_partkey + 1 WHERE a.p_partkey >= 1
UNION ALL SELECT a.p_partkey, b.p_partkey, 3 FROM {part} a JOIN {part} b ON b.p_partkey = 3 * a.p_partkey WHERE a.p_partkey >= 2"""

VIEWS: dict[str, str] = {
    "bom_edges": f"SELECT {_code('p.parent')} AS parent, {_code('p.child')} AS child, CAST(1 + a.p_size % 5 AS BIGINT) AS qty FROM ({_PAIRS}) p JOIN {{part}} a ON a.p_partkey = p.parent",
    "bom_headers": f"""
SELECT 'B' || code || '-' || revision AS bom_id, bom_seq, code, revision, title FROM (
SELECT {_code('a.p_partkey')} AS code, 'A' AS revision, a.p_partkey * 10 AS bom_seq, a.p_name AS title FROM {{part}} a JOIN {{part}} b ON b.p_partkey = 2 * a.p_partkey WHERE a.p_partkey >= 1 AND a.p_partkey % 19 <> 0
UNION ALL SELECT {_code('a.p_partkey')}, 'B', a.p_partkey * 10 + 1, a.p_name FROM {{part}} a JOIN {{part}} b ON b.p_partkey = 2 * a.p_partkey WHERE a.p_partkey >= 1 AND a.p_size % 3 = 0
UNION ALL SELECT {_code('a.p_partkey')}, 'C1', a.p_partkey * 10 + 2, a.p_name FROM {{part}} a JOIN {{part}} b ON b.p_partkey = 2 * a.p_partkey WHERE a.p_partkey >= 1 AND a.p_size % 5 = 0) h""",
    "structure_revs": f"SELECT {_code('p_partkey')} AS code, CASE WHEN p_size % 4 = 0 THEN 'A' ELSE 'Z' END AS rev FROM {{part}} WHERE p_size % 4 = 0 OR p_size % 7 = 0",
    "pbs_rows": f"""
SELECT 'D1' AS doc_id, seq, level, code, rev, qty FROM (
SELECT CAST(0 AS BIGINT) AS seq, 0 AS level, 'E0000001' AS code, 'A' AS rev, CAST(1 AS DOUBLE) AS qty FROM {{region}} WHERE r_regionkey = 0
UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT) * 100000000, 1, {_code('r_regionkey + 2')}, 'B', CAST(1 AS DOUBLE) FROM {{region}}
UNION ALL SELECT CAST(n_regionkey + 1 AS BIGINT) * 100000000 + (n_nationkey + 1) * 1000000, 2, {_code('n_nationkey + 8')}, CASE WHEN n_nationkey % 3 = 0 THEN 'A' ELSE '' END, CAST(n_nationkey % 3 AS DOUBLE) FROM {{nation}}
UNION ALL SELECT CAST(n_regionkey + 1 AS BIGINT) * 100000000 + (n_nationkey + 1) * 1000000 + s_suppkey + 1, CASE WHEN s_suppkey % 7 = 0 THEN 4 ELSE 3 END, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE {_code('s_suppkey % 60 + 1')} END, CASE WHEN s_suppkey % 4 = 0 THEN 'C1' WHEN s_suppkey % 4 = 1 THEN 'A' ELSE '' END, CAST(s_suppkey % 4 AS DOUBLE) FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey) p""",
    "totals": f"SELECT {_code('l_partkey')} AS pn, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM {{lineitem}} WHERE l_partkey % 7 <> 0 GROUP BY l_partkey",
    "bom_totals": f"SELECT {_code('l_partkey')} AS pn, CAST(SUM(CASE WHEN l_orderkey % 50 = 0 AND l_partkey % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS qty FROM {{lineitem}} WHERE l_partkey % 5 <> 0 GROUP BY l_partkey",
    "units": f"SELECT {_code('p_partkey')} AS pn, CASE WHEN p_size % 9 = 0 THEN 'M' ELSE 'NR' END AS uom, p_size % 9 = 0 AS other FROM {{part}}",
    "raw_codes": """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' e' || lpad(CAST(p_partkey AS STRING), 7, '0') || ' 01 ' WHEN 1 THEN 'E' || lpad(CAST(p_partkey AS STRING), 7, '0') || '02'
WHEN 2 THEN 'ab/' || CAST(p_partkey AS STRING) || '_x' WHEN 3 THEN 'E' || lpad(CAST(p_partkey AS STRING), 7, '0') || '-03' ELSE CAST(p_partkey + 100000 AS STRING) || 'PRTL' END AS code,
CASE WHEN p_size % 4 = 0 THEN '07' ELSE '' END AS suffix FROM {part}""",
}

_UNITS = "CASE b.p_size % 4 WHEN 0 THEN 'pz' WHEN 1 THEN 'MT' WHEN 2 THEN '' ELSE 'KG' END"
_QTY = "CASE WHEN b.p_size % 10 = 0 THEN NULL WHEN b.p_size % 17 = 0 THEN 0 ELSE 1 + a.p_size % 5 + CASE WHEN h.revision = 'B' THEN 1 ELSE 0 END END"
VIEWS["bom_lines"] = f"""
SELECT bom_id, line_no, internal_code, description, qty, unit, CASE WHEN key % 13 = 0 THEN 'DOCUMENT_REF' WHEN qty IS NULL THEN 'UNKNOWN' ELSE 'MATERIAL' END AS kind, '' AS type, '' AS rev, manufacturer, manufacturer_code, seq FROM (
SELECT h.bom_id, p.slot AS line_no, {_code('p.child')} AS internal_code, b.p_name AS description, CAST({_QTY} AS DOUBLE) AS qty, {_UNITS} AS unit, p.child AS key, b.p_brand AS manufacturer, b.p_type AS manufacturer_code, h.bom_seq * 10 + p.slot AS seq
FROM ({VIEWS['bom_headers']}) h JOIN ({_PAIRS}) p ON h.code = {_code('p.parent')} JOIN {{part}} a ON a.p_partkey = p.parent JOIN {{part}} b ON b.p_partkey = p.child
UNION ALL SELECT h.bom_id, 4, 'E0000001', 'back', CAST(1 AS DOUBLE), 'NR', 1, '', '', h.bom_seq * 10 + 4 FROM ({VIEWS['bom_headers']}) h WHERE CAST(substr(h.code, 2) AS BIGINT) % 97 = 0) l"""  # fmt: skip
#: Revisions that lists of pages name for their children: most have one, and mostly one that exists.
VIEWS["page_revs"] = f"SELECT {_code('p_partkey')} AS code, CASE WHEN p_size % 6 = 0 THEN 'B' ELSE 'A' END AS rev FROM {{part}} WHERE p_partkey % 5 <> 0"
#: Lists that form a forest: every eleventh code is nobody's child, and nothing leads back to the top.
VIEWS["forest_lines"] = f"""
SELECT * FROM ({VIEWS['bom_lines']}) f WHERE CAST(substr(internal_code, 2) AS BIGINT) % 11 <> 0 AND line_no < 4"""
for _name in ("bom_edges", "pbs_rows"):
    VIEWS[_name] = VIEWS[_name].strip()


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a table; parts are joined by shuffles, as few columns of them are expected to be small however many there are."""
    sql = VIEWS[name]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **{t: read(t).hint("merge") if t == "part" else read(t) for t in tables_in(sql)})


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The views of lines and of headers; headers, which lines name twice, are worked out once, as a table."""
    headers = stored(view(spark, sf_dir, "bom_headers"), "bom-headers")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").hint("merge")
    sql = VIEWS["bom_lines"].replace(f"({VIEWS['bom_headers']})", "{headers}")
    return spark.sql(sql, part=part, headers=headers.hint("merge")), headers


def duck(name: str) -> str:
    """The view as a common table expression of DuckDB."""
    sql = VIEWS[name]
    return f"{name} AS ({sql.format(**{t: t for t in tables_in(sql)})})"


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(duck(n) for n in names)
