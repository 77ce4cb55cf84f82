"""Report tables and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm
from .tree import strict_parents


def export_lines(rows: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with external_id, parent_seq and parent_external_id of the import file, and code|rev keys."""
    p = strict_parents(rows)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    named = p.withColumn("external_id", F.format_string(f"{prefix}__line__%06d", number))
    up = named.select("doc_id", F.col("seq").alias("parent_seq"), F.col("external_id").alias("parent_external_id"))
    return named.join(up, ["doc_id", "parent_seq"], "left").withColumn("key", F.concat_ws("|", norm(F.col("code")), norm(F.col("rev"))))


def check_export(lines: DataFrame) -> DataFrame:
    """level, check, n: findings about an export (external_id, parent_external_id, code)."""
    ids = lines.groupBy("external_id").agg(F.count("*").alias("n"))
    doubled = ids.where("n > 1").agg(F.count("*").alias("n"))
    parents = lines.where("parent_external_id is not null").select(F.col("parent_external_id").alias("external_id"))
    lost = parents.join(ids, "external_id", "left_anti").agg(F.count("*").alias("n"))
    empty = lines.where("coalesce(external_id, '') = ''").agg(F.count("*").alias("n"))
    none = lines.agg((F.count("*") == 0).cast("bigint").alias("n"))
    tag = lambda df, level, check: df.select(F.lit(level).alias("level"), F.lit(check).alias("check"), "n")
    found = tag(doubled, "ERROR", "DUPLICATE_ID").unionByName(tag(lost, "ERROR", "UNKNOWN_PARENT")).unionByName(tag(empty, "ERROR", "EMPTY_ID")).unionByName(tag(none, "ERROR", "NO_LINES"))
    return found


def tree_text(rows: DataFrame) -> DataFrame:
    """doc_id, seq, line: the structure as text, two spaces for each level below the top."""
    top = F.min("level").over(Window.partitionBy("doc_id"))
    return rows.select("doc_id", "seq", F.concat(F.repeat(F.lit("  "), F.col("level") - top), F.trim(F.concat_ws(" ", "code", F.when(F.col("rev") != "", F.concat(F.lit("REV "), F.col("rev")))))).alias("line"))


def edge_text(edges: DataFrame) -> DataFrame:
    """dfs_key, line: explosion edges in path order, indented by depth."""
    return edges.select("dfs_key", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("child_code"), F.lit(" x "), F.col("qty").cast("string")).alias("line")).orderBy("dfs_key")


def write_csv(df: DataFrame, folder: str, order: list[str]) -> None:
    """One sorted CSV report with a header; reports are for people, so they are one file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(folder, header=True)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
