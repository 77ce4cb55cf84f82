"""Discovery of project files: metadata only, contents stay unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that discovery passes over.
SKIPPED = (".git", ".svn", "__pycache__", "node_modules", "_diagnostics", "_odoo_export")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modification_time, length of all files below ``folder``; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modification_time"), "length")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def classify(files: DataFrame, base: str = "", depth: int = 4) -> DataFrame:
    """path, kind (PBS, BOM_EXCEL, BOM_PDF) of the files that a project's folder layout allows."""
    relative = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    folders = F.slice(F.split(F.ltrim(relative, F.lit("/")), "/"), F.lit(1), F.greatest(F.size(F.split(F.ltrim(relative, F.lit("/")), "/")) - 1, F.lit(0)))
    name = F.upper(base_name(F.col("path")))
    excel, pdf = F.rlike(name, F.lit(r"\.XLS[XM]?$")), F.endswith(name, F.lit(".PDF"))
    kind = F.when(excel & F.contains(name, F.lit("PBS")), "PBS").when(excel & F.rlike(name, F.lit("PRT LIST|PART LIST")), "BOM_EXCEL").when(pdf & F.contains(name, F.lit("BOM")), "BOM_PDF")
    fine = (F.size(folders) <= depth) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED])) & ~F.startswith(name, F.lit("~$"))
    return files.where(fine).withColumn("kind", kind).where("kind is not null").select("path", "kind")


def mode(files: DataFrame) -> DataFrame:
    """One row: mode PBS_EXCEL or PDF_ONLY."""
    name = F.upper(base_name(F.col("path")))
    excel = F.rlike(name, F.lit(r"\.XLS[XM]?$"))
    a = files.agg(F.max((excel & F.rlike(name, F.lit("PARTL|PBS|MDP"))).cast("int")).alias("m"), F.max(excel.cast("int")).alias("x"), F.max(F.endswith(name, F.lit(".PDF")).cast("int")).alias("p"))
    return a.select(F.when(F.col("m") == 1, "PBS_EXCEL").when((F.col("p") == 1) & (F.col("x") == 0), "PDF_ONLY").otherwise("PBS_EXCEL").alias("mode"))


def choose_structure(files: DataFrame) -> DataFrame:
    """path, rank_ties: the structure file of highest revision, number before letters, then of latest time."""
    name = F.upper(base_name(F.col("path")))
    rev = F.regexp_extract(name, r"(?:^|[^A-Z0-9])REV[\s_\-.]*([A-Z]|[0-9]{1,3})(?:[^A-Z0-9]|$)", 1)
    number, letter = F.coalesce(rev.try_cast("int"), F.lit(-1)), F.when(F.rlike(rev, F.lit("^[A-Z]$")), F.ascii(rev) - 64).otherwise(-1)
    ranked = files.select("path", F.struct(number.alias("number"), letter.alias("letter"), "modification_time").alias("rank"))
    best = ranked.agg(F.max("rank").alias("best"))  # one row
    return ranked.join(F.broadcast(best), F.col("rank") == F.col("best")).groupBy("rank").agg(F.count("*").alias("rank_ties"), F.collect_list("path").alias("paths")).select(F.explode("paths").alias("path"), "rank_ties")
