"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the result
is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Decisions are made for each row: rows are numbered as they come in (or,
in the quality rules, judged where they are), so null and repeated ids keep or lose no other row, and
columns may have any name.  Empty tables pass through every stage.  Tables on the way to a stage's decisions
are deleted once these are stored, and small decisions go to the rows packed into bits, so texts stay put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import mixing, near_dups, packing, privacy, quality
from partloom.llm.store import decided, fresh_dir, numbered, told


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null texts and such of few words go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, one of least doc_id."""
    return near_dups.keep_first(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that reveal it replaced by labels."""
    return privacy.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 2 times); texts without words go."""
    rows = numbered(docs)
    sized = rows.select("row", "doc.doc_id", "doc.source", "doc.text")
    taken = decided(lambda: mixing.mix(sized, carry=["row"]).where(F.col("copies") > 0).select("row", "copies"), "copies")
    repeated = told(rows, taken, "copies", bits=2).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Near-duplicate classes, random rounding and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
