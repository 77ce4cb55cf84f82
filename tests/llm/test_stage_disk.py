"""What the pipeline's stages leave on disk and move: tables on the way to a decision go, texts stay where they are."""

import os

import pytest
from cases import frame
from pyspark.sql import functions as F

import corpus_pipeline as P
from partloom.llm.store import told
from partloom.plans.tables import fresh_path


def left(spark) -> set[str]:
    folder = fresh_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize(
    "stage, kinds",
    [
        (P.keep_good, {"common-words", "references"}),
        (P.drop_near_duplicates, {"numbered", "kept"}),
        (P.remove_personal_data, {"numbered", "sanitise-spans"}),
        (P.mix_sources, {"numbered", "copies"}),
    ],
)
def test_tables_of_a_stage_go_and_texts_stay(spark, stage, kinds):
    before = left(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stage(spark, frame(spark), "")
        assert {x.rsplit("-", 1)[0] for x in left(spark) - before} == kinds
        plan = got._jdf.queryExecution().executedPlan().toString()
        if stage in (P.drop_near_duplicates, P.mix_sources):
            assert "SortMergeJoin" not in plan
        got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [1, 2])
def test_numbers_find_their_rows(spark, bits):
    rows = spark.range(0, 5000, 1, 5).select((F.col("id") + F.spark_partition_id().cast("long") * (1 << 33)).alias("row"), F.col("id").alias("doc"))
    n = F.pmod(F.xxhash64("doc"), F.lit(1 << bits))
    got = told(rows, rows.select("row", n.alias("n")).where("n > 0"), "n", bits)
    assert got.columns == ["row", "doc", "n"]
    assert (got.count(), got.where(F.col("n") != n).count(), got.select("n").distinct().count()) == (5000, 0, 1 << bits)
