from partloom.adapters import view
from partloom.plans import pipelines as P
from partloom.operators.explode import Policy
from partloom.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def test_structure_analysis(spark):
    v = lambda n: view(spark, SMALL, n)
    cells = v("totals").selectExpr("1 as sheet_row", "pn as code", "cast(qty as string) as qty")
    a = P.analyse_structure(spark, v("pbs_rows"), v("bom_headers"), v("bom_lines"), cells, Policy(explode_unknown=True, root_strict_rev=False))
    counts = {k: t.count() for k, t in a.tables.items()}
    assert counts["edges"] and counts["validation"] and counts["tree"] == v("pbs_rows").count()
    assert isinstance(a.has_errors(), bool)


def test_structure_without_root(spark):
    rows = spark.createDataFrame([], "doc_id string, seq long, level int, code string, rev string, qty double")
    a = P.analyse_structure(spark, rows, view(spark, SMALL, "bom_headers"), view(spark, SMALL, "bom_lines"))
    assert a.has_errors() and a.explosion is None


def test_lists_analysis(spark):
    lines = view(spark, SMALL, "bom_lines").where("line_no < 4")
    a = P.analyse_lists(spark, view(spark, SMALL, "bom_headers"), lines)
    assert a.tables["ranking"].count() and a.tables["edges"].count()


def test_streamed_quantities(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01 10:00:00", "a ", "1,5"), ("2024-01-01 11:00:00", "A", "2"), ("2024-01-09 11:00:00", "B", "1")], "arrived string, internal_code string, qty string").selectExpr("cast(arrived as timestamp) as arrived", "internal_code", "qty")
    lines.write.parquet(f"{tmp_path}/in")
    stream = ingest.quantities_by_code(ingest.arriving_lines(spark, f"{tmp_path}/in", lines.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.code, r.qty, r.lines) for r in got] == [("A", 3.5, 2)]
