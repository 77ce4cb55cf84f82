"""Tables of sheets: where they begin and end, what joins, what is passed over."""

from partloom import catalog_sources
from partloom.operators.reconcile import load_totalization
from partloom.sources import sheets as S

CELLS = "file_id string, row int, col int, value string"


def cells(spark, rows, file="f"):
    return spark.createDataFrame([(file, r, c, v) for r, values in rows for c, v in enumerate(values, 1) if v is not None], CELLS).repartition(3)


def test_a_component_sheet(spark):
    sheet = cells(spark, [
        (2, ["List", None, "x"]), (4, ["Pos.", "Internal  code", "Description", "Q.ty", "UM", "RefDes", "Value"]),
        (5, [None, None, "before any record"]), (6, ["10", "A1", "bolt", "1.234,5", "NR", "R1", "5k"]), (7, [None, "ignored", "long", "9", None, "R2"]),
        (8, ["Pos", "code", "Description"]), (9, ["x", "code", "notes", "qty", "unit"]), (38, ["20", None, "nut", "2", None, None]), (67, ["30", "C3", "washer", "-", "M"]), (98, ["40", "D4", "after the gap", "1", "NR"]),
    ])
    records, orphans = S.sheet_records(sheet)
    assert [(r.pos, r.internal_code, r.description, r.qty, r.um, r.refdes, r.val, r.notes) for r in records.orderBy("row").collect()] == [
        ("0010", "A1", "bolt long", 1234.5, "NR", "R1, R2", "5k", None), ("0020", "", "nut", 2.0, "", "", "", None), ("0030", "C3", "washer", None, "M", "", "", None),
    ]
    assert [r.row for r in orphans.collect()] == [5]
    assert S.sheet_records(sheet.limit(0))[0].count() == 0


def test_a_totals_sheet_ends_at_thirty_empty_rows_that_count(spark):
    rows = [("Totalizzazione ", r, c, v) for r, values in [
        (1, ["Internal code", "Q.ty"]), (2, ["A1", "2"]), (3, ["A1", "1,5"]), (4, ["B2", "=SUM(A1)"]), (5, ["77", "3"]), (6, ["C3", "0"]),
        (36, ["D4", "4"]), (37, ["hidden", "9"]), (68, ["E5", "5"]), (100, ["F6", "6"]),
    ] for c, v in enumerate(values, 1)] + [("Other", 2, 1, "X1"), ("Other", 2, 2, "1")]
    table = spark.createDataFrame([("f", *r) for r in rows], "file_id string, sheet string, row int, col int, value string")
    hidden = spark.createDataFrame([("f", 37), ("f", 50)], "file_id string, row int")
    loaded = lambda h: {r.pn: (float(r.qty), r.n_rows, r.samples) for r in load_totalization(S.totals_cells(table, h)).collect()}
    assert loaded(hidden) == {"A1": (3.5, 2, [2, 3]), "D4": (4.0, 1, [36]), "E5": (5.0, 1, [68])}
    assert loaded(None) == {"A1": (3.5, 2, [2, 3]), "D4": (4.0, 1, [36]), "HIDDEN": (9.0, 1, [37])}


def test_a_structure_is_read_by_merged_spans_where_plain_columns_give_nothing(spark):
    head = ["Rev.", "Description", None, None, "Qty", "Code"]
    merged = [(3, head), (4, ["A", None, "bolt  x", None, "2,5", None, " E1  01 "]), (5, [None, None, None, "nut", "x", None, None, "E2"]), (6, [None, None, None, None, "1", None, "E3"]), (32, ["B", None, "after the gap", None, "1", None, "E4"])]
    plain = [(1, ["Code", None, "Description", None, "Rev", "Qty"]), (2, ["E5", None, None, "screw", "A", "3"])]
    both = cells(spark, merged).unionByName(cells(spark, plain, "g"))
    spans = spark.createDataFrame([("f", 3, 3, 2, 4), ("f", 3, 3, 6, 8), ("f", 9, 12, 1, 9), ("g", 1, 1, 3, 3)], "file_id string, row0 int, row1 int, col0 int, col1 int")
    rows = [tuple(r) for r in S.structure_rows(both, spans).orderBy("doc_id", "seq").select("doc_id", "seq", "code", "description", "rev", "qty", "level").collect()]
    assert rows == [("f", 4, "E1 01", "bolt  x", "A", 2.5, 1), ("f", 5, "E2", "nut", "", 0.0, 2), ("f", 6, "E3", "", "", 1.0, 0), ("g", 2, "E5", "screw", "A", 3.0, 1)]
    assert S.structure_rows(both, spans.limit(0)).where("doc_id = 'f'").count() == 0


def test_a_structure_of_a_union_whose_parts_are_spread_alike(spark):
    """Joined by shuffles, marked rows and starts are spread alike; their union was held to have the partitions of one of them."""
    cells = catalog_sources._over(spark, "/root/testdata/sf0.001", catalog_sources._MERGED_CELLS, "part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert S._structure(cells, S.structure_blocks(cells)).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
