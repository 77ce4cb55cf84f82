import random

from pyspark.sql import functions as F

from partloom.operators import reconcile as C
from partloom.operators import tree as T
from partloom.operators import views as V
from partloom.operators.sinks import check_export, export_lines, tree_text
from partloom.sources import files as S
from partloom.sources import grids as I

ROWS = "doc_id string, seq long, level int, code string, rev string, qty double"


def test_totals_status_table(spark):
    bom = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 0.0), ("D", 3.0), ("E", 3.00005)], "pn string, qty double")
    total = spark.createDataFrame([("B", 2.0), ("D", 4.0), ("E", 3.0), ("F", 1.0)], "pn string, qty double")
    units = spark.createDataFrame([("D", "M", True)], "pn string, uom string, other boolean")
    got = {r.pn: (r.status, r.uom) for r in C.validate_totals(bom, total, units).collect()}
    assert got == {"A": ("ERROR_MISSING_IN_TOTAL", ""), "B": ("OK", ""), "C": ("OK", ""), "D": ("SKIPPED_NON_NR", "M"), "E": ("OK", ""), "F": ("ERROR_EXTRA_IN_TOTAL", "")}


def test_totalization_rows(spark):
    cells = spark.createDataFrame([(i, c, q) for i, (c, q) in enumerate([(" a1", "2"), ("A1 ", "1,5"), ("77", "1"), ("B", "=2"), ("C", "0"), ("D", None)])], "sheet_row int, code string, qty string")
    assert [(r.pn, float(r.qty), r.n_rows, r.samples) for r in C.load_totalization(cells).collect()] == [("A1", 3.5, 2, [0, 1])]


def test_typo_and_chain_breaks(spark):
    d = spark.createDataFrame([("P", "ABC1", "MISSING_IN_BOM"), ("P", "ABC2", "EXTRA_IN_BOM"), ("P", "999999123X", "MISSING_IN_BOM"), ("P", "YY999999877", "EXTRA_IN_BOM")], "parent string, child string, side string")
    assert sorted((r.missing, r.extra, r.distance) for r in C.typo_suspects(d).collect()) == [("999999123X", "YY999999877", 2), ("ABC1", "ABC2", 1)]
    rows = spark.createDataFrame([("d", 0, 0, "R", "", 1.0), ("d", 1, 1, "A", "", 1.0), ("d", 2, 2, "B", "", 1.0), ("d", 3, 3, "C", "", 1.0), ("d", 4, 1, "E", "", 1.0)], ROWS)
    one = lambda *codes: spark.createDataFrame([(c,) for c in codes], "code string")
    roots, classes = C.chain_breaks(T.level_parents(rows), T.effective_children(rows), one("A", "E"), one("R"))
    assert [(r.code, r.impacted) for r in roots.collect()] == [("A", 2)]
    assert sorted((r.code, r.kind, r.root, r.depth) for r in classes.collect()) == [("A", "ROOT", "A", 0), ("B", "CASCADE", "A", 1), ("C", "CASCADE", "A", 2)]


def test_diagnosis_precedence(spark):
    codes = spark.createDataFrame([(c,) for c in ("ZERO", "HIT", "BREAK", "DONE", "123456A", "ABCDEFGHX", "QRSTUVWXYZ", "ALONE")], "code string")
    effective = spark.createDataFrame([(c, 1) for c in ("HIT", "BREAK", "DONE", "123456A", "ABCDEFGHX", "QRSTUVWXYZ", "ALONE")], "code string, total long")
    places = [("BREAK", "DONE", 1), ("BREAK", "P", 2), ("HIT", "P", 3), ("DONE", "P", 4), ("123456B", "P", 5), ("ABCDEFGHY", "P", 6), ("QRSTUVWXYZA", "P", 7)]
    occurring = spark.createDataFrame([(c, p, "A", n * 10, n) for c, p, n in places], "code string, parent string, parent_rev string, pos int, seq long")
    one = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    revs = spark.createDataFrame([("HIT", "B")], "code string, rev string")
    traced = spark.createDataFrame([("EXPLODE_CHILD", "HIT", "B", "C", "FALLBACK")], "context string, expected_code string, expected_rev string, selected_rev string, outcome string")
    rows = C.diagnose_unexploded(codes, effective, one("HIT", "DONE"), occurring, one("DONE"), revs, traced, one("HIT")).collect()
    got = {r.code: (r.reason, r.candidate, r.parent, r.pos) for r in rows}
    assert got == {
        "ZERO": ("INFO_PBS_ONLY_ZERO_QTY_CHILDREN", "ZERO", "", ""), "HIT": ("REACHED_SELECTION_FAIL", "HIT", "P", "30"), "BREAK": ("NOT_REACHED_CHAIN_BREAK", "BREAK", "P", "20"),
        "DONE": ("REV_LOOKUP_FAIL", "DONE", "P", "40"), "123456A": ("CODE_VARIANT", "123456B", "P", "50"), "ABCDEFGHX": ("LIKELY_TYPO", "ABCDEFGHY", "P", "60"),
        "QRSTUVWXYZ": ("LIKELY_TYPO", "QRSTUVWXYZA", "P", "70"), "ALONE": ("MISSING_LINK", "", "", ""),
    }
    notes = {r.code: (r.rev, r.note) for r in rows}
    assert notes["HIT"] == ("B", "a list exists, none can be chosen; revision B asked, C taken; fallback")
    assert notes["BREAK"][1] == "under P, which is not exploded" and notes["ABCDEFGHX"][1] == "1 letters differ, ratio 0.89"


def test_inference_table(spark):
    pair = "parent string, child string, unit string"
    missing = spark.createDataFrame([("P", "A", "NR"), ("P", "B", ""), ("Q", "B", ""), ("P", "C", "M"), ("P", "D", ""), ("P", "D", ""), ("P", "E", "NR")], pair)
    totals = spark.createDataFrame([("A", 6.0), ("B", 1.0), ("D", 1.0), ("E", 5.0)], "code string, qty double")
    occ = spark.createDataFrame([("P", 2.0)], "code string, occurrences double")
    got = {(r.parent, r.child): (r.value, r.status, r.confidence) for r in C.infer_quantities(missing, spark.createDataFrame([], pair), totals, occ).collect()}
    assert got["P", "A"] == (3.0, "INFERRED", 0.9) and got["P", "E"] == (2.5, "CHECK", 0.4)
    assert got["P", "B"][1] == got["P", "D"][1] == "AMBIGUOUS" and got["P", "C"] == (None, "NOT_CALCULABLE", 0.0)


def test_inference_cascade(spark):
    pair = "parent string, child string, unit string"
    missing = spark.createDataFrame([("S", "A", "NR"), ("T", "B", "NR"), ("C", "D", "NR"), ("R", "E", "NR"), ("N", "F", "NR")], pair)
    totals = spark.createDataFrame([(c, 12.0) for c in "ABDEF"], "code string, qty double")
    table = lambda column, *rows: spark.createDataFrame(rows, f"code string, {column} double")
    got = C.infer_quantities(missing, spark.createDataFrame([], pair), totals, table("occurrences", ("S", 2.0)), table("occurrences", ("S", 4.0), ("T", 3.0)), table("qty", ("T", 6.0), ("C", 4.0)), "R").collect()
    assert {r.parent: (r.occurrences, r.value) for r in got} == {"S": (2.0, 6.0), "T": (3.0, 4.0), "C": (4.0, 3.0), "R": (1.0, 12.0), "N": (None, None)}


def test_totals_are_summed_by_plain_part_number(spark):
    bom = spark.createDataFrame([("a-1", 1.0), ("A1 ", 2.0)], "pn string, qty double")
    total = spark.createDataFrame([("A 1", 3.0)], "pn string, qty double")
    got = C.validate_totals(bom, total, spark.createDataFrame([], "pn string, uom string, other boolean")).collect()
    assert [(r.pn, r.qty_bom, r.qty_total, r.status) for r in got] == [("A1", 3.0, 3.0, "OK")]


def test_misaligned_quantities_look_at_the_first_lines(spark):
    rows = [("f", i, "01" if i < 3 else "x", "1" if i < 2 else "01", "NR") for i in range(500)] + [("f", 500 + i, "7", "7", "") for i in range(50)]
    got = I.misaligned_quantities(spark.createDataFrame(rows, "file_id string, row int, qty_text string, rev string, um string")).first()
    assert (got.checked, got.suspect, got.misaligned) == (3, 1, False)  # 01 is not 1, and line 501 is not looked at


def test_export_and_text(spark):
    rows = spark.createDataFrame([("d", 0, 0, "R", "A", 1.0), ("d", 1, 1, "A", "", 1.0), ("d", 2, 3, "B", "", 1.0)], ROWS)
    lines = export_lines(rows, "X")
    assert {r.code: r.parent_external_id for r in lines.collect()} == {"R": None, "A": "X__line__000001", "B": None}
    assert all(r.n == 0 for r in check_export(lines).collect())
    bad = {r.check: r.n for r in check_export(lines.unionByName(lines)).collect()}
    assert bad["DUPLICATE_ID"] == 3
    assert [r.line for r in tree_text(rows).orderBy("seq").collect()] == ["R REV A", "  A", "      B"]


def test_grids(spark):
    cells = spark.createDataFrame([("f", 1, 1, "title"), ("f", 3, 1, "pos"), ("f", 3, 2, "Description"), ("f", 3, 4, "q.ty"), ("f", 5, 2, "rev")], "file_id string, row int, col int, value string")
    names = I.alias_table(spark)
    head = I.header_rows(cells, names, ["pos", "description", "qty"])
    assert [(r.row, r.score) for r in head.collect()] == [(3, 3)]
    assert {r.column: r.col for r in I.column_map(cells, names, head).collect()} == {"pos": 1, "description": 2, "qty": 4}
    rows = spark.createDataFrame([("f", 1, "x", "lost"), ("f", 2, "0001", "a"), ("f", 3, "", "b"), ("f", 4, "0002", "c")], "file_id string, row int, pos string, text string")
    from pyspark.sql import functions as F

    got = I.assembled_records(rows, F.rlike("pos", F.lit("^[0-9]+$")), {"pos": "", "text": " "})
    assert sorted((r.pos, r.text) for r in got.collect()) == [("0001", "a b"), ("0002", "c")]
    cell = spark.createDataFrame([("f", 1, "1\n2", "x\nnull\ny\nz", "n")], "file_id string, row int, pos string, notes string, um string")
    assert sorted((r.part, r.pos, r.notes, r.um) for r in I.expanded_cells(cell, ["pos", "notes", "um"], ["notes"]).collect()) == [(1, "1", "x", "n"), (2, "2", "y z", "")]
    text = spark.createDataFrame([("f", i, t) for i, t in enumerate(["0010 A", "more", "0020 B"])], "file_id string, line_no int, text string")
    assert sorted(r.text for r in I.line_records(text).collect()) == ["0010 A more", "0020 B"]


def test_parser_choice(spark):
    rows = spark.createDataFrame([("f", "tables", "A", 1.0), ("f", "grid", "A", 1.0), ("f", "grid", "B", 1.0), ("f", "grid", "C", 1.0)], "file_id string, parser string, internal_code string, qty double")
    assert [r.parser for r in I.chosen_parser(I.parser_scores(rows), ["tables", "grid"]).collect()] == ["grid"]
    got = I.parser_overlap(rows.where("parser = 'tables'"), rows.where("parser = 'grid'")).first()
    assert (got.shared, got.share_a, round(got.share_b, 3)) == (1, 1.0, 0.333)


def test_files(spark, tmp_path):
    for name in ("PBS REV A.xlsx", "PBS_REV B.xlsx", "PRT LIST 1.xls", "~$PBS.xlsx", "node_modules/BOM 2.pdf", "a/b/BOM 1.pdf", "a/b/c/d/e/BOM 3.pdf"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    files = S.list_files(spark, str(tmp_path))
    base = f"file:{tmp_path}"
    kinds = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.kind for r in S.classify(files, base).collect()}
    assert kinds == {"PBS REV A.xlsx": "PBS", "PBS_REV B.xlsx": "PBS", "PRT LIST 1.xls": "BOM_EXCEL", "BOM 1.pdf": "BOM_PDF"}
    assert "PBS_REV" in S.choose_structure(files.where("path like '%PBS%' and path not like '%~%'")).first().path


def test_targets_and_headers(spark):
    files = spark.createDataFrame([("/f/1", "231005117 REV A.pdf"), ("/f/2", "99.pdf")], "path string, name string")
    targets = spark.createDataFrame([("231005117PRTL", "A"), ("2310059PRTL", "")], "target string, rev string")
    assert [(r.path, r.target, r.match_len, r.strength) for r in V.match_targets(files, targets).collect()] == [("/f/1", "231005117PRTL", 9, "STRONG")]
    heads = spark.createDataFrame([("a", "2310051171A01", "A"), ("b", "231005117", ""), ("c", "231005117", "B"), ("d", "55", "A")], "bom_id string, code string, revision string")
    got = {r.bom_id: r.reason for r in V.verify_headers(heads, targets.where("rev = 'A'")).collect()}
    assert got == {"a": "MATCH", "b": "REV_MISSING", "c": "REV_MISMATCH", "d": "NO_NUMERIC_MATCH"}


def test_clusters_of_values_by_ranges_equal_one_sorted_walk(spark):
    """Like values meet in one row, ranges end anywhere, and nulls, infinities and values that are no number count as sorted."""
    r = random.Random(5)
    nan, inf = float("nan"), float("inf")
    rows = [(f, x) for f in ("a", "b", None) for x in [None, None, nan, nan, nan, inf, inf, -inf] + [float(r.randint(0, 900)) for _ in range(300)]]
    rows += [("c", nan), ("c", nan), ("d", None), ("d", nan), ("d", nan), ("e", 1.0)]
    values = spark.createDataFrame(rows, "file_id string, x double")
    for tolerance in (2.0, 0.0, 50.0):
        # the cluster of every row, and how many rows of one value are in it
        whole = I.clusters(values, "x", tolerance, ["file_id"]).groupBy("file_id", "x", "cluster").agg(F.count("*").alias("n"))
        parts = I.cluster_values(values, "x", tolerance, ["file_id"])
        key = lambda t: tuple(str(v) for v in t)
        assert sorted(map(key, whole.select("file_id", "x", "n", "cluster").collect())) == sorted(map(key, parts.collect()))
    windows = [line for line in parts._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in line and "lag(x" in line]
    assert windows and all("__range" in line for line in windows)  # no file is sorted in one task
