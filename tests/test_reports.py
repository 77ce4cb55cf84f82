from partloom.functions.keys import canonical_pn
from partloom.operators import explode as X
from partloom.operators import graph as G
from partloom.operators import reports as P
from partloom.sources import headers as H

HEADERS = "bom_id string, bom_seq long, code string, revision string"
LINES = "bom_id string, line_no int, internal_code string, description string, qty double, unit string, kind string, type string, rev string, seq long"


def line(bom, n, code, qty, kind="MATERIAL", description="", rev=""):
    return bom, n, code, description, qty, "NR", kind, "", rev, n


def test_page_policy(spark):
    headers = spark.createDataFrame([("1", 1, "R-A", "A"), ("2", 2, "B-A", "A")], HEADERS)
    lines = spark.createDataFrame([line("1", 1, "B", 2.0, rev="A"), line("2", 1, "C", None), line("2", 2, "D", 3.0), line("2", 3, "R", None, rev="A"), line("2", 4, "R", 1.0, rev="A")], LINES)
    keyed = headers.withColumn("code", canonical_pn(headers.code, headers.revision))
    e = X.explode(spark, lines, keyed, "R-A", "", None, X.Policy(explode_documents=True, explode_unknown=True, root_strict_rev=False, pdf=True))
    assert sorted((r.child_code, float(r.qty), r.state) for r in e.edges().collect()) == [("B-A", 2.0, "EDGE"), ("C", 0.0, "MISSING_QTY"), ("D", 6.0, "EDGE")]
    assert sorted(r.state for r in e.visited.collect()) == ["CYCLE", "CYCLE_WITHOUT_QTY", "EDGE", "EDGE", "MISSING_QTY"]
    assert sorted(r.code for r in e.totals().collect()) == ["B-A", "D", "R-A"]


def test_procedures_have_a_switch_of_their_own(spark):
    lines = spark.createDataFrame([line("1", 1, "A", 1.0, "UNKNOWN", "Procedura 7"), line("1", 2, "B", 1.0, "UNKNOWN"), line("1", 3, "C", 1.0), line("1", 4, "D", 1.0, "DOCUMENT_REF")], LINES)
    codes = lambda **k: [r.internal_code for r in X.eligible_lines(lines, X.Policy(**k)).orderBy("line_no").collect()]
    assert codes() == ["C"] and codes(explode_unknown=True) == ["B", "C"] and codes(explode_procedural=True) == ["A", "C"]
    assert codes(explode_documents=True, explode_unknown=True, explode_procedural=True) == ["A", "B", "C", "D"]


def test_traces_and_reasons(spark):
    headers = spark.createDataFrame([("1", 1, "A123456", "A"), ("2", 2, "A123456", "B"), ("3", 3, "X777777Y", "A")], HEADERS)
    wanted = spark.createDataFrame([("ROOT", "A123456", "A"), ("EXPLODE_CHILD", "A123456", "C"), ("EXPLODE_CHILD", "777777Z", ""), ("EXPLODE_CHILD", "Q", "")], "context string, code string, rev string")
    got = {(r.expected_code, r.expected_rev): (r.selected_rev, r.outcome, r.n_candidates, r.suspicious) for r in P.traces(wanted, headers).collect()}
    assert got == {("A123456", "A"): ("A", "OK", 2, []), ("A123456", "C"): ("B", "FALLBACK", 2, []), ("777777Z", ""): ("", "SUSPICIOUS_HEADER_MISMATCH", 0, ["X777777Y"]), ("Q", ""): ("", "MISSING_FILE", 0, [])}
    roots = spark.createDataFrame([("A123456", 3), ("Q", 1), ("777777Z", 0), ("NEW", 0)], "code string, impacted long")
    assert {r.code: r.reason for r in P.break_reasons(roots, P.traces(wanted, headers)).collect()} == {
        "A123456": "revision C asked, B taken", "Q": "no sub-bom resolved (missing file)", "777777Z": "alias mismatch", "NEW": "unknown",
    }
    assert [tuple(r) for r in P.rev_fallbacks(P.traces(wanted, headers)).collect()] == [("A123456", "C", "B")]


def test_cycles(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("D", "A"), ("C", "E"), ("F", "F"), ("G", "H"), ("H", "I")]
    got = P.graph_cycles(spark.createDataFrame(edges, "parent string, child string")).collect()
    assert sorted(r.path for r in got) == ["A > B > A", "A > B > C > A", "F > F"]
    assert P.graph_cycles(spark.createDataFrame([("A", "B")], "parent string, child string")).count() == 0


def test_reach_over_levels(spark):
    graph = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("X", "C")], "parent string, child string")
    got = G.reach(graph, spark.createDataFrame([("A",), ("X",)], "code string"))
    assert sorted((r.start, r.code) for r in got.collect()) == [(s, c) for s, c in (("A", "A"), ("A", "B"), ("A", "C"), ("X", "A"), ("X", "B"), ("X", "C"), ("X", "X"))]


def test_header_expressions(spark):
    texts = ["E0181296 01-06", "folder", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r.h) if r.h else None for r in df.select(H.folder_hint(df.t).alias("h")).collect()] == [("E0181296", "06"), None, None]
    roots = spark.createDataFrame([(t,) for t in ("e0029472 01-03", "E12-3 E45", "none", None)], "t string")
    assert [r.r for r in roots.select(H.root_code(roots.t).alias("r")).collect()] == ["E0029472", "E45", "", ""]
    names = spark.createDataFrame([(t,) for t in ("Q.t\u00e0", "Q.t\ufffd", "qt?!", "codice costruttore", "Manufacturer code name", "x", "")], "t string")
    assert [r.n for r in names.select(H.header_name(names.t).alias("n")).collect()] == ["qty", "qty", "qty", "manufacturer_code", "code", None, None]


def test_sheet_headers_fall_back_to_the_file_name(spark):
    cells = spark.createDataFrame([("1", 2, 3, "P / N : AB-1"), ("1", 5, 1, "Revision"), ("1", 5, 9, "C"), ("2", 1, 1, "part no"), ("2", 1, 10, "far"), ("2", 70, 1, "PN late")], "file_id string, row int, col int, value string")
    files = spark.createDataFrame([("1", "a.xls"), ("2", "LIST 1234567 REV D.xls"), ("3", "x.xls")], "file_id string, name string")
    got = {r.file_id: (r.code, r.code_source, r.code_cell, r.rev, r.rev_source, r.rev_cell) for r in H.sheet_headers(cells, files).collect()}
    assert got == {"1": ("AB-1", "sheet_inline", "C2", "C", "sheet_label_right", "I5"), "2": ("1234567", "filename_fallback", "", "D", "filename_fallback", ""), "3": ("", "missing_in_sheet", "", "", "missing_in_sheet", "")}


def test_close_matches_by_ratio(spark):
    pairs = spark.createDataFrame([("QRSTUVWXYZ", "QRSTUVWXYZA"), ("ABCD", "DCBA")], "a string, b string")
    assert [round(r.r, 4) for r in pairs.select(P.sequence_ratio("a", "b").alias("r")).collect()] == [0.9524, 0.25]


def test_only_parents_of_roots_are_gathered(spark, monkeypatch):
    tables, real = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: tables.append((name, real(df, name))) or tables[-1][1])
    headers = spark.createDataFrame([("b1", 1, "R", "B"), ("b2", 2, "R", "A"), ("b3", 3, "C", "A")], "bom_id string, bom_seq long, code string, revision string")
    edges = spark.createDataFrame([("R", "C"), ("X", "R"), ("W", "R"), ("X", "R"), ("C", "D")], "parent string, child string")
    got = P.root_candidates(spark.createDataFrame([("R",)], "code string"), edges, headers)
    assert sorted(tuple(r) for r in got.collect()) == [("R", "A", 2, "W;X", "A;B"), ("R", "B", 2, "W;X", "A;B")]
    assert {name: df.count() for name, df in tables} == {"wanted-roots": 1, "root-parents": 2, "root-revisions": 2}
