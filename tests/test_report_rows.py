from partloom.operators import report_rows as RR
from partloom.operators import similar as S
from partloom.operators import tree as T

HEADERS = "bom_id string, bom_seq long, code string, revision string"


def test_trace_rows_name_parents_lists_and_suspects(spark):
    headers = spark.createDataFrame([("l1", 1, "A", "01"), ("l2", 2, "A", "01"), ("l3", 3, "X123456", "B"), ("l4", 4, "Y123456", "C")], HEADERS)
    traced = spark.createDataFrame(
        [("ROOT", "A", "01", "A", "01", 2, [], "OK", "", ""), ("EXPLODE_CHILD", "Z123456", "", "", "", 0, ["X123456", "Y123456"], "SUSPICIOUS_HEADER_MISMATCH", "", "look")],
        "context string, expected_code string, expected_rev string, selected_code string, selected_rev string, n_candidates long, suspicious array<string>, outcome string, note string, suggestion string",
    )
    edges = spark.createDataFrame([("A", "01", "Z123456", ""), ("A", "01", "Z123456", ""), ("Q", "", "Z123456", "")], "parent_code string, parent_rev string, child_code string, child_rev string")
    got = sorted((r.expected_code, r.source_parent_code, r.selected_bom_id, r.suspicious) for r in RR.trace_rows(traced, edges, headers).collect())
    near = "X123456 rev B @ l3 | Y123456 rev C @ l4"
    assert got == [("A", "", "l1", ""), ("Z123456", "A", "", near), ("Z123456", "Q", "", near)]


def test_mismatch_rows(spark):
    rows = spark.createDataFrame(
        [("d", 0, 0, "R", "A", 1.0), ("d", 1, 1, "BOLT7", "", 1.0), ("d", 2, 1, "OLD9", "", 0.0), ("d", 3, 1, "9123456AAA", "", 1.0), ("d", 4, 1, "SAME", "", 1.0)],
        "doc_id string, seq long, level int, code string, rev string, qty double",
    )
    headers = spark.createDataFrame([("l1", 1, "R", "A")], HEADERS)
    lines = spark.createDataFrame(
        [("l1", 30, "BOLT8", "MATERIAL"), ("l1", 10, "BOLT8", "MATERIAL"), ("l1", 20, "ZZ9123456", "MATERIAL"), ("l1", 40, "SAME", "MATERIAL"), ("l1", 50, "OTHER", "MATERIAL")],
        "bom_id string, line_no int, internal_code string, kind string",
    )
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    got = RR.mismatch_rows(T.level_parents(rows, "skip"), headers, lines, codes("R"), codes()).collect()
    assert {(r.severity, r.category, r.structure_child, r.list_child, r.positions, r.suggestion) for r in got} == {
        ("ERROR", "CHILD_MISSING_IN_BOM", "BOLT7", "", "", "the list has BOLT8, edits: 1"),
        ("WARN", "CHILD_MISSING_IN_BOM_OPTIONAL", "OLD9", "", "", ""),
        ("ERROR", "CHILD_MISSING_IN_BOM", "9123456AAA", "", "", ""),
        ("ERROR", "TYPO_SUSPECT_CHILD_MISMATCH", "", "BOLT8", "10;30", "write BOLT7, edits: 1"),
        ("ERROR", "TYPO_SUSPECT_CHILD_MISMATCH", "", "ZZ9123456", "20", "may be 9123456AAA, digits alike: 7"),
    }
    assert {(r.parent, r.parent_rev, r.parent_seq, r.bom_id, r.place) for r in got} == {("R", "A", 0, "l1", "ROOT")}


def test_nearest_children_of_a_parent(spark):
    left = spark.createDataFrame([("p", "1234567"), ("p", "AB"), ("q", "AB"), ("p", "ABCD")], "parent string, code string")
    right = spark.createDataFrame([("p", "X123456"), ("p", "12345699"), ("p", "AC"), ("p", "AAB"), ("q", "")], "parent string, other string")
    got = {(r.parent, r.code, r.other, r.distance, r.digits) for r in S.nearest_children(left, right).collect()}
    assert got == {("p", "1234567", "12345699", None, 6), ("p", "AB", "AAB", 1, None)}


def test_diagnosis_and_break_rows(spark):
    diagnosis = spark.createDataFrame([("A", "r", "P", "q", "10"), ("B", "", "", "", ""), ("C", "", "", "", "")], "code string, rev string, parent string, parent_rev string, pos string")
    classes = spark.createDataFrame([("A", "ROOT", "A", 0), ("B", "CASCADE", "A", 2)], "code string, kind string, root string, depth int")
    got = sorted((r.code, r.classification, r.root_chain_break, r.cascade_depth, r.not_reached_by_root) for r in RR.diagnosis_rows(diagnosis, classes).collect())
    assert got == [("A", "ROOT", "1", "0", ""), ("B", "CASCADE", "0", "2", "A"), ("C", "", "", "", "")]
    reasons = spark.createDataFrame([("A", 1, "unknown", "s"), ("N", 0, "unknown", "s")], "code string, impacted long, reason string, suggestion string")
    effective = spark.createDataFrame([("A", 3, 5)], "code string, most long, total long")
    assert sorted(tuple(r) for r in RR.break_rows(reasons, diagnosis, effective).collect()) == [("A", "r", "P", "q", "10", 3, 1, "unknown", "s"), ("N", "", "", "", "", 0, 0, "unknown", "s")]


def test_a_report_explodes_once(spark, monkeypatch):
    """Every explosion is a walk through all lists; what a report derives from one is derived from the same tables."""
    from partloom import catalog_reports
    from partloom.operators import explode as X

    calls, real = [], X.explode

    def once(*args, **options):
        calls.append(calls[0] if calls else real(*args, **options))
        return calls[0]

    monkeypatch.setattr(X, "explode", once)
    for name in ("chain_break_rows", "top_chain_breaks", "resolution_trace_rows", "unexploded_diagnosis_rows"):
        del calls[1:]
        before = len(calls)
        catalog_reports.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) - before == 1, name


def test_a_root_is_resolved_from_its_own_lists(spark):
    from partloom.operators import explode as X

    headers = spark.createDataFrame([("b1", 1, "R", "A"), ("b2", 2, "R", "B"), ("b3", 3, "S", "C")], "bom_id string, bom_seq long, code string, revision string")
    start = lambda rev, strict: [r.bom_id for r in X._start(spark, headers, "r", rev, X.Policy(root_strict_rev=strict)).collect()]
    assert (start("A", True), start("Z", True), start("Z", False), start("", True)) == (["b1"], [None], ["b2"], ["b2"])
