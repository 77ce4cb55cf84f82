import random
from collections import Counter, defaultdict

import pytest

from partloom.operators import explode as X
from partloom.operators import graph as G
from partloom.operators import resolve as R
from partloom.operators import tree as T

ROWS = "doc_id string, seq long, level int, code string, rev string, qty double"


def stack_parents(rows, blank):
    out, stack = {}, []
    for seq, level, code in rows:
        if blank == "skip" and not code:
            continue
        if blank == "reset" and not code:
            level = 0
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[seq] = stack[-1][0] if stack else None
        stack.append((seq, level))
    return out


def random_rows(seed, n=60):
    r = random.Random(seed)
    return [(i, r.randint(0, 5), "" if r.random() < 0.15 else f"C{r.randint(0, 12)}") for i in range(n)]


@pytest.mark.parametrize("blank", ["keep", "skip", "reset"])
def test_level_parents_like_a_stack(spark, blank):
    docs = {f"d{s}": random_rows(s) for s in range(8)}
    df = spark.createDataFrame([(d, i, lv, c, "", 1.0) for d, rows in docs.items() for i, lv, c in rows], ROWS)
    got = {(r.doc_id, r.seq): r.parent_seq for r in T.level_parents(df, blank).collect()}
    assert got == {(d, s): p for d, rows in docs.items() for s, p in stack_parents(rows, blank).items()}


def test_strict_parents_like_last_ids(spark):
    for s in range(4):
        rows, last, want = random_rows(s), {}, {}
        for i, lv, _ in rows:
            want[i] = last.get(lv - 1)
            last = {k: v for k, v in last.items() if k < lv} | {lv: i}
        df = spark.createDataFrame([("d", i, lv, c, "", 1.0) for i, lv, c in rows], ROWS)
        assert {r.seq: r.parent_seq for r in T.strict_parents(df).collect()} == want


def test_occurrences_multiply_down(spark):
    rows = [("d", 0, 0, "R", "", 1.0), ("d", 1, 1, "APRTL", "", 2.0), ("d", 2, 2, "B", "", 3.0), ("d", 3, 1, "B", "", 0.0), ("d", 4, 4, "C", "", 5.0)]
    got = {r.code: r.occurrences for r in T.occurrences(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"R": 1.0, "APRTL": 2.0, "A": 2.0, "B": 7.0, "C": 5.0}


HEADERS = "bom_id string, bom_seq long, code string, revision string"
LINES = "bom_id string, line_no int, internal_code string, qty double, unit string, kind string, type string, description string, rev string"


def test_resolution_table(spark):
    heads = [("b1", 1, "A", "A"), ("b2", 2, "A", "B"), ("b3", 3, "A", "B"), ("b4", 4, "S", ""), ("b5", 5, "123456X", "A")]
    h = spark.createDataFrame(heads, HEADERS)
    wanted = [("A", "A"), ("A", "B"), ("A", "Z"), ("A", ""), ("S", ""), ("S", "Q"), ("123456Y", "A"), ("NONE", ""), ("NONE", "A")]
    w = spark.createDataFrame(wanted, "code string, rev string")
    got = {(r.code, r.rev): (r.bom_id, r.outcome, r.rev_mismatch) for r in R.resolve(w, h).collect()}
    assert got == {
        ("A", "A"): ("b1", "OK", False), ("A", "B"): ("b2", "OK", False), ("A", "Z"): ("b2", "FALLBACK", True), ("A", ""): ("b2", "FALLBACK", False), ("S", ""): ("b4", "OK", False),
        ("S", "Q"): ("b4", "FALLBACK", True), ("123456Y", "A"): (None, "SUSPICIOUS_HEADER_MISMATCH", False), ("NONE", ""): (None, "MISSING_FILE", False), ("NONE", "A"): (None, "MISSING_FILE", False),
    }
    strict = {(r.code, r.rev): r.outcome for r in R.resolve(w, h, fallback=False).collect()}
    assert strict["A", "Z"] == "MISSING_FILE" and strict["A", ""] == "AMBIGUOUS" and strict["S", ""] == "OK"


def plain_explosion(lists, start):
    """lists: code -> [(line_no, child, qty)]; visited rows like the operator's."""
    out = []

    def walk(code, path, times, key):
        for n, child, qty in lists.get(code, []):
            k = (*key, n)
            if qty is None:
                out.append(("MISSING_QTY", (*path, child), None, k))
            elif qty <= 0:
                out.append(("NON_POSITIVE", (*path, child), times * qty, k))
            elif child in path:
                out.append(("CYCLE", (*path, child), times * qty, k))
            else:
                out.append(("EDGE", (*path, child), times * qty, k))
                walk(child, (*path, child), times * qty, k)

    walk(start, (start,), 1, ())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_explosion_against_recursion(spark, seed):
    r = random.Random(seed)
    lists = {f"P{i}": [(n, f"P{min(i + r.randint(1, 5), 14) if r.random() > 0.1 else r.randint(0, i)}", r.choice([None, 0.0, 1.0, 2.0, 3.0])) for n in range(1, r.randint(2, 4))] for i in range(10)}
    h = spark.createDataFrame([(f"b{c}", i, c, "A") for i, c in enumerate(lists)], HEADERS)
    lines = spark.createDataFrame([(f"b{c}", n, child, q, "PZ", "UNKNOWN" if q is None else "MATERIAL", "", "", "") for c, ls in lists.items() for n, child, q in ls], LINES)
    e = X.explode(spark, lines, h, "P0", "", None, X.Policy(explode_unknown=True))
    got = Counter((x.state, tuple(x.path), None if x.qty is None else float(x.qty), tuple(x.dfs_key)) for x in e.visited.collect())
    want = plain_explosion(lists, "P0")
    assert got == Counter(want)
    totals = defaultdict(float)
    for state, path, qty, _ in want:
        if state in ("EDGE", "CYCLE"):
            totals[path[-1]] += qty
    assert {x.code: float(x.qty) for x in e.totals().collect()} == dict(totals)
    summed = X.explode_sums(spark, lines, h, "P0", "", None, X.Policy(explode_unknown=True))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for mine, walked in ((summed.totals(), e.totals()), (summed.totals_by_rev(), e.totals_by_rev()), (summed.units(), e.units()), (summed.exploded(), e.exploded())):
        assert rows(mine) == rows(walked)


def test_a_million_paths_are_summed_by_level(spark):
    """20 levels of two lines each: 2^20 paths to the last code; and a part that leads back twice on the way."""
    h = spark.createDataFrame([(f"b{i}", i, f"L{i:02d}", "A") for i in range(20)] + [("bx", 30, "X", "A")], HEADERS)
    rows = [(f"b{i}", n, f"L{i + 1:02d}", 1.0, "M" if n == 2 and i == 19 else "", "MATERIAL", "", "", "") for i in range(20) for n in (1, 2)]
    rows += [("b3", 3, "X", 2.0, "PZ", "MATERIAL", "", "", ""), ("bx", 1, "L02", 3.0, "PZ", "MATERIAL", "", "", "")]
    summed = X.explode_sums(spark, spark.createDataFrame(rows, LINES), h, "L00", "", None, X.Policy())
    totals = {r.code: (int(r.qty), r.visits) for r in summed.totals().collect()}
    assert totals["L20"] == (2**20, 2**20) and totals["X"] == (2 * 2**3, 2**3) and totals["L02"] == (2**2 + 3 * 2 * 2**3, 2**2 + 2**3)
    assert {r.code: r.uom for r in summed.units().collect()} == {"L20": "M", "X": "NR", "L02": "NR"}
    assert {r.code for r in summed.exploded().collect()} == {f"L{i:02d}" for i in range(20)} | {"X"}


def test_pdf_keys_align_with_edges(spark):
    h = spark.createDataFrame([("b", 1, "ROOT0001", "01")], HEADERS)
    lines = spark.createDataFrame([("b", 1, "166104001-04", 2.0, "NR", "MATERIAL", "", "", "04")], LINES)
    e = X.explode(spark, lines, h, "ROOT0001", "", None, X.Policy(pdf=True, root_strict_rev=False))
    assert [r.code for r in e.totals().collect()] == [r.child_code for r in e.edges().collect()] == ["166104001-04"]


def test_totals_without_paths(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 3), ("b", "d", 5), ("c", "d", 7), ("d", "e", 1)], "parent string, child string, qty long")
    got = {r.code: (r.qty, r.visits, r.max_depth) for r in X.explode_totals(edges, spark.createDataFrame([("a",)], "code string")).collect()}
    assert got == {"b": (2, 1, 1), "c": (3, 1, 1), "d": (31, 2, 2), "e": (31, 2, 3)}


def test_part_master_takes_the_longest(spark):
    from pyspark.sql import functions as F

    from partloom.functions.keys import canonical_pn

    rows = [("E002947201", "01", "screw", "", "", 1), ("E0029472 01", "", "", "ACME", "", 2)]
    df = spark.createDataFrame(rows, "internal_code string, rev string, description string, manufacturer string, manufacturer_code string, seq long")
    got = G.part_master(df, canonical_pn(F.col("internal_code"), F.col("rev"))).collect()
    assert [(r.code, r.description, r.manufacturer) for r in got] == [("E0029472-01", "screw", "ACME")]


def test_ranking_prefers_folder_then_reach(spark):
    h = spark.createDataFrame([(f"b{c}", i, c, "") for i, c in enumerate(["R1", "R2", "X", "Y"])], HEADERS)
    g = spark.createDataFrame([("R1", "X"), ("R2", "X"), ("R2", "Y")], "parent string, child string")
    assert [r.code for r in G.rank_roots(g, h).orderBy("rank").collect()] == ["R2", "R1"]
    assert [r.code for r in G.rank_roots(g, h, "R1").orderBy("rank").collect()] == ["R1", "R2"]


def test_aliases_need_one_suffixed_header(spark):
    h = spark.createDataFrame([(c, i, c, "") for i, c in enumerate(["E0254438-01", "E0181296", "E1-01", "E1-02"])], HEADERS)
    assert [(r.base, r.full) for r in G.base_aliases(h).collect()] == [("E0254438", "E0254438-01")]
    g = spark.createDataFrame([("E0181296", "E0254438"), ("E0181296", "E1")], "parent string, child string")
    assert sorted(r.child for r in G.with_aliases(g, h).collect()) == ["E0254438-01", "E1"]
