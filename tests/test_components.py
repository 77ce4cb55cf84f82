"""Strongly connected parts and cycles against plain search."""

import random
from collections import defaultdict

from partloom.operators import components as C


def graph(spark, edges):
    return spark.createDataFrame(list(edges), "parent string, child string").repartition(3)


def plain(edges):
    """Parts by mutual reach, and for each edge into a part's least code a shortest way, least of equals."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    codes = {x for e in edges for x in e}
    reach = {}
    for a in codes:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[a] = seen
    heads = {a: min(b for b in reach[a] if a in reach[b]) for a in codes if a in reach[a]}
    found = {(a, (a, a)) for a in codes if a in out[a]}
    for head in set(heads.values()):
        best, level = {head: (head,)}, {head: (head,)}
        while level:
            step = {}
            for a in sorted(level, key=lambda x: level[x]):
                for b in out[a]:
                    if heads.get(b) == head and b not in best and (b not in step or (*level[a], b) < step[b]):
                        step[b] = (*level[a], b)
            best |= step
            level = step
        found |= {(head, (*way, head)) for a, way in best.items() if a != head and head in out[a]}
    return heads, found


def check(spark, edges):
    heads, found = plain(edges)
    g = graph(spark, edges)
    assert {r.code: r.head for r in C.strong_components(g).collect()} == heads
    rows = C.cycle_witnesses(g).collect()
    assert {(r.head, tuple(r.path)) for r in rows} == found and len(rows) == len(found) and all(r.length == len(r.path) - 1 for r in rows)


def test_a_ring_of_forty_codes(spark):
    check(spark, {(f"C{i:02d}", f"C{(i + 1) % 40:02d}") for i in range(40)} | {("X", "C05"), ("C07", "Y")})


def test_random_graphs_loops_and_none(spark):
    r = random.Random(8)
    check(spark, {(f"n{r.randint(0, 25):02d}", f"n{r.randint(0, 25):02d}") for _ in range(34)} | {("a", "a"), ("b", "c"), ("c", "b"), ("c", "c"), ("z", "a")})
    assert C.cycle_witnesses(graph(spark, {("a", "b"), ("b", "c")})).count() == 0
    assert C.strong_components(graph(spark, {("a", "b")}).limit(0)).count() == 0


def test_reach_counts_equal_plain_reach(spark):
    from partloom.operators import graph as G

    r = random.Random(3)
    edges = {(f"N{r.randint(0, 40):02d}", f"N{r.randint(0, 40):02d}") for _ in range(60)}
    headers = [(f"b{i}", i, f"N{i:02d}", "A") for i in range(0, 41, 2)] + [("x", 99, "ALONE", "A")]
    own = {h[2] for h in headers}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    want = {}
    for start in [*own, "N01", "NOTHING"]:
        seen, todo = {start}, [start]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        want[start] = len(seen & own)
    g, h = graph(spark, edges), spark.createDataFrame(headers, "bom_id string, bom_seq long, code string, revision string")
    got = G.reach_counts(g, h, spark.createDataFrame([(c,) for c in want], "code string"))
    assert {x.code: x.reachable for x in got.collect()} == want


def test_ranks_by_ranges(spark):
    from pyspark.sql import functions as F

    from partloom.plans.tables import ranked

    values = [random.Random(5).randint(0, 50) for _ in range(300)]
    rows = ranked(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), [F.desc("v"), F.asc("i")]).collect()
    assert [(x.v, x.i) for x in sorted(rows, key=lambda x: x.rank)] == sorted([(v, i) for i, v in enumerate(values)], key=lambda x: (-x[0], x[1])) and {x.rank for x in rows} == set(range(1, 301))


def test_reach_is_counted_by_words_that_are_not_broadcast(spark, monkeypatch):
    """B leads to A, A to 70 more headers, C to the last of them: counts over several words; the driver holds none of them."""
    from partloom.operators import graph as G

    tables, real = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: tables.append((name, df)) or real(df, name))
    low = [f"X{i:02d}" for i in range(70)]
    g = graph(spark, {("B", "A"), ("C", "X69")} | {("A", x) for x in low} | {("A", "no header")})
    codes = spark.createDataFrame([(f"b{c}", i, c, "A", "") for i, c in enumerate(["A", "B", "C", *low])], "bom_id string, bom_seq long, code string, revision string, title string")
    got = G.reach_counts(g, codes, codes.select("code").where("code in ('B', 'C')"))
    assert {r.code: r.reachable for r in got.collect()} == {"B": 72, "C": 2}
    bits = [df for name, df in tables if name == "reach-bits"]
    assert len(bits) == 3 and dict(bits[-1].dtypes)["bits"] == "bigint"
    assert "BroadcastHashJoin" not in bits[-1]._jdf.queryExecution().executedPlan().toString()


def test_all_simple_cycles_and_not_only_shortest_ones(spark):
    """Two ways from A to the edge back: both are cycles, and so is one that does not pass by A."""
    edges = {("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("D", "C"), ("E", "E"), ("D", "F")}
    rows = C.simple_cycles(graph(spark, edges)).collect()
    assert sorted("".join(r.path) for r in rows) == ["ABDA", "ACDA", "CDC", "EE"] and all(r.length == len(r.path) - 1 for r in rows)


def test_reach_sends_no_level_to_the_driver(spark, monkeypatch):
    from partloom.operators import graph as G

    tables, real = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: tables.append((name, df)) or real(df, name))
    got = G.reach(graph(spark, {("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")}), spark.createDataFrame([("A",)], "code string"))
    assert {r.code for r in got.collect()} == {"A", "B", "C"}
    levels = [df for name, df in tables if name == "reach"]
    assert len(levels) == 4 and "BroadcastHashJoin" not in levels[-1]._jdf.queryExecution().executedPlan().toString()


def test_reachable_count_broadcasts_nothing(spark):
    from partloom import catalog

    plan = catalog.queries()["reachable_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
