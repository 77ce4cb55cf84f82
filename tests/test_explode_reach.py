import random

import pytest
from pyspark.sql import functions as F

from partloom import catalog_reports
from partloom.adapters import lists, view
from partloom.functions import keys as K
from partloom.operators import explode as X
from partloom.plans import tables

HEADERS = "bom_id string, bom_seq long, code string, revision string"
LINES = "bom_id string, line_no int, internal_code string, qty double, unit string, kind string, description string, type string, rev string"


@pytest.mark.parametrize("seed", range(2))
def test_reach_equals_the_children_of_all_paths(spark, seed):
    """Lists with lines back up, and codes asked for in several revisions, which lead to different lists."""
    r = random.Random(seed)
    h = spark.createDataFrame([(f"b{i}{v}", 2 * i + (v == "B"), f"P{i}", v) for i in range(8) for v in "AB"], HEADERS)
    lines = []
    for i in range(8):
        for v in "AB":
            for n in range(1, r.randint(2, 4)):
                child = min(i + r.randint(1, 4), 10) if r.random() > 0.3 else r.randint(0, i)
                lines.append((f"b{i}{v}", n, f"P{child}", r.choice([None, 0.0, 1.0, 2.0, 3.0]), "", "MATERIAL", "", "", r.choice(["", "A", "B"])))
    lines = spark.createDataFrame(lines, LINES)
    for policy, root in ((X.Policy(pdf=True, root_strict_rev=False), "P0"), (X.Policy(), "P0")):
        asked = lambda df: sorted(map(tuple, df.select("child_code", "child_rev").distinct().collect()))
        walked = X.explode(spark, lines, h, root, "", None, policy)
        assert asked(X.explode_reach(spark, lines, h, root, "", None, policy).met) == asked(walked.visited.where("state = 'EDGE'"))


def test_a_code_of_several_revisions_comes_once_on_a_path(spark):
    """b1 leads by M-A and by M-B to other lists; under M-A, M may not come again, so its list B is met only without M-A before."""
    h = spark.createDataFrame([("r", 1, "R", "A"), ("ma", 2, "M", "A"), ("mb", 3, "M", "B"), ("k", 4, "K", "A")], HEADERS)
    line = lambda b, n, c: (b, n, c, 1.0, "", "MATERIAL", "", "", "")
    lines = spark.createDataFrame([line("r", 1, "M"), line("ma", 1, "K"), line("k", 1, "M"), line("mb", 1, "Z")], LINES)
    revs = spark.createDataFrame([("M", "A"), ("M", "B")], "code string, rev string")
    for rows in (revs, revs.where("rev = 'A'")):
        met = lambda df: sorted(map(tuple, df.select("child_code", "child_rev").distinct().collect()))
        walked = met(X.explode(spark, lines, h, "R", "A", rows).edges())
        assert met(X.explode_reach(spark, lines, h, "R", "A", rows).met) == walked
        assert (("Z", "") in walked) == (rows is revs)


def test_traces_walk_no_paths(spark, monkeypatch):
    """what was asked for is the distinct children, so paths are not written out for it."""

    def refuse(*args, **options):
        raise AssertionError("all paths were walked")

    monkeypatch.setattr(X, "explode", refuse)
    assert catalog_reports.resolution_traces(spark, "/root/testdata/sf0.001").count() > 0


def test_headers_are_worked_out_once_for_lines_and_headers(spark, monkeypatch):
    """lines read headers from a table; the rows are those of the views."""
    d, names, real = "/root/testdata/sf0.001", [], tables.stored
    monkeypatch.setattr("partloom.adapters.stored", lambda df, name: names.append(name) or real(df, name))
    lines, headers = lists(spark, d)
    assert names == ["bom-headers"]
    for mine, whole in ((lines, view(spark, d, "bom_lines")), (headers, view(spark, d, "bom_headers"))):
        assert mine.dtypes == whole.dtypes
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, whole.collect()))


def test_part_numbers_and_revisions_are_cleaned_once(spark):
    """a cleaned value that an expression names in many places was worked out in each of them."""
    df = spark.createDataFrame([("E0000001", "A")], "code string, rev string")
    cleanings = lambda c: df.select(c.alias("v"))._jdf.queryExecution().analyzed().toString().count("regexp_replace")
    assert cleanings(K.canonical_pn(F.col("code"), F.col("rev"))) == 3 and cleanings(K.rev_order(F.col("rev"))) == 1
