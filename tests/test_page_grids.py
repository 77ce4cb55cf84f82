"""Words and ruled columns to component lines."""

from pyspark.sql import functions as F

from partloom.sources import page_grids as G

EDGES = [10.0, 50.0, 120.0, 150.0, 300.0, 340.0, 380.0]
NAMES = ["Pos", "Codice", "Rev.", "Descrizione", "U.M.", "Q.tà"]


def words_of(page, top, cells, file="f"):
    """One word for each token of a line's cells."""
    out = []
    for k, cell in enumerate(cells):
        for i, token in enumerate((cell or "").split()):
            x = EDGES[k] + 2 + 12 * i
            out.append((file, page, token, x, x + 8, float(top), top + 9.0))
    return out


def run(spark, lines, ruled=(1,), height=842.0, pages=(1, 2, 3)):
    words = spark.createDataFrame([w for page, top, cells in lines for w in words_of(page, top, cells)], "file_id string, page int, text string, x0 double, x1 double, top double, bottom double").repartition(3)
    rules = spark.createDataFrame([("f", p, x + d, 100.0, 790.0) for p in ruled for x in EDGES for d in (-0.5, 0.5)], "file_id string, page int, x double, top double, bottom double")
    sheet = spark.createDataFrame([("f", p, height) for p in pages], "file_id string, page int, height double")
    records, state = G.grid_records(words, rules, sheet)
    rows = [(r.page, r.pos, r.internal_code, r.rev, r.description, r.um, r.qty) for r in records.orderBy("page", "record").collect()]
    return rows, {r.page: r.status for r in state.collect()}


def body(page, first, n):
    return [(page, 260 + 14 * i, [f"{first + 10 * i:04d}", f"E{100000 + first + i}", "A", f"part {first + i}", "NR", str(i + 1)]) for i in range(n)]


def test_records_merge_and_noise_goes(spark):
    lines = [(1, 200, NAMES), *body(1, 10, 2), (1, 290, ["", "", "", "longer text", "", "9"]), (1, 304, ["0050", "E777777", "", "base", "", ""]), (1, 306, ["", "", "B", "", "", "4"])]
    lines += [(1, 320, ["", "", "", "one", "", ""]), (1, 334, ["", "", "", "two", "", ""]), (1, 348, ["", "E888888", "", "three", "", ""])]
    lines += [(1, 795, ["0099", "E999999", "A", "footer", "NR", "1"]), (1, 120, ["0001", "E000001", "A", "above the band", "NR", "1"])]
    rows, state = run(spark, lines, pages=(1,))
    assert rows == [
        (1, "0010", "E100010", "A", "part 10", "NR", "1"), (1, "0020", "E100011", "A", "part 11 longer text", "NR", "2"),
        (1, "", "E888888", "", "three", "", None),
    ]
    assert state == {1: "OK"}


def test_pages_inherit_columns_and_header_while_rows_go_on(spark):
    lines = [(1, 200, NAMES), *body(1, 10, 4), *body(2, 50, 5), (3, 260, ["0500", "E100500", "A", "too few words", "NR", "1"])]
    rows, state = run(spark, lines, pages=(1, 2, 3, 4))
    assert [r[1] for r in rows if r[0] == 2] == ["0050", "0060", "0070", "0080", "0090"] and len(rows) == 9
    assert state == {1: "OK", 2: "OK", 3: "FEW_RULES", 4: "NO_WORDS"}
    alone, state = run(spark, lines[5:], ruled=(1, 2), pages=(1, 2, 3))
    assert alone == [] and state == {1: "NO_WORDS", 2: "NO_HEADER", 3: "FEW_RULES"}


def test_lines_are_anchored_at_their_first_top(spark):
    got = spark.range(1).select(G.line_anchors(F.array(*[F.lit(float(x)) for x in (5, 1, 3, 4, 7, 8)]), F.lit(3.0)).alias("a")).first().a
    assert got == [1.0, 5.0]
    assert run(spark, [(1, 200, ["Pos", "", "", "Descrizione", "", "Q.tà"]), *body(1, 10, 3)], pages=(1,))[1] == {1: "NO_CODE"}


def test_words_are_named_from_one_token(spark):
    """Names of columns came from a token that was worked out again for each spelling; the fold over pages repeated its parts likewise."""
    from pyspark.sql import functions as F

    from partloom.sources.headers import header_name

    words = spark.createDataFrame([("Q.tà",), ("Codice / Code",), ("bolt",), ("",)], "text string").select(header_name(F.col("text")).alias("n"))
    assert [r.n for r in words.collect()] == ["qty", "code", None, None]
    assert words._jdf.queryExecution().analyzed().toString().count("translate(") == 1
