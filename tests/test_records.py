"""Tables and text lines to component lines, by hand and against plain Python."""

import random
import re

from partloom.sources import records as R

FIELDS = list(R.FIELDS.values())


def table(spark, rows):
    """rows: (page, table_no, row, [cells])."""
    cells = [("f", p, t, r, c, v) for p, t, r, values in rows for c, v in enumerate(values)]
    return spark.createDataFrame(cells, "file_id string, page int, table_no int, row int, col int, value string").repartition(3)


HEAD = ["Pos", "Tipo", "Codice\nCode", "Rev.", "Descrizione", "U.M.", "Q.tà", "Note"]


def got(df, *keys):
    return [tuple(r) for r in df.orderBy("page", *keys).select("pos", "type", "internal_code", "rev", "description", "um", "qty", "notes").collect()]


def test_rows_expand_pad_cut_and_join(spark):
    t = table(spark, [
        (1, 1, 0, ["Lista", None, "x", "", "", "", "", ""]), (1, 1, 1, HEAD),
        (1, 1, 2, ["10\n20", "", "A1000\nA2000\nA3000", "A", "one\ntwo\nmore\nstill", "NR\nMT", "1\n2", "n1"]),
        (1, 1, 3, ["", "Disegno", "D\n1", "B", "draw\ning", "", "7", ""]),
        (1, 1, 4, ["x1", "Motor", "C9", "B", "neither digits nor document", "", "7", ""]),
        (1, 1, 5, ["30\n40", "", "\nB4000", "", "", "", "5", None]),
    ])
    assert got(R.table_records(t), "row", "part") == [
        ("0010", None, "A1000", "A", "one", "NR", "1", "n1"), ("0020", None, "A2000", "", "two\nmore\nstill", "MT", "2", ""),
        ("", "Disegno", "D 1", "B", "draw ing", "", None, ""), ("0030", None, "B4000", "", "", "", "5", ""),
    ]


def test_a_header_is_carried_only_where_asked(spark):
    t = table(spark, [
        (1, 1, 0, ["Pos", "Code", "Qty", "Code"]), (1, 1, 1, ["1", "A1", "2", "second code"]),
        (2, 1, 0, ["2", "A2", "3", ""]), (2, 2, 0, ["Item", "Quantity", "Material"]), (2, 2, 1, ["3", "4", "A3"]),
        (3, 1, 0, ["4", "5", "A4"]),
    ])
    codes = lambda df: [(r.pos, r.internal_code, r.qty) for r in df.orderBy("page", "table_no", "row").collect()]
    assert codes(R.table_records(t)) == [("0001", "A1", "2"), ("0003", "A3", "4")]
    assert codes(R.table_records(t, carry=True)) == [("0001", "A1", "2"), ("0002", "A2", "3"), ("0003", "A3", "4"), ("0004", "A4", "5")]
    assert R.table_records(t.limit(0)).count() == 0


def plain_text(lines):
    """(pos, type, code, rev, description, um, qty) of the lines of one file."""
    part, rev, qty = re.compile(r"(?i)([A-Z]{1,3}\d{4,}|[A-Z]\d{6,}|\d{6,})"), re.compile(r"(?i)[A-Z0-9]{1,3}"), re.compile(r"\d+([.,]\d+)?")
    records, out = [], []
    for line in (x.strip() for x in lines):
        if not line:
            continue
        if re.match(r"\d{4}\s+", line + "") and len(line.split()) > 1:
            records.append([line])
        elif records:
            records[-1].append(line)
        else:
            tokens = line.split()
            k = next((i for i, t in enumerate(tokens) if part.fullmatch(t)), -1)
            if len(tokens) >= 3 and k > 0 and (len(tokens[k - 1]) <= 4 or tokens[k - 1].lower() in R.DOCUMENT_TYPES):
                rest = tokens[k + 1 :]
                if len(rest) > 1 and re.fullmatch(r"\d\d", rest[0]) and rev.fullmatch(rest[1]):
                    out.append(("", tokens[k - 1], f"{tokens[k]} {rest[0]}", rest[1], " ".join(rest[2:]), "", None))
                elif rest and rev.fullmatch(rest[0]):
                    out.append(("", tokens[k - 1], tokens[k], rest[0], " ".join(rest[1:]), "", None))
                else:
                    out.append(("", tokens[k - 1], tokens[k], "", " ".join(rest), "", None))
    for r in records:
        pos, *tokens = " ".join(r).split()
        k = next((i for i, t in enumerate(tokens) if part.fullmatch(t)), -1)
        if k < 0:
            continue
        code, rest, own = tokens[k], tokens[k + 1 :], ""
        if len(rest) > 1 and re.fullmatch(r"\d\d", rest[0]) and rev.fullmatch(rest[1]):
            code, own, rest = f"{code} {rest[0]}", rest[1], rest[2:]
        elif rest and rev.fullmatch(rest[0]):
            own, rest = rest[0], rest[1:]
        q = max((i for i, t in enumerate(rest) if qty.fullmatch(t)), default=-1)
        um = rest[q - 1] if q > 0 and len(rest[q - 1]) <= 4 else ""
        text = rest if q < 0 else rest[: q - 1] if um else rest[:q]
        out.append((pos, None, code, own, " ".join(text), um, rest[q] if q >= 0 else None))
    return out


def test_text_lines_equal_plain_parsing(spark):
    r = random.Random(4)
    words = ["E1234567", "AB12345", "123456", "01", "A", "03", "NR", "PZ", "12", "1,5", "3.25", "bolt", "Disegno", "DD", "washer", "x", "Drawing", "M6x20", "2024", "(a)"]
    files, expected = [], {}
    for f in range(60):
        lines = [" ".join(([f"{r.randint(0, 9999):04d}"] if r.random() < 0.4 else []) + [r.choice(words) for _ in range(r.randint(0, 9))]) for _ in range(r.randint(0, 14))]
        expected[str(f)] = plain_text(lines)
        files += [(str(f), 1 + i // 5, i % 5, " " + t) for i, t in enumerate(lines)]
    found = R.text_records(spark.createDataFrame(files, "file_id string, page int, line_no int, text string").repartition(5))
    rows = {}
    for x in found.orderBy("file_id", "page", "line_no").collect():
        rows.setdefault(x.file_id, []).append((x.pos, x.type, x.internal_code, x.rev, x.description, x.um, x.qty))
    assert {k: v for k, v in expected.items() if v} == rows and sum(map(len, rows.values())) >= 100


def test_cells_are_made_rows_once(spark):
    cells = spark.createDataFrame([("f", 1, 1, r, c, v) for r, values in enumerate([("Pos", "Code", "Qty"), ("1", "A1", "2")]) for c, v in enumerate(values)], "file_id string, page int, table_no int, row int, col int, value string")
    got = R.table_records(cells, True)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x.pos, x.internal_code, x.qty) for x in got.collect()] == [("0001", "A1", "2")]
