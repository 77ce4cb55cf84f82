import pytest
from pyspark.sql import functions as F

from partloom.functions import keys as K


def values(spark, f, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.v for r in df.select("i", f(*[F.col(f"c{k}") for k in range(len(rows[0]))]).alias("v")).orderBy("i").collect()]


def test_part_numbers(spark):
    rows = [("E0029472", None), ("E0029472 01", None), ("E002947201", "01"), ("E002947201", "03"), ("E002947301", None), ("E0029473 01", None), ("166104001-04", "04"), (" ab/ 12_x ", "r1"), (None, "1"), ("", None), ("-", "2")]
    assert values(spark, K.canonical_pn, rows) == ["E0029472", "E0029472-01", "E0029472-01", "E0029472-03", "E0029473-01", "E0029473-01", "166104001-04", "AB-12-X-R1", "", "", ""]


def test_units_and_quantities(spark):
    assert values(spark, K.unit, [(" pz ",), ("mt",), ("g",), ("LT",), ("roll",), (None,)]) == ["NR", "M", "GR", "L", "ROLL", ""]
    assert values(spark, K.quantity, [("1,5",), ("-",), ("",), (None,), ("NaN",), ("x",), ("1 000",), ("=A1",)]) == [1.5, None, None, None, None, None, 1000.0, None]


def test_revision_order(spark):
    revs = ["", "?", "A-1", "1", "10", "A", "A2", "A10", "B"]
    df = spark.createDataFrame([(r,) for r in reversed(revs)], "r string")
    assert [x.r for x in df.orderBy(K.rev_order(F.col("r"))).collect()] == revs


def test_roots_and_prefixes(spark):
    assert values(spark, K.digit_root, [("ab1234567x",), ("12345",), (None,)]) == ["1234567", "", ""]
    assert values(spark, K.leading_root, [("123456AB",), ("A123456",)]) == ["123456", None]
    assert values(spark, K.digit_match, [("231005117PRTL", "2310051171A01"), ("12", "x"), ("777 231005", "file 231009")]) == [9, 0, 5]
    assert values(spark, K.rev_in_text, [("bom rev_b2",), ("REVISION",), ("none",)]) == ["B2", "ISION", ""]


def test_lookup_suffix_and_documents(spark):
    assert values(spark, K.strip_lookup_suffix, [("XPRTL",), ("PRTL",), ("ABDS",), ("Xprtl",)]) == ["X", "PRTL", "AB", "Xprtl"]
    assert values(spark, K.looks_like_document, [("12-assd",), ("x3D_S",), ("PCB",)]) == [True, False, False]


@pytest.mark.parametrize("value,status,want", [(2.01, "OK_STEP", 2.0), (2.5, "OK_STEP", 2.5), (0.37, "CHECK", 0.37)])
def test_quantized(spark, value, status, want):
    r = spark.range(1).select(K.quantized(F.lit(value), [1.0, 0.5]).alias("q")).first().q
    assert (r.status, r.value) == (status, want)
