"""Component lines from tables and from text lines of pages.

Decoders hand over table cells (file_id, page, table_no, row, col, value) and text lines
(file_id, page, line_no, text); both operators give lines with the columns of FIELDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stored
from .headers import header_name

# Names of columns and the fields they fill, types of documents, patterns of tokens.
FIELDS = {
    "pos": "pos", "type": "type", "code": "internal_code", "rev": "rev", "desc": "description", "um": "um", "qty": "qty",
    "notes": "notes", "manufacturer": "manufacturer", "manufacturer_code": "manufacturer_code",
}
LONG = ("desc", "notes", "manufacturer", "manufacturer_code")
DOCUMENT_TYPES = ("disegno", "drawing", "documento", "document", "doc", "dwg")
POSITION = r"^\s*([0-9]{4})\s+(.*)$"
PART_LIKE = r"(?i)^(?:[A-Z]{1,3}[0-9]{4,}|[A-Z][0-9]{6,}|[0-9]{6,})$"
REVISION_LIKE = r"(?i)^[A-Z0-9]{1,3}$"
QUANTITY_LIKE = r"^[0-9]+(?:[.,][0-9]+)?$"


def clean(c: Column) -> Column:
    """Text without glyph numbers, all white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:[0-9]+\)", ""), r"[\s\x{A0}]+", " "))


def cell_lines(c: Column) -> Column:
    """The filled lines of a cell; ``null`` counts as empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "null"))


def position(c: Column) -> Column:
    """A position of digits only as four digits at least."""
    return F.when(F.rlike(c, F.lit("^[0-9]{1,3}$")), F.lpad(c, 4, "0")).otherwise(c)


def is_table_header(said: Column) -> Column:
    """Whether a row names a position, a code and a quantity."""
    t = F.lower(said)
    return F.rlike(t, F.lit("pos|riga|item")) & F.rlike(t, F.lit("codice|code|materiale|material")) & F.rlike(t, F.lit(r"qty|quant|qta|q\s*\.?\s*t"))


def _named(cells: Column) -> Column:
    """[struct(name, col)] of a header row's cells: each cell by its first line that names a column, else by all its lines."""

    def name(x: Column) -> Column:
        names = F.filter(F.transform(x["lines"], header_name), lambda n: n.isNotNull())
        return F.coalesce(F.get(names, F.lit(0)), header_name(F.array_join(x["lines"], " ")))

    return F.filter(F.transform(cells, lambda x: F.struct(name(x).alias("name"), x["col"].alias("col"))), lambda x: x["name"].isNotNull())


def column_of(named: Column, name: str) -> Column:
    """The first column of a name among [struct(name, col)] in the order of columns; null without one."""
    return F.get(F.transform(F.filter(named, lambda x: x["name"] == name), lambda x: x["col"]), F.lit(0))


def table_records(cells: DataFrame, carry: bool = False) -> DataFrame:
    """file_id, page, table_no, row, part and FIELDS of the lines of all tables.

    The first row of a table that names position, code and quantity is its header; of two columns
    of one name the first counts.  Below it, a row with digits as positions gives a line for each
    position: short columns are padded, longer ones cut, but what is left over of long texts
    joins the last line.  A row without position is kept where its type is that of a document, and
    has no quantity.  Tables without a header, or whose header names no code, give nothing; with
    ``carry`` they take the columns of the last header before them in the file, all rows being lines.
    Fields whose column the header lacks are null; lines without a code are left out.
    """
    kept = cells.select("file_id", "page", "table_no", "row", F.struct("col", cell_lines(F.col("value")).alias("lines")).alias("cell"))
    rows = kept.groupBy("file_id", "page", "table_no", "row").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    said = F.array_join(F.flatten(F.transform("cells", lambda x: x["lines"])), " ")
    # read twice, so a table: cells are shuffled into rows once
    rows = stored(rows.withColumn("named", F.when(is_table_header(said), _named(F.col("cells")))), "table-rows")
    # one row for each table: its header, or the last one before it
    tables = rows.groupBy("file_id", "page", "table_no").agg(F.min_by("named", F.when(F.col("named").isNotNull(), F.col("row"))).alias("named"), F.min(F.when(F.col("named").isNotNull(), F.col("row"))).alias("at"))
    usable = F.when(column_of(F.col("named"), "code").isNotNull(), F.col("named"))
    if carry:
        earlier = Window.partitionBy("file_id").orderBy("page", "table_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        usable = F.coalesce(usable, F.when(F.col("at").isNull(), F.last(usable, ignorenulls=True).over(earlier)))
    heads = tables.select("file_id", "page", "table_no", usable.alias("map"), "at").where("map is not null")
    # the columns are sought once for a table; stored, heads have a known size, and rows need not move to few of them
    heads = stored(heads.select("file_id", "page", "table_no", "at", *[column_of(F.col("map"), n).alias(f"at_{n}") for n in FIELDS]), "table-heads")
    body = rows.drop("named").join(heads, ["file_id", "page", "table_no"]).where(F.col("at").isNull() | (F.col("row") > F.col("at")))

    def lines(name: str) -> Column:
        at = F.col(f"at_{name}")
        found = F.get(F.transform(F.filter("cells", lambda x: x["col"] == at), lambda x: x["lines"]), F.lit(0))
        return F.when(at.isNotNull(), F.coalesce(found, F.array().cast("array<string>"))).alias(name)

    split = body.select("file_id", "page", "table_no", "row", *[lines(n) for n in FIELDS])
    none = F.array().cast("array<string>")
    pos = F.coalesce("pos", none)
    numbered = (F.size(pos) > 0) & F.forall(pos, lambda p: F.rlike(p, F.lit("^[0-9]+$")))
    document = ~numbered & F.lower(F.array_join("type", " ")).isin(*DOCUMENT_TYPES)
    marked = split.select("*", numbered.alias("numbered"), F.when(numbered, F.size(pos)).otherwise(1).alias("n")).where(numbered | document)
    each = marked.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("part"))

    def value(name: str) -> Column:
        own = F.coalesce(F.get(F.col(name), F.col("part") - 1), F.lit(""))
        if name in LONG:
            own = F.when((F.col("part") == F.col("n")) & (F.size(name) > F.col("n")), F.array_join(F.slice(name, F.col("n"), F.size(name)), "\n")).otherwise(own)
        got = F.when(F.col("numbered"), own).otherwise(F.array_join(name, " "))
        if name == "pos":
            got = F.when(F.col("numbered"), position(own)).otherwise("")
        if name == "type":
            got = F.when(~F.col("numbered"), F.array_join(name, " "))
        if name == "qty":
            got = F.when(F.col("numbered") & (own != ""), own)
        if name in ("rev", "desc", "um"):
            got = F.coalesce(got, F.lit(""))
        return F.when(F.col(name).isNotNull() | F.lit(name in ("pos", "rev", "desc", "um")), got).alias(FIELDS[name])

    return each.select("file_id", "page", "table_no", "row", "part", *[value(n) for n in FIELDS]).where("internal_code <> ''")


def _first(tokens: Column, pattern: str) -> Column:
    """The place (from 1) of the first token of a pattern, 0 without one."""
    return F.array_position(F.transform(tokens, lambda t: F.rlike(t, F.lit(pattern))), True)


def text_records(lines: DataFrame) -> DataFrame:
    """file_id, page, line_no and FIELDS of the lines of text, pages of a file read on in order.

    A line that begins with four digits begins a record, and later lines are joined to it.  The first
    token like a part number is the code; two digits after it belong to it where a revision
    follows; what then looks like a revision is one.  The last number is the quantity, a token of
    at most four letters before it the unit, the rest before both the description.  Before the
    first such line, a line of three tokens or more with a short or documentary word before the code
    is a document without quantity.
    """
    order = Window.partitionBy("file_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lines.select("file_id", "page", "line_no", F.trim(F.coalesce("text", F.lit(""))).alias("text")).where(F.col("text") != "")
    starts = F.rlike("text", F.lit(POSITION))
    marked = filled.withColumn("record", F.sum(starts.cast("int")).over(order))
    place = F.struct("page", "line_no", "text")
    # each line before the first record stands alone
    alone = F.when(F.col("record") == 0, F.struct("page", "line_no"))
    joined = marked.groupBy("file_id", "record", alone.alias("alone")).agg(F.sort_array(F.collect_list(place)).alias("p"))
    said = joined.select("file_id", F.col("p")[0]["page"].alias("page"), F.col("p")[0]["line_no"].alias("line_no"), (F.col("record") > 0).alias("numbered"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("said"))
    tail = F.when(F.col("numbered"), F.regexp_replace("said", r"^[0-9]{4}\s+", "")).otherwise(F.col("said"))
    tokens = said.select("*", F.filter(F.split(tail, r"\s+"), lambda t: t != "").alias("t"))
    coded = tokens.withColumn("k", _first(F.col("t"), PART_LIKE).cast("int")).where("k > 0")
    at = lambda d: F.coalesce(F.get("t", F.col("k") - 1 + d), F.lit(""))
    revision = lambda d: F.rlike(at(d), F.lit(REVISION_LIKE))
    suffix = F.rlike(at(1), F.lit("^[0-9]{2}$")) & revision(2)
    used = F.when(suffix, 3).when(revision(1), 2).otherwise(1)
    parsed = coded.select(
        "file_id", "page", "line_no", "numbered", "said", F.when(F.col("k") > 1, at(-1)).otherwise("").alias("before"), F.size("t").alias("n"),
        F.when(suffix, F.concat_ws(" ", at(0), at(1))).otherwise(at(0)).alias("internal_code"), F.when(suffix, at(2)).when(revision(1), at(1)).otherwise("").alias("rev"),
        F.slice("t", F.col("k") + used, F.greatest(F.size("t"), F.lit(1))).alias("rest"),
    )
    last = F.array_position(F.transform(F.reverse("rest"), lambda t: F.rlike(t, F.lit(QUANTITY_LIKE))), True)
    q = F.when(last > 0, F.size("rest") - last.cast("int") + 1).otherwise(0)
    measured = parsed.withColumn("q", F.when(F.col("numbered"), q).otherwise(0))
    token = lambda d: F.coalesce(F.get("rest", F.col("q") - 1 + d), F.lit(""))
    with_unit = (F.col("q") > 1) & (F.length(token(-1)) <= 4)
    kept = F.when(F.col("q") == 0, F.size("rest")).when(with_unit, F.col("q") - 2).otherwise(F.col("q") - 1)
    short = (F.col("before") != "") & ((F.length("before") <= 4) | F.lower("before").isin(*DOCUMENT_TYPES))
    text = F.lit(None).cast("string")
    return measured.where(F.col("numbered") | ((F.col("n") >= 3) & short)).select(
        "file_id", "page", "line_no",
        F.when(F.col("numbered"), F.regexp_extract("said", POSITION, 1)).otherwise("").alias("pos"), F.when(~F.col("numbered"), F.col("before")).alias("type"), "internal_code", "rev",
        F.array_join(F.slice("rest", F.lit(1), kept), " ").alias("description"), F.when(with_unit, token(-1)).otherwise("").alias("um"), F.when(F.col("q") > 0, token(0)).alias("qty"),
        text.alias("notes"), text.alias("manufacturer"), text.alias("manufacturer_code"),
    )
