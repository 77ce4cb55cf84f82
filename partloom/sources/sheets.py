"""Component lists and totals of sheets, up to where their table ends.

Cells are (file_id, row, col, value), without empty ones if the decoder leaves them out; sheets have some
ten thousand rows at most, and the windows here take the rows of one sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm, quantity, text
from ..plans.tables import stored
from .grids import alias_table, assembled_records, column_map, header_rows
from .headers import STRUCTURE_NAMES, structure_blocks, totals_header

# Spellings of the columns of a component sheet, and limits of its table.
SHEET_NAMES = {
    "pos": ["POS", "POS.", "POSITION"],
    "qty": ["Q.TY", "QTY", "QTA", "Q.TÀ", "Q.TÀ.", "QTA.", "Q'TY", "QUANTITY"],
    "um": ["UM", "U.M.", "U.M", "UOM", "UNIT"],
    "internal_code": ["INTERNAL CODE", "INTERNALCODE", "CODE", "COMPONENT CODE", "COMPONENTCODE"],
    "description": ["DESCRIPTION", "DESCRIZIONE", "DESC"],
    "refdes": ["REF. DESIGNATOR", "REF DESIGNATOR", "REFDES", "REFERENCE DESIGNATOR", "REF.DES"],
    "notes": ["NOTES", "NOTE"],
    "manufacturer": ["MANUFACTURER", "PRODUTTORE", "MFR"],
    "manufacturer_code": ["MANUFACTURER CODE", "MFR CODE", "MFRCODE", "COD. PRODUTTORE", "COD PRODUTTORE"],
    "rev": ["REV", "REVISION"],
    "val": ["VAL", "VALUE"],
    "rat": ["RAT", "RATING"],
    "tol": ["TOL", "TOLERANCE"],
    "tecn": ["TECN", "TECH", "TECHNOLOGY"],
}
REQUIRED, ONCE = ["pos", "description", "qty"], ("pos", "qty", "um", "internal_code")
MOST_EMPTY, MOST_EMPTY_STRUCTURE, MOST_ROWS, TOTALS_SHEET = 30, 25, 20_000, "TOTALIZZAZIONE"


def spelled(c: Column) -> Column:
    """Upper case, white space one blank."""
    return F.regexp_replace(norm(c), r"\s+", " ")


def sheet_number(c: Column) -> Column:
    """A number with comma or dot; of both, the dots part thousands."""
    t = F.regexp_replace(text(c), r"\s+", "")
    return quantity(F.when(F.contains(t, F.lit(",")) & F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.", "")).otherwise(t))


def before_gap(filled: DataFrame, start: DataFrame, skipped: DataFrame | None = None, most: int = MOST_EMPTY) -> DataFrame:
    """file_id, row of ``filled`` below ``start`` and before the first ``most`` empty rows in a row; skipped rows are not counted."""
    marked = filled.select("file_id", "row", F.lit(1).alias("kind")).distinct().unionByName(start.select("file_id", "row", F.lit(2).alias("kind")))
    if skipped is not None:
        marked = marked.unionByName(skipped.select("file_id", "row", F.lit(0).alias("kind")).distinct())
    # a table: where all parts of a union are spread alike, a join takes their partitions for those of one
    marked = stored(marked, "marked-rows").join(start.select("file_id", F.col("row").alias("first")), "file_id").where("row >= first").groupBy("file_id", "row").agg(F.max("kind").alias("kind"), F.min("kind").alias("least"))
    order = Window.partitionBy("file_id").orderBy("row")
    # a skipped row that is filled stays skipped; the start is the start
    counted = marked.withColumn("out", (F.col("least") == 0) & (F.col("kind") < 2)).withColumn("at", F.col("row") - F.sum(F.col("out").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(~F.col("out"), F.col("at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = counted.withColumn("gap", ~F.col("out") & (F.col("at") - last > most))
    ended = F.max(F.coalesce("gap", F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("ended", ended).where("ended = 0 and not out and kind < 2").select("file_id", "row")


def sheet_records(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (file_id, record, row and a column for each of SHEET_NAMES), and orphan rows (file_id, row).

    The table ends before 30 empty rows or after 20,000.  A position of digits begins a record; what follows
    joins it, but for position, quantity, unit and code.  Repeated headers are left out; rows
    before the first record are orphans.  Columns that a sheet lacks are null.
    """
    aliases = alias_table(cells.sparkSession, SHEET_NAMES)
    plain = cells.withColumn("value", F.trim(text(F.col("value")))).where("value <> ''")
    spaced = plain.withColumn("value", spelled(F.col("value")))
    heads = header_rows(spaced, aliases, REQUIRED)
    places = column_map(spaced, aliases, heads).where("col is not null")
    start = heads.select("file_id", "row")
    below = plain.join(start.withColumnRenamed("row", "head"), "file_id").where((F.col("row") > F.col("head")) & (F.col("row") <= F.col("head") + MOST_ROWS))
    named = below.join(places, ["file_id", "col"])
    alias = F.col("alias").isNotNull()
    known = named.withColumn("spelled", spelled(F.col("value"))).join(aliases.select(F.col("alias"), F.col("column").alias("means")), F.col("spelled") == F.col("alias"), "left")
    value = lambda c: F.max(F.when(F.col("column") == c, F.col("value"))).alias(c)
    rows = known.groupBy("file_id", "row").agg(*[value(c) for c in SHEET_NAMES], F.count_if(alias).alias("hits"), F.bool_or((F.col("column") == "pos") & (F.col("means") == "pos")).alias("header"))
    inside = rows.join(before_gap(rows, start), ["file_id", "row"], "left_semi").where("not coalesce(header, false) and hits < 3")
    starts = F.coalesce(F.rlike("pos", F.lit("^[0-9]+$")), F.lit(False))
    seps = {c: "" if c in ONCE else ", " if c == "refdes" else " " for c in SHEET_NAMES}
    has = places.groupBy("file_id").agg(F.collect_set("column").alias("has"))
    found = assembled_records(inside, starts, seps).join(has, "file_id")
    pos = F.when(F.length("pos") < 4, F.lpad("pos", 4, "0")).otherwise(F.col("pos"))
    own = lambda c: pos if c == "pos" else sheet_number(F.col(c)) if c == "qty" else F.col(c)
    records = found.select("file_id", "record", "row", *[F.when(F.array_contains("has", c), own(c)).alias(c) for c in SHEET_NAMES])
    first = inside.where(starts).groupBy("file_id").agg(F.min("row").alias("first"))
    orphans = inside.join(first, "file_id", "left").where("first is null or row < first").select("file_id", "row")
    return records, orphans


def totals_cells(cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """file_id, sheet_row, code, qty of the rows of totals sheets, up to 30 empty rows; input of ``load_totalization``.

    ``cells`` (file_id, sheet, row, col, value): only the sheet named for totals counts.  ``hidden`` (file_id,
    row): rows that a filter hides, and formulas kept as text, are passed over and do not end a table.
    """
    own = cells.where(norm(F.col("sheet")) == TOTALS_SHEET).select("file_id", "row", "col", "value")
    heads = totals_header(own)
    j = own.join(heads.select("file_id", F.col("row").alias("head"), "code_col", "qty_col"), "file_id").where("row > head")
    value = lambda c: F.max(F.when(F.col("col") == F.col(c), F.trim(text(F.col("value")))))
    rows = j.groupBy("file_id", "row").agg(F.coalesce(value("code_col"), F.lit("")).alias("code"), F.coalesce(value("qty_col"), F.lit("")).alias("qty"))
    formula = F.startswith("qty", F.lit("=")) & (F.length("qty") > 1)
    filled = rows.where((F.col("code") != "") | quantity(F.col("qty")).isNotNull())
    skipped = rows.where(formula).select("file_id", "row")
    if hidden is not None:
        skipped = skipped.unionByName(hidden.select("file_id", "row"))
    kept = before_gap(filled, heads.select("file_id", "row"), skipped)
    return rows.join(kept, ["file_id", "row"], "left_semi").select("file_id", F.col("row").alias("sheet_row"), "code", "qty")


def merged_blocks(cells: DataFrame, spans: DataFrame, rows: int = 250, cols: int = 120) -> DataFrame:
    """As ``structure_blocks``, with the columns of a header cell those of the merged span it stands in.

    ``spans`` (file_id, row0, row1, col0, col1): each row of a span meets the header cells of that
    row, so a cell is only held against spans beside it.
    """
    table = [(k, alias) for k, spellings in STRUCTURE_NAMES.items() for alias in spellings]
    names = cells.sparkSession.createDataFrame(table, "name string, alias string")
    hit = cells.where((F.col("row") <= rows) & (F.col("col") <= cols)).withColumn("alias", F.regexp_replace(norm(F.col("value")), r"\s+", "")).join(F.broadcast(names), "alias").select("file_id", "row", "col", "name")
    by_row = spans.select("file_id", "col0", "col1", F.explode(F.sequence("row0", F.least("row1", F.lit(rows)))).alias("row"))
    placed = hit.join(by_row, ["file_id", "row"], "left").withColumn("in", F.coalesce(F.col("col").between(F.col("col0"), F.col("col1")), F.lit(False)))
    wide = placed.groupBy("file_id", "row", "col", "name").agg(F.coalesce(F.min(F.when(F.col("in"), F.col("col0"))), F.col("col")).alias("c0"), F.coalesce(F.max(F.when(F.col("in"), F.col("col1"))), F.col("col")).alias("c1"))
    at = lambda name: F.min(F.when(F.col("name") == name, F.struct("col", "c0", "c1"))).alias(name)
    found = wide.groupBy("file_id", "row").agg(*[at(n) for n in STRUCTURE_NAMES]).where("CODE is not null and DESCRIPTION is not null")
    first = found.groupBy("file_id").agg(F.min(F.struct("row", *STRUCTURE_NAMES)).alias("h")).select("file_id", "h.*")
    return first.select(
        "file_id", F.col("row").alias("header_row"), F.col("CODE.c0").alias("code0"), F.col("CODE.c1").alias("code1"), F.col("DESCRIPTION.c0").alias("desc0"), F.col("DESCRIPTION.c1").alias("desc1"),
        F.col("REV.c0").alias("rev_col"), F.col("QTY.c0").alias("qty_col"), F.when(F.col("REV").isNull() | F.col("QTY").isNull(), "MISSING_COLUMNS").otherwise("").alias("error"),
    )


def _structure(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, seq, code, description, rev, qty, level of the rows below a header, up to 25 empty ones."""
    good = blocks.where("error = ''")
    filled = cells.withColumn("value", F.trim(text(F.col("value")))).where("value <> ''").join(good, "file_id").where("row > header_row")
    first = lambda a, b: F.min(F.when(F.col("col").between(F.col(a), F.col(b)), F.struct("col", "value")))
    one = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("value")))
    rows = filled.groupBy("file_id", "row", "desc0").agg(first("code0", "code1").alias("c"), first("desc0", "desc1").alias("d"), one("rev_col").alias("rev"), one("qty_col").alias("q")).where("c is not null or d is not null")
    rows = stored(rows, "structure-rows")
    kept = rows.join(before_gap(rows, good.select("file_id", F.col("header_row").alias("row")), most=MOST_EMPTY_STRUCTURE), ["file_id", "row"], "left_semi")
    blank = F.lit("")
    return kept.select(
        F.col("file_id").alias("doc_id"), F.col("row").cast("long").alias("seq"), F.regexp_replace(F.coalesce("c.value", blank), r"\s+", " ").alias("code"), F.coalesce("d.value", blank).alias("description"),
        F.coalesce("rev", blank).alias("rev"), F.coalesce(quantity(F.col("q")), F.lit(0.0)).alias("qty"), F.coalesce(F.greatest(F.col("d.col") - F.col("desc0"), F.lit(0)), F.lit(0)).alias("level"),
    )


def structure_rows(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of indented structures; files of which the columns between header cells give no row are read by merged spans.

    The level is the place of the description within its columns, 0 without one.  The structure
    ends before 25 rows without code and description.  What is read more than once is a table.
    """
    cells, spans = stored(cells.select("file_id", "row", "col", "value"), "structure-cells"), stored(spans.select("file_id", "row0", "row1", "col0", "col1"), "spans")
    plain = stored(_structure(cells, stored(structure_blocks(cells), "blocks")), "structure")
    rest = stored(cells.join(plain.select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_anti"), "structure-cells")
    return plain.unionByName(_structure(rest, stored(merged_blocks(rest, spans), "blocks")))
