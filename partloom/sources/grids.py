"""Schema inference over grids of cells, lines of text and words of pages.

Spreadsheet and page decoders hand over these grids as tables: cells (file_id, row, col, value),
lines (file_id, line_no, text), words (file_id, page, text, x0, x1, top, bottom).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm, quantity
from ..plans.tables import stored

# Spellings of the columns of a component list.
COLUMN_NAMES = {
    "pos": ["POS", "POS.", "POSITION", "ITEM"],
    "internal_code": ["INTERNAL CODE", "CODE", "CODICE", "PART NUMBER", "P/N"],
    "description": ["DESCRIPTION", "DESCRIZIONE", "DESC"],
    "qty": ["QTY", "Q.TY", "QUANTITY", "Q.TA", "QTA"],
    "um": ["UM", "U.M.", "UOM", "UNIT"],
    "rev": ["REV", "REV.", "REVISION"],
    "type": ["TYPE", "TIPO"],
    "notes": ["NOTES", "NOTE"],
    "manufacturer": ["MANUFACTURER", "MFR", "COSTRUTTORE"],
}


def alias_table(spark, names: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, vs in (names or COLUMN_NAMES).items() for v in vs], "column string, alias string")


def header_rows(cells: DataFrame, aliases: DataFrame, required: list[str], rows: int = 120, cols: int = 60, least: int = 3) -> DataFrame:
    """file_id, row, score: the first row that has all required columns, else the best of at least ``least``."""
    hit = cells.where((F.col("row") <= rows) & (F.col("col") <= cols)).withColumn("alias", norm(F.col("value"))).join(aliases, "alias")
    scored = hit.groupBy("file_id", "row").agg(F.count_distinct("column").alias("score"), F.count_distinct(F.when(F.col("column").isin(required), F.col("column"))).alias("must"))
    best = Window.partitionBy("file_id").orderBy(F.desc(F.col("must") == len(required)), F.when(F.col("must") == len(required), F.lit(0)).otherwise(-F.col("score")), "row")
    return scored.where((F.col("must") == len(required)) | (F.col("score") >= least)).withColumn("__r", F.row_number().over(best)).where("__r = 1").select("file_id", "row", "score")


def column_map(cells: DataFrame, aliases: DataFrame, header: DataFrame) -> DataFrame:
    """file_id, column, col: the first column of each name in the header row."""
    return cells.join(header.select("file_id", "row"), ["file_id", "row"]).withColumn("alias", norm(F.col("value"))).join(aliases, "alias").groupBy("file_id", "column").agg(F.min("col").alias("col"))


def assembled_records(rows: DataFrame, starts: Column, fields: dict[str, str]) -> DataFrame:
    """Records of (file_id, row, ...): a row that ``starts`` begins one, later rows continue its ``fields``.

    ``fields``: name -> separator for continued text, or "" for fields of the first row only.  Rows
    before the first start are left out.
    """
    order = Window.partitionBy("file_id").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("record", F.sum(starts.cast("int")).over(order)).where("record > 0")
    parts = []
    for name, sep in fields.items():
        if sep:
            kept = F.sort_array(F.collect_list(F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.struct("row", F.trim(F.col(name)).alias("t")))))
            parts.append(F.array_join(F.transform(kept, lambda x: x["t"]), sep).alias(name))
        else:
            parts.append(F.coalesce(F.min_by(name, "row"), F.lit("")).alias(name))
    return marked.groupBy("file_id", "record").agg(F.min("row").alias("row"), *parts)


def line_records(lines: DataFrame, pattern: str = r"^\s*[0-9]{4}\b") -> DataFrame:
    """file_id, record, line_no, text: a line with a position begins a record, others are joined to it."""
    rows = lines.select("file_id", F.col("line_no").alias("row"), "text")
    return assembled_records(rows, F.rlike("text", F.lit(pattern)), {"text": " "})


def expanded_cells(rows: DataFrame, columns: list[str], joined: list[str]) -> DataFrame:
    """Cells with line breaks become one logical row for each line of ``pos``.

    Short columns are padded with empty text; text beyond the last row is joined to it in the
    columns ``joined`` and dropped in others.
    """
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~F.lower(F.trim(x)).isin("", "null"))
    arrays = rows.select("file_id", "row", *[split(c).alias(c) for c in columns]).withColumn("n", F.greatest(F.size("pos"), F.lit(1)))
    indexed = arrays.select("*", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("k", "i"))
    value = lambda c: F.coalesce(F.get(c, F.col("k")), F.lit(""))
    rest = lambda c: F.when((F.col("i") == F.col("n")) & (F.size(c) > F.col("n")), F.array_join(F.slice(c, F.col("n"), F.size(c)), " ")).otherwise(value(c))
    return indexed.select("file_id", "row", (F.col("k") + 1).alias("part"), *[(rest(c) if c in joined else value(c)).alias(c) for c in columns])


def cluster_values(values: DataFrame, column: str, tolerance: float, within: list[str]) -> DataFrame:
    """within, column, n, cluster (from 1): a row for each different value; sorted values no further apart than ``tolerance`` are one cluster.

    Ranges of the different values are marked apart, then moved by the gaps of the ranges before; one task of a
    file adds up its ranges, which are as many as shuffle partitions, not its values.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.groupBy(*within, column).agg(F.count("*").alias("n"))
    ranges = stored(counted.repartitionByRange(parts, *within, column).withColumn("__range", F.spark_partition_id()), "cluster-ranges")
    inside = Window.partitionBy(*within, "__range").orderBy(column)
    # equal values differ by more only where their difference is no number: each row is then a gap
    own = F.when(F.col(column) - F.col(column) > tolerance, F.col("n") - 1).otherwise(0)
    marked = ranges.withColumn("__gap", F.when(F.col(column) - F.lag(column).over(inside) > tolerance, 1).otherwise(0) + own)
    marked = marked.withColumn("__gaps", F.sum("__gap").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = marked.groupBy(*within, "__range").agg(F.min_by(column, F.struct(F.col(column))).alias("__first"), F.max_by(column, F.struct(F.col(column))).alias("__last"), F.sum("__gap").alias("__sum"))
    along = Window.partitionBy(*within).orderBy("__range")
    joint = ends.withColumn("__joint", F.when(F.col("__first") - F.lag("__last").over(along) > tolerance, 1).otherwise(0))
    before = F.sum(F.col("__joint") + F.col("__sum")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__sum")
    moved = joint.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__range").alias("__r"), before.alias("__before"))
    same = F.col("__range") == F.col("__r")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return marked.join(moved, same).select(*within, column, "n", (F.col("__gaps") + F.col("__before") + 1).alias("cluster"))


def clusters(values: DataFrame, column: str, tolerance: float, within: list[str]) -> DataFrame:
    """``values`` with cluster (from 1) and center, as ``cluster_values``, of groups as small as the words of a page."""
    order = Window.partitionBy(*within).orderBy(column)
    gap = F.when(F.col(column) - F.lag(column).over(order) > tolerance, 1).otherwise(0)
    marked = values.withColumn("__gap", gap).withColumn("cluster", F.sum("__gap").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + 1)
    return marked.withColumn("center", F.avg(column).over(Window.partitionBy(*within, "cluster"))).drop("__gap")


def words_to_columns(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Words with the column whose range holds their middle; ``edges`` (file_id, col, x0, x1), few per file."""
    middle = (F.col("w.x0") + F.col("w.x1")) / 2
    on = (F.col("w.file_id") == F.col("e.file_id")) & (middle >= F.col("e.x0")) & (middle < F.col("e.x1"))
    return words.alias("w").join(edges.alias("e"), on).select("w.file_id", "w.word_id", "e.col")


def parser_scores(rows: DataFrame) -> DataFrame:
    """file_id, parser, n, coverage, duplicates, score of each extractor's rows (file_id, parser, internal_code, qty)."""
    code = norm(F.col("internal_code"))
    a = rows.groupBy("file_id", "parser").agg(F.count("*").alias("n"), F.avg((code != "").cast("double")).alias("coverage"), (F.count("*") - F.count_distinct(code)).alias("duplicates"), F.count("qty").alias("with_qty"))
    return a.select("file_id", "parser", "n", "coverage", "duplicates", (F.col("n") * F.col("coverage") + 0.25 * F.col("with_qty") - 0.5 * F.col("duplicates")).alias("score"))


def chosen_parser(scores: DataFrame, preferred: list[str], gain: float = 1.5) -> DataFrame:
    """file_id, parser: the first preferred one with rows, unless another scores higher by ``gain`` at full coverage."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("parser")), F.lit(99))
    a = scores.where("n > 0").groupBy("file_id").agg(F.min(F.struct(rank.alias("k"), "parser", "score")).alias("first"), F.max(F.when(F.col("coverage") >= 1, F.struct("score", "parser"))).alias("best"))
    better = F.col("best").isNotNull() & (F.col("best.score") - F.col("first.score") >= gain)
    return a.select("file_id", F.when(better, F.col("best.parser")).otherwise(F.col("first.parser")).alias("parser"))


def parser_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """file_id, shared, share_a, share_b of the distinct codes of two extractors."""
    sets = lambda df, n: df.groupBy("file_id").agg(F.collect_set(norm(F.col("internal_code"))).alias(n))
    j = sets(a, "a").join(sets(b, "b"), "file_id", "full").select("file_id", F.coalesce("a", F.array().cast("array<string>")).alias("a"), F.coalesce("b", F.array().cast("array<string>")).alias("b"))
    n = F.size(F.array_intersect("a", "b"))
    return j.select("file_id", n.alias("shared"), (n / F.greatest(F.size("a"), F.lit(1))).alias("share_a"), (n / F.greatest(F.size("b"), F.lit(1))).alias("share_b"))


def misaligned_quantities(rows: DataFrame, most: int = 500, share: float = 0.35) -> DataFrame:
    """file_id, checked, suspect, misaligned: of the short quantities among the first lines, those equal to the revision or without unit.

    Texts are compared as they stand; a file without short quantities is not misaligned.
    """
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("row"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = rows.withColumn("__r", place).where(F.col("__r") <= most)
    short = F.rlike(clean("qty_text"), F.lit("^[0-9]{1,3}$"))
    odd = short & ((clean("qty_text") == clean("rev")) | (clean("um") == ""))
    a = first.groupBy("file_id").agg(F.count_if(short).alias("checked"), F.count_if(odd).alias("suspect"))
    return a.withColumn("misaligned", F.when(F.col("checked") > 0, F.col("suspect") / F.col("checked") >= share).otherwise(F.lit(False)))


def indented_rows(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Structure rows of sheets: the level is the place of the description within its block of columns.

    ``blocks`` (file_id, header_row, code0, code1, desc0, desc1, rev_col, qty_col).
    """
    j = cells.join(blocks, "file_id").where((F.col("row") > F.col("header_row")) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    first = lambda a, b: F.min(F.when((F.col("col") >= F.col(a)) & (F.col("col") <= F.col(b)), F.struct("col", "value")))
    a = j.groupBy("file_id", "row", "desc0").agg(first("code0", "code1").alias("c"), first("desc0", "desc1").alias("d"), F.min(F.when(F.col("col") == F.col("rev_col"), F.col("value"))).alias("rev"), F.min(F.when(F.col("col") == F.col("qty_col"), F.col("value"))).alias("q"))
    return a.where("d is not null").select(F.col("file_id").alias("doc_id"), F.col("row").cast("long").alias("seq"), F.regexp_replace(F.trim(F.coalesce("c.value", F.lit(""))), r"\s+", " ").alias("code"), F.trim(F.col("d.value")).alias("description"), F.coalesce("rev", F.lit("")).alias("rev"), F.coalesce(quantity(F.col("q")), F.lit(0.0)).alias("qty"), (F.col("d.col") - F.col("desc0")).alias("level"))
