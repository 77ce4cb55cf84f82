"""Who a component list is: header cells of sheets, header lines of pages, folder and file names.

Cells are (file_id, row, col, value), pages (file_id, page, text); all of it is window and regular
expression work inside Catalyst, one group for each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import alnum, canonical_pn, norm, once, text

# Labels, header names by exact spelling, and header names by a part of the spelling, in order.
CODE_LABELS = ("PN", "PARTNUMBER", "PARTNO")
HEADER_NAMES = {
    "pos": ["pos", "riga", "item", "nr", "n"],
    "type": ["tipo", "type"],
    "code": ["codice", "code", "materiale", "material", "pn", "partnumber"],
    "rev": ["rev", "revisione", "revision"],
    "desc": ["descrizione", "description", "desc"],
    "um": ["um", "unit", "unita", "uom"],
    "qty": ["qty", "qta", "qt", "quant", "quantita"],
    "notes": ["note", "notes"],
    "manufacturer": ["produttore", "manufacturer", "ditta", "company", "ragsoc", "compname", "ragsoccompname", "ragionesociale", "companyname"],
    "manufacturer_code": ["codicecostruttore", "codiceproduttore", "manufacturercode", "trade"],
}
HEADER_PARTS = [
    ("qty", "^qt.{0,5}$|^(?=.{0,10}$).*quant"),
    ("rev", "revis"),
    ("desc", "descr"),
    ("code", "cod|material"),
    ("pos", "pos|riga|item"),
    ("um", "um|unit|uom"),
    ("type", "tipo|type"),
    ("notes", "note"),
    ("manufacturer_code", "costrutt|manufactur.*code|code.*manufactur|trade"),
    ("manufacturer", "manufactur|produtt|ditta|company"),
]
STRUCTURE_NAMES = {
    "CODE": ["CODE", "CODICE", "PN", "PARTNUMBER", "PARTNO"],
    "DESCRIPTION": ["DESCRIPTION", "DESCRIZIONE", "DESC"],
    "REV": ["REV", "REV.", "REVISION", "REVIS", "REVISIONS"],
    "QTY": ["QTY", "QTA", "QUANTITY", "QUANTITA", "QUANTITÀ"],
}
TOTAL_CODES = ("pn", "part", "part number", "partnumber", "internal code", "code", "codice", "codice interno", "item", "articolo")
TOTAL_QUANTITIES = ("q.ty", "qty", "qta", "quantity", "qty_total", "qty total", "quantità", "quantita", "totale")
STRONG_CODES, STRONG_QUANTITIES = ("internal code",), ("q.ty", "q ty", "q.t y")
SUSPICIOUS = {
    "footer_like": "THIS DOCUMENT CONTAINS|AUTORE|ORIGINATOR|STATO|STAGE|DATA RILASCIO|RILASCIO|RELEASE|PROPRIETA|CONFIDENZIALE",
    "signature_like": "firma digitale|digital signature|documento emesso con sistema di firma digitale",
    "page_marker": r"\b(?:Pagina|Page|Sheet)\s*[0-9]+\b",
}
CODE_REV = r"(?i)(?:Codice\s*/\s*Code|Codice|Code)\s+([A-Z0-9 _.\-]+?)\s+(?:Revisione\s*/\s*Revision|Revisione|Revision)\s+([A-Z0-9]+)"
TITLE = r"(?i)(?:Descrizione\s*/\s*Description|Descrizione|Description)\s+(.+)"
PRINTED = r"(?i)(?:Data di Stampa|Printing Date)\s*/?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})"
ROOT_CODE = r"(?i)\b(E[0-9]+)\b(?!-[0-9])"
_ACCENTS, _PLAIN = "àáâäãåèéêëìíîïòóôöõùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def _one(c: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    got = F.trim(F.regexp_extract(text(c), pattern, 1))
    return F.when(got != "", got)


def sheet_headers(cells: DataFrame, files: DataFrame, rows: int = 60, cols: int = 30, right: int = 8) -> DataFrame:
    """file_id, code, code_source, code_cell, rev, rev_source, rev_cell of each of ``files`` (file_id, name).

    The first cell, row by row, that holds a part number, or a label whose next filled cell to the
    right, at most ``right`` columns on, is taken for it; then what the file's name says.
    """
    seen = cells.where((F.col("row") <= rows) & (F.col("col") <= cols)).withColumn("t", F.trim(text(F.col("value")))).where("t <> ''")
    line = Window.partitionBy("file_id", "row").orderBy("col")
    near = F.lead("col").over(line) - F.col("col") <= right
    m = seen.withColumn("label", alnum(F.col("t"))).withColumn("next", F.when(near, F.lead("t").over(line))).withColumn("next_col", F.lead("col").over(line))
    number = F.coalesce(_one(F.col("t"), r"(?i)\bP\s*/\s*N\b\s*[:\-]?\s*([A-Z0-9\-_.]+)"), _one(F.col("t"), r"(?i)\bPN\b\s*[:\-]?\s*([A-Z0-9\-_.]+)"))
    revision = _one(F.col("t"), r"(?i)\bREV(?:ISION)?\b\s*[:\-]?\s*([A-Z0-9]+)\b")

    def first(inline: Column, label: Column, name: str) -> Column:
        value = F.coalesce(inline, F.when(label, F.col("next")))
        source = F.when(inline.isNotNull(), "sheet_inline").otherwise("sheet_label_right")
        cell = F.concat(column_letters(F.when(inline.isNotNull(), F.col("col")).otherwise(F.col("next_col"))), F.col("row").cast("string"))
        found = F.struct("row", "col", value.alias("value"), source.alias("source"), cell.alias("cell"))
        return F.min(F.when(value.isNotNull(), found)).alias(name)

    rev_label = F.startswith(F.col("label"), F.lit("REV"))
    got = m.groupBy("file_id").agg(first(number, F.col("label").isin(*CODE_LABELS), "c"), first(F.when(rev_label, revision), rev_label, "r"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    j = files.select("file_id", _one(stem, r"\b([0-9]{6,})\b").alias("fc"), _one(stem, r"(?i)\bREV\s+([A-Z0-9]+)\b").alias("fr")).join(got, "file_id", "left")

    def chosen(kind: str, own: str, named: str) -> list[Column]:
        source = F.when(F.col(own).isNotNull(), F.col(f"{own}.source")).when(F.col(named).isNotNull(), "filename_fallback").otherwise("missing_in_sheet")
        return [F.coalesce(f"{own}.value", named, F.lit("")).alias(kind), source.alias(f"{kind}_source"), F.coalesce(f"{own}.cell", F.lit("")).alias(f"{kind}_cell")]

    return j.select("file_id", *chosen("code", "c", "fc"), *chosen("rev", "r", "fr"))


def root_code(c: Column) -> Column:
    """The first ``E`` with digits that no dash and digit follow; else empty."""
    return F.upper(F.regexp_extract(F.trim(F.regexp_replace(text(c), r"[\s\x{A0}]+", " ")), ROOT_CODE, 1))


def page_headers(pages: DataFrame) -> DataFrame:
    """file_id, code, rev, title, printed, root_code, error of each file, from its first two pages; error: NO_CODE or empty."""
    joined = pages.where("page <= 2").groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("t"))
    part = lambda pattern, n=1: F.trim(F.regexp_extract("t", pattern, n))
    day = part(PRINTED)
    h = joined.select("file_id", part(CODE_REV).alias("code"), part(CODE_REV, 2).alias("rev"), part(TITLE).alias("title"), F.when(day != "", F.array_join(F.reverse(F.split(day, "/")), "-")).otherwise("").alias("printed"))
    root = F.coalesce(F.nullif(root_code(F.col("title")), F.lit("")), root_code(F.col("code")))
    return h.withColumn("root_code", root).withColumn("error", F.when(F.col("code") == "", "NO_CODE").otherwise(""))


def list_key(code: Column, rev: Column, root: Column) -> Column:
    """The key of a list: its code with the revision, else its root code."""
    return F.when(F.trim(text(code)) != "", canonical_pn(code, rev)).otherwise(canonical_pn(root, F.lit("")))


def folder_hint(name: Column) -> Column:
    """struct(base, rev) of a folder called like ``E0181296 01-06``; null otherwise."""
    pattern = r"(E[0-9]{7,8})\s*0?1\s*[-_ ]\s*([0-9]{1,2})"
    up = F.upper(text(name))
    return F.when(F.rlike(up, F.lit(pattern)), F.struct(canonical_pn(F.regexp_extract(up, pattern, 1)).alias("base"), F.regexp_extract(up, pattern, 2).alias("rev")))


def header_parts(c: Column) -> Column:
    """struct(code, rev) of ``CODE REV R``."""
    up = F.upper(F.trim(text(c)))
    at = F.instr(up, " REV ")
    return F.struct(norm(F.when(at > 0, F.substring(up, F.lit(1), at - 1)).otherwise(up)).alias("code"), F.when(at > 0, norm(F.substring(up, at + 5, F.length(up)))).otherwise("").alias("rev"))


def warned_line(c: Column) -> Column:
    """struct(parent, parent_rev, child, pos) of a warning about a missing quantity; null for other texts."""
    pattern = r"(?i)Qty mancante:\s*parent=(.+?)\s+rev\s+(.+?)\s*->\s*child=(.+?)\s*\(pos=(.*?)\)"
    part = lambda i: F.trim(F.regexp_extract(text(c), pattern, i))
    return F.when(F.rlike(text(c), F.lit(pattern)), F.struct(part(1).alias("parent"), part(2).alias("parent_rev"), part(3).alias("child"), part(4).alias("pos")))


def header_token(c: Column) -> Column:
    """Lower case letters and digits, accents and their broken forms replaced."""
    plain = F.translate(F.lower(F.trim(text(c))), _ACCENTS, _PLAIN)
    mended = F.regexp_replace(F.regexp_replace(plain, "ï¿½|i¿½", "a"), "�", "a")
    return F.regexp_replace(mended, "[^a-z0-9]+", "")


def header_name(c: Column) -> Column:
    """The column that a header cell names, by its spelling, else by a part of it; null for others."""
    return once(header_token(c), _named)


def _named(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, part in reversed(HEADER_PARTS):
        out = F.when(F.rlike(t, F.lit(part)), name).otherwise(out)
    for name, spellings in HEADER_NAMES.items():
        out = F.when(t.isin(*spellings), name).otherwise(out)
    return F.when(t != "", out)


def text_flags(c: Column) -> Column:
    """Sorted names of what a text looks like beside a component: footer, signature, page marker."""
    clean = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return once(clean, lambda t: F.array_compact(F.array(*[F.when(F.rlike(t, F.lit(f"(?i){p}")), name) for name, p in sorted(SUSPICIOUS.items())])))


def row_flags(fields: list[Column], code: Column) -> Column:
    """Sorted flags of a parsed line: contamination of its texts, and a code that looks like none."""
    said = F.transform(text_flags(F.concat_ws(" ", *[text(f) for f in fields])), lambda f: F.concat(F.regexp_replace(f, "_like$", ""), F.lit("_contamination")))
    weak = ~F.rlike(F.trim(text(code)), F.lit(r"^[A-Z0-9][A-Z0-9._\-/]{4,}$"))
    return F.array_sort(F.concat(said, F.array_compact(F.array(F.when(weak, "weak_code_pattern")))))


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters, as sheets have."""
    digit = lambda v: F.char(65 + v)
    i = n.cast("int") - 1
    two, three = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    low, mid = digit(i % 26), F.when(i >= 26, digit(two % 26)).otherwise("")
    return F.concat(F.when(i >= 702, digit(three)).otherwise(""), mid, low)


def structure_blocks(cells: DataFrame, rows: int = 250, cols: int = 120) -> DataFrame:
    """file_id, header_row, code0, code1, desc0, desc1, rev_col, qty_col, error of each sheet with a header.

    The first row that names a code and a description; error MISSING_COLUMNS if it lacks revision or quantity.
    """
    table = [(k, alias) for k, spellings in STRUCTURE_NAMES.items() for alias in spellings]
    names = cells.sparkSession.createDataFrame(table, "name string, alias string")
    hit = cells.where((F.col("row") <= rows) & (F.col("col") <= cols)).withColumn("alias", F.regexp_replace(norm(F.col("value")), r"\s+", "")).join(F.broadcast(names), "alias")
    at = lambda name: F.min(F.when(F.col("name") == name, F.col("col")))
    by_row = hit.groupBy("file_id", "row").agg(at("CODE").alias("c"), at("DESCRIPTION").alias("d"), at("REV").alias("r"), at("QTY").alias("q")).where("c is not null and d is not null")
    first = by_row.groupBy("file_id").agg(F.min(F.struct("row", "c", "d", "r", "q")).alias("h")).select("file_id", "h.*")
    return first.select(
        "file_id", F.col("row").alias("header_row"), F.col("c").alias("code0"), F.greatest("c", F.col("d") - 1).alias("code1"), F.col("d").alias("desc0"),
        F.greatest("d", F.coalesce(F.col("r") - 1, "d")).alias("desc1"), F.col("r").alias("rev_col"), F.col("q").alias("qty_col"), F.when(F.col("r").isNull() | F.col("q").isNull(), "MISSING_COLUMNS").otherwise("").alias("error"),
    )


def totals_header(cells: DataFrame, rows: int = 300) -> DataFrame:
    """file_id, row, code_col, qty_col, score: the best header row of a sheet of totals, the first of equal ones.

    A strong name counts 100, another one 10; the first row with 200 ends the search.
    """
    h = F.lower(F.trim(F.regexp_replace(text(F.col("value")), r"\s+", " ")))
    seen = cells.where(F.col("row") <= rows).withColumn("h", h).where("h <> ''")
    holds = lambda names: F.rlike("h", F.lit("|".join(n.replace(".", r"\.") for n in names)))
    at = lambda names: F.min(F.when(holds(names), F.col("col")))
    a = seen.groupBy("file_id", "row").agg(at(STRONG_CODES).alias("sc"), at(STRONG_QUANTITIES).alias("sq"), at(TOTAL_CODES).alias("wc"), at(TOTAL_QUANTITIES).alias("wq"))
    points = lambda strong: F.when(F.col(strong).isNotNull(), 100).otherwise(10)
    b = a.select("file_id", "row", F.coalesce("sc", "wc").alias("code_col"), F.coalesce("sq", "wq").alias("qty_col"), (points("sc") + points("sq")).alias("score")).where("code_col is not null and qty_col is not null")
    best = Window.partitionBy("file_id").orderBy(F.desc("score"), "row")
    return b.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def totals_file(files: DataFrame) -> DataFrame:
    """path: the first file by name, right in the base folder, that is called like totals; none if there is none."""
    name = F.upper(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.where(F.rlike(name, F.lit(r"^TOTALIZZ.*\.XLS"))).agg(F.min("path").alias("path")).where("path is not null")


def page_report(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """file_id, n_pages, n_rows, pages_with_rows, coverage, suspicious, complete of parsed files.

    ``rows`` (file_id, page, flags) of the parsed lines, ``pages`` (file_id, page).
    """
    p = pages.groupBy("file_id").agg(F.count_distinct("page").alias("n_pages"))
    r = rows.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.count_distinct("page").alias("pages_with_rows"), F.count_if(F.size("flags") > 0).alias("suspicious"))
    j = p.join(r, "file_id", "left").na.fill(0, ["n_rows", "pages_with_rows", "suspicious"])
    return j.withColumn("coverage", F.col("pages_with_rows") / F.col("n_pages")).withColumn("complete", (F.col("n_rows") > 0) & (F.col("suspicious") == 0) & (F.col("pages_with_rows") == F.col("n_pages")))


def words_by_layout(words: DataFrame, labels: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """file_id, page, line, col, text of pages without tables: words put into columns and lines by where they stand.

    ``words`` (file_id, page, text, x0, top), ``labels`` (file_id, col, x0) of the header; columns
    part in the middle between two labels, lines where tops are further apart than ``tolerance``;
    only lines with a position of four digits stay.
    """
    from .grids import clusters

    order = Window.partitionBy("file_id").orderBy("x0")
    bounds = labels.select("file_id", "col", ((F.lag("x0").over(order) + F.col("x0")) / 2).alias("low"), ((F.col("x0") + F.lead("x0").over(order)) / 2).alias("high"))
    lines = clusters(words, "top", tolerance, ["file_id", "page"]).withColumnRenamed("cluster", "line").drop("center")
    on = (lines["file_id"] == bounds["file_id"]) & (F.col("low").isNull() | (F.col("x0") >= F.col("low"))) & (F.col("high").isNull() | (F.col("x0") < F.col("high")))
    put = lines.join(bounds, on).select(lines["file_id"], "page", "line", "col", "x0", "text")
    joined = put.groupBy("file_id", "page", "line", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))
    real = words.withColumn("p", F.rlike("text", F.lit("^[0-9]{4}$")))
    kept = clusters(real, "top", tolerance, ["file_id", "page"]).groupBy("file_id", "page", F.col("cluster").alias("line")).agg(F.bool_or("p").alias("p")).where("p").drop("p")
    return joined.join(kept, ["file_id", "page", "line"], "left_semi")
