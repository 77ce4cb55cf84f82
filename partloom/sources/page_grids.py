"""Component lines from words and ruled columns of pages.

Decoders hand over words (file_id, page, text, x0, x1, top, bottom), vertical rules (file_id, page,
x, top, bottom) and pages (file_id, page, height).  Words meet columns by an equi-join on the page and a
search in its sorted column edges, so no word is held against words or pages of other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import once
from ..plans.tables import stored
from .headers import header_name, text_flags
from .records import FIELDS, clean, column_of, position

# The band of the table, distances, and least counts of a page that continues a table.
TABLE_TOP, TABLE_BOTTOM, FOOTER = 170.0, 800.0, 55.0
X_TOLERANCE, Y_TOLERANCE, LEAST_RULES = 2.0, 3.0, 4
CONTINUED = {"words": 18, "codes": 3, "positions": 2}
MOST_MERGED = 2
CODE_LIKE = r"^[A-Z0-9][A-Z0-9._\-/]{4,}$"
MERGED = ("desc", "notes", "manufacturer", "manufacturer_code", "type")
_PAGE = ["file_id", "page"]


def band_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """A stored table of the words of the table's band that are no noise, not in the footer's band, at most one flag; with height and the column each one names."""
    said = words.withColumn("text", clean(F.col("text"))).where((F.col("text") != "") & F.col("top").between(TABLE_TOP, TABLE_BOTTOM))
    kept = said.join(pages.select(*_PAGE, "height"), _PAGE).where((F.col("height") - F.col("top") > FOOTER) & (F.size(text_flags(F.col("text"))) < 2))
    return stored(kept.withColumn("name", header_name(F.col("text"))), "band-words")


def column_edges(rules: DataFrame) -> DataFrame:
    """file_id, page, edges: sorted centres of the vertical rules of the band, those at most X_TOLERANCE apart as one."""
    from .grids import clusters

    own = rules.where((F.col("bottom") >= TABLE_TOP) & (F.col("top") <= TABLE_BOTTOM)).select(*_PAGE, "x")
    centres = clusters(own, "x", X_TOLERANCE, _PAGE).groupBy(*_PAGE, "cluster").agg(F.avg("x").alias("x"))
    return centres.groupBy(*_PAGE).agg(F.sort_array(F.collect_list("x")).alias("edges"))


def line_anchors(tops: Column, tolerance: Column) -> Column:
    """The first top of each line: a sorted top further than ``tolerance`` from the line's first one begins the next."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(F.array_distinct(tops)), none, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(F.concat(F.array(F.lit(-1e18)), a), -1) > tolerance), F.concat(a, F.array(t))).otherwise(a))


def line_of(anchors: Column, top: Column) -> Column:
    return F.size(F.filter(anchors, lambda a: a <= top))


def column_at(edges: Column, x: Column) -> Column:
    """The column (from 0) between two edges that holds x; null outside of all."""
    return once(F.size(F.filter(edges, lambda e: e <= x)) - 1, lambda k: F.when((k >= 0) & (k < F.size(edges) - 1), k))


def header_bands(words: DataFrame) -> DataFrame:
    """file_id, page, low, high: where the header of the page's table stands; pages without one are left out.

    The first line that names position, code and a third column; else the line of the best score
    that names a position and a code or quantity.
    """
    tolerance = F.greatest(F.lit(2.0), F.least(F.lit(4.5), F.avg(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))) * 0.6))
    lines = words.groupBy(*_PAGE).agg(F.collect_set(F.col("top").cast("double")).alias("tops"), F.coalesce(tolerance, F.lit(3.0)).alias("tolerance"))
    anchored = lines.select(*_PAGE, line_anchors(F.col("tops"), F.col("tolerance")).alias("anchors"))
    named = words.join(anchored, _PAGE)
    has = lambda n: F.bool_or(F.coalesce(F.col("name") == n, F.lit(False))).cast("int")
    scored = named.groupBy(*_PAGE, line_of(F.col("anchors"), F.col("top")).alias("line")).agg(*[has(n).alias(n) for n in ("pos", "code", "rev", "desc", "qty")], F.min("top").alias("low"), F.max("bottom").alias("high"))
    score = F.col("pos") + F.col("code") + F.col("rev") + F.col("desc") + F.col("qty")
    strict = (F.col("pos") + F.col("code") == 2) & (score >= 3)
    weak = (score >= 2) & (F.col("pos") == 1) & (F.col("code") + F.col("qty") > 0)
    rank = F.struct(F.when(strict, 0).otherwise(1).alias("a"), F.when(strict, 0).otherwise(-score).alias("b"), "line", (F.col("low") - F.when(strict, 3.0).otherwise(2.0)).alias("low"), (F.col("high") + 18.0).alias("high"))
    best = scored.where(strict | weak).groupBy(*_PAGE).agg(F.min(rank).alias("b"))
    return best.select(*_PAGE, "b.low", "b.high")


def page_state(words: DataFrame, usable: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """file_id, page, status, edges, map, high of every page: its columns, its own or those of the page before; ``usable`` are its ``band_words``.

    A page that has few rules or no header takes the columns or the header of the page before if
    that one had rows and this one looks like its continuation.  ``status``: OK, NO_WORDS, FEW_RULES, NO_HEADER
    or NO_CODE.  Pages of a file are folded in order, as whether a page had rows decides on the next
    one; so the words of one file meet in one row.
    """
    headed = usable.join(header_bands(usable), _PAGE, "left")
    inside = F.col("low").isNotNull() & F.col("top").between(F.col("low"), F.col("high"))
    middle = (F.col("x0") + F.col("x1")) / 2
    place = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), middle.alias("x"), "text")
    named = F.struct(F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), middle.alias("x"), "name")
    own = headed.groupBy(*_PAGE).agg(
        F.count("*").alias("words"), F.count_if(F.rlike("text", F.lit(CODE_LIKE))).alias("codes"), F.count_if(F.rlike("text", F.lit("^[0-9]{4}$"))).alias("positions"),
        F.first("high").alias("high"), F.sort_array(F.collect_list(F.when(inside & F.col("name").isNotNull(), named))).alias("heads"), F.collect_list(place).alias("all"),
    )
    raw = words.where((clean(F.col("text")) != "") & F.col("top").between(TABLE_TOP, TABLE_BOTTOM)).groupBy(*_PAGE).agg(F.count("*").alias("raw"))
    every = pages.select(*_PAGE, "height").join(raw, _PAGE, "left").join(own, _PAGE, "left").join(column_edges(rules), _PAGE, "left")
    none = F.array().cast("array<double>")
    entry = F.struct(
        "page", (F.coalesce("raw", F.lit(0)) > 0).alias("filled"), F.col("height").cast("double").alias("height"), F.coalesce("edges", none).alias("edges"),
        F.coalesce((F.col("words") >= CONTINUED["words"]) & (F.col("codes") >= CONTINUED["codes"]) & (F.col("positions") >= CONTINUED["positions"]), F.lit(False)).alias("like"),
        F.col("high").cast("double").alias("high"), "heads", "all",
    )
    files = every.groupBy("file_id").agg(F.sort_array(F.collect_list(entry)).alias("pages"))
    columns = "array<struct<name:string,col:int>>"
    start = F.struct(
        none.alias("edges"), F.array().cast(columns).alias("map"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("rows"),
        F.array().cast(f"array<struct<page:int,status:string,edges:array<double>,map:{columns},high:double>>").alias("out"),
    )

    words_of = lambda c, kind: F.coalesce(c, F.array().cast(f"array<struct<top:double,x0:double,x:double,{kind}:string>>"))

    def step(state: Column, p: Column) -> Column:
        continued = state["rows"] & F.coalesce(p["like"], F.lit(False))
        few = F.size(p["edges"]) < LEAST_RULES
        edges = F.when(few, F.when(continued & (F.size(state["edges"]) >= LEAST_RULES), state["edges"])).otherwise(p["edges"])
        return once(F.struct(edges.alias("edges"), (continued & (F.size(state["map"]) > 0)).alias("inherit")), lambda own: with_header(state, p, own))

    def with_header(state: Column, p: Column, own: Column) -> Column:
        placed = F.filter(F.transform(words_of(p["heads"], "name"), lambda h: F.struct(h["name"].alias("name"), column_at(own["edges"], h["x"]).alias("col"))), lambda h: h["col"].isNotNull())
        mapped = F.when(p["high"].isNull(), F.when(own["inherit"] & state["high"].isNotNull(), state["map"])).otherwise(placed)
        return once(mapped, lambda m: with_code(state, p, own, m))

    def with_code(state: Column, p: Column, own: Column, mapped: Column) -> Column:
        coded = F.when(column_of(mapped, "code").isNotNull(), mapped).when(own["inherit"], state["map"])
        high = F.coalesce(p["high"], state["high"], F.lit(TABLE_TOP))
        return once(F.struct(coded.alias("map"), high.alias("high")), lambda found: with_status(state, p, own["edges"], mapped, found))

    def with_status(state: Column, p: Column, edges: Column, mapped: Column, found: Column) -> Column:
        status = F.when(~p["filled"], "NO_WORDS").when(edges.isNull(), "FEW_RULES").when(mapped.isNull(), "NO_HEADER").when(found["map"].isNull(), "NO_CODE").otherwise("OK")
        pos = F.coalesce(column_of(found["map"], "pos"), F.lit(-1))
        return once(F.struct(status.alias("status"), pos.alias("pos")), lambda at: after(state, p, edges, found, at))

    def after(state: Column, p: Column, edges: Column, found: Column, at: Column) -> Column:
        def starts(w: Column) -> Column:
            col = once(column_at(edges, w["x"]), lambda c: c.isNotNull() & ((c != at["pos"]) | F.rlike(w["text"], F.lit("(?i)^([0-9]{4}|null)$"))))
            return (w["top"] > found["high"]) & (w["top"] < p["height"] - FOOTER) & col

        ok = at["status"] == "OK"
        had = ok & F.exists(words_of(p["all"], "text"), starts)
        row = F.struct(p["page"].cast("int").alias("page"), at["status"].alias("status"), F.when(ok, edges).alias("edges"), F.when(ok, found["map"]).alias("map"), F.when(ok, found["high"]).alias("high"))
        keep = lambda new, old: F.when(ok, new).otherwise(old)
        return F.struct(
            keep(edges, state["edges"]).alias("edges"), keep(found["map"], state["map"]).alias("map"), keep(found["high"], state["high"]).alias("high"),
            F.coalesce(had, F.lit(False)).alias("rows"), F.concat(state["out"], F.array(row)).alias("out"),
        )

    folded = files.select("file_id", F.explode(F.aggregate("pages", start, step, lambda s: s["out"])).alias("s"))
    return folded.select("file_id", "s.*")


def grid_records(words: DataFrame, rules: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (file_id, page, record and FIELDS), and the state of every page (file_id, page, status).

    Words below the header go to lines by their top and to columns by their middle.  A line with a
    position of four digits begins a record; what follows joins it, in long columns by a line
    break, in others where they are still empty.  Beyond two such lines only the last line counts.
    Lines without a code are left out.
    """
    kept = band_words(words, pages)
    state = stored(page_state(words, kept, rules, pages), "page-state")
    # columns by name and the long ones, looked up once for each page
    columns = F.struct(*[column_of(F.col("map"), n).alias(n) for n in FIELDS]).alias("map")
    long_columns = F.transform(F.filter("map", lambda m: m["name"].isin(*MERGED)), lambda m: m["col"]).alias("long_columns")
    usable = kept.join(state.where("status = 'OK'").select(*_PAGE, "edges", "high", columns, long_columns), _PAGE)
    body = usable.where((F.col("top") > F.col("high")) & (F.col("top") < F.col("height") - FOOTER))
    body = body.withColumn("col", column_at(F.col("edges"), (F.col("x0") + F.col("x1")) / 2))
    anchors = body.groupBy(*_PAGE).agg(line_anchors(F.collect_set(F.col("top").cast("double")), F.lit(Y_TOLERANCE)).alias("anchors"))
    placed = body.where("col is not null").join(anchors, _PAGE).select(*_PAGE, "map", "long_columns", line_of(F.col("anchors"), F.col("top")).alias("line"), "col", "x0", "text")
    cells = placed.groupBy(*_PAGE, "map", "long_columns", "line", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))
    at_pos = F.col("col") == F.coalesce("map.pos", F.lit(-1))
    lines = cells.groupBy(*_PAGE, "map", "long_columns", "line").agg(F.collect_list(F.struct("col", "text")).alias("cells"), F.bool_or(~at_pos).alias("payload"), F.bool_or(at_pos & F.rlike("text", F.lit("(?i)^([0-9]{4}|null)$"))).alias("starts"))
    order = Window.partitionBy(*_PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = lines.where("payload or starts").withColumn("record", F.sum(F.col("starts").cast("int")).over(order))
    within = Window.partitionBy(*_PAGE, "record").orderBy("line")
    counted = grouped.withColumn("k", F.row_number().over(within)).withColumn("n", F.count("*").over(Window.partitionBy(*_PAGE, "record")))
    kept = counted.where((F.col("n") <= MOST_MERGED + 1) | (F.col("k") == F.col("n")))
    each = kept.select(*_PAGE, "map", "long_columns", "record", "line", F.explode("cells").alias("c")).select(*_PAGE, "map", "long_columns", "record", "line", "c.*")
    long = F.array_contains("long_columns", F.col("col"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    merged = each.withColumn("long", long).groupBy(*_PAGE, "map", "record", "col", "long").agg(texts.alias("t"))
    merged = merged.select(*_PAGE, "map", "record", "col", clean(F.when(F.col("long"), F.array_join("t", "\n")).otherwise(F.col("t")[0])).alias("text"))
    value = lambda n: F.coalesce(F.max(F.when(F.col("col") == F.col(f"map.{n}"), F.col("text"))), F.lit(""))
    records = merged.groupBy(*_PAGE, "record").agg(*[value(n).alias(FIELDS[n]) for n in FIELDS]).where("internal_code <> ''")
    pos = F.when(F.lower("pos") == "null", "").otherwise(position(F.col("pos")))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    optional = ("type", "qty", "notes", "manufacturer", "manufacturer_code")
    out = records.select(*_PAGE, "record", *[(pos if c == "pos" else empty(c) if c in optional else F.col(c)).alias(c) for c in FIELDS.values()])
    return out, state.select(*_PAGE, "status")
