"""Which extractor's lines a file gets: a cascade in which each one runs only on the files that are still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from .grids import misaligned_quantities
from .headers import row_flags
from .records import FIELDS, clean

# The stages in order, and weights and limits of the comparison.
PLAIN = ("tables", "tables-aggressive", "text")
TAIL, SUSPICIOUS, LEAST_GAIN, LEAST_OVERLAP, MOST_LOSS = 1.2, 2.0, 1.5, 0.55, 0.15
SKIPPED, INCOMPLETE, COVERAGE, OVERLAP, LOSS, SEVERE = 3.0, 10.0, 20.0, 12.0, 14.0, 3.0
NO_LINES = -100.0
SEVERE_STATES = ("FEW_RULES", "NO_HEADER", "NO_CODE")

Extract = Callable[[DataFrame], DataFrame]


def quality(records: DataFrame) -> DataFrame:
    """file_id, n, tail (lines with a manufacturer or its code), suspicious (lines with flags)."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    flags = row_flags([F.col(c) for c in ("description", "manufacturer", "manufacturer_code", "notes", "type")], F.col("internal_code"))
    return records.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(filled("manufacturer") | filled("manufacturer_code")).alias("tail"), F.count_if(F.size(flags) > 0).alias("suspicious"))


def overlaps(base: DataFrame, other: DataFrame) -> DataFrame:
    """file_id, overlap: the share of the base's different codes that the other has; joined code by code."""
    codes = lambda df: df.select("file_id", F.upper(clean(F.col("internal_code"))).alias("code")).where("code <> ''").distinct()
    a, b = codes(base).withColumn("a", F.lit(1)), codes(other).withColumn("b", F.lit(1))
    both = a.join(b, ["file_id", "code"], "full").groupBy("file_id").agg(F.count("a").alias("n"), F.count(F.col("a") + F.col("b")).alias("shared"))
    return both.select("file_id", F.when(F.col("n") > 0, F.col("shared") / F.col("n")).otherwise(F.lit(0.0)).alias("overlap"))


def _score(n: str, tail: str, suspicious: Column) -> Column:
    return F.when(F.col(n) > 0, F.col(n) + TAIL * F.col(tail) - SUSPICIOUS * suspicious).otherwise(F.lit(NO_LINES))


def compared(base: DataFrame, grid: DataFrame, pages: DataFrame, tried: DataFrame) -> DataFrame:
    """For each file where the grid was tried: sizes, scores, gain, what blocks it, and the choice with its reason.

    ``pages`` (file_id, page, status) as the grid left them.  The grid's score is lowered for pages
    it skipped, an incomplete parse, codes it does not share and lines it lost; it replaces lines
    only with a gain, all pages, and not both few shared codes and lost lines.
    """
    own = quality(base).select("file_id", F.col("n").alias("base_rows"), F.col("tail").alias("base_tail"), F.col("suspicious").alias("base_odd"))
    new = quality(grid).select("file_id", F.col("n").alias("grid_rows"), F.col("tail").alias("grid_tail"), F.col("suspicious").alias("grid_odd"))
    seen = pages.groupBy("file_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") != "OK").alias("skipped"), F.count_if(F.col("status").isin(*SEVERE_STATES)).alias("severe"))
    j = tried.join(own, "file_id", "left").join(new, "file_id", "left").join(seen, "file_id", "left").na.fill(0).join(overlaps(base, grid), "file_id", "left")
    coverage = F.when(F.col("pages") > 0, (F.col("pages") - F.col("skipped")) / F.col("pages")).otherwise(F.lit(0.0))
    lost = F.when(F.col("grid_rows") < F.col("base_rows"), (F.col("base_rows") - F.col("grid_rows")) / F.col("base_rows")).otherwise(F.lit(0.0))
    j = j.withColumn("overlap", F.coalesce("overlap", F.lit(1.0))).withColumn("coverage", coverage).withColumn("lost", lost)
    j = j.withColumn("complete", (F.col("grid_rows") > 0) & (F.col("skipped") == 0) & (F.col("severe") == 0))
    zero = F.lit(0.0)
    penalty = (
        SKIPPED * F.col("skipped") + F.when(F.col("complete"), 0.0).otherwise(INCOMPLETE) + COVERAGE * (1 - F.col("coverage")) + SEVERE * F.col("severe")
        + F.when(F.col("base_rows") > 0, OVERLAP * F.greatest(zero, LEAST_OVERLAP - F.col("overlap"))).otherwise(zero) + LOSS * F.greatest(zero, F.col("lost") - MOST_LOSS)
    )
    j = j.withColumn("base_score", _score("base_rows", "base_tail", F.col("base_odd"))).withColumn("grid_score", _score("grid_rows", "grid_tail", F.col("grid_odd") + F.col("severe")) - penalty)
    gain = F.col("grid_score") - F.col("base_score")
    lossy = (F.col("overlap") < LEAST_OVERLAP) & (F.col("lost") > MOST_LOSS)
    better = (gain >= LEAST_GAIN) & (F.col("coverage") >= 1) & ~lossy & F.col("complete")
    reason = (
        F.when(F.col("grid_rows") == 0, F.when(F.col("base_rows") > 0, "tables_preferred").otherwise("grid_empty")).when(F.col("base_rows") == 0, "grid_has_rows_tables_empty")
        .when(better, "quality_score_adjusted_strong_gain").when(~F.col("complete"), "tables_preferred_parse_incomplete").when(F.col("coverage") < 1, "tables_preferred_low_page_coverage")
        .when(lossy, "tables_preferred_low_overlap_row_loss").otherwise("tables_preferred_adjusted_score")
    )
    j = j.withColumn("gain", gain).withColumn("reason", reason)
    return j.select("file_id", "base_rows", "grid_rows", "base_score", "grid_score", "gain", "overlap", "coverage", "lost", "complete", "reason", F.col("reason").isin("grid_has_rows_tables_empty", "quality_score_adjusted_strong_gain").alias("grid"))


def staged_records(files: DataFrame, plain: dict[str, Extract], grid: Callable[[DataFrame], tuple[DataFrame, DataFrame]], layout: Extract, body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of all ``files`` (file_id) with their ``parser``, and a report of one row for each file.

    ``plain``: extractors of PLAIN; each gets the files that those before it left without lines.  The
    grid is tried where there are no lines, quantities look misaligned, or a table was seen
    (``body``: file_id); the layout where the grid gave no lines either.  An extractor takes files
    and gives records (file_id, page, record and FIELDS); every result is stored, so it runs once.
    """
    columns = ["file_id", "page", "record", *FIELDS.values()]
    open_files, parts = files.select("file_id").distinct(), []
    for name in PLAIN:
        found = stored(plain[name](open_files).select(*columns, F.lit(name).alias("parser")), "extracted")
        parts.append(found)
        open_files = stored(open_files.join(found, "file_id", "left_anti"), "open-files")
    base = parts[0].unionByName(parts[1]).unionByName(parts[2])
    numbered = base.select("file_id", F.struct("page", "record").alias("row"), F.col("qty").alias("qty_text"), "rev", "um")
    odd = misaligned_quantities(numbered).where("misaligned").select("file_id")
    tried = stored(open_files.unionByName(odd).unionByName(body.select("file_id").join(files.select("file_id"), "file_id", "left_semi")).distinct(), "tried-files")
    lines, pages = grid(tried)
    lines = stored(lines.select(*columns, F.lit("grid-layout").alias("parser")), "extracted")
    choice = stored(compared(base, lines, pages, tried), "compared")
    replaced = choice.where("grid").select("file_id")
    rest = choice.where("base_rows = 0 and grid_rows = 0").select("file_id")
    last = stored(layout(rest).select(*columns, F.lit("layout").alias("parser")), "extracted")
    records = base.join(replaced, "file_id", "left_anti").unionByName(lines.join(replaced, "file_id", "left_semi")).unionByName(last)
    chosen = records.groupBy("file_id").agg(F.first("parser").alias("parser"), F.count("*").alias("n_rows"))
    report = files.select("file_id").distinct().join(chosen, "file_id", "left").join(choice, "file_id", "left")
    reason = F.coalesce("reason", F.when(F.col("parser").isNotNull(), "first_with_lines"))
    return records, report.select("file_id", F.coalesce("parser", F.lit("none")).alias("parser"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), reason.alias("reason"), "base_rows", "grid_rows", "base_score", "grid_score", "gain", "overlap", "coverage", "lost", "complete")
