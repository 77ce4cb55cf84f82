"""Part-number, revision and quantity expressions; all run inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,12)"

# Unit spellings of the piece, and other units' names.
PIECE_UNITS = ("NR", "N", "N°", "PZ", "PZA", "PZI", "PC", "PCS", "EA", "EACH", "PCE", "PZ.")
UNIT_NAMES = {"MT": "M", "M": "M", "GR": "GR", "G": "GR", "LT": "L", "L": "L", "MM": "MM", "CM": "CM", "KG": "KG", "ML": "ML"}
DOCUMENT_TYPES = ("DD", "DOC", "DOCUMENTO", "DISEGNO", "DRAWING", "DWG")
DOCUMENT_UNITS = ("REF", "REFERENCE", "DOC", "DOCUMENT", "DWG")
DOCUMENT_SUFFIXES = ("ASSD", "MCHD", "PRTL", "ELTD", "OUTL", "USRM", "TCHS", "GRBF", "PCBD", "POST", "POSB", "MFGS")
LOOKUP_SUFFIXES = ("ASSY", "PRTL", "ASSD", "ELTD", "BLKD", "DS")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def norm(c: Column) -> Column:
    """Upper case, without white space at the ends; null becomes empty."""
    return F.upper(F.regexp_replace(text(c), r"^\s+|\s+$", ""))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def canonical_pn(code: Column, suffix: Column | None = None) -> Column:
    """Part number with its two-digit suffix behind a dash; a given suffix replaces the parsed one."""
    cleaned = F.struct(F.regexp_replace(norm(code), r"\s+", " ").alias("code"), (norm(suffix) if suffix is not None else F.lit("")).alias("suffix"))
    return once(cleaned, lambda v: _shaped_pn(v["code"], v["suffix"]))


def _shaped_pn(c: Column, s: Column) -> Column:
    spaced, compact = r"^([A-Z]{1,3}[0-9]{4,})[\s\-_/.]+([0-9]{2})$", r"^([A-Z]{1,3}[0-9]{7,})([0-9]{2})$"
    ending = lambda p: F.concat(F.regexp_extract(c, p, 1), F.lit("-"), F.when(s != "", s).otherwise(F.regexp_extract(c, p, 2)))
    joined = F.array_join(F.filter(F.split(c, r"[\s\-_/.]+"), lambda x: x != ""), "-")
    whole = lambda parts: (parts == "") | (s == "") | (parts == s) | F.endswith(parts, F.concat(F.lit("-"), s))
    plain = once(joined, lambda parts: F.when(whole(parts), parts).otherwise(F.concat(parts, F.lit("-"), s)))
    return F.when(F.rlike(c, F.lit(spaced)), ending(spaced)).when(F.rlike(c, F.lit(compact)), ending(compact)).otherwise(plain)


def unit(c: Column, names: dict[str, str] = UNIT_NAMES) -> Column:
    """Spellings of the piece become NR; other known units their short name; the rest upper case."""
    u = norm(c)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(u.isin(*PIECE_UNITS), F.lit("NR")).otherwise(F.coalesce(F.element_at(table, u), u))


def rev_order(rev: Column) -> Column:
    """Struct whose order is that of revisions: empty, irregular, then letters and number."""
    return once(norm(rev), _rev_struct)


def _rev_struct(r: Column) -> Column:
    regular = F.rlike(r, F.lit("^[A-Z]*[0-9]*$"))
    return F.struct(
        F.when(r == "", 0).when(regular, 2).otherwise(1).alias("kind"),
        F.when(regular, F.regexp_extract(r, "^([A-Z]*)", 1)).otherwise(r).alias("letters"),
        F.when(regular, F.coalesce(F.regexp_extract(r, "([0-9]*)$", 1).try_cast("bigint"), F.lit(-1))).otherwise(F.lit(-1)).alias("number"),
    )


def digit_root(code: Column) -> Column:
    """First run of at least six digits, anywhere; else empty."""
    return F.regexp_extract(text(code), "([0-9]{6,})", 1)


def leading_root(code: Column) -> Column:
    """At least six leading digits, else null."""
    got = F.regexp_extract(norm(code), "^([0-9]{6,})", 1)
    return F.when(got != "", got)


def alnum_root(code: Column) -> Column:
    return digit_root(alnum(code))


def rev_in_text(c: Column) -> Column:
    return F.regexp_extract(F.upper(text(c)), r"\bREV\s*[-_ .]*([A-Z0-9]+)\b", 1)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s)))


def digit_match(a: Column, b: Column) -> Column:
    """Longest common prefix over all pairs of digit runs."""
    runs = lambda c: F.regexp_extract_all(text(c), F.lit("[0-9]+"), F.lit(0))
    found = F.flatten(F.transform(runs(a), lambda x: F.transform(runs(b), lambda y: common_prefix(x, y))))
    return F.coalesce(F.array_max(found), F.lit(0))


def strength(match: Column, target_rev: Column, file_rev: Column, least: int = 6) -> Column:
    t, f = alnum(target_rev), alnum(file_rev)
    return F.when(match < least, "NO_MATCH").when((t != "") & (f != "") & (t != f), "NO_MATCH").when((t != "") & (t == f), "STRONG").otherwise("MEDIUM")


def match_score(kind: Column, match: Column) -> Column:
    return F.when(kind == "STRONG", 1.0).when(kind == "MEDIUM", 0.7).otherwise(0.0) + F.least(match, F.lit(12)) / 100.0


def quantity(c: Column, kind: str = "double") -> Column:
    """Number with comma or dot; null for empty, ``-``, NaN, formulas and anything else."""
    t = F.regexp_replace(F.regexp_replace(text(c), ",", "."), r"\s+", "")
    return F.when(F.lower(t).isin("", "-", "nan"), None).otherwise(t.try_cast(kind))


def strip_lookup_suffix(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^(.+?)({'|'.join(LOOKUP_SUFFIXES)})$", "$1")


def line_kind(kind: Column, description: Column, unit_: Column, qty: Column) -> Column:
    """DOCUMENT_REF, UNKNOWN (no quantity) or MATERIAL."""
    document = norm(kind).isin(*DOCUMENT_TYPES) | F.rlike(norm(description), F.lit("DISEGNO|DRAWING|DOCUMENT")) | norm(unit_).isin(*DOCUMENT_UNITS)
    return F.when(document, "DOCUMENT_REF").when(qty.isNull(), "UNKNOWN").otherwise("MATERIAL")


def looks_like_document(code: Column) -> Column:
    return F.rlike(alnum(code), F.lit(f"({'|'.join(DOCUMENT_SUFFIXES)})$"))


def quantized(value: Column, steps: list[float], tolerance: float = 0.02) -> Column:
    """struct(value, status): the first step with a multiple near the value, else three decimals to check."""
    tried = F.array(*[F.struct((F.floor(value / s + 0.5) * s).alias("value"), F.abs(F.floor(value / s + 0.5) * s - value).alias("off")) for s in steps])
    hit = F.get(F.filter(tried, lambda t: t["off"] <= tolerance), F.lit(0))
    return F.struct(F.coalesce(hit["value"], F.bround(value, 3)).alias("value"), F.when(hit.isNull(), "CHECK").otherwise("OK_STEP").alias("status"))


def plain_number(c: Column) -> Column:
    """Fixed-point text without trailing zeros."""
    t = c.cast("string")
    return F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
