"""Source divergence audit: how the sources of a language differ in the terms they use.

Each term of a language becomes one wide row, an array of its counts by source.  Higher-order
functions read the array and emit what the term adds to each pair of sources; a map-side sum
adds these up.  Pairs of which neither source holds a term get the same share from each such
term, so that share is multiplied, not emitted.

A null text, language or source counts as ''.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import documents, written

#: Documents of a language that a kept term is in, at least; terms that are listed for a group.
LEAST_DOCUMENTS, LISTED = 10, 10
#: (language, source, term) entries that a task holds before it passes them on.
HELD = 500_000
#: Bytes of UTF-8: ASCII other than letters becomes a blank, A to Z their small letters, the rest stays.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task by language, source and term: occurrences and rows that hold the term."""
    occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
    rows: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in occurrences.items():
            terms.pop(b"", None)
            held = rows[lang, source]
            for part in slices(list(terms), 20_000):
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()), pa.array([held[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])
        occurrences.clear()
        rows.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            terms = text.translate(_BYTES).split(b" ")
            occurrences[lang, source].update(terms)
            rows[lang, source].update(set(terms))
        if sum(map(len, occurrences.values())) >= HELD:
            yield from told()
    yield from told()


def slices(items: list, size: int) -> Iterator[list]:
    return (items[k : k + size] for k in range(0, len(items), size))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) in two steps, exact while count <= total < 2^48; 1 + 0 where total is 0."""
    n = F.greatest(total, F.lit(1).cast("long"))
    scaled, step = count * F.lit(31250).cast("long"), F.lit(32000).cast("long")
    return _div(scaled, n) * step + _div(F.pmod(scaled, n) * step, n) + F.lit(1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents) of every term; texts are read and split once, and summed in the task that reads them.

    The sums of the tasks are dealt by language and term, which serves the wide rows too: one shuffle for both.
    """
    blank = F.lit("")
    named = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce("text", blank).cast("binary").alias("text"))
    sums = named.mapInArrow(_term_counts, "lang string, source string, term string, n long, d long")
    return sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each source to every other one of its language, and its own most telling terms.

    An empty table gives no rows; a language with one source only term rows; texts without terms only
    make their group occur.  Repeated rows count as often as they are there; doc_id and other columns
    are not read.  A term's row holds the counts of all sources of its language, so a row is as wide as these are many.
    """
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    groups = written(named.distinct(), "source-groups")
    numbers = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")).select("lang", F.posexplode("sources").alias("i", "source"))
    numbers = written(numbers, "source-numbers")
    entry = F.struct("i", "n").alias("e")
    terms = counted(docs).join(numbers, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(entry)).alias("entries"))
    kept = written(terms.where(F.col("d") >= least).select("lang", "term", "entries"), "kept-terms")

    totals = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.i").alias("i")).agg(F.sum("e.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    each = numbers.join(totals, ["lang", "i"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    wide = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "source", "total"))).alias("g"), F.sum("total").alias("all"))
    wide = wide.join(sizes, "lang", "left").select(
        "lang", "all", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.col("g.source").alias("sources"), F.col("g.total").alias("totals")
    )
    langs = written(wide, "source-totals")
    vectors = _vectors(kept, langs)
    return _pairs(vectors, langs).unionByName(_terms(vectors, listed))


def _vectors(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """kept with its language's totals, counts (by source number, zeros too), p (the sources' probabilities) and q (the language's)."""
    two, zero = F.lit(2).cast("long"), F.lit(0).cast("long")
    e, n = F.col("entries"), F.size("sources")
    gap = lambda x, k: x["i"] - F.when(k == 0, F.lit(-1)).otherwise(e[F.greatest(k - 1, F.lit(0))]["i"]) - 1
    dense = F.flatten(F.concat(F.transform(e, lambda x, k: F.concat(F.array_repeat(zero, gap(x, k)), F.array(x["n"]))), F.array(F.array_repeat(zero, n - 1 - F.element_at(e, -1)["i"]))))
    more = F.col("v") * 2
    counts = kept.join(langs, "lang").withColumn("counts", dense)
    return counts.select(
        "*",
        F.zip_with("counts", "totals", lambda c, t: probability(c + two, t + more)).alias("p"),
        probability(F.aggregate("counts", zero, lambda a, c: a + c) + two, F.col("all") + more).alias("q"),
    )


def _pairs(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """Part ``pair``.  A term emits each pair with a source that holds it, once; the rest is multiplied."""
    zero = F.lit(0).cast("long")
    n, p, counts = F.size("sources"), F.col("p"), F.col("counts")

    def partners(x: Column) -> Column:
        others = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j != x["i"]) & ((counts[j] == 0) | (j > x["i"])))
        return F.transform(others, lambda j: F.struct(F.least(j, x["i"]).alias("a"), F.greatest(j, x["i"]).alias("b"), distance(p[j], p[x["i"]]).alias("f")))

    emitted = vectors.select("lang", F.explode(F.flatten(F.transform("entries", partners))).alias("x"))
    sums = emitted.groupBy("lang", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.f").alias("f"), F.count("*").alias("seen"))
    without = F.transform("totals", lambda t: probability(F.lit(2).cast("long"), t + F.col("v") * 2))
    base = langs.select("lang", "v", "sources", without.alias("p0"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    base = base.select("*", F.explode(F.array_remove(F.sequence(F.lit(0), n - 1), F.col("i"))).alias("j"))
    at = lambda c, k: F.col(c)[F.col(k)]
    base = base.select(
        "lang", "v", at("sources", "i").alias("source"), at("sources", "j").alias("item"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), distance(at("p0", "i"), at("p0", "j")).alias("f0")
    )
    value = F.coalesce("f", zero) + (F.col("v") - F.coalesce("seen", zero)) * F.col("f0")
    valued = base.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return valued.withColumn("rank", F.row_number().over(_ranks()))


def _ranks() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _terms(vectors: DataFrame, listed: int) -> DataFrame:
    """Part ``term``: the first ranks only, cut down before the shuffle too."""
    p, q = F.col("p"), F.col("q")
    over = F.filter("entries", lambda x: p[x["i"]] > q)
    rows = vectors.select("lang", F.col("term").alias("item"), F.explode(F.transform(over, lambda x: F.struct(F.col("sources")[x["i"]].alias("source"), distance(p[x["i"]], q).alias("value")))).alias("x"))
    valued = rows.select("lang", "x.source", F.lit("term").alias("part"), "item", "x.value")
    return valued.withColumn("rank", F.row_number().over(_ranks())).where(F.col("rank") <= listed)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 12 over all documents."""
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occ AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
held AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, CAST(COALESCE(sum(h.n), 0) AS HUGEINT) AS total FROM groups g LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, COALESCE(h.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (COALESCE(h.n, 0) + 2)) // (t.total + 2 * s.v) AS p
  FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang LEFT JOIN held h ON h.lang = t.lang AND h.source = t.source AND h.term = k.term),
q AS (SELECT h.lang, h.term, 1 + (CAST(1000000000 AS HUGEINT) * (CAST(sum(h.n) AS HUGEINT) + 2)) // (any_value(w.total) + 2 * any_value(s.v)) AS q
  FROM held h JOIN sizes s ON s.lang = h.lang JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) w ON w.lang = h.lang GROUP BY h.lang, h.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""
