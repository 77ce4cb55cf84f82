"""Personal data: base patterns, and terms that reveal them by corpus co-occurrence.

Emails, IP addresses, card and telephone numbers are the protected entities.  A term of a
document that holds an entity reveals it when knowing the term says almost as much as the entity itself: with document
frequencies over the whole corpus, PMI(entity, term) >= IC(entity) / ALPHA.  The share of a term's
documents that hold the entity is shrunk towards the entity's share of all documents by PRIOR
documents, so small counts weigh less, but entities that occur once are judged too.  Such terms are
removed or generalised wherever they stand in the documents that hold the entity.  All of it is
DataFrame expressions, in time about proportional to a text's length however many spans it has;
only texts that hold entities are shuffled, or where sanitised texts are asked for and too many
were found to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import decided, let, numbered, told, written

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
#: A term is disclosing if its PMI, smoothed by PRIOR documents, reaches the entity's information over ALPHA.
ALPHA, PRIOR = 1.2, 1.0
TERM = r"[\p{L}\p{N}]++"

# The contract's patterns with possessive repeats, which match the same and neither recurse nor
# start again within a run of the same characters.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Characters of a block that texts are cut into while spans are replaced.
_BLOCK = 1024
_FOUND = "array<struct<start:int,end:int,value:string>>"


def running(values: Column, step, neutral: int) -> Column:
    """Running ``step`` (sum or greatest) of an int array, by doubling: n log n steps, nothing is appended."""
    ints = lambda a: a.cast("array<int>")

    def doubled(a: Column, k: Column) -> Column:
        shift = F.call_function("shiftleft", F.lit(1), k)
        earlier = F.concat(F.array_repeat(F.lit(neutral), shift), F.slice(a, F.lit(1), F.size(a) - shift))
        return ints(F.zip_with(a, earlier, step))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    return F.when(F.size(values) > 1, F.aggregate(rounds, ints(values), doubled)).otherwise(ints(values))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: start, end (code points, exclusive) and value."""

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda a, b: F.char_length(a) + F.char_length(b))
        ends = let(steps, lambda s: running(s, lambda a, b: a + b, 0))
        return F.zip_with(ends, found, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(_FOUND)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def counted(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + counted(i)) % 10 == 0


def _valid(kind: int):
    if kind == 1:
        return lambda m: F.forall(F.split(m["value"], r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) < 3) | ((F.char_length(q) == 3) & (q <= "255"))))
    if kind == 2:
        return lambda m: let(_digits(m["value"]), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == 3:
        return lambda m: F.char_length(_digits(m["value"])).between(9, 15)
    return lambda m: F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind, end, value); kinds are places in ``KINDS``."""

    def found(kind: int, pattern: str, sign: str) -> Column:
        of_kind = F.transform(F.filter(matches(text, pattern), _valid(kind)), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        return F.when(F.contains(text, F.lit(sign)), of_kind).otherwise(none) if sign else of_kind

    return F.sort_array(F.concat(found(0, EMAIL, "@"), found(1, IP, "."), found(2, CARD, ""), found(3, PHONE, "+")))


def _filled(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(start, end, kind, at)`` in place of each sorted span; what lies between stays.

    ``at``: the greatest end of the spans before, up to which the text is done.  The text is cut
    into blocks first, so that a place is found without counting from the text's beginning.
    """

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / _BLOCK).cast("int"), F.floor((b - 1) / _BLOCK).cast("int")
        inner = lambda i, x, y: F.substring(F.get(blocks, i), (x - i * _BLOCK + 1).cast("int"), (y - x).cast("int"))
        middle = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
        several = F.concat(inner(first, a, (first + 1) * _BLOCK), middle, inner(last, last * _BLOCK, b))
        return F.when(b <= a, F.lit("")).when(first == last, inner(first, a, b)).otherwise(several)

    def made(parts: Column) -> Column:
        blocks, reached = parts["blocks"], parts["reached"]
        before = F.concat(F.array(F.lit(0)), reached)
        pieces = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, at: F.concat(cut(blocks, at, s["start"]), fill(s["start"], s["end"], s["kind"], at)))
        return F.concat(F.array_join(pieces, ""), cut(blocks, F.element_at(before, -1), F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    reached = let(F.transform(spans, lambda s: s["end"]), lambda e: running(e, lambda a, b: F.greatest(a, b), 0))
    return let(F.struct(blocks.alias("blocks"), reached.alias("reached")), made)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, so that all else stays where it is."""
    return _filled(text, spans, lambda start, end, kind, at: F.repeat(F.lit(" "), F.greatest(end - F.greatest(start, at), F.lit(0))))


def _lowered(text: Column) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def find_personal(docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """doc_id, text_hash, spans (sorted; start, kind, end) of every row of ``docs``.

    Null texts count as empty; empty tables give no rows.  Equal rows come out as often as they
    went in.  Whatever other columns ``docs`` has is ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    spotted = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("spans"))
    base = written(
        spotted.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, blanked(F.col("text"), F.col("spans"))).alias("rest")),
        "personal",
    )
    holders = base.where(F.col("rest").isNotNull()).withColumn("entities", F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], s["value"]))))
    of_entity = written(holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    most = of_entity.agg(F.max("n_entity")).first()[0]
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    if most is None:
        return base.select("doc_id", "text_hash", plain.alias("spans"))
    total = float(base.count())
    # PMI needs (n_term + prior) <= (n_both + prior * share) * (1 / share) ^ (1 - 1 / alpha), and n_both is at most n_entity
    reach = lambda n_both, n_entity: (n_both + n_entity * (prior / total)) * F.pow(F.lit(total) / n_entity, F.lit(1 - 1 / alpha)) * (1 + 1e-9) - prior
    frequency = rows.select(F.explode(_lowered(F.col("text"))).alias("value")).groupBy("value").agg(F.count("*").alias("n_term"))
    frequency = frequency.where(F.col("n_term") <= reach(F.lit(most), F.lit(most)))
    terms = F.filter(_lowered(F.col("rest")), lambda t: (F.char_length(t) >= 3) & F.rlike(t, F.lit(r"\p{L}")))
    rare = holders.select("doc_id", "text_hash", "entities", F.explode(terms).alias("value")).join(frequency, "value")
    pairs = rare.select("doc_id", "text_hash", "value", "n_term", F.explode("entities").alias("entity")).join(of_entity, "entity")
    pairs = written(pairs.where(F.col("n_term") <= reach(F.col("n_entity"), F.col("n_entity"))), "candidate-terms")
    both = pairs.groupBy("entity", "value").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    flagged = both.where(F.col("n_term") <= reach(F.col("n_both"), F.col("n_entity"))).select("entity", "value")
    told = written(pairs.join(flagged, ["entity", "value"]).select("doc_id", "text_hash", "value").distinct(), "revealing-terms")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    of_told = told.select("doc_id", "text_hash").distinct()
    texts = holders.select("doc_id", "text_hash", "rest").join(of_told, same(holders, of_told), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    seen = texts.select("doc_id", "text_hash", F.explode(matches(F.col("rest"), TERM)).alias("m"))
    hits = seen.join(told, same(seen, told) & (F.lower(seen["m.value"]) == told["value"]), "left_semi")
    more = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(F.col("m.start").alias("start"), F.lit(4).alias("kind"), F.col("m.end").alias("end"))).alias("more"))
    more = written(more, "term-spans")
    joined = base.join(more, same(base, more), "left")
    every = F.when(more["more"].isNull(), plain).otherwise(F.sort_array(F.concat(plain, more["more"])))
    return joined.select(base["doc_id"], base["text_hash"], every.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind's label; overlapping spans by the first one's."""
    label = lambda kind: F.element_at(F.array(*[F.lit(x) for x in LABELS]), kind + 1)
    return _filled(text, spans, lambda start, end, kind, at: F.when(start >= at, label(kind)).otherwise(F.lit("")))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in ``text``; all columns and rows stay.

    Null texts stay null; texts without personal data are unchanged; ids may be null or repeat.
    n_chars, where there is one, follows a changed text.
    """
    rows = numbered(docs)
    texts = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    found = decided(lambda: find_personal(texts).where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans"), "sanitise-spans")
    # only texts with spans travel to them
    marked = told(rows, found.select("row", F.lit(1).alias("spotted")), "spotted")
    clean = marked.where("spotted = 0").select("row", "doc", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    joined = clean.unionByName(marked.where("spotted = 1").select("row", "doc").join(found, "row"))
    old = F.col("doc.text")
    changed = {"text": F.when(F.col("spans").isNull(), old).otherwise(redacted(old, F.col("spans")))}
    if "n_chars" in docs.columns:
        n = F.char_length(changed["text"]).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(n)
    return joined.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op8_disclosure_sanitisation(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all documents."""
    from .store import documents

    found = find_personal(documents(spark, sf_dir))
    name = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
