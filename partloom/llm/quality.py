"""Quality rules: repetition features and divergence of histograms from language references.

A document's histogram of character classes, and that of the most common words of its language,
are compared by Jensen-Shannon distance with the sums of all documents of the language.  Short
texts have noisy histograms, so each distance only counts from a minimum length on.  Everything is
a DataFrame expression; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BLANK, let, written

#: Words in the common-word histogram of a language; one more bin takes all other words.
COMMON = 24
#: Least sizes for which a distance counts.
LEAST_CHARS, LEAST_WORDS = 400, 80
#: Greatest distances (natural logarithms, so at most 0.833).
MOST_CLASSES, MOST_COMMON = 0.27, 0.385
CLASSES = ("vowel", "lower", "upper", "digit", "stop", "mark", "symbol", "other")


def words_of(text: Column) -> Column:
    """The words of a text, without empty ones."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def repeated_words(hashes: Column) -> Column:
    """Words in windows of 8 words that the text holds twice or more, the first included.

    ``hashes``: 64-bit hashes of the words; windows are told apart by one made from those of their halves.
    """

    windows = hashes
    for step in (1, 2, 4):
        windows = let(windows, _paired(step))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            n = F.size(o)
            same = F.filter(o, lambda s, k: ((k > 0) & (o[F.greatest(k - 1, F.lit(0))]["h"] == s["h"])) | ((k < n - 1) & (o[F.least(k + 1, n - 1)]["h"] == s["h"])))
            return F.sort_array(F.transform(same, lambda s: s["i"]))

        def total(at: Column) -> Column:
            n = F.size(at)
            return F.aggregate(F.transform(at, lambda p, k: F.when(k < n - 1, F.least(F.lit(8), at[F.least(k + 1, n - 1)] - p)).otherwise(F.lit(8))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, starts), total)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _paired(step: int):
    """Hashes of each hash and the one ``step`` places later."""

    def pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    return pairs


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence, natural logarithms) of two count arrays of equal length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x: let(total(x), lambda t: F.transform(x, lambda v: F.when(t > 0, v / t).otherwise(F.lit(0.0))))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(share(a), share(b), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(total(parts) / 2, F.lit(0.0)))


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, hashes (of the words) and what the contract's base rules count, with the character classes.

    A null text has no words.  Columns of ``docs`` with other names are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    split = docs.select(F.col("doc_id"), F.col("lang"), text.alias("text"), words_of(F.col("text")).alias("words"))
    joined = split.select("doc_id", "lang", "text", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.array_join("words", "").alias("__all"))
    consonants = joined.select("*", F.regexp_replace("__all", "[aeiou]+", "").alias("__b"))
    rest = consonants.select("*", F.regexp_replace("__b", "[a-z]+", "").alias("__c"))
    n = lambda c: F.length(c).cast("long")
    strip = lambda pattern: n("__c") - n(F.regexp_replace("__c", pattern, ""))
    counted = rest.select(
        "doc_id",
        "lang",
        "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        n("__all").alias("word_chars"),
        strip(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        (n("__all") - n("__b")).alias("vowel"),
        (n("__b") - n("__c")).alias("lower"),
        strip("[A-Z]+").alias("upper"),
        strip("[0-9]+").alias("digit"),
        strip("[.,]+").alias("stop"),
        strip("[;:!?()'\"/@_+=-]+").alias("mark"),
    )
    known = sum((F.col(c) for c in CLASSES[:6]), F.lit(0)) + F.col("n_symbols")
    return counted.select(
        "doc_id", "lang", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*[F.col(c).cast("double") for c in CLASSES[:6]], F.col("n_symbols").cast("double"), (F.col("word_chars") - known).cast("double")).alias("classes"),
    )


def common_words(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """lang, common (its most frequent words) of every language that has words."""
    counted = docs.select(F.col("lang"), F.explode(words_of(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    best = counted.withColumn("__r", top).where(F.col("__r") <= common)
    return best.groupBy("lang").agg(F.sort_array(F.collect_list("w")).alias("common"))


def _word_lists(docs: DataFrame) -> DataFrame:
    listed = common_words(docs).select(F.col("lang").alias("__lang"), F.transform("common", lambda w: F.xxhash64(w)).alias("__common"))
    return written(listed, "common-words")  # stored, so Spark knows the size and broadcasts it only where it is small


def _histograms(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The base features of every row, with its counts of character classes and of its language's common words."""
    features = base_features(docs)
    hits = let(
        F.filter("hashes", lambda h: F.array_contains(F.col("__common"), h)),
        lambda found: F.transform(F.col("__common"), lambda c: (F.size(found) - F.size(F.array_remove(found, c))).cast("double")),
    )
    joined = features.join(lists, features["lang"].eqNullSafe(lists["__lang"]), "left")
    with_hits = joined.withColumn("__hits", hits)
    rest = F.col("n_words").cast("double") - F.aggregate("__hits", F.lit(0.0), lambda s, v: s + v)
    return with_hits.withColumn("commons", F.concat("__hits", F.array(rest))).drop("hashes", "__common", "__hits", "__lang")


def _references(narrow: DataFrame) -> DataFrame:
    """Sums of the histograms of each language."""
    n = len(CLASSES)
    sums = lambda c, k: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(k)])
    # a language without a word list has no words, so nothing of it is compared
    listed = narrow.where(F.col("commons").isNotNull())
    return written(listed.groupBy("lang").agg(sums("classes", n).alias("__classes"), sums("commons", COMMON + 1).alias("__commons")).withColumnRenamed("lang", "__lang"), "references")


def _judged(narrow: DataFrame, by_lang: DataFrame) -> DataFrame:
    compared = narrow.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    k = F.size("commons")
    measured = compared.select(
        "*",
        F.when(F.col("word_chars") > 0, distance(F.col("classes"), F.col("__classes"))).otherwise(F.lit(0.0)).alias("class_distance"),
        F.when(F.col("commons").isNotNull() & (F.col("n_words") > 0), distance(F.col("commons"), F.slice("__commons", F.lit(1), k))).otherwise(F.lit(0.0)).alias("common_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASSES)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("common_distance") > MOST_COMMON))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "class_distance", "common_distance", (~failed & ~far).alias("kept"))


def rate(docs: DataFrame) -> DataFrame:
    """Features, distances and the verdict of every row of ``docs``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    common_distance, kept.  Null texts and texts of few words fail the base rules.  Documents whose
    language is null form a language of their own.
    """
    narrow = written(_histograms(docs, _word_lists(docs)), "quality-features")
    return _judged(narrow, _references(narrow))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, with all columns, whatever their names.

    Features are worked out once for the references and once more for the verdict, so that no row and
    no text is stored or moved; ``docs`` is read for each: pass a table.
    """
    lists = _word_lists(docs)
    by_lang = _references(_histograms(docs.select(F.lit(None).alias("doc_id"), "text", "lang"), lists))
    every = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    judged = _judged(_histograms(docs.select(every.alias("doc_id"), "text", "lang"), lists), by_lang)
    return judged.where("kept").select("doc_id.*")


def op3_divergence_quality(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all documents."""
    from .store import documents

    return rate(documents(spark, sf_dir))
