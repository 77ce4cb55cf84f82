"""Token counts with a digest cache.

The count of a text is stored under the digest of its normalised content and the digest of the
tokenizer file, so a later run, or another copy of the text, reads it instead of encoding again.
Normalising must not change the count: a null text is the empty text, nothing else is altered
(``normalise`` takes a stronger rule for tokenizers that ignore, say, letter case).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, fresh_dir, likely, written
from .tokens import encoder, slices, tokenizer_path

_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _empty_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, normalise: Callable[[Column], Column] = _empty_null) -> DataFrame:
    """doc_id, n_bytes (UTF-8 of the text as it is, null: 0) and n_tokens of every row of ``docs``.

    ``cache`` is a folder of Parquet files in a store that all executors share; without one a new
    cache is begun.  Only distinct contents that it lacks are encoded, and their counts appended:
    digests are held against the cache first, and texts move only where their digest may be missing.
    Repeated rows come out as often as they went in; an empty table gives no rows.  Copies are
    collapsed before the shuffle, so a text that a third of all rows hold moves once per task, and
    the counts are stored before rows are joined with them, so Spark can split the rows of one digest.
    """
    spark = docs.sparkSession
    cache, version = cache or fresh_dir(spark, "token-counts"), tokenizer_digest(path)
    text = normalise(F.col("text"))
    digest = F.unhex(F.sha2(text, 256))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids = encoder(path).encode_bytes
        for batch in slices(batches):
            counts = [len(ids(x)) // 4 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    narrow = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest"))
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    first = lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest")
        missing = written(narrow.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        misses = first(likely(texts, missing, "digest")).join(missing, "digest", "left_semi")
    else:
        misses = first(texts)
    counted = misses.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    with bounded_batches(spark):
        counted.write.mode("append").parquet(cache)
    stored = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return narrow.join(written(stored, "counts-by-digest"), "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op9_digest_cache_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Contract of operator 9 over all documents."""
    from .store import documents

    counted = count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
