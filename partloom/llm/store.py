"""Tables that cut lineage, prefix sums without a single-task window, and small helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import alone, stored
from ..plans.tables import fresh_path as fresh_dir

#: White space of the contracts, as a class of Java's and Python's regular expressions.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
#: Bytes of a batch that goes to a Python worker, about: very long texts come in few at a time.
BATCH_BYTES = 8 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written: small batches to Python, and shuffle files go when the write has ended."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) if name.endswith("Batch") else spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def written(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and is computed once.  A file has ``most`` rows at most, if that is not 0."""
    with bounded_batches(df.sparkSession):
        return stored(df, name, most)


def numbered(docs: DataFrame) -> DataFrame:
    """A stored table of the rows of ``docs``: row, a number of its own for each, and doc, a struct of all columns.

    With it a decision on a row finds its way back whatever ids are null or repeat, and however
    columns are called.
    """
    every = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return written(docs.select(F.monotonically_increasing_id().alias("row"), every.alias("doc")), "numbered")


def decided(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table of ``make()``, without those that were written on the way to it."""
    return alone(make, lambda df: written(df, name))


def told(rows: DataFrame, numbers: DataFrame, column: str, bits: int = 1) -> DataFrame:
    """``rows`` with the ``column`` of ``numbers`` (row, column), whole numbers of ``bits`` (a power of two) bits; 0 where there is none.

    Rows stay where they are: their numbers are broadcast, packed into words of 64 bits, so 2 MB of bits for 16 million rows.
    """
    lanes = 64 // bits
    word, place = F.shiftright("row", lanes.bit_length() - 1), (F.col("row").bitwiseAND(lanes - 1) * bits).cast("int")
    shifted = F.call_function("shiftleft", F.col(column).cast("long"), place)
    packed = numbers.groupBy(word.alias("__word")).agg(F.bit_or(shifted).alias("__bits"))
    own = F.call_function("shiftrightunsigned", F.col("__bits"), place).bitwiseAND((1 << bits) - 1)
    return rows.join(F.broadcast(packed), word == F.col("__word"), "left").select(*rows.columns, F.coalesce(own, F.lit(0)).cast("long").alias(column))


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be in ``wanted``: a bitmap of 2^24 bits, 4 MB whatever the input, is broadcast.

    It only keeps rows that cannot match out of the exact join that follows.
    """
    h = F.xxhash64(key)
    place, bit = F.pmod(h, F.lit(1 << 18)).alias("__place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int"))
    bitmap = wanted.select(place, bit.alias("__bit")).groupBy("__place").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.select("*", place, bit.alias("__bit")).join(F.broadcast(bitmap), "__place")
    return marked.where(F.col("__bits").bitwiseAND(F.col("__bit")) != 0).select(*rows.columns)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made; nothing may read it afterwards."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def before(totals: DataFrame, order: str, sums: list[str], within: list[str] | None = None, group: int = 1024) -> DataFrame:
    """``totals`` with ``before_<c>``: the sum of each c over the rows of smaller ``order``.

    ``order`` is an integer from 0, unique within the columns ``within``.  Two levels of windows:
    rows in runs of ``group``, then the runs, so a task gets at most ``group`` rows, or one row
    for each run.
    """
    within = within or []
    marked = totals.withColumn("__run", F.floor(F.col(order) / F.lit(group)))
    inner = Window.partitionBy(*within, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = marked.groupBy(*within, "__run").agg(*[F.sum(c).alias(f"__run_{c}") for c in sums])
    outer = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*within, "__run", *[F.coalesce(F.sum(f"__run_{c}").over(outer), F.lit(0)).alias(f"__base_{c}") for c in sums])
    inner_sums = marked.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__in_{c}") for c in sums])
    keys = [*within, "__run"]
    on = [inner_sums[k].eqNullSafe(runs[k]) for k in keys]
    joined = inner_sums.join(runs, on)
    return joined.select(
        *[inner_sums[c] for c in totals.columns],
        *[(F.col(f"__in_{c}") + F.col(f"__base_{c}")).alias(f"before_{c}") for c in sums],
    )


def let(value, body):
    """``body(value)`` with ``value`` computed once for each row, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
