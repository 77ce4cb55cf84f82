"""Tables that cut the lineage of iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDERS: dict[tuple[str, str], str] = {}
#: Paths of the tables that the job of ``alone`` at work has stored.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, on one machine only, a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="partloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _own_folder(spark: SparkSession) -> str:
    """The folder of this application, which is deleted when the driver's Python ends."""
    shared, app = shared_folder(spark), spark.sparkContext.applicationId
    if (shared, app) not in _FOLDERS:
        _FOLDERS[shared, app] = f"{shared}/partloom-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[shared, app])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())

        def clear() -> None:
            try:
                files.delete(path, True)
            except Exception:  # the JVM may be gone by now
                pass

        atexit.register(clear)
    return _FOLDERS[shared, app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """``df`` as a table in the shared folder: it survives lost executors and is computed once.  A file has ``most`` rows at most, if that is not 0."""
    path = fresh_path(df.sparkSession, name)
    write = df.write.option("compression", "zstd")
    (write.option("maxRecordsPerFile", most) if most else write).parquet(path)
    if (on_the_way := _ON_THE_WAY.get()) is not None:
        on_the_way.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table ``store(make())``; the tables that ``make`` stored on the way to it are deleted."""
    token = _ON_THE_WAY.set(paths := [])
    try:
        df = make()
    finally:
        _ON_THE_WAY.reset(token)
    table, spark = store(df), df.sparkSession
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return table


#: A row number within a task is the part of monotonically_increasing_id below this bit.
_PLACE = 33


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``rank``, from 1 by ``order``: ranges of it are sorted and numbered apart, then moved by the sizes of those before.

    One task adds up the ranges, which are as many as shuffle partitions, not the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__m")), "ranges")
    part = F.shiftright("__m", _PLACE)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    moved = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(moved), part == F.col("__part")).select(*df.columns, (F.col("__before") + F.col("__m").bitwiseAND((1 << _PLACE) - 1) + 1).cast("int").alias("rank"))
