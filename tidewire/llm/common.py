"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates words everywhere in this subpackage: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the test that spares rows a shuffle (512 KB).
BITS = 1 << 22
#: A class with more than one row in so many is joined where its rows are; there are fewer than that.
HOT = 1000

_own: dict[str, str] = {}
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only with a local master, as in
    tests, may that be unset; a temporary folder of this machine is then chosen, once an
    application, and goes when Python ends.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the table of a DataFrame that ``materialise`` returned; nothing may read it any more."""
    drop(df.sparkSession, df._tidewire_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; for its end, when no result is read any more."""
    drop(spark, f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``materialise`` writes inside go at the end, but for those that the given function wrote."""
    own, outer = [], _tables.get()
    token = _tables.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _tables.set(outer)
        try:
            return materialise(df, name)
        finally:
            _tables.reset(inner)

    try:
        yield keep
    finally:
        _tables.reset(token)
        for path in own:
            drop(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, computes an expensive input once for several readers, and
    survives lost executors, because the files belong to no executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    return out


def bits(hashes: DataFrame) -> Column:
    """array<long> of ``BITS`` bits, as a scalar subquery: those set at which some ``h`` of ``hashes`` falls; its size doesn't depend on the data."""
    at = hashes.select(F.pmod("h", F.lit(BITS)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("word"))
    dense = hashes.sparkSession.range(BITS // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"])).scalar()


def maybe_in(h: Column, hashes: DataFrame) -> Column:
    """False only where ``h`` is none of the ``hashes``: the few rows that pass may then be joined."""
    place = F.pmod(h, F.lit(BITS))
    return F.call_function("getbit", F.get(bits(hashes), F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with their class; ``classes`` has a row a value of ``key``, with its number of rows as ``times``.

    Rows of large classes don't meet in one task: those are fewer than HOT, and are
    broadcast.  ``total`` is the sum of times, or a little more, where that is known.
    """
    if total is None:
        total = classes.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("times") * HOT > total))
    few = rows.join(hot.select(key), key, "left_anti").join(classes.where(F.col("times") * HOT <= total), key)
    return few.unionByName(rows.join(hot, key))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(df[column], F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
