"""Intermediate tables of an analysis, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.util import inheritable_thread_target

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; with a local master only, where it is unset, a folder of this machine that goes when Python ends."""
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


class Tables:
    """Relations that are written once for all who read them.

    They belong to no executor, so a lost one costs nothing, and what reads them has a short
    plan.  ``close`` deletes them; nothing may read them any more then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tidewire-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
        self._n = count(1)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{next(self._n)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_all(self, relations: dict[str, DataFrame]) -> dict[str, DataFrame | Exception]:
        """Several at a time, so that small stages fill the cluster; one that fails gives its exception."""

        def one(item: tuple[str, DataFrame]) -> DataFrame | Exception:
            try:
                return self.keep(item[1], item[0])
            except Exception as e:
                return e

        with ThreadPoolExecutor(max(1, len(relations))) as pool:
            return dict(zip(relations, pool.map(inheritable_thread_target(self.spark)(one), relations.items())))

    def numbered(self, df: DataFrame, *order: str) -> DataFrame:
        """``df`` with idx, each row's place in ``order`` from 1, nulls first; ties come in any order, but stay as they are.

        Rows are dealt by ranges and numbered in them; a row a range tells how many go before,
        so no task sees all rows.  An empty ``df`` gives no rows.
        """
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
        at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        dealt = self.keep(dealt.withColumns({"_range": F.spark_partition_id(), "_at": at}), "numbered")
        counts = dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
        before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")  # a row a range
        shift = F.broadcast(counts.select("_range", (before - F.col("first") + 1).alias("_shift")))
        return dealt.join(shift, "_range").withColumn("idx", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")

    def close(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
