"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

``LineIndex`` takes documents batch by batch.  A batch's lines are counted by hash and
anti-joined with the runs in turn: the hashes that no run holds are new, and are a new run;
those that are known already are a run of revisions.  So a hash stands in one run of new
ones, with its count in the batch that brought it, and only hashes that came again are ever
added up.  Runs are bucketed and sorted by hash, so a batch is shuffled once and then
merge-joined with every run as it lies.  ``FAN`` runs of a level are compacted into one of the
next, so a store of n batches has about FAN * log n runs.

A hash is the MD5 of a line without blanks around it and in lower case, 16 bytes.  Which
lines are frequent is known when all batches are in; a line's copies are then dropped but for
those in the largest document that holds it.  Only documents that lose a line meet their
lines in a join; all others are done where they are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import drop, join_classes, materialise, maybe_in, new_path, partitions, text_of

#: What is stripped around a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that a line has at least, and documents that share it.
LONG, SHARED = 40, 5
#: Runs of a level that are compacted into one of the next; buckets of a run; batches of the query.
FAN, BUCKETS, BATCHES = 3, 32, 5
RUN = "h binary, docs long, last long"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(text: Column, longest: int = LONG) -> Column:
    """Distinct hashes of the lines that are long enough."""
    keys = F.filter(F.transform(F.split(text, "\n"), key_of), lambda k: F.length(k) >= longest)
    return F.transform(F.array_distinct(keys), lambda k: F.unhex(F.md5(k.cast("binary"))))


class LineIndex:
    """Counts of line hashes, in runs under a folder of the shared file system.

    A batch is committed once its marker is written; adding it again changes nothing, and
    one that broke off is written anew.  What runs there are follows from the markers.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.fan, self.buckets = spark, path, fan, buckets
        self._names: dict[str, str] = {}

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, kind: str) -> list[str]:
        """Finished runs of a kind: their folders are named level-first-last."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at, fs = path(f"{self.path}/{kind}"), self._fs()
        if not fs.exists(at):
            return []
        return [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS"))]

    def runs(self, kind: str) -> list[tuple[int, int, int]]:
        """(level, first batch, last batch) of the runs that count: those that no run of a higher level contains."""
        every = sorted((tuple(map(int, n.split("-"))) for n in self._listed(kind)), reverse=True)
        out: list[tuple[int, int, int]] = []
        for run in every:
            if not any(a <= run[1] and run[2] <= b for _, a, b in out):
                out.append(run)
        return sorted(out, key=lambda r: r[1])

    def _table(self, kind: str, run: tuple[int, int, int]) -> DataFrame:
        """A run as a table whose buckets and order Spark knows."""
        folder = f"{self.path}/{kind}/{'-'.join(map(str, run))}"
        if folder not in self._names:
            self._names[folder] = f"tidewire_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._names[folder]} (h BINARY, docs BIGINT, last BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(self._names[folder])

    def _write(self, rows: DataFrame, kind: str, run: tuple[int, int, int]) -> None:
        """Rows that are dealt by hash already make a file a bucket; the writer sorts them."""
        folder = f"{self.path}/{kind}/{'-'.join(map(str, run))}"
        if old := self._names.pop(folder, None):
            self.spark.sql(f"DROP TABLE {old}")
        drop(self.spark, folder)
        name = f"tidewire_new_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", folder).option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def close(self) -> None:
        """Forget the tables' names; runs stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()

    def add(self, batch: int, lines: DataFrame) -> bool:
        """Count a batch of (h, doc_id), every pair once; False if it was there already.  A document is in one batch only."""
        if any(a <= batch <= b for _, a, b in self.runs("again")):
            return False
        run = (0, batch, batch)
        self._write(lines.groupBy("h").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")), "batch", run)
        own, known = self._table("batch", run), [r for r in self.runs("first") if r[2] != batch]
        fresh = reduce(lambda left, r: left.hint("merge").join(self._table("first", r), "h", "left_anti"), known, own)
        self._write(fresh, "first", run)
        self._write(own.hint("merge").join(self._table("first", run), "h", "left_anti"), "again", run)  # comes last: it says that the batch is in
        drop(self.spark, f"{self.path}/batch")
        self.compact()
        return True

    def _together(self, kind: str, runs: list[tuple[int, int, int]]) -> DataFrame:
        """Runs as one relation, read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed, which it isn't, and would group in parts."""
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/{kind}/{'-'.join(map(str, r))}" for r in runs))

    def compact(self) -> None:
        """Where a level has FAN runs, they become one of the next level."""
        for kind in ("first", "again"):
            while True:
                levels: dict[int, list[tuple[int, int, int]]] = {}
                for r in self.runs(kind):
                    levels.setdefault(r[0], []).append(r)
                full = next((rs[: self.fan] for _, rs in sorted(levels.items()) if len(rs) >= self.fan), None)
                if full is None:
                    break
                rows = self._together(kind, full)
                if kind == "again":  # new hashes are in one run each
                    rows = rows.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
                self._write(rows if kind == "again" else rows.repartition(self.buckets, "h"), kind, (full[0][0] + 1, full[0][1], full[-1][2]))

    def vacuum(self) -> None:
        """Delete runs that a compacted one contains; for when nothing reads them any more."""
        self.close()
        for kind in ("first", "again"):
            live = {"-".join(map(str, r)) for r in self.runs(kind)}
            for n in self._listed(kind):
                if n not in live:
                    drop(self.spark, f"{self.path}/{kind}/{n}")

    def frequent(self, shared: int = SHARED) -> DataFrame:
        """h, docs, last: hashes that at least ``shared`` documents hold, and the largest of these."""
        first = [self._table("first", r) for r in self.runs("first")]
        if not first:
            return self.spark.createDataFrame([], RUN)
        more = materialise(self._together("again", self.runs("again")).groupBy("h").agg(F.sum("docs").alias("more"), F.max("last").alias("later")), "more")
        parts = [f.hint("merge").join(more, "h", "left").select("h", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last")).where(F.col("docs") >= shared) for f in first]
        return reduce(DataFrame.unionByName, parts)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are to go, and how many those are."""
    small = str.maketrans(UPPER, LOWER)
    for b in batches:
        for k in range(b.num_rows):  # a text at a time, however long
            drops, kept, n = set(b["drops"][k].as_py()), [], 0
            for line in b["text"][k].as_py().split("\n"):
                key = line.strip(BLANKS).translate(small)
                if len(key) >= LONG and hashlib.md5(key.encode()).digest() in drops:
                    n += 1
                else:
                    kept.append(line)
            yield pa.RecordBatch.from_arrays([b["doc_id"].slice(k, 1), b["n_lines"].slice(k, 1), pa.array([n], pa.int64()), pa.array(["\n".join(kept)], pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, batches: int = BATCHES, shared: int = SHARED, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: documents without the lines that at least ``shared`` documents hold, which stay in the largest.

    A null text is an empty one, which has one empty line.  Lines of under LONG code points
    stay.  Rows that share a doc_id count as one document, and rows without one as one, too,
    which is smaller than any other.  A line stays wherever its largest document has it,
    however often.  Documents come in ``batches`` by a hash of their id.
    """
    spark, name = docs.sparkSession, F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # A row has each of its lines once, so only rows of a repeated id can have a pair twice.
    shared_ids = materialise(own.groupBy("doc_id").count().where("count > 1").select(name.alias("h")), "shared-ids")
    lines = own.select("doc_id", maybe_in(name, shared_ids).alias("twice"), F.explode(line_hashes(F.col("text"))).alias("h"))
    path = new_path(spark, "lines")
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("doc_id long, twice boolean, h binary, batch int").parquet(path)
    index = LineIndex(spark, new_path(spark, "line-runs"), fan, partitions(spark))
    for batch in range(batches):
        rows = lines.where(F.col("batch") == batch)
        index.add(batch, rows.where("not twice").select("h", "doc_id").unionByName(rows.where("twice").select("h", "doc_id").distinct()))
    common = materialise(index.frequent(shared), "frequent")
    index.close()
    # A line goes unless its document is the largest; the null document is the smallest.
    test = F.xxhash64("h")
    near = lines.where(maybe_in(test, common.select(test.alias("h")))).select("h", "doc_id")
    hits = join_classes(near, common.withColumn("times", F.col("docs")), "h").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last"))).where("last is not null")
    drops = materialise(hits.groupBy("doc_id").agg(F.collect_set("h").alias("drops")), "drops")  # lines of one document
    sized = own.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    touched = maybe_in(name, drops.select(name.alias("h")))
    some = sized.where(touched).withColumnRenamed("doc_id", "_id").join(drops.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")), "left")  # drops grow with the input
    changed = some.select(F.col("_id").alias("doc_id"), "n_lines", "text", F.coalesce("drops", F.array().cast("array<binary>")).alias("drops"))
    changed = changed.mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, text string")
    rest = sized.where(~touched).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "text")
    return rest.unionByName(changed)


def kept_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``dedup_lines``."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
