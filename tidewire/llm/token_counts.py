"""Token counts by source, language and tokenizer version, maintained from deltas.

A store has two kinds of tables in the shared file system, one folder a batch:

* ``ledger/batch=<id>``: the documents that the batch touched, with their counts after it;
  a deleted document has a row without counts.
* ``deltas/batch=<id>``: what the batch adds to the totals, signed and summed by key.

Totals are the sum of all deltas, so a batch is committed by writing its delta and never
rewrites a total.  The ledger is written first and the delta last.  A batch whose delta
is complete is committed, and committing it again changes nothing; one that broke off
before is simply written anew.  A document's former counts are found in the ledger's rows
of the batch's documents, by their latest batch.  ``compact`` writes ledger and totals as
one batch each, so reads and commits need not open every batch there ever was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import drop, materialise, new_path, text_of
from tidewire.llm.tokens import encoder, public_path, slices

#: Tokenizer versions and their files: that of a first load, and all public ones.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json"}
PUBLIC = {**VERSIONS, "word_bpe_49k": "word_bpe_49k.json"}
KEY = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, n_tokens long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, version and n_tokens: a row a row of ``docs`` and version."""
    paths = {v: public_path(f) for v, f in (versions or VERSIONS).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in slices(batches):
            texts = x["text"].tolist()
            for version, path in paths.items():
                yield x.drop(columns="text").assign(version=version, n_tokens=[len(i) // 4 for i in encoder(path).ids(texts)])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), text_of(docs).alias("text"))
    return own.mapInPandas(run, LEDGER)


class Rollup:
    """Totals under ``path``; batches are named by integers that rise."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _batches(self, kind: str) -> list[int]:
        """Batches of which a table is complete: Spark marks those with _SUCCESS."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        frame = self.spark.read.schema(f"{schema}, batch long")
        whole = self._batches(f"{kind}_whole")
        held = [b for b in whole if b == batches[0]]  # a compacted batch stands for itself and all before
        rest = batches[len(held) :]
        parts = [frame.option("basePath", f"{self.path}/{k}").parquet(*(f"{self.path}/{k}/batch={b}" for b in own)) for k, own in ((f"{kind}_whole", held), (kind, rest)) if own]
        return reduce(DataFrame.unionByName, parts)

    def current(self, before: int, only: DataFrame | None = None) -> DataFrame:
        """The ledger as the committed batches below ``before`` have left it; deleted documents are without version.

        With ``only``, of the documents in its column doc_id: the ledger's rows of other
        documents are then left out before their latest batch is looked for.
        """
        rows = self._read("ledger", LEDGER, self._live("ledger", before))
        if only is not None:
            rows = rows.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        # A document has few rows a batch, so those of its latest are found in one grouping.
        last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.collect_list(F.struct("batch", "source", "lang", "version", "n_tokens")).alias("rows"))
        kept = F.filter("rows", lambda r: r["batch"] == F.col("batch"))
        return last.select("doc_id", F.explode(kept).alias("r")).select("doc_id", "r.source", "r.lang", "r.version", "r.n_tokens")

    def _live(self, kind: str, before: int | None = None) -> list[int]:
        """Committed batches, below ``before`` if given, from the latest compacted one on: that holds all up to it."""
        done = [b for b in self._batches("deltas") if before is None or b < before]
        last = max((b for b in self._batches(f"{kind}_whole") if b in done), default=None)
        return done if last is None else [b for b in done if b >= last]

    def compact(self) -> None:
        """Write ledger and totals as of the latest batch as one batch each, which later reads start from.

        The batches before stay where they are until ``vacuum``, so a reader that has
        begun is not disturbed; a compaction that breaks off is written anew.
        """
        done = self._batches("deltas")
        if done and done[-1] not in self._batches("ledger_whole"):
            self.current(done[-1] + 1).where("version is not null").write.mode("overwrite").parquet(f"{self.path}/ledger_whole/batch={done[-1]}")
        if done and done[-1] not in self._batches("deltas_whole"):
            self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas_whole/batch={done[-1]}")

    def vacuum(self) -> None:
        """Delete the ledgers of batches that a compacted one holds; deltas stay, for they say what is committed."""
        whole = self._batches("ledger_whole")
        for b in self._batches("ledger"):
            if whole and b <= whole[-1]:
                drop(self.spark, f"{self.path}/ledger/batch={b}")
        for b in whole[:-1]:
            drop(self.spark, f"{self.path}/ledger_whole/batch={b}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, version, n_tokens); False if the batch was committed before.

        ``upsert`` rows state all counts that a document has from now on, one a version;
        they insert or revise.  ``delete`` rows remove a document; only their doc_id
        counts.  A document that a batch both deletes and upserts stays as upserted;
        deleting one that isn't there changes nothing.  Repeated rows count once; of
        differing rows of one document and version, the one with most tokens counts.
        Changes without a doc_id name no document and are left out.
        """
        if batch in (done := self._batches("deltas")):
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        rows = changes.where("doc_id is not null and op in ('upsert', 'delete')")
        after = rows.where("op = 'upsert'").groupBy("doc_id", "version").agg(F.max(F.struct("n_tokens", "source", "lang")).alias("m"))
        after = after.select("doc_id", "m.source", "m.lang", "version", "m.n_tokens")
        gone = rows.where("op = 'delete'").select("doc_id").distinct().join(after.select("doc_id"), "doc_id", "left_anti")
        gone = gone.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("version", "string"), ("n_tokens", "long"))))
        ledger = f"{self.path}/ledger/batch={batch}"
        after.unionByName(gone).write.mode("overwrite").parquet(ledger)
        new = self.spark.read.schema(LEDGER).parquet(ledger)
        plus = new.where("version is not null").withColumn("sign", F.lit(1))
        minus = self.current(batch, new).where("version is not null").withColumn("sign", F.lit(-1))
        delta = plus.unionByName(minus).groupBy(*KEY).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        delta.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; keys whose documents are all gone are left out."""
        sums = self._read("deltas", DELTA, self._live("deltas")).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


def _loaded(docs: DataFrame, versions: dict[str, str] | None) -> tuple[Rollup, DataFrame]:
    """A store after three batches, and the counts of all documents by the versions.

    Documents come in with their number of characters for a count, which the second batch
    revises to that of tokens; the third removes exact copies.  Each is committed twice.
    """
    spark, first = docs.sparkSession, next(iter(versions or VERSIONS))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    counts = materialise(count_tokens(docs, versions).withColumn("op", F.lit("upsert")), "counts")
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.sha2(text_of(docs).cast("binary"), 256).alias("h"), F.length(text_of(docs)).cast("long").alias("n_tokens"))
    own = materialise(own, "digests")
    # Copies are the documents that are the first of no text; found by their ids, so a common text is no common key.
    firsts = own.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    copies = own.select("doc_id").distinct().join(firsts, "doc_id", "left_anti")
    rough = own.select(F.lit("upsert").alias("op"), "doc_id", "source", "lang", F.lit(first).alias("version"), "n_tokens")
    gone = copies.select(F.lit("delete").alias("op"), "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("version", "string"), ("n_tokens", "long"))))
    for _ in range(2):
        for batch, changes in enumerate((rough, counts.where(F.col("version") == first), gone), 1):
            rollup.commit(batch, changes)
    return rollup, counts


def maintained(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """Totals of ``docs`` after a first load, a revision of its counts, a removal of exact copies, and a replay of all.

    The first batch inserts every document, the second revises its count by the first
    version, the third deletes the documents that are the first of no text, and all are
    committed again, which changes nothing.  So the totals are those of the distinct
    texts, under their first document's source and language.  Rows without a doc_id are
    no documents.
    """
    return _loaded(docs, versions)[0].totals()


def restored(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """Totals of all ``docs`` by all versions, after the batches of ``maintained``, a compaction and another revision.

    The fourth batch states the counts of every document by every version: it inserts the
    deleted copies again and revises the others, which had the first version only.  It is
    committed twice, too, over the compacted ledger.
    """
    rollup, counts = _loaded(docs, versions or PUBLIC)
    rollup.compact()
    for _ in range(2):
        rollup.commit(4, counts)
    return rollup.totals()
