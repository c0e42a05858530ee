"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

A document's place is a hash of its id.  Words are summed by source and hash bucket, and
the bucket in which a source's budget ends is found from the running sums.  Only that
bucket is then summed again by the next bits of the hash, and so on; what lies below the
final threshold is taken.  No documents are sorted, and the tables that meet the
documents have a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import WORD, materialise, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Bits of the hash in each histogram; after the last, a bucket holds one document in 2**36.
LEVELS = (12, 12, 12)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """36 bits of the MD5 of the id, or of the text where there is none; other engines compute them alike."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of each source; works on a row a source.

    Resharing an excess by weight until nobody is above its cap ends where every source
    has the lesser of its cap and its weight times one common level.  With the sources
    in order of cap / weight, those before some point are full; the level follows.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    own = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (every % len(weights) + 1).cast("int")))
    own = own.withColumn("cap", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    until, everything = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("full", F.sum("cap").over(until) - F.col("cap")).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(until) + F.col("weight"))
    own = own.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    below = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return own.select("source", "source_size", F.least(F.col("cap"), F.coalesce(below * F.col("weight"), F.col("cap"))).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(text_of(docs)).alias("size"), place(docs["doc_id"], text_of(docs)).alias("place"))


def cutoffs(own: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, levels: tuple = LEVELS) -> DataFrame:
    """source, source_size, target, whole, rest and edge of each source of ``own`` (source, size, place).

    Every document is to be taken ``whole`` times, and those before the place ``edge``
    once more (all, where it is null) if ``rest`` is above 0.
    """
    goal = materialise(targets(own, weights, share, cap), "targets")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # (source, left, edge): what the budget still has from the place ``edge`` on.
    state = goal.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("edge"))
    shift = sum(levels)
    for n in levels:
        same = own["source"].eqNullSafe(state["source"]) & (F.shiftright(own["place"], shift) == F.shiftright(state["edge"], shift))
        inside = own.join(state, same).select(own["source"], "size", "place", "left")
        shift -= n
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        run = sums.withColumn("sum", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        # The boundary bucket: the first with which the running sum passes what is left.
        ends = run.where(F.col("sum") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "sum", "size", "left")).alias("at"))
        state = ends.select("source", (F.col("at.left") - F.col("at.sum") + F.col("at.size")).alias("left"), F.shiftleft(F.col("at.bucket"), shift).alias("edge"), F.col("at.size").alias("here"))
        state = materialise(state, "edges")
    # The last bucket is taken if that brings the source nearer to its target.
    edge = state.select("source", (F.col("edge") + F.when(F.col("here") < 2 * F.col("left"), 1).otherwise(0)).alias("edge"))
    out = goal.join(edge, goal["source"].eqNullSafe(edge["source"]), "left")
    return materialise(out.select(goal["source"], "source_size", "target", "whole", "rest", "edge"), "cutoffs")


def _times(has_words: Column) -> Column:
    more = F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("place") < F.col("edge"))), 1).otherwise(0)
    return F.when(has_words, F.col("whole") + more).otherwise(0).cast("long")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``.

    A source's target over its size gives the whole number of times that each of its
    documents is taken; the rest of the target is met by the documents whose place lies
    below the source's threshold, which are taken once more.  Null texts have size 0, as
    have texts without words.  Null sources are a source, the last.  Rows of one
    id share a place and are taken together, as are rows without ids that have one text.  If nothing has a word, nothing is
    taken and targets are 0.
    """
    own = materialise(sizes(docs), "sizes")
    goal = cutoffs(own, **settings)
    out = own.join(goal, own["source"].eqNullSafe(goal["source"]))
    return out.select("doc_id", "size", "source_size", "target", (_times(F.col("size") > 0) * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    Texts meet only the table of cutoffs, which has a row a source.
    """
    goal = cutoffs(materialise(sizes(docs), "sizes"), **settings).withColumnRenamed("source", "_source")
    # A row travels as one column, so names of other columns can't clash.
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), place(docs["doc_id"], text_of(docs)).alias("place"))
    has_words = F.coalesce(F.col("_row.text"), F.lit("")).rlike(WORD)
    out = own.join(goal, F.col("_row.source").eqNullSafe(F.col("_source"))).withColumn("_times", _times(has_words))
    return out.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")).select("_row.*")
