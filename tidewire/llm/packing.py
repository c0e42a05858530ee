"""Best-fit packing of token sequences by minimum bin slack.

Only the lengths decide which pieces share a sequence, and there are at most ``capacity``
different lengths.  So Spark counts the pieces by length; the driver packs those counts
(a table of at most ``capacity`` rows, whatever the corpus); and every piece finds its
place from its rank among the pieces of its length.

Minimum bin slack: for each bin the longest piece left is set, and a subset-sum over
bitsets of the lengths left finds the fullest combination with it, which is then removed.
Since equal lengths are alike, a combination is removed as often as the counts allow, so
the number of rounds depends on the number of lengths and not of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import materialise, partitions, text_of
from tidewire.llm.tokens import encoder, public_path, slices

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, at most as many of each as there are, with the largest sum that fits ``room``.

    Bit s of ``reach`` says that some combination of the lengths so far sums to s.
    """
    whole = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left = min(counts[length], room // length)
        take = 1
        while left:  # one, two, four, ... and the rest make any number up to the count
            take = min(take, left)
            new = (reach | reach << take * length) & whole
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            take *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= take * length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths longest first) of each combination, until every piece is placed."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        chosen = [top, *fullest(rest, capacity - top)]
        uses: dict[int, int] = {}
        for x in chosen:
            uses[x] = uses.get(x, 0) + 1
        times = min(left[x] // k for x, k in uses.items())
        out.append((times, sorted(chosen, reverse=True)))
        for x, k in uses.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for x in slices(batches):
            rows = []
            for doc, ids in zip(x["doc_id"], own.ids(x["text"].tolist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The token pieces of every row of ``docs``; only documents over ``capacity`` are cut."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return own.mapInPandas(_cut(path, end_id, capacity), PIECES)


class Places:
    """For the pieces of each length: where their ranks lie.  Bounded by the plan, not by the corpus."""

    def __init__(self, packed: list[tuple[int, list[int]]]):
        self.at: dict[int, list[np.ndarray]] = {}
        seen: dict[int, int] = {}
        rows: dict[int, list] = {}
        base = 0
        for times, lengths in packed:
            offset = 0
            done: set[int] = set()
            for x in lengths:  # equal lengths stand together
                if x not in done:
                    k = lengths.count(x)
                    rows.setdefault(x, []).append((seen.get(x, 0), base, k, offset))
                    seen[x] = seen.get(x, 0) + times * k
                    offset += k * x
                    done.add(x)
            base += times
        self.at = {x: [np.array(c, np.int64) for c in zip(*r)] for x, r in rows.items()}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, each, offset = self.at[length]
        i = np.searchsorted(first, rank, "right") - 1
        copy, slot = np.divmod(rank - first[i], each[i])
        return base[i] + copy, offset[i] + slot * length


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id long and offset long to the rows of ``cut``, which has a column length of 1 to ``capacity``.

    Ranks among equal lengths are taken within hash buckets, whose counts are then
    accumulated, so a length that many pieces have is ranked by many tasks.  Lengths that
    are null or out of range are an error of the caller; an empty table gives an empty one.
    """
    spark = cut.sparkSession
    buckets = max(64, partitions(spark))
    order = [c for c in cut.columns if c != "length"]
    own = cut.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = own.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if counts and not all(x is not None and 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))  # bounded by the number of lengths
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = own.withColumn("_rank", rank.cast("long")).join(before, ["length", "_bucket"]).select(*cut.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(), x.pop("_rank").to_numpy()
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            by = np.argsort(length, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(x) else []:
                sequence[part], offset[part] = places.value.find(int(length[part[0]]), rank[part])
            yield x.assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack every row of ``docs``.

    A null or empty text is its end id alone, a piece of length 1.  Null ids and repeated
    rows are packed like any other.  Other columns of ``docs`` are not read.
    """
    return pack(materialise(pieces(docs, path or public_path(TOKENIZER), end_id, capacity), "pieces"), capacity)
