"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints that differ in few bits agree in whole blocks of bits, so each distinct
fingerprint is filed under every choice of agreeing blocks (64 bits in ``MAX_BITS + 2``
blocks, of which two must agree).  Under one key the fingerprints are sorted by Gray
rank; runs of neighbours share most bits, so every node of the hierarchy stores the bits
its members have in common, and a pair of nodes whose common bits already differ in more
than ``MAX_BITS`` places is dropped with all that lies below.  A pair of nodes that
cannot differ in more places is linked as a whole, without looking at its members.

Keys with many fingerprints don't stay in one task: they are cut into pages of
``PAGE`` Gray neighbours, the pages are joined by key where their common bits allow it,
and each surviving pair of pages is a unit of work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewire.llm.common import join_classes, materialise, maybe_in, partitions, text_of
from tidewire.llm.graph import connected_components, forest

MAX_BITS = 4
SHINGLE = 4
SEED = 42
PAGE = 1024
FAN = 8
#: Pairs of nodes that are opened at a time; bounds the memory of a task.
OPEN = 8192


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"doc_id": x["doc_id"], "fp": [fingerprint(t) for t in x["text"]]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(_fingerprints, "doc_id long, fp long")


@F.pandas_udf(LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return text.map(fingerprint).astype("int64")


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order, up to where the order begins."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def block_keys(fp: Column, bits: int = MAX_BITS) -> Column:
    """Keys of which two patterns that differ in ``bits`` places or fewer share at least one."""
    blocks = bits + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:])]
    pairs = list(combinations(range(blocks), 2))
    return F.array(*(F.lit(k << 40).cast("long").bitwiseOR(F.shiftleft(part[i], 20)).bitwiseOR(part[j]) for k, (i, j) in enumerate(pairs)))


class Index:
    """The hierarchy over Gray-sorted fingerprints of some groups; nodes never cross groups.

    Level 0 holds the members; a node of the next level covers up to ``FAN`` nodes.  Each
    node has the bits that are one, and those that are zero, in all its members.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        ones, zeros = fp.view(np.uint64), ~fp.view(np.uint64)
        self.levels = [(ones, zeros, np.arange(len(fp)), np.arange(len(fp)) + 1)]
        self.first = [np.arange(len(fp))]
        self.last = [np.arange(len(fp)) + 1]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            new = np.r_[True, group[1:] != group[:-1]]
            head = np.flatnonzero(new)
            place = np.arange(len(group)) - head[np.cumsum(new) - 1]
            cut = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            end = np.r_[cut[1:], len(group)]
            self.levels.append((ones, zeros, cut, end))
            self.first.append(self.first[-1][cut])
            self.last.append(self.last[-1][end - 1])
            group = group[cut]

    def links(self, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect whatever members of the top nodes i and j differ in at most ``bits`` places."""
        a, b, todo, found = [], [], [(len(self.levels) - 1, i, j)], 0
        while todo:
            level, i, j = todo.pop()
            if len(i) > OPEN:
                todo += [(level, i[OPEN:], j[OPEN:])]
                i, j = i[:OPEN], j[:OPEN]
            ones, zeros, child, end = self.levels[level]
            apart = np.bitwise_count((ones[i] & zeros[j]) | (zeros[i] & ones[j]))
            near = apart <= bits
            i, j = i[near], j[near]
            solid = np.bitwise_count(~((ones[i] & ones[j]) | (zeros[i] & zeros[j]))) <= bits
            if solid.any():
                p, q = i[solid], j[solid]
                self._whole(level, p[p == q], a, b)
                a.append(self.fp[self.first[level][p[p != q]]])
                b.append(self.fp[self.first[level][q[p != q]]])
                found += sum(map(len, a[-2:]))
            i, j = i[~solid], j[~solid]
            if level and len(i):
                step = np.arange(FAN)
                p = np.broadcast_to(child[i][:, None, None] + step[None, :, None], (len(i), FAN, FAN))
                q = np.broadcast_to(child[j][:, None, None] + step[None, None, :], (len(i), FAN, FAN))
                ok = (p < end[i][:, None, None]) & (q < end[j][:, None, None]) & ((i != j)[:, None, None] | (p <= q))
                todo.append((level - 1, p[ok], q[ok]))
            if found > 1_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, found = [x], [y], 0
        return (np.concatenate(a), np.concatenate(b)) if a else (self.fp[:0], self.fp[:0])

    def _whole(self, level: int, nodes: np.ndarray, a: list, b: list) -> None:
        """Members of a node that cannot differ in too many places hang together."""
        first, size = self.first[level][nodes], self.last[level][nodes] - self.first[level][nodes]
        if not size.sum():
            return
        head = np.repeat(first, size)
        member = head + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a.append(self.fp[head[member != head]])
        b.append(self.fp[member[member != head]])


def _within(fp: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    if len(fp) < 2:
        return fp[:0], fp[:0]
    pair = group[1:] == group[:-1]
    more = np.r_[False, pair] | np.r_[pair, False]
    index = Index(fp[more], group[more])
    top = np.arange(len(index.levels[-1][0]))
    return index.links(top, top, bits)


def _scan(bits: int):
    """Links inside the keys of a sorted partition; keys at its ends and large ones as pages."""

    def rows(a=(), b=(), key=(), rank=(), ones=(), zeros=(), members=()) -> pd.DataFrame:
        n, p = len(a), len(members)
        pad = [None] * p
        return pd.DataFrame({
            "a": pd.array([*a, *pad], "Int64"), "b": pd.array([*b, *pad], "Int64"),
            "key": pd.array([None] * n + list(key), "Int64"), "rank": pd.array([None] * n + list(rank), "Int64"),
            "ones": pd.array([None] * n + list(ones), "Int64"), "zeros": pd.array([None] * n + list(zeros), "Int64"), "members": [None] * n + list(members),
        })

    def pages(key: int, fp: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        at = range(0, len(fp), PAGE)
        cut = [fp[i : i + PAGE] for i in at]
        a, b = _within(fp, np.repeat(np.arange(len(cut)), [len(x) for x in cut]), bits)
        a, b = forest(a, b)
        return rows(a, b, [key] * len(cut), [int(rank[i]) for i in at], [int(np.bitwise_and.reduce(x)) for x in cut], [int(np.bitwise_and.reduce(~x)) for x in cut], [x.tobytes() for x in cut])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, edge = None, None  # edge: the key whose rows go to pages whatever their number
        for x in batches:
            if not len(x):
                continue
            now = [x[c].to_numpy() for c in ("key", "fp", "rank")]
            if held is None:
                edge = now[0][0]
            else:
                now = [np.concatenate([p, q]) for p, q in zip(held, now)]
            key, fp, rank = now
            open_at = np.searchsorted(key, key[-1])
            size = len(key) - open_at
            if size >= PAGE:
                full = open_at + size // PAGE * PAGE
                yield pages(int(key[-1]), fp[open_at:full], rank[open_at:full])
                edge_next = key[-1]
                held = [p[full:] for p in now]
            else:
                edge_next = edge if key[-1] == edge else None
                held = [p[open_at:] for p in now]
            key, fp, rank = key[:open_at], fp[:open_at], rank[:open_at]
            if len(key):
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[new, len(key)])
                paged = (sizes > PAGE) | (key[new] == edge)
                for s, n in zip(new[paged], sizes[paged]):
                    yield pages(int(key[s]), fp[s : s + n], rank[s : s + n])
                small = np.repeat(~paged, sizes)
                a, b = _within(fp[small], key[small], bits)
                if len(a):
                    yield rows(*forest(a, b))
            edge = edge_next
        if held is not None and len(held[0]):
            yield pages(int(held[0][-1]), held[1], held[2])

    return run


def _across(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for m, n in zip(x["m"], x["n"]):
                p, q = np.frombuffer(m, np.int64), np.frombuffer(n, np.int64)
                index = Index(np.concatenate([p, q]), np.repeat([0, 1], [len(p), len(q)]))
                a, b = index.links(np.array([0]), np.array([1]), bits)
                a, b = forest(a, b)
                yield pd.DataFrame({"a": a, "b": b})

    return run


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all those within ``bits`` differing bits.

    ``fps`` has distinct values in its column fp.  The edges have the components of the
    full link graph, not all its edges.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(block_keys(F.col("fp"), bits)).alias("key"))
    found = keyed.repartitionByRange(partitions(spark), "key", "rank").sortWithinPartitions("key", "rank")
    found = materialise(found.mapInPandas(_scan(bits), "a long, b long, key long, rank long, ones long, zeros long, members binary"), "links")
    page = found.where("key is not null").select("key", "rank", "ones", "zeros", "members")
    left, right = page.toDF("key", "r", "o", "z", "m"), page.toDF("key", "r2", "o2", "z2", "n")
    near = F.bit_count(F.col("o").bitwiseAND(F.col("z2")).bitwiseOR(F.col("z").bitwiseAND(F.col("o2")))) <= bits
    units = left.join(right, "key").where((F.col("r") < F.col("r2")) & near).select("m", "n")
    return found.where("a is not null").select("a", "b").unionByName(units.mapInPandas(_across(bits), "a long, b long"))


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``bits`` bits.

    Every row of ``docs`` comes back once, repeated rows included; other columns are not
    read.  A null or empty text has fingerprint 0, which links like any other.  Rows
    whose doc_id is null get the component of their fingerprint (null if nothing in it
    has a doc_id).  Rows with one text always share a component, since equal
    fingerprints do.
    """
    own = materialise(fingerprints(docs), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")), "classes")
    return join_classes(own, _grouped(classes, bits).select("fp", "times", F.col("low").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def _grouped(classes: DataFrame, bits: int) -> DataFrame:
    """``classes``, a row a fingerprint with the least of its rows as ``first``, with group and low, the least ``first`` of the group."""
    parts = connected_components(links(classes.select("fp"), bits)).toDF("fp", "group")
    parts = materialise(parts, "parts")
    low = materialise(parts.join(classes, "fp").groupBy("group").agg(F.min("first").alias("low"), F.count("*").alias("times")), "groups")
    moved = join_classes(parts, low, "group").select("fp", "group", "low")
    return classes.join(moved, "fp", "left").withColumn("low", F.when(F.col("group").isNull(), F.col("first")).otherwise(F.col("low"))).withColumn("group", F.coalesce("group", "fp"))


def keep_one(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with its columns: that with the smallest doc_id.

    Rows are decided by their own texts, so rows of one doc_id whose texts are no near
    copies all stay, and repeated rows stay once.  Null ids come last; of rows alike in
    doc_id the smaller fingerprint stays, then the smaller hash of the text.

    Texts are read once.  Only rows that may go, by a test against bits of fixed size,
    are shuffled with their texts.
    """
    # A row travels as one column, so names of other columns can't clash.
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), fingerprint_of(text_of(docs)).alias("fp"), F.xxhash64(text_of(docs)).alias("h"), F.monotonically_increasing_id().alias("id"))
    own = materialise(own, "marked")
    rank = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("doc_id"), "fp", "h", "id")
    classes = materialise(own.groupBy("fp").agg(F.min(rank).alias("first")), "classes")
    kept = _grouped(classes, bits).select("low.id").distinct()
    gone = materialise(own.select("id").join(kept, "id", "left_anti"), "gone")
    own = own.withColumn("may_go", maybe_in(F.xxhash64("id"), gone.select(F.xxhash64("id").alias("h"))))
    return own.where("not may_go").select("row.*").unionByName(own.where("may_go").join(gone, "id", "left_anti").select("row.*"))
