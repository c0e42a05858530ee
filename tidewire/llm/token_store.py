"""Token ids on disk: canonical, length-limited Huffman codes in independent blocks.

Format.  A store is a folder with two tables in the shared file system, written by Spark:

* ``book``: one row with the code length of every id that occurs (arrays ``ids`` and
  ``bits``).  Codes are canonical: shorter first, then smaller ids.
* ``blocks``: one row a block of whole documents, in ascending document order by
  (``part``, ``block``).  ``docs`` and ``lengths`` are the documents' ids and numbers of
  token ids; ``first`` counts the token ids before the block; ``code`` is the bit string,
  most significant bit first; ``checkpoints`` are the bit offsets of every ``STRIDE``-th
  token id.

A block needs nothing but the book to be read.  Within a block, decoding starts at all
checkpoints at once: each step looks up ``LIMIT`` bits for every checkpoint in one table
and moves them all on by one token.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import materialise, new_path, partitions, text_of
from tidewire.llm.tokens import encoder, public_path, slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Longest code; tokens between checkpoints; tokens after which a block is closed.
LIMIT, STRIDE, BLOCK = 18, 64, 1 << 17
BLOCKS = "part int, block int, docs array<long>, lengths array<long>, n long, code binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol, 0 where it doesn't occur: Huffman's lengths, held to ``limit``.

    Lengths over the limit are cut to it; the excess of Kraft's sum is then paid by
    lengthening the rarest codes below the limit, and what is over is given back to the
    most frequent ones.
    """
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit {limit} bits")
    bits = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        bits[used] = 1
        return bits
    heap = [(int(counts[s]), k) for k, s in enumerate(used)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(used) - 1, np.int64)
    for node in range(len(used), len(parent)):
        for _ in range(2):
            n, k = heapq.heappop(heap)
            parent[k] = node
            total = n if _ == 0 else total + n
        heapq.heappush(heap, (total, node))
    depth = np.zeros(len(parent), np.int64)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    own = np.minimum(depth[: len(used)], limit)
    order = np.argsort(counts[used], kind="stable")  # rarest first
    over = int((1 << limit - own).sum()) - (1 << limit)
    while over > 0:
        for k in order:
            if over > 0 and own[k] < limit:
                over -= 1 << limit - own[k] - 1
                own[k] += 1
    for k in order[::-1]:
        while own[k] > 1 and (1 << limit - own[k]) <= -over:
            over += 1 << limit - own[k]
            own[k] -= 1
    bits[used] = own
    return bits


@dataclass(frozen=True)
class Book:
    """Codes of the ids and the table that decodes ``LIMIT`` bits at a time."""

    bits: np.ndarray
    code: np.ndarray
    table: np.ndarray  # id << 8 | bits

    @staticmethod
    def of(bits: np.ndarray, limit: int = LIMIT) -> Book:
        order = np.lexsort((np.arange(len(bits)), bits))
        order = order[bits[order] > 0]
        size = 1 << limit - bits[order]
        end = np.cumsum(size)
        code = np.zeros(len(bits), np.int64)
        code[order] = (end - size) >> limit - bits[order]
        table = np.zeros(1 << limit, np.int64)
        table[: end[-1] if len(end) else 0] = np.repeat(order << 8 | bits[order], size)
        return Book(bits, code, table)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, with 8 spare bytes at its end, and the bit offset of every STRIDE-th id."""
        n = self.bits[ids]
        end = np.cumsum(n)
        start = end - n
        words = (int(end[-1]) if len(ids) else 0) // 32 + 3
        shift = 64 - (start & 31) - n
        value = self.code[ids] << shift  # within 64 bits, since 31 + LIMIT < 63
        at = start >> 5
        bits = np.bincount(at, value >> 32, words) + np.bincount(at + 1, value & 0xFFFFFFFF, words)  # exact: sums stay under 2**32
        return bits.astype(np.uint64).astype(">u4").tobytes(), start[::STRIDE]

    def decode(self, code: bytes, checkpoints: np.ndarray, n: int, limit: int = LIMIT) -> np.ndarray:
        raw = np.frombuffer(code, np.uint8).astype(np.int64)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from every byte
        at = checkpoints.copy()
        out = np.zeros((STRIDE, len(at)), np.int64)
        for k in range(STRIDE):
            live = len(at) if k <= (n - 1) % STRIDE else len(at) - 1  # the last run may be shorter
            here = at[:live]
            hit = self.table[(window[here >> 3] >> 32 - limit - (here & 7)) & (1 << limit) - 1]
            out[k, :live] = hit >> 8
            here += hit & 255
        return out.T.reshape(-1)[:n]


TOKENS = "doc_id long, wide boolean, ids binary, used array<int>, times array<long>"


def _tokenise(path: str, end_id: int):
    """Rows of ids, in two bytes each where all of a row's fit, and a last row of how often the partition uses each id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = encoder(path), np.zeros(0, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for x in slices(batches):
            ids = [i + end for i in own.ids(x["text"].tolist())]
            n = np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
            if len(total) > 1 << 16:
                ids = [np.frombuffer(i, "<u4") for i in ids]
                wide = [bool((i > 0xFFFF).any()) for i in ids]
                ids = [(i if w else i.astype("<u2")).tobytes() for i, w in zip(ids, wide)]
            else:
                ids, wide = [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids], False
            yield pd.DataFrame({"doc_id": x["doc_id"], "wide": wide, "ids": ids, "used": None, "times": None})
        used = np.flatnonzero(total)
        if len(used):
            yield pd.DataFrame({"doc_id": [None], "wide": [None], "ids": [None], "used": [used.astype(np.int32)], "times": [total[used]]})

    return run


def _read_ids(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)


def write(tokens: DataFrame, path: str) -> Book:
    """Write what ``tokenise`` made as a store.  The counts are by id, so the driver gets a row an id of the vocabulary."""
    spark = tokens.sparkSession
    counts = tokens.where("used is not null").select(F.explode(F.arrays_zip("used", "times")).alias("c"))
    counts = counts.groupBy(F.col("c.used").alias("id")).agg(F.sum("c.times").alias("n")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    bits = code_lengths(total)
    used = np.flatnonzero(bits)
    spark.createDataFrame([(used.tolist(), bits[used].tolist())], "ids array<long>, bits array<long>").write.parquet(f"{path}/book")
    book = spark.sparkContext.broadcast(Book.of(bits))  # bounded by the vocabulary

    def block(part: int, k: int, docs: list, runs: list) -> pd.DataFrame:
        ids = np.concatenate(runs)
        code, checkpoints = book.value.encode(ids)
        return pd.DataFrame({"part": [part], "block": [k], "docs": [docs], "lengths": [[len(r) for r in runs]], "n": [len(ids)], "code": [code], "checkpoints": [checkpoints.astype("<i8").tobytes()]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, size, docs, runs = TaskContext.get().partitionId(), 0, 0, [], []
        for x in batches:
            for d, i, w in zip(x["doc_id"], x["ids"], x["wide"]):
                docs.append(None if pd.isna(d) else int(d))
                runs.append(_read_ids(i, w))
                size += len(runs[-1])
                if size >= BLOCK:
                    yield block(part, k, docs, runs)
                    k, size, docs, runs = k + 1, 0, [], []
        if docs:
            yield block(part, k, docs, runs)

    order = [F.asc_nulls_first("doc_id"), F.col("wide"), F.col("ids")]  # repeated ids: in the order of their tokens
    dealt = tokens.where("ids is not null").select("doc_id", "wide", "ids").repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(*order)
    dealt.mapInPandas(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    return book.value


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a store, in any order.

    ``ids`` are little-endian unsigned 32-bit integers as binary; with ``digest``, their
    CRC-32 stands in their place, as ids_crc32.
    """
    row = spark.read.schema("ids array<long>, bits array<long>").parquet(f"{path}/book").first()
    bits = np.zeros(max(row["ids"], default=-1) + 1, np.int64)
    bits[row["ids"]] = row["bits"]
    book = spark.sparkContext.broadcast(Book.of(bits))  # bounded by the vocabulary
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # Tokens before each block: those of the files before, and those before it in its file; numbers alone.
    files = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = stored.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("base"))
    ahead = stored.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ahead")).join(before, "part")
    ahead = ahead.select("part", "block", (F.col("base") + F.col("ahead")).alias("first"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for first, docs, lengths, n, code, checkpoints in zip(x["first"], x["docs"], x["lengths"], x["n"], x["code"], x["checkpoints"]):
                ids = book.value.decode(code, np.frombuffer(checkpoints, "<i8"), n).astype("<u4")
                end = np.cumsum(lengths)
                own = [ids[e - k : e].tobytes() for e, k in zip(end, lengths)]
                doc_id = pd.array([None if d is None or d != d else int(d) for d in docs], "Int64")
                out = pd.DataFrame({"doc_id": doc_id, "start": first + end - lengths, "n_tokens": lengths})
                yield out.assign(ids_crc32=list(map(zlib.crc32, own))) if digest else out.assign(ids=own)

    last = "ids_crc32 long" if digest else "ids binary"
    return stored.join(ahead, ["part", "block"]).mapInPandas(decode, f"doc_id long, start long, n_tokens long, {last}")


def tokenise(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row (doc_id, wide, ids) a row of ``docs``, and rows of counts (used, times), one a partition, made in the same pass.

    A null or empty text is its end id alone.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return own.mapInPandas(_tokenise(path or public_path(TOKENIZER), end_id), TOKENS)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token ids of ``docs`` as a store, read them back and digest them: doc_id, start, n_tokens, ids_crc32.

    Rows whose doc_id is null come first; repeated ids follow one another in the order of
    their tokens.  An empty table makes an empty store.
    """
    spark = docs.sparkSession
    store = new_path(spark, "store")
    write(materialise(tokenise(docs, path, end_id), "tokens"), store)

    return read(spark, store, digest=True)
