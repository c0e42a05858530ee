"""A Merkle manifest of a dataset: every document's hash up to one root, with a proof for each.

Documents are leaves of a tree a language; the languages' roots are the leaves of one more
tree.  A tree's nodes are hashed two by two, level by level, until one is left; a last node
without a partner is hashed alone.

The build goes from the leaves up.  ``LEVELS`` levels at a time are one step: the nodes of a
tree are cut into blocks of 2 ** LEVELS, which are the whole subtrees below the nodes that many
levels up, so a block is hashed where it is, and its top is the only thing that goes on.
Blocks are persisted.  Proofs then go from the root down: each block is joined with the proof
of its top, and every node of it puts its own siblings before that.  Both ways a unit of work
is one block, whatever the size of a tree, and a step is a table that survives its executors.

Places of leaves in their order come from a range partitioning and the partitions' counts, so
no language is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import materialise

#: Levels of a tree that are hashed in one step: blocks have at most 2 ** LEVELS nodes.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: list[Column]) -> Column:
    """Hash of values: each as its number of UTF-8 bytes, a colon and itself, or - if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_name(c: Column) -> Column:
    """A name that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def ordered(rows: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """tree, i, n and ``keep``: the rows' places in their tree, from 0, and the trees' sizes.

    Rows are dealt by ranges and numbered in their partition; how many of a tree go before
    follows from the partitions' counts.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = dealt.select("tree", *keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    dealt = materialise(dealt, "ordered")
    counts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("tree")))
    counts = materialise(counts.select("tree", "_part", (F.col("_before") - F.col("_first")).alias("_shift"), "n"), "counts")  # a row a tree and partition
    return dealt.join(counts, ["tree", "_part"]).select("tree", (F.col("_at") + F.col("_shift")).alias("i"), "n", *keep)


def _parents(nodes: list[str]) -> list[str]:
    return [sha256((nodes[k] + (nodes[k + 1] if k + 1 < len(nodes) else "")).encode()).hexdigest() for k in range(0, len(nodes), 2)]


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return (n - 1).bit_length()


def blocks(nodes: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """tree, block, n, nodes: a tree's nodes (i, digest, ``keep``) in order, in blocks of 2 ** levels."""
    held = F.sort_array(F.collect_list(F.struct("i", "digest", *keep)))
    return nodes.groupBy("tree", F.expr(f"shiftright(i, {levels})").alias("block"), "n").agg(held.alias("nodes"))


def tops(cut: DataFrame, levels: int) -> DataFrame:
    """tree, i, n, digest: the nodes that many levels above, each of a block; n is the tree's number of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, nodes in zip(b["n"].to_pylist(), b["digests"].to_pylist()):
                for _ in range(min(levels, height(n))):
                    nodes = _parents(nodes)
                out.append(nodes[0])
            yield pa.RecordBatch.from_arrays([b["tree"], b["block"], b["n"], pa.array(out, pa.string())], ["tree", "i", "n", "digest"])

    flat = cut.select("tree", "block", "n", F.transform("nodes", lambda x: x["digest"]).alias("digests"))
    return flat.mapInArrow(run, "tree string, i long, n long, digest string").withColumn("n", F.expr(f"shiftright(n + {(1 << levels) - 1}, {levels})"))


def _pushed(carried: list[str], levels: int):
    """Of each block its nodes, with their siblings in it before the proof of its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (tree, n, above) in enumerate(zip(b["tree"].to_pylist(), b["n"].to_pylist(), b["proof"].to_pylist())):
                nodes = b["nodes"].slice(k, 1).flatten()
                level, under, proofs = nodes.field("digest").to_pylist(), [], []
                for _ in range(min(levels, height(n))):
                    under.append(level)
                    level = _parents(level)
                for at in range(len(nodes)):
                    own = []
                    for level in under:
                        other = at ^ 1
                        own.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
                        at >>= 1
                    proofs.append(own + above)
                same = pa.array([k] * len(nodes), pa.int32())
                names = [f.name for f in nodes.type]
                columns = [b["tree"].take(same), *nodes.flatten(), *(b[c].take(same) for c in carried), pa.array(proofs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", *names, *carried, "proof"])

    return run


def push(cut: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Every node of the blocks with its proof, given those of their tops (tree, i, proof, and what all nodes of a tree share)."""
    carried = [c for c in above.columns if c not in ("tree", "i", "proof")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema["nodes"].dataType.elementType.fields] + [f"`{c}` {above.schema[c].dataType.simpleString()}" for c in carried]
    joined = cut.join(above.withColumnRenamed("i", "block"), ["tree", "block"]).select("tree", "n", "nodes", *carried, "proof")
    return joined.mapInArrow(_pushed(carried, levels), f"tree string, {', '.join(fields)}, proof array<string>")


def grow(nodes: DataFrame, keep: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The persisted steps of the trees of (tree, i, n, digest, ``keep``), from the leaves up, and the trees' roots (tree, digest)."""
    steps = [materialise(blocks(nodes, keep, levels), "blocks")]
    while True:
        up = materialise(tops(steps[-1], levels), "tops")
        if up.where("n > 1").isEmpty():  # a tree that is done passes on as it is: one node has no level above
            return steps, up.select("tree", "digest")
        steps.append(materialise(blocks(up, [], levels), "blocks"))


def prove(steps: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first step with their proofs, given what follows at the roots (tree, proof, and what a tree's nodes share).

    A proof is a list from the leaf up: L or R and the sibling on that side, or - where there is none.
    """
    proofs = above.withColumn("i", F.lit(0).cast("long"))
    for cut in reversed(steps[1:]):
        own = push(cut, proofs, levels)
        proofs = materialise(own.drop("digest"), "proofs")
    return push(steps[0], proofs, levels)


def manifest(leaves: DataFrame, order: list[str], keep: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """tree, leaf, subroot, root, proof, and the columns of ``order`` and ``keep``, of leaves (tree, digest and those columns).

    ``tree`` is not null (``tree_name``).  A tree's leaves stand in the order of ``order``,
    nulls first, then of their digests; equal leaves are told apart by nothing.  Without
    leaves there is nothing.
    """
    own = list(dict.fromkeys([*order, *(keep or [])]))
    steps, roots = grow(ordered(leaves, [*order, "digest"], ["digest", *own]), own, levels)
    again, root = grow(ordered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"], ["digest", "own"]), ["own"], levels)
    top = prove(again, root.select("tree", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("root")), levels)
    subroots = materialise(top.select(F.col("own").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "subroots")
    return prove(steps, subroots, levels).select("tree", F.col("digest").alias("leaf"), "subroot", "root", "proof", *own)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    side, other = lambda x: F.substring(x, 1, 1), lambda x: F.substr(x, F.lit(2))
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.when(side(x) == "L", F.concat(other(x), acc)).when(side(x) == "R", F.concat(acc, other(x))).otherwise(acc).cast("binary"), 256))


def siblings_sha256(proof: Column) -> Column:
    """Hash of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda x: x != "-"), lambda x: F.substr(x, F.lit(2))), "").cast("binary"), 256)


def documents_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, and ``tampered`` (the leaf that tampered values give; the leaf itself where nothing was tampered with).

    Leaves of a language are in order of doc_id, null first.  Any column may be null, and
    rows may repeat; each is a leaf of its own.
    """
    own = {k: F.col(k) for k in FIELDS}
    leaf = leaf_of(list(own.values()))
    changed = leaf if tampered is None else F.when(tampered, leaf_of(list((own | {"n_chars": F.col("n_chars") + 1}).values())))
    rows = docs.select("doc_id", tree_name(F.col("lang")).alias("tree"), leaf.alias("digest"), changed.alias("tampered"))
    rows = materialise(rows, "leaves")  # texts are read and hashed once
    out = manifest(rows, ["doc_id"], ["tampered"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof", F.coalesce("tampered", "leaf").alias("tampered"))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a manifest, and which documents still prove their root after some were tampered with.

    Where 7 divides the checksum of the doc_id, one is added to n_chars after the manifest
    was made; nulls stay null, and such rows still verify.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = documents_manifest(docs, hit)
    fold = folded(F.col("tampered"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_sha256(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
