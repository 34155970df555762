"""Merkle manifest of a table: a proof for every row, built by a butterfly exchange of subtree roots between aligned partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

#: Leaves of an aligned block, a power of the fanout: what one task hashes at once.
BLOCK = 4096
_STEP = "array<struct<left:string,right:string>>"


def field_bytes(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the fields of a row, lowercase hex."""
    return F.sha2(F.concat(*[field_bytes(v) for v in values]), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` ``(tree, key, leaf, ...)`` with ``pos``, the place in its tree, and ``size``, the leaves of the tree.

    A range shuffle by (tree, key, leaf) puts neighbours together and splits a tree over as many tasks as it needs; each task counts
    its own rows, and only the counts of tasks are summed up.
    """
    order = [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = dealt.schema
    tree = leaves.columns.index("tree")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for value in batch.column(tree).to_pylist():
                n = n + 1 if (value,) == last else 0
                last = (value,)
                at.append(n)
            columns = [*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "task", "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", task int, at long"
    placed = durable(dealt.mapInArrow(place, schema), "manifest-leaves")
    counts = placed.groupBy("tree", "task").agg((F.max("at") + 1).alias("n"))  # a row for each tree in a task
    whole = Window.partitionBy("tree")
    earlier = F.sum("n").over(whole.orderBy("task")) - F.col("n")
    starts = counts.select("tree", "task", earlier.alias("start"), F.sum("n").over(whole).alias("size"))
    joined = placed.alias("p").join(starts.alias("s"), F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.task") == F.col("s.task")))
    own = [F.col(f"p.{c}") for c in leaves.columns]
    return joined.select(*own, (F.col("start") + F.col("at")).alias("pos"), "size")


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], fanout: int, depth: int | None) -> list[list[str]]:
    """All levels above and with ``nodes``: ``depth`` more of them, or up to the single node."""
    levels = [nodes]
    while len(levels) <= depth if depth is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def _depth(block: int, fanout: int) -> int:
    depth = 0
    while fanout**depth < block:
        depth += 1
    if fanout < 2 or fanout**depth != block:
        raise ValueError("block must be a power of a fanout of at least 2")
    return depth


def _block_roots(numbered: DataFrame, fanout: int, block: int) -> DataFrame:
    """``(tree, block, blocks, node, path)``: the root over each aligned block of leaves; ``path`` is still empty."""
    depth = _depth(block, fanout)

    def root(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        size = rows["size"][0].as_py()
        levels = _levels(rows["leaf"].to_pylist(), fanout, depth if size > block else None)
        blocks = pa.array([-(-size // block)], pa.int64())
        return pa.table({"tree": rows["tree"][:1], "block": rows["block"][:1], "blocks": blocks, "node": pa.array(levels[-1], pa.string())})

    tree = numbered.schema["tree"].dataType.simpleString()
    rows = numbered.select("tree", F.floor(F.col("pos") / block).alias("block"), "pos", "size", "leaf")
    roots = rows.groupBy("tree", "block").applyInArrow(root, f"tree {tree}, block long, blocks long, node string")
    return roots.withColumn("path", F.array().cast(_STEP))


def _exchange(blocks: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: every block gets the roots of its run's other subtrees from a member of each, and hashes the parent itself.

    A subtree spans ``width`` blocks. A block asks the member at its own offset; the last subtree may be short, so offsets wrap there.
    """
    own = F.floor(F.col("block") / width) % fanout
    start = F.floor(F.col("block") / (width * fanout)) * (width * fanout)
    offset = F.col("block") % width
    others = F.array(*[F.lit(e).cast("long") for e in range(fanout)])
    wanted = blocks.where(F.col("blocks") > width).select("tree", "block", F.explode(others).alias("digit"), own.alias("own"), start.alias("start"), offset.alias("offset"), "blocks")
    first = F.col("start") + F.col("digit") * width
    present = F.least(F.lit(width).cast("long"), F.col("blocks") - first)
    wanted = wanted.where((F.col("digit") != F.col("own")) & (first < F.col("blocks")))
    wanted = wanted.select("tree", "block", "digit", (first + F.col("offset") % present).alias("partner"))
    sent = blocks.select(F.col("tree").alias("_tree"), F.col("block").alias("partner"), F.col("node").alias("sent"))
    got = wanted.join(sent, F.col("tree").eqNullSafe(F.col("_tree")) & (wanted["partner"] == sent["partner"])).drop("_tree")
    got = got.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("digit", "sent"))).alias("got"))
    got = got.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "got")
    met = blocks.join(got, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")), "left")
    received = F.coalesce("got", F.array().cast("array<struct<digit:bigint,sent:string>>"))

    def side(of) -> Column:
        return F.array_join(F.transform(F.filter(received, of), lambda x: x["sent"]), "")

    step = F.struct(side(lambda x: x["digit"] < own).alias("left"), side(lambda x: x["digit"] > own).alias("right"))
    climbs = F.col("blocks") > width
    bound = met.select("tree", "block", "blocks", "node", "path", climbs.alias("climbs"), step.alias("step"))
    parent = F.sha2(F.concat("step.left", "node", "step.right"), 256)
    return bound.select(
        "tree", "block", "blocks", F.when(F.col("climbs"), parent).otherwise(F.col("node")).alias("node"),
        F.when(F.col("climbs"), F.concat("path", F.array("step"))).otherwise(F.col("path")).alias("path"),
    )


def _upper(numbered: DataFrame, fanout: int, block: int) -> DataFrame:
    """``(tree, block, node, path)``: of each block the root of its whole tree and the siblings from the block's root up to it."""
    blocks = durable(_block_roots(numbered, fanout, block), "manifest-blocks")
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        blocks = durable(_exchange(blocks, width, fanout), "manifest-round")
        width *= fanout
    return blocks.select("tree", "block", F.col("node").alias("root"), "path")


def _with_paths(numbered: DataFrame, upper: DataFrame, fanout: int, block: int, carried: str) -> DataFrame:
    """Each leaf with ``root`` and its whole ``path``: within the block hashed anew, above it as the block has acquired it.

    ``carried`` is a nullable string column that stays with the leaf.
    """
    depth = _depth(block, fanout)

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        size = rows["size"][0].as_py() if rows.num_rows else 0
        upper_path = above["path"][0].as_py() if above.num_rows else []
        levels = _levels(rows["leaf"].to_pylist(), fanout, depth if size > block else None) if rows.num_rows else [[]]
        paths = []
        for i in range(rows.num_rows):
            path = []
            for level in levels[:-1]:
                first = i - i % fanout
                path.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + fanout])})
                i //= fanout
            paths.append(path + upper_path)
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        root = pa.array([above["root"][0].as_py() if above.num_rows else None] * rows.num_rows, pa.string())
        return pa.table({"tree": rows["tree"], "key": rows["key"], "leaf": rows["leaf"], carried: rows[carried], "root": root, "path": pa.array(paths, kind)})

    kinds = {c: numbered.schema[c].dataType.simpleString() for c in ("tree", "key")}
    rows = numbered.select("tree", F.floor(F.col("pos") / block).alias("block"), "pos", "size", "key", "leaf", carried)
    return rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(
        prove, f"tree {kinds['tree']}, key {kinds['key']}, leaf string, {carried} string, root string, path {_STEP}"
    )


def proofs(leaves: DataFrame, fanout: int = 2, block: int = BLOCK, carried: str = "changed") -> DataFrame:
    """``(tree, key, leaf, <carried>, root, path)`` for each leaf of ``leaves`` ``(tree, key, leaf, <carried>)``.

    In each ``tree`` the leaves ascend by ``key`` (null first), equal keys by ``leaf``; while several nodes remain, each ``fanout`` consecutive
    ones (the last run may be shorter, even one node) become the SHA-256 of their hex digests. ``path`` has a step for each level:
    the digests of the run left and right of the node. Aligned blocks of ``block`` leaves are hashed in one task each;
    above them, groups of ``fanout`` aligned blocks swap the roots of their subtrees round by round and all hash the
    parent, so each block ends with the root and its own upper siblings and nothing is passed down. A tree of any size is
    split into blocks; no task sees more than one. No leaves give no rows.
    """
    numbered = durable(_numbered(leaves.select("tree", "key", "leaf", carried)), "manifest-numbered")
    return _with_paths(numbered, _upper(numbered, fanout, block), fanout, block, carried)


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(
    rows: DataFrame, id_col: str, tree_col: str, fields: list[Column], changed: Column | None = None, fanout: int = 2, block: int = BLOCK
) -> DataFrame:
    """``(doc_id, tree, leaf, changed, subroot, root, path)`` for each row.

    A leaf is the digest of ``fields``; the rows of one value of ``tree_col`` form a tree with ``subroot`` on top, and the subroots, ordered
    by that value (null first, by bytes), are the leaves of the last tree, whose top is ``root``. ``changed`` is another
    digest to be checked against the same path, or null. Rows whose id is null come first in their tree, rows that share an id are ordered by
    digest, equal rows give equal leaves with paths of their own; null and empty values differ. An empty table gives no rows.
    Columns not named are not read.
    """
    told = rows.select(
        F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").cast("long").alias("key"), leaf_digest(*fields).alias("leaf"),
        (F.lit(None) if changed is None else changed).cast("string").alias("changed"),
    )
    below = durable(proofs(told, fanout, block), "manifest-proofs")
    tops = below.select("tree", "root").distinct()
    tops = tops.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("changed"))
    above = proofs(tops, fanout, block)
    above = above.select(F.col("key").alias("_tree"), F.col("root").alias("_root"), F.col("path").alias("_path"))
    joined = below.join(above, F.col("tree").eqNullSafe(F.col("_tree")))
    return joined.select(
        F.col("key").alias("doc_id"), "tree", "leaf", "changed", F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_path").alias("path")
    )
