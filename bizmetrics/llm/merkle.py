"""A Merkle manifest of a table, its trees stored in van Emde Boas order.

Leaves stand in groups (one tree each, runs of ``ARITY`` nodes), and the groups' roots in one tree
above. A tree is cut into aligned blocks of ``BLOCK`` levels. A block is one flat array: the upper half of
its levels first, then each subtree of the lower half, every part laid out like that again, so a
path to the root stays within few neighbouring places at every scale. Where a node stands is arithmetic on
its level and index (``veb_address``); building a block and finding the siblings of a leaf use nothing else.

The roots of a tier of blocks are the leaves of the next tier, until a tree has one block. Tiers go down
again for the proofs: a block learns the path of its root from the tier above and hands each of its leaves
the siblings on its way. One block is all that a task holds at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bizmetrics.llm.common import ship
from bizmetrics.session import partitions_for, planned_bytes, store_once

ARITY = 3
#: Levels above the leaves that a block holds: 3 ** 8 leaves of 32 bytes, 0.3 MB with the nodes above them.
BLOCK = 8
DIGEST = 32
NODES = "tree binary, block bigint, height int, leaves bigint, nodes binary, root binary"
PLACE_BITS = 33  # of monotonically_increasing_id
TOP = b"*"  # the one tree above the groups' trees


def height_of(leaves: int) -> int:
    """Levels above ``leaves`` nodes until one remains."""
    height, width = 0, 1
    while width < leaves:
        height, width = height + 1, width * ARITY
    return height


@lru_cache(maxsize=64)
def subtree_size(height: int) -> int:
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


@lru_cache(maxsize=64)
def _layout(height: int) -> tuple[np.ndarray, ...]:
    """For a complete tree of ``height`` levels below its root: the place of every node, level by level from
    the root (0) to the leaves (``height``)."""
    if height == 0:
        return (np.zeros(1, np.int64),)
    upper = (height - 1) // 2  # levels below the root of the upper half
    lower = height - upper - 1
    top, under = _layout(upper), _layout(lower)
    subtrees = ARITY ** (upper + 1)
    starts = subtree_size(upper) + np.arange(subtrees, dtype=np.int64) * subtree_size(lower)
    return (*top, *[(starts[:, None] + level[None, :]).ravel() for level in under])


def veb_address(height: int, level: int, index: np.ndarray | int) -> np.ndarray:
    """Where node ``index`` of ``level`` (0 the root) stands in a block of that height: at each cut the
    index's leading digits choose a subtree, the rest go on inside it."""
    index = np.asarray(index, np.int64)
    base = np.zeros_like(index)
    while height:
        upper = (height - 1) // 2
        lower = height - upper - 1
        if level <= upper:
            height = upper
            continue
        width = ARITY ** (level - upper - 1)
        base = base + subtree_size(upper) + index // width * subtree_size(lower)
        index, level, height = index % width, level - upper - 1, lower
    return base


def _node(children: bytes) -> bytes:
    """The digest of a run of digests, taken as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """The nodes of a block over ``leaves`` (n x 32 bytes) in van Emde Boas order. Places without a node are zero."""
    nodes = np.zeros((subtree_size(height), DIGEST), np.uint8)
    count, row = len(leaves), np.ascontiguousarray(leaves)
    nodes[veb_address(height, height, np.arange(count))] = row
    for level in range(height - 1, -1, -1):
        run = row.tobytes()
        above = b"".join(_node(run[i:i + ARITY * DIGEST]) for i in range(0, len(run), ARITY * DIGEST))
        row = np.frombuffer(above, np.uint8).reshape(-1, DIGEST)
        nodes[veb_address(height, level, np.arange(len(row)))] = row
    return nodes


def level_nodes(nodes: np.ndarray, height: int, leaves: int) -> list[bytes]:
    """The digests of each level, from the leaves to below the root, gathered from their addresses."""
    out, count = [], leaves
    for level in range(height, 0, -1):
        out.append(nodes[veb_address(height, level, np.arange(count))].tobytes())
        count = -(-count // ARITY)
    return out


def sibling_path(levels: list[bytes], index: int) -> bytes:
    """The way from leaf ``index`` to its block's root: for each level one byte (siblings to the left * 16 +
    siblings to the right) and the siblings' digests, from left to right."""
    out = []
    for row in levels:
        first, here = index // ARITY * ARITY * DIGEST, index * DIGEST
        last = min(first + ARITY * DIGEST, len(row))
        before, after = row[first:here], row[here + DIGEST:last]
        out += [bytes(((len(before) * 16 + len(after)) // DIGEST,)), before, after]
        index //= ARITY
    return b"".join(out)


def fold(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """(the root that ``leaf`` and the siblings on ``path`` give, all siblings)."""
    at, siblings = 0, []
    while at < len(path):
        left, right = (path[at] >> 4) * DIGEST, (path[at] & 15) * DIGEST
        at += 1
        before, after = path[at:at + left], path[at + left:at + left + right]
        leaf = _node(before + leaf + after)
        siblings += [before, after]
        at += left + right
    return leaf, b"".join(siblings)


def _whole(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], same: Callable[[tuple, tuple], bool]) -> Iterator[list[tuple]]:
    """Runs of consecutive rows that belong together, across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and not same(held[-1], row):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _blocks(leaves: DataFrame) -> DataFrame:
    """One tier of blocks over ``leaves`` (tree, size, place, digest), where ``size`` is how many leaves the tree has here."""
    per_block = ARITY ** BLOCK
    rows = leaves.select("tree", "size", "place", "digest").withColumn("block", F.floor(F.col("place") / per_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, schema = [], pa.schema([("tree", pa.binary()), ("block", pa.int64()), ("height", pa.int32()), ("leaves", pa.int64()),
                                      ("nodes", pa.binary()), ("root", pa.binary())])
        for rows in _whole(batches, ("tree", "block", "size", "digest"), lambda a, b: a[:2] == b[:2]):
            tree, block, size, _ = rows[0]
            # Among several blocks all have the full height: a run of one node still becomes a digest.
            height = BLOCK if size > per_block else height_of(size)
            nodes = build_block(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, DIGEST), height)
            made.append((tree, block, height, len(rows), nodes.tobytes(), nodes[0].tobytes()))
            if sum(len(m[4]) for m in made) > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(run, NODES)


def _tiers(leaves: DataFrame) -> list[DataFrame]:
    """Stored tiers of blocks, the lowest first, until every tree has one block."""
    tiers = []
    while True:
        blocks = store_once(_blocks(leaves), "merkle")
        tiers.append(blocks)
        if not blocks.where(F.col("block") > 0).head(1):
            return tiers
        # Trees of one block are finished. They stay out of further tiers.
        trees = blocks.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        leaves = blocks.select("tree", F.col("block").alias("place"), F.col("root").alias("digest")).join(trees, "tree")


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (leaf rows with ``tree`` and ``place``), the tiers of blocks of all trees, the tree of their
    roots, and ``roots`` (tree, subroot, root)."""
    leaves: DataFrame
    tiers: list[DataFrame]
    top_leaves: DataFrame
    top_tiers: list[DataFrame]


def leaf_digest(columns: list[Column]) -> Column:
    """Hex digest of some values: ``-`` for a null, else the size in UTF-8 bytes, a colon and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)), 256)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` in ``order``, stored, with their global number in ``number`` (from 0)."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(partitions_for(planned_bytes(rows), least), *order).sortWithinPartitions(*order)
    stored = store_once(cut.withColumn("at", F.monotonically_increasing_id()), "leaves")
    stored = stored.withColumn("slice", F.shiftright("at", PLACE_BITS))
    before = F.sum("rows").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    # One row per slice at most: safe to broadcast.
    starts = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("rows")).select("slice", F.coalesce(before, F.lit(0)).alias("start"))
    return (stored.join(F.broadcast(starts), "slice")
            .withColumn("number", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("slice", "start", "at"))


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` in their tree and its ``size``. A tree may hold any share of the rows: places
    come from the numbers of the sorted slices, not from a window over the tree."""
    numbered = _numbered(rows, [F.col("tree"), *order])
    spans = numbered.groupBy("tree").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size"))
    return numbered.join(spans, "tree").withColumn("place", F.col("number") - F.col("first")).drop("first", "number")


def tree_key(group: Column) -> Column:
    """A never null binary key of a group's value, which sorts nulls first and then as UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit(b"\x01"), group.cast("string").cast("binary")), F.lit(b""))


def build(rows: DataFrame, group: Column, leaf: Column, order: list[Column], *more: Column) -> Manifest:
    """The stored manifest of ``rows``: a tree for each value of ``group`` over the hex digests ``leaf``, in
    ``order`` (ties by leaf, so that rows that still tie are equal), and a tree over their roots. ``more``
    are columns to keep with each leaf; ``order`` may use them.
    """
    ship(rows.sparkSession)
    work = rows.select(tree_key(group).alias("tree"), F.unhex(leaf).alias("digest"), *more)
    # Digests are stored before they are sorted: choosing the slices' bounds reads them, not the texts.
    leaves = _placed(store_once(work, "digests"), [*order, F.col("digest")])
    tiers = _tiers(leaves)
    roots = tiers[0].where("false").select("tree", "root")
    for k, tier in enumerate(tiers):
        finished = tier if k == len(tiers) - 1 else tier.join(tier.where(F.col("block") > 0).select("tree").distinct(), "tree", "left_anti")
        roots = roots.unionByName(finished.select("tree", "root"))
    subroots = _numbered(roots, [F.col("tree")])
    top = subroots.select(F.lit(TOP).alias("tree"), F.lit(subroots.count()).alias("size"), F.col("number").alias("place"), F.col("root").alias("digest"), F.col("tree").alias("member"))
    return Manifest(leaves, tiers, top, _tiers(top))


def _descend(tiers: list[DataFrame], above: DataFrame, leaves: DataFrame, schema: str,
             emit: Callable[[tuple, bytes, tuple], tuple], carried: list[str], own: list[str]) -> DataFrame:
    """Hand paths down. ``above`` (tree, *carried) is what each tree's root knows, ``path`` among it; a tier's block
    adds its own siblings for each of its leaves. At the lowest tier ``emit`` makes a row from a leaf's own
    columns, its whole path and what was carried."""
    per_block = ARITY ** BLOCK
    others = [c for c in carried if c != "path"]
    known = above.select("tree", F.lit(0).cast("bigint").alias("block"), "path", *others)
    kinds = {f.name: f.dataType for f in above.schema.fields}
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        if k < len(tiers) - 1:  # trees whose one block is in this tier get their path from ``above``
            lone = tier.select("tree", "block").join(tier.where(F.col("block") > 0).select("tree").distinct(), "tree", "left_anti")
            known = known.unionByName(lone.join(above, "tree").select("tree", "block", "path", *others))
        heads = tier.join(known, ["tree", "block"]).select("tree", "block", F.lit(-1).cast("bigint").alias("place"), "height", "leaves", "nodes", "path", *others)
        if k:
            rows = tiers[k - 1].select("tree", F.col("block").alias("place"))
            rows = rows.join(tier.select("tree").distinct(), "tree", "left_semi")
            columns, fields = [], "tree binary, block bigint, path binary" + "".join(f", {c} {kinds[c].simpleString()}" for c in others)
        else:
            rows, columns, fields = leaves, own, schema
        rows = rows.withColumn("block", F.floor(F.col("place") / per_block))
        stacked = heads.unionByName(rows.select("tree", "block", "place", *columns), allowMissingColumns=True)
        known = _handed(stacked, fields, emit if k == 0 else None, others, columns)
    return known


def _handed(stacked: DataFrame, fields: str, emit, others: list[str], own: list[str]) -> DataFrame:
    """A block's row comes first in its partition, then its leaves'."""
    dealt = stacked.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = path = carried = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("tree", "place", "height", "leaves", "path", *others, *own)]
            stored = batch.column("nodes")
            for i, (tree, place, tall, many, upper, *rest) in enumerate(zip(*columns)):
                if place < 0:
                    levels = level_nodes(np.frombuffer(stored[i].as_py(), np.uint8).reshape(-1, DIGEST), tall, many)
                    path, carried = upper, tuple(rest[:len(others)])
                    continue
                way = sibling_path(levels, place % ARITY ** BLOCK) + path
                out.append(emit(tuple(rest[len(others):]), way, carried) if emit else (tree, place, way, *carried))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, fields)


def proofs(manifest: Manifest, schema: str, emit: Callable[[tuple, bytes, tuple], tuple], own: list[str]) -> DataFrame:
    """A row for every leaf, made by ``emit(own columns, path to the root, (subroot, root))``."""
    member = manifest.top_tiers[-1].select("tree", F.lit(b"").alias("path"), F.col("root").alias("whole"))
    subtrees = _descend(manifest.top_tiers, member, manifest.top_leaves, "tree binary, path binary, subroot binary, whole binary",
                        lambda row, path, carried: (row[0], path, row[1], carried[0]), ["path", "whole"], ["member", "digest"])
    above = store_once(subtrees, "subroots")
    return _descend(manifest.tiers, above, manifest.leaves, schema, emit, ["path", "subroot", "whole"], own)


VERIFIED = ("doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def verified(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source",
             columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
             changed: Column | None = None) -> DataFrame:
    """Build the manifest of ``docs``, and check every row's proof after ``tampered`` (a condition, null for no) rows
    had their text replaced by ``changed`` (by default: their line feeds deleted).

    One row per row: ``doc_id``, ``leaf``, ``subroot`` and ``root`` (hex, of the untampered table), ``proof_sha256`` (digest
    of all siblings up to the root, as hex text), ``folded_root`` (from the tampered leaf, if it is one, and the siblings)
    and ``verified``, whether that is the root. Groups are ordered nulls first, then by their UTF-8 bytes, their leaves by id, nulls
    first, ties by leaf digest; repeated rows have equal leaves and take consecutive places. Nulls in any column, empty and long
    texts are part of the leaf. A lone leaf is its group's root, a lone group's root is the root; then there are no siblings.
    An empty table gives no rows. Columns besides ``columns`` take no part.
    """
    names = [F.col(f"`{c}`") for c in columns]
    new = F.translate(F.col(f"`{text_col}`"), "\n", "") if changed is None else changed
    other = leaf_digest([new if c == text_col else F.col(f"`{c}`") for c in columns])
    kept = [F.col(f"`{id_col}`").alias("doc_id"),
            F.when(tampered, F.unhex(other)).alias("found")]
    manifest = build(docs, F.col(f"`{group_col}`"), leaf_digest(names), [F.col("doc_id").asc_nulls_first()], *kept)

    def emit(row: tuple, path: bytes, roots: tuple) -> tuple:
        doc_id, digest, found = row
        folded, siblings = fold(found or digest, path)
        return (doc_id, digest.hex(), roots[0].hex(), roots[1].hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(),
                folded.hex(), folded == roots[1])

    kind = docs.schema[id_col].dataType.simpleString()
    return proofs(manifest, VERIFIED.format(id=kind), emit, ["doc_id", "digest", "found"])
