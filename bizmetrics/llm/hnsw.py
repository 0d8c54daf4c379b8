"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Vectors are dealt to shards by hash. Each shard builds a hierarchical graph over its different
vectors and stores it as flat neighbour arrays, one row per node; every query then searches every
shard's graph, and the shards' results are merged. Equal vectors are one node, which carries the
smallest ids that could appear in a result, so copies neither swamp a graph nor lose a row.

Largest inner product becomes smallest distance by one more component, sqrt(max |x|^2 - |x|^2),
which is 0 for queries. Graphs are searched in single precision; what is found is scored on the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bizmetrics.llm.common import ship
from bizmetrics.session import cut_lineage

#: Links per node (twice as many in the lowest layer), and the widths of the beams that build and search.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 80, 128
#: Shards at least, and the vectors one aims for: a size at which the beam's recall was measured (see README).
LEAST_SHARDS, SHARD_ROWS = 12, 4_300
#: Vectors of the shards that one task searches, and their components: the bound of its memory. Queries are sent once to each task.
TASK_ROWS, TASK_VALUES = 500_000, 1 << 25
#: Nodes inserted at once, nodes of the beam expanded at once, and the cells of a block's visited table.
INSERTED, EXPANDED, CELLS = 256, 4, 1 << 26


@dataclass
class Graph:
    """Nodes are numbered from the highest layer down: layer l has nodes 0 to len(links[l]) - 1."""
    points: np.ndarray  # with the extra component, single precision
    links: list[np.ndarray]

    def beam(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int, inserted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest nodes found in a layer, nearest first, and their squared distances;
        -1 and infinity fill up. All queries take their steps together."""
        links = self.links[layer]
        size = inserted or len(links)
        ids, far = [], []
        block = max(1, CELLS // max(size, 1))
        for lo in range(0, len(queries), block):
            got = self._beam(queries[lo:lo + block], entry[lo:lo + block], links, width, size)
            ids.append(got[0])
            far.append(got[1])
        return np.concatenate(ids), np.concatenate(far)

    def _beam(self, queries, entry, links, width, size):
        n = len(queries)
        ids, far = np.full((n, width), -1, np.int64), np.full((n, width), np.inf, np.float32)
        done = np.ones((n, width), bool)
        seen = np.zeros((n, size), bool)
        ids[:, 0], done[:, 0], seen[np.arange(n), entry] = entry, False, True
        far[:, 0] = ((self.points[entry] - queries) ** 2).sum(1)
        on = np.arange(n)
        while len(on):
            open_far = np.where(done[on], np.inf, far[on])
            pick = np.argpartition(open_far, min(EXPANDED, width) - 1, axis=1)[:, :EXPANDED]
            picked = np.take_along_axis(open_far, pick, 1) < np.inf
            live = picked.any(1)
            on, pick, picked = on[live], pick[live], picked[live]
            if not len(on):
                break
            done[on[:, None], pick] |= picked
            near = links[np.where(picked, ids[on[:, None], pick], 0)]
            near = np.where(picked[:, :, None], near, -1).reshape(len(on), -1)
            near.sort(axis=1)
            new = (near >= 0) & np.r_["1", np.ones((len(on), 1), bool), near[:, 1:] != near[:, :-1]]
            new &= ~seen[on[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(new)
            found = near[row, col]
            seen[on[row], found] = True
            gap = self.points[found] - queries[on[row]]
            reach = np.full(near.shape, np.inf, np.float32)
            reach[row, col] = np.einsum("ij,ij->i", gap, gap)
            all_ids = np.concatenate([ids[on], np.where(new, near, -1)], 1)
            all_far = np.concatenate([far[on], reach], 1)
            all_done = np.concatenate([done[on], ~new], 1)
            best = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            ids[on], far[on], done[on] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_done))
        order = np.lexsort((ids, far), axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """For each query the nearest node found on the way from the top to above layer ``down_to``."""
        at = np.zeros(len(queries), np.int64)
        for layer in range(len(self.links) - 1, down_to, -1):
            at = self.beam(queries, at, layer, EXPANDED)[0][:, 0]
        return at


def _diverse(points: np.ndarray, owner: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each owner's candidates (sorted by distance, -1 fills up) the first ``most`` that are nearer to the
    owner than to any chosen before; free places go to the nearest of the rest."""
    n, width = near.shape
    out = np.full((n, most), -1, np.int64)
    for lo in range(0, n, 512):
        some, gaps = near[lo:lo + 512], far[lo:lo + 512]
        here = points[np.maximum(some, 0)]
        square = np.einsum("ijk,ijk->ij", here, here)
        apart = square[:, :, None] + square[:, None, :] - 2 * np.matmul(here, here.transpose(0, 2, 1))
        chosen = np.zeros(some.shape, bool)
        blocked = np.full(some.shape, np.inf, np.float32)  # distance to the nearest chosen
        for c in range(width):
            ok = (some[:, c] >= 0) & (gaps[:, c] < blocked[:, c]) & (chosen.sum(1) < most)
            chosen[:, c] = ok
            blocked = np.where(ok[:, None], np.minimum(blocked, apart[:, c, :]), blocked)
        rank = np.where(some < 0, 2, np.where(chosen, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(some, order, 1), -1)
        out[lo:lo + 512, :picked.shape[1]] = picked
    return out


def _uniform(n: int) -> np.ndarray:
    """Reproducible numbers in (0, 1], by node number."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54


def _single(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """For walking the graph only: in single precision, doubles scaled (all together, or each by itself) by a
    power of two that brings them into its range. Scaled inner products have the same order."""
    if vectors.dtype == np.float32:
        return vectors
    _, power = np.frexp(np.abs(vectors).max(axis=axis, keepdims=True, initial=0))
    return np.ldexp(vectors, -power).astype(np.float32)


def extended(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the component that makes the largest inner product the smallest distance."""
    vectors = _single(vectors)
    square = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    more = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
    return np.concatenate([vectors, more[:, None]], 1).astype(np.float32)


def build(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> tuple[Graph, np.ndarray]:
    """The graph over ``vectors``, and for each node the row it stands for."""
    levels = np.floor(-np.log(_uniform(len(vectors))) / np.log(links)).astype(int)
    order = np.argsort(-levels, kind="stable")
    points = extended(vectors)[order]
    counts = [int((levels >= layer).sum()) for layer in range(levels.max(initial=0) + 1)]
    graph = Graph(points, [np.full((c, links * (2 if layer == 0 else 1)), -1, np.int32) for layer, c in enumerate(counts)])
    for layer in range(len(counts) - 1, -1, -1):
        above = counts[layer + 1] if layer + 1 < len(counts) else 0
        at = 0
        while at < counts[layer]:
            stop = min(counts[layer], at + max(min(INSERTED, at), 64))
            _insert(graph, layer, at, stop, above, links, beam)
            at = stop
    return graph, order


def _insert(graph: Graph, layer: int, at: int, stop: int, above: int, links: int, beam: int) -> None:
    """Add nodes ``at`` to ``stop`` to a layer whose nodes before ``at`` are linked."""
    points, new = graph.points, np.arange(at, stop)
    mine = points[new]
    near, far = np.full((len(new), 0), -1, np.int64), np.full((len(new), 0), np.inf, np.float32)
    if at:
        entry = np.zeros(len(new), np.int64)
        lower = new >= above
        if above and lower.any():
            entry[lower] = graph.descend(mine[lower], layer)
            entry = np.where(entry < at, entry, 0)
        near, far = graph.beam(mine, entry, layer, beam, inserted=at)
    among = np.maximum(((mine ** 2).sum(1)[:, None] + (mine ** 2).sum(1)[None, :] - 2 * mine @ mine.T), 0)
    np.fill_diagonal(among, np.inf)
    few = min(len(new), links)
    close = np.argpartition(among, few - 1, axis=1)[:, :few]
    gap = np.take_along_axis(among, close, 1).astype(np.float32)
    near = np.concatenate([near, np.where(gap < np.inf, new[close], -1)], 1)
    far = np.concatenate([far, gap], 1)
    order = np.argsort(far, axis=1, kind="stable")[:, :beam]
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    width = graph.links[layer].shape[1]
    chosen = _diverse(points, new, near, far, links)
    graph.links[layer][new, :chosen.shape[1]] = chosen
    # Links back. A node with too many keeps the diverse ones among its nearest.
    row, col = np.nonzero(chosen >= 0)
    to, back = chosen[row, col], new[row]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    most = min(int(counts.max(initial=0)), 4 * links)
    for lo in range(0, len(nodes), 2048):
        some, cnt = nodes[lo:lo + 2048], counts[lo:lo + 2048]
        added = np.full((len(some), int(cnt.max())), -1, np.int64)
        r = np.repeat(np.arange(len(some)), cnt)
        c = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        added[r, c] = back[first[lo]:first[lo] + cnt.sum()]
        added[(added[:, :, None] == graph.links[layer][some][:, None, :]).any(2)] = -1
        both = np.concatenate([graph.links[layer][some], added], 1)
        gap = points[np.maximum(both, 0)] - points[some][:, None, :]
        reach = np.where(both >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf).astype(np.float32)
        order = np.argsort(reach, axis=1, kind="stable")[:, :width + most]
        both, reach = np.take_along_axis(both, order, 1), np.take_along_axis(reach, order, 1)
        graph.links[layer][some] = _diverse(points, some, both, reach, width)


NODE_ARROW = pa.schema([("part", pa.int64()), ("node", pa.int32()), ("ids", pa.list_(pa.int64())), ("links", pa.list_(pa.int32()))])
NODE = "part bigint, node int, ids array<bigint>, links array<int>, vec array<{}>"


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def _build_shard(links: int, beam: int):
    def run(shard: pa.Table) -> pa.Table:
        graph, order = build(_vectors(shard["vec"]), links, beam)
        nodes = shard.take(pa.array(order))
        flat = [np.concatenate([layer[i] for layer in graph.links if i < len(layer)]) for i in range(len(order))]
        return pa.table({"part": nodes["part"], "node": pa.array(np.arange(len(order)), pa.int32()), "ids": nodes["ids"],
                         "links": _lists(flat, pa.int32())}).cast(NODE_ARROW).append_column("vec", nodes["vec"])
    return run


def _search_shards(k: int, links: int, beam: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group of shards: its shards one by one, their nodes in order, and then the queries."""
        group, nodes, graphs = None, [], []
        for batch in batches:
            groups, kinds, parts = (batch.column(c).to_numpy() for c in ("group", "kind", "part"))
            new = (np.diff(groups) != 0) | (np.diff(kinds) != 0) | (np.diff(parts) != 0)
            cuts = np.r_[0, np.nonzero(new)[0] + 1, len(parts)] if len(parts) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows = batch.slice(int(lo), int(hi - lo))
                if groups[lo] != group:
                    group, nodes, graphs = groups[lo], [], []
                if kinds[lo] == 0:
                    if nodes and nodes[0].column("part")[0].as_py() != parts[lo]:
                        graphs.append(_loaded(pa.Table.from_batches(nodes), links))
                        nodes = []
                    nodes.append(rows)
                    continue
                if nodes:
                    graphs.append(_loaded(pa.Table.from_batches(nodes), links))
                    nodes = []
                if not graphs:
                    continue  # no candidate has as many components
                found = _search(graphs, rows, k, beam)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)
    return run


def _loaded(nodes: pa.Table, links: int) -> tuple[Graph, np.ndarray, pa.Array]:
    vectors = _vectors(nodes["vec"])
    flat = nodes["links"].combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    starts, values = flat.offsets.to_numpy()[:-1], flat.values.to_numpy()
    layers, at = [], 0
    while at < sizes.max():
        width = links * (2 if at == 0 else 1)
        count = int((sizes > at).sum())
        layers.append(values[starts[:count, None] + at + np.arange(width)])
        at += width
    return Graph(extended(vectors), layers), vectors, nodes["ids"].combine_chunks()


def _search(graphs, rows, k, beam):
    queries = _vectors(rows.column("vec"))
    asked = np.concatenate([_single(queries, 1), np.zeros((len(queries), 1), np.float32)], 1)
    own = rows.column("query_id").to_numpy()
    query, score, vec_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for graph, vectors, ids in graphs:
        found = _found(graph, vectors, ids, asked, queries, own, beam)
        query, score, vec_id = (np.concatenate(x) for x in zip((query, score, vec_id), found))
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        starts = np.nonzero(np.diff(query, prepend=-1) != 0)[0]
        top = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)])) < k
        query, score, vec_id = query[top], score[top], vec_id[top]
    return (own[query], rows.column("query_key").to_numpy()[query], vec_id, score) if len(query) else None


def _found(graph, vectors, ids, asked, queries, own, beam):
    """What one graph leads to: number of the query, score and id."""
    near, _ = graph.beam(asked, graph.descend(asked, 0), 0, min(beam, len(vectors)))
    query, col = np.nonzero(near >= 0)
    node = near[query, col]
    score = np.einsum("ij,ij->i", vectors[node].astype(np.float64), queries[query].astype(np.float64))
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    sizes = offsets[node + 1] - offsets[node]
    rep = np.repeat(np.arange(len(node)), sizes)
    vec_id = values[np.arange(len(rep)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[node][rep]]
    query, score = query[rep], score[rep]
    keep = vec_id != own[query]
    return query[keep], score[keep], vec_id[keep]


def _kind(*columns: tuple[DataFrame, str]) -> str:
    """The element type in which vectors are compared: float if all columns hold floats, else double."""
    given = {df.select(F.col(f"`{c}`")).schema[0].dataType.simpleString() for df, c in columns}
    return "float" if given == {"array<float>"} else "double"


def _usable(rows: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    vec = F.col(f"`{vec_col}`").cast(f"array<{kind}>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vec.alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)))


def index(rows: DataFrame, k: int, links: int = LINKS, beam: int = BUILD_BEAM, shards: int | None = None,
          id_col: str = "vec_id", vec_col: str = "embedding", kind: str | None = None) -> tuple[DataFrame, int]:
    """The stored graphs of all usable vectors, one row per node, and the number of groups of shards: the shards of
    a group, of ``TASK_ROWS`` vectors or ``TASK_VALUES`` components together, are searched in one task."""
    ship(rows.sparkSession)
    kind = kind or _kind((rows, vec_col))
    each = _usable(rows, id_col, vec_col, kind).distinct()
    # Of equal vectors the k + 1 smallest ids can be in a result, the query's own left out.
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = each.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    different = cut_lineage(kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n, values = different.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    shards = shards or max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    groups = min(shards, max(LEAST_SHARDS, -(-n // TASK_ROWS), -(-values // TASK_VALUES)))
    dealt = different.withColumn("part", F.size("vec").cast("bigint") * shards + F.pmod(F.xxhash64("vec"), F.lit(shards)))
    # Vectors with other numbers of components are in graphs of their own.
    ordered = dealt.select("part", "ids", "vec")
    nodes = ordered.groupBy("part").applyInArrow(_build_shard(links, beam), NODE.format(kind))
    group = F.size("vec").cast("bigint") * groups + F.pmod(F.col("part") - F.size("vec").cast("bigint") * shards, F.lit(groups))
    return cut_lineage(nodes.withColumn("group", group)), groups


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, links: int = LINKS, build_beam: int = BUILD_BEAM,
            beam: int = SEARCH_BEAM, shards: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each of ``queries`` its ``k`` nearest of ``rows`` by inner product that the graphs lead to, its own id left
    out: ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the inner product in double precision, of the
    vectors as they are given; only the way through the graph is found in single precision).

    Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part, nor
    do rows without an id; a query meets only vectors with as many components as it has. Repeated rows count
    once. Fewer candidates than ``k`` give fewer rows; empty tables give none. Recall is measured against brute
    force in the tests. Shards hold about ``SHARD_ROWS`` vectors, so that the beam sees as much of each
    whatever the table holds. A task holds shards of about ``TASK_ROWS`` vectors together and streams the queries.
    """
    kind = _kind((rows, vec_col), (queries, vec_col))
    nodes, groups = index(rows, k, links, build_beam, shards, id_col, vec_col, kind)
    asked = _usable(queries, id_col, vec_col, kind).distinct().withColumnRenamed("vec_id", "query_id").withColumn("query_key", F.xxhash64("vec"))
    tasks = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.size("vec").cast("bigint") * groups + g)
    to_all = asked.select(F.explode(tasks).alias("group"), F.lit(1).alias("kind"), "query_id", "query_key", "vec")
    none = lambda type_: F.lit(None).cast(type_)
    both = (nodes.select("group", F.lit(0).alias("kind"), "part", "node", "ids", "links", none("bigint").alias("query_id"), none("bigint").alias("query_key"), "vec")
            .unionByName(to_all.select("group", "kind", F.lit(-1).cast("bigint").alias("part"), none("int").alias("node"), none("array<bigint>").alias("ids"),
                                       none("array<int>").alias("links"), "query_id", "query_key", "vec")))
    found = both.repartition("group").sortWithinPartitions("group", "kind", "part", "node").mapInArrow(
        _search_shards(k, links, beam), "query_id bigint, query_key bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
