"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Rows are dealt to shards by a hash. In a shard, vectors enter a graph in growing batches: a
greedy search from the entry point proposes neighbours, and relaxed pruning keeps those that
are not better reached through one kept before, so that edges stay diverse; edges run back
too, and full nodes are pruned again. A query is walked through the graph of each shard with
a beam, and the nearest of all shards are ranked by their exact distance.

Equal vectors of a shard are one node with all their ids, so copies neither fill a
neighbourhood nor a beam.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.text import named
from tandemtext.llm.vectors import matrix, whole

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, RELAXED = 32, 64, 1.1
# A node takes edges back until it has this many times its degree, and then chooses again.
SLACK = 2
BEAM = 128
EXPANDED = 4
BATCH, QUERY_BLOCK = 512, 512


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of each point (b, d) to its own others (b, n, d)."""
    apart = others - points[:, None]
    return np.einsum("bnd,bnd->bn", apart, apart)


def beam_search(
    data: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The beam of each query, and all nodes it expanded on the way, with squared distances.

    All queries walk side by side: a step expands the nearest few nodes of each beam that are
    not yet expanded. Node -1 at infinite distance is none.
    """
    q, m = len(queries), len(data)
    rows = np.arange(q)[:, None]
    nodes = np.full((q, beam), -1, np.int32)
    nodes[:, 0] = start
    far = np.full((q, beam), np.inf, np.float32)
    far[:, 0] = squared(queries, data[np.full((q, 1), start)])[:, 0]
    done = far == np.inf
    seen = np.zeros((q, m + 1), bool)
    seen[:, [start, m]] = True
    trail_nodes, trail_far = [], []
    while True:
        open_far = np.where(done, np.inf, far)
        step = min(EXPANDED, beam)
        near = np.argpartition(open_far, step - 1, axis=1)[:, :step]
        picked = ~done[rows, near]
        walking = np.flatnonzero(picked.any(1))
        if not len(walking):
            break
        done[rows, near] = True
        expanded = np.where(picked, nodes[rows, near], -1)
        trail_nodes.append(expanded)
        trail_far.append(np.where(picked, far[rows, near], np.inf).astype(np.float32))
        # Only those who still walk look at neighbours; node m stands for none.
        own = walking[:, None]
        met = graph[expanded[walking]]
        met = np.where((expanded[walking] < 0)[:, :, None] | (met < 0), m, met).reshape(len(walking), -1)
        met.sort(axis=1)
        met[:, 1:][met[:, 1:] == met[:, :-1]] = m
        met = np.where(seen[own, met], m, met)
        met.sort(axis=1)
        met = met[:, : max(1, (met < m).sum(1).max())]
        seen[own, met] = True
        distance = squared(queries[walking], data[np.minimum(met, m - 1)])
        distance[met == m] = np.inf
        all_nodes = np.concatenate([nodes[walking], np.where(met == m, -1, met).astype(np.int32)], 1)
        all_far = np.concatenate([far[walking], distance], 1)
        all_done = np.concatenate([done[walking], met == m], 1)
        kept = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        here = np.arange(len(walking))[:, None]
        nodes[walking], far[walking], done[walking] = all_nodes[here, kept], all_far[here, kept], all_done[here, kept]
    return nodes, far, np.concatenate(trail_nodes, 1), np.concatenate(trail_far, 1)


def robust_prune(
    data: np.ndarray, points: np.ndarray, candidates: np.ndarray, far: np.ndarray, degree: int, relaxed: float
) -> np.ndarray:
    """Neighbours of each point: the nearest candidate, then the nearest not covered, and so on.

    A candidate is covered if a kept neighbour is nearer to it than the point is, by the factor
    ``relaxed`` at least. ``candidates`` (b, c) are distinct nodes by row, -1 for none.
    """
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    used = (candidates >= 0).sum(1).max(initial=1)
    candidates, far = candidates[:, :used], far[:, :used]
    alive = candidates >= 0
    # Relative to the point, so that near ones keep their digits.
    around = data[candidates] - data[points][:, None]
    around[~alive] = 0
    norms = np.einsum("bcd,bcd->bc", around, around)
    kept = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for place in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, place] = candidates[rows, first][some]
        chosen = around[rows, first]
        between = norms + norms[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", around, chosen)
        alive &= relaxed**2 * np.maximum(between, 0) > norms
        alive[rows, first] = False
    return kept


def distinct_by_row(nodes: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node once in its row; what repeats becomes -1."""
    order = np.argsort(nodes, axis=1, kind="stable")
    nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
    again = np.zeros(nodes.shape, bool)
    again[:, 1:] = nodes[:, 1:] == nodes[:, :-1]
    return np.where(again, -1, nodes), np.where(again | (nodes < 0), np.inf, far).astype(np.float32)


def build_graph(
    data: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED
) -> tuple[np.ndarray, int]:
    """Neighbours (nodes, degree; -1 for none) of distinct vectors, and the entry point.

    The entry point is the vector nearest to the mean. Batches double until ``BATCH``.
    """
    m = len(data)
    graph = np.full((m, SLACK * degree), -1, np.int32)

    def choose_again(points: np.ndarray, candidates: np.ndarray) -> None:
        for a in range(0, len(points), BATCH):
            own, choice = points[a : a + BATCH], candidates[a : a + BATCH]
            apart = np.where(choice < 0, np.inf, squared(data[own], data[choice]))
            graph[own] = -1
            graph[own, :degree] = robust_prune(data, own, *distinct_by_row(choice, apart), degree, relaxed)

    mean = data.mean(0, dtype=np.float64).astype(np.float32)
    start = int(squared(mean[None], data[None])[0].argmin())
    order = np.random.default_rng(m).permutation(m).astype(np.int32)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    inside = 1
    while inside < m:
        batch = order[inside : inside + min(inside, BATCH)]
        inside += len(batch)
        nodes, far, trail, trail_far = beam_search(data, graph, start, data[batch], beam)
        proposed, distance = distinct_by_row(
            np.concatenate([nodes, trail], 1), np.concatenate([far, trail_far], 1)
        )
        chosen = robust_prune(data, batch, proposed, distance, degree, relaxed)
        graph[batch, :degree] = chosen
        # Edges back.
        to, back = chosen.reshape(-1), np.repeat(batch, degree)
        to, back = to[to >= 0], back[to >= 0]
        order_to = np.argsort(to, kind="stable")
        to, back = to[order_to], back[order_to]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for width in np.unique(counts):
            some = np.flatnonzero(counts == width)
            incoming = back[first[some][:, None] + np.arange(width)]
            own = np.concatenate([graph[targets[some]], incoming], 1)
            full = (own >= 0).sum(1) > SLACK * degree
            # Those with room take them; the others choose again.
            graph[targets[some][~full]] = np.sort(own[~full], axis=1)[:, ::-1][:, : SLACK * degree]
            choose_again(targets[some][full], own[full])
    over = np.flatnonzero(graph[:, degree] >= 0)
    choose_again(over, graph[over])
    return graph[:, :degree], start


def comparable(vectors: np.ndarray) -> np.ndarray:
    """For walking: single precision, scaled so that squares stay finite."""
    most = np.abs(vectors).max(initial=0)
    return (vectors / (most or 1)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Vectors that take part: finite, and not zero throughout."""
    return whole(vector) & F.exists(vector, lambda x: x != 0)


def shard_count(rows: int, shard_rows: int) -> int:
    return max(1, math.ceil(rows / shard_rows))


def build_index(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BUILD_BEAM,
    relaxed: float = RELAXED,
) -> DataFrame:
    """The graphs of all shards, a row for each node: ``shard, node, ids, vector, neighbours``.

    Node 0 of a shard is its entry point. Vectors that are null, zero or hold null or
    non-finite components are left out; all others are in it, those with a null id too.
    Rows equal in id and vector are one. Vectors of different lengths are an error. To be
    written before it is searched; a lost task builds its shard again, to the same graph.
    """
    rows = vectors.select(named(id_column).alias("id"), named(vector_column).alias("vector")).where(
        usable(F.col("vector"))
    )
    shards = shard_count(rows.count(), shard_rows)
    placed = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    # Twice as many partitions, so that few of them get several shards.
    dealt = placed.repartition(2 * shards, "shard").sortWithinPartitions("shard", "id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunks, last = None, [], (None, None)

        def graph_of() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(chunks).combine_chunks()
            exact = matrix(table.column(2).combine_chunks())
            distinct, of_row = np.unique(exact, axis=0, return_inverse=True)
            of_row = of_row.reshape(-1)
            graph, start = build_graph(comparable(distinct), degree, beam, relaxed)
            # The entry point changes places with node 0.
            place = np.arange(len(distinct))
            place[[0, start]] = [start, 0]
            swapped = np.where(graph < 0, -1, place[graph])[place]
            by_node = np.argsort(place[of_row], kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(place[of_row], minlength=len(distinct)))])
            lengths = (swapped >= 0).sum(1)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            kind = table.column(2).type.value_type
            width = exact.shape[1]
            columns = [
                pa.array(np.full(len(distinct), shard, np.int32)),
                pa.array(np.arange(len(distinct), dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.column(1).combine_chunks().take(pa.array(by_node))),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(distinct) + 1, dtype=np.int32) * width),
                    pa.array(distinct[place].reshape(-1)).cast(kind),
                ),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(swapped[swapped >= 0].astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "ids", "vector", "neighbours"])

        for batch in batches:
            # Rows come by shard and id; a row that was just there is passed over.
            stays = np.ones(batch.num_rows, bool)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, key in enumerate(keys):
                if key == last[0]:
                    bytes_ = str(batch.column(2)[i].as_py())
                    stays[i] = bytes_ not in last[1]
                    last[1].add(bytes_)
                elif i + 1 == len(keys) or keys[i + 1] == key:
                    last = key, {str(batch.column(2)[i].as_py())}
            for part in by_shard(batch.filter(pa.array(stays))):
                here = part.column(0)[0].as_py()
                if shard is not None and here != shard:
                    yield from graph_of()
                    chunks = []
                shard = here
                chunks.append(part)
        if chunks:
            yield from graph_of()

    key, kind = rows.schema["id"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString()
    return dealt.mapInArrow(build, f"shard int, node int, ids array<{key}>, vector {kind}, neighbours array<int>")


def by_shard(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first column."""
    shards = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Shard:
    """A graph in memory, as read from the rows of the index."""

    def __init__(self, chunks: list[pa.RecordBatch]):
        table = pa.Table.from_batches(chunks).combine_chunks()
        self.exact = matrix(table.column("vector").combine_chunks())
        self.ids = table.column("ids").to_pylist()
        edges = table.column("neighbours").combine_chunks()
        lengths = edges.value_lengths().to_numpy(zero_copy_only=False)
        self.graph = np.full((len(lengths), max(1, lengths.max(initial=1))), -1, np.int32)
        inside = np.arange(self.graph.shape[1]) < lengths[:, None]
        self.graph[inside] = edges.flatten().to_numpy(zero_copy_only=False)
        self.scale = np.abs(self.exact).max(initial=0) or 1
        self.near = (self.exact / self.scale).astype(np.float32)

    def nearest(self, ids: list, queries: np.ndarray, count: int, beam: int) -> Iterator[tuple]:
        """query id, id, distance: of each query the ``count`` nearest other ids that the beam met."""
        with np.errstate(over="ignore"):
            walked = (queries / self.scale).astype(np.float32)
        nodes, *_ = beam_search(self.near, self.graph, 0, walked, beam)
        apart = np.sqrt(squared(queries, self.exact[nodes]))
        apart[nodes < 0] = np.inf
        for query, met, far in zip(ids, nodes, apart):
            order = np.lexsort([met, far])
            found, edge = [], None
            for node, distance in zip(met[order].tolist(), far[order].tolist()):
                if node < 0 or len(found) >= count and distance > edge:
                    break
                own = sorted(i for i in self.ids[node] if i is not None and i != query)[:count]
                own += [None] * min(count - len(own), sum(i is None for i in self.ids[node]))
                found += [(distance, i is None, i or 0, i) for i in own]
                edge = distance
            for distance, _, _, i in sorted(found, key=lambda f: f[:3])[:count]:
                yield query, i, distance


def search(index: DataFrame, queries: DataFrame, count: int = 10, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, id, score``: the ``count`` ids nearest to each query, without its own.

    ``queries`` has ``id`` (not null) and ``vector``; vectors that take no part in an index ask
    nothing. The score is the Euclidean distance in double precision; ties go to the smaller
    id, null last. An id with several vectors counts once, by the nearest of them, and so does
    a query id. Every query visits every shard; a task holds one shard and a block of
    queries. A query alone in its index has no row.
    """
    last = index.agg(F.max("shard")).first()[0]
    shards = 0 if last is None else last + 1
    key, kind = queries.schema["id"].dataType.simpleString(), index.schema["vector"].dataType.simpleString()
    asked = (
        queries.where(usable(F.col("vector")) & F.col("id").isNotNull())
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))) if shards else F.lit(0))
        .select(
            "shard",
            F.lit(1).alias("asks"),
            F.lit(0).alias("node"),
            F.array("id").alias("ids"),
            F.col("vector").cast(kind).alias("vector"),
            F.array().cast("array<int>").alias("neighbours"),
        )
    )
    nodes = index.select("shard", F.lit(0).alias("asks"), "node", "ids", "vector", "neighbours")
    # By shard: first its nodes, then the queries.
    dealt = nodes.union(asked).repartition(max(1, 2 * shards), "shard").sortWithinPartitions("shard", "asks", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunks, graph, waiting = None, [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, graph
            rows, waiting = waiting, []
            if not rows or not chunks and graph is None:
                return
            graph = graph or Shard(chunks)
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = [i[0] for i in table.column("ids").to_pylist()]
            vectors = matrix(table.column("vector").combine_chunks(), graph.exact.shape[1])
            found = [*zip(*graph.nearest(ids, vectors, count, beam))] or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], id_type), pa.array(found[1], id_type), pa.array(found[2], pa.float64())],
                names=["query_id", "id", "score"],
            )

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for part in by_shard(batch):
                if part.column(0)[0].as_py() != shard:
                    yield from answers()
                    shard, chunks, graph = part.column(0)[0].as_py(), [], None
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                border = int(np.searchsorted(asks, 1))
                if border:
                    chunks.append(part.slice(0, border))
                for a in range(border, part.num_rows, QUERY_BLOCK):
                    if sum(w.num_rows for w in waiting) + 1 > QUERY_BLOCK // 2:
                        yield from answers()
                    waiting.append(part.slice(a, QUERY_BLOCK))
        yield from answers()

    found = dealt.mapInArrow(run, f"query_id {key}, id {key}, score double")
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy("score", F.col("id").asc_nulls_last())
    return once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= count).select(
        "query_id", "rank", "id", "score"
    )


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (query_id, id) that is found."""
    row = (
        exact.select("query_id", "id")
        .join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
        .agg(F.count("*").alias("all"), F.count("hit").alias("hits"))
        .first()
    )
    return row["hits"] / row["all"] if row["all"] else 1.0
