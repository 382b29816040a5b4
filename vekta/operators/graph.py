"""Neighbour-graph ANN index built and searched with DataFrame joins.

Build:
  * a start from random projections: nodes with equal sign codes meet in bounded groups,
    several codes a node;
  * rounds of neighbour descent (Dong et al. 2011) as a local join by neighbourhood: the nodes around v,
    those v points at and those that point at v, meet in one group with one vector each, and a
    vectorised Arrow kernel scores all pairs inside. The nodes that point at a hub are split into
    blocks, each of which meets all nodes that the hub points at. A pair leaves its group only if it
    beats the farthest candidate that its node holds, so late rounds ship next to nothing;
  * each node keeps its nearest ``ef_construction`` candidates; when few change, a second kernel prunes
    them by diversity to ``m`` links: a candidate that is nearer to a link already kept than to the node is
    passed over (and only fills places left free).

The index adjacency is bidirectional with bounded degree: m out-links plus
up to m links back from the nearest nodes pointing at a node. Nodes (id, vector, links) are one table,
bucketed by id.

Vectors by home: nodes that lie together have one home, a bounded number of them, and what is done for the nodes of a home
is done by one task. It gets each vector it needs once, however many neighbourhoods, candidates or beams name it: the
wanted (home, id) pairs go to the node table, which is never exchanged, and bring the vectors back. Homes decide where work is
done, never what comes out.

Search (batched beam search): every query keeps a beam of ``max(ef, k)`` nodes. A round
fetches the neighbours of the unexpanded beam nodes to the homes of the queries, scores them there and merges the best
into the beam. The beam is all that is kept
and rewritten: it only gets nearer, so a node that fell out of it can be scored again but cannot come
back, and no visited set is needed. Stops when every beam node is expanded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.sizing import grid_partitions, vector_dim
from ..plans.staging import dropped, staged
from ..session import scratch_path
from . import kernel as K
from .knn import _empty, _prep, exact_candidates, knn_join, rank_candidates, sample_queries

# Graph index parameter defaults of the reference.
DEFAULT_M = 32
DEFAULT_EF_CONSTRUCTION = 128
DEFAULT_EF = 10
MIN_ENTRY_POINTS = 64

NEIGHBOURHOOD = 16     # nearest candidates of a node that take part in a local join, each way
START_GROUP = 256      # nodes that meet in a group of the start, about
BUCKET_NODES = 512     # least nodes of a bucket, where that leaves every core one
START_CODES = 4        # random codes of a node at the start
HOME_NODES = 4096      # most nodes of a home
HOME_LEAST = 512       # homes are made smaller than that for no core's sake
HOME_CANDIDATES = 2 ** 20     # candidates that the queries of a home meet in the first round, at most,
SMALL_GRAPH = 2 ** 17         # unless the graph has so few nodes that a home can hold them all
HOME_POOL = 2 ** 18    # candidates of the nodes of a home that are pruned together, about
HUB_BLOCKS = 16        # blocks of a hub that stay at its home; the others are dealt to other homes
MOST_PIVOTS = 4096     # nodes around which homes lie; a home beyond its bound is split
SLICE = 2 ** 20        # candidates that are scored at a time
EDGE = "src long, dst long, distance double"


@dataclass
class GraphIndex:
    nodes: DataFrame     # (id, v, links): bucketed by id
    edges: DataFrame     # (src, dst, distance, rank, kind): kind 'out' rank 1..m, 'in' <= m
    m: int
    ef_construction: int
    dim: int

    @property
    def vectors(self) -> DataFrame:
        return self.nodes.select("id", "v")


@dataclass
class GraphFamily:
    """Graphs of one base that are searched together."""
    nodes: DataFrame     # (id, v, links): links[i] are those of graph i; bucketed by id
    sets: list[tuple[int, int]]     # (m, ef_construction) of graph i
    dim: int


# ------------------------------------------------------------- bucketed tables
def write_bucketed(df: DataFrame, path: str, buckets: int, by: str = "id") -> DataFrame:
    """``df`` as a table bucketed and sorted by ``by``, one file a bucket: joins on it need no exchange of it."""
    name = f"vekta_{uuid.uuid4().hex}"
    (df.repartition(buckets, by).write.format("parquet").option("path", path)
     .bucketBy(buckets, by).sortBy(by).saveAsTable(name))
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, buckets: int, by: str = "id") -> DataFrame:
    """A table written by ``write_bucketed``, in any session."""
    name = f"vekta_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _buckets(spark: SparkSession, n: int) -> int:
    """Buckets of a table of ``n`` nodes: a search round has a task for each, so few nodes are not cut into many."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, n // BUCKET_NODES))


# --------------------------------------------------------------------- kernels
def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, bounds) of whole groups from batches sorted by ``keys``: bounds[i]:bounds[i+1] is a group.
    Holds one batch and the group that goes over its end."""
    held: list[pa.RecordBatch] = []

    def cut(rb: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, rb.num_rows - 1), bool)
        for k in keys:
            c = rb.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [rb.num_rows]])

    for rb in batches:
        if rb.num_rows == 0:
            continue
        held.append(rb)
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bounds = cut(whole)
        held = [whole.slice(int(bounds[-2]))]
        if len(bounds) > 2:
            yield whole.slice(0, int(bounds[-2])), bounds[:-1]
    if held:
        yield held[0], np.array([0, held[0].num_rows])


def _edge_batch(src: list[np.ndarray], dst: list[np.ndarray], dist: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst, dist)], ["src", "dst", "distance"])


def _local_join(batches: Iterator[pa.RecordBatch], keys: list[str], dim: int, most: int, split: int = 0) -> Iterator[pa.RecordBatch]:
    """All pairs inside each group of members (id, v): for each member its ``most`` nearest others. Groups beyond ``split``
    members are cut into chunks."""
    for rb, bounds in _runs(batches, keys):
        ids = rb.column("id").to_numpy()
        v, valid = K.vectors_from_arrow(rb.column("v"), dim)
        v, ok = K.normalise(v, valid)
        chunks = [(s, e) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                  for s, e in ([(a, b)] if not split else [(s, min(s + split, b)) for s in range(a, b, split)])]
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in chunks:
            row, col = _near_pairs(v[s:e], ok[s:e], ids[s:e], most)
            src.append(s + row), dst.append(s + col)
        src, dst = np.concatenate(src), np.concatenate(dst)
        yield _edge_batch([ids[src]], [ids[dst]], [K._pair_distances(v, v, src, dst)])


def _near_pairs(v: np.ndarray, ok: np.ndarray, ids: np.ndarray, most: int, fresh: np.ndarray | None = None,
                bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, col) of a group: for each member its ``most`` nearest others that are nearer than its bound, of pairs with a fresh member."""
    n = min(most, len(v) - 1)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = 1.0 - v @ v.T
    if fresh is not None:
        old = ~fresh
        d[np.ix_(old, old)] = np.inf
    d[~ok, :] = np.inf
    d[:, ~ok] = np.inf
    d[ids[:, None] == ids[None, :]] = np.inf
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    row = np.repeat(np.arange(len(v)), n)
    col = near.ravel()
    keep = d[row, col] < (np.inf if bound is None else bound[row])
    return row[keep], col[keep]


def _at(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, row): for each ``wanted[i]`` the rows of ``ids`` (sorted) that hold it: none, one, or all where an id repeats."""
    first, last = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, side="right")
    count = last - first
    i = np.repeat(np.arange(len(wanted)), count)
    return i, np.repeat(first, count) + _within(count)


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count[0] - 1, 0, 1, ... count[1] - 1, ..."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _fetched(nodes: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, ids, unit vectors, usable) of the node rows that came to a home, by id."""
    ids = nodes.column("id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    single = pa.types.is_float32(nodes.column("v").type.value_type)
    v, valid = K.vectors_from_arrow(nodes.column("v"), dim, np.float32 if single else np.float64)
    unit, ok = np.empty(v.shape), np.empty(len(v), bool)
    for s in range(0, len(v), K.BLOCK_ROWS):
        at = order[s:s + K.BLOCK_ROWS]
        unit[s:s + K.BLOCK_ROWS], ok[s:s + K.BLOCK_ROWS] = K.normalise(v[at].astype(np.float64, copy=False), valid[at])
    return order, ids[order], unit, ok


def _home_join(members: pa.Table, nodes: pa.Table, dim: int, reach: int, most: int) -> pa.Table:
    """The local join of all neighbourhoods of a home. ``members``: (node, block, id, fresh), a neighbourhood for each (node, block);
    ``nodes``: (id, v, bound) of every member. A pair that several neighbourhoods find comes out once, and of a member
    only the ``most`` nearest."""
    order, ids, unit, ok = _fetched(nodes, dim)
    bounds_of = nodes.column("bound").to_numpy()[order]
    node, block = members.column("node").to_numpy(), members.column("block").to_numpy()
    member, fresh = members.column("id").to_numpy(), members.column("fresh").to_numpy()
    by = np.lexsort((member, block, node))
    node, block, member, fresh = node[by], block[by], member[by], fresh[by]
    group = np.concatenate([[True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])]) if len(node) else np.zeros(0, bool)
    new = group.copy()
    new[1:] |= member[1:] != member[:-1]
    first = np.flatnonzero(new)
    if len(first) == 0:
        return _EDGES.empty_table()
    fresh = np.logical_or.reduceat(fresh, first)
    i, row = _at(ids, member[first])
    group, fresh = (np.cumsum(group)[first])[i], fresh[i]
    ends = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        at = row[s:e]
        a, b = _near_pairs(unit[at], ok[at], ids[at], reach, fresh[s:e], bounds_of[at])
        src.append(at[a]), dst.append(at[b])
    pair = np.unique(np.concatenate(src) * len(ids) + np.concatenate(dst))
    src, dst = np.divmod(pair, max(1, len(ids)))
    dist = K._pair_distances(unit, unit, src, dst)
    src, dst = ids[src], ids[dst]
    if (ids[1:] == ids[:-1]).any():     # rows that share an id: one pair, the nearest
        by = np.lexsort((dist, dst, src))
        by = by[np.concatenate([[True] * min(1, len(by)), (src[by[1:]] != src[by[:-1]]) | (dst[by[1:]] != dst[by[:-1]])]).astype(bool)]
        src, dst, dist = src[by], dst[by], dist[by]
    by = np.lexsort((dst, dist, src))
    by = by[_ranks(src[by]) < most]
    return pa.table({"src": src[by], "dst": dst[by], "distance": dist[by]}, schema=_EDGES)


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """The number of each row within its run of equal keys, from 0."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.arange(len(sorted_keys))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _occlusion(cands: pa.Table, nodes: pa.Table, dim: int, sets: list[tuple[int, int]]) -> pa.Table:
    """Diversity pruning of the candidates (src, id, distance) of each node of a home, once for each (m, pool) of ``sets``: nearest first
    among the ``pool`` nearest, one that is nearer to a kept link than to the node is passed over; those passed over fill
    what is left of ``m`` places, nearest first. ``graph`` counts along ``sets``. ``nodes``: (id, v) of every candidate."""
    _, ids, unit, _ = _fetched(nodes, dim)
    source, distance = cands.column("src").to_numpy(), cands.column("distance").to_numpy()
    i, row = _at(ids, cands.column("id").to_numpy())
    source, distance = source[i], distance[i]
    by = np.lexsort((row, distance, source))     # rows are by id
    source, distance, row = source[by], distance[by], row[by]
    ends = np.concatenate([[0], np.flatnonzero(source[1:] != source[:-1]) + 1, [len(source)]])
    rows, graphs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        v = unit[row[s:e]]
        between = 1.0 - v @ v.T
        for graph, (m, pool) in enumerate(sets):
            n = min(pool, e - s)
            own = distance[s:s + n]
            nearest_kept = np.full(n, np.inf)
            kept = np.zeros(n, bool)
            left = m
            for i in range(n):
                if not nearest_kept[i] < own[i]:
                    kept[i] = True
                    left -= 1
                    if left == 0:
                        break
                    nearest_kept = np.minimum(nearest_kept, between[i, :n])
            chosen = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept)])[:m]
            rows.append(s + np.sort(chosen))
            graphs.append(np.full(len(chosen), graph, np.int32))
    at = np.concatenate(rows)
    return pa.table({"graph": np.concatenate(graphs), "src": source[at], "dst": ids[row[at]], "distance": distance[at]})


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("distance", pa.float64())])


# ----------------------------------------------------------------------- homes
def _homes(rows: DataFrame, dim: int, size: int, least: int = HOME_LEAST) -> tuple[DataFrame, int]:
    """((id, home), number of homes) of the ids of ``rows`` (id, v): at most about ``size`` ids a home, those around one of a
    sample of nodes. A home that many nodes share is split by hash. A few rows are dealt out until every core has a home."""
    spark = rows.sparkSession
    n = rows.count()
    cells = max(math.ceil(n / size), min(spark.sparkContext.defaultParallelism, n // least), 1)
    size = math.ceil(n / cells) if n else 1
    pivots = sample_queries(rows.where(F.size("v") == dim), min(cells, MOST_PIVOTS)).select("v").toArrow()
    near, _ = K.normalise(K.vectors_from_arrow(pivots.column("v"), dim or 1)[0])
    near = near.astype(np.float32).T

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            v, _ = K.vectors_from_arrow(rb.column("v"), dim, np.float32)
            at = np.concatenate([np.zeros(0, np.int64)] + [np.argmax(v[s:s + K.BLOCK_ROWS] @ near, axis=1) for s in range(0, len(v), K.BLOCK_ROWS)])
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(at.astype(np.int32))], ["id", "cell"])

    if near.shape[1] > 1:
        own = rows.mapInArrow(cell, "id long, cell int").groupBy("id").agg(F.min("cell").alias("cell"))
    else:
        own = rows.select("id").distinct().withColumn("cell", F.lit(0))
    own = staged(own, "graph-homes")
    held = sorted((r["cell"], math.ceil(r["count"] / (2 * size))) for r in own.groupBy("cell").count().collect())
    first = np.concatenate([[0], np.cumsum([p for _, p in held])]).astype(int).tolist()
    parts = spark.createDataFrame([(c, f, p) for (c, p), f in zip(held, first)], "cell int, first int, parts int")
    home = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("home")
    return own.join(F.broadcast(parts), "cell").select("id", home), max(1, first[-1])


def _by_home(df: DataFrame, homes: int):
    return df.repartitionById(grid_partitions(homes), "home").groupBy("home")


def _fetch(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes``, one for each home that names it in ``wanted`` (home, id)."""
    there = at_nodes(wanted.distinct(), nodes)
    return there.select(*[F.col(c).alias(c) for c in there.columns])     # columns of its own: it meets what ``wanted`` came from


# ----------------------------------------------------------------------- build
def _keep_best(cands: DataFrame, n: int, by: tuple[str, ...] = ("src",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("distance").asc_nulls_last(), F.col("dst"))
    return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("long")))


def _start(vectors: DataFrame, dim: int, n: int, most: int, seed: int) -> DataFrame:
    """First candidates: nodes with one sign code under random projections, in groups of about START_GROUP.
    Rows are dealt by range of (code, hash), so a code that many nodes share is split like any other."""
    bits = max(0, math.ceil(math.log2(max(1, n) / START_GROUP)))
    planes = np.random.default_rng(seed).normal(size=(START_CODES, dim or 1, bits))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            v, _ = K.vectors_from_arrow(rb.column("v"), dim)
            for t in range(START_CODES):
                code = ((v @ planes[t] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(v))).astype(np.int64) * START_CODES + t
                yield pa.RecordBatch.from_arrays([pa.array(code), rb.column("id"), rb.column("v")], ["code", "id", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    coded = vectors.mapInArrow(codes, f"code long, id long, v {kind}")
    order = ["code", F.xxhash64("id", F.lit(seed)), "id"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).select("code", "id", "v")
    return dealt.mapInArrow(lambda b: _local_join(b, ["code"], dim, most, 2 * START_GROUP), EDGE).repartition("src").distinct()


def local_join(edges: DataFrame, vectors: DataFrame, dim: int, reach: int, most: int, homes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Candidates (src, dst, distance) from the neighbourhoods of ``edges`` (src, dst, distance, rank, fresh), those around the nodes
    of a home together: one vector a member and home. A hub's in-neighbours are dealt to blocks of about ``2 * reach``.
    ``homes``: ``_homes`` of the vectors."""
    near = edges.where(F.col("rank") <= reach)
    homes, parts = homes or _homes(vectors, dim, HOME_NODES)
    pointed = near.groupBy(F.col("dst").alias("v_id")).agg(F.count(F.lit(1)).alias("n"))
    places = (homes.join(pointed, homes["id"] == pointed["v_id"], "left")
              .select(F.col("id").alias("v_id"), "home", F.coalesce(F.ceil(F.col("n") / (2 * reach)), F.lit(1)).cast("int").alias("blocks")))
    into = near.select(F.col("dst").alias("node"), F.col("src").alias("id"), "fresh")
    into = (into.join(places, into["node"] == places["v_id"])
            .select("home", "node", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "fresh"))
    out = near.select(F.col("src").alias("node"), F.col("dst").alias("id"), "fresh")
    out = (out.join(places, out["node"] == places["v_id"])
           .select("home", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "fresh"))
    at = F.pmod(F.col("home") + F.floor(F.col("block") / HUB_BLOCKS), F.lit(parts)).cast("int")
    members = into.unionByName(out).withColumn("home", at)
    bound = edges.groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("held"))
    bound = bound.select("id", F.when(F.col("held") >= most, F.col("bound")).otherwise(float("inf")).alias("bound"))
    there = (_fetch(members.select("home", "id"), vectors).join(bound, "id", "left").fillna(float("inf"), ["bound"])
             .select("home", "id", "v", "bound"))
    return _by_home(members, parts).cogroup(_by_home(there, parts)).applyInArrow(
        lambda m, n: _home_join(m.drop_columns(["home"]), n, dim, reach, most), EDGE)


def _descend(vectors: DataFrame, dim: int, n: int, pool: int, max_iter: int | None, min_update_rate: float, seed: int) -> DataFrame:
    """Each node's nearest ``pool`` candidates: (src, dst, distance, rank)."""
    reach = min(NEIGHBOURHOOD, pool)
    homes = _homes(vectors, dim, HOME_NODES)
    edges = staged(_keep_best(_start(vectors, dim, n, reach, seed), pool).withColumn("fresh", F.lit(True)), "graph-pool")
    rounds = max_iter if max_iter is not None else 4 + n.bit_length()
    for _ in range(rounds):
        found = local_join(edges, vectors, dim, reach, pool, homes)
        old = edges.select("src", "dst", "distance", F.lit(False).alias("fresh"))
        merged = old.unionByName(found.withColumn("fresh", F.lit(True))).repartition("src").groupBy("src", "dst").agg(
            F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        before, edges = edges, staged(_keep_best(merged, pool), "graph-pool")
        del found, old, merged
        dropped(before)
        if edges.where(F.col("fresh") & (F.col("rank") <= reach)).count() <= min_update_rate * n * reach:
            break
    out = edges.select("src", "dst", "distance", "rank")
    out._staged_at = edges._staged_at
    return out


def diverse_links(cands: DataFrame, vectors: DataFrame, dim: int, m: int) -> DataFrame:
    """(src, dst, distance, rank): ``m`` links of each node, pruned by diversity from its candidates (src, dst, distance)."""
    return _pruned(cands, vectors, dim, [(m, _ALL)]).drop("graph")


_ALL = np.iinfo(np.int32).max     # a pool that takes every candidate


def _pruned(cands: DataFrame, vectors: DataFrame, dim: int, sets: list[tuple[int, int]]) -> DataFrame:
    """(graph, src, dst, distance, rank): for each (m, pool) of ``sets`` the links of each node. A node's candidates meet once."""
    each = max(1, math.ceil(cands.count() / max(1, vectors.count())))
    homes, parts = _homes(vectors, dim, max(1, min(HOME_NODES, HOME_POOL // each)))
    own = cands.select("src", F.col("dst").alias("id"), "distance").join(homes.select(F.col("id").alias("src"), "home"), "src")
    there = _fetch(own.select("home", "id"), vectors).select("home", "id", "v")
    links = _by_home(own, parts).cogroup(_by_home(there, parts)).applyInArrow(lambda c, n: _occlusion(c, n, dim, sets), f"graph int, {EDGE}")
    return _keep_best(links, max(m for m, _ in sets), ("graph", "src"))


def _bidirectional(edges: DataFrame, m: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Search adjacency: each node's m out-links (kind 'out') plus links back
    from the m nearest nodes that point at it (kind 'in'), so the index is a
    bounded-degree bidirectional graph (degree <= 2m) — a directed kNN graph
    alone navigates poorly. Reverse links are chosen by distance (a window
    with WindowGroupLimit, reduced map-side for hub nodes). ``by``: columns that tell several graphs apart."""
    out = edges.select(*by, "src", "dst", "distance", "rank", F.lit("out").alias("kind"))
    w = Window.partitionBy(*by, "src").orderBy(F.col("distance").asc_nulls_last(), F.col("dst"))
    back = (edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
            .join(out.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)
            .select(*by, "src", "dst", "distance", F.col("rank").cast("long").alias("rank"),
                    F.lit("in").alias("kind")))
    return staged(out.unionByName(back), "graph-edges")


def nodes_of(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, v, links): what a search reads of a node."""
    links = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("links"))
    return vectors.join(links, "id", "left").select("id", "v", F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))


def _index(vectors: DataFrame, links: DataFrame, m: int, ef_construction: int, dim: int) -> GraphIndex:
    spark = vectors.sparkSession
    edges = _bidirectional(links, m)
    nodes = write_bucketed(nodes_of(vectors, edges), scratch_path(spark, "graph-nodes"), _buckets(spark, vectors.count()))
    return GraphIndex(nodes, edges, m, ef_construction, dim)


def _nodes_in(base: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))


def graph_pool(base: DataFrame, pool: int, max_iter: int | None = None, min_update_rate: float = 0.005, seed: int = 42,
               id_col: str = "id", vec_col: str = "v", dim: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(vectors, candidates, dim): the dear part of a build. Every narrower build follows from the widest
    pool by ``graph_from_pool``."""
    spark = base.sparkSession
    ensure_shipped(spark)
    b = _nodes_in(base, id_col, vec_col)
    dim = dim or vector_dim(b, "v")
    n = b.count()
    vectors = write_bucketed(b, scratch_path(spark, "graph-vectors"), _buckets(spark, n))
    return vectors, _descend(vectors, dim, n, max(1, min(pool, n - 1)), max_iter, min_update_rate, seed), dim


def graph_from_pool(vectors: DataFrame, cands: DataFrame, dim: int, m: int, ef_construction: int) -> GraphIndex:
    """The index with ``m`` links pruned from each node's nearest max(m, ef_construction) candidates."""
    own = cands.where(F.col("rank") <= max(m, ef_construction))
    links = staged(diverse_links(own, vectors, dim, m), "graph-links")
    index = _index(vectors, links, m, ef_construction, dim)
    dropped(links)
    return index


def graph_family(vectors: DataFrame, cands: DataFrame, dim: int, sets: list[tuple[int, int]]) -> GraphFamily:
    """The indexes of ``graph_from_pool`` for every (m, ef_construction) of ``sets``, pruned in one pass and kept in one node table."""
    spark = vectors.sparkSession
    widest = max(max(s) for s in sets)
    links = staged(_pruned(cands.where(F.col("rank") <= widest), vectors, dim, [(m, max(m, efc)) for m, efc in sets]), "graph-links")
    m_of = F.get(F.array(*[F.lit(m) for m, _ in sets]), F.col("graph"))
    edges = _bidirectional(links, m_of, ("graph",))
    dropped(links)
    lists = edges.groupBy("graph", F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("links"))
    by_graph = lists.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("graph", "links"))).alias("of"))
    none = F.array().cast("array<bigint>")
    nodes = vectors.join(by_graph, "id", "left").select(
        "id", "v", F.array(*[F.coalesce(F.element_at("of", F.lit(g)), none) for g in range(len(sets))]).alias("links"))
    family = GraphFamily(write_bucketed(nodes, scratch_path(spark, "graph-nodes"), _buckets(spark, vectors.count())), sets, dim)
    dropped(edges)
    return family


def graph_build(base: DataFrame, m: int = DEFAULT_M, ef_construction: int = DEFAULT_EF_CONSTRUCTION,
                max_iter: int | None = None, min_update_rate: float = 0.005, seed: int = 42,
                id_col: str = "id", vec_col: str = "v", dim: int | None = None) -> GraphIndex:
    """Graph index of ``base``. Rows whose vector is null, zero or of another length than ``dim`` are nodes without links."""
    vectors, cands, dim = graph_pool(base, max(m, ef_construction), max_iter, min_update_rate, seed, id_col, vec_col, dim)
    index = graph_from_pool(vectors, cands, dim, m, ef_construction)
    dropped(cands)
    return index


def graph_append(index: GraphIndex, new_rows: DataFrame, id_col: str = "id", vec_col: str = "v") -> GraphIndex:
    """Insert rows into a graph index: each new node links to its nearest
    nodes, found by searching the present graph and among the batch itself, pruned by diversity;
    links back are chosen anew, so degrees keep their bound."""
    new = staged(_nodes_in(new_rows, id_col, vec_col), "graph-new")
    pool = max(index.ef_construction, index.m)
    found = graph_search(index, new, pool, ef=pool)
    own = knn_join(new, new, pool + 1, dim=index.dim).where("query_id <> id")
    vectors = index.vectors.unionByName(new)
    cands = staged(_keep_best(found.unionByName(own).where("query_id <> id")
                              .select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance").repartition("src").distinct(), pool), "graph-pool")
    out = diverse_links(cands, vectors, index.dim, index.m).select("src", "dst", "distance", "rank")
    old = index.edges.where("kind = 'out'").select("src", "dst", "distance", "rank")
    links = staged(old.unionByName(out), "graph-links")
    dropped(cands)
    grown = _index(vectors, links, index.m, index.ef_construction, index.dim)
    dropped(links)
    dropped(new)
    return grown


# ---------------------------------------------------------------------- search
def graph_search(index: GraphIndex, queries: DataFrame, k: int, ef: int = DEFAULT_EF,
                 entry_points: int | None = None, max_rounds: int | None = None, seed: int = 42,
                 query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """Approximate k nearest via beam search: (query_id, id, distance, rank).
    The beam is max(ef, k) wide; seeds are each query's nearest nodes among a
    seeded sample of ``entry_points`` nodes (default: 4 times the root of the node count)."""
    if k <= 0:
        return _empty(queries.sparkSession)
    beam = _beam(index, queries, k, [ef], entry_points, max_rounds, seed, query_id, query_vec)
    return rank_candidates(_beam_rows(beam).drop("graph", "ef"), k)


def graph_search_multi(index: GraphIndex, queries: DataFrame, k: int, efs: list[int],
                       entry_points: int | None = None, max_rounds: int | None = None, seed: int = 42,
                       query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """Several ``ef`` settings in one search: the setting is part of the beam
    key, so all settings advance together round by round.
    Returns (ef, query_id, id, distance, rank)."""
    beam = _beam(index, queries, k, efs, entry_points, max_rounds, seed, query_id, query_vec)
    return rank_candidates(_beam_rows(beam).drop("graph"), k, ["ef", "query_id"])


def family_search(family: GraphFamily, queries: DataFrame, k: int, efs: list[list[int]], seed: int = 42,
                  query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """``graph_search_multi`` of every graph of a family with its own ``efs``, all in one search: graph and ef are parts of the
    beam key, so a round serves them all. Returns (graph, ef, query_id, id, distance, rank)."""
    beam = _beam(family, queries, k, efs, None, None, seed, query_id, query_vec)
    return rank_candidates(_beam_rows(beam), k, ["graph", "ef", "query_id"])


def graph_search_effort(index: GraphIndex, queries: DataFrame, ef: int = DEFAULT_EF, **kw) -> DataFrame:
    """(query_id, examined): distances computed per query, seeds of the beam included."""
    return _beam(index, queries, 1, [ef], **kw).select("query_id", "examined")


def _beam_rows(beam: DataFrame) -> DataFrame:
    rows = beam.select(*BEAM, F.explode(F.arrays_zip("ids", "distances")).alias("b"))
    distance = F.col("b.distances")
    return rows.select(*BEAM, F.col("b.ids").alias("id"), F.when(distance < float("inf"), distance).otherwise(float("nan")).alias("distance"))


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, values) of a column of lists."""
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    return col.offsets.to_numpy().astype(np.int64), col.values


def _advance(state: pa.Table, nodes: pa.Table, dim: int, k: int, several: bool) -> pa.Table:
    """One round of the beams of a home. ``nodes`` holds the unexpanded nodes of all its beams and what they link to. Returns the
    state, and after it a row (home, want) for each node that the next round needs."""
    state = state.append_column("want", pa.nulls(state.num_rows, pa.int64()))
    if state.num_rows == 0 or nodes.num_rows == 0:
        return state
    n = state.num_rows
    order, ids, unit, ok = _fetched(nodes, dim)
    like = unit.astype(np.float32)
    known_at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))     # the first row of each id
    known = ids[known_at]
    q, _ = K.vectors_from_arrow(state.column("qv"), dim, np.float64)
    qn, q_ok = K.normalise(q)
    q_like = qn.astype(np.float32)
    graph = state.column("graph").to_numpy()
    width = np.maximum(state.column("ef").to_numpy().astype(np.int64), k)
    ends, beam_ids = _lists(state.column("ids"))
    held = slice(int(ends[0]), int(ends[-1]))
    beam_ids = beam_ids.to_numpy(zero_copy_only=False)[held]
    beam_d = _lists(state.column("distances"))[1].to_numpy(zero_copy_only=False)[held]
    is_open = _lists(state.column("open"))[1].to_numpy(zero_copy_only=False)[held]
    ends = ends - ends[0]
    beam_row = np.repeat(np.arange(n), np.diff(ends))
    link_ends, links = _lists(nodes.column("links"))
    if several:     # a list for each graph
        first_list = link_ends
        link_ends, links = links.offsets.to_numpy().astype(np.int64), links.values
    links = links.to_numpy(zero_copy_only=False)

    def number(wanted: np.ndarray) -> np.ndarray:
        """Places in ``known``, -1 where there is none."""
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, at, -1)

    def linked(of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes ``of`` (places in ``known``) of beams ``row``: (i, ends, links) with the links of entry j at ends[i[j]]:ends[i[j] + 1]."""
        at = order[known_at[of]]
        lists, i = np.unique(first_list[at] + graph[row] if several else at, return_inverse=True)
        count = link_ends[lists + 1] - link_ends[lists]
        return i, np.concatenate([[0], np.cumsum(count)]), links[np.repeat(link_ends[lists], count) + _within(count)]

    entry = np.flatnonzero(is_open)
    of, entry_row = number(beam_ids[entry]), beam_row[entry]
    of, entry_row = of[of >= 0], entry_row[of >= 0]
    i, list_ends, values = linked(of, entry_row)
    values, count = number(values), np.diff(list_ends)[i]
    reps = np.diff(np.concatenate([known_at, [len(ids)]]))
    so_far = np.concatenate([[0], np.cumsum(np.bincount(entry_row, weights=count, minlength=n).astype(np.int64))])
    steps = np.unique(np.concatenate([[0], np.searchsorted(so_far, np.arange(SLICE, int(so_far[-1]) + SLICE, SLICE)), [n]]).clip(0, n))
    examined = np.zeros(n, np.int64)
    parts = []
    for r0, r1 in zip(steps[:-1].tolist(), steps[1:].tolist()):
        e = slice(*np.searchsorted(entry_row, [r0, r1]).tolist())
        at = values[np.repeat(list_ends[i[e]], count[e]) + _within(count[e])]
        row = np.repeat(entry_row[e] - r0, count[e])
        key = np.unique((row * len(known) + at)[at >= 0])
        b = slice(int(ends[r0]), int(ends[r1]))
        b_row, b_d, b_ids = beam_row[b] - r0, beam_d[b], beam_ids[b]
        in_beam = number(b_ids)
        key = np.setdiff1d(key, np.unique((b_row * len(known) + in_beam)[in_beam >= 0]), assume_unique=True)
        row, at = np.divmod(key, len(known))
        row, at = np.repeat(row, reps[at]), np.repeat(known_at[at], reps[at]) + _within(reps[at])
        found = np.bincount(row, minlength=r1 - r0)
        examined[r0:r1] = found
        d = np.empty(len(row))
        step = max(1, 4 * K.PAIR_CELLS // max(1, dim))
        for s in range(0, len(row), step):
            x = slice(s, s + step)
            d[x] = 1.0 - np.einsum("ij,ij->i", q_like[r0 + row[x]], like[at[x]])
        d[~(q_ok[r0 + row] & ok[at])] = np.inf
        # single precision finds what can be in the beam
        b_count, w = np.diff(ends[r0:r1 + 1]), width[r0:r1]
        room = max(int(found.max()) + int(b_count.max()), int(w.max()))
        every = np.full((r1 - r0, room), np.inf)
        every[b_row, _within(b_count)] = b_d
        every[row, b_count[row] + _within(found)] = d
        every.partition(np.unique(w - 1), axis=1)
        near = d <= every[np.arange(r1 - r0), w - 1][row] + 2 * K.margin(dim, np.float32)
        row, at, d = row[near], at[near], d[near]
        number_at = np.flatnonzero(np.isfinite(d))
        d[number_at] = K._pair_distances(qn, unit, r0 + row[number_at], at[number_at])
        new = np.concatenate([np.zeros(len(b_row), bool), np.ones(len(row), bool)])
        row, d, node = np.concatenate([b_row, row]), np.concatenate([b_d, d]), np.concatenate([b_ids, ids[at]])
        by = np.lexsort((new, node, d, row))
        by = by[_ranks(row[by]) < w[row[by]]]
        parts.append((r0 + row[by], node[by], d[by], new[by]))
    row, node, d, new = (np.concatenate(x) for x in zip(*parts))
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    own = {"ids": pa.array(node, pa.int64()), "distances": pa.array(d, pa.float64()), "open": pa.array(new, pa.bool_())}
    for c, x in own.items():
        state = state.set_column(state.column_names.index(c), c, pa.ListArray.from_arrays(bounds, x))
    state = state.set_column(state.column_names.index("examined"), "examined",
                             pa.array(state.column("examined").to_numpy() + examined, pa.int64()))
    of = number(node[new])
    want = np.unique(np.concatenate([node[new], linked(of, row[new])[2]]))
    more = pa.table({"home": pa.array(np.full(len(want), state.column("home")[0].as_py()), pa.int32()), "want": pa.array(want, pa.int64())})
    return pa.concat_tables([state, more], promote_options="default")


def at_nodes(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates joined with the node table at its buckets: the candidates are exchanged, the table is not. A task holds its
    bucket of the table, and the candidates pass by."""
    return cands.join(nodes.hint("shuffle_hash"), "id")


BEAM = ["graph", "ef", "query_id"]     # key of a beam; ``graph`` is 0 where there is one


def _beam(index: GraphIndex | GraphFamily, queries: DataFrame, k: int, efs: list[int] | list[list[int]], entry_points: int | None = None,
          max_rounds: int | None = None, seed: int = 42, query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """One row a graph, ef and query: (home, graph, ef, query_id, qv, ids, distances, open, examined). ids, distances, open: the
    best max(ef, k) nodes and whether they are unexpanded. ``efs``: of a family a list for each graph."""
    spark = queries.sparkSession
    ensure_shipped(spark)
    q = _prep(queries, query_id, query_vec, "query_id")
    dim = index.dim
    several = isinstance(index, GraphFamily)
    runs = sorted({(g, int(e)) for g, own in enumerate(efs if several else [efs]) for e in own})     # (graph, ef)
    widest = max(k, *(e for _, e in runs))
    size = index.nodes.count()
    if entry_points is None:
        entry_points = max(MIN_ENTRY_POINTS, 4 * math.isqrt(size))
    # seeds: each query's nearest nodes of a seeded sample
    sample = staged(sample_queries(index.nodes, entry_points, seed=seed), "graph-entry")
    seeds = rank_candidates(exact_candidates(q, sample.select("id", "v"), widest, dim), widest)
    usable = q.where(F.size("v") == dim).groupBy(F.col("query_id").alias("id")).agg(F.min("v").alias("v"))
    reached = sum(max(k, e) * 2 * (index.sets[g][0] if several else index.m) for g, e in runs)
    several_sets = several and len(index.sets) > 1     # a node then has as many lists of links
    most = HOME_NODES if size <= SMALL_GRAPH and not several_sets else HOME_CANDIDATES // max(1, reached)
    homes, parts = _homes(usable, dim, max(1, min(HOME_NODES, most)))
    usable = usable.join(homes, "id").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), "home")
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("graph"), F.lit(e).alias("ef")) for g, e in runs]))
    seeds = (seeds.join(sample.select("id"), "id").withColumn("_run", each).select("*", "_run.*")
             .where(F.col("rank") <= F.greatest(F.col("ef"), F.lit(k)))
             .withColumn("distance", F.when(F.isnan("distance"), float("inf")).otherwise(F.col("distance"))))
    first = seeds.groupBy(*BEAM).agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("beam"), F.count(F.lit(1)).alias("examined"))
    ids, far = F.transform("beam", lambda b: b["id"]), F.transform("beam", lambda b: b["distance"])
    held = staged(first.join(usable, "query_id").select(
        "home", *BEAM, "qv", ids.alias("ids"), far.alias("distances"), F.transform("beam", lambda b: F.lit(True)).alias("open"), "examined"), "graph-beam")
    state = held
    at = held.select("home", F.explode("ids").alias("id")).distinct()
    onward = F.explode(F.array_distinct(F.flatten("links")) if several else F.col("links"))
    wanted = at.unionByName(at.join(sample.select("id", "links"), "id").select("home", onward.alias("id")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + ", want long"
    nodes = index.nodes.where(F.size("v") == dim).select("id", "v", "links")
    # until no beam has an unexpanded node; a beam only gets nearer, so this ends. ``max_rounds`` is an optional bound
    rnd = 0
    while max_rounds is None or rnd < max_rounds:
        rnd += 1
        there = _fetch(wanted, nodes).select("home", "id", "v", "links")
        after = staged(_by_home(state, parts).cogroup(_by_home(there, parts)).applyInArrow(
            lambda s, n: _advance(s, n, dim, k, several), schema), "graph-beam")
        state = after.where(F.col("want").isNull()).drop("want")
        wanted = after.where(F.col("want").isNotNull()).select("home", F.col("want").alias("id"))
        del there
        dropped(held)
        held = after
        if wanted.limit(1).isEmpty():
            break
    return state
