"""Arrow/numpy distance kernels that run inside Spark tasks.

Spark partitions and shuffles the work; these functions only turn one Arrow
batch (or one co-grouped block pair) into a handful of candidate rows.
Distances are cosine distances computed as ``1 - q̂·b̂`` on row-normalised
matrices, so every norm is computed once per row, never per pair. A matrix
product finds the pairs worth keeping; the distance of a kept pair is added up in one
fixed order, so it does not depend on the plan or the shape of a block.

Ordering contract (shared by every operator): ascending distance, ties by
ascending id; NaN distances (zero vectors) sort after every number.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa

SENTINEL_ID = np.iinfo(np.int64).max
# Upper bound on the size of one distance block (rows x cols) held in memory.
BLOCK_CELLS = 4_000_000
BLOCK_ROWS = 8192        # rows of a block that queries meet at a time
PAIR_CELLS = 250_000     # components of the pairs whose distances are added up at a time
LEAD_ROWS = 512          # rows of a block that a query without k distances ranks first

CANDIDATE_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()),
                              ("distance", pa.float64())])


def vectors_from_arrow(col: pa.Array | pa.ChunkedArray, dim: int,
                       dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(matrix n x dim, valid mask). Rows that are NULL or of another length
    are invalid and come back as zero rows (callers drop or NaN them)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.LargeListArray):
        col = col.cast(pa.list_(col.type.value_type))
    n = len(col)
    if n == 0:
        return np.zeros((0, dim), dtype=dtype), np.zeros(0, dtype=bool)
    offsets = col.offsets.to_numpy()
    lens = np.diff(offsets)
    valid = lens == dim
    if col.null_count:
        valid &= col.is_valid().to_numpy(zero_copy_only=False)
    values = col.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if valid.all() and offsets[0] == 0 and offsets[-1] == n * dim:
        return values[: n * dim].reshape(n, dim), valid
    out = np.zeros((n, dim), dtype=dtype)
    rows = np.nonzero(valid)[0]
    if len(rows):
        out[rows] = values[offsets[rows][:, None] + np.arange(dim)]
    return out, valid


def normalise(m: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised copy and a mask of rows whose distance is a number
    (valid, finite, non-zero norm). A row's result does not depend on the rows around it."""
    norms = np.sqrt(row_sums(m * m))
    ok = np.isfinite(norms) & (norms > 0)
    if valid is not None:
        ok &= valid
    safe = np.where(ok, norms, 1.0)
    return m / safe[:, None], ok


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sum of each row, halves added to halves: the order depends on the row length only."""
    if x.shape[1] == 0:
        return np.zeros(len(x), dtype=x.dtype)
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        odd = x[:, 2 * half:]
        x = x[:, :half] + x[:, half:2 * half]
        if odd.shape[1]:
            x[:, :1] += odd
    return x[:, 0]


def pair_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of row i of ``a`` and row i of ``b`` (normalised). Products are added by halving in
    float64, so the value follows from the two vectors alone, not from batch or block shapes."""
    return 1.0 - row_sums(a.astype(np.float64, copy=False) * b.astype(np.float64, copy=False))


def margin(dim: int, dtype) -> float:
    """More than a product of two normalised vectors loses on rounding."""
    return 4 * max(1, dim) * float(np.finfo(dtype).eps)


def _pair_distances(qn: np.ndarray, bn: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    step = max(1, PAIR_CELLS // max(1, qn.shape[1]))
    for s in range(0, len(row), step):
        at = slice(s, s + step)
        out[at] = pair_cosine(qn[row[at]], bn[col[at]])
    return out


def cosine_block(qn: np.ndarray, q_ok: np.ndarray, bn: np.ndarray, b_ok: np.ndarray) -> np.ndarray:
    """Distance block; pairs involving a zero/invalid vector are +inf
    (ranked last; reported as NaN)."""
    d = 1.0 - qn @ bn.T
    if not (q_ok.all() and b_ok.all()):
        d[~q_ok, :] = np.inf
        d[:, ~b_ok] = np.inf
    return d


def without_copies(v: np.ndarray, ids: np.ndarray, k: int, cells: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``v``, in their order, without those that k rows of the same vector (and cell) and no greater id
    precede: equal vectors are equally far from any query, so these are never among its k nearest. Otherwise one
    very common vector makes as many pairs that tie as its rows times its queries."""
    bits = np.ascontiguousarray(v).view(f"u{v.itemsize}")
    key = bits.astype(np.uint64, copy=False) @ np.random.default_rng(0).integers(2 ** 63, size=v.shape[1], dtype=np.uint64)
    if cells is not None:
        key = key * np.uint64(31) + cells.astype(np.int64).view(np.uint64)
    order = np.lexsort((ids, key))
    key = key[order]
    if len(key) <= k or not (key[k:] == key[:len(key) - k]).any():
        return np.arange(len(key))
    same = np.zeros(len(key), dtype=bool)       # as the row before it in the order; equal keys alone prove nothing
    same[1:] = key[1:] == key[:-1]
    if cells is not None:
        same[1:] &= cells[order[1:]] == cells[order[:-1]]
    at = np.flatnonzero(same)
    step = max(1, PAIR_CELLS // max(1, v.shape[1]))
    for s in range(0, len(at), step):
        i = at[s:s + step]
        same[i] = (bits[order[i]] == bits[order[i - 1]]).all(axis=1)
    number = np.arange(len(key))
    copy = number - np.maximum.accumulate(np.where(same, 0, number))
    return np.sort(order[copy < k])


class TopK:
    """Running k smallest (distance, id) per query, over any number of blocks."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.d = np.full((n_queries, k), np.inf)
        self.ids = np.full((n_queries, k), SENTINEL_ID, dtype=np.int64)

    def add(self, rows: np.ndarray | slice, qn: np.ndarray, q_ok: np.ndarray,
            bn: np.ndarray, b_ok: np.ndarray, ids: np.ndarray) -> None:
        """Merge the base rows ``bn`` into the queries ``rows`` (vectors ``qn``). The matrix product only
        chooses the pairs that can be among the k nearest, with a margin for its rounding;
        their distances come from ``pair_cosine``, so they are the same on every path. A query that
        holds k distances needs one comparison a pair; the others rank the first rows of the block."""
        if self.k == 0 or len(qn) == 0 or len(bn) == 0:
            return
        if not q_ok.all():      # all distances of these are undefined: the smallest ids
            at = np.arange(len(self.d))[rows]
            low = np.sort(ids)[:self.k]
            self.merge(at[~q_ok], np.full((int((~q_ok).sum()), len(low)), np.inf), low)
            rows, qn, q_ok = at[q_ok], qn[q_ok], q_ok[q_ok]
            if len(qn) == 0:
                return
        worst = self.d[rows].max(axis=1)
        full = np.isfinite(worst)
        if full.all():
            self._add_nearer(rows, qn, bn, b_ok, ids, worst)
            return
        lead = max(LEAD_ROWS, 4 * self.k)
        if len(bn) > 2 * lead:
            start, end = 0, lead
            while start < len(bn):      # as many rows again as were met: few pairs pass a bound that they gave
                part = slice(start, end)
                self.add(rows, qn, q_ok, bn[part], b_ok[part], ids[part])
                start, end = end, 2 * end
            return
        at = np.arange(len(self.d))[rows]
        if full.any():
            self._add_nearer(at[full], qn[full], bn, b_ok, ids, worst[full])
            at, qn, q_ok = at[~full], qn[~full], q_ok[~full]
        self._add_all(at, qn, q_ok, bn, b_ok, ids)

    def _add_all(self, rows: np.ndarray, qn: np.ndarray, q_ok: np.ndarray, bn: np.ndarray, b_ok: np.ndarray, ids: np.ndarray) -> None:
        d = cosine_block(qn, q_ok, bn, b_ok)
        bound = np.partition(np.concatenate([self.d[rows], d], axis=1), self.k - 1, axis=1)[:, self.k - 1]
        row, col = np.nonzero(d <= (bound + margin(qn.shape[1], d.dtype))[:, None])
        dist = d[row, col].astype(np.float64)
        number = np.flatnonzero(np.isfinite(dist))
        dist[number] = _pair_distances(qn, bn, row[number], col[number])
        self._merge_pairs(rows, row, dist, ids[col])

    def _add_nearer(self, rows: np.ndarray | slice, qn: np.ndarray, bn: np.ndarray, b_ok: np.ndarray, ids: np.ndarray, worst: np.ndarray) -> None:
        """``add`` for queries that hold k distances, the farthest ``worst``: a product in single precision finds what can be nearer."""
        if not b_ok.all():
            bn, ids = bn[b_ok], ids[b_ok]
        if len(bn) == 0:
            return
        like = qn.astype(np.float32, copy=False) @ bn.astype(np.float32, copy=False).T
        least = (1.0 - worst - 2 * margin(qn.shape[1], np.float32)).astype(np.float32)
        row, col = np.divmod(np.flatnonzero(like >= least[:, None]), len(bn))
        if len(row) == 0:
            return
        dist = _pair_distances(qn, bn, row, col)
        held = self.d[rows]
        last = np.where(held == worst[:, None], self.ids[rows], -1).max(axis=1)
        keep = (dist < worst[row]) | ((dist == worst[row]) & (ids[col] < last[row]))
        self._merge_pairs(rows, row[keep], dist[keep], ids[col[keep]])

    def _merge_pairs(self, rows: np.ndarray | slice, row: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Merge single pairs: ``row`` counts along ``rows``."""
        if len(row) == 0:
            return
        change = np.flatnonzero(row[1:] != row[:-1]) + 1      # pairs come by row
        first = np.concatenate([[0], change])
        count = np.diff(np.concatenate([first, [len(row)]]))
        if count.max() > 4 * self.k + 64:                     # many that tie: the k nearest of each row
            order = np.lexsort((ids, dist, row))
            few = order[np.arange(len(row)) - np.repeat(first, count) < self.k]
            row, dist, ids, count = row[few], dist[few], ids[few], np.minimum(count, self.k)
            first = np.cumsum(count) - count
        line = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(first, count)
        near = np.full((len(count), int(count.max())), np.inf)
        near_ids = np.full(near.shape, SENTINEL_ID, dtype=np.int64)
        near[line, place], near_ids[line, place] = dist, ids
        self.merge(np.arange(len(self.d))[rows][row[first]], near, near_ids)

    def merge(self, rows: np.ndarray | slice, d: np.ndarray, ids: np.ndarray) -> None:
        """Merge block ``d`` (a row for each of ``rows``) of the base rows ``ids`` (one list, or one a row)."""
        k = self.k
        if k == 0 or d.size == 0:
            return
        cd = np.concatenate([self.d[rows], d], axis=1)
        ci = np.concatenate([self.ids[rows], np.broadcast_to(ids, d.shape)], axis=1)
        width = cd.shape[1]
        if width > k:
            part = np.argpartition(cd, k - 1, axis=1)[:, :k]
            sd = np.take_along_axis(cd, part, axis=1)
            si = np.take_along_axis(ci, part, axis=1)
            # Ties at the k-th distance: resolve those rows exactly by id.
            thr = sd.max(axis=1)
            amb = np.nonzero((cd <= thr[:, None]).sum(axis=1) > k)[0]
            if len(amb):
                o = np.lexsort((ci[amb], cd[amb]), axis=1)[:, :k]
                sd[amb] = np.take_along_axis(cd[amb], o, axis=1)
                si[amb] = np.take_along_axis(ci[amb], o, axis=1)
        else:
            sd, si = cd, ci
        self.d[rows], self.ids[rows] = sd, si

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) with each row in (distance, id) order."""
        o = np.lexsort((self.ids, self.d), axis=1)
        return np.take_along_axis(self.d, o, axis=1), np.take_along_axis(self.ids, o, axis=1)

    def emit(self, query_ids: np.ndarray) -> pa.RecordBatch:
        keep = self.ids != SENTINEL_ID
        qi = np.broadcast_to(query_ids[:, None], self.ids.shape)[keep]
        dist = self.d[keep]
        dist = np.where(np.isinf(dist), np.nan, dist)
        return pa.RecordBatch.from_arrays(
            [pa.array(qi, pa.int64()), pa.array(self.ids[keep], pa.int64()),
             pa.array(dist, pa.float64())], schema=CANDIDATE_SCHEMA)


def _query_chunks(nq: int, nb: int) -> Iterable[slice]:
    step = max(1, BLOCK_CELLS // max(nb, 1))
    for s in range(0, nq, step):
        yield slice(s, min(nq, s + step))


def exact_topk_partition(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray,
                         qn: np.ndarray, q_ok: np.ndarray, k: int, dim: int,
                         id_col: str, vec_col: str, dtype=np.float64,
                         counts: bool = False) -> Iterator[pa.RecordBatch]:
    """Stream base batches against a broadcast query block; emit <= k rows per
    query for this partition (the partial top-k)."""
    qn = qn.astype(dtype, copy=False)
    top = TopK(len(query_ids), k)
    examined = np.zeros(len(query_ids), dtype=np.int64)
    for rb in batches:
        if rb.num_rows == 0:
            continue
        ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
        b, valid = vectors_from_arrow(rb.column(vec_col), dim, dtype)
        bn, b_ok = normalise(b, valid)
        has = valid  # invalid-length / NULL vectors are not candidates
        if not has.all():
            ids, bn, b_ok = ids[has], bn[has], b_ok[has]
        if len(ids) == 0:
            continue
        examined += len(ids)
        if not counts and len(query_ids) >= LEAD_ROWS:
            few = without_copies(bn, ids, k)
            ids, bn, b_ok = ids[few], bn[few], b_ok[few]
        for qs in _query_chunks(len(query_ids), len(ids)):
            top.add(qs, qn[qs], q_ok[qs], bn, b_ok, ids)
    if counts:
        yield _counts_batch(query_ids, examined)
    else:
        yield top.emit(query_ids)


def _counts_batch(query_ids: np.ndarray, examined: np.ndarray) -> pa.RecordBatch:
    keep = examined > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[keep], pa.int64()), pa.array(examined[keep], pa.int64())],
        names=["query_id", "examined"])


def cell_topk_partition(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray,
                        qn: np.ndarray, q_ok: np.ndarray, cell_queries: dict,
                        k: int, dim: int, id_col: str, vec_col: str, cell_col: str,
                        dtype=np.float64, counts: bool = False) -> Iterator[pa.RecordBatch]:
    """IVF probe kernel: a base row of cell c is compared only with the queries
    that probe c (``cell_queries[c]`` = index array into the query block)."""
    qn = qn.astype(dtype, copy=False)
    top = TopK(len(query_ids), k)
    examined = np.zeros(len(query_ids), dtype=np.int64)
    for rb in batches:
        if rb.num_rows == 0:
            continue
        cells = rb.column(cell_col).to_numpy(zero_copy_only=False)
        ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
        b, valid = vectors_from_arrow(rb.column(vec_col), dim, dtype)
        bn, b_ok = normalise(b, valid)
        order = np.argsort(cells, kind="stable")
        cs = cells[order]
        bounds = np.flatnonzero(np.diff(cs)) + 1
        for grp in np.split(order, bounds):
            if len(grp) == 0:
                continue
            qsel = cell_queries.get(int(cells[grp[0]]))
            if qsel is None:
                continue
            grp = grp[valid[grp]]
            if len(grp) == 0:
                continue
            examined[qsel] += len(grp)
            gb, gok, gid = bn[grp], b_ok[grp], ids[grp]
            for s in _query_chunks(len(qsel), len(grp)):
                rows = qsel[s]
                top.add(rows, qn[rows], q_ok[rows], gb, gok, gid)
    if counts:
        yield _counts_batch(query_ids, examined)
    else:
        yield top.emit(query_ids)


def nearest_of_block(batches: Iterator[pa.RecordBatch], cand_ids: np.ndarray,
                     cn: np.ndarray, c_ok: np.ndarray, n: int, dim: int,
                     id_col: str, vec_col: str, out_id: str, out_rank: str,
                     out_dist: str, dtype=np.float64) -> Iterator[pa.RecordBatch]:
    """For each streamed row, its n nearest rows of a complete broadcast block
    (centroids, seed nodes). Pure map: no merge across partitions needed."""
    n = min(n, len(cand_ids))
    cn = cn.astype(dtype, copy=False)
    for rb in batches:
        if rb.num_rows == 0:
            continue
        ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
        q, valid = vectors_from_arrow(rb.column(vec_col), dim, dtype)
        qn, q_ok = normalise(q, valid)
        top = TopK(len(ids), n)
        for s in _query_chunks(len(ids), len(cand_ids)):
            top.add(s, qn[s], q_ok[s], cn, c_ok, cand_ids)
        near, near_ids = top.ordered()
        keep = (near_ids != SENTINEL_ID) & valid[:, None]
        rank = np.broadcast_to(np.arange(1, n + 1, dtype=np.int64), near_ids.shape)
        dist = np.where(np.isinf(near), np.nan, near)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(ids[:, None], near_ids.shape)[keep], pa.int64()),
             pa.array(near_ids[keep], pa.int64()), pa.array(rank[keep], pa.int64()),
             pa.array(dist[keep], pa.float64())],
            names=[id_col, out_id, out_rank, out_dist])


def nearest_one(vec_col: pa.Array, cand_ids: np.ndarray, cn: np.ndarray, c_ok: np.ndarray,
                dim: int, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Nearest candidate id per row (-1 for NULL / wrong-length vectors) and
    its distance (NaN when undefined); ties by candidate id."""
    cn = cn.astype(dtype, copy=False)
    q, valid = vectors_from_arrow(vec_col, dim, dtype)
    qn, q_ok = normalise(q, valid)
    top = TopK(len(q), 1)
    for s in _query_chunks(len(q), len(cand_ids)):
        top.add(s, qn[s], q_ok[s], cn, c_ok, cand_ids)
    best = top.ids[:, 0]
    keep = valid & (best != SENTINEL_ID)
    dist = np.where(np.isinf(top.d[:, 0]), np.nan, top.d[:, 0])
    return np.where(keep, best, -1), np.where(keep, dist, np.nan)


def block_pair_topk(q_tbl: pa.Table, b_tbl: pa.Table, k: int, dim: int,
                    qid_col: str, qvec_col: str, id_col: str, vec_col: str,
                    dtype=np.float64) -> pa.Table:
    """Grid path: one (query block, base block) pair -> <= k rows per query."""
    if q_tbl.num_rows == 0 or b_tbl.num_rows == 0:
        return CANDIDATE_SCHEMA.empty_table()
    qids = q_tbl.column(qid_col).to_numpy().astype(np.int64)
    q, qv = vectors_from_arrow(q_tbl.column(qvec_col), dim, dtype)
    qn, q_ok = normalise(q, qv)
    qids, qn, q_ok = qids[qv], qn[qv], q_ok[qv]
    batches = b_tbl.select([id_col, vec_col]).to_batches()
    out = list(exact_topk_partition(iter(batches), qids, qn, q_ok, k, dim, id_col, vec_col, dtype))
    return pa.Table.from_batches(out, schema=CANDIDATE_SCHEMA)


def asked_batch(keys: dict[str, pa.Array], vectors: pa.Array, row: np.ndarray, cell: np.ndarray, parts: int,
                level: np.ndarray | None = None) -> pa.RecordBatch:
    """(keys, v, part, cells): what row ``row`` of a batch asks for, a row for each part (cell modulo ``parts``) that holds
    one of its cells. With ``level`` also the level of each of the cells: ``levels``."""
    cell = cell.astype(np.int64, copy=False)
    part = cell % parts
    order = np.lexsort((cell, part, row))
    row, cell, part = row[order], cell[order], part[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    bounds = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
    lists = {"cells": pa.ListArray.from_arrays(bounds, pa.array(cell, pa.int32()))}
    if level is not None:
        lists["levels"] = pa.ListArray.from_arrays(bounds, pa.array(level[order], pa.int32()))
    at = pa.array(row[first], pa.int64())
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in keys.values()], vectors.take(at), pa.array(part[first], pa.int32()), *lists.values()],
                                      [*keys, "v", "part", *lists])


def _reach(top: TopK, of: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Which pairs of ``top`` (slot i: level ``level[i]`` of query ``of[i]``) are among the k nearest of their query at their
    own level or below: no other is among them at a higher level."""
    keep = top.ids != SENTINEL_ID
    so_far = TopK(n, top.k)
    for step in np.unique(level).tolist():
        at = np.flatnonzero(level == step)
        so_far.merge(of[at], top.d[at], top.ids[at])
        d, ids = so_far.d[of[at]], so_far.ids[of[at]]
        worst = d.max(axis=1)[:, None]
        last = np.where(d == worst, ids, -1).max(axis=1)[:, None]
        keep[at] &= (top.d[at] < worst) | ((top.d[at] == worst) & (top.ids[at] <= last))
    return keep


def cells_topk(q_tbl: pa.Table, b_tbl: pa.Table, k: int, dim: int, keys: list[str], dtype=np.float64, counts: bool = False) -> pa.Table:
    """A block of queries (keys, v, cells) and of rows (id, v, cell): for each query its k nearest rows of the cells it asks
    for (null: all), as (keys, id, distance); with ``counts`` (keys, examined). Where ``levels`` gives each asked cell a level,
    the k nearest of each level, as (keys, level, id, distance), without those that k of the same or lower levels beat."""
    ids = b_tbl.column("id").to_numpy().astype(np.int64)
    cells = b_tbl.column("cell").to_numpy()
    b, valid = vectors_from_arrow(b_tbl.column("v"), dim, dtype)
    order = np.flatnonzero(valid)
    order = order[np.argsort(cells[order], kind="stable")]
    b, ids, cells = b[order], ids[order], cells[order]
    if not counts:
        few = without_copies(b, ids, k, cells)
        b, ids, cells = b[few], ids[few], cells[few]
    bn, b_ok = normalise(b)
    q, q_valid = vectors_from_arrow(q_tbl.column("v"), dim, dtype)
    qn, q_ok = normalise(q, q_valid)
    wanted = q_tbl.column("cells").combine_chunks()
    wanted = wanted.chunk(0) if isinstance(wanted, pa.ChunkedArray) else wanted
    every = np.flatnonzero(q_valid & wanted.is_null().to_numpy(zero_copy_only=False))
    count = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, cell = np.repeat(np.arange(len(count)), count), wanted.flatten().to_numpy(zero_copy_only=False)
    levelled = "levels" in q_tbl.column_names
    level = np.zeros(len(row), dtype=np.int64)
    if levelled:
        level = q_tbl.column("levels").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    level, cell, row = level[q_valid[row]], cell[q_valid[row]], row[q_valid[row]]
    order = np.lexsort((level, row, cell))
    row, cell, level = row[order], cell[order], level[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    row, cell, level = row[new], cell[new], level[new]
    of, slot_level = np.arange(len(qn)), np.zeros(len(qn), dtype=np.int64)     # a slot keeps k pairs of query of[slot]
    if levelled:
        steps, step = np.unique(level, return_inverse=True)
        slots, row = np.unique(row * max(1, len(steps)) + step, return_inverse=True)
        of, slot_level = slots // max(1, len(steps)), steps[slots % max(1, len(steps))] if len(steps) else slots
    top = TopK(len(of), k)
    examined = np.zeros(len(qn), dtype=np.int64)

    def meet(asking: np.ndarray, rows: slice) -> None:
        np.add.at(examined, of[asking], rows.stop - rows.start)
        if not counts:
            for s in _query_chunks(len(asking), rows.stop - rows.start):
                query = of[asking[s]]
                top.add(asking[s], qn[query], q_ok[query], bn[rows], b_ok[rows], ids[rows])

    if len(every):
        for s in range(0, len(ids), BLOCK_ROWS):
            meet(every, slice(s, min(s + BLOCK_ROWS, len(ids))))
    held = np.unique(cells)
    begin, end = np.searchsorted(cells, held), np.searchsorted(cells, held, side="right")
    first, last = np.searchsorted(cell, held), np.searchsorted(cell, held, side="right")
    for b0, b1, q0, q1 in zip(begin.tolist(), end.tolist(), first.tolist(), last.tolist()):
        for s in range(b0, b1 if q1 > q0 else b0, BLOCK_ROWS):
            meet(row[q0:q1], slice(s, min(s + BLOCK_ROWS, b1)))
    if counts:
        at = np.flatnonzero(examined)
        return pa.table({**{c: q_tbl.column(c).take(pa.array(at)) for c in keys}, "examined": pa.array(examined[at], pa.int64())})
    keep = _reach(top, of, slot_level, len(qn)) if levelled else top.ids != SENTINEL_ID
    slot = np.nonzero(keep)[0]
    at = pa.array(of[slot])
    dist = top.d[keep]
    found = {"level": pa.array(slot_level[slot], pa.int32())} if levelled else {}
    return pa.table({**{c: q_tbl.column(c).take(at) for c in keys}, **found, "id": pa.array(top.ids[keep], pa.int64()),
                     "distance": pa.array(np.where(np.isinf(dist), np.nan, dist), pa.float64())})


def cell_pair_topk_partition(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray,
                             qn: np.ndarray, q_ok: np.ndarray, cell_slots: dict,
                             slot_query: np.ndarray, slot_cell: np.ndarray, k: int, dim: int,
                             id_col: str, vec_col: str, cell_col: str,
                             dtype=np.float64) -> Iterator[pa.RecordBatch]:
    """Top-k per (query, probed cell) pair ("slot"), so one pass at the
    largest probe count serves every smaller probe count: the top-k over
    probes <= P is the top-k of the union of the per-cell lists."""
    qn = qn.astype(dtype, copy=False)
    top = TopK(len(slot_query), k)
    for rb in batches:
        if rb.num_rows == 0:
            continue
        cells = rb.column(cell_col).to_numpy(zero_copy_only=False)
        ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
        b, valid = vectors_from_arrow(rb.column(vec_col), dim, dtype)
        bn, b_ok = normalise(b, valid)
        order = np.argsort(cells, kind="stable")
        bounds = np.flatnonzero(np.diff(cells[order])) + 1
        for grp in np.split(order, bounds):
            if len(grp) == 0:
                continue
            slots = cell_slots.get(int(cells[grp[0]]))
            if slots is None:
                continue
            grp = grp[valid[grp]]
            if len(grp) == 0:
                continue
            for s in _query_chunks(len(slots), len(grp)):
                sl = slots[s]
                qr = slot_query[sl]
                top.add(sl, qn[qr], q_ok[qr], bn[grp], b_ok[grp], ids[grp])
    keep = top.ids != SENTINEL_ID
    shape = top.ids.shape
    qi = np.broadcast_to(query_ids[slot_query][:, None], shape)[keep]
    ce = np.broadcast_to(slot_cell[:, None], shape)[keep]
    dist = np.where(np.isinf(top.d), np.nan, top.d)[keep]
    yield pa.RecordBatch.from_arrays(
        [pa.array(qi, pa.int64()), pa.array(ce, pa.int32()), pa.array(top.ids[keep], pa.int64()),
         pa.array(dist, pa.float64())], names=["query_id", "cell", "id", "distance"])
