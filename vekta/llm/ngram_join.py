"""Near-duplicate join of documents on word 5-gram sets by chosen paths.

1. Each text's set of hashed 5-word shingles gives a fingerprint and a min-hash
   signature: coordinate i is a token sampled by hash function i, and two
   sets agree in it with probability equal to their Jaccard similarity. Texts
   with equal sets form one class, and only classes go on.
2. Every run starts with all classes in one bucket. A bucket with more than
   ``SMALL`` members splits on sampled tokens: the bucket's path picks 1/threshold
   coordinates on average, and members go to the child of their token there.
   Small buckets, and those at ``DEPTH``, are compared by brute force on signatures. The number of
   runs follows from the target recall at the threshold.
3. Pairs that look similar enough link up to connected groups (stars, never all
   pairs). Within a group, all exact Jaccard similarities are computed from the shingles
   themselves, and every pair at or above the threshold counts as a link.

Buckets and groups beyond a block are dealt out as block pairs, so no task
holds more than two blocks. Nothing is capped: every member of every bucket is compared.

Defined results: a null, empty or blank text has no shingles, no links and a class of
its own; a text of 1 to 4 words has one shingle of all its words; words are split at ASCII
white space and compared in lower case; repeated rows are copies of each other (one row out for each row in); an
empty table gives an empty table. The class id is the smallest doc_id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, staged, table, text_slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 128
DEPTH = 3            # most splits of a run; what is left is compared in blocks
SMALL = 48           # members of a bucket that is compared at once
BLOCK = 512          # members of a block
BLOCK_SHINGLES = 1_000_000
BROADCAST_ROWS = 1_000_000   # a side of a join up to this many rows of 40 bytes is broadcast
_RNG = np.random.default_rng(20240229)
_FACTORS = (_RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
_SHIFTS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    words = [t.lower().encode().split() for t in texts]
    code, known = numbered(chain.from_iterable(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[code] if known else np.zeros(0, np.uint64)
    out, at = [], 0
    gram = h[:max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        gram = mixed(gram) + h[k:len(h) - size + 1 + k] if len(gram) else gram
    for w in words:
        n = len(w)
        if n >= size:
            out.append(np.unique(gram[at:at + n - size + 1]))
        elif n:
            short = h[at:at + 1].copy()
            for k in range(1, n):
                short = mixed(short) + h[at + k:at + k + 1]
            out.append(mixed(short + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) uint32; sets must not be empty."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (mixed(flat) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], start)
    return out


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a last bucket with
    probability ``recall``: one coordinate always, a second with probability p."""
    p, q = 1 / threshold - 1, 1.0
    for _ in range(depth):
        q = 1 - ((1 - p) * (1 - threshold * q) + p * (1 - threshold * q) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def split_paths(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (path, signature) row: (row, child path)."""
    one, two = mixed(path + np.uint64(0x1F3)), mixed(path + np.uint64(0x2E5))
    share = 1 / threshold - 1
    second = np.flatnonzero((mixed(path + np.uint64(0x3D7)) >> np.uint64(11)).astype(np.float64) / (1 << 53) < share)
    row = np.concatenate([np.arange(len(path)), second])
    c1 = (one % np.uint64(COORDINATES)).astype(np.int64)
    c2 = (c1 + 1 + (two % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    c = np.concatenate([c1, c2[second]])
    return row, mixed(mixed(path[row]) + sig[row, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, text_key, n, f1, f2, sig) of every row, written to the shared folder."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets = shingle_sets(pc.fill_null(b.column("text"), "").to_pylist())
            n = np.array([len(s) for s in sets])
            some = [s for s in sets if len(s)]
            sig = np.zeros((len(sets), COORDINATES), np.uint32)
            if some:
                sig[n > 0] = signatures(some)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            f2 = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int32()), pa.array(f1), pa.array(f2),
                                              pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "text_key", "n", "f1", "f2", "sig"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    rows = src.mapInArrow(work, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_key long, n int, f1 long, f2 long, sig binary")
    return staged(rows.withColumn("rid", F.monotonically_increasing_id()), "sketch")


def by_group(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """Run ``work`` on each group of rows with equal keys. Partitions are sorted by key and cut into
    groups as they stream by, which costs less than one Python call frame and batch for each small group."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            if kept:
                out = work(pa.Table.from_batches(kept))
                kept.clear()
                if out is not None and out.num_rows:
                    yield out

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last != tuple(c[0] for c in cols)
            at = [*np.flatnonzero(new), b.num_rows]
            if at[0]:
                kept.append(b.slice(0, at[0]))
            for s, e in zip(at[:-1], at[1:]):
                yield from finish()
                kept.append(b.slice(s, e - s))
            last = tuple(c[-1] for c in cols)
        yield from finish()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(cut, schema)


def dealt_blocks(rows: DataFrame, key: str, member: str, blocks: str) -> DataFrame:
    """Rows of a key with n > 1 blocks, once for each pair of blocks that holds them; adds bi, bj and own."""
    n = F.col(blocks).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(own, o).alias("bi"), F.greatest(own, o).alias("bj")))
    return rows.withColumn("own", own).withColumn("pair", F.explode(pairs)).withColumns({"bi": F.col("pair.bi"), "bj": F.col("pair.bj")}).drop("pair")


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each member reaches over the links (a symmetric matrix)."""
    root = ids.copy()
    while True:
        low = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component of (a, b)."""
    both = staged(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("low"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "low").alias("next"))
        # a label's own label: halves the way to the smallest node
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        step = staged(moved.join(jump, "next").select("node", "comp", F.least("next", "further").alias("next")), "labels")
        if step.where("comp <> next").isEmpty():
            return step.select("node", F.col("next").alias("comp"))
        labels = step.select("node", F.col("next").alias("comp"))


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Stars (a, b) that connect all classes whose signatures look similar enough
    in a last bucket of any run. ``classes``: set_id, sig."""
    runs = runs_needed(threshold, recall)
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64))
    near = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 4096):
                b = big.slice(s, 4096)
                ids = b.column("set_id").to_numpy()
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                if "path" in b.schema.names:
                    path = b.column("path").to_numpy().view(np.uint64)
                else:
                    ids, sig, path = np.tile(ids, runs), np.tile(sig, (runs, 1)), np.repeat(roots, len(ids))
                row, child = split_paths(path, sig, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row])], ["path", "set_id"])

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        ids = group["set_id"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        if len(ids) <= SMALL:
            same = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
        else:
            same = np.zeros((len(ids), len(ids)), np.int16)
            for c in range(COORDINATES):
                same += sig[:, c, None] == sig[None, :, c]
        root = local_roots(same >= near * COORDINATES, ids)
        far = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], ["a", "b"])

    schema, leaves = "path long, set_id long", []
    rows = staged(classes.select("set_id", "sig").mapInArrow(split, schema), "paths")
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("path").count().where("count > 1")
        live = staged(rows.join(sizes, "path"), "buckets")
        leaves.append(live if depth == DEPTH else live.where(F.col("count") <= SMALL))
        if depth < DEPTH:
            rows = staged(live.where(F.col("count") > SMALL).join(classes.select("set_id", "sig"), "set_id")
                          .select("path", "set_id", "sig").mapInArrow(split, schema), "paths")
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    dealt = dealt_blocks(leaf.withColumn("blocks", F.ceil(F.col("count") / BLOCK)), "path", "set_id", "blocks")
    work = dealt.join(classes.select("set_id", "sig"), "set_id").select("path", "bi", "bj", "set_id", "sig")
    return by_group(work, ["path", "bi", "bj"], "a long, b long", compare)


def shared_counts(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, from 0/1 matrices of ``width`` tokens at a time."""
    n = np.array([len(s) for s in sets])
    token, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often > 1
    column = (np.cumsum(common) - 1)[code]
    stay = common[code]
    column, row = column[stay], np.repeat(np.arange(len(sets)), n)[stay]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(common.sum()), width):
        s, e = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        out += part @ part.T
    out[np.arange(len(sets)), np.arange(len(sets))] = n
    return out


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """(set_id, root, texts, rows): exact links of each set in its group (or block pair) and the star to
    the smallest set it reaches. ``groups``: comp, set_id, mult, shingles."""
    def check(group: pa.Table) -> pa.RecordBatch | None:
        ids, mult = group["set_id"].to_numpy(), group["mult"].to_numpy()
        own, bi, bj = (group[c].to_numpy() for c in ("own", "bi", "bj"))
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        n = np.array([len(s) for s in sets], np.float64)
        shared = shared_counts(sets).astype(np.float64)
        linked = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        # a pair inside one block belongs to the task of that block alone
        linked &= (own[:, None] != own[None, :]) | (bi == bj)[:, None]
        root = local_roots(linked, ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(linked.sum(axis=1)), pa.array(linked @ mult)],
                                          ["set_id", "root", "texts", "rows"])

    sizes = groups.groupBy("comp").agg(F.count("*").alias("members"), F.sum(F.length("shingles") / 8).alias("shingle_n"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingle_n") / BLOCK_SHINGLES))
    dealt = dealt_blocks(groups.join(sizes.select("comp", blocks.alias("blocks")), "comp"), "comp", "set_id", "blocks")
    return by_group(dealt.select("comp", "bi", "bj", "own", "set_id", "mult", "shingles"), ["comp", "bi", "bj"],
                    "set_id long, root long, texts long, rows long", check)


def sized(side: DataFrame) -> DataFrame:
    """``side`` marked for broadcast if it has few rows; else the join shuffles."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, text_key, rid, class_id, n_links (other rows at or above the
    threshold, copies too) and n_text_links (other shingle sets)."""
    rows = sketch(docs, id_col, text_col)
    classes = staged(rows.where("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("rid").alias("set_id"), F.count("*").alias("mult"), F.min("text_key").alias("text_key"), F.min("sig").alias("sig")), "classes")
    group = staged(components(candidate_edges(classes, threshold, recall)).join(
        classes.select(F.col("set_id").alias("node"), "mult", "text_key"), "node"), "groups")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets = shingle_sets(pc.fill_null(b.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("set_id"), b.column("mult"),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["comp", "set_id", "mult", "shingles"])

    wanted = group.select("text_key", F.col("node").alias("set_id"), "comp", "mult")
    texts = (docs.select(F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
             .join(sized(wanted), "text_key").groupBy("comp", "set_id", "mult").agg(F.min("text").alias("text")))
    sets = staged(texts.mapInArrow(shingles, "comp long, set_id long, mult long, shingles binary"), "shingles")
    found = staged(verified(sets, threshold), "links")
    counts = found.groupBy("set_id").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    comps = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))

    of_set = (classes.select("f1", "f2", "n", "set_id", "mult").join(counts, "set_id", "left")
              .join(comps.withColumnRenamed("node", "set_id"), "set_id", "left")
              .select("f1", "f2", "n", F.coalesce("comp", "set_id").alias("comp"),
                      (F.coalesce("rows", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links")))
    full = rows.drop("sig").join(of_set, ["f1", "f2", "n"], "left").withColumn("comp", F.coalesce("comp", "rid"))
    full = staged(full.select("rid", "doc_id", "text_key", "comp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                              F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links")), "linked")
    # classes of one row have their own id; only the others need a group's smallest
    name = full.where("n_links > 0").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return (full.join(name, "comp", "left").withColumn("class_id", F.when(F.col("n_links") > 0, F.col("class_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "class_id", "n_links", "n_text_links", "text_key", "rid", "comp"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each class: the smallest doc_id (then
    row) stays. ``classes`` comes from :func:`near_duplicates`; all columns of docs are kept."""
    grouped = classes.where("n_links > 0")
    first = grouped.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select("comp", F.col("first.rid").alias("stays"))
    # rows are known again by (id, text); the copies among rows with both equal count
    t_id, t_key, row = (fresh(n, docs.columns) for n in ("t_id", "t_key", "row"))
    marked = (grouped.join(first, "comp").groupBy("doc_id", "text_key")
              .agg(F.max((F.col("rid") == F.col("stays")).cast("int")).alias("has_first"), F.count("*").alias("rows")))
    touched = staged(marked.where("has_first = 0 OR rows > 1").select(F.col("doc_id").alias(t_id), F.col("text_key").alias(t_key), "has_first"), "dropped")
    same = F.col(id_col).eqNullSafe(F.col(t_id)) & (F.xxhash64(F.col(text_col)) == F.col(t_key))
    untouched = docs.join(sized(touched.select(t_id, t_key)), same, "left_anti")
    repeated = touched.where("has_first = 1").select(t_id, t_key)
    once = (docs.join(sized(repeated), same).groupBy(t_id, t_key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
            .select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))
    return untouched.unionByName(once)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_text_links")
