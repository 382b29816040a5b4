"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Leaves are hashes of a row's fields. Inside each source, leaves in id order are hashed
in runs of 16 to nodes, level by level, to the source's subroot; subroots in source order
give the root by the same rule. Sixteen leaves of a run have one path upwards, so the run
is the lowest node that holds segments. A segment is the list of steps (siblings to the left,
siblings to the right) from a node to the ancestor it points to. Each round joins the
table of segments with itself on that ancestor: segments are concatenated and the distance
doubles, until every node points past the root.

Positions come from one range sort by (source, id, hash, row), so a source that holds most rows is
split like any other. All tables between steps are in the shared folder.

Defined results: a null field is hashed as ``-``, an empty text as ``0:``; a null id sorts first
and is never tampered with; rows with one id are ordered by their hash, repeated rows are leaves of their own;
a null source is a source; an empty table gives an empty table; texts are hashed whole; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scalars import attach_scalars
from .common import staged, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_NODES = 10_000   # most target nodes of a round that are broadcast
TOP = -1                   # tree number of the tree over subroots
_STEP = "array<struct<left: string, right: string, top: boolean>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*fields: Column) -> Column:
    """``-`` for a null, else UTF-8 byte count, ``:`` and the value, of all fields."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def fold(start: Column, steps: Column) -> Column:
    """The hash at the end of a path that begins with ``start``."""
    return F.aggregate(steps, start, lambda h, s: digest(s["left"], h, s["right"]))


def placed(leaves: DataFrame, name: str) -> DataFrame:
    """``leaves`` (grp, key, hash, carried) with tree, pos and n: the place in its group and the group's size.

    A row's ``at`` is (partition, number in it); a group's rows are consecutive. One row for each (partition, group) gives
    the rows of the group in earlier partitions; the group's first ``at`` is its tree number, in group order."""
    leaves = staged(leaves.withColumn("uid", F.monotonically_increasing_id()), f"{name}-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "hash", "uid")]
    rows = staged(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("uid", "key")
                  .withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    of_group = Window.partitionBy("g")
    earlier = of_group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("part").alias("p"), F.col("grp").alias("g")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("p", "g", "first", F.min("first").over(of_group).alias("tree"), F.sum("rows").over(of_group).alias("n"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    here = rows.join(sizes, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return here.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n", "hash", "carried")


def _levels(placed: DataFrame, name: str) -> list[DataFrame]:
    """Levels 1, 2, ... of all trees: tree, level, pos, n (nodes of the tree's level), hash,
    run (the children, at most 16). The one child of a tree with a single leaf passes its hash on."""
    below, out, largest = placed, [], None
    while True:
        run = F.sort_array(F.collect_list(F.struct("pos", "hash", "carried")))
        up = (below.groupBy("tree", F.expr(f"pos div {FAN}").alias("up")).agg(run.alias("run"), F.max("n").alias("n"))
              .select("tree", F.lit(len(out) + 1).alias("level"), F.col("up").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
                      F.when(F.col("n") == 1, F.col("run")[0]["hash"]).otherwise(digest(F.array_join("run.hash", ""))).alias("hash"),
                      "run", (F.col("n") > 1).alias("hashed")))
        out.append(staged(up, f"{name}-level"))
        if largest is None:
            largest = out[0].agg(F.max("n")).first()[0] or 1
        else:
            largest = -(-largest // FAN)
        if largest <= 1:
            return out
        below = out[-1].where("n > 1").select("tree", "pos", "n", "hash", F.lit(None).cast("string").alias("carried"))


def _own_steps(top: bool) -> Column:
    """The step from child ``i`` of ``run`` to its node: none where the hash was only passed on."""
    hashes = F.col("run.hash")
    step = F.struct(F.array_join(F.slice(hashes, F.lit(1), F.col("i")), "").alias("left"),
                    F.array_join(F.slice(hashes, F.col("i") + 2, F.lit(FAN)), "").alias("right"), F.lit(top).alias("top"))
    return F.when(F.col("hashed"), F.array(step)).otherwise(F.array()).cast(_STEP)


def _segments(level: DataFrame, top: bool, child: Column) -> DataFrame:
    """One row for each child: its node, the node it points to, and the one-step segment between."""
    return (level.select("tree", "level", "pos", "run", "hashed", F.posexplode("run").alias("i", "c"))
            .select(child.alias("node"), F.struct("tree", "level", "pos").alias("to"), _own_steps(top).alias("path")))


def _jumped(segments: DataFrame, edges: int) -> DataFrame:
    """Segments to the root: each round replaces a node's target by the target's target."""
    reach = 1
    while reach <= edges:
        # what a segment of ``reach`` edges leads to lies above level ``reach`` of its tree, or in the upper tree
        target = segments.where((F.col("node.tree") == TOP) | (F.col("node.level") > reach)).select(
            F.col("node").alias("to"), F.col("to").alias("then"), F.col("path").alias("more"))
        small = target.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        open_ = segments.where(F.col("to").isNotNull()).join(F.broadcast(target) if small else target, "to").select(
            "node", F.col("then").alias("to"), F.concat("path", "more").alias("path"))
        segments = staged(segments.where(F.col("to").isNull()).unionByName(open_), "merkle-segments")
        reach *= 2
    return segments


def proofs(leaves: DataFrame) -> DataFrame:
    """From leaves (grp, key, hash, carried): carried, hash, subroot, root and proof of each leaf.
    ``proof`` lists its steps to the root: left and right siblings (hex digests, joined), and whether above the subroot."""
    lower = _levels(placed(leaves, "merkle"), "merkle")
    ends = [x.where("n = 1").select("tree", "level", "pos", "hash") for x in lower]
    subroots = reduce(DataFrame.unionByName, ends).select(F.lit(0).alias("grp"), F.col("tree").alias("key"), "hash",
                                           F.struct("tree", "level", "pos").alias("carried"))
    upper = _levels(placed(subroots, "merkle-top").withColumn("tree", F.lit(TOP).cast("long")), "merkle-top")
    child = F.struct("tree", (F.col("level") - 1).alias("level"), F.col("c.pos").alias("pos"))
    root = upper[-1].where("n = 1")
    nothing = F.lit(None).cast("struct<tree: bigint, level: int, pos: bigint>")
    segments = [root.select(F.struct("tree", "level", "pos").alias("node"), nothing.alias("to"), F.array().cast(_STEP).alias("path")),
                _segments(upper[0], True, F.col("c.carried"))]
    segments += [_segments(x, True, child) for x in upper[1:]] + [_segments(x, False, child) for x in lower[1:]]
    paths = _jumped(reduce(DataFrame.unionByName, segments), len(lower) + len(upper) - 1)
    runs = lower[0].withColumn("node", F.struct("tree", "level", "pos")).join(paths.where("node.level = 1").select("node", "path"), "node")
    # subroot: the end of the lower steps, once for a run
    runs = runs.withColumn("subroot", fold(F.col("hash"), F.filter("path", lambda s: ~s["top"])))
    out = (runs.select("run", "hashed", "subroot", "path", F.posexplode("run").alias("i", "c"))
           .select("c.carried", "c.hash", "subroot", F.concat(_own_steps(False), F.col("path")).alias("proof")))
    return attach_scalars(out, root.select(F.col("hash").alias("root")))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of ``documents``, and whether each row still verifies after the tampering of the contract."""
    docs = docs.select(*FIELDS)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(*[lowered if f == "text" else F.col(f) for f in FIELDS]))
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), leaf_hash(*map(F.col, FIELDS)).alias("hash"),
                         F.struct("doc_id", tampered.alias("tampered")).alias("carried"))
    return (proofs(leaves)
            .withColumn("folded_root", fold(F.coalesce("carried.tampered", "hash"), F.col("proof")))
            .select("carried.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return m.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", "verified")


def manifest_sql() -> str:
    """DuckDB SQL of the query: levels and paths by recursion."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')" for x in (*FIELDS[:-1], text)) + ")"

    bits = ("list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(string_split(doc_id::varchar, ''), "
            "lambda d: [ascii(d)::ubigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: "
            "xor(xor(c, b) >> 1, (3988292384::ubigint * (xor(c, b) & 1))))")
    levels = """{name}(g, level, pos, n, h) AS (
        SELECT g, 0, pos, n, h FROM {first}
        UNION ALL
        SELECT g, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}
        WHERE n > 1 GROUP BY g, level, n, pos // 16)"""
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE
      d AS (SELECT doc_id, source, {leaf('text')} AS leaf,
                   CASE WHEN xor({bits}, 4294967295) % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS altered FROM documents),
      placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                        count(*) OVER (PARTITION BY source) AS n,
                        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, leaf AS h FROM d),
      {levels.format(name='lower_nodes', first='placed')},
      subroots AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h, g AS tree FROM lower_nodes WHERE n = 1),
      {levels.format(name='upper_nodes', first='subroots')},
      nodes AS (SELECT 0 AS kind, * FROM lower_nodes UNION ALL SELECT 1, * FROM upper_nodes),
      sides AS (SELECT kind, g, level, pos, n,
                  coalesce(string_agg(h, '') OVER (run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                  coalesce(string_agg(h, '') OVER (run ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM nodes WINDOW run AS (PARTITION BY kind, g, level, n, pos // 16)),
      climb(doc_id, leaf, tree, kind, g, level, pos, n, folded, siblings) AS (
        SELECT doc_id, leaf, g, 0, g, 0, pos, n, altered, '' FROM placed
        UNION ALL
        SELECT c.doc_id, c.leaf, c.tree,
               CASE WHEN c.n > 1 THEN c.kind ELSE 1 END, CASE WHEN c.n > 1 THEN c.g ELSE 0 END,
               CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 16 ELSE c.g END,
               CASE WHEN c.n > 1 THEN (c.n + 15) // 16 ELSE (SELECT count(*) FROM subroots) END,
               CASE WHEN c.n > 1 THEN sha256(s.l || c.folded || s.r) ELSE c.folded END,
               CASE WHEN c.n > 1 THEN c.siblings || s.l || s.r ELSE c.siblings END
        FROM climb c JOIN sides s ON s.kind = c.kind AND s.g = c.g AND s.level = c.level AND s.pos = c.pos
        WHERE NOT (c.kind = 1 AND c.n = 1))
      SELECT c.doc_id, c.leaf, t.h AS subroot, r.h AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root,
             c.folded = r.h AS verified
      FROM climb c JOIN subroots t ON t.tree = c.tree, (SELECT h FROM upper_nodes WHERE n = 1) r
      WHERE c.kind = 1 AND c.n = 1"""
