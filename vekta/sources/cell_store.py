"""An IVF index in folders by bucket of cells, which grows in place.

Rows lie in ``rows/gen=<g>/bucket=<b>``; a cell's bucket is its number modulo ``buckets``. An append adds one generation with the
new rows alone. A merge rewrites the buckets that lie in several generations, a split those of cells that grew too large; the
files of all other buckets stay. Which (generation, bucket) folders are live is a small versioned table: a version becomes
visible only when all it names is written, so a reader never sees half an append, and what a failed writer left is named nowhere.
One writer per store.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kernel as K
from ..operators.ingest import assigned, unknown_ids
from ..operators.ivf import IvfIndex, bucket_of
from ..operators.two_level import assign_inside, spherical_kmeans
from ..plans.shipping import ensure_shipped
from ..plans.staging import staged
from .catalog import _fs, prune_versions, read_version, versions, write_version

BUCKETS = 256
SPLIT_INTO = 64         # parts of a cell in one round of a split, at most; rounds go on until no cell is too large
FIT_ROWS = 256          # about so many rows a part are fitted, drawn by a seeded hash of the id


@dataclass
class CellStore:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, index: IvfIndex, path: str, buckets: int = BUCKETS) -> "CellStore":
        """Store ``index`` (with one or two levels of cells). Rows without a cell (null or wrong-length vectors) are kept in bucket -1."""
        store = cls(index.cells.sparkSession, path)
        shape = replace(index, buckets=buckets, lists=index.lists if index.lists > 0 else index.centroids.count())
        model = store._write_model(shape)
        store._publish(shape, model, store._write(index.cells.select("id", "v", F.col("cell").cast("int").alias("cell")), buckets))
        return store

    # ------------------------------------------------------------ reading
    def live(self) -> list[tuple[int, int]]:
        """(generation, bucket) of the newest version: at most buckets x generations numbers."""
        rows = read_version(self.spark, f"{self.path}/manifest", "live").collect()
        return sorted((r["gen"], r["bucket"]) for r in rows)

    def index(self) -> IvfIndex:
        """The newest version; its searches prune bucket folders at run time."""
        m = self._shape()
        fs, p = _fs(self.spark, f"{self.path}/model/v{m['model']:06d}/coarse")
        part = lambda name: read_version(self.spark, f"{self.path}/model", name, m["model"])
        return IvfIndex(part("centroids"), self._rows(self.live(), m["kind"]), m["lists"], m["dim"],
                        part("coarse") if fs.exists(p) else None, m["buckets"])

    def _shape(self):
        return read_version(self.spark, f"{self.path}/manifest", "shape").first()

    def _rows(self, folders: list[tuple[int, int]], kind: str) -> DataFrame:
        schema = f"id long, v {kind}, cell int, gen int, bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/rows"
        return (self.spark.read.schema(schema).option("basePath", root)
                .parquet(*[f"{root}/gen={g}/bucket={b}" for g, b in folders]))

    # ------------------------------------------------------------ writing
    def append(self, rows: DataFrame, id_col: str = "id", vec_col: str = "v", skip_known: bool = False) -> int | None:
        """Add rows to their nearest cells; no stored row is read or moved. ``skip_known`` leaves out ids that the store
        holds and keeps one row of an id that ``rows`` repeats. Returns the generation, None if nothing was left to add."""
        index, m = self.index(), self._shape()
        new = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(m["kind"]).alias("v"))
        if skip_known:
            new = unknown_ids(new, index.cells)
        added = self._write(assigned(index, new), m["buckets"])
        if added:
            self._publish(index, m["model"], self.live() + added)
        return added[0][0] if added else None

    def merge(self) -> list[int]:
        """Put the buckets that lie in several generations into one each; returns those buckets."""
        live, m = self.live(), self._shape()
        gens: dict[int, int] = {}
        for _, b in live:
            gens[b] = gens.get(b, 0) + 1
        several = sorted(b for b, n in gens.items() if n > 1)
        if several:
            self._rewrite(self.index(), m["model"], live, several, self._rows([x for x in live if gens[x[1]] > 1], m["kind"]))
        return several

    def split(self, most: int, seed: int = 42) -> int:
        """Split cells of more than ``most`` rows by k-means inside the cell, until none is larger but those whose vectors
        all point one way. The first part keeps the cell's number, the others get new ones; a row goes to the nearest part of
        its own cell. Only buckets of split cells are read and rewritten. Returns the number of cells added."""
        first, stuck = self.index().lists, self.spark.createDataFrame([], "cell int")
        while True:
            index, m, live = self.index(), self._shape(), self.live()
            parts = F.least(F.lit(SPLIT_INTO), F.ceil(F.col("count") / F.lit(most))).cast("int")
            large = (index.cells.where("cell IS NOT NULL").groupBy("cell").count().where(F.col("count") > most)
                     .join(stuck, "cell", "left_anti"))
            large = staged(large.withColumn("parts", parts), "large-cells")          # one row a cell, at most lists
            if large.isEmpty():
                return index.lists - first
            buckets = sorted(r[0] for r in large.select(bucket_of(F.col("cell"), m["buckets"])).distinct().collect())
            folders = [x for x in live if x[1] in set(buckets)]
            rows = self._rows(folders, m["kind"]).select("id", "v", "cell")
            children = staged(_fit_parts(rows.join(F.broadcast(large), "cell"), index.dim, seed), "cell-parts")
            divided = children.groupBy("cell").count().where("count > 1").select("cell")
            stuck = staged(stuck.unionByName(large.select("cell").join(divided, "cell", "left_anti")), "stuck-cells")
            children = children.join(F.broadcast(divided), "cell", "left_semi")
            if children.isEmpty():
                continue
            fresh = children.where("j > 0")
            top = index.centroids.agg(F.max("cell")).first()[0]
            number = F.row_number().over(Window.orderBy("cell", "j")) + F.lit(top)    # at most SPLIT_INTO rows a split cell
            named = (children.where("j = 0").select("cell", F.col("cell").alias("part"), "v")
                     .unionByName(fresh.select("cell", number.cast("int").alias("part"), "v")))
            named = staged(named, "cell-parts-named")
            inside = staged(rows.join(F.broadcast(divided), "cell", "left_semi").withColumnRenamed("cell", "coarse"), "split-rows")
            moved = staged(assign_inside(inside, named.select(F.col("cell").alias("coarse"), F.col("part").alias("cell"), "v"), index.dim),
                           "split-moved")
            whole = named.select("cell", "part").join(large.select("cell", F.col("count").alias("before")), "cell").drop("cell")
            undivided = (moved.groupBy("cell").count().join(whole, F.col("cell") == F.col("part"))
                         .where(F.col("count") == F.col("before")).select("cell"))   # parts too alike to part any row
            stuck = staged(stuck.unionByName(undivided), "stuck-cells")
            stay = rows.join(F.broadcast(divided), "cell", "left_anti")
            old = index.centroids.join(divided, "cell", "left_anti")
            new = named.select(F.col("part").alias("cell"), "v", F.col("cell").alias("_from"))
            if index.coarse is not None:                                              # parts stay in their cell's coarse cell
                new = new.join(index.centroids.select(F.col("cell").alias("_from"), "coarse"), "_from")
            centroids = staged(old.unionByName(new.drop("_from")), "split-centroids")
            grown = replace(index, centroids=centroids, lists=centroids.count())
            self._rewrite(grown, self._write_model(grown), live, buckets, stay.unionByName(moved))

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` versions and the folders that none of them names; returns the folders removed.
        Readers of older versions must be done."""
        prune_versions(self.spark, f"{self.path}/manifest", keep)
        named = set()
        for v in versions(self.spark, f"{self.path}/manifest"):
            named |= {(r["gen"], r["bucket"]) for r in read_version(self.spark, f"{self.path}/manifest", "live", v).collect()}
        gone = 0
        fs, root = _fs(self.spark, f"{self.path}/rows")
        for st in fs.listStatus(root):
            gen = int(st.getPath().getName().split("=")[1])
            for b in self._buckets_of(gen):
                if (gen, b) not in named:
                    gone += bool(fs.delete(_fs(self.spark, f"{self.path}/rows/gen={gen}/bucket={b}")[1], True))
        return gone

    def _buckets_of(self, gen: int) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/rows/gen={gen}")
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]

    def _write(self, rows: DataFrame, buckets: int) -> list[tuple[int, int]]:
        """``rows`` as a new generation. The range sort ends in the id, so a hot cell is spread over as many tasks as its size needs."""
        fs, p = _fs(self.spark, f"{self.path}/rows")
        taken = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)] if fs.exists(p) else []
        gen = max(taken, default=0) + 1
        (rows.withColumn("bucket", bucket_of(F.col("cell"), buckets)).repartitionByRange("bucket", "cell", "id")
         .sortWithinPartitions("bucket", "cell", "id")
         .write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.path}/rows/gen={gen}"))
        return [(gen, b) for b in self._buckets_of(gen)]

    def _rewrite(self, index: IvfIndex, model: int, live: list[tuple[int, int]], buckets: list[int], rows: DataFrame) -> None:
        gone = set(buckets)
        written = self._write(rows, index.buckets)
        self._publish(index, model, [x for x in live if x[1] not in gone] + written)

    def _write_model(self, index: IvfIndex) -> int:
        parts = {"centroids": index.centroids}
        if index.coarse is not None:
            parts["coarse"] = index.coarse
        return write_version(parts, f"{self.path}/model")

    def _publish(self, index: IvfIndex, model: int, live: list[tuple[int, int]]) -> None:
        shape = self.spark.range(1).select(
            F.lit(index.dim).cast("int").alias("dim"), F.lit(index.lists).cast("int").alias("lists"), F.lit(index.buckets).alias("buckets"),
            F.lit(model).alias("model"), F.lit(index.cells.schema["v"].dataType.simpleString()).alias("kind"))
        table = self.spark.createDataFrame(sorted(live), "gen int, bucket int").coalesce(1)
        write_version({"live": table, "shape": shape}, f"{self.path}/manifest")


def _fit_parts(rows: DataFrame, dim: int, seed: int) -> DataFrame:
    """(cell, j, v): centroids of the parts of each cell, from a sample of about FIT_ROWS rows a part: a group holds no more."""
    one_in = F.greatest(F.lit(1), F.floor(F.col("count") / (F.lit(FIT_ROWS) * F.col("parts"))))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), one_in) == 0).select("cell", "parts", "id", "v")

    def fit(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("id")
        v, valid = K.vectors_from_arrow(tbl.column("v"), dim)
        v, ok = K.normalise(v, valid)
        v = v[ok]
        parts = min(tbl.column("parts")[0].as_py(), len(v))
        c = spherical_kmeans(v, parts, seed) if parts else v
        # a part that no row is nearest to is no part
        near = sorted({int(x) for s in range(0, len(v), 4096) for x in (v[s:s + 4096] @ c.T).argmax(axis=1)}) if parts else []
        return pa.table({"cell": pa.array([tbl.column("cell")[0].as_py()] * len(near), pa.int32()),
                         "j": pa.array(range(len(near)), pa.int32()), "v": pa.array([c[i] for i in near], pa.list_(pa.float64()))})

    ensure_shipped(rows.sparkSession)
    return sample.groupBy("cell").applyInArrow(fit, "cell int, j int, v array<double>")
