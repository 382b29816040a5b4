"""Write PLANS.md: the physical plan tree (plus pushed filters / read schema)
of each headline operator at sf0.01, AQE off so the static plan is shown.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from vekta.operators import ivf, knn, recall, results as R  # noqa: E402
from vekta.session import checkpoint_dir, local_session  # noqa: E402
from vekta.sources import fixtures as fx  # noqa: E402


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    head = text.split("\n\n")[0]
    extra = [ln.strip() for ln in text.splitlines()
             if ln.startswith(("PushedFilters", "ReadSchema", "PartitionFilters"))]
    return head + ("\n\n" + "\n".join(sorted(set(extra))) if extra else "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    q = knn._prep(b, "id", "v", "query_id")
    sections = [
        ("knn_join (broadcast query block, base streamed, WindowGroupLimit top-k)",
         knn.knn_join(b, b, 10)),
        ("ivf_search (probe filter pushed to the scan, cell kernel, no cell shuffle)",
         ivf.ivf_search(idx, b, 10, probes=3)),
        ("ivf with_cells (assignment is a pure map)",
         ivf.with_cells(b.select("id", "v"), idx.centroids, idx.dim)),
        ("recall_curve (bounded groups: <= K ids per (query, K))",
         recall.recall_curve(knn.knn_join(b, b, 10), knn.build_truth(b, b, 20), 500, [1, 5, 10])),
        ("results upsert (anti join + union; ids from distributed positions)",
         fx.results_store(spark, sf)),
    ]
    from vekta.operators import graph
    g = graph.graph_build(b.select("id", "v"), m=8, ef_construction=32, max_iter=1)
    edges = g.edges.where("kind = 'out'").withColumn("fresh", F.lit(True))
    sections += [
        ("graph build round: local join, one vector a member of a neighbourhood",
         graph.local_join(edges, g.vectors, g.dim, graph.NEIGHBOURHOOD, 32)),
        ("graph search: candidates of a round at the buckets of the node table",
         graph.at_nodes(spark.range(1000), g.nodes)),
        ("graph search (beam search over the bidirectional index; one checkpointed table per round)",
         graph.graph_search(g, b.where("id < 50"), 10, ef=20)),
    ]
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 100))
    spark.conf.set("vekta.block.maxBytes", str(64 * 8 * 100))
    sections += [
        ("knn grid path (query side above the broadcast limit)",
         knn.knn_join(b, b, 10)),
        ("ivf grid path (bounded (cell, salt, query block) groups)",
         ivf.ivf_search(idx, b, 10, probes=3)),
    ]
    spark.conf.unset("vekta.broadcast.maxBytes")
    spark.conf.unset("vekta.block.maxBytes")
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `tools/plans.py` on `{os.path.basename(sf)}` with AQE off (static plans).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", re.sub(r"#\d+", "", tree(df)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
