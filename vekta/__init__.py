"""vekta — nearest-neighbour search and ANN evaluation on Spark DataFrames.

Every public operator takes DataFrames (plus plain keyword parameters) and
returns a lazily evaluated DataFrame; nothing is collected on the driver
except size-checked broadcast blocks and scalar counters.

    from vekta import knn_join, build_truth, ivf_build, ivf_search, recall_curve
"""

__version__ = "0.1.0"

from .functions.vectors import cosine_distance, params_key, with_stddev_band  # noqa: E402,F401
from .functions.text import extract_plan_buffers, extract_run_metrics, extract_timing  # noqa: E402,F401
from .operators.graph import graph_build, graph_search, graph_search_multi  # noqa: E402,F401
from .operators.ingest import appended_rows, ingest_append, plan_ingest, seed_rows, window_counts  # noqa: E402,F401
from .operators.ivf import (assign_cells, ivf_build, ivf_from_labels, ivf_search,  # noqa: E402,F401
                            search_effort, with_cells)
from .operators.knn import (build_truth, knn, knn_join, neighbour_lists,  # noqa: E402,F401
                            point_workload, sample_queries)
from .operators.metrics import index_stats, latency_summary, latency_windows, summarize  # noqa: E402,F401
from .operators.recall import recall_at_k, recall_curve  # noqa: E402,F401
from .operators.search import search  # noqa: E402,F401
from .operators.results import (compare_results, distinct_params, lookup_result,  # noqa: E402,F401
                                metric_series, metric_series_all, upsert_results)
from .operators.sweep import evaluate_build, evaluate_search, param_grid, sweep_graph, sweep_ivf  # noqa: E402,F401
from .sources.catalog import ResultsStore, drop_index, read_ivf_index, write_index  # noqa: E402,F401
from .sources.vectors import load_truth, load_vectors, validate_vectors, with_positional_id  # noqa: E402,F401
