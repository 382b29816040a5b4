"""One entry point over the three index kinds, the way the reference picks
an index configuration per run: ``method='exact'`` (no index), ``'ivf'``
or ``'graph'``, with that method's search parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .graph import DEFAULT_EF, GraphIndex, graph_search
from .ivf import DEFAULT_PROBES, IvfIndex, ivf_search
from .knn import knn_join


def search(queries: DataFrame, k: int, *, base: DataFrame | None = None,
           index: IvfIndex | GraphIndex | None = None, probes: int = DEFAULT_PROBES,
           ef: int = DEFAULT_EF, query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """k nearest per query: (query_id, id, distance, rank).

    No index -> exact search over ``base``; an ``IvfIndex`` -> probe search
    with ``probes``; a ``GraphIndex`` -> beam search with ``ef``."""
    if index is None:
        if base is None:
            raise ValueError("exact search needs base")
        return knn_join(queries, base, k, query_id=query_id, query_vec=query_vec)
    if isinstance(index, IvfIndex):
        return ivf_search(index, queries, k, probes=probes, query_id=query_id, query_vec=query_vec)
    if isinstance(index, GraphIndex):
        return graph_search(index, queries, k, ef=ef, query_id=query_id, query_vec=query_vec)
    raise TypeError(f"not an index: {type(index)}")
