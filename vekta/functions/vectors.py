"""Column expressions over vector (array<float>) and id-list columns.

All of these stay JVM-side (higher-order functions), so they run inside
whole-stage codegen spans. The bulk distance path uses the Arrow kernel in
``vekta.operators.kernel``; these expressions serve single comparisons,
filters and the SQL-only form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector_norm(v) -> Column:
    """Euclidean norm, computed in double."""
    v = _c(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - a·b / (|a| |b|); NaN when a norm is zero, NULL when an input is NULL.

    Pass precomputed norm columns to avoid recomputing them per pair.
    Spark's ANSI mode raises on 0/0, so the zero-norm case is a ``when``.
    """
    na = vector_norm(a) if norm_a is None else _c(norm_a)
    nb = vector_norm(b) if norm_b is None else _c(norm_b)
    den = na * nb
    return (F.when(_c(a).isNull() | _c(b).isNull(), F.lit(None).cast("double"))
            .when(den == 0, F.lit(float("nan")))
            .otherwise(F.lit(1.0) - dot(a, b) / den))


def array_prefix(ids, k: int) -> Column:
    """First k elements (1-based inclusive slice; shorter arrays stay short)."""
    return F.slice(_c(ids), 1, k)


def overlap_size(a, b) -> Column:
    """Size of the set intersection (duplicates removed); NULL arrays count as empty."""
    e = F.array().cast("array<bigint>")
    return F.size(F.array_intersect(F.coalesce(_c(a).cast("array<bigint>"), e),
                                    F.coalesce(_c(b).cast("array<bigint>"), e)))


def shift_ids(ids, offset: int) -> Column:
    """Add ``offset`` to every id of an id list."""
    return F.transform(_c(ids), lambda x: x + F.lit(offset))


def params_key(m) -> Column:
    """Canonical text key of a parameter map: JSON with keys sorted.

    Spark writes JSON without blanks (``{"lists":100,"probes":16}``); keys are
    compared within this engine only, never byte-wise with other writers.
    """
    m = _c(m)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def params_json(params: dict) -> str:
    """Driver-side twin of ``params_key`` for literal parameter sets."""
    items = ",".join(f'"{k}":{_json_scalar(params[k])}' for k in sorted(params))
    return "{" + items + "}"


def _json_scalar(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return '"' + str(v).replace('"', '\\"') + '"'


def with_stddev_band(df: DataFrame, mean: str, sd: str, prefix: str | None = None) -> DataFrame:
    """Upper/lower band = mean ± coalesce(sd, 0)."""
    p = prefix or mean
    s = F.coalesce(F.col(sd), F.lit(0.0))
    return (df.withColumn(f"{p}_upper", F.col(mean) + s)
              .withColumn(f"{p}_lower", F.col(mean) - s))
