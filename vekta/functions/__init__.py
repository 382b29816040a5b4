from .vectors import (cosine_distance, vector_norm, array_prefix, overlap_size,
                      shift_ids, params_key, params_json, with_stddev_band)
from .text import extract_run_metrics, extract_plan_buffers, extract_timing

__all__ = [
    "cosine_distance", "vector_norm", "array_prefix", "overlap_size", "shift_ids",
    "params_key", "params_json", "with_stddev_band",
    "extract_run_metrics", "extract_plan_buffers", "extract_timing",
]
