"""Make the package importable in Python workers.

Task closures refer to ``vekta`` modules (the Arrow kernels); workers that
do not have the package installed get it as a zip through
``SparkContext.addPyFile``, once per SparkContext. The zip is written to
the shared checkpoint folder, whatever file system that is on.
"""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set = set()
_PKG_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _package_zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(_PKG_DIR):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PKG_DIR)))
    return out.getvalue()


def ensure_shipped(spark: SparkSession) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    from ..session import scratch_path
    folder = sc._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "package"))
    path = sc._jvm.org.apache.hadoop.fs.Path(folder, "vekta.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(_package_zip())
    finally:
        out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(key)
