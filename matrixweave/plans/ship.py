"""Makes the package importable where a session's Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or str(root) in path:
        return
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="matrixweave-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(out))
    _SHIPPED.add(context.applicationId)
