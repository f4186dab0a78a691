"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="plaza-code-")) / "plaza_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    _SENT.add(sc.applicationId)
