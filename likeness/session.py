"""Session factory and shipping of this package to the Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str = "local[*]", name: str = "likeness", **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for (ANSI on, UTC, adaptive plans)."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="likeness-")).resolve() / "likeness_pkg.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
