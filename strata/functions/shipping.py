"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once per session.

    A cluster whose workers already have the repository on PYTHONPATH needs nothing; otherwise the
    package is zipped and sent along with ``addPyFile``.
    """
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_strata_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="strata-ship-")) / "strata_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "strata").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))
    sc._strata_shipped = True
