"""Hand this package to the executors' Python workers through Spark's own file server."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; needed only by the few operators that run Python on executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="cohortloom-")) / "cohortloom_core.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
