"""Arrow functions on executors: the package goes with the job."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
