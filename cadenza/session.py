"""Getting the package to the Python workers of a session that was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def importable() -> bool:
    """Whether workers find the package as this process's environment has it: by PYTHONPATH, or from the working folder."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == _ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application, unless workers find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _shipped or importable():
        return
    path = Path(tempfile.mkdtemp(prefix="cadenza-")) / "cadenza.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "cadenza").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
