"""What a session needs once: the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, wherever the driver found it; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_foliospark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():  # not where the package itself comes from a zip
        folder = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "foliospark.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, Path("foliospark") / f.relative_to(here))
        sc.addPyFile(path)
    sc._foliospark_shipped = True
