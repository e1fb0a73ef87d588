"""Sending this package to the Python workers of a session, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a zip file that Spark serves to its executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(home)
    if os.path.isdir(home):  # not when it is run from such a file itself
        path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(home):
                for f in files:
                    if f.endswith(".py"):
                        at = os.path.join(folder, f)
                        z.write(at, os.path.join(name, os.path.relpath(at, home)))
        sc.addPyFile(path)
    _sent.add(sc.applicationId)
