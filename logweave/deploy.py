"""Makes the package importable in Python workers that the launcher didn't prepare."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session.

    Only a local session's workers search the driver's working folder and PYTHONPATH; where those have
    the package nothing is sent.  On a cluster it may have been given with ``--py-files``, and sending
    it again does no harm.
    """
    paths = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    context = spark.sparkContext
    app, local = context.applicationId, re.fullmatch(r"local(\[.*\])?", context.master)
    if app in _shipped or (local and str(ROOT) in paths):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="logweave-package-")
    archive = shutil.make_archive(f"{folder}/logweave", "zip", ROOT, "logweave")
    context.addPyFile(archive)  # served by the driver from then on
