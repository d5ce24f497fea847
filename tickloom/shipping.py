"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

import tickloom

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Adds a zip of the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(tickloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom-"), "tickloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tickloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
