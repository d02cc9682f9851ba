"""The package on the machines of the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext

_sent: set[str] = set()


def send_package(context: SparkContext) -> None:
    """Give this package to the Python workers, once for each application, so that it need not be installed on their machines."""
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.realpath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestar-")), "lodestar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(top, "lodestar")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    _sent.add(context.applicationId)
