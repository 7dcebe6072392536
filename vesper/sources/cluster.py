"""What a session's executors need: the package's code, and a folder that all of them share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per context; they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_vesper_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="vesper-code-")) / "vesper_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._vesper_shipped = True


def set_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and the session is local a temporary one is made and set.

    On a cluster executors would each write to a disk of their own, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="vesper-checkpoint-")
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()
