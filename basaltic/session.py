"""What operators need of the session: the shared folder, and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: the session's spark.checkpoint.dir, or, on one machine alone, one of our own where unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf:
        own = tempfile.mkdtemp(prefix="basaltic-shared-")  # one machine: the driver's own, gone when it ends
        atexit.register(shutil.rmtree, own, True)
        conf = f"file://{own}"
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_basaltic_shipped", False):
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="basaltic-")) / "basaltic.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(name))
    context._basaltic_shipped = True
