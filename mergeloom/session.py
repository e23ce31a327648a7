"""What a session needs to run the operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that the operators count on; sizes are the cluster's to choose.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from where the driver has it, and on a cluster from a zip that Spark hands out, once a context."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    env = context.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{have}:{root}" if have else root
        if not context.master.startswith("local"):
            name = os.path.basename(package)
            context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: ``spark.checkpoint.dir``, or where that is unset on one machine, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/") if "://" in at or not at.startswith("/") else f"file://{at.rstrip('/')}"


def session(name: str = "mergeloom", **settings: str) -> SparkSession:
    """A session with ``SETTINGS`` and further ones, dots in names as __."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return ship(builder.getOrCreate())
