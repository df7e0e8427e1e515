"""Session helpers: a tuned local session, and the package's code for the executors."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str | int = 8, app: str = "ragloom") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors by Spark's own file server, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ragloom-code-"), "ragloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(here.rglob("*.py")):
            archive.write(path, path.relative_to(here.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under ``spark.checkpoint.dir``; only a local session may do without that."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ragloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """What an action gives, and the milliseconds it took."""
    began = time.monotonic()
    found = action()
    return found, (time.monotonic() - began) * 1000
