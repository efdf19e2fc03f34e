"""Sessions: a tuned local one, and shipping this package to the executors of any."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once per application, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_sievelight_shipped", False):
        return spark
    target = os.path.join(tempfile.mkdtemp(prefix="sievelight-code-"), "sievelight.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    context._sievelight_shipped = True
    return spark


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "sievelight") -> SparkSession:
    """A session for one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
