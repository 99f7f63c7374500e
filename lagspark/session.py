"""Session helpers: package shipping and the settings that queries rely on."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package: a zip of its sources, sent once per context."""
    sc = spark.sparkContext
    if sc in _shipped:
        return spark
    top = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="lagspark-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    if spark.conf.get(BATCH) == "10000":  # rows hold whole texts: smaller batches than the default
        spark.conf.set(BATCH, "2000")
    _shipped.add(sc)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A session for one machine, as tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lagspark")
    for k, v in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())
