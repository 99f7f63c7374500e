"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names the folder.  Where it is unset and all runs on
one machine, as in tests, a temporary folder is made and set; on a cluster that
is an error.  Tables are Parquet files that Spark itself writes and reads, so a
lost executor takes nothing with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lagspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run.  ``put`` writes one and reads it back; ``drop`` deletes."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top, self.made = spark, f"{folder(spark)}/{what}-{uuid.uuid4().hex}", 0
        self.kept: list[str] = []

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.top}/{self.made:03d}-{name}"

    def put(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path) if not by else self.spark.read.parquet(path)
        out.kept_at = path
        self.kept.append(path)
        return out

    def drop(self, *tables) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(getattr(table, "kept_at", table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        own = {t.kept_at for t in keep}
        self.drop(*[p for p in self.kept if p not in own])
        self.kept = [p for p in self.kept if p in own]


def whole(docs: DataFrame, name: str = "row") -> Column:
    """All columns of a table as one struct, so that no other column can clash with theirs."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
