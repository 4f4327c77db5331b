"""State of earlier runs and intermediate tables, as versioned Parquet folders."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.schema import STATE_VERSION


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back."""
    path = f"{shared_dir(df.sparkSession)}/inkwell/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class State:
    """Tables of runs under a root: <root>/<table>/run=<n>. The last finished run is current, the one before it previous."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self):
        path = self._hadoop.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, table: str) -> list[int]:
        """Numbers of the runs that were written to the end."""
        fs, at = self._fs(), self._hadoop.Path(f"{self.root}/{table}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("run=")]
        return sorted(int(p.getName()[4:]) for p in found if fs.exists(self._hadoop.Path(p, "_SUCCESS")))

    def write(self, table: str, df: DataFrame, **facts: object) -> int:
        """Add a run and drop those before the previous one. facts are kept with it, with the time in UTC, for facts()."""
        facts["generated_at"] = datetime.now(UTC).isoformat(timespec="milliseconds")
        run = max(self.runs(table), default=0) + 1
        df.withColumn("version", F.lit(STATE_VERSION)).withColumn("facts", F.lit(json.dumps(facts, sort_keys=True))).write.mode("overwrite").parquet(f"{self.root}/{table}/run={run}")
        for old in self.runs(table)[:-2]:
            self._fs().delete(self._hadoop.Path(f"{self.root}/{table}/run={old}"), True)
        return run

    def read(self, table: str, back: int = 0) -> DataFrame | None:
        """The current run's rows, or those of `back` runs before; None if there is none of this version."""
        runs = self.runs(table)
        if len(runs) <= back:
            return None
        try:
            df = self.spark.read.parquet(f"{self.root}/{table}/run={runs[-1 - back]}")
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if "version" not in df.columns or df.filter(~F.col("version").eqNullSafe(STATE_VERSION)).limit(1).count():
            return None
        return df.drop("version", "facts")

    def facts(self, table: str, back: int = 0) -> dict:
        runs = self.runs(table)
        if len(runs) <= back:
            return {}
        row = self.spark.read.parquet(f"{self.root}/{table}/run={runs[-1 - back]}").select("facts").first()
        return json.loads(row["facts"]) if row else {}

    def clear(self) -> None:
        """Drop all runs; only folders named run=<n> go."""
        fs, root = self._fs(), self._hadoop.Path(self.root)
        if fs.exists(root):
            for t in fs.listStatus(root):
                if t.isDirectory():
                    for s in fs.listStatus(t.getPath()):
                        if s.getPath().getName().startswith("run="):
                            fs.delete(s.getPath(), True)
