"""Boundaries between the stages of a job: each is written to the shared folder once and read by all that follows.

What a stage computed, such as times and hashes read from files, is never computed again, however many later steps use it, and a lost executor costs no more than the stage at hand. Counts of a stage's rows are
observed while it is written, so they need no pass of their own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Stages:
    """Written stages of one job, and the counts observed on the way.

    They live below spark.checkpoint.dir, which the driver and all executors must share; where it is unset and all run in one process, below a temporary folder. close() deletes them all; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = os.path.join(tempfile.gettempdir(), "shoebox-stages")
        self.spark, self.root = spark, f"{root}/stages-{uuid.uuid4().hex}"
        self.counts: dict[str, int] = {}
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(self.root))
        self._written: dict[str, str] = {}

    def put(self, rows: DataFrame, name: str, **counts: Column) -> DataFrame:
        """The rows of a stage, written; counts are aggregates over them. A name may be used again: what it named before is deleted when the new rows stand."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        seen = Observation(f"{name}-{uuid.uuid4().hex}") if counts else None
        kept = rows.observe(seen, *(c.alias(k) for k, c in counts.items())) if seen else rows
        kept.write.option("compression", "zstd").parquet(path)
        if seen:
            self.counts |= {k: int(v or 0) for k, v in seen.get.items()}
        self.drop(name)
        self._written[name] = path
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete stages that nothing reads any more."""
        for name in names:
            path = self._written.pop(name, None)
            if path:
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def keep_only(self, *names: str) -> None:
        self.drop(*(set(self._written) - set(names)))

    def close(self) -> None:
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)
        self._written = {}
