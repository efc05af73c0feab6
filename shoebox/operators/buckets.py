"""A table that is changed in place, bucket by bucket.

Rows are dealt to a fixed number of buckets by a hash of their key. A manifest names the folder of each bucket that holds rows; a change reads and writes only the buckets that it touches, puts them in new folders, and then moves
a new manifest into place under the next number. Readers see the table before the change or after it; a change that fails leaves the old manifest, and of two that started from the same version the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another change came first."""


class BucketedTable:
    """A table below a folder; key is the column that tells its rows apart."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "path", buckets: int = 256):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema: StructType = spark.createDataFrame([], schema).schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        version = self.version()
        #: The number that the table was made with stands, whatever is asked for later.
        self.buckets = self._manifest(version)["buckets"] if version else buckets

    def _manifests(self) -> dict[int, str]:
        folder = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {int(n[9:-5]): n for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()}

    def version(self) -> int:
        """The number of the current version; 0 before the first change."""
        return max(self._manifests(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"buckets": self.buckets, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{version}.json", wholetext=True).first()[0])

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        """Rows of folders; columns that older ones lack are null."""
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(self.version() if version is None else version)["folders"].values())

    def bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(column or self.key), F.lit(self.buckets)).cast("int")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Give the rows of all buckets that hold one of the keys, or would, to change, and put what it returns in their place; how many buckets were touched.

        keys has the key's column. change gets rows of other keys of these buckets as well and must return them; what it returns must fall into the same buckets.
        """
        touched = {r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets
        if not touched:
            return 0
        version = self.version()
        folders = {int(b): f for b, f in self._manifest(version)["folders"].items()}
        rows = change(self._rows(f for b, f in folders.items() if b in touched)).select(*(F.col(c.name).cast(c.dataType) for c in self.schema))
        data = f"data-{version + 1}-{uuid.uuid4().hex}"
        slots = min(len(touched), 4 * self.spark.sparkContext.defaultParallelism)
        rows.withColumn("_bucket", self.bucket()).repartition(slots, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{data}")
        written = {int(s.getPath().getName()[8:]): f"{data}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.root}/{data}")) if s.getPath().getName().startswith("_bucket=")}
        if not written.keys() <= touched:
            raise ValueError("a change returned rows of buckets that it was not given")
        self._commit(version + 1, {b: f for b, f in folders.items() if b not in touched} | written)
        return len(touched)

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        temporary, final = self._path(f"{self.root}/_manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{version}.json")
        out = self._fs.create(temporary, False)
        out.write(json.dumps({"buckets": self.buckets, "folders": folders}).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else jvm.java.io.File("/").toURI(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, final, none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """merge(old rows of the touched buckets, new) in their place."""
        return self.rewrite(new.select(self.key), lambda old: merge(old, new))

    def delete(self, gone: DataFrame) -> int:
        """Without the rows of the keys in gone."""
        return self.rewrite(gone.select(self.key), lambda old: old.join(gone.select(self.key).distinct(), self.key, "left_anti"))

    def tidy(self, keep: int = 2) -> None:
        """Delete all but the last versions' manifests, and folders that none of those names: what older versions or failed changes left. Not while a change runs."""
        manifests = self._manifests()
        kept = sorted(manifests)[-keep:]
        used = {f.split("/")[0] for v in kept for f in self._manifest(v)["folders"].values()}
        for v, name in manifests.items():
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/{name}"), False)
        for s in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            name = s.getPath().getName()
            if (name.startswith("data-") and name not in used) or name.startswith("_manifest-"):
                self._fs.delete(s.getPath(), True)
            elif name in used:  # buckets of a change that later ones have replaced
                named = {f for v in kept for f in self._manifest(v)["folders"].values()}
                for b in self._fs.listStatus(s.getPath()):
                    if b.getPath().getName().startswith("_bucket=") and f"{name}/{b.getPath().getName()}" not in named:
                        self._fs.delete(b.getPath(), True)
