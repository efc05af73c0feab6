"""The photo library: tables photos, faces, people, appearances, labels and meta as DataFrames, and what is done with them.

Tables are values: an operation takes DataFrames and returns new ones; `snapshot` writes one beside the old and moves a pointer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.formats import js_round

PHOTOS = "path string, name string, ext string, dir string, size bigint, mtime_ms bigint, capture_ms bigint, year int, month int, day int, scan_id bigint, rating int, kind string, origin string, width int, height int, recognized int"
FACES = "id bigint, path string, embedding array<float>, name string, person_id bigint"
PEOPLE = "id bigint, name string, exemplar array<float>"
APPEARANCES = "path string, person_id bigint"
LABELS_TABLE = "path string, label string"
META = "key string, value string"
DEFAULTS = {"rating": 0, "kind": "photo", "origin": "", "width": 0, "height": 0, "recognized": 0}
LABELS = ("person", "animal", "landscape")
MIN_EDGES = (0, 120, 240, 360, 480)
FACE_MODEL, CLUSTER_VERSION = "buffalo_l", "4"
MAX_PAGE, PAGE, MAX_PATHS, MAX_IDS, MAX_PLAYLIST = 200, 80, 500, 1000, 5000


def opened(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of any age: columns it lacks have their defaults."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    want = spark.createDataFrame([], schema).schema
    return df.select(*((F.coalesce(F.col(f.name), F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in want))


def backfilled(photos: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """recognized is 1 where a photo has a face or a label."""
    seen = faces.select("path").union(labels.select("path")).distinct().withColumn("_seen", F.lit(1))
    return photos.join(seen, "path", "left").withColumn("recognized", F.greatest("recognized", F.coalesce("_seen", F.lit(0)))).drop("_seen")


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a table's new version and then move its pointer, so that readers see the old one or the new."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.current")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    version = int(spark.read.text(f"{root}/{name}.current").first()[0]) + 1 if fs.exists(fs_path) else 1
    df.write.mode("overwrite").parquet(f"{root}/{name}.v{version}")
    out = fs.create(fs_path, True)
    out.write(str(version).encode())
    out.close()
    return f"{root}/{name}.v{version}"


def upsert(photos: DataFrame, new: DataFrame, scan_id: int, order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same path, but keep their rating and recognition. Of several new rows of a path the last one counts, by `order` or as the rows stand."""
    rest = [c for c in new.columns if c != "path"]
    place = F.col(order) if order else F.monotonically_increasing_id()
    n = new.withColumn("_place", place).groupBy("path").agg(F.max_by(F.struct(*rest), "_place").alias("_row")).select("path", "_row.*")
    kind = F.when(F.col("kind") == "video", "video").otherwise("photo")
    origin = F.when(F.col("origin").isin("camera", "phone"), F.col("origin")).otherwise("")
    n = n.withColumn("kind", kind).withColumn("origin", origin).withColumn("scan_id", F.lit(scan_id).cast("bigint")).withColumn("_new", F.lit(True))
    joined = photos.alias("o").join(n.alias("n"), "path", "full")
    cols = []
    for c in photos.columns:
        if c == "path":
            cols.append(F.col("path"))
        elif c in ("rating", "recognized"):
            cols.append(F.coalesce(F.col(f"o.{c}"), F.lit(0)).alias(c))
        else:
            cols.append((F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in n.columns else F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def under_roots(path: Column | str, roots: list[str]) -> Column:
    return N.is_excluded(path, roots) if roots else F.lit(True)


def purge(photos: DataFrame, scan_id: int, kind: str, roots: list[str] | None = None) -> DataFrame:
    """Without rows of a kind that the scan did not see, under its roots if it had any."""
    return photos.filter(~((F.col("kind") == kind) & (F.coalesce("scan_id", F.lit(-1)) != scan_id) & under_roots("path", roots or [])))


def removed(photos: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the given paths, whatever the case of ASCII letters."""
    gone = paths.select(N.ascii_lower("path").alias("_k")).distinct()
    return photos.withColumn("_k", N.ascii_lower("path")).join(gone, "_k", "left_anti").drop("_k")


@dataclass
class Marks:
    faces: DataFrame
    labels: DataFrame
    appearances: DataFrame
    people: DataFrame


def without_orphans(photos: DataFrame, m: Marks) -> Marks:
    """Marks of photos that are there, and people who are named or appear."""
    own = lambda df: df.join(photos.select("path"), "path", "left_semi")
    faces, appearances = own(m.faces), own(m.appearances)
    seen = faces.select("person_id").union(appearances.select("person_id")).distinct()
    people = m.people.filter("name <> ''").unionByName(m.people.filter("coalesce(name, '') = ''").join(seen.withColumnRenamed("person_id", "id"), "id", "left_semi"))
    return Marks(faces, own(m.labels), appearances, people)


def rated(photos: DataFrame, path: str, rating: float) -> DataFrame:
    value = F.least(F.greatest(js_round(F.lit(float(rating))), F.lit(0)), F.lit(5)).cast("int")
    return photos.withColumn("rating", F.when(F.col("path") == path, value).otherwise(F.col("rating")))


def marked_recognized(photos: DataFrame, path: str) -> DataFrame:
    return photos.withColumn("recognized", F.when(F.col("path") == path, 1).otherwise(F.col("recognized")))


def put_meta(meta: DataFrame, key: str, value) -> DataFrame:
    row = meta.sparkSession.createDataFrame([(key, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))], META)
    return meta.filter(F.col("key") != key).unionByName(row)


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).first()
    return row["value"] if row else None


@dataclass
class Settings:
    exclude_dirs: list[str] = field(default_factory=list)
    min_edge_photo: int = 0
    min_edge_video: int = 0

    @classmethod
    def of(cls, text: str | None) -> Settings:
        """From JSON; directories once each whatever their case, edges from the list allowed."""
        try:
            d = json.loads(text or "{}")
        except ValueError:
            d = {}
        d = d if isinstance(d, dict) else {}
        seen: dict[str, str] = {}
        for x in d.get("excludeDirs") or []:
            x = str(x or "").strip()
            if x:
                seen.setdefault(x.rstrip("/\\").lower(), x)
        edge = lambda v: v if v in MIN_EDGES else 0
        return cls(list(seen.values()), edge(d.get("minEdgePhoto")), edge(d.get("minEdgeVideo")))

    def json(self) -> str:
        return json.dumps({"excludeDirs": self.exclude_dirs, "minEdgePhoto": self.min_edge_photo, "minEdgeVideo": self.min_edge_video}, ensure_ascii=False)


@dataclass
class Filter:
    """What to show; values that make no sense are ignored, those that do must all hold."""

    rating: int | None = None
    kind: str | None = None
    origin: str | None = None
    label: str | None = None
    person: str | None = None
    person_id: int | None = None
    person_ids: list[int] | None = None
    year: int | None = None
    month: int | None = None
    day: int | None = None
    text: str | None = None


def appearing(m: Marks) -> DataFrame:
    """path, person_id of faces and of other appearances, once each."""
    return m.faces.filter("person_id > 0").select("path", "person_id").union(m.appearances.select("path", "person_id")).distinct()


def filtered(photos: DataFrame, f: Filter, m: Marks | None = None) -> DataFrame:
    df = photos
    if f.rating in (1, 2, 3, 4, 5):
        df = df.filter(F.col("rating") == f.rating)
    if f.kind in ("photo", "video"):
        df = df.filter(F.col("kind") == f.kind)
    if f.origin in ("camera", "phone"):
        df = df.filter(F.col("origin") == f.origin)
    for c in ("year", "month", "day"):
        if getattr(f, c):
            df = df.filter(F.col(c) == getattr(f, c))
    text = (f.text or "").strip().replace("%", "").replace("_", "")
    if text:
        df = df.filter(F.contains(N.ascii_lower("name"), N.ascii_lower(F.lit(text))))
    if m and f.label in LABELS:
        df = df.join(m.labels.filter(F.col("label") == f.label).select("path"), "path", "left_semi")
    if m and (f.person or "").strip():
        name = f.person.strip()
        named = m.appearances.join(m.people.filter(F.col("name") == name).select(F.col("id").alias("person_id")), "person_id", "left_semi").select("path")
        df = df.join(m.faces.filter(F.col("name") == name).select("path").union(named).distinct(), "path", "left_semi")
    ids = [f.person_id] if (f.person_id or 0) > 0 else [i for i in (f.person_ids or []) if isinstance(i, int) and i > 0][:MAX_IDS]
    if m and ids:
        df = df.join(appearing(m).filter(F.col("person_id").isin(*ids)).select("path").distinct(), "path", "left_semi")
    return df


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page, the latest first."""
    n = min(MAX_PAGE, max(1, limit or PAGE))
    return df.orderBy(F.desc("capture_ms"), N.ascii_lower("path"), "path").offset(max(0, offset or 0)).limit(n)


def playlist(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("capture_ms"), N.ascii_lower("path"), "path").limit(MAX_PLAYLIST).select("path")


def tree(df: DataFrame) -> DataFrame:
    """Count and size by day, the latest first."""
    return df.groupBy("year", "month", "day").agg(F.count("*").alias("count"), F.sum("size").alias("size")).orderBy(F.desc("year"), F.desc("month"), F.desc("day"))


def rolled_up(df: DataFrame) -> DataFrame:
    """Count and size by day, month and year; level 0 is a day, 1 a month, 3 a year, 7 all."""
    return df.rollup("year", "month", "day").agg(F.count("*").alias("count"), F.sum("size").alias("size"), F.grouping_id().cast("int").alias("level"))


def kind_totals(photos: DataFrame) -> DataFrame:
    """Count and size of photos and of videos, zeros where there are none."""
    kinds = photos.sparkSession.createDataFrame([("photo",), ("video",)], "kind string")
    totals = photos.groupBy("kind").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    return kinds.join(F.broadcast(totals), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("size", F.lit(0)).alias("size"))


def count(photos: DataFrame, kind: str | None = None) -> int:
    return (photos.filter(F.col("kind") == kind) if kind in ("photo", "video") else photos).count()


def label_counts(labels: DataFrame) -> DataFrame:
    every = labels.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return every.join(F.broadcast(labels.groupBy("label").agg(F.count("*").alias("count"))), "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("count"))


def people_counts(m: Marks) -> DataFrame:
    """People with the number of different photos they are in, the most frequent first."""
    n = appearing(m).groupBy("person_id").agg(F.countDistinct("path").alias("count"))
    return m.people.join(n, m.people.id == n.person_id).select("id", "name", "count").orderBy(F.desc("count"), "id")


def other_people(counts: DataFrame, least: int = 8) -> DataFrame:
    """People in fewer photos than `least`, if anyone is in as many."""
    top = counts.agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top)).filter((F.col("top") >= least) & (F.col("count") < least)).drop("top")


def titles(people: DataFrame) -> DataFrame:
    """id and title: the name, or an ordinal among the nameless."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy((F.coalesce("name", F.lit("")) == "").alias("_")).orderBy(F.desc("count"), "id"))
    return people.withColumn("_n", nth).select("id", F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("人物 "), F.col("_n").cast("string"))).otherwise(F.col("name")).alias("title"))


def photo(photos: DataFrame, path: str) -> DataFrame:
    """The row of a path, in its exact case."""
    return photos.filter(F.col("path") == path)


def photo_faces(faces: DataFrame, path: str) -> DataFrame:
    """id and name of a photo's faces, by id."""
    return faces.filter(F.col("path") == path).select("id", "name").orderBy("id")


def state(photos: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: photos and videos, their number and bytes, and the last scan's summary as JSON, null if there is none or it is broken."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("bigint")
    totals = photos.filter(F.col("kind").isin("photo", "video")).agg(
        F.count("*").alias("total"), of("photo", 1).alias("photos"), of("video", 1).alias("videos"), of("photo", F.col("size")).alias("photo_bytes"), of("video", F.col("size")).alias("video_bytes")
    )
    summary = meta.filter("key = 'summary'").agg(F.max(F.when(F.try_parse_json("value").isNotNull(), F.col("value"))).alias("summary"))
    return totals.join(F.broadcast(summary))


def sync_deleted(photos: DataFrame, grouped: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The library and the groups without the files that were deleted."""
    from .plan import without_paths

    return removed(photos, paths), without_paths(grouped, paths)


def present(photos: DataFrame, paths: list[str]) -> DataFrame:
    keys = photos.sparkSession.createDataFrame([(p,) for p in paths[:MAX_PATHS]], "path string").select(N.ascii_lower("path").alias("_k")).distinct()
    return photos.withColumn("_k", N.ascii_lower("path")).join(F.broadcast(keys), "_k", "left_semi").select("path")


def photo_paths(photos: DataFrame, unrecognized: bool = False) -> DataFrame:
    df = photos.filter(F.col("kind") == "photo")
    return (df.filter("recognized = 0") if unrecognized else df).orderBy(F.desc("capture_ms"), "path").select("path")


def scan_delta(old: DataFrame, new: DataFrame, scan_id: int) -> DataFrame:
    """One row: rows seen by the scan, added, removed, and the new totals."""
    gone = old.join(new.select("path"), "path", "left_anti").agg(F.count("*").alias("removed"))
    before = old.agg(F.count("*").alias("before"))
    now = new.agg(F.count(F.when(F.col("scan_id") == scan_id, 1)).alias("seen"), F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return now.join(gone).join(before).select("seen", F.greatest(F.lit(0), F.col("seen") - F.col("before")).alias("added"), "removed", "total", "size")


def forgotten(photos: DataFrame, listing: DataFrame, reachable: list[str]) -> DataFrame:
    """Without files that are gone from a root that can be reached."""
    gone = photos.filter(under_roots("path", reachable) if reachable else F.lit(False)).join(listing.select(F.lower("path").alias("_k")), F.lower("path") == F.col("_k"), "left_anti")
    return photos.join(gone.select("path"), "path", "left_anti")


def neighbours(df: DataFrame) -> DataFrame:
    """path with the one before and the one after in the order of pages, null at the edges."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("capture_ms"), N.ascii_lower("path"), "path")
    top = df.orderBy(F.desc("capture_ms"), N.ascii_lower("path"), "path").limit(MAX_PLAYLIST)
    return top.select("path", F.lag("path").over(w).alias("previous"), F.lead("path").over(w).alias("following"))
