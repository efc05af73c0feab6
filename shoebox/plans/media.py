"""Named queries over media bytes that Spark builds from the driver's tables, over detections, and over edits and deletions of groups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import times, vectors
from ..operators import dedupe, plan
from ..sources import files as sources
from . import fixtures as X
from .registry import GROUPED, KEEP, grouped, query


def _bytes(digits: str) -> Column:
    return F.unhex(F.lit(digits.replace(" ", "")))


def _number(value: Column, size: int, order: str = "big") -> Column:
    """A whole number as so many bytes."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    pairs = [F.substr(text, F.lit(2 * i + 1), F.lit(2)) for i in range(size)]
    return F.unhex(F.concat(*(pairs if order == "big" else pairs[::-1])))


#: A TIFF structure with an Exif directory that holds a date, and one that holds a fraction of a second, 12, as well.
PLAIN = "49492A0008000000 0100 6987 0400 01000000 1A000000 00000000 0100 0390 0200 14000000 2C000000 00000000"
SPLIT = "49492A0008000000 0100 6987 0400 01000000 1A000000 00000000 0200 0390 0200 14000000 38000000 9192 0200 03000000 31320000 00000000"


def _stamp() -> Column:
    return F.concat(F.encode(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), "UTF-8"), _bytes("00"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) + CASE WHEN o_orderkey % 2 = 0 THEN 120 ELSE 0 END END AS capture_ms, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS subsec_known, CASE WHEN o_orderkey % 5 <> 0 THEN 'exif' END AS source FROM orders""")
def raw_dates(spark, sf_dir):
    """Capture times of raw files' headers; every fifth is cut off."""
    whole = F.when(F.col("o_orderkey") % 2 == 0, F.concat(_bytes(SPLIT), _stamp())).otherwise(F.concat(_bytes(PLAIN), _stamp()))
    content = F.when(F.col("o_orderkey") % 5 == 0, F.substr(whole, F.lit(1), F.lit(30))).otherwise(whole)
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    return o.select("o_orderkey", sources.capture("content", F.lit(".cr2")).alias("c")).select("o_orderkey", "c.capture_ms", "c.subsec_known", "c.source")


@query("""SELECT o_orderkey, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS capture_ms, CAST(o_orderkey % 4000 + 1 AS INT) AS width, CAST(o_custkey % 3000 + 1 AS INT) AS height FROM orders""")
def jpeg_headers(spark, sf_dir):
    """Capture time and size of JPEG files' headers."""
    exif = F.concat(_bytes("457869660000"), _bytes(PLAIN), _stamp())
    frame = F.concat(_bytes("FFC0000B08"), _number(F.col("o_custkey") % 3000 + 1, 2), _number(F.col("o_orderkey") % 4000 + 1, 2), _bytes("01011100"))
    content = F.concat(_bytes("FFD8FFE1"), _number(F.octet_length(exif) + 2, 2), exif, frame, _bytes("FFDA0002FFD9"))
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content"))
    read = o.select("o_orderkey", sources.capture("content", F.lit(".jpg")).alias("c"), sources.probed("content", F.lit(".jpg")).alias("p"))
    return read.select("o_orderkey", "c.capture_ms", "p.width", "p.height")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE CAST(epoch_us(ts) // 1000000 * 1000 AS BIGINT) END AS capture_ms, CASE WHEN event_id % 7 <> 3 THEN 'mvhd' END AS source FROM events""")
def movie_headers(spark, sf_dir):
    """Creation times of movies' headers, in seconds since 1904; every seventh movie has none."""
    created = F.unix_seconds(F.col("ts").cast("timestamp")) + 2082844800
    header = F.concat(_bytes("00000000"), _number(created, 4), _number(created, 4), _bytes("000003E800001388"), _bytes("00" * 80))
    box = lambda kind, body: F.concat(_number(F.octet_length(body) + 8, 4), F.encode(F.lit(kind), "UTF-8"), body)
    movie = F.when(F.col("event_id") % 7 == 3, box("moov", box("free", header))).otherwise(box("moov", box("mvhd", header)))
    content = F.concat(box("ftyp", F.encode(F.lit("isom0000"), "UTF-8")), box("mdat", _bytes("AB" * 500)), movie)
    e = X.table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    return e.select("event_id", sources.capture("content", F.lit(".mp4")).alias("c")).select("event_id", "c.capture_ms", "c.source")


def _iou(a: str, b: str) -> str:
    side = lambda c, d: f"greatest(0.0, least({a}.{c} + {a}.{d} / 2, {b}.{c} + {b}.{d} / 2) - greatest({a}.{c} - {a}.{d} / 2, {b}.{c} - {b}.{d} / 2))"
    inter = f"({side('cx', 'w')} * {side('cy', 'h')})"
    return f"({inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}))"


def _within(values) -> str:
    return "(" + ", ".join(map(str, values)) + ")"


DETECTED = "SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 97 AS DOUBLE) / 97 AS score, CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 14 + l_partkey % 10 ELSE l_partkey % 60 END AS INT) AS kind, CAST(l_quantity AS DOUBLE) * 4 AS cx, CAST(l_discount AS DOUBLE) * 1000 AS cy, CAST(40 + l_partkey % 60 AS DOUBLE) AS w, CAST(40 + l_suppkey % 60 AS DOUBLE) AS h FROM {lineitem}"
#: Of each order's detections the subjects by falling score; each stays unless it overlaps a better one of its kind.
SCENES = f"""WITH RECURSIVE d AS ({DETECTED.format(lineitem="lineitem")}), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS i FROM d WHERE kind = 0 AND score >= {vectors.PERSON_SCORE} OR kind IN {_within(vectors.ANIMAL)} AND score >= {vectors.ANIMAL_SCORE}),
walk AS (
  SELECT l_orderkey, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(score DOUBLE, kind INT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE)[]) AS kept FROM (SELECT DISTINCT l_orderkey FROM d)
  UNION ALL
  SELECT w.l_orderkey, s.i, CASE WHEN len(list_filter(w.kept, lambda k: k.kind = s.kind AND {_iou("k", "s")} >= 0.5)) > 0 THEN w.kept ELSE list_append(w.kept, {{'score': s.score, 'kind': s.kind, 'cx': s.cx, 'cy': s.cy, 'w': s.w, 'h': s.h}}) END
  FROM walk w JOIN s ON s.l_orderkey = w.l_orderkey AND s.i = w.i + 1
),
done AS (SELECT l_orderkey, arg_max(kept, i) AS kept FROM walk GROUP BY l_orderkey),
large AS (SELECT l_orderkey, len(kept) AS n_kept, list_filter(kept, lambda b: b.w * b.h >= {vectors.MIN_SUBJECT}) AS kept FROM done),
split AS (SELECT *, list_filter(kept, lambda b: b.kind = 0) AS people FROM large),
found AS (SELECT *, len(list_filter(kept, lambda b: b.kind IN {_within(vectors.ANIMAL)} AND NOT (len(people) > 0 AND b.kind IN {_within(vectors.SUSPECT_ANIMAL)}) AND len(list_filter(people, lambda p: {_iou("b", "p")} >= {vectors.OVERLAP})) = 0)) > 0 AS animal FROM split),
shut AS (SELECT l_orderkey, bool_or(kind IN {_within((*vectors.VEHICLE, *vectors.INDOOR))} AND score >= {vectors.OBJECT_SCORE}) AS blocked FROM d GROUP BY l_orderkey)
SELECT l_orderkey, n_kept, concat_ws(' ', CASE WHEN animal THEN 'animal' END, CASE WHEN len(people) = 0 AND NOT animal AND NOT blocked THEN 'landscape' END, CASE WHEN len(people) > 0 THEN 'person' END) AS labels FROM found JOIN shut USING (l_orderkey)"""


@query(SCENES)
def scene_labels(spark, sf_dir):
    """Each order's items as detections in one picture: what is left after suppression, and the picture's labels."""
    d = spark.sql(DETECTED, lineitem=X.table(spark, sf_dir, "lineitem"))
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "score", "kind", "cx", "cy", "w", "h"))), lambda b: b.dropFields("l_linenumber"))
    pictures = d.groupBy("l_orderkey").agg(boxes.alias("found"))
    subject = F.filter("found", lambda b: ((b["kind"] == 0) & (b["score"] >= vectors.PERSON_SCORE)) | (b["kind"].isin(*vectors.ANIMAL) & (b["score"] >= vectors.ANIMAL_SCORE)))
    return pictures.select("l_orderkey", F.size(vectors.nms(subject)).cast("bigint").alias("n_kept"), F.array_join(vectors.scene_labels("found"), " ").alias("labels"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'EXIF' WHEN 'view' THEN 'XMP' WHEN 'error' THEN '视频拍摄时间' ELSE '无拍摄时间' END AS label FROM events")
def capture_sources(spark, sf_dir):
    kind = F.col("event_type")
    source = F.when(kind == "click", "exif").when(kind == "view", "xmp").when(kind == "error", "quicktime")
    return X.table(spark, sf_dir, "events").select("event_id", times.source_label(source).alias("label"))


@query(f"""WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk, min(doc_id) OVER (PARTITION BY size, hash) AS first_id FROM grouped), e AS (SELECT *, first_id = (SELECT min(first_id) FROM r) AS mine FROM r), last AS (SELECT max(doc_id) AS doc_id FROM e WHERE mine)
SELECT doc_id, CASE WHEN mine AND doc_id = (SELECT doc_id FROM last) THEN 'keep' WHEN rk = 1 AND NOT mine THEN 'keep' ELSE 'delete' END AS role FROM e""")
def roles_edited(spark, sf_dir):
    """The last file of one group is kept in place of the one before."""
    g = dedupe.with_roles(grouped(spark, sf_dir)).withColumn("path_key", F.col("doc_id").cast("string"))
    first = g.groupBy("group_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("low").first()
    return plan.with_role(g, first["group_id"], str(first["high"]), "keep").select("doc_id", "role")


@query(f"""WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped), k AS (SELECT *, max(CASE WHEN rk = 1 THEN doc_id END) OVER (PARTITION BY size, hash) AS keep_id FROM r)
SELECT doc_id, CASE WHEN doc_id % 2 = 1 OR bit_count(xor(doc_id, keep_id)) <= 3 THEN '' ELSE 'picture' END AS reason FROM k WHERE rk > 1""")
def similar_deletions(spark, sf_dir):
    """Files that are alike but not equal get new fingerprints before they may go."""
    files = lambda df: df.withColumn("path", F.col("doc_id").cast("string")).withColumn("path_key", F.col("doc_id").cast("string"))
    g = files(dedupe.with_roles(grouped(spark, sf_dir))).withColumn("kind", F.lit("similar"))
    other = F.when((F.col("role") == "delete") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("#"), F.col("path"))).otherwise(F.col("hash"))
    out = plan.deletions(g.withColumn("hash", other), files(X.files(spark, sf_dir)), max_distance=3, refingerprint=lambda c: F.col(c).cast("bigint"))
    return out.select(F.col("path").cast("bigint").alias("doc_id"), F.when(F.col("reason").isNull(), "").when(F.col("reason") == plan.SKIPPED["picture"], "picture").otherwise(F.col("reason")).alias("reason"))


@query(f"""WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped), gone AS (SELECT * FROM r WHERE rk > 1)
SELECT g.doc_id, count(l.doc_id) AS n_sidecars, coalesce(string_agg(CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN '.xmp' ELSE '.aae' END END, ' '), '') AS kinds FROM gone g LEFT JOIN labels l ON l.doc_id = g.doc_id GROUP BY g.doc_id""")
def deletions_with_sidecars(spark, sf_dir):
    """Files that go take their sidecars along."""
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".JPG"))
    files = lambda df: df.withColumn("path", path).withColumn("path_key", F.lower(path))
    g = files(dedupe.with_roles(grouped(spark, sf_dir))).withColumn("kind", F.lit("exact"))
    beside = X.table(spark, sf_dir, "labels").select(F.concat(F.lit("/D/"), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, ".xmp").otherwise(".aae")).alias("path"))
    out = plan.with_sidecars(plan.deletions(g, files(X.files(spark, sf_dir))), beside)
    kinds = F.array_join(F.transform("sidecars", lambda s: F.regexp_extract(s, r"\.[a-z]+$", 0)), " ")
    return out.select(F.regexp_extract("path", r"(\d+)\.JPG$", 1).cast("bigint").alias("doc_id"), F.size("sidecars").cast("bigint").alias("n_sidecars"), kinds.alias("kinds"))
