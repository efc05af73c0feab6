"""Named queries over the steps of the duplicate funnel whose order matters, with recursive SQL beside them, and over its counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import dedupe
from ..operators.stages import Stages
from . import fixtures as X
from .registry import EVENTS, FILES, PHOTOS, query

FAMILY = "CASE lower(ext) WHEN '.jpeg' THEN '.jpg' ELSE lower(ext) END"


def _buckets_sql(rows: str, key: str, tol: int) -> str:
    """Buckets of one sequence: from the first second after each gap on, the next bucket begins with the first second beyond the tolerance."""
    return f"""WITH RECURSIVE {rows}, secs AS (SELECT DISTINCT capture_ms // 1000 AS s FROM src WHERE capture_ms IS NOT NULL),
    run AS (SELECT s, sum(CASE WHEN s - prev <= {tol} THEN 0 ELSE 1 END) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT s, lag(s) OVER (ORDER BY s) AS prev FROM secs)),
    starts AS (SELECT run, min(s) AS s FROM run GROUP BY run UNION ALL SELECT r.run, min(r.s) AS s FROM starts t JOIN run r ON r.run = t.run AND r.s > t.s + {tol} GROUP BY r.run, t.s),
    placed AS (SELECT r.s, max(t.s) AS start FROM run r JOIN starts t ON t.run = r.run AND t.s <= r.s GROUP BY r.s),
    sized AS (SELECT src.*, start, count(*) OVER (PARTITION BY start) AS files FROM src JOIN placed ON src.capture_ms // 1000 = placed.s)
    SELECT {key}, CAST(start AS BIGINT) AS start, files FROM sized WHERE files >= 2"""


@query(_buckets_sql(f"{PHOTOS}, src AS (SELECT path, capture_ms // 3600 AS capture_ms FROM photos)", "path", 61))
def capture_buckets(spark, sf_dir):
    """All photos as one sequence, an hour taken for a second: buckets that begin with their first photo and last for the tolerance."""
    p = X.photos(spark, sf_dir).select("path", F.expr("capture_ms div 3600").alias("capture_ms"))
    b = dedupe.anchored_buckets(p, 61)
    return b.select("path", F.col("bucket").cast("bigint").alias("start"), F.count("*").over(Window.partitionBy("bucket")).alias("files"))


@query(_buckets_sql(f"{EVENTS}, src AS (SELECT path, capture_ms FROM shots)", "path", 120))
def shot_buckets(spark, sf_dir):
    """Shots with gaps all over: mostly short runs."""
    b = dedupe.anchored_buckets(X.events(spark, sf_dir).select("path", "capture_ms"), 120)
    return b.select("path", F.col("bucket").cast("bigint").alias("start"), F.count("*").over(Window.partitionBy("bucket")).alias("files"))


TOLERANCE = 5
#: Within each block of files of one family and directory: files whose times have fractions chain; whole seconds then join, one after another, the only cluster they fit.
MIXED_SQL = f"""WITH RECURSIVE {FILES}, timed AS (SELECT doc_id, capture_ms, subsec_known, capture_ms // 1000 AS s, {FAMILY} || regexp_replace(path, '/[^/]*$', '') AS block FROM files WHERE capture_ms IS NOT NULL),
fine AS (SELECT *, sum(CASE WHEN capture_ms - prev <= {TOLERANCE * 1000} THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY capture_ms, doc_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(capture_ms) OVER (PARTITION BY block ORDER BY capture_ms, doc_id) AS prev FROM timed WHERE subsec_known)),
spans AS (SELECT block, g, CAST(min(s) AS BIGINT) AS lo, CAST(max(s) AS BIGINT) AS hi FROM fine GROUP BY block, g),
loose AS (SELECT doc_id, block, s, row_number() OVER (PARTITION BY block ORDER BY doc_id) AS i FROM timed WHERE NOT subsec_known),
blocks AS (SELECT DISTINCT block FROM timed),
walk AS (
  SELECT b.block, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS g, coalesce((SELECT list({{'g': CAST(g AS BIGINT), 'lo': lo, 'hi': hi}} ORDER BY g) FROM spans WHERE spans.block = b.block), []) AS state FROM blocks b
  UNION ALL
  SELECT block, i, doc_id, g, CASE WHEN g IS NULL THEN state ELSE list_transform(state, lambda x: CASE WHEN x.g = g THEN {{'g': x.g, 'lo': least(x.lo, s), 'hi': greatest(x.hi, s)}} ELSE x END) END
  FROM (SELECT *, CASE WHEN len(hits) = 1 THEN hits[1].g END AS g FROM (SELECT w.block, l.i, l.doc_id, l.s, w.state, list_filter(w.state, lambda x: abs(x.lo - l.s) <= {TOLERANCE} AND abs(x.hi - l.s) <= {TOLERANCE}) AS hits FROM walk w JOIN loose l ON l.block = w.block AND l.i = w.i + 1))
),
rest AS (SELECT l.block, l.doc_id, l.s, sum(CASE WHEN l.s - prev <= {TOLERANCE} THEN 0 ELSE 1 END) OVER (PARTITION BY l.block ORDER BY l.s, l.doc_id ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT l.*, lag(l.s) OVER (PARTITION BY l.block ORDER BY l.s, l.doc_id) AS prev FROM loose l JOIN walk w ON w.doc_id = l.doc_id AND w.g IS NULL) l),
every AS (SELECT block, doc_id, 'f' || CAST(g AS VARCHAR) AS g FROM fine UNION ALL SELECT block, doc_id, 'f' || CAST(g AS VARCHAR) FROM walk WHERE g IS NOT NULL AND doc_id IS NOT NULL UNION ALL SELECT block, doc_id, 'r' || CAST(g AS VARCHAR) FROM rest),
sized AS (SELECT doc_id, count(*) OVER w AS files, min(doc_id) OVER w AS first_id FROM every WINDOW w AS (PARTITION BY block, g))
SELECT doc_id, files, first_id FROM sized WHERE files >= 2"""


@query(MIXED_SQL)
def mixed_time_clusters(spark, sf_dir):
    """Time groups with tolerance over files of which some have times with fractions and some whole seconds; blocks are families within a directory."""
    f = X.files(spark, sf_dir).withColumn("block", F.concat(N.family("ext"), N.dirname("path")))
    timed = dedupe.time_groups(f, dedupe.ScanOptions(tolerance_sec=TOLERANCE, match_without_time=False))
    w = Window.partitionBy("time_group")
    return timed.select("doc_id", F.count("*").over(w).alias("files"), F.min("doc_id").over(w).alias("first_id"))


#: Fingerprints by path in each bucket: each joins the first group all of whose members are near.
NEAR = 22
FIRST_FIT_SQL = f"""WITH RECURSIVE b AS (SELECT vec_id, CAST(bits AS UBIGINT) AS bits, vec_id % 97 AS bucket FROM ({X.BITS_SQL})), o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY vec_id) AS i FROM b),
walk AS (
  SELECT bucket, i, vec_id, CAST(0 AS BIGINT) AS g, [[bits]] AS groups FROM o WHERE i = 1
  UNION ALL
  SELECT bucket, i, vec_id, coalesce(k, len(groups) + 1) - 1 AS g, CASE WHEN k IS NULL THEN list_append(groups, [bits]) ELSE list_transform(groups, lambda x, j: CASE WHEN j = k THEN list_append(x, bits) ELSE x END) END
  FROM (SELECT o.bucket, o.i, o.vec_id, o.bits, w.groups, list_filter(range(1, len(w.groups) + 1), lambda k: len(list_filter(w.groups[k], lambda m: bit_count(xor(m, o.bits)) > {NEAR})) = 0)[1] AS k FROM walk w JOIN o ON o.bucket = w.bucket AND o.i = w.i + 1)
),
s AS (SELECT *, count(*) OVER (PARTITION BY bucket, g) AS n, min(vec_id) OVER (PARTITION BY bucket, g) AS first_id FROM walk) SELECT vec_id, bucket, first_id, n AS files FROM s WHERE n >= 2"""


@query(FIRST_FIT_SQL)
def phash_groups(spark, sf_dir):
    """Groups of near fingerprints in small buckets."""
    b = X.fingerprints(spark, sf_dir).withColumn("bucket", (F.col("vec_id") % 97).cast("bigint"))
    w = Window.partitionBy("cluster")
    return dedupe.phash_clusters(b, NEAR).select("vec_id", "bucket", F.min("vec_id").over(w).alias("first_id"), F.count("*").over(w).alias("files"))


@query(f"""WITH {FILES}, k AS (SELECT *, {FAMILY} AS family, count(*) OVER (PARTITION BY size, {FAMILY}) AS alike FROM files WHERE subsec_known OR capture_ms IS NULL), c AS (SELECT *, count(*) OVER (PARTITION BY size, family, capture_ms) AS timed FROM k WHERE alike >= 2),
h AS (SELECT *, count(*) OVER (PARTITION BY size, family, capture_ms, hash) AS same FROM c WHERE timed >= 2)
SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM c) AS meta_files, CAST((SELECT coalesce(sum(octet_length(encode(path))), 0) FROM c) AS BIGINT) AS meta_bytes, (SELECT count(*) FROM h) AS hash_files, CAST((SELECT coalesce(sum(size), 0) FROM h) AS BIGINT) AS hash_bytes,
  CAST(0 AS BIGINT) AS printed_files, CAST(0 AS BIGINT) AS camera_pairs_skipped, (SELECT count(*) FROM (SELECT DISTINCT size, family, capture_ms, hash FROM h WHERE same >= 2)) AS groups,
  (SELECT count(*) FROM h WHERE same >= 2) - (SELECT count(*) FROM (SELECT DISTINCT size, family, capture_ms, hash FROM h WHERE same >= 2)) AS deletable_files,
  CAST((SELECT coalesce(sum(w), 0) FROM (SELECT (count(*) - 1) * size AS w FROM h WHERE same >= 2 GROUP BY size, family, capture_ms, hash)) AS BIGINT) AS wasted_bytes""")
def scan_counters(spark, sf_dir):
    """What a run counts on its way: times and hashes come from readers here, so that their stages have something to count."""
    media = X.files(spark, sf_dir).filter("subsec_known or capture_ms is null")
    bare = media.withColumnRenamed("capture_ms", "_ms").withColumnRenamed("hash", "_hash").drop("subsec_known")
    reader = lambda source, ext: F.struct(F.col("_ms").alias("capture_ms"), F.lit(True).alias("subsec_known"), F.lit("exif").alias("source"), F.octet_length(source).cast("bigint").alias("bytes_read"))
    stages = Stages(spark)
    dedupe.scan(bare, dedupe.ScanOptions(name_mode="ignore"), reader=reader, hasher=lambda source: F.col("_hash"), stages=stages)
    counted = dedupe.run_counters(stages)
    stages.close()
    return counted
