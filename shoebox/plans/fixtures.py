"""The driver's tables seen as media tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import Marks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents as files. Names repeat and some are copies' names; a file's content is its text.
FILES = """
SELECT doc_id, dir || name AS path, lower(dir || name) AS path_key, name, ext, size, hash, doc_id * 1000 AS mtime_ms, doc_id * 700 AS birthtime_ms, doc_id AS seq,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 97) * 1000 + (doc_id % 3) * 250 END AS capture_ms, doc_id % 3 > 0 AS subsec_known
FROM (
  SELECT *, '/' || source || '/' || lang || '/' || CAST(doc_id {div} 800 AS {text}) || '/' AS dir, 'shot_' || CAST(doc_id {div} 2 % 400 AS {text}) || CASE doc_id {div} 2 % 5 WHEN 1 THEN ' (1)' WHEN 2 THEN ' - Copy' ELSE '' END || ext AS name
  FROM (SELECT doc_id, source, lang, CAST(octet_length({bytes}) AS BIGINT) AS size, md5(text) AS hash,
               CASE WHEN doc_id % 4 = 0 THEN '.cr2' WHEN doc_id % 4 = 1 THEN '.JPEG' WHEN doc_id % 4 = 2 THEN '.jpg' ELSE '.mp4' END AS ext FROM documents) d
) e"""
FILES_SQL = FILES.format(text="VARCHAR", bytes="encode(text)", div="//")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES.format(text="STRING", bytes="text", div="div").replace("FROM documents)", "FROM {docs})"), docs=table(spark, sf_dir, "documents"))


#: Orders as catalogued photos.
PHOTOS = """
SELECT 'IMG_' || CAST(o_orderkey AS {text}) AS path, 'IMG_' || CAST(o_orderkey AS {text}) || '.jpg' AS name, CAST({epoch} AS BIGINT) AS capture_ms, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       CAST(day(o_orderdate) AS INT) AS day, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderstatus = 'F' THEN 'video' ELSE 'photo' END AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS rating,
       CASE WHEN o_orderstatus = 'O' THEN 'camera' WHEN o_orderstatus = 'P' THEN 'phone' ELSE '' END AS origin, o_custkey AS scan_id, 0 AS recognized
FROM orders"""
PHOTOS_SQL = PHOTOS.format(text="VARCHAR", epoch="epoch_us(o_orderdate) // 1000")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PHOTOS.format(text="STRING", epoch="unix_millis(CAST(o_orderdate AS TIMESTAMP))").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


#: Events as shots: the user (from 1) is who is seen, the type a label; errors are shots of a body without a face.
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("capture_ms"), (F.col("user_id") + 1).alias("user_id"), "event_type", "value", "ts")


EVENTS_SQL = "SELECT event_id, 'E' || CAST(event_id AS VARCHAR) AS path, CAST(epoch_us(ts) // 1000 AS BIGINT) AS capture_ms, user_id + 1 AS user_id, event_type, value, ts FROM events"


def marks(spark: SparkSession, sf_dir: str) -> Marks:
    e = events(spark, sf_dir)
    faces = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), "path", F.array().cast("array<float>").alias("embedding"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("name"), F.col("user_id").alias("person_id"))
    appearances = e.filter("event_type = 'view'").select("path", F.col("user_id").alias("person_id"))
    labels = e.select("path", F.when(F.col("event_type") == "error", "person").when(F.col("event_type") == "click", "animal").otherwise("landscape").alias("label"))
    people = e.select(F.col("user_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("P"), F.col("id").cast("string")))
    return Marks(faces, labels, appearances, people)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    body = F.col("event_type") == "error"
    return e.select("path", "capture_ms", F.when(body, F.array().cast("array<bigint>")).otherwise(F.array("user_id")).alias("person_ids"), body.alias("body"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import sign_bits

    return table(spark, sf_dir, "embeddings").select("vec_id", F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("path"), sign_bits("embedding").alias("phash"))


BITS_SQL = "SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (64 - i) ELSE 0 END FOR i IN range(1, 65)]) AS bits FROM embeddings"
