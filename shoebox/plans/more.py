"""Further named queries: edits and look-ups of the library, times and names, people, deletion plans, and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, names, times, vectors
from ..operators import dedupe, library, people, plan
from ..sources import files as sources
from . import fixtures as X
from .registry import EVENTS, EXACT, FILES, GROUPED, KEEP, KEY, PHOTOS, grouped, query

NUMBER = "CAST(substr(path, 5) AS BIGINT)"


# The library: edits and look-ups.


@query(f"WITH {PHOTOS} SELECT path, CASE WHEN path = 'IMG_7' THEN 5 WHEN path = 'IMG_33' THEN 0 ELSE rating END AS rating FROM photos")
def set_rating(spark, sf_dir):
    return library.rated(library.rated(X.photos(spark, sf_dir), "IMG_7", 4.5), "IMG_33", -2).select("path", F.col("rating").cast("int").alias("rating"))


@query(f"WITH {PHOTOS} SELECT path FROM photos WHERE {NUMBER} % 10 <> 0")
def remove_photos(spark, sf_dir):
    p = X.photos(spark, sf_dir)
    return library.removed(p, p.filter(f"{NUMBER} % 10 = 0").select(F.lower("path").alias("path"))).select("path")


@query(f"WITH {PHOTOS} SELECT path, CASE WHEN path = 'IMG_5' THEN 1 ELSE recognized END AS recognized FROM photos")
def mark_recognized(spark, sf_dir):
    return library.marked_recognized(X.photos(spark, sf_dir), "IMG_5").select("path", "recognized")


@query(f"WITH {EVENTS} SELECT event_id AS id, CASE WHEN user_id = 7 THEN 'Zed' ELSE 'P' || CAST(user_id AS VARCHAR) END AS name FROM shots WHERE event_type = 'click'")
def rename_person(spark, sf_dir):
    return people.renamed(X.marks(spark, sf_dir), 7, "  Zed ").faces.select("id", "name")


@query("SELECT CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'first' ELSE n_name END AS key, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN '{\"a\": 1}' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation")
def put_meta(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation")
    meta = n.select(F.when(F.col("n_name") == n.agg(F.min("n_name")).first()[0], "first").otherwise(F.col("n_name")).alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return library.put_meta(meta, "first", {"a": 1})


@query(f"WITH {FILES} SELECT doc_id FROM files WHERE NOT (doc_id % 9 = 4 AND (starts_with(path, '/src1/') OR starts_with(path, '/src2/')))")
def forget_missing(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return library.forgotten(f, f.filter("doc_id % 9 <> 4").select(F.upper("path").alias("path")), ["/SRC1", "/src2/"]).select("doc_id")


@query(f"WITH {PHOTOS} SELECT path FROM photos WHERE path IN ('IMG_1', 'IMG_2', 'IMG_3')")
def present_paths(spark, sf_dir):
    return library.present(X.photos(spark, sf_dir), ["img_1", "IMG_2", "Img_3", "img_none"])


@query(f"WITH {PHOTOS} SELECT path, size, rating, kind FROM photos WHERE path = 'IMG_5'")
def photo_lookup(spark, sf_dir):
    return library.photo(X.photos(spark, sf_dir), "IMG_5").select("path", "size", "rating", "kind")


@query(f"WITH {EVENTS} SELECT event_id AS id, 'P3' AS name FROM shots WHERE event_type = 'click' AND user_id = 3")
def photo_faces(spark, sf_dir):
    faces = X.marks(spark, sf_dir).faces.withColumn("path", F.concat(F.lit("U"), F.col("person_id").cast("string")))
    return library.photo_faces(faces, "U3")


@query(f"WITH {PHOTOS} SELECT count(*) AS total, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos, CAST(sum(size) FILTER (kind = 'photo') AS BIGINT) AS photo_bytes, CAST(sum(size) FILTER (kind = 'video') AS BIGINT) AS video_bytes, '{{\"added\": 3}}' AS summary FROM photos")
def library_state(spark, sf_dir):
    meta = spark.createDataFrame([("summary", '{"added": 3}'), ("other", "x")], library.META)
    return library.state(X.photos(spark, sf_dir), meta)


@query(f"WITH {PHOTOS} SELECT count(*) FILTER (kind = 'video') AS videos, count(*) AS every FROM photos")
def library_count(spark, sf_dir):
    p = X.photos(spark, sf_dir)
    return spark.range(1).select(F.lit(library.count(p, "video")).cast("bigint").alias("videos"), F.lit(library.count(p)).cast("bigint").alias("every"))


@query(f"WITH {EVENTS}, c AS (SELECT user_id AS id, count(*) AS count FROM shots GROUP BY user_id) SELECT id, CASE WHEN id % 3 = 0 THEN '人物 ' || CAST(row_number() OVER (PARTITION BY id % 3 = 0 ORDER BY count DESC, id) AS VARCHAR) ELSE 'P' || CAST(id AS VARCHAR) END AS title FROM c")
def person_titles(spark, sf_dir):
    c = X.events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("count"))
    return library.titles(c.withColumn("name", F.when(F.expr("id % 3 = 0"), "").otherwise(F.concat(F.lit("P"), F.col("id").cast("string")))))


@query(f"WITH {PHOTOS} SELECT path, CASE WHEN {NUMBER} % 6 IN (0, 2, 3, 4) THEN 1 ELSE 0 END AS recognized FROM photos")
def recognized_backfill(spark, sf_dir):
    p = X.photos(spark, sf_dir)
    return library.backfilled(p, p.filter(f"{NUMBER} % 2 = 0").select("path"), p.filter(f"{NUMBER} % 3 = 0").select("path")).select("path", "recognized")


@query(f"WITH {PHOTOS} SELECT path FROM photos ORDER BY capture_ms DESC, lower(path), path LIMIT 5000")
def cast_playlist(spark, sf_dir):
    return library.playlist(X.photos(spark, sf_dir))


@query(f"WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped), l AS (SELECT *, count(*) OVER (PARTITION BY size, hash) AS k FROM r WHERE doc_id % 7 <> 3) SELECT (SELECT count(*) FROM files WHERE doc_id % 7 <> 3) AS files, (SELECT count(*) FROM l WHERE k >= 2) AS left_in_groups")
def sync_deleted(spark, sf_dir):
    key = F.concat("path", F.lit("#"), F.col("doc_id").cast("string"))
    f = X.files(spark, sf_dir).withColumn("path", key)
    g = dedupe.with_roles(grouped(spark, sf_dir)).withColumn("path", key).withColumn("path_key", F.lower("path")).withColumn("ord", F.col("doc_id"))
    kept, groups = library.sync_deleted(f, g, f.filter("doc_id % 7 = 3").select("path"))
    return kept.agg(F.count("*").alias("files")).join(groups.agg(F.count("*").alias("left_in_groups")))


# Groups of duplicates.


@query(f"WITH {GROUPED}, g AS (SELECT size, hash, min(doc_id) AS first_id, count(*) AS files FROM grouped GROUP BY size, hash HAVING bool_and(ext <> '.mp4')) SELECT first_id, files FROM g")
def visible_groups(spark, sf_dir):
    g = dedupe.with_totals(dedupe.with_roles(grouped(spark, sf_dir))).withColumn("kind", F.lit("exact"))
    seen = plan.visible(dedupe.nested(g), "exact", "photo")
    return seen.select(F.array_min(F.transform("files", lambda f: f["doc_id"])).alias("first_id"), F.size("files").cast("bigint").alias("files"))


@query(f"WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped) SELECT count(DISTINCT (size, hash)) AS groups, count(*) FILTER (rk > 1) AS files, CAST(coalesce(sum(size) FILTER (rk > 1), 0) AS BIGINT) AS bytes FROM r WHERE size % 3 <> 0")
def enabled_totals(spark, sf_dir):
    return plan.enabled_totals(dedupe.with_roles(grouped(spark, sf_dir)).withColumn("enabled", F.expr("size % 3 <> 0")))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN user_id = 7 THEN true ELSE value > 50 END AS enabled FROM shots")
def enable_group(spark, sf_dir):
    g = X.events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("group_id"), (F.col("value") > 50).alias("enabled"))
    return plan.with_enabled(g, True, "7").select("event_id", "enabled")


@query(f"""WITH {FILES}, k AS (SELECT *, CASE lower(ext) WHEN '.jpeg' THEN '.jpg' ELSE lower(ext) END AS family FROM files WHERE subsec_known OR capture_ms IS NULL), n AS (SELECT *, count(*) OVER (PARTITION BY size, family, capture_ms, hash) AS n FROM k)
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY size, family, capture_ms, hash {KEEP}) = 1 THEN 'keep' ELSE 'delete' END AS role, CAST((n - 1) * size AS BIGINT) AS wasted FROM n WHERE n >= 2""")
def exact_scan(spark, sf_dir):
    """The whole funnel without tolerance over files whose time has fractions, or none."""
    media = X.files(spark, sf_dir).filter("subsec_known or capture_ms is null")
    return dedupe.scan(media, dedupe.ScanOptions(name_mode="ignore")).select("doc_id", "role", "wasted")


@query(f"""WITH {FILES}, k AS (SELECT *, CASE lower(ext) WHEN '.jpeg' THEN '.jpg' ELSE lower(ext) END AS family FROM files WHERE subsec_known AND capture_ms IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN capture_ms - prev <= 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY size, family ORDER BY capture_ms, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(capture_ms) OVER (PARTITION BY size, family ORDER BY capture_ms, doc_id) AS prev FROM k)),
n AS (SELECT *, count(*) OVER (PARTITION BY size, family, island) AS files FROM i) SELECT doc_id, files FROM n WHERE files >= 2""")
def time_clusters(spark, sf_dir):
    from pyspark.sql import Window

    blocked = dedupe.pregroup(X.files(spark, sf_dir).filter("subsec_known and capture_ms is not null"), "ignore")
    timed = dedupe.time_groups(blocked, dedupe.ScanOptions(tolerance_sec=5))
    return timed.select("doc_id", F.count("*").over(Window.partitionBy("time_group")).alias("files"))


@query(f"""WITH {FILES}, k AS (SELECT *, count(*) OVER (PARTITION BY size, CASE lower(ext) WHEN '.jpeg' THEN '.jpg' ELSE lower(ext) END) AS files FROM files WHERE capture_ms IS NULL) SELECT doc_id, files FROM k WHERE files >= 2""")
def missing_time_groups(spark, sf_dir):
    from pyspark.sql import Window

    timed = dedupe.time_groups(dedupe.pregroup(X.files(spark, sf_dir).filter("capture_ms is null"), "ignore"))
    return timed.select("doc_id", F.count("*").over(Window.partitionBy("time_group")).alias("files"))


@query(f"""WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped) SELECT doc_id, CASE WHEN doc_id % 5 = 2 AND doc_id % 2 = 1 THEN '文件内容已变化，未删除' END AS reason FROM r WHERE rk > 1""")
def deletion_of_moved(spark, sf_dir):
    """Files whose time moved are read anew, and stay if their content is another one."""
    key = F.concat("path", F.lit("#"), F.col("doc_id").cast("string"))
    f = X.files(spark, sf_dir).withColumn("path", key).withColumn("path_key", F.lower("path"))
    roles = dedupe.with_roles(grouped(spark, sf_dir)).withColumn("path", key).withColumn("path_key", F.lower("path")).withColumn("kind", F.lit("exact"))
    now = f.select("path_key", "size", (F.col("mtime_ms") + F.when(F.expr("doc_id % 5 = 2"), 60_000).otherwise(1)).alias("mtime_ms"))
    number = lambda p: F.element_at(F.split(p, "#"), -1).cast("bigint")
    # the content that is read stands in the path here: the hash known for even ids, another one for odd ids
    roles = roles.withColumn("path", F.concat("hash", F.lit("#"), F.col("doc_id").cast("string")))
    out = plan.deletions(roles, now, rehash=lambda p: F.when(number(p) % 2 == 1, F.lit("other")).otherwise(F.element_at(F.split(p, "#"), 1)))
    return out.select(number("path").alias("doc_id"), "reason")


@query(f"WITH {GROUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY size, hash {KEEP}) AS rk FROM grouped) SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed_bytes FROM r WHERE rk > 1")
def freed_bytes(spark, sf_dir):
    key = F.concat("path", F.lit("#"), F.col("doc_id").cast("string"))
    f = X.files(spark, sf_dir).withColumn("path_key", F.lower(key))
    roles = dedupe.with_roles(grouped(spark, sf_dir)).withColumn("path_key", F.lower(key)).withColumn("kind", F.lit("exact"))
    return plan.freed_bytes(plan.deletions(roles, f.select("path_key", "size", "mtime_ms")))


@query(f"WITH {FILES}, k AS (SELECT doc_id, lower(ext) AS e, regexp_replace(path, '/[^/]*$', '') AS d, {EXACT} AS s, path FROM files) SELECT a.doc_id, count(b.path) AS pairs FROM k a LEFT JOIN k b ON a.d = b.d AND a.s = b.s AND a.path <> b.path AND (a.e = '.cr2' AND b.e IN ('.jpg', '.jpeg') OR a.e = '.jpg' AND b.e IN ('.jpeg', '.cr2') OR a.e = '.jpeg' AND b.e IN ('.jpg', '.cr2')) GROUP BY a.doc_id")
def camera_pair_paths(spark, sf_dir):
    f = X.files(spark, sf_dir)
    pairs = sources.camera_pairs(f.select("path"), f.select("path"))
    return f.select("doc_id", "path").join(pairs, "path").select("doc_id", F.size("pairs").cast("bigint").alias("pairs"))


@query("SELECT page_id, page_id % 4 = 1 AS program, page_id % 4 = 2 AS asset, page_id % 3 = 0 AS below FROM pages")
def program_files(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages")
    name = F.expr("element_at(array('a.jpg', 'Setup.EXE', 'Textures', 'package.jso'), CAST(page_id % 4 + 1 AS INT))")
    folder = F.expr("element_at(array('D:/a/b', 'D:/a', '/a/b/c'), CAST(page_id % 3 + 1 AS INT))")
    return p.select("page_id", sources.is_program(name).alias("program"), sources.is_bundled_asset(name).alias("asset"), sources.below_first_level(folder).alias("below"))


# People.

NEAR = "p AS (SELECT vec_id AS pid, embedding AS pe FROM embeddings WHERE label = 1), s AS (SELECT vec_id, pid, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(pe AS DOUBLE[])) AS c FROM embeddings, p)"


@query(f"WITH {NEAR} SELECT e.vec_id AS face_id, coalesce('L' || CAST(arg_max(pid, c) FILTER (c >= 0.32) AS VARCHAR), '') AS name FROM embeddings e LEFT JOIN s USING (vec_id) GROUP BY e.vec_id")
def best_name(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    named = e.withColumn("name", F.when(F.col("label") == 1, F.concat(F.lit("L"), F.col("id").cast("string"))).otherwise(""))
    return people.best_name(e, named)


@query("WITH t AS (SELECT embedding AS te FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id AS id, 'Zoe' AS name FROM embeddings, t WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(te AS DOUBLE[])) >= 0.32")
def faces_to_rename(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return people.faces_to_rename(e, e.agg(F.min("id")).first()[0], " Zoe ")


@query(f"""WITH {EVENTS}, c AS (SELECT a.path, b.user_id, count(*) AS n FROM shots a JOIN shots b ON a.event_type = 'error' AND b.event_type <> 'error' AND abs(a.capture_ms - b.capture_ms) <= 600000 GROUP BY a.path, b.user_id),
f AS (SELECT a.path, count(*) AS faceless FROM shots a JOIN shots b ON a.event_type = 'error' AND b.event_type = 'error' AND abs(a.capture_ms - b.capture_ms) <= 600000 GROUP BY a.path),
t AS (SELECT path, arg_max(user_id, n) AS person_id, max(n) AS top, sum(n) AS total, count(*) AS persons FROM c GROUP BY path),
b AS (SELECT path, person_id FROM t JOIN f USING (path) WHERE top >= faceless AND (persons = 1 OR top >= 2 AND top / total >= 0.8))
SELECT path, user_id AS person_id FROM shots WHERE event_type = 'click' AND value > 20 UNION SELECT path, person_id FROM b""")
def relink_back_views(spark, sf_dir):
    m = X.marks(spark, sf_dir)
    m.appearances = X.events(spark, sf_dir).filter("value > 20").select("path", F.col("user_id").alias("person_id"))
    return people.relinked(X.shots(spark, sf_dir), m, 600_000)


@query(f"WITH {EVENTS}, l AS (SELECT path, CASE WHEN event_type = 'click' OR user_id % 2 = 0 THEN 'person' ELSE 'landscape' END AS label FROM shots UNION SELECT path, 'animal' FROM shots WHERE user_id % 5 = 0) SELECT path, label FROM l")
def recognized_labels(spark, sf_dir):
    """A face makes a person, and where a person is there is no landscape; what is no label is left out."""
    face = F.array(F.struct(F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(1.0).alias("area")))
    some = F.when(F.col("event_type") == "click", face).otherwise(F.slice(face, 1, 0))
    labels = F.concat(F.array(F.lit("landscape"), F.lit("tree")), F.expr("if(user_id % 2 = 0, array('person'), array())").cast("array<string>"), F.expr("if(user_id % 5 = 0, array('animal'), array())").cast("array<string>"))
    return people.recognized_labels(X.events(spark, sf_dir).select("path", some.alias("faces"), labels.alias("labels")))


@query(f"""WITH {EVENTS}, n AS (SELECT count(*) FILTER (event_type = 'click') AS faces, count(DISTINCT user_id) AS people FROM shots)
SELECT model, again, CASE WHEN kept THEN faces ELSE 0 END AS faces, CASE WHEN kept THEN people ELSE 0 END AS people FROM n, (VALUES ('same', false, true), ('other', true, false), ('older', true, true), ('none', true, false)) v(model, again, kept)""")
def prepared_recognition(spark, sf_dir):
    """Faces of another model are not kept, and people of another version are found anew."""
    out = None
    for name, model, version in (("same", library.FACE_MODEL, library.CLUSTER_VERSION), ("other", "another model", library.CLUSTER_VERSION), ("older", library.FACE_MODEL, "3"), ("none", None, None)):
        m, again = people.prepared(X.marks(spark, sf_dir), model, version)
        counts = m.faces.agg(F.count("*").alias("faces")).crossJoin(m.people.agg(F.count("*").alias("people")))
        row = counts.select(F.lit(name).alias("model"), F.lit(again).alias("again"), "faces", "people")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {EVENTS} SELECT user_id AS person_id, count(*) FILTER (event_type = 'click') AS count FROM shots WHERE user_id IN (7, 8) GROUP BY user_id")
def renamed_counts(spark, sf_dir):
    """How many faces a new name reaches, for a person and for the person of a face; nothing for a person who is not there."""
    m = X.marks(spark, sf_dir)
    face = m.faces.filter("person_id = 8").agg(F.min("id").alias("id")).first()["id"]
    return people.renamed_count(m, 7).unionByName(people.renamed_face(m, face, "Zed")[1]).unionByName(people.renamed_count(m, -1))


#: Vectors by id as photos with one face: every 50th is a known person, each other one joins the nearest of those and of the new ones before, the last of equals, or becomes a new person.
SAVED = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings WHERE vec_id % 50 <> 0),
known AS (SELECT list({'id': vec_id + 1, 'v': CAST(embedding AS DOUBLE[])} ORDER BY vec_id) AS people, max(vec_id) + 1 AS top FROM embeddings WHERE vec_id % 50 = 0),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS person, people, CAST(top AS BIGINT) AS top FROM known
  UNION ALL
  SELECT i, vec_id, coalesce(hit, top + 1), CASE WHEN hit IS NULL THEN list_append(people, {'id': top + 1, 'v': v}) ELSE people END, CASE WHEN hit IS NULL THEN top + 1 ELSE top END
  FROM (SELECT e.i, e.vec_id, e.v, w.people, w.top, list_sort([{'s': list_cosine_similarity(p.v, e.v), 'id': p.id} FOR p IN w.people IF list_cosine_similarity(p.v, e.v) >= 0.32], 'DESC')[1].id AS hit FROM walk w JOIN e ON e.i = w.i + 1)
) SELECT 'v' || CAST(vec_id AS VARCHAR) AS path, person AS person_id, CASE WHEN person <= (SELECT top FROM known) THEN 'N' || CAST(person AS VARCHAR) ELSE '' END AS name FROM walk WHERE i > 0"""


@query(SAVED)
def saved_recognition(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    known = e.filter("vec_id % 50 = 0").select((F.col("vec_id") + 1).alias("id"), F.concat(F.lit("N"), (F.col("vec_id") + 1).cast("string")).alias("name"), F.col("embedding").alias("exemplar"))
    photo = F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path")
    face = F.array(F.struct("embedding", F.lit(1.0).alias("area"))).alias("faces")
    items = e.filter("vec_id % 50 <> 0").select(F.col("vec_id").alias("seq"), photo, face, F.array(F.lit("landscape")).alias("labels"))
    empty = lambda schema: spark.createDataFrame([], schema)
    m = library.Marks(empty(library.FACES), empty(library.LABELS_TABLE), empty(library.APPEARANCES), known)
    saved = people.save_recognition(items, m, e.select(photo))
    return saved.faces.join(saved.appearances, ["path", "person_id"]).join(saved.labels.filter("label = 'person'").select("path"), "path").select("path", "person_id", "name")


# Functions.


@query("SELECT p_partkey, CAST(bit_count(xor(p_partkey, CAST(p_size * 77 AS BIGINT))) AS INT) AS bits, CASE WHEN p_size % 2 = 0 THEN CAST(bit_count(xor(p_partkey, CAST(p_size AS BIGINT))) AS INT) END AS some FROM part")
def hamming_hex(spark, sf_dir):
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    bits = vectors.hamming(digits(F.col("p_partkey")), digits(F.col("p_size").cast("bigint") * 77)).cast("int")
    short = F.when(F.expr("p_size % 2 = 0"), digits(F.col("p_size").cast("bigint"))).otherwise("zz")
    return X.table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits"), vectors.hamming(digits(F.col("p_partkey")), short).cast("int").alias("some"))


DAY_MS = "CAST(epoch_us(date_trunc('day', o_orderdate)) // 1000 + 45000000 AS BIGINT)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {DAY_MS} + 500 WHEN o_orderkey % 4 = 1 THEN {DAY_MS} + 1000 WHEN o_orderkey % 4 = 2 THEN {DAY_MS} + 2000 END AS capture_ms, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 = 0 END AS subsec_known FROM orders")
def exif_choice(spark, sf_dir):
    """The original time counts, then the digitised one, then the last change; the first that is there, even if it cannot be read."""
    at = lambda s: F.concat(F.date_format("o_orderdate", "yyyy:MM:dd "), F.lit(f"12:30:0{s}"))
    k = F.col("o_orderkey") % 4
    original = F.when(k == 0, at(0)).when(k == 3, "broken").otherwise("")
    c = times.choose_exif(original, F.when((k == 1) | (k == 3), at(1)).otherwise(""), at(2), F.lit("5"), F.lit(""), F.lit(""))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", c["capture_ms"].alias("capture_ms"), c["subsec_known"].alias("subsec_known"))


@query(f"SELECT o_orderkey, {DAY_MS} + 250 AS iso_ms, {DAY_MS} AS xmp_ms FROM orders")
def iso_and_xmp_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    iso = times.iso_date(F.concat(day, F.lit("T12:30:00.25+09:00")))
    xmp = times.xmp_date(F.concat(F.lit("<x xmp:CreateDate=\"1999-01-01T00:00:00\" exif:DateTimeOriginal=\""), day, F.lit("T12:30:00Z\"/>")))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", iso["capture_ms"].alias("iso_ms"), xmp["capture_ms"].alias("xmp_ms"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'a.jpg' ELSE 'x' END AS text, round(sqrt(list_sum([x * x FOR x IN [CAST(p_size AS DOUBLE), 2.0]])), 6) AS norm FROM part")
def vector_blobs(spark, sf_dir):
    """Vectors to bytes and back."""
    v = vectors.from_blob(vectors.to_blob(F.array(F.col("p_size").cast("float"), F.lit(2.0).cast("float"))))
    return X.table(spark, sf_dir, "part").select("p_partkey", F.when(F.expr("p_size % 5 = 0"), "a.jpg").otherwise("x").alias("text"), F.round(F.sqrt(vectors.dot(v, v)), 6).alias("norm"))


@query("WITH s AS (SELECT p_partkey, p_size, greatest(0, 2 - abs(p_size % 7 / 2)) * greatest(0, 4 - abs(p_size % 3)) AS inter FROM part) SELECT p_partkey, round(CASE WHEN inter > 0 THEN inter / (16 - inter) ELSE 0 END, 6) AS iou FROM s")
def box_overlap(spark, sf_dir):
    box = lambda x, y: F.struct(x.alias("cx"), y.alias("cy"), F.lit(2.0).alias("w"), F.lit(4.0).alias("h"))
    moved = box(F.expr("CAST(p_size % 7 / 2 AS DOUBLE)"), F.expr("CAST(p_size % 3 AS DOUBLE)"))
    return X.table(spark, sf_dir, "part").select("p_partkey", F.round(vectors.box_iou(box(F.lit(0.0), F.lit(0.0)), moved), 6).alias("iou"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS shown, strftime(o_orderdate, '%Y-%m-%d') || ' 10:11:12' AS pretty FROM orders")
def shown_times(spark, sf_dir):
    ms = F.when(F.expr("o_orderkey % 5 = 0"), 0).otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    text = F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 10:11:12 "))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", times.format_when(ms, "UTC").alias("shown"), times.pretty_time(F.trim(text)).alias("pretty"))


@query(f"WITH {FILES}, h AS (SELECT * REPLACE ('shot_' || substr(hash, 1, 4) || CASE doc_id // 2 % 3 WHEN 1 THEN ' (1)' WHEN 2 THEN ' - Copy' ELSE '' END || ext AS name) FROM files), k AS (SELECT doc_id, count(*) OVER (PARTITION BY size, CASE lower(ext) WHEN '.jpeg' THEN '.jpg' ELSE lower(ext) END, {KEY}) AS n FROM h) SELECT doc_id FROM k WHERE n >= 2")
def duplicate_candidates(spark, sf_dir):
    """Names here come from the content, with a copy's suffix on some: copies of one family meet whatever their suffix."""
    name = F.concat(F.lit("shot_"), F.substring("hash", 1, 4), F.expr("CASE doc_id div 2 % 3 WHEN 1 THEN ' (1)' WHEN 2 THEN ' - Copy' ELSE '' END"), F.col("ext"))
    return dedupe.pregroup(X.files(spark, sf_dir).withColumn("name", name)).select("doc_id")


@query(f"WITH {FILES} SELECT doc_id, {EXACT} AS exact, {EXACT} <> {KEY} AS copied FROM files")
def copy_names(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", names.exact_key("name").alias("exact"), names.is_copy_name("name").alias("copied"))


@query("""WITH RECURSIVE o AS (SELECT label, vec_id, CAST(vec_id % 17 AS DOUBLE) AS area, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id % 17 DESC, vec_id) AS k FROM embeddings),
r AS (SELECT label, vec_id, area, k, [e] AS kept, true AS took FROM o WHERE k = 1
UNION ALL SELECT o.label, o.vec_id, o.area, o.k, CASE WHEN len([x FOR x IN r.kept IF list_cosine_similarity(x, o.e) >= 0.32]) = 0 THEN list_append(r.kept, o.e) ELSE r.kept END,
len([x FOR x IN r.kept IF list_cosine_similarity(x, o.e) >= 0.32]) = 0 FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)
SELECT CAST(label AS VARCHAR) AS path, area, vec_id AS ord FROM r WHERE took""")
def main_subjects(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("path"), "embedding", (F.col("vec_id") % 17).cast("double").alias("area"), F.col("vec_id").alias("ord"))
    return people.main_subjects(e).select("path", "area", "ord")


@query(f"WITH {EVENTS} SELECT event_id, count(*) OVER (ORDER BY capture_ms RANGE BETWEEN 600000 PRECEDING AND 600000 FOLLOWING) AS around FROM shots")
def time_window_density(spark, sf_dir):
    e = X.events(spark, sf_dir).select("event_id", "capture_ms")
    return people.counts_within(e, e.select(F.col("capture_ms").alias("other_ms")), "capture_ms", "other_ms", 600_000).select("event_id", "around")


FORMATS = {
    "bytes_decimal": (lambda: formats.bytes_decimal(F.floor("o_totalprice") * 37, even=True), "CASE WHEN n >= 1e9 THEN printf('%.2f GB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1f MB', n / 1e6) END"),
    "trimmed": (lambda: formats.trim_num((F.col("o_orderkey") % 50).cast("double") / 10), "CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey % 50 // 10 AS VARCHAR) ELSE printf('%.1f', o_orderkey % 50 / 10) END"),
}


@query(f"WITH q AS (SELECT *, floor(o_totalprice) * 37 AS n FROM orders WHERE floor(o_totalprice) * 37 >= 1e6) SELECT o_orderkey, {', '.join(f'{sql} AS {name}' for name, (_, sql) in FORMATS.items())} FROM q")
def number_formats(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").filter(F.floor("o_totalprice") * 37 >= 1e6)
    return o.select("o_orderkey", *(f().alias(name) for name, (f, _) in FORMATS.items()))
