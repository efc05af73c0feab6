import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.operators import dedupe, library, people, plan, search
from shoebox.operators.stages import Stages

FILE = "path string, path_key string, name string, ext string, size bigint, mtime_ms bigint, birthtime_ms bigint, capture_ms bigint, subsec_known boolean, hash string, phash bigint, seq bigint"


def file(seq, path, size=10, ms=None, sub=False, content="h", phash=None, mtime=0, birth=0):
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower()
    return (path, path.lower(), name, ext, size, mtime, birth, ms, sub, content, phash, seq)


def naive_clusters(rows, tol):
    def same(a, b):
        if a[1] and b[1]:
            return abs(a[0] - b[0]) <= tol * 1000
        return abs(a[0] // 1000 - b[0] // 1000) <= int(np.floor(tol + 0.5))

    def chain(items):
        groups = []
        for i in items:
            near = [g for g in groups if any(same(rows[i], rows[j]) for j in g)]
            groups = [g for g in groups if g not in near] + [[j for g in near for j in g] + [i]]
        return groups

    known = [i for i, r in enumerate(rows) if r[0] is not None and r[1]]
    groups, rest = chain(known), []
    groups.sort(key=min)
    for i in (i for i, r in enumerate(rows) if r[0] is not None and not r[1]):
        hits = [g for g in groups if all(same(rows[j], rows[i]) for j in g)]
        if len(hits) == 1:
            hits[0].append(i)
        else:
            rest.append(i)
    return {frozenset(g) for g in groups + chain(rest) if len(g) > 1}


def test_time_clusters_match_a_naive_model():
    r = random.Random(1)
    for _ in range(600):
        rows = [(None if r.random() < 0.1 else r.randrange(0, 9000, 250), r.random() < 0.5) for _ in range(r.randrange(1, 9))]
        tol = r.choice([0, 1, 2])
        df = pd.DataFrame(rows, columns=["capture_ms", "subsec_known"])
        assert {frozenset(g) for g in dedupe.cluster_by_capture(df, tol)} == naive_clusters(rows, tol), (rows, tol)


def test_first_fit_is_complete_linkage():
    assert dedupe.first_fit(["a", "b", "c"], [0b0, 0b11, 0b1111], 2) == [[0, 1]]
    assert dedupe.first_fit(["b", "a"], [-1, -1], 0) == [[1, 0]]


def test_anchored_buckets(spark):
    df = spark.createDataFrame([("a", 0), ("b", 2000), ("c", 4000), ("d", 5000)], "path string, capture_ms bigint")
    got = dedupe.anchored_buckets(df, 2).groupBy("bucket").agg(F.sort_array(F.collect_list("path")).alias("p")).collect()
    assert sorted(r.p for r in got) == [["a", "b"], ["c", "d"]]


def test_near_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 15))) for b in base for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "path bigint, phash bigint")
    for d in (0, 4, 12, 20):
        want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= d}
        assert {(x.a, x.b) for x in dedupe.near_pairs(df, d).collect()} == want


def test_near_pairs_under_crowded_values(spark):
    """Most fingerprints share one half of their bits: pairs are those of brute force, and far fewer are met than share a value."""
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(30)] + [r.getrandbits(32) << 32 | 0xABCD for _ in range(150)] + [0xABCD | r.getrandbits(32)]
    prints += [p ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for p in prints[::2]] + prints[40:43]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "path bigint, phash bigint")
    for d in (0, 3, 6, 14):
        want = {(i, j, n) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (n := (prints[i] ^ prints[j]).bit_count()) <= d}
        assert {tuple(x) for x in dedupe.near_pairs(df, d, crowded=8).collect()} == want
    only = df.select(F.col("phash").alias("p")).distinct()
    met = [left.join(right, ["band", "v", "part", "u"]).count() for left, right in (dedupe.looked_up(only, 3, n) for n in (8, 10**6))]
    assert met[0] * 4 < met[1]


def test_scan_exact_and_similar(spark):
    rows = [
        file(1, "/a/IMG_1.jpg", ms=1000, sub=True, phash=0), file(2, "/b/IMG_1 (1).jpg", ms=1000, sub=True, phash=0), file(3, "/c/IMG_1.jpg", ms=1000, sub=True, content="other", phash=1),
        file(4, "/d/IMG_1.jpg", ms=9000, sub=True, phash=3), file(5, "/e/else.jpg", ms=99000, phash=7), file(6, "/e/v.mp4", size=5, content="v"), file(7, "/f/v.mp4", size=5, content="v"),
        file(8, "/g/X.cr2", size=7, ms=50000, phash=0, content="r"), file(9, "/g/X.jpg", size=8, ms=50000, phash=0, content="s"),
    ]
    media = spark.createDataFrame(rows, FILE)
    exact = dedupe.scan(media)
    groups = {frozenset(r.p) for r in exact.groupBy("group_id").agg(F.collect_set("path").alias("p")).collect()}
    assert groups == {frozenset({"/a/IMG_1.jpg", "/b/IMG_1 (1).jpg"}), frozenset({"/e/v.mp4", "/f/v.mp4"})}
    kept = {r.path for r in exact.filter("role = 'keep'").collect()}
    assert kept == {"/a/IMG_1.jpg", "/e/v.mp4"}
    assert exact.filter("path = '/b/IMG_1 (1).jpg'").first()["origin"] == "copy"
    both = dedupe.scan(media, dedupe.ScanOptions(similar=True))
    joined = both.filter("path = '/c/IMG_1.jpg'").first()
    assert joined.kind == "similar" and joined.distance == 1 and both.filter("path = '/a/IMG_1.jpg'").first()["kind"] == "similar"
    assert both.filter("path like '/g/%'").count() == 0  # a camera's two formats of one shot
    total = dedupe.summary(exact).first()
    assert (total["groups"], total.deletable_files, total.wasted_bytes) == (2, 2, 15)
    assert dedupe.nested(exact).filter("size(files) = 2").count() == 2


def test_missing_times_and_modes(spark):
    rows = [file(1, "/a/x.jpg"), file(2, "/b/x.jpg"), file(3, "/c/y.jpg")]
    media = spark.createDataFrame(rows, FILE)
    assert dedupe.scan(media, dedupe.ScanOptions(match_without_time=False)).count() == 0
    assert dedupe.scan(media).count() == 2 and dedupe.scan(media, dedupe.ScanOptions(name_mode="ignore")).count() == 3
    assert dedupe.scan(media.limit(0)).count() == 0


def test_search_ignores_names(spark):
    files = spark.createDataFrame([file(1, "/a/x.zip", 0), file(2, "/b/y.ZIP", 0), file(3, "/skip/z.zip", 0), file(4, "/b/y.txt", 0)], FILE)
    assert sorted(r.path for r in search.duplicates(files, "*.zip", ["/SKIP"]).collect()) == ["/a/x.zip", "/b/y.ZIP"]


def test_plan_roles_and_report(spark):
    media = spark.createDataFrame([file(1, "/a/x.jpg"), file(2, "/b/x.jpg"), file(3, "/c/x.jpg")], FILE)
    g = dedupe.scan(media).withColumn("ord", F.col("seq"))
    now = media.select("path_key", "size", "mtime_ms")
    assert [r.reason for r in plan.deletions(g, now).collect()] == [None, None]
    assert {r.path: r.reason for r in plan.deletions(g, now.filter("path_key <> '/b/x.jpg'")).collect()}["/b/x.jpg"] == plan.SKIPPED["gone"]
    assert {r.reason for r in plan.deletions(g, now.filter("path_key <> '/a/x.jpg'")).collect()} == {plan.SKIPPED["keep_gone"]}
    gid = g.first()["group_id"]
    swapped = plan.with_role(g, gid, "/B/x.jpg", "keep")
    assert {r.path: r.role for r in swapped.collect()} == {"/a/x.jpg": "delete", "/b/x.jpg": "keep", "/c/x.jpg": "delete"}
    with pytest.raises(plan.RoleError):
        plan.with_role(g, gid, "/a/x.jpg", "spare")
    left = plan.without_paths(g, spark.createDataFrame([("/A/x.jpg",)], "path string"))
    assert {r.path: r.role for r in left.collect()} == {"/b/x.jpg": "keep", "/c/x.jpg": "delete"} and left.first()["wasted"] == 10
    out = io.StringIO()
    plan.write_report(g.withColumn("enabled", F.lit(True)), out)
    text = out.getvalue()
    assert text.startswith("\ufeff\"组\"") and text.count("\r\n") == 4 and "无拍摄时间" in text


def photos(spark, rows):
    return spark.createDataFrame(rows, library.PHOTOS)


def photo(path, size=1, kind="photo", scan=1, rating=0, ms=0, rec=0):
    return (path, path.rsplit("/", 1)[-1], ".jpg", "/p", size, 0, ms, 2020, 1, 2, scan, rating, kind, "", 0, 0, rec)


def test_library_tables(spark):
    old = photos(spark, [photo("/p/a.jpg", rating=4, rec=1), photo("/p/b.jpg"), photo("/q/É.jpg", kind="video")])
    new = photos(spark, [photo("/p/a.jpg", size=9), photo("/p/c.jpg")]).drop("scan_id", "rating", "recognized")
    up = library.upsert(old, new, 2)
    a = up.filter("path = '/p/a.jpg'").first()
    assert (up.count(), a["size"], a.rating, a.recognized, a.scan_id) == (4, 9, 4, 1, 2)
    assert {r.path for r in library.purge(up, 2, "photo").collect()} == {"/p/a.jpg", "/p/c.jpg", "/q/É.jpg"}
    assert library.purge(up, 2, "photo", ["/elsewhere"]).count() == 4
    assert library.rated(old, "/p/b.jpg", 7.2).filter("path = '/p/b.jpg'").first()["rating"] == 5
    gone = library.removed(old, spark.createDataFrame([("/P/A.JPG",), ("/q/é.jpg",)], "path string"))
    assert {r.path for r in gone.collect()} == {"/p/b.jpg", "/q/É.jpg"}
    assert {r.kind: (r["count"], r["size"]) for r in library.kind_totals(old.filter("kind = 'photo'")).collect()} == {"photo": (2, 2), "video": (0, 0)}
    assert library.page(old, 0, -3).count() == 3 and library.page(old, 1).count() == 1
    assert [r.path for r in library.present(old, ["/P/A.jpg", "/x"]).collect()] == ["/p/a.jpg"]
    delta = library.scan_delta(old, library.purge(up, 2, "photo"), 2).first()
    assert (delta.seen, delta.added, delta.removed) == (2, 0, 1)
    s = library.Settings.of('{"excludeDirs": ["C:/A", "c:/a/"], "minEdgePhoto": 241, "minEdgeVideo": 240}')
    assert (s.exclude_dirs, s.min_edge_photo, s.min_edge_video) == (["C:/A"], 0, 240) and library.Settings.of(s.json()) == s and library.Settings.of("x") == library.Settings()
    meta = library.put_meta(library.put_meta(spark.createDataFrame([], library.META), "k", {"a": 1}), "k", "v")
    assert library.get_meta(meta, "k") == "v" and library.get_meta(meta, "no") is None


def test_snapshot_and_old_tables(spark, tmp_path):
    p = photos(spark, [photo("/p/a.jpg")])
    assert library.snapshot(p, str(tmp_path), "photos").endswith(".v1") and library.snapshot(p, str(tmp_path), "photos").endswith(".v2")
    p.drop("rating", "kind").write.parquet(str(tmp_path / "old"))
    row = library.opened(spark, str(tmp_path / "old"), library.PHOTOS).first()
    assert (row.rating, row.kind) == (0, "photo")


def marks(spark):
    faces = spark.createDataFrame([(1, "/p/a.jpg", [1.0, 0.0], "Ann", 1), (2, "/x", [0.0, 1.0], "", 2)], library.FACES)
    return library.Marks(
        faces, spark.createDataFrame([("/p/a.jpg", "person"), ("/x", "animal")], library.LABELS_TABLE), spark.createDataFrame([("/p/b.jpg", 1), ("/x", 2)], library.APPEARANCES),
        spark.createDataFrame([(1, "Ann", [1.0, 0.0]), (2, "", [0.0, 1.0]), (3, "Bob", None)], library.PEOPLE),
    )


def test_orphans_filters_and_names(spark):
    p, m = photos(spark, [photo("/p/a.jpg"), photo("/p/b.jpg")]), marks(spark)
    clean = library.without_orphans(p, m)
    assert clean.faces.count() == 1 and clean.labels.count() == 1 and clean.appearances.count() == 1 and {r.id for r in clean.people.collect()} == {1, 3}
    show = lambda **f: {r.path for r in library.filtered(p, library.Filter(**f), m).collect()}
    assert show(person="Ann") == {"/p/a.jpg", "/p/b.jpg"} and show(label="person") == {"/p/a.jpg"} and show(person_id=2) == set() and show(person_ids=[1, -5]) == {"/p/a.jpg", "/p/b.jpg"} and show(rating=9) == {"/p/a.jpg", "/p/b.jpg"}
    renamed = people.renamed(m, 1, "  " + "x" * 50)
    assert renamed.people.filter("id = 1").first()["name"] == "x" * 40 and renamed.faces.filter("id = 1").first()["name"] == "x" * 40
    assert people.prepared(m, "other", "4")[0].faces.count() == 0 and people.prepared(m, "buffalo_l", "3")[1]


def test_nearest_and_clusters(spark):
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -0.1])], "id bigint, embedding array<float>")
    p = spark.createDataFrame([(7, [1.0, 0.1]), (8, [2.0, 0.2]), (9, None)], "id bigint, embedding array<float>")
    got = {r.face_id: r.person_id for r in people.nearest(f, p).collect()}
    assert got == {1: 8, 2: None}
    assert {r.face_id: r.person_id for r in people.nearest(f, p, sent_bytes=20).collect()} == got  # dealt in blocks
    r = np.random.default_rng(3)
    a, b = r.normal(size=64), r.normal(size=64)
    v = np.stack([a + r.normal(size=64) * 0.1 for _ in range(12)] + [b + r.normal(size=64) * 0.1 for _ in range(9)]).astype(np.float32)
    assert sorted(sorted(g) for g in people.cluster(v)) == [list(range(12)), list(range(12, 21))]
    faces = spark.createDataFrame([(i, f"/{i}", x.tolist(), "Ann" if i < 3 else "") for i, x in enumerate(v)], "id bigint, path string, embedding array<float>, name string")
    out, who = people.rebuild(faces)
    assert out.select("person_id").distinct().count() == 2 and {x.name for x in who.collect()} == {"Ann", ""}
    assert all(abs(sum(c * c for c in x.exemplar) - 1) < 1e-5 for x in who.collect())
    subjects = people.main_subjects(faces.withColumn("path", F.lit("/one")).withColumn("area", F.col("id").cast("double")).withColumn("ord", F.col("id")))
    assert sorted(x.area for x in subjects.collect()) == [11.0, 20.0]


def naive_links(shots, window):
    faced = [s for s in shots if s[2]]
    out = set()
    for path, ms, ids, body in shots:
        if not body or ids:
            continue
        count = {}
        for _, t, who, _ in faced:
            if abs(t - ms) <= window:
                for w in set(who):
                    count[w] = count.get(w, 0) + 1
        if not count:
            continue
        top = max(count.values())
        who = max(k for k, v in count.items() if v == top)
        faceless = sum(1 for s in shots if s[3] and not s[2] and abs(s[1] - ms) <= window)
        if faceless <= top and (len(count) == 1 or top >= 2 and top / sum(count.values()) >= 0.8):
            out.add((path, who))
    return out


def test_back_views_match_a_naive_model(spark):
    r = random.Random(4)
    rows = [(f"{case}/{i}", case * 10**9 + r.randrange(100), [r.randrange(1, 3) for _ in range(r.choice([0, 0, 1, 2]))], r.random() < 0.6) for case in range(60) for i in range(7)]
    df = spark.createDataFrame(rows, "path string, capture_ms bigint, person_ids array<bigint>, body boolean")
    assert {(x.path, x.person_id) for x in people.link_back_views(df, 20).collect()} == naive_links(rows, 20)


def test_recognised_labels(spark):
    items = spark.createDataFrame([("a", [([1.0], 2.0)], ["landscape"]), ("b", [], ["landscape", "odd"])], "path string, faces array<struct<embedding: array<float>, area: double>>, labels array<string>")
    assert {tuple(r) for r in people.recognized_labels(items).collect()} == {("a", "person"), ("b", "landscape")}


def test_recognised_faces(spark):
    items = spark.createDataFrame([("a", [([1.0, 0.0], 9.0), ([0.9, 0.1], 5.0), ([0.0, 1.0], 4.0)], ["person"])], "path string, faces array<struct<embedding: array<float>, area: double>>, labels array<string>")
    faces, labels = people.recognized(items, marks(spark).people.filter("id = 1"))
    assert sorted((r.ord, r.person_id) for r in faces.collect()) == [(0, 1), (2, 0)] and labels.count() == 1
    loose = faces.withColumn("id", F.col("ord"))
    known = marks(spark).people.filter("id = 2").select("id", "name", F.lit(None).cast("array<float>").alias("exemplar"))
    rows = [(5, "z", [1.0, 0.0], None, 0), (6, "z", [0.0, 1.0], "Bo", 0), (7, "z", [0.9, 0.1], "", 0), (8, "z", [1.0, 0.0], "Ann", 1)]
    found, everyone = people.attach_loose(spark.createDataFrame(rows, library.FACES), known)
    assert {r.id: (r.person_id, r.name) for r in found.collect()} == {5: (3, ""), 6: (4, "Bo"), 7: (3, ""), 8: (1, "Ann")}
    assert {r.id: r.name for r in everyone.filter("id > 2").collect()} == {3: "", 4: "Bo"}
    first = marks(spark).people.filter("exemplar is not null")
    assert sorted(r.person_id for r in people.attach_loose(loose.withColumn("name", F.lit("")), first)[0].collect())[0] == 1


def test_counts_within_match_pairs(spark):
    r = np.random.default_rng(5)
    left, right = r.integers(-50, 200, 80).tolist(), r.integers(-50, 200, 120).tolist()
    for w in (0, 7, 1000):
        out = people.counts_within(spark.createDataFrame([(x,) for x in left], "t bigint"), spark.createDataFrame([(x,) for x in right], "u bigint"), "t", "u", w)
        assert sorted((x.t, x.around) for x in out.collect()) == sorted((x, sum(abs(x - y) <= w for y in right)) for x in left)


def test_deletions_read_again(spark):
    media = spark.createDataFrame([file(1, "/a/x.jpg"), file(2, "/b/x.jpg"), file(3, "/c/x.jpg")], FILE)
    g = dedupe.scan(media)
    kept = g.filter("role = 'keep'").first()
    now = media.select("path_key", "size", F.when(F.col("path") == "/c/x.jpg", F.col("mtime_ms") + 9).otherwise(F.col("mtime_ms")).alias("mtime_ms"))
    reasons = lambda **o: {r.path: r.reason for r in plan.deletions(g, now, **o).collect()}
    assert reasons() == {"/b/x.jpg": None, "/c/x.jpg": plan.SKIPPED["content"]}  # a moved file that nothing can read anew stays
    assert reasons(rehash=lambda p: F.lit("other")) == reasons() and reasons(rehash=lambda p: F.lit(kept["hash"]))["/c/x.jpg"] is None
    alike = g.withColumn("kind", F.lit("similar")).withColumn("hash", F.when(F.col("role") == "keep", F.col("hash")).otherwise(F.lit("differs")))
    same = media.select("path_key", "size", "mtime_ms")
    prints = lambda p: F.when(F.col(p) == "/b/x.jpg", F.lit(0b111)).otherwise(F.lit(0b1)).cast("bigint")
    see = lambda **o: {r.path: r.reason for r in plan.deletions(alike, same, **o).collect()}
    assert see(max_distance=1) == {"/b/x.jpg": plan.SKIPPED["picture"], "/c/x.jpg": plan.SKIPPED["picture"]}
    assert see(max_distance=1, refingerprint=prints) == {"/b/x.jpg": plan.SKIPPED["picture"], "/c/x.jpg": None}
    assert plan.with_sidecars(plan.deletions(g, same), spark.createDataFrame([("/B/X.xmp",), ("/b/y.xmp",)], "path string")).filter("path = '/b/x.jpg'").first()["sidecars"] == ["/B/X.xmp"]


def test_library_look_ups(spark):
    photos = spark.createDataFrame([("/p/A.jpg", "photo", 3), ("/p/a.jpg", "photo", 4), ("/v", "video", 10)], "path string, kind string, size bigint")
    faces = spark.createDataFrame([(9, "/p/a.jpg", "x"), (2, "/p/a.jpg", ""), (3, "/q", "y")], "id bigint, path string, name string")
    assert library.photo(photos, "/p/a.jpg").first()["size"] == 4 and library.photo(photos, "/P/a.jpg").count() == 0
    assert [(r.id, r.name) for r in library.photo_faces(faces, "/p/a.jpg").collect()] == [(2, ""), (9, "x")]
    meta = library.put_meta(spark.createDataFrame([], library.META), "summary", {"added": 1})
    assert tuple(library.state(photos, meta).first()) == (3, 2, 1, 7, 10, '{"added": 1}')
    assert library.state(photos, library.put_meta(meta, "summary", "{broken")).first()["summary"] is None
    twice = spark.createDataFrame([("/n", 1, 1), ("/n", 2, 0)], "path string, size bigint, place int")
    one = library.upsert(photos.withColumn("rating", F.lit(0)).withColumn("recognized", F.lit(0)).withColumn("origin", F.lit("")).withColumn("scan_id", F.lit(0)), twice.withColumn("kind", F.lit("photo")).withColumn("origin", F.lit("")), 3, "place")
    assert one.filter("path = '/n'").first()["size"] == 1


def test_counts_do_not_depend_on_how_rows_are_dealt(spark):
    r = random.Random(8)
    times = [r.randrange(0, 40000) for _ in range(3000)]
    base = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(times)], "k bigint, t bigint, g int")
    other = spark.createDataFrame([(g,) for g in range(7)], "g int")
    shapes = {"dealt": base.repartition(13), "joined": base.join(other, "g"), "grouped": base.groupBy("k", "g").agg(F.max("t").alias("t")), "repeated": base.unionByName(base).repartition(3)}
    for name, df in shapes.items():
        n = 2 if name == "repeated" else 1
        want = {i: n * sum(abs(t - u) <= 500 for u in times) for i, t in enumerate(times[:60])}
        out = people.counts_within(df, df.select(F.col("t").alias("u")), "t", "u", 500).filter("k < 60").collect()
        assert len(out) == 60 * n and all(want[x.k] == x.around for x in out), name
    missing = people.counts_within(spark.createDataFrame([(None,), (5,)], "t bigint"), spark.createDataFrame([(None,), (5,)], "u bigint"), "t", "u", 3).collect()
    assert {x.t: x.around for x in missing} == {None: 0, 5: 1}


def folded(times, tol):
    start, out = None, {}
    for t in sorted(x for x in times if x is not None):
        s = t // 1000
        if start is None or s - start > tol:
            start = s
        out.setdefault(start, []).append(t)
    return sorted(sorted(v) for v in out.values() if len(v) >= 2)


def test_buckets_of_one_sequence_match_a_fold(spark):
    r = random.Random(11)
    for tol, n, spread in ((0, 200, 150), (1, 200, 260), (3, 400, 500), (7, 300, 900), (120, 500, 20000), (2, 400, 399)):
        times = [None if r.random() < 0.05 else r.randrange(-spread * 300, spread * 700) for _ in range(n)]
        df = spark.createDataFrame([(t,) for t in times], "capture_ms bigint").repartition(5)
        stages = Stages(spark)
        got = dedupe.anchored_buckets(df, tol, stages=stages).groupBy("bucket").agg(F.sort_array(F.collect_list("capture_ms")).alias("t")).collect()
        assert sorted(x.t for x in got) == folded(times, tol), (tol, n)
        stages.close()
    many = [r.randrange(0, 3_000_000) for _ in range(6000)]  # a run over several panels of 1024 tolerances, with a gap here and there
    for panel in (dedupe.PANEL, 40, 2):
        got = dedupe.anchored_buckets(spark.createDataFrame([(t,) for t in many], "capture_ms bigint"), 2, panel=panel).groupBy("bucket").agg(F.sort_array(F.collect_list("capture_ms")).alias("t")).collect()
        assert sorted(x.t for x in got) == folded(many, 2)
    every = list(range(0, 700_000, 1000))  # one run without a gap: a chain of 234 buckets
    got = dedupe.anchored_buckets(spark.createDataFrame([(t,) for t in every], "capture_ms bigint"), 2).groupBy("bucket").count().collect()
    assert len(got) == 233 and {x["count"] for x in got} == {3}


def test_each_file_is_read_at_most_once(spark, tmp_path):
    rows = [file(i, f"/a{i % 7}/IMG_{i // 3}.{'mp4' if i % 5 == 0 else 'jpg'}", size=i // 6) for i in range(60)]
    media = spark.createDataFrame(rows, FILE).drop("capture_ms", "subsec_known", "hash", "phash").repartition(3)
    log = str(tmp_path)

    def noted(kind, value):
        def run(path: pd.Series) -> pd.Series:
            for p in path:
                with open(f"{log}/{kind}", "a") as f:
                    f.write(p + "\n")
            return path.map(value)

        return run

    def reader(source, ext):
        stamp = F.pandas_udf(noted("times", lambda p: len(p) * 1000), "bigint")(source)
        return F.struct(stamp.alias("capture_ms"), F.lit(True).alias("subsec_known"), F.lit("exif").alias("source"), F.lit(10).cast("bigint").alias("bytes_read"))

    hasher = F.pandas_udf(noted("hashes", lambda p: "h"), "string")
    printer = F.pandas_udf(noted("prints", lambda p: len(p) % 3), "bigint")
    stages = Stages(spark)
    found = dedupe.scan(media, dedupe.ScanOptions(similar=True), reader=reader, hasher=hasher, printer=printer, stages=stages)
    read = {k: open(f"{log}/{k}").read().split() for k in ("times", "hashes", "prints")}
    assert all(len(v) == len(set(v)) for v in read.values())
    pictures = {x[0] for x in rows if not x[0].endswith(".mp4")}
    assert pictures <= set(read["times"]) and set(read["prints"]) <= pictures
    counted = dedupe.run_counters(stages).first()
    candidates = {x.path for x in dedupe.pregroup(media).collect()}
    assert set(read["times"]) == pictures | candidates and counted.candidates == len(candidates)
    assert (counted.meta_files, counted.meta_bytes, counted.hash_files, counted.printed_files) == (len(read["times"]), 10 * len(read["times"]), len(read["hashes"]), len(read["prints"]))
    total = dedupe.summary(found).first()
    assert tuple(counted)[-3:] == (total["groups"], total.deletable_files, total.wasted_bytes)
    stages.close()


def test_scan_has_no_single_partition(spark):
    rows = [file(i, f"/a{i % 7}/IMG_{i // 3}.jpg", size=i // 6, ms=i * 700, phash=i % 4) for i in range(60)]
    plans = []

    class Watched(Stages):
        def put(self, rows, name, **counts):
            plans.append((name, rows._jdf.queryExecution().executedPlan().toString()))
            return super().put(rows, name, **counts)

    dedupe.scan(spark.createDataFrame(rows, FILE), dedupe.ScanOptions(similar=True, tolerance_sec=2), stages=Watched(spark))
    assert plans and not [n for n, p in plans if "SinglePartition" in p]


def test_saving_a_recognition(spark):
    photos_ = photos(spark, [photo("/p/a.jpg"), photo("/p/b.jpg"), photo("/p/c.jpg"), photo("/x")])
    items = [(1, "/p/c.jpg", [([0.0, 0.0, 1.0], 5.0), ([1.0, 0.0, 0.0], 9.0)], ["landscape"]), (2, "/p/b.jpg", [([0.0, 0.1, 1.0], 5.0)], []), (3, "/p/a.jpg", [], ["animal"])]
    m = marks(spark)
    m = library.Marks(m.faces, m.labels, m.appearances, spark.createDataFrame([(1, "Ann", [1.0, 0.0, 0.0]), (2, "", [0.0, 1.0, 0.0]), (4, "", [0.5, 0.5, 0.0])], library.PEOPLE))
    got = people.save_recognition(spark.createDataFrame(items, "seq int, path string, faces array<struct<embedding: array<float>, area: double>>, labels array<string>"), m, photos_)
    assert {(r.path, r.person_id, r.name) for r in got.faces.collect()} == {("/p/c.jpg", 1, "Ann"), ("/p/c.jpg", 5, ""), ("/p/b.jpg", 5, ""), ("/x", 2, "")}
    assert {tuple(r) for r in got.labels.collect()} == {("/p/c.jpg", "person"), ("/p/b.jpg", "person"), ("/p/a.jpg", "animal"), ("/x", "animal")}
    assert {tuple(r) for r in got.appearances.collect()} == {("/p/c.jpg", 1), ("/p/c.jpg", 5), ("/p/b.jpg", 5), ("/x", 2)}
    assert {r.id for r in got.people.collect()} == {1, 2, 5}  # nobody's face or appearance is left of the fourth
    assert people.renamed_count(m, 9).count() == 0 and [tuple(r) for r in people.renamed_count(m, 1).collect()] == [(1, 1)]
    after, count = people.renamed_face(m, 2, " Bo ")
    assert [tuple(r) for r in count.collect()] == [(2, 1)] and after.people.filter("id = 2").first()["name"] == "Bo" and after.faces.filter("id = 2").first()["name"] == "Bo"
    assert people.renamed_face(m, 99, "x")[1].count() == 0


def test_similar_pairs_and_blocks(spark):
    r = np.random.default_rng(6)
    x, y = r.normal(size=(70, 5)), r.normal(size=(50, 5))
    frame = lambda v: spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)] + [(1000, [0.0] * 5), (1001, None)], "id bigint, embedding array<double>")
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert {(p.a, p.b) for p in people.similar_pairs(frame(x), frame(y), 0.5).collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= 0.5))}
    want = {i: int(cos[i].argmax()) if cos[i].max() >= 0.5 else None for i in range(70)}
    for size in (1 << 20, 500, 60):
        got = {p.face_id: p.person_id for p in people.nearest(frame(x), frame(y), 0.5, sent_bytes=size).collect()}
        assert {i: got[i] for i in want} == want, size
