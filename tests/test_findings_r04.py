"""One test for each finding of round 4 that was right."""

import random
import time
import tracemalloc
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shoebox.functions import formats
from shoebox.llm import webp
from shoebox.operators import dedupe, people
from shoebox.plans import registry
from tests.test_operators import naive_links


def shuffled_rows(spark, run) -> int:
    """Rows that exchanges wrote during a call."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def crowd(n, span, people_, seed=1):
    r = random.Random(seed)
    return [(f"/{i}", r.randrange(span), [] if i % 4 == 0 else [r.randrange(people_)], i % 4 == 0) for i in range(n)]


SHOT = "path string, capture_ms bigint, person_ids array<bigint>, body boolean"


def test_back_views_shuffle_shots_not_people_around_them(spark, monkeypatch):
    """with many people around every shot no more than about two rows a shot travel; parts of crowded panels add up."""
    df = spark.createDataFrame(crowd(6000, 60_000, 500), SHOT).repartition(3).localCheckpoint()
    assert shuffled_rows(spark, lambda: people.link_back_views(df, 1000).collect()) < 2.5 * 6000
    r = random.Random(7)
    rows = [(f"/{i}", r.randrange(40_000), [] if r.random() < 0.02 else [1 + r.randrange(40) % r.choice([1, 1, 1, 40])], r.random() < 0.5) for i in range(3000)]
    want = naive_links(rows, 60)
    few = spark.createDataFrame(rows, SHOT)
    assert want and {(x.path, x.person_id) for x in people.link_back_views(few, 60).collect()} == want
    monkeypatch.setattr(people, "PANEL_ROWS", 8)
    assert {(x.path, x.person_id) for x in people.link_back_views(few, 60).collect()} == want


def test_relinked_keeps_appearances_and_adds_back_views(spark):
    """the same rows as the model's, and no row for a pair of a shot and a person around it."""
    rows = crowd(3000, 30_000, 300, seed=2) + [("/x1", 90_000, [], True), ("/x2", 90_010, [7], False), ("/x3", 90_020, [7], False)]
    df = spark.createDataFrame(rows, SHOT).repartition(3).localCheckpoint()
    faces = df.select("path", F.explode("person_ids").alias("person_id"))
    m = people.Marks(faces, None, faces.filter("path < '/2'").unionByName(spark.createDataFrame([("/0", 3)], faces.schema)).localCheckpoint(), None)
    got = []
    assert shuffled_rows(spark, lambda: got.extend(tuple(r) for r in people.relinked(df, m, 1000).collect())) < 5 * 3000
    own = {(p, w[0]) for p, _, w, _ in rows if w and p < "/2"}
    assert len(got) == len(set(got)) and set(got) == own | naive_links(rows, 1000) and ("/x1", 7) in got


def test_persons_within_counts_where_pairs_meet(spark, monkeypatch):
    """counts of persons around each path; pairs do not travel, whether panels are in parts or a path has several shots."""
    r = random.Random(3)
    shots = [(f"/{i % 380}", r.randrange(20_000)) for i in range(400)] + [("/none", None)]
    faces = [(r.choice([None, *range(50)]), r.randrange(20_000)) for _ in range(3000)]
    want = {}
    for path, t in shots:
        for person, ms in faces:
            if t is not None and abs(t - ms) <= 700:
                want[path, person] = want.get((path, person), 0) + 1
    frames = lambda some: (spark.createDataFrame(some, "path string, ms bigint").localCheckpoint(), spark.createDataFrame(faces, "person_id bigint, ms bigint").localCheckpoint())
    counted = lambda some: {(x.path, x.person_id): x.n for x in people.persons_within(*frames(some), 700).collect()}
    assert counted(shots) == want
    own = {p for p, t in shots[:380]}
    alone = frames(shots[:380])
    assert shuffled_rows(spark, lambda: people.persons_within(*alone, 700).collect()) < 3 * 3400 and len(own) == 380
    monkeypatch.setattr(people, "PANEL_ROWS", 100)
    assert counted(shots) == want


def test_clusters_merge_without_a_table_of_all_pairs():
    """the same clusters as by looking through all pairs each time, in memory that does not grow with the square of the clusters."""
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 8))
    v = (base[r.integers(0, 60, 700)] + 0.5 * r.normal(size=(700, 8))).astype(np.float32)
    found = lambda: people._leaders(v, list(range(len(v))), 12, 0.9, 0.8)
    slow = found()
    while True:
        c = people._unit_rows(np.stack([x.center for x in slow]))
        large = np.array([len(x.members) >= 12 for x in slow])
        s = np.where(np.triu(c @ c.T >= np.where(large[:, None] | large, 0.9, 0.8), 1), c @ c.T, -2)
        a, b = divmod(int(s.argmax()), len(slow))
        if s[a, b] <= -1:
            break
        slow[a].take(slow[b].members, slow[b].sum)
        del slow[b]
    assert len(slow) < len(found()) and [x.members for x in people._merged(found(), 12, 0.9, 0.8)] == [x.members for x in slow]
    far = r.normal(size=(5000, 32)).astype(np.float32)
    tracemalloc.start()
    people.cluster(far, low=0.8, high=0.8, floor=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_far_fingerprints_are_compared_in_blocks(spark, monkeypatch):
    """at a distance whose bands tell nothing apart every pair is found, with copies of fingerprints, without candidates that travel."""
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)]
    prints = [(f"k{i}", (seeds[i % 40] ^ sum(1 << r.randrange(64) for _ in range(r.randrange(12)))) & (1 << 64) - 1) for i in range(300)] + [("k7", seeds[7]), ("n", None)]
    prints += [(f"c{i}", seeds[0]) for i in range(30)]
    df = spark.createDataFrame([(k, None if p is None else p - (1 << 64) if p >> 63 else p) for k, p in prints], "path string, phash bigint").localCheckpoint()
    known = [x for x in prints if x[1] is not None]
    want = sorted((*sorted((k, m)), (p ^ q).bit_count()) for i, (k, p) in enumerate(known) for m, q in known[:i] if k != m and (p ^ q).bit_count() <= 20)
    found = lambda: sorted(tuple(x) for x in dedupe.near_pairs(df, 20).collect())
    assert found() == want
    monkeypatch.setattr(dedupe, "PRINTS_BLOCK", 20)
    assert found() == want
    monkeypatch.undo()
    many = spark.range(2000).select("id", F.xxhash64("id").alias("phash")).localCheckpoint()
    assert shuffled_rows(spark, lambda: dedupe.near_pairs(many, 20, key="id").count()) < 12 * 2000


def test_main_subjects_of_a_photo_over_several_batches(spark):
    """faces of one photo that come in several batches, also of different lengths, as one after the other."""
    r = np.random.default_rng(4)
    faces = [(f"/{i % 3}", r.normal(size=int(r.choice([6, 6, 9]))).tolist(), float(r.integers(5)), i) for i in range(900)] + [("/0", None, 9.0, 900), ("/0", [0.0] * 6, None, 901)]
    want = set()
    for path in {f[0] for f in faces}:
        kept = []
        for _, e, _, ord_ in sorted((f for f in faces if f[0] == path and f[1]), key=lambda f: (-(f[2] or 0), f[3])):
            if not any(people._cos(e, k) >= 0.5 for k in kept):
                kept.append(e)
                want.add((path, ord_))
    df = spark.createDataFrame(faces, "path string, embedding array<double>, area double, ord bigint").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert {(x.path, x.ord) for x in people.main_subjects(df, 0.5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_of_sizes_round_the_double_itself(spark, tmp_path):
    """digits as C and JavaScript write them, ties to even where the SQL's printf decides, and the queries equal their SQL on prices in the middle."""
    r = random.Random(6)
    some = [194.25, 194.75, 0.15, 0.25, 0.35, 0.05, 2.5, 9.999, 0.999, 1.005, 2.675, 1e15 + 0.5, 123456.785, -0.25, -1.05, 0.0, 37 * 50000 / 1e6, 9.25, 27.75] + [r.randrange(10**6) / 8000 for _ in range(300)] + [r.random() * 10 ** r.randrange(6) for _ in range(300)]
    half_up = lambda x, d: str(Decimal(x).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))
    df = spark.createDataFrame([(x,) for x in some], "x double")
    for d in (0, 1, 2):
        got = df.select("x", formats._fixed(F.col("x"), d, True).alias("c"), formats._fixed(F.col("x"), d).alias("js")).collect()
        assert [(g.x, g.c) for g in got] == [(g.x, f"{g.x:.{d}f}") for g in got] and [(g.x, g.js) for g in got] == [(g.x, half_up(g.x, d)) for g in got]
    assert spark.range(1).select(formats.trim_num(F.lit(None).cast("double")).alias("t")).first().t is None
    middle = [k for k in range(1, 10**6) if 37 * k % 100_000 == 50_000 or 37 * k / 1e9 > 0.02 and 37 * k % 10_000_000 == 5_000_000] + [27_027_000 + k for k in range(0, 10**6, 9973)]
    dyadic = [k for k in range(1, 30_000) if 37 * k % 256 == 0] + [2**20 * k // 4 for k in range(1, 30)]
    rows = [(i, float(p)) for i, p in enumerate(sorted(middle + dyadic))] + [(None, 50_000.0), (10**6, None)]
    pq.write_table(pa.table({"o_orderkey": pa.array([x for x, _ in rows], pa.int64()), "o_totalprice": pa.array([x for _, x in rows], pa.float64())}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    for name in ("size_format", "number_formats"):
        got = registry.queries()[name](spark, str(tmp_path)).toArrow()
        want = con.sql(registry.SQL[name]).to_arrow_table().select(got.column_names)
        texts = lambda t: sorted(repr(tuple(x.values())) for x in t.to_pylist())
        assert texts(got) == texts(want), name


def test_nearest_in_bounded_tiles():
    """the best of 20,000 people for each of 3,000 faces, the last of equals, without the table of both."""
    r = np.random.default_rng(8)
    x, y = r.normal(size=(3000, 16)), r.normal(size=(20_000, 16))
    y[19_000] = y[11]  # in another tile
    ids = r.permutation(20_000)
    x[5] = y[11]
    faces = [*x, None]
    tracemalloc.start()
    hit, who, score = people._best_of(faces, people._people(ids, list(y)), 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # the table has 480e6 bytes
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(hit) == {i for i in range(3000) if i == 5 or (unit(x[i : i + 1]) @ unit(y).T).max() >= 0.5}
    at = {int(i): (int(w), s) for i, w, s in zip(hit, who, score)}
    assert at[5][0] in (ids[11], ids[19_000]) and all(at[i][0] == ids[(unit(x[i : i + 1]) @ unit(y).T).argmax()] for i in range(0, 3000, 60) if i in at)


def test_best_name_of_vectors_with_gaps(spark):
    """names of the nearest named faces, whatever the vectors' lengths; blocks and tiles give the same."""
    r = np.random.default_rng(9)
    rows = [(i, None if i % 50 == 0 else r.normal(size=int(r.choice([5, 8]))).tolist(), "" if i % 3 else f"N{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, name string")
    named = [(i, v, n) for i, v, n in rows if n and v is not None]
    best = {}
    for i, v, _ in rows:
        s = max(((people._cos(v, w), n) for _, w, n in named), default=(-1, "")) if v is not None else (-1, "")
        best[i] = s[1] if s[0] >= 0.32 else ""
    assert {x.face_id: x.name for x in people.best_name(df, df).collect()} == best
    near = {x.face_id: x.person_id for x in people.nearest(df, df.filter("name <> ''"), sent_bytes=500).collect()}
    assert {i: "" if p is None else f"N{p}" for i, p in near.items()} == best


def test_first_fit_of_many_fingerprints_and_many_small_blocks(spark):
    """the same groups as by asking every group, in time that does not grow with their square; time groups of blocks of all sizes, over several batches."""

    def slow(paths, prints, distance):
        groups = []
        for i in sorted(range(len(paths)), key=lambda i: paths[i]):
            g = next((g for g in groups if all((prints[i] ^ prints[j]).bit_count() <= distance for j in g)), None)
            if g is None:
                groups.append(g := [])
            g.append(i)
        return [g for g in groups if len(g) >= 2]

    r = random.Random(10)
    for _ in range(200):
        seeds, d = [r.getrandbits(63) for _ in range(r.choice([1, 4]))], r.choice([0, 2, 4, 12, 22])
        prints = [r.choice(seeds) ^ sum({1 << r.randrange(r.choice([6, 63])) for _ in range(r.randrange(7))}) for _ in range(r.randrange(1, 50))]
        paths = [str(r.randrange(10**6)) for _ in prints]
        assert dedupe.first_fit(paths, prints, d) == slow(paths, prints, d)
    many = [r.getrandbits(63) for _ in range(30_000)]
    began = time.process_time()
    assert dedupe.first_fit([str(i) for i in range(60_000)], many + many, 4) and time.process_time() - began < 20
    sizes = [1, 2, 3, 20_000, 1, 5, *(r.randrange(1, 6) for _ in range(3000)), 17_000]
    rows = [(b, f"/{b}/{i}", i % 7, None if r.random() < 0.1 else r.randrange(0, 9_000_000, 250), r.random() < 0.5) for b, n in enumerate(sizes) for i in range(n)]
    schema = "block bigint, path string, seq bigint, capture_ms bigint, subsec_known boolean"
    want = set()
    for b in range(len(sizes)):
        own = pd.DataFrame([x for x in rows if x[0] == b] if b < 6 else [], columns=["block", "path", "seq", "capture_ms", "subsec_known"]).sort_values(["seq", "path"]).reset_index(drop=True)
        groups = [*dedupe.cluster_by_capture(own, 1), *([m] if len(m := own.index[own["capture_ms"].isna()].tolist()) >= 2 else [])] if len(own) else []
        want |= {(own["path"][i], f"{b}:{k}") for k, g in enumerate(groups) for i in g}
    got = {(x.path, x.time_group) for x in dedupe.time_groups(spark.createDataFrame(rows, schema), dedupe.ScanOptions(tolerance_sec=1)).filter("block < 6").collect()}
    assert got == want and len(want) > 10_000


def test_webp_references_begin_at_every_place():
    """passages that repeat inside words, away from every 32nd byte, are referred to as a whole."""
    r = np.random.default_rng(11)
    letters = lambda n: r.integers(97, 123, n, dtype=np.uint8)
    phrase = letters(24)
    image = np.concatenate([x for k in range(120) for x in (letters(9), phrase)])
    image = np.concatenate((image, letters(-len(image) % 64)))
    origin, place, run, back = webp._matches(image, np.array([0, len(image)]))
    assert run.sum() >= 119 * 24 and all((image[p : p + n] == image[p - d : p - d + n]).all() for p, n, d in zip(place, run, back))
    (file,) = webp.encode_many(image, np.array([0, len(image)]), 64)
    assert (webp.decode_many([file])[0] == image).all() and (webp.decode(file)[2].ravel() >> 8 & 255 == image).all()
