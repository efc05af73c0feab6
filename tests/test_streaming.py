import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import dedupe
from shoebox.operators.buckets import BucketedTable, Conflict
from shoebox.streaming import ingest


def test_upserts_and_groups(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = dict(path="/a.jpg", name="a.jpg", ext=".jpg", dir="/", size=1, mtime_ms=0, capture_ms=0, year=2020, month=1, day=1, kind="photo", origin="", width=0, height=0)
    (src / "1.json").write_text(json.dumps(row))
    schema = "path string, name string, ext string, dir string, size bigint, mtime_ms bigint, capture_ms bigint, year int, month int, day int, kind string, origin string, width int, height int"
    for size in (1, 5):
        (src / f"{size}.json").write_text(json.dumps(row | {"size": size, "path": f"/{size}.jpg"}))
        ingest.upserts(ingest.incoming(spark, str(src), schema), str(tmp_path / "lib"), 3, str(tmp_path / "ck")).awaitTermination()
    table = ingest.photos_table(spark, str(tmp_path / "lib"))
    got = table.read()
    assert table.version() == 2 and table.buckets == 256
    assert {r.path for r in got.collect()} == {"/1.jpg", "/5.jpg"} and got.filter("scan_id = 3").count() == 2
    (src / "g.json").write_text('{"group_id": "g1", "version": 1, "payload": "a"}\n{"group_id": "g1", "version": 2, "payload": "b"}\n')
    groups = spark.readStream.schema("group_id string, version bigint, payload string").json(str(src)).filter(F.col("group_id").isNotNull())
    q = ingest.latest_groups(groups).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("latest").collect()] == [("g1", "b", 2)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    table = BucketedTable(spark, root, "path string, v int", buckets=32)
    frame = lambda rows: spark.createDataFrame(rows, "path string, v int")
    newest = lambda old, new: old.join(new, "path", "left_anti").unionByName(new)
    assert table.read().count() == 0 and table.version() == 0
    table.upsert(frame([(f"p{i}", i) for i in range(1000)]), newest)
    first = json.loads(open(f"{root}/manifest-1.json").read())["folders"]
    assert len(first) == 32
    batch = [(f"p{i}", -1) for i in range(3)] + [("new", 7)]
    n = table.upsert(frame(batch), newest)
    second = json.loads(open(f"{root}/manifest-2.json").read())["folders"]
    changed = {b for b in second if second[b] != first.get(b)}
    assert len(changed) == n <= len(batch)
    want = {f"p{i}": i for i in range(1000)} | dict(batch)
    assert {r.path: r.v for r in table.read().collect()} == want
    assert {r.path: r.v for r in table.read(1).collect()} == {f"p{i}": i for i in range(1000)}  # a reader of the version before
    with pytest.raises(Exception, match="spoilt"):
        table.rewrite(frame([("p5", 0)]), lambda old: old.withColumn("v", F.raise_error(F.lit("spoilt"))))
    assert table.version() == 2 and {r.path: r.v for r in table.read().collect()} == want
    late = BucketedTable(spark, root, "path string, v int", buckets=5)
    assert late.buckets == 32

    def overtaken(old):
        late.delete(frame([("p9", 0)]))
        return old

    with pytest.raises(Conflict):
        table.rewrite(frame([("p8", 0)]), overtaken)
    del want["p9"]
    assert table.version() == 3 and {r.path: r.v for r in table.read().collect()} == want
    table.tidy(keep=1)
    assert {r.path: r.v for r in table.read().collect()} == want and sorted(f for f in os.listdir(root) if f.startswith("manifest")) == ["manifest-3.json"]
    kept = {f for f in json.loads(open(f"{root}/manifest-3.json").read())["folders"].values()}
    assert {f"{d}/{b}" for d in os.listdir(root) if d.startswith("data-") for b in os.listdir(f"{root}/{d}") if b.startswith("_bucket")} == kept
    with pytest.raises(ValueError, match="not given"):
        table.rewrite(frame([("p1", 0)]), lambda old: frame([(f"q{i}", 0) for i in range(99)]))
    table.delete(table.read())
    assert table.read().count() == 0 and table.rewrite(frame([]), lambda old: old) == 0


FILE = "path string, name string, ext string, size bigint, seq bigint, capture_ms bigint, subsec_known boolean, hash string, gone boolean"


def test_groups_grow_to_what_the_batch_funnel_finds(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(60):
        name = f"IMG_{r.randrange(4)}{r.choice(['', ' (1)', ' - Copy'])}.jpg"
        rows.append((f"/d{i}/{name}", name, ".jpg", r.randrange(2), i, r.choice([None, 1000, 1500, 2000, 9000]), r.random() < 0.5, r.choice("ab"), False))
    o = dedupe.ScanOptions(tolerance_sec=1)
    later = [row[:7] + ("a", False) for row in rows[:5]] + [row[:8] + (True,) for row in rows[5:12]]  # changed contents, and files that go
    final = spark.createDataFrame(later[:5] + rows[12:], FILE)
    exact = dedupe.exact_groups(dedupe.time_groups(dedupe.pregroup(final), o), "time_group").groupBy("group_id").agg(F.sort_array(F.collect_list("path")).alias("p")).collect()
    want = sorted(x.p for x in exact)
    for order in range(2):
        src = tmp_path / f"in{order}"
        src.mkdir()
        mixed = rows[:]
        r.shuffle(mixed)
        batches = [mixed[:20], mixed[20:35], mixed[35:], later]
        out, query = {}, None

        def keep(batch, _, out=out):
            for x in batch.collect():
                if x.version > out.get(x.block, (0,))[0]:
                    out[x.block] = (x.version, x.groups)

        stream = ingest.growing_groups(ingest.incoming(spark, str(src), FILE), o)
        for k, part in enumerate(batches):
            names = [f.split()[0] for f in FILE.split(", ")]
            (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, x))) for x in part))
            query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"ck{order}")).trigger(availableNow=True).start()
            query.awaitTermination()
        assert sorted(g for _, groups in out.values() for g in groups) == want
