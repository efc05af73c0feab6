import os
import sys

import builders as B
from pyspark.sql import functions as F

from shoebox.operators.stages import Stages
from shoebox.sources import decode, files, process

WANT = 1577934245120


def test_capture_times():
    for data, ext in ((B.jpeg(), ".jpg"), (B.tiff(), ".cr2"), (B.tiff(order=">"), ".nef"), (B.heic(), ".heic"), (B.cr3(), ".cr3")):
        found, n = decode.read_capture(data, ext)
        assert found and found.capture_ms == WANT and found.subsec_known and found.source == "exif", ext
        assert n <= 2 * len(data) + 64 * 1024
    found, _ = decode.read_capture(B.mp4(date=b"2021-05-06T07:08:09+08:00"), ".mov")
    assert (found.capture_ms, found.source, found.subsec_known) == (1620284889000, "quicktime", False)
    big = B.mp4(payload=b"m" * 3_000_000)
    found, n = decode.read_capture(big, ".mp4")
    assert found.source == "mvhd" and n < len(big) // 100
    for bad in (b"", b"\xff\xd8\xff", B.jpeg()[:40], B.mp4()[:30], B.tiff()[:12], os.urandom(200)):
        for ext in (".jpg", ".mp4"):
            assert decode.read_capture(bad, ext)[0] is None


def test_facts_and_sizes():
    f = decode.photo_facts(B.jpeg(size=(320, 200)))
    assert (f["width"], f["height"], f["time"]) == (320, 200, "2020:01:02 03:04:05")
    assert decode.duration(B.mp4()) == 5.0
    assert decode.probe(b"nothing", ".jpg") == (0, 0, "")


def write(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def test_listing_and_catalogue(spark, tmp_path):
    write(tmp_path, "a/one.jpg", B.jpeg())
    write(tmp_path, "a/b/two.MP4", B.mp4())
    write(tmp_path, "a/empty.jpg", b"")
    write(tmp_path, "a/._hidden.jpg", b"x")
    os.link(tmp_path / "a/one.jpg", tmp_path / "a/b/three.jpg")
    write(tmp_path, "node_modules/x.jpg", B.jpeg())
    root = str(tmp_path)
    every = files.listed_local(spark, [root])
    seen = every.filter("size > 0 and not startswith(name, '.')")  # Spark's listing skips hidden and empty files
    assert {r.path for r in files.listed(spark, [root]).select("path").collect()} == {r.path for r in seen.select("path").collect()}
    exts = (".jpg", ".mp4")
    kept = files.media(files.pruned(every, [root], mixed=True), exts)
    assert sorted(r.name for r in kept.select("name").collect()) == ["three.jpg", "two.MP4"] or sorted(r.name for r in kept.select("name").collect()) == ["one.jpg", "two.MP4"]
    rows = {r.ext: r for r in files.catalog(kept, "photo").collect()}
    assert rows[".jpg"].capture_ms == WANT and (rows[".jpg"].width, rows[".jpg"].year) == (640, 2020)
    assert files.media(files.pruned(every, [root], [root + "/A/B"], mixed=True), exts).count() == 1


def test_mixed_directories(spark):
    paths = ["D:/p/album/x/1.jpg", "D:/p/album/x/2.jpg", "D:/p/web/index.html", "D:/p/web/img1.jpg", "D:/p/web/sub/2.jpg", "D:/top.txt", "D:/top.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = {r.path for r in files.pruned(df, ["D:/"]).filter("name like '%.jpg'").collect()}
    assert got == {"D:/p/album/x/1.jpg", "D:/p/album/x/2.jpg"}


def test_roots_and_lines(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    a = str(tmp_path / "a")
    assert files.prune_roots([f' "{a}" ', a.upper() if False else a, a + "/b", str(tmp_path / "none"), ""]) == ([a], [a + "/b"], [str(tmp_path / "none")])
    (tmp_path / "l.json").write_text('{"path": "x", "faces": [], "labels": ["animal"], "pass": "scene"}\nbroken\n')
    assert [r.path for r in files.recognition_lines(spark, str(tmp_path / "l.json")).collect()] == ["x"]
    assert files.drives("C:\n DD\nE: \n1:") == ["C:", "E:"]


def test_sidecars_and_pairs(spark):
    paths = spark.createDataFrame([("/p/IMG_1.CR2",), ("/p/img_1.jpg",), ("/p/IMG_1.xmp",), ("/q/IMG_1.xmp",), ("/p/IMG_2.jpg",)], "path string")
    mine = paths.filter("path = '/p/IMG_1.CR2'")
    assert files.sidecars(mine, paths).first()["sidecars"] == ["/p/IMG_1.xmp"] and files.camera_pairs(mine, paths).first()["pairs"] == ["/p/img_1.jpg"]


def test_workers_list_what_the_driver_would(spark, tmp_path, monkeypatch):
    for i in range(40):
        write(tmp_path, f"d{i % 5}/e{i % 3}/f{i % 2}/IMG_{i}.jpg", b"x" * i)
    write(tmp_path, "d0/.hidden.jpg", b"x")
    write(tmp_path, "d1/.deep/in/side.jpg", b"x")
    write(tmp_path, "node_modules/x.jpg", b"x")
    write(tmp_path, "d2/skip/x.jpg", b"x")
    os.link(tmp_path / "d1/e1/f1/IMG_1.jpg", tmp_path / "d2/linked.jpg")
    os.symlink(tmp_path / "d1", tmp_path / "d3/round")
    os.symlink(tmp_path / "d1/e1/f1/IMG_1.jpg", tmp_path / "d3/soft.jpg")
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    want = sorted(tuple(r) for r in files.listed_local(spark, [root]).collect())
    monkeypatch.setattr(os, "walk", None)
    stages = Stages(spark)
    got, errors = files.walked(spark, [root, root + "/d0"], software=False, stages=stages)
    assert sorted(tuple(r) for r in got.collect()) == want and errors.count() == 0
    once = files.media(got, (".jpg",))
    assert once.groupBy("dev", "ino").count().filter("count > 1").count() == 0
    pruned = {r.path for r in files.walked(spark, [root], [root + "/D2/skip"])[0].collect()}
    assert pruned == {r[0] for r in want if "node_modules" not in r[0] and "/skip/" not in r[0]}
    lost, errors = files.walked(spark, [root + "/none"])
    assert lost.count() == 0 and [r.path for r in errors.collect()] == [root + "/none"]
    assert files.walked(spark, [])[0].count() == 0
    stages.close()


PROGRAM = """
import json, os, sys, time
print("warming up", flush=True)
for line in sys.stdin:
    p = line.strip()
    if p == "die": os._exit(3)
    if p == "hang": time.sleep(60)
    if p == "noise": print("{broken", flush=True)
    if p == "other": print(json.dumps({"path": "elsewhere", "phash": "0"}), flush=True)
    print(json.dumps({"path": p, "phash": format(len(p), "016x") if p != "bad" else "xyz", "pid": os.getpid()}), flush=True)
"""


def test_programs_are_asked_line_by_line(spark, tmp_path):
    script = tmp_path / "program.py"
    script.write_text(PROGRAM)
    asked = ["a", "die", "bb", "noise", "hang", "ccc", "other", "bad", "die", "die", "é" * 4, "with\nbreak", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(asked)], "i int, path string").coalesce(1)
    command = [sys.executable, str(script)]
    got = {r.i: r for r in process.answered(rows, command, "path string, phash string, pid bigint", limit=3).collect()}
    lost = {i for i, p in enumerate(asked) if p in ("die", "hang", "", None) or "\n" in p}
    assert {i for i, r in got.items() if r.answer is None} == lost and all(got[i].answer.path == p for i, p in enumerate(asked) if i not in lost)
    assert len({r.answer.pid for r in got.values() if r.answer}) == 4  # a new child after each loss that something followed
    prints = {r.i: r.phash for r in process.fingerprints(rows, command, limit=3).collect()}
    assert prints[0] == 1 and prints[2] == 2 and prints[7] is None and prints[10] == 4
    nobody = process.answered(rows.limit(1), ["/no/such/program"], "path string", limit=1)
    try:
        nobody.collect()
        raise AssertionError("a program that is not there must not look like one without answers")
    except Exception as e:
        assert "no/such/program" in str(e)
