import pytest
from pyspark.sql import functions as F

from shoebox.functions import formats, names, times, vectors
from shoebox.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_copy_suffixes(spark):
    cases = {
        "IMG_1 (1).jpg": "img_1", "IMG_1（2）.JPG": "img_1", "a - 副本.png": "a", "a - 复件 (3).png": "a", "a - Copy.cr2": "a", "a copy 2.cr2": "a", "a copy.cr2": "a",
        "a - Copy (2) (3).jpg": "a", "holiday.tar.gz": "holiday.tar", "copy.jpg": "copy", "(1).jpg": "(1)", "plain.jpg": "plain",
    }
    df = spark.createDataFrame(list(cases.items()), "name string, want string")
    bad = df.withColumn("got", names.normalize_key("name")).filter("got <> want").collect()
    assert not bad
    assert one(spark, names.normalize_key(F.lit("a" + "(1)" * 12 + " - Copy" * 12 + ".jpg"))) == "a" and one(spark, names.normalize_key(F.lit("(1)" * 30 + ".jpg"))) == "(1)"
    assert one(spark, names.is_copy_name(F.lit(" a .jpg"))) and not one(spark, names.is_copy_name(F.lit("a.jpg")))


def test_patterns(spark):
    assert one(spark, names.matches(F.lit("D:\\x\\Report.PDF"), "*.pdf")) and one(spark, names.matches(F.lit("akkb.pdf"), "*kk*.pdf"))
    assert not one(spark, names.matches(F.lit("a.pdfx"), "*.pdf")) and not one(spark, names.matches(F.lit("a.pdf"), ""))
    assert one(spark, names.matches(F.lit("a+b(1).pdf"), ["a+b(1)*"]))
    for bad in ("*a", "x" * 81 + "*", " ".join(["abc"] * 21)):
        with pytest.raises(names.PatternError):
            names.compile_patterns(bad)


def test_families_and_origins(spark):
    assert one(spark, names.family(F.lit(".JPEG"))) == ".jpg" and one(spark, names.family(F.lit(".m4v"))) == ".mp4" and one(spark, names.family(F.lit(None).cast("string"))) == ""
    for ext, text, want in ((".CR2", "", "camera"), (".jpg", "Apple iPhone 12", "phone"), (".jpg", "SONY ILCE-7M3", "camera"), (".heic", "", "phone"), (".mts", "", "camera"), (".jpg", "", ""), (".jpg", "Canon Galaxy", "phone")):
        assert one(spark, names.origin(F.lit(ext), F.lit(text))) == want, (ext, text)
    assert one(spark, names.js_length(F.lit("a😀"))) == 3 and one(spark, names.ascii_lower(F.lit("AÉ"))) == "aÉ"
    assert one(spark, names.is_excluded(F.lit("C:\\A\\b"), ["c:/a"])) and not one(spark, names.is_excluded(F.lit("C:/ab"), ["c:/a"]))
    assert one(spark, names.passes_min_edge(F.lit(0), F.lit(9), 240)) and not one(spark, names.passes_min_edge(F.lit(100), F.lit(200), 240))


def test_software_directories(spark):
    yes = ("C:\\Windows", "D:/x/node_modules", "D:/pics/Adobe Photoshop 2021", "D:/a/com.adobe.x/y", "E:/图标", "D:/a/CEP/extensions/b")
    no = ("D:/x/Windows", "D:/DCIM/100CANON", "D:/photos/2020")
    for p in yes:
        assert one(spark, files.is_software(F.lit(p))), p
    for p in no:
        assert not one(spark, files.is_software(F.lit(p))), p
    assert one(spark, files.is_photo_related(F.lit("Thumbs.db"))) and one(spark, files.is_photo_related(F.lit("._x"))) and not one(spark, files.is_photo_related(F.lit("a.txt")))
    assert one(spark, files.below_first_level(F.lit("D:\\a\\b"))) and not one(spark, files.below_first_level(F.lit("/a/b/c")))


def test_times(spark):
    ms = lambda c: one(spark, c["capture_ms"])
    assert ms(times.exif_date(F.lit("2020:01:02 03:04:05"), F.lit("12"))) == 1577934245120
    assert ms(times.iso_date(F.lit("2021-05-06T07:08:09+08:00"))) == 1620284889000
    assert ms(times.exif_date(F.lit("2023:02:31 00:00:00"))) == 1677801600000  # 3 March
    assert one(spark, times.exif_date(F.lit("1979:01:01 00:00:00"))) is None
    assert ms(times.choose_exif(F.lit(""), F.lit("2020:01:02 03:04:05"), F.lit("x"), F.lit("9"), F.lit("5"), F.lit("1"))) == 1577934245500
    assert one(spark, times.choose_exif(F.lit("bad"), F.lit("2020:01:02 03:04:05"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert ms(times.xmp_date(F.lit('xmp:CreateDate="2020-01-02T03:04:05.5" exif:DateTimeOriginal>2019-01-02T03:04:05<'))) == 1546398245000
    assert one(spark, times.format_capture(F.lit(1577934245120), F.lit(True))) == "2020-01-02 03:04:05.120" and one(spark, times.format_capture(F.lit(None).cast("bigint"), F.lit(True))) == times.NO_TIME


def test_formats(spark):
    assert [one(spark, formats.bytes_binary(F.lit(n))) for n in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.0 KB", "3.0 MB", "5.00 GB"]
    assert [one(spark, formats.bytes_adaptive(F.lit(n))) for n in (5, 1500, 20 << 10, 300 << 20)] == ["5 B", "1.46 KB", "20.0 KB", "300 MB"]
    assert [one(spark, formats.bytes_compact(F.lit(n))) for n in (5, 1500, 1 << 20, 15 << 20)] == ["5B", "1KB", "1MB", "15MB"]
    assert one(spark, formats.bytes_decimal(F.lit(1500))) == "2 KB"
    assert [one(spark, formats.shutter(F.lit(x))) for x in (2.0, 0.004, 0.0)] == ["2 秒", "1/250 秒", ""]
    assert one(spark, formats.csv_cell(F.lit('=a"b'))) == '"\'=a""b"'
    assert one(spark, formats.bitrate_text(F.lit(2_500_000))) == "2.5 Mbps" and one(spark, formats.gps(F.lit(-1.5), F.lit(2.0))) == "1.50000°S  2.00000°E"


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(a(1.0, 0.0, 5.0), a(1.0, 1.0))) == pytest.approx(2**-0.5) and one(spark, vectors.cosine(a(0.0), a(1.0))) == 0
    assert one(spark, vectors.hamming(F.lit("f" * 16), F.lit("f" * 15 + "c"))) == 2 and one(spark, vectors.hamming(F.lit("zz"), F.lit("ff"))) is None and one(spark, vectors.hamming(F.lit("f"), F.lit("ff"))) is None
    box = lambda s, k, cx, cy, w, h: F.struct(F.lit(s).alias("score"), F.lit(k).alias("kind"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    dog, man, bird = box(0.9, 16, 100.0, 100.0, 80.0, 80.0), box(0.8, 0, 400.0, 400.0, 90.0, 90.0), box(0.9, 14, 100.0, 400.0, 80.0, 80.0)
    assert one(spark, vectors.scene_labels(F.array(dog, man))) == ["animal", "person"]
    assert one(spark, vectors.scene_labels(F.array(man, bird))) == ["person"]
    assert one(spark, vectors.scene_labels(F.array(box(0.9, 60, 1.0, 1.0, 9.0, 9.0)))) == []
    assert one(spark, vectors.scene_labels(F.slice(F.array(dog), 1, 0))) == ["landscape"]
    assert len(one(spark, vectors.nms(F.array(dog, box(0.5, 16, 101.0, 101.0, 80.0, 80.0), man)))) == 2
