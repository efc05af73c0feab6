"""Catalogues of media files as DataFrames.

Files are listed by Spark's binaryFile source, which reads no content unless it is asked for, or level by level by the workers, who see hidden and empty files, links and birth times; directories are pruned with joins on the
listing. Decoders read header ranges by path where workers can open it and the content column elsewhere.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.times import parts as date_parts
from ..functions.udfs import vectorised
from ..operators.stages import Stages
from . import decode, jpeg

# Names of directories that hold software or its assets, marks of installed programs, names at a drive's root.
SOFTWARE = (
    "$recycle.bin", "system volume information", "node_modules", ".git", ".svn", ".hg", "bower_components", "__pycache__", "site-packages", ".venv", "venv", "__macosx", "windowsapps", "winsxs", "wpsystem", "perflogs",
    "program files", "program files (x86)", "programdata", "appdata", "sample pictures", "sample videos", "示例图片", "示例视频", "steamapps", "epic games", "gog games", "riot games", "xboxgames", "wegameapps",
    "icons", "icon", "assets", "resources", "cache", "caches", ".cache", "cache2", "thumbnails", "thumbs", ".thumbnails", "emoji", "emojis", "emoticon", "emoticons", "emotion", "customemotion", "stickers", "sticker",
    "skins", "skin", "themes", "theme", "cursors", "locales", "locale", "fonts", "mipmap", "mipmaps", "drawable", "plugins", "plugin", "wallpaper", "wallpapers", "图标", "缓存", "表情", "表情包", "贴纸", "皮肤",
)
INSTALLED = ("photoshop", "lightroom", "premiere", "illustrator", "indesign", "acrobat", "after effects", "media encoder", "creative cloud")
DRIVE_ROOT = ("windows", "recovery", "$windows.~bt", "$winreagent")
ASSETS = ("images", "image", "img", "pics", "pictures", "photos", "res", "ui", "bitmaps", "bitmap", "textures", "texture", "samples", "sample", "demo", "demos", "help", "docs", "manual")
PROGRAM_EXTENSIONS, PROGRAM_FILES = (".exe", ".dll", ".mui", ".asar", ".ocx"), ("package.json", "uninstall.exe")
IMAGES = (".png", ".gif", ".bmp", ".webp", ".avif", ".jfif", ".jpe", ".jp2", ".svg", ".ico", ".psd", ".psb", ".jxl", ".heics", ".thm", ".lrv", ".hif")
IGNORED = ("desktop.ini", "thumbs.db", "ehthumbs.db", "ehthumbs_vista.db", ".ds_store", ".localized", ".nomedia")
MAX_SIZE = (1 << 53) - 1

MEDIA = "path string, path_key string, name string, ext string, size bigint, mtime_ms bigint, birthtime_ms bigint, dev bigint, ino bigint, nlink int, seq bigint"


def is_software(path: Column | str) -> Column:
    """Whether a directory holds software: by its name, by a mark anywhere in its path, or by its name at a drive's root."""
    p = N.parts(path)
    last, joined = F.element_at(p, -1), F.array_join(p, "/")
    marked = F.exists(p, lambda x: x.isin("adobe", "cdn-assets") | F.startswith(x, F.lit("com.adobe.")) | x.rlike("|".join(INSTALLED)))
    rooted = (F.size(p) == 2) & F.endswith(p[0], F.lit(":")) & last.isin(*DRIVE_ROOT)
    return F.coalesce(last.isin(*SOFTWARE) | marked | F.contains(joined, F.lit("/cep/extensions/")) | rooted, F.lit(False))


def is_photo_related(name: Column | str) -> Column:
    low = F.lower(F.coalesce(N.col(name), F.lit("")))
    every = {e for group in N.EXTENSIONS.values() for e in group} | set(N.SIDECARS) | set(IMAGES)
    return (low == "") | F.startswith(low, F.lit("._")) | low.isin(*IGNORED) | N.extension(low).isin(*sorted(every))


def is_program(name: Column | str) -> Column:
    low = F.lower(N.col(name))
    return low.isin(*PROGRAM_FILES) | N.extension(low).isin(*PROGRAM_EXTENSIONS)


def is_bundled_asset(name: Column | str) -> Column:
    return F.lower(N.col(name)).isin(*ASSETS)


def below_first_level(path: Column | str) -> Column:
    p = N.parts(path)
    return (F.size(p) >= 3) & F.endswith(p[0], F.lit(":"))


def prune_roots(given: list[str], exists=os.path.isdir) -> tuple[list[str], list[str], list[str]]:
    """Roots to scan, those inside another one, those that are no directories."""
    seen, good, invalid = set(), [], []
    for raw in given:
        text = raw.strip()
        text = text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text
        if not text:
            continue
        full = os.path.abspath(text)
        key = full.rstrip("/\\").lower()
        if key in seen:
            continue
        seen.add(key)
        (good if exists(full) else invalid).append(full)
    roots: list[str] = []
    nested: list[str] = []
    for path in sorted(good, key=len):
        key = path.rstrip("/\\").lower()
        inside = any(key.startswith(r.rstrip("/\\").lower() + sep) for r in roots for sep in "/\\")
        (nested if inside else roots).append(path)
    return roots, nested, invalid


def listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file below the roots but hidden and empty ones, without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length", "modificationTime")
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return _named(files.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")))


def _stamps(s: os.stat_result) -> tuple[int, int]:
    """When a file was changed and born, in whole milliseconds; where its birth is not known it is the change."""
    changed = s.st_mtime_ns // 1_000_000
    return changed, int(getattr(s, "st_birthtime", 0) * 1000) or changed


def listed_local(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The same through the driver's file system, with birth times and hard links, which Spark's listing lacks. For roots of one machine."""
    rows = []
    for root in roots:
        for folder, dirs, files in os.walk(root):
            dirs.sort()
            for f in sorted(files):
                p = os.path.join(folder, f)
                if os.path.islink(p):
                    continue
                s = os.lstat(p)
                rows.append((p, s.st_size, *_stamps(s), s.st_dev, s.st_ino, s.st_nlink))
    raw = spark.createDataFrame(rows, "path string, size bigint, mtime_ms bigint, birthtime_ms bigint, dev bigint, ino bigint, nlink int")
    return _named(raw)


LISTED = "kind string, path string, size bigint, mtime_ms bigint, birthtime_ms bigint, dev bigint, ino bigint, nlink int, error string"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder: files, hidden and empty ones too, and folders; links are passed over, and what cannot be read is named with its error."""
    kinds = {"kind": pa.string(), "path": pa.string(), **dict.fromkeys(("size", "mtime_ms", "birthtime_ms", "dev", "ino"), pa.int64()), "nlink": pa.int32(), "error": pa.string()}
    for batch in batches:
        rows: list[tuple] = []
        for folder in batch.column(0).to_pylist():
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                rows.append(("error", folder, *[None] * 6, str(e)))
                continue
            for entry in entries:
                try:
                    path = entry.path.encode().decode()  # a name that is no UTF-8 has no place in a string column
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        rows.append(("folder", path, *[None] * 7))
                    elif entry.is_file(follow_symlinks=False):
                        s = os.lstat(path)
                        rows.append(("file", path, s.st_size, *_stamps(s), s.st_dev, s.st_ino, s.st_nlink, None))
                except (OSError, UnicodeError) as e:
                    rows.append(("error", repr(entry.path), *[None] * 6, str(e)))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def walked(spark: SparkSession, roots: list[str], excluded: list[str] | None = None, software: bool = True, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """Every file below the roots, hidden and empty ones too, with birth times and what tells hard links; and the folders and files that could not be read, with their errors.

    Folders are listed by the workers, level by level: each level's folders are the next one's input, so the driver sees only how many there are, and a level of many folders is spread over all tasks. Folders that are excluded
    or hold software are not entered. For folders that all workers see under the same path.
    """
    stages = stages or Stages(spark)
    frontier, waiting, levels = spark.createDataFrame([(r,) for r in prune_roots(roots, exists=lambda _: True)[0]], "path string"), len(roots), []
    slots = spark.sparkContext.defaultParallelism
    while waiting:
        shut = N.is_excluded("path", excluded or []) | (is_software("path") if software else F.lit(False))
        open_ = frontier.filter(~shut).repartition(max(1, min(waiting, 4 * slots)), "path")
        level = stages.put(open_.mapInArrow(_list_folders, LISTED), f"level{len(levels)}", folders=F.count(F.when(F.col("kind") == "folder", 1)))
        levels.append(level)
        waiting, frontier = stages.counts["folders"], level.filter("kind = 'folder'").select("path")
    if not levels:
        levels = [spark.createDataFrame([], LISTED)]
    every = reduce(DataFrame.unionByName, levels)
    return _named(every.filter("kind = 'file'").drop("kind", "error")), every.filter("kind = 'error'").select("path", "error")


def _named(df: DataFrame) -> DataFrame:
    for c in ("birthtime_ms", "dev", "ino", "nlink"):
        if c not in df.columns:
            df = df.withColumn(c, F.col("mtime_ms") if c == "birthtime_ms" else F.lit(None).cast("int" if c == "nlink" else "bigint"))
    return df.select("path", F.lower("path").alias("path_key"), N.basename("path").alias("name"), N.extension("path").alias("ext"), "size", "mtime_ms", "birthtime_ms", "dev", "ino", "nlink")


def _ancestors(path: Column, root: Column) -> Column:
    """Directories of a path that are at or below its root, the nearest first."""
    rest = F.split(F.substr(path, F.length(root) + 2), "/")
    ups = F.sequence(F.lit(0), F.size(rest) - 1)
    return F.reverse(F.transform(ups, lambda i: F.when(i == 0, root).otherwise(F.concat(root, F.lit("/"), F.array_join(F.slice(rest, F.lit(1), i), "/")))))


def pruned(files: DataFrame, roots: list[str], excluded: list[str] | None = None, mixed: bool = True) -> DataFrame:
    """Files that are in no pruned directory: software, excluded, or mixed with files that are no photos.

    A mixed directory loses its own files, and all that is below it if it is two levels below a drive.
    """
    plain = lambda x: F.regexp_replace(x, r"\\", "/")
    root = F.lit(None).cast("string")
    for r in sorted((r.replace("\\", "/").rstrip("/") for r in roots), key=len):
        root = F.when(F.startswith(F.lower(plain(F.col("path"))), F.lit(r.lower() + "/")), F.lit(r)).otherwise(root)
    tree = files.withColumn("_p", plain(F.col("path"))).withColumn("_root", root).filter("_root is not null").withColumn("_up", _ancestors(F.col("_p"), F.col("_root"))).withColumn("_dir", F.col("_up")[0])
    dirs = tree.select(F.explode("_up").alias("dir"), "_root").distinct()
    own = tree.groupBy("_dir").agg(F.bool_or(~is_photo_related("name")).alias("other"))
    dirs = dirs.join(own, dirs.dir == own._dir, "left")
    soft = is_software("dir") if mixed else F.lit(False)
    whole = soft | N.is_excluded("dir", excluded or [])
    if mixed:
        whole = whole | (F.coalesce("other", F.lit(False)) & below_first_level("dir"))
    bad = dirs.filter(whole).select(F.col("dir").alias("bad")).distinct()
    kept = tree.join(tree.select("path", F.explode("_up").alias("bad")).join(bad, "bad", "left_semi").select("path").distinct(), "path", "left_anti")
    if mixed:
        kept = kept.join(dirs.filter("other").select(F.col("dir").alias("_dir")).distinct(), "_dir", "left_anti")
    return kept.drop("_p", "_root", "_up", "_dir")


def media(files: DataFrame, extensions: tuple[str, ...], empty: bool = False) -> DataFrame:
    """Media files of the extensions, once each, of hard links the first; with seq, the order by path."""
    found = files.filter(F.col("ext").isin(*extensions) & ~F.startswith("name", F.lit("._")) & (F.col("size") <= MAX_SIZE) & (F.col("size") >= (0 if empty else 1)))
    by_path = Window.partitionBy("path_key").orderBy("path")
    linked = Window.partitionBy("dev", "ino", F.when(F.coalesce("nlink", F.lit(1)) > 1, F.lit("")).otherwise(F.col("path_key"))).orderBy("path")
    once = found.withColumn("_n", F.row_number().over(by_path)).filter("_n = 1").withColumn("_n", F.row_number().over(linked)).filter("_n = 1").drop("_n")
    # ranges of paths in order, each sorted: the id that grows along them is an order of all
    return once.repartitionByRange("path_key").sortWithinPartitions("path_key").withColumn("seq", F.monotonically_increasing_id())


def _over_paths(name: str, kind: str):
    def wrap(f):
        names = [x.split()[0] for x in kind.split(", ")]

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for path, ext in batches:
                yield pd.DataFrame([f(p, e) for p, e in zip(path, ext, strict=True)], columns=names)

        run.__name__ = name
        return vectorised(kind)(run)

    return wrap


@_over_paths("capture", "capture_ms bigint, subsec_known boolean, source string, bytes_read bigint")
def capture(source, ext):
    """The capture time of a path, or of content."""
    found, n = decode.read_capture(source, ext)
    return {"capture_ms": found and found.capture_ms, "subsec_known": bool(found and found.subsec_known), "source": found and found.source, "bytes_read": n}


@_over_paths("probed", "width int, height int, text string")
def probed(source, ext):
    return dict(zip(("width", "height", "text"), decode.probe(source, ext), strict=True))


FACTS = "make string, model string, lens string, description string, software string, artist string, copyright string, time string, exposure double, aperture double, focal double, bias double, iso int, program int, metering int, flash int, white_balance int, focal35 int, width int, height int, latitude double, longitude double"


@_over_paths("facts", FACTS)
def facts(source, ext):
    """Camera facts of a photo's path or content."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    try:
        with decode.Reader(source) as r:
            found = decode.photo_facts(r.read(0, 8 * decode.MIB))
    except (OSError, IndexError):
        found = {}
    return {n: found.get(n) for n in names}


@vectorised("string")
def content_hash(source: pd.Series) -> pd.Series:
    return source.map(decode.content_hash)


@vectorised("bigint")
def phash_embedded(source: pd.Series) -> pd.Series:
    """The difference hash of pictures, by path or content: of JPEG files, and of others by the JPEG picture in them, as raw files have one. Other formats are read if an optional imaging library is there, and null otherwise."""
    return source.map(lambda p: None if p is None else picture_hash(p)).astype("Int64")


def picture_hash(source: str | bytes) -> int | None:
    try:
        with decode.Reader(source) as r:
            head = r.read(0, 2)
            data = r.read(0, r.size if head == b"\xff\xd8" else jpeg.PREVIEW_BYTES)
    except OSError:
        return None
    found = None if head in (b"\xff\xd8", b"II", b"MM") else _decoded_elsewhere(source)
    return jpeg.fingerprint(data) if found is None else found


def _decoded_elsewhere(source: str | bytes) -> int | None:
    try:
        from PIL import Image, ImageOps
    except ImportError:
        return None
    try:
        grey = ImageOps.exif_transpose(Image.open(io.BytesIO(source) if isinstance(source, bytes) else source)).convert("L")
    except Exception:  # whatever the library cannot read has no fingerprint
        return None
    return jpeg.difference_hash(np.asarray(grey, float))


def catalog(files: DataFrame, kind: str, min_edge: int = 0, zone: str | None = None) -> DataFrame:
    """Rows of the photos table from media files; an unknown capture time is the time of modification, in the zone's calendar."""
    f = files.withColumn("p", probed("path", "ext")).filter(N.passes_min_edge(F.col("p.width"), F.col("p.height"), min_edge)).withColumn("c", capture("path", "ext"))
    ms = F.coalesce("c.capture_ms", "mtime_ms")
    d = F.when(F.col("c.capture_ms").isNotNull(), date_parts(ms)).otherwise(date_parts(ms, zone))
    return f.select(
        "path", "name", "ext", N.dirname("path").alias("dir"), "size", "mtime_ms", ms.alias("capture_ms"), d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"),
        F.lit("video" if kind == "video" else "photo").alias("kind"), N.origin("ext", F.col("p.text")).alias("origin"), F.col("p.width").alias("width"), F.col("p.height").alias("height"),
    )


RECOGNITION = "path string, faces array<struct<embedding: array<float>, area: double>>, labels array<string>, pass string"


def recognition_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON that a recogniser wrote; broken lines are ignored."""
    return spark.read.schema(RECOGNITION).json(path, mode="DROPMALFORMED").filter("path is not null")


def fingerprint_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and phash (16 hex digits) from lines of JSON."""
    return spark.read.schema("path string, phash string, error string").json(path, mode="DROPMALFORMED").filter("path is not null").select("path", F.when(F.col("phash").rlike("^[0-9a-fA-F]{16}$"), F.col("phash")).alias("phash"))


def drives(text: str) -> list[str]:
    """Drive letters that a listing names, one a line."""
    return [x.strip() for x in text.splitlines() if len(x.strip()) == 2 and x.strip()[0].isascii() and x.strip()[0].isupper() and x.strip()[1] == ":"]


def sidecars(files: DataFrame, listing: DataFrame) -> DataFrame:
    """path and the files beside it with its stem and a sidecar's extension."""
    key = lambda p: (F.lower(N.dirname(p)).alias("_d"), F.lower(N.stem(N.basename(p))).alias("_s"))
    beside = listing.filter(N.extension("path").isin(*N.SIDECARS)).select(F.col("path").alias("sidecar"), *key("path"))
    return files.select("path", *key("path")).join(beside, ["_d", "_s"], "left").groupBy("path").agg(F.sort_array(F.collect_set("sidecar")).alias("sidecars"))


def camera_pairs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """path and the other formats of the same shot beside it."""
    key = lambda p: (F.lower(N.dirname(p)).alias("_d"), F.lower(N.stem(N.basename(p))).alias("_s"))
    wanted = F.create_map(*(x for e, o in N.CAMERA_PAIRS.items() for x in (F.lit(e), F.array(*map(F.lit, o)))))
    other = listing.select(F.col("path").alias("pair"), N.extension("path").alias("pair_ext"), *key("path"))
    mine = files.select("path", wanted[N.extension("path")].alias("wanted"), *key("path"))
    fits = F.array_contains("wanted", F.col("pair_ext")) & (F.lower("pair") != F.lower("path"))
    return mine.join(other, ["_d", "_s"], "left").groupBy("path").agg(F.sort_array(F.collect_set(F.when(fits, F.col("pair")))).alias("pairs"))
