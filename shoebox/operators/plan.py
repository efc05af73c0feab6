"""Plans of deletion, edits of groups, and reports. Nothing here deletes a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.formats import csv_cell
from ..functions.times import format_capture

# Why a file is not deleted.
SKIPPED = {
    "keepers": "这一组没有唯一的保留文件，已跳过", "keep_gone": "保留文件已经不在原处，这一组未删除", "keep_changed": "保留文件已变化，这一组未删除", "is_kept": "不能删除要保留的文件",
    "gone": "文件已经不在原处", "size": "文件大小已变化，未删除", "content": "文件内容已变化，未删除", "unlike": "无法确认这份文件和保留文件相同，未删除", "picture": "画面已经对不上，未删除",
}
HEADER = ("组", "处理", "来源", "操作", "文件名", "拍摄时间", "大小", "路径", "内容哈希")


def deletions(grouped: DataFrame, listing: DataFrame, rehash=None, max_distance: int | None = None, enabled: DataFrame | None = None, refingerprint=None) -> DataFrame:
    """Every file to delete of enabled groups, with reason null if it may go: path, path_key, size, group_id, reason.

    listing: path_key, size, mtime_ms of files as they are now. rehash: function of a path column that reads the content anew; only files whose time of change moved are
    read, and without it they stay. refingerprint: the same for pictures; files that are alike but not equal, and their kept ones, get new fingerprints and are compared within
    max_distance; without it they stay.
    """
    own = Window.partitionBy("group_id")
    rows = grouped if enabled is None else grouped.join(enabled.filter("enabled").select("group_id"), "group_id", "left_semi")
    now = listing.select("path_key", F.col("size").alias("now_size"), F.col("mtime_ms").alias("now_mtime"))
    rows = rows.join(now, "path_key", "left")
    is_keep = F.col("role") == "keep"
    of_keep = lambda c: F.max(F.when(is_keep, F.col(c))).over(own)
    rows = rows.withColumn("_keepers", F.count(F.when(is_keep, 1)).over(own))
    for c in ("path", "path_key", "size", "now_size", "hash"):
        rows = rows.withColumn(f"_keep_{c}", of_keep(c))
    same = F.coalesce((F.col("hash") == F.col("_keep_hash")), F.lit(False))
    moved = (F.abs(F.col("now_mtime") - F.col("mtime_ms")) > 2) & same
    rows = rows.filter("role = 'delete'")
    read = lambda paths, f, out: paths.dropDuplicates(["path"]).repartition("path").select(F.col("path").alias(f"_of{out}"), f("path").alias(out))
    if rehash:
        rows = rows.join(read(rows.filter(moved).select("path"), rehash, "_again"), F.col("path") == F.col("_of_again"), "left")
    else:
        rows = rows.withColumn("_again", F.lit(None).cast("string"))
    near = F.lit(False)
    if refingerprint and max_distance is not None:
        alike = rows.filter((F.col("kind") == "similar") & ~same & F.col("_keep_path").isNotNull())
        new = read(alike.select("path").union(alike.select("_keep_path")), refingerprint, "_print")
        rows = rows.join(new, F.col("path") == F.col("_of_print"), "left").drop("_of_print")
        rows = rows.join(new.select("_of_print", F.col("_print").alias("_keep_print")), F.col("_keep_path") == F.col("_of_print"), "left")
        near = F.bit_count(F.col("_keep_print").bitwiseXOR(F.col("_print"))) <= max_distance
    similar = (F.col("kind") == "similar") & F.lit(max_distance is not None)
    reason = (
        F.when(F.col("_keepers") != 1, SKIPPED["keepers"]).when(F.col("_keep_now_size").isNull(), SKIPPED["keep_gone"]).when(F.col("_keep_now_size") != F.col("_keep_size"), SKIPPED["keep_changed"])
        .when(F.col("path_key") == F.col("_keep_path_key"), SKIPPED["is_kept"]).when(F.col("now_size").isNull(), SKIPPED["gone"]).when(F.col("now_size") != F.col("size"), SKIPPED["size"])
        .when(moved & (F.coalesce("_again", F.lit("")) != F.col("_keep_hash")), SKIPPED["content"]).when(same, None).when(~similar, SKIPPED["unlike"]).when(~F.coalesce(near, F.lit(False)), SKIPPED["picture"])
    )
    return rows.select("path", "path_key", "size", "group_id", reason.alias("reason"))


def with_sidecars(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Columns + sidecars: of the files that may go, those beside them that go along."""
    from ..sources.files import sidecars

    go = plan.filter("reason is null").select("path").distinct()
    return plan.join(sidecars(go, listing), "path", "left").withColumn("sidecars", F.coalesce("sidecars", F.array().cast("array<string>")))


def enabled_totals(grouped: DataFrame) -> DataFrame:
    """One row: of enabled groups (enabled: a column) their number, the files to delete and the bytes to gain."""
    on = grouped.filter("enabled")
    gone = F.when(F.col("role") == "delete", F.col("size"))
    return on.agg(F.countDistinct("group_id").alias("groups"), F.count(gone).alias("files"), F.coalesce(F.sum(gone), F.lit(0)).alias("bytes"))


def freed_bytes(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("files"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("size"))), F.lit(0)).alias("freed_bytes"))


def without_paths(grouped: DataFrame, paths: DataFrame) -> DataFrame:
    """Groups without the given files: a group whose kept file went keeps its first, wasted is counted anew, groups of fewer than two go. ord: place in its group."""
    left = grouped.join(paths.select(F.lower("path").alias("path_key")).distinct(), "path_key", "left_anti")
    own = Window.partitionBy("group_id")
    touched = grouped.groupBy("group_id").agg(F.count("*").alias("_before"))
    rows = left.join(touched, "group_id").withColumn("_n", F.count("*").over(own)).withColumn("_keep", F.max((F.col("role") == "keep").cast("int")).over(own))
    first = F.row_number().over(own.orderBy("ord")) == 1
    role = F.when((F.col("_n") < F.col("_before")) & (F.col("_keep") == 0) & first, "keep").otherwise(F.col("role"))
    rows = rows.withColumn("role", role).filter("_n >= 2")
    wasted = F.coalesce(F.sum(F.when(F.col("role") == "delete", F.col("size"))).over(own), F.lit(0))
    return rows.withColumn("wasted", wasted).drop("_before", "_n", "_keep")


class RoleError(ValueError):
    """An edit of a role that is not allowed."""


def with_role(grouped: DataFrame, group_id: str, path: str, role: str) -> DataFrame:
    """A file's new role. Keeping one takes that role from the other; the kept file cannot lose it otherwise."""
    if role not in ("keep", "delete", "spare"):
        raise RoleError("no such role")
    key = path.lower()
    here = (F.col("group_id") == group_id) & (F.col("path_key") == key)
    now = grouped.filter(here).select("role").first()
    if now is None:
        raise RoleError("no such file")
    if role != "keep" and now["role"] == "keep":
        raise RoleError("another file must be kept first")
    demoted = (F.col("group_id") == group_id) & (F.col("role") == "keep") & F.lit(role == "keep")
    rows = grouped.withColumn("role", F.when(here, role).when(demoted, "delete").otherwise(F.col("role")))
    return rows.withColumn("wasted", F.coalesce(F.sum(F.when(F.col("role") == "delete", F.col("size"))).over(Window.partitionBy("group_id")), F.lit(0)))


def with_enabled(groups: DataFrame, enabled: bool, group_id: str | None = None) -> DataFrame:
    return groups.withColumn("enabled", F.when(F.lit(group_id is None) | (F.col("group_id") == F.lit(group_id)), enabled).otherwise(F.col("enabled")))


def latest(groups: DataFrame, version: str = "version") -> DataFrame:
    """Of groups that were given out several times, the last version."""
    rest = [c for c in groups.columns if c != "group_id"]
    return groups.groupBy("group_id").agg(F.max_by(F.struct(*rest), version).alias("g")).select("group_id", "g.*")


def visible(groups: DataFrame, kind: str = "all", media: str = "all") -> DataFrame:
    """Groups with files (array) of a kind (exact, similar) and class (photo, video, other: all files), by bytes to gain."""
    ext = lambda f: F.lower(f["ext"])
    photo = tuple(e for g in ("dslrRaw", "dslrJpeg", "applePhoto") for e in N.EXTENSIONS[g])
    all_in = lambda exts: F.forall("files", lambda f: ext(f).isin(*exts))
    df = groups if kind == "all" else groups.filter(F.col("kind") == kind)
    if media == "photo":
        df = df.filter(all_in(photo))
    elif media == "video":
        df = df.filter(all_in(N.EXTENSIONS["video"]))
    elif media == "other":
        df = df.filter(~all_in(photo) & ~all_in(N.EXTENSIONS["video"]))
    return df.orderBy(F.desc("wasted"), "group_id")


def report_lines(grouped: DataFrame) -> DataFrame:
    """line, in the order group_id, ord: the rows of the report."""
    origin = F.when(F.col("origin") == "original", "原始").when(F.col("origin") == "copy", "复制").otherwise("")
    action = F.when(F.col("role") == "keep", "保留").when(F.col("role") == "spare", "跳过").otherwise("移入回收站")
    cells = [F.col("group_id"), F.when(F.col("enabled"), "是").otherwise("否"), origin, action, F.col("name"), format_capture("capture_ms", "subsec_known"), F.col("size"), F.col("path"), F.col("hash")]
    return grouped.select("group_id", "ord", F.concat_ws(",", *(csv_cell(c) for c in cells)).alias("line"))


def write_report(grouped: DataFrame, file) -> None:
    """The report as UTF-8 with a byte order mark and CRLF, a row at a time through the driver: what a user opens in a spreadsheet."""
    file.write("﻿" + ",".join(f'"{h}"' for h in HEADER) + "\r\n")
    for row in report_lines(grouped).orderBy("group_id", "ord").select("line").toLocalIterator():
        file.write(row["line"] + "\r\n")
