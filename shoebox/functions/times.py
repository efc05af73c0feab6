"""Wall-clock times as milliseconds of an epoch in UTC, parsed with the roll-over of calendar arithmetic (31 February is early March)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col, js_trim

# How Exif and ISO write times, the tags of XMP that hold one in order of priority, and what stands between a tag and its time.
EXIF = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
XMP_TAGS = ("exif:DateTimeOriginal", "xmp:CreateDate", "photoshop:DateCreated")
XMP_VALUE = r'(?:>|=")(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)'
LABELS = {"exif": "EXIF", "xmp": "XMP", "quicktime": "视频拍摄时间", "mvhd": "视频创建时间"}
NO_TIME = "无拍摄时间"


def wall_clock(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, fraction: Column | None = None) -> Column:
    """STRUCT<capture_ms, subsec_known>, null outside 1980-2100 and the fields' ranges."""
    y, mo, d, h, mi, s = (x.cast("int") for x in (y, mo, d, h, mi, s))
    digits = F.substring(F.regexp_replace(F.coalesce(fraction, F.lit("")), r"\D", ""), 1, 3) if fraction is not None else F.lit("")
    days = F.unix_date(F.make_date(y, mo, F.lit(1))).cast("long") + d - 1
    ms = ((days * 24 + h) * 60 + mi) * 60000 + s * 1000 + F.coalesce(F.rpad(digits, 3, "0").cast("int"), F.lit(0))
    ok = y.between(1980, 2100) & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 60)
    return F.when(ok, F.struct(ms.cast("long").alias("capture_ms"), (digits != "").alias("subsec_known")))


def _parsed(text: Column, pattern: str, fraction: Column) -> Column:
    x = js_trim(text)
    fields = [F.regexp_extract(x, pattern, i) for i in range(1, 7)]
    return F.when(x.rlike(pattern), wall_clock(*(F.nullif(f, F.lit("")) for f in fields), fraction))


def exif_date(text: Column | str, subsec: Column | str | None = None) -> Column:
    return _parsed(col(text), EXIF, col(subsec) if subsec is not None else F.lit(""))


def iso_date(text: Column | str) -> Column:
    """A zone's offset is ignored."""
    return _parsed(col(text), ISO, F.regexp_extract(js_trim(text), ISO, 7))


def xmp_date(text: Column | str) -> Column:
    """The first tag, in order of priority, whose time can be parsed."""
    return F.coalesce(*(iso_date(F.regexp_extract(col(text), tag + XMP_VALUE, 1)) for tag in XMP_TAGS))


def choose_exif(original: Column | str, digitized: Column | str, modified: Column | str, sub_original: Column | str, sub_digitized: Column | str, sub_modified: Column | str) -> Column:
    """The first date that is there, with its own fraction; if it can't be parsed, none."""
    there = lambda x: F.coalesce(col(x), F.lit("")) != ""
    return F.when(there(original), exif_date(original, sub_original)).when(there(digitized), exif_date(digitized, sub_digitized)).when(there(modified), exif_date(modified, sub_modified))


def timestamp(ms: Column | str) -> Column:
    return F.timestamp_millis(col(ms))


def parts(ms: Column | str, zone: str | None = None) -> Column:
    """STRUCT<year, month, day> in UTC or in a zone. The session's zone must be UTC."""
    t = timestamp(ms)
    t = F.from_utc_timestamp(t, zone) if zone else t
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"))


def format_capture(ms: Column | str, subsec: Column | str) -> Column:
    text = F.date_format(timestamp(ms), "yyyy-MM-dd HH:mm:ss")
    return F.when(col(ms).isNull(), NO_TIME).when(F.coalesce(col(subsec), F.lit(False)), F.concat(text, F.lit("."), F.lpad(F.pmod(col(ms), F.lit(1000)).cast("string"), 3, "0"))).otherwise(text)


def format_when(ms: Column | str, zone: str | None = None) -> Column:
    t = timestamp(ms)
    t = F.from_utc_timestamp(t, zone) if zone else t
    return F.when(F.coalesce(col(ms), F.lit(0)) == 0, "").otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))


def source_label(source: Column | str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.coalesce(col(source), F.lit(""))], F.lit(NO_TIME))


def pretty_time(text: Column | str) -> Column:
    return js_trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"))
