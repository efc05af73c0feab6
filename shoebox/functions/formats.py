"""Texts for reports: sizes, shutter speeds, places, bit rates, cells of a CSV file, and a photo's description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col
from .times import pretty_time

# EXIF enumerations.
PROGRAM = {1: "手动", 2: "程序自动", 3: "光圈优先", 4: "快门优先", 5: "创意程序", 6: "运动模式", 7: "人像", 8: "风景"}
METERING = {1: "平均", 2: "中央重点", 3: "点测光", 4: "多点", 5: "多区域", 6: "局部"}


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def _n(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("double"), F.lit(0.0))


def _fixed(x: Column, digits: int, even: bool = False) -> Column:
    """The double itself, not its shortest text, rounded to so many digits; what lies in the middle goes away from zero, or with `even` to the even digit, as C's printf does.

    The fraction is cut in two, so that both parts times the scale are exact and the sign of their distance from the middle is too.
    """
    scale, cut, size = float(10**digits), float(1 << 26), F.abs(x)
    fraction = size - F.floor(size)
    high = F.floor(fraction * cut) / F.lit(cut)
    k = F.floor(high * scale)
    beyond = (high * scale - k - 0.5) + (fraction - high) * scale
    up = beyond + (k % 2) * 1e-300 > 0 if even else beyond >= 0
    n = F.floor(size) * int(scale) + k + up.cast("long")
    tail = (F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0")) if digits else ()
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.call_function("div", n, F.lit(int(scale))).cast("string"), *tail)
    return F.when(size < min(2.0**52, 2.0**62 / scale), text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)").cast("string")


def bytes_binary(size: Column | str, even: bool = False, gigabytes: bool = True) -> Column:
    """Steps of 1024: B, KB and MB with one digit, GB with two unless MB are the largest. even: what lies in the middle goes to the even digit."""
    n = _n(size)
    mega = F.concat(_fixed(n / 1024**2, 1, even), F.lit(" MB"))
    large = F.when(n < 1024**3, mega).otherwise(F.concat(_fixed(n / 1024**3, 2, even), F.lit(" GB"))) if gigabytes else mega
    return F.when(n < 1024, F.concat(_whole(n), F.lit(" B"))).when(n < 1024**2, F.concat(_fixed(n / 1024, 1, even), F.lit(" KB"))).otherwise(large)


def bytes_decimal(size: Column | str, even: bool = False) -> Column:
    """Steps of 1000: GB with two digits, MB with one, whole KB and B. even: what lies in the middle goes to the even digit."""
    n = _n(size)
    return F.when(n >= 1e9, F.concat(_fixed(n / 1e9, 2, even), F.lit(" GB"))).when(n >= 1e6, F.concat(_fixed(n / 1e6, 1, even), F.lit(" MB"))).when(n >= 1e3, F.concat(_whole(js_round(n / 1e3)), F.lit(" KB"))).otherwise(F.concat(_whole(n), F.lit(" B")))


def bytes_adaptive(size: Column | str) -> Column:
    """Steps of 1024 with fewer digits for larger numbers: none from 100, one from 10, two below; whole bytes."""
    n = _n(size)
    out = F.concat(_whole(n), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        v = n / float(1024**power)
        text = F.when(v >= 100, _fixed(v, 0)).when(v >= 10, _fixed(v, 1)).otherwise(_fixed(v, 2))
        out = F.when(v >= 1, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def bytes_compact(size: Column | str) -> Column:
    """Steps of 1024 without a space: whole KB, and MB to TB with one digit below 10 if it is not 0."""
    n = _n(size)
    out = F.when(n < 1024, F.concat(_whole(n), F.lit("B"))).otherwise(F.concat(_whole(F.greatest(F.lit(1), js_round(n / 1024))), F.lit("KB")))
    for power, unit in ((2, "MB"), (3, "GB"), (4, "TB")):
        v = n / float(1024**power)
        out = F.when(v >= 1, F.concat(F.when(v >= 10, _whole(js_round(v))).otherwise(trim_num(v)), F.lit(unit))).otherwise(out)
    return out


def trim_num(x: Column | str) -> Column:
    r = js_round(col(x) * 10) / 10
    return F.when(r == F.floor(r), _whole(r)).otherwise(_fixed(r, 1))


def shutter(seconds: Column | str) -> Column:
    s = col(seconds).cast("double")
    slow, fast = F.concat(trim_num(s), F.lit(" 秒")), F.concat(F.lit("1/"), _whole(F.greatest(F.lit(1), js_round(1 / s))), F.lit(" 秒"))
    return F.when(s.isNull() | F.isnan(s) | (s <= 0) | (s == float("inf")), "").when(s >= 1, slow).otherwise(fast)


def gps(latitude: Column | str, longitude: Column | str) -> Column:
    one = lambda x, plus, minus: F.concat(_fixed(F.abs(x), 5), F.lit("°"), F.when(x >= 0, plus).otherwise(minus))
    lat, lng = col(latitude), col(longitude)
    return F.when(lat.isNull() | lng.isNull(), "").otherwise(F.concat(one(lat, "N", "S"), F.lit("  "), one(lng, "E", "W")))


def bitrate(size: Column | str, seconds: Column | str) -> Column:
    s = col(seconds).cast("double")
    return F.when(s.between(0.1, 86400), js_round(col(size) * 8 / s)).otherwise(0).cast("long")


def bitrate_text(bits: Column | str) -> Column:
    k = _n(bits) / 1000
    return F.when(k < 1, "").when(k >= 1000, F.concat(_fixed(k / 1000, 1), F.lit(" Mbps"))).otherwise(F.concat(_whole(js_round(k)), F.lit(" kbps")))


def csv_cell(value: Column | str) -> Column:
    """Quoted; a cell that a spreadsheet would take for a formula gets an apostrophe."""
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def describe(photo: Column, facts: Column) -> Column:
    """ARRAY<STRUCT<label, value>> of a photo row and its facts, blanks left out. Both are structs."""
    p, f = photo, facts
    names = lambda values, x: F.create_map(*(F.lit(v) for kv in values.items() for v in kv))[x.cast("int")]
    width, height = F.coalesce(F.nullif(f["width"], F.lit(0)), p["width"]), F.coalesce(F.nullif(f["height"], F.lit(0)), p["height"])
    text = lambda x: x.cast("string")
    date = F.when(F.coalesce(p["year"], F.lit(0)) != 0, F.concat(text(p["year"]), F.lit("年"), text(p["month"]), F.lit("月"), text(p["day"]), F.lit("日")))
    unit = lambda x, before, after: F.when(x.isNotNull(), F.concat(F.lit(before), x, F.lit(after)))
    fields = [
        ("文件名", p["name"]), ("来源", F.when(p["origin"] == "camera", "相机拍摄").when(p["origin"] == "phone", "手机拍摄")), ("拍摄时间", F.coalesce(F.nullif(pretty_time(f["time"]), F.lit("")), date)),
        ("尺寸", F.when((width > 0) & (height > 0), F.concat(text(width), F.lit(" × "), text(height)))), ("大小", bytes_binary(p["size"])), ("相机", F.concat_ws(" ", F.nullif(f["make"], F.lit("")), F.nullif(f["model"], F.lit("")))), ("镜头", f["lens"]),
        ("光圈", unit(trim_num(f["aperture"]), "f/", "")), ("快门", shutter(f["exposure"])), ("感光度", unit(text(f["iso"]), "ISO ", "")), ("焦距", unit(trim_num(f["focal"]), "", " mm")), ("等效焦距", F.when(f["focal35"] > 0, unit(text(f["focal35"]), "", " mm"))),
        ("曝光补偿", F.when(f["bias"].isNotNull(), F.concat(F.when(f["bias"] > 0, "+").otherwise(""), trim_num(f["bias"]), F.lit(" EV")))), ("曝光程序", names(PROGRAM, f["program"])), ("测光", names(METERING, f["metering"])),
        ("闪光灯", F.when(f["flash"].isNotNull(), F.when(f["flash"].bitwiseAND(1) == 1, "闪光").otherwise("未闪光"))), ("白平衡", F.when(f["white_balance"].isNotNull(), F.when(f["white_balance"] == 0, "自动").otherwise("手动"))), ("位置", gps(f["latitude"], f["longitude"])),
        ("描述", f["description"]), ("作者", f["artist"]), ("版权", f["copyright"]), ("软件", f["software"]), ("文件夹", p["dir"]), ("星级", F.when(F.coalesce(p["rating"], F.lit(0)) > 0, F.concat(text(p["rating"]), F.lit(" 星")))),
    ]
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(text(v), F.lit("")).alias("value")) for k, v in fields)), lambda x: x["value"] != "")
