"""The duplicate funnel: size, family and name, then capture time, then content, then pictures' fingerprints.

Groups are kept in long form, a row for each file with the id of its group; `nested` makes arrays at the edge. Steps whose order matters run per bucket
in grouped-map functions, on rows in the order of seq; everything else is windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .stages import Stages


@dataclass(frozen=True)
class ScanOptions:
    name_mode: str = "normalized"
    tolerance_sec: float = 0
    match_without_time: bool = True
    similar: bool = False
    similar_distance: int = 4

    def tolerance(self) -> float:
        return min(120, max(0, self.tolerance_sec))

    def distance(self) -> int:
        return min(12, max(0, self.similar_distance))


def by_groups(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f over the rows of each group. Groups stream through a task in the order of their keys, so a call costs little for each and one group is in memory at a time."""

    def key(rows: pd.DataFrame) -> list:
        return [None if pd.isna(v) else v for v in (rows[k].iloc[0] for k in keys)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last group so far
        for rows in batches:
            parts = [g for _, g in rows.groupby(keys, sort=False, dropna=False)]
            if held and parts and key(held[0]) == key(parts[0]):
                held.append(parts.pop(0))
            for part in parts:
                if held:
                    yield f(pd.concat(held))
                held = [part]
        if held:
            yield f(pd.concat(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


#: Rows of small groups that are handled together.
TOGETHER = 1 << 14


def by_whole_groups(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    """f over the rows of many whole groups at once, those of one group one behind the other; key is never null. Small groups cost their rows, not a call each; only a group of more rows than TOGETHER is more in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, enough = [], 0, TOGETHER
        for rows in batches:
            held.append(rows)
            n += len(rows)
            if n >= enough:
                whole = pd.concat(held, ignore_index=True)
                own = whole[key].to_numpy()
                last = int(np.searchsorted(np.cumsum(own[1:] != own[:-1]), (own[1:] != own[:-1]).sum())) + 1 if (own != own[0]).any() else 0
                if last:
                    yield f(whole.iloc[:last].reset_index(drop=True))
                held, n = [whole.iloc[last:]], len(whole) - last
                enough = max(TOGETHER, 2 * n)
        if n:
            yield f(pd.concat(held, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def by_cells(df: DataFrame, keys: tuple[str, str], f, schema: str) -> DataFrame:
    """The record batches that f makes, one by one, of each group's rows as an Arrow table. Keys are two whole numbers; one group is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of the last group so far
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            own = np.stack([rows.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and last != tuple(own[:, a].tolist()):
                    yield from f(pa.concat_tables(held))
                    held = []
                last = tuple(own[:, a].tolist())
                held.append(rows.slice(a, b - a))
        if held:
            yield from f(pa.concat_tables(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def with_blocks(files: DataFrame, mode: str = "normalized") -> DataFrame:
    """Columns + block: which files share size, family and name key; null for a file that shares them with none."""
    keyed = files.withColumn("_family", N.family("ext")).withColumn("_key", N.name_key("name", mode))
    alike = Window.partitionBy("size", "_family", "_key")
    return keyed.withColumn("_n", F.count("*").over(alike)).withColumn("block", F.when(F.col("_n") >= 2, F.xxhash64("size", "_family", "_key"))).drop("_n", "_family", "_key")


def with_keys(files: DataFrame, mode: str = "normalized") -> DataFrame:
    """Columns + block: the same number for files of one size, family and name key, whether or not there are others."""
    return files.withColumn("block", F.xxhash64("size", N.family("ext"), N.name_key("name", mode)))


def pregroup(files: DataFrame, mode: str = "normalized") -> DataFrame:
    """Files that share size, family and name key with another one; block tells which share."""
    return with_blocks(files, mode).filter("block is not null")


def time_islands(df: DataFrame, ms: str, gap_ms: int | Column, *by: str, out: str = "island") -> DataFrame:
    """Number the runs of times that follow each other within the gap; null times have none."""
    w = Window.partitionBy(*by).orderBy(ms)
    gap = gap_ms if isinstance(gap_ms, Column) else F.lit(gap_ms)
    fresh = (F.col(ms) - F.lag(ms).over(w) > gap).cast("int")
    known = df.filter(F.col(ms).isNotNull()).withColumn("_fresh", F.coalesce(fresh, F.lit(1)))
    return known.withColumn(out, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def _islands(ms: np.ndarray, gap: float) -> np.ndarray:
    order = np.argsort(ms, kind="stable")
    label = np.empty(len(ms), int)
    label[order] = np.cumsum(np.concatenate(([0], np.diff(ms[order]) > gap)))[: len(ms)]
    return label


def cluster_by_capture(rows: pd.DataFrame, tolerance: float) -> list[list[int]]:
    """Positions of the files of each time cluster of two or more; rows in walking order, with capture_ms and subsec_known.

    Times with fractions chain within the tolerance. A whole-second time joins the one cluster whose members all match it, and is a member
    from then on; where several match, or none, whole seconds chain among themselves.
    """
    return _clusters(*_times(rows), tolerance)


def _times(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["capture_ms"].to_numpy(dtype=float), rows["subsec_known"].fillna(False).to_numpy(dtype=bool)


def _clusters(ms: np.ndarray, sub: np.ndarray, tolerance: float) -> list[list[int]]:
    known, loose = np.flatnonzero(~np.isnan(ms) & sub), np.flatnonzero(~np.isnan(ms) & ~sub)
    whole = max(0, int(np.floor(tolerance + 0.5)))
    groups: dict[int, list[int]] = {}
    for i, g in zip(known.tolist(), _islands(ms[known], tolerance * 1000).tolist(), strict=True):
        groups.setdefault(g, []).append(i)
    span = {g: (ms[m].min() // 1000, ms[m].max() // 1000) for g, m in groups.items()}
    rest = []
    for i in loose.tolist():
        s = ms[i] // 1000
        hits = [g for g, (lo, hi) in span.items() if abs(lo - s) <= whole and abs(hi - s) <= whole]
        if len(hits) == 1:
            groups[hits[0]].append(i)
            lo, hi = span[hits[0]]
            span[hits[0]] = (min(lo, s), max(hi, s))
        else:
            rest.append(i)
    out = list(groups.values())
    if rest:
        labels = _islands(ms[rest] // 1000, whole)
        out += [[rest[j] for j in np.flatnonzero(labels == k)] for k in range(labels.max() + 1)]
    return [g for g in out if len(g) >= 2]


def time_groups(blocked: DataFrame, o: ScanOptions = ScanOptions()) -> DataFrame:
    """Files of each time group of a block, and of each block's files without a time if there are two; columns + time_group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.schema) + ", time_group string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # blocks stay together in their order; within one, rows are in walking order
        rows = rows.assign(_nth=(rows["block"] != rows["block"].shift()).cumsum()).sort_values(["_nth", "seq", "path"]).drop(columns="_nth").reset_index(drop=True)
        block = rows["block"].to_numpy()
        ms, sub = _times(rows)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(rows)]
        at, names = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            groups = _clusters(ms[a:b], sub[a:b], o.tolerance())
            missing = np.flatnonzero(np.isnan(ms[a:b])).tolist()
            if o.match_without_time and len(missing) >= 2:
                groups.append(missing)
            for k, g in enumerate(groups):
                at += [a + i for i in g]
                names += [f"{block[a]}:{k}"] * len(g)
        return rows.iloc[at].assign(time_group=pd.Series(names, dtype=str).to_numpy(dtype=object))

    return by_whole_groups(blocked, "block", run, schema)


def exact_groups(timed: DataFrame, *by: str) -> DataFrame:
    """Files of equal content within each of `by`; group_id names the group. Files without a hash are left out."""
    w = Window.partitionBy(*by, "hash")
    grouped = timed.filter(F.col("hash").isNotNull()).withColumn("_n", F.count("*").over(w)).filter("_n >= 2").drop("_n")
    return grouped.withColumn("group_id", F.concat(F.lit("e"), F.hex(F.xxhash64(*by, "hash"))))


def has_camera_pair(*by: str) -> Column:
    """Whether a window of files in one directory with one stem holds a raw file and a rendered one."""
    w = Window.partitionBy(*by, F.lower(N.dirname("path")), N.exact_key("name"))
    return F.max(N.is_raw("ext").cast("int")).over(w).cast("boolean") & F.max(N.is_rendered("ext").cast("int")).over(w).cast("boolean")


def without_camera_pairs(grouped: DataFrame, group: str = "group_id", marked: bool = False) -> DataFrame:
    """Groups with a camera's raw and rendered file of one shot, split to raw and other files; parts of one file are dropped, or kept with skipped set if marked. Columns + part."""
    pair = grouped.withColumn("_pair", has_camera_pair(group))
    mixed = F.max(F.col("_pair").cast("int")).over(Window.partitionBy(group)) == 1
    part = F.when(mixed, N.is_raw("ext").cast("int")).otherwise(F.lit(2))
    sized = pair.withColumn("part", part).withColumn("_mixed", mixed).withColumn("_n", F.count("*").over(Window.partitionBy(group, "part")))
    skipped = sized.withColumn("skipped", (F.col("_n") < 2) & F.col("_mixed")).drop("_pair", "_mixed", "_n")
    return skipped if marked else skipped.filter("not skipped").drop("skipped")


def _nearest_points(asked: DataFrame, points: DataFrame, width: int, by: tuple[str, ...], forward: bool) -> DataFrame:
    """Columns of asked (by, x) + found: the first point at or after x, or the last one at or before it, at most width away.

    An equal or adjacent bin of that width holds it: a window within each bin, and a join with what the adjacent bin begins (or ends) with.
    """
    bin_ = F.floor(F.col("x") / width)
    both = asked.select(*by, "x", F.lit(None).cast("long").alias("p")).unionByName(points.select(*by, F.col("s").alias("x"), F.col("s").alias("p"))).withColumn("_bin", bin_)
    w = Window.partitionBy(*by, "_bin").orderBy(F.desc("x") if forward else F.asc("x"))
    near = both.withColumn("own", F.min("p").over(w) if forward else F.max("p").over(w)).filter("p is null")
    edge = points.groupBy(*by, F.floor(F.col("s") / width).alias("_bin")).agg((F.min("s") if forward else F.max("s")).alias("other"))
    beside = edge.withColumn("_bin", F.col("_bin") + (-1 if forward else 1))
    found = F.coalesce("own", "other")
    reach = F.when(F.abs(found - F.col("x")) <= width, found)
    return near.join(beside, [*by, "_bin"], "left").select(*by, "x", reach.alias("found"))


#: A panel is as many tolerances of time, two at least: what one task folds at once.
PANEL = 1024


def _panel_exits(rows: pd.DataFrame, tol: int, panel: int) -> pd.DataFrame:
    """Of the seconds at which a panel may be entered, and of its sure starts, where the chain of buckets from there leaves the panel."""
    rows = rows.sort_values("s")
    s, to, sure = rows["s"].to_numpy(), rows["to"].fillna(-1).to_numpy(dtype=np.int64), rows["sure"].to_numpy(dtype=bool)
    known = rows["to"].notna().to_numpy()
    at = np.searchsorted(s, to)
    left = np.full(len(s), -1, np.int64)  # the row whose jump leaves the panel, -1 if none does
    for i in range(len(s) - 1, -1, -1):
        if known[i]:
            left[i] = i if at[i] == len(s) else -1 if sure[at[i]] else left[at[i]]
    begin = s[0] // (panel * tol) * panel * tol
    told = ((s < begin + 2 * tol) | sure) & (left >= 0)
    return rows[told].assign(beyond=to[left[told]])


def _panel_starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The starts of a panel, from the sure ones and the one at which it is entered."""
    rows = rows.sort_values("s")
    s, begins = rows["s"].to_numpy(), rows["sure"].to_numpy(dtype=bool) | rows["entered"].to_numpy(dtype=bool)
    known = rows["to"].notna().to_numpy()
    at = np.searchsorted(s, rows["to"].fillna(-1).to_numpy(dtype=np.int64))
    for i in range(len(s)):
        if begins[i] and known[i] and at[i] < len(s):
            begins[at[i]] = True
    return rows[begins]


def bucket_starts(seconds: DataFrame, tol: int, stages: Stages, *by: str, panel: int = PANEL) -> DataFrame:
    """Of distinct seconds (by, s) the start of each one's bucket: (by, s, start). A bucket begins with its first second and lasts for the tolerance; the next one begins with the first second beyond.

    After a gap over the tolerance a bucket surely begins. Every other start is the successor of a start, the first second beyond its tolerance, so starts are what is reached from the sure ones. Within a panel of time a
    task follows the chain; from panel to panel pointers are squared round by round, so the rounds are the logarithm of the most panels between two gaps. No step orders more than one panel.
    """
    if tol == 0:
        return seconds.withColumn("start", F.col("s"))
    before = _nearest_points(seconds.select(*by, (F.col("s") - 1).alias("x")), seconds, tol, by, forward=False)
    sure = before.select(*by, (F.col("x") + 1).alias("s"), (F.col("found").isNull() | (F.col("x") + 1 - F.col("found") > tol)).alias("sure"))
    # within a run the next second beyond the tolerance is less than a tolerance further
    after = _nearest_points(seconds.select(*by, (F.col("s") + tol + 1).alias("x")), seconds, tol, by, forward=True)
    jump = after.select(*by, (F.col("x") - tol - 1).alias("s"), F.col("found").alias("to"))
    steps = stages.put(sure.join(jump, [*by, "s"]).withColumn("_panel", F.floor(F.col("s") / (panel * tol))), "steps")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema)
    own, keys = [*by, "s"], [*by, "_panel"]
    exits = stages.put(by_groups(steps, keys, lambda rows: _panel_exits(rows, tol, panel), f"{kinds}, beyond bigint"), "exits", chains=F.count(F.when(~F.col("sure"), 1)), sure_exits=F.count(F.when(F.col("sure"), 1)))
    entered = exits.filter("sure").select(*by, F.col("beyond").alias("s")).distinct()
    if stages.counts["sure_exits"]:
        entered, leap = stages.put(entered, "entered"), exits.filter("not sure").select(*by, "s", "beyond")
        while stages.counts["chains"]:
            reached = entered.join(leap, own).select(*by, F.col("beyond").alias("s"))
            entered = stages.put(entered.unionByName(reached).distinct(), "entered")
            onward = leap.select(*by, F.col("s").alias("beyond"), F.col("beyond").alias("_next"))
            leap = stages.put(leap.join(onward, [*by, "beyond"]).select(*by, "s", F.col("_next").alias("beyond")), "leaps", chains=F.count("*"))
    marked = steps.join(entered.withColumn("entered", F.lit(True)), own, "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    starts = stages.put(by_groups(marked, keys, _panel_starts, f"{kinds}, entered boolean").select(*by, "s"), "starts")
    last = _nearest_points(seconds.select(*by, F.col("s").alias("x")), starts, tol, by, forward=False)
    return last.select(*by, F.col("x").alias("s"), F.col("found").alias("start"))


def anchored_buckets(timed: DataFrame, tolerance_sec: float, *by: str, stages: Stages | None = None, panel: int = PANEL) -> DataFrame:
    """Buckets of whole seconds that begin with their first file and last for the tolerance; those of two or more. Columns + bucket. Without keys all files form one sequence; it is never in one task.

    Rows meet their bucket by their second; whether a bucket has two is counted on seconds, not on rows.
    """
    tol = max(0, int(np.floor(tolerance_sec + 0.5)))
    stages = stages or Stages(timed.sparkSession)
    second = F.floor(F.col("capture_ms") / 1000).cast("long")
    rows = timed.filter("capture_ms is not null").withColumn("_s", second)
    seconds = stages.put(rows.groupBy(*by, F.col("_s").alias("s")).agg(F.count("*").alias("n")), "seconds")
    placed = seconds.join(bucket_starts(seconds.select(*by, "s"), tol, stages, *by, panel=panel), [*by, "s"])
    shared = placed.groupBy(*by, "start").agg(F.sum("n").alias("n")).filter("n >= 2").select(*by, "start")
    own = stages.put(placed.join(shared, [*by, "start"]).select(*by, F.col("s").alias("_s"), "start"), "buckets")
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in by), F.col("start").cast("string"))
    return rows.join(own, [*by, "_s"]).withColumn("bucket", name).select(*timed.columns, "bucket")


#: Up to this distance a group's first fingerprint is looked up by the bands that it must share one of, beyond it all are compared.
LOOKED_UP = 11


def first_fit(paths: list[str], prints: list[int], distance: int) -> list[list[int]]:
    """Positions of greedy groups: by path, each joins the first group all of whose members are near; those of two or more.

    A fingerprint that came before goes where it went: its group is near as a whole, and earlier groups, which only grow, still are not. A new one asks the groups whose first member is near.
    """
    mask = (1 << 64) - 1
    groups: list[list[int]] = []
    members: list[list[int]] = []  # different fingerprints of each group
    went: dict[int, int] = {}
    first = np.zeros(64, np.uint64)
    cuts = [64 * k // (distance + 1) for k in range(distance + 2)] if distance <= LOOKED_UP else []
    bands = [(lo, (1 << hi - lo) - 1, {}) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    for i in sorted(range(len(paths)), key=lambda i: paths[i]):
        p = prints[i] & mask
        g = went.get(p)
        if g is None:
            lists = [found.get(p >> lo & ones, ()) for lo, ones, found in bands]
            if not bands or 64 + sum(map(len, lists)) * 50 > len(groups) + 500:
                asked = np.flatnonzero(np.bitwise_count(first[: len(groups)] ^ np.uint64(p)) <= distance).tolist()
            else:
                asked = sorted({k for some in lists for k in some if (members[k][0] ^ p).bit_count() <= distance})
            g = next((k for k in asked if all((p ^ q).bit_count() <= distance for q in members[k])), len(groups))
            went[p] = g
            if g == len(groups):
                groups.append([])
                members.append([])
                if len(first) < len(groups):
                    first = np.concatenate((first, np.zeros_like(first)))
                first[g] = p
                for lo, ones, found in bands:
                    found.setdefault(p >> lo & ones, []).append(g)
            members[g].append(p)
        groups[g].append(i)
    return [g for g in groups if len(g) >= 2]


def phash_clusters(bucketed: DataFrame, distance: int, bucket: str = "bucket") -> DataFrame:
    """Complete-linkage groups of pictures in each bucket; phash is a 64-bit number, null ones are left out. Columns + cluster."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bucketed.schema) + ", cluster string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        groups = first_fit(rows["path"].tolist(), [int(x) for x in rows["phash"]], distance)
        parts = [rows.iloc[g].assign(cluster=f"{rows[bucket].iloc[0]}/{k}") for k, g in enumerate(groups)]
        return pd.concat(parts) if parts else rows.iloc[:0].assign(cluster=pd.Series(dtype=str))

    return by_groups(bucketed.filter("phash is not null"), [bucket], run, schema)


def _banding(distance: int, bits: int = 64, most: int = 1000) -> tuple[int, int, list[int]]:
    """Bands of so many bits, their width, and the changes that a band's value is looked up with: the choice that meets the fewest values.

    Fingerprints within the distance differ in at most distance // bands bits of some band, so one of these changes makes its values equal.
    """
    best = None
    for bands in range(1, 17):
        width, slack = bits // bands, distance // bands
        flips = sum(comb(width, i) for i in range(slack + 1))
        cost = bands * flips * (1 + 1e6 / 2**width)
        if flips <= most and (best is None or cost < best[0]):
            best = cost, bands, width, slack
    if best is None:
        raise ValueError(f"no bands of {bits} bits tell fingerprints at that distance apart")
    _, bands, width, slack = best
    return bands, width, [sum(1 << k for k in ks) for i in range(slack + 1) for ks in combinations(range(width), i)]


#: A band's value that more different fingerprints have is split by bands of the other bits.
CROWDED = 256


def _band_values(of: Column, bands: int, width: int) -> Column:
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return F.array(*(F.shiftrightunsigned(of, i * width).bitwiseAND(mask) for i in range(bands)))


def _changed(value: str, flips: list[int]) -> Column:
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda f: F.col(value).bitwiseXOR(f))


def looked_up(prints: DataFrame, distance: int, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Different fingerprints p under their bands' values, and as p2 under all values to look for: (band, v, part, u). Two within the distance meet under one of them.

    Where more than `crowded` fingerprints share a value, part and u are a band of the other bits and its value: two fingerprints within the distance differ in no more bits there, so the same rule holds again.
    Elsewhere part is -1. Which values are crowded is counted first.
    """
    bands, width, flips = _banding(distance)
    left = prints.select("p", F.posexplode(_band_values(F.col("p"), bands, width)).alias("band", "v"))
    right = left.select(F.col("p").alias("p2"), "band", F.explode(_changed("v", flips)).alias("v"))
    other = 64 - width
    if distance >= other:  # the other bits tell nothing apart
        whole = (F.lit(-1).alias("part"), F.lit(0).cast("long").alias("u"))
        return left.select("*", *whole), right.select("*", *whole)
    parts, part_width, part_flips = _banding(distance, other)
    crowd = left.groupBy("band", "v").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).select("band", "v", F.lit(True).alias("_crowded"))

    def split(rows: DataFrame, p: str) -> DataFrame:
        turn = (F.col("band") + 1) * width % 64  # the band's own bits come last
        rest = F.when(turn == 0, F.col(p)).otherwise(F.call_function("shiftrightunsigned", F.col(p), turn).bitwiseOR(F.call_function("shiftleft", F.col(p), 64 - turn)))
        values = F.when(F.col("_crowded"), _band_values(rest, parts, part_width)).otherwise(F.array(F.lit(0).cast("long")))
        told = rows.join(crowd, ["band", "v"], "left").select(p, "band", "v", "_crowded", F.posexplode(values).alias("part", "u"))
        return told.withColumn("part", F.when(F.col("_crowded"), F.col("part")).otherwise(-1))

    asked = split(right, "p2").withColumn("u", F.explode(F.when(F.col("_crowded"), _changed("u", part_flips)).otherwise(F.array("u"))))
    return split(left, "p").drop("_crowded"), asked.drop("_crowded")


#: Rows of a block of fingerprints, and the least number of blocks; and pairs that a task holds at once.
PRINTS_BLOCK, PRINTS_BLOCKS, PAIRS_BLOCK = 1 << 16, 8, 1 << 20
#: Bands whose values two unlike fingerprints share more often than this are of no use: all pairs are compared.
SELECTIVE = 1 / 256


def _near(left: np.ndarray, right: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left and in right of all pairs within the distance, and how far they are, tile by tile."""
    high, wide = 128, 4096
    x, d = np.empty((high, wide), np.uint64), np.empty((high, wide), np.uint8)
    for i in range(0, len(left), high):
        for j in range(0, len(right), wide):
            a, b = left[i : i + high, None], right[None, j : j + wide]
            bits, far = x[: a.shape[0], : b.shape[1]], d[: a.shape[0], : b.shape[1]]
            np.bitwise_count(np.bitwise_xor(a, b, out=bits), out=far)
            at = np.flatnonzero(far <= distance)
            if len(at):
                k, m = np.divmod(at, b.shape[1])
                yield i + k, j + m, far[k, m]


def _all_near_pairs(base: DataFrame, distance: int) -> DataFrame:
    """near_pairs by comparing all fingerprints (k, p): blocks meet in cells, each pair of blocks in one, and in a cell different fingerprints meet once. A task has two blocks and a bounded number of pairs at a time, and pairs never travel."""
    n = max(PRINTS_BLOCKS, base.count() // PRINTS_BLOCK + 1)
    block = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    dealt = base.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = dealt.select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") <= F.col("_o")).alias("_left"), "k", "p")

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = rows.column("_i")[0] == rows.column("_j")[0]
        left = rows.filter(rows.column("_left"))
        right = left if own else rows.filter(pc.invert(rows.column("_left")))
        (keys, at, begin), (others, to, start) = ((side.column("k").combine_chunks(), *_grouped(side.column("p").to_numpy().view(np.uint64))) for side in (left, right))
        for i, j, far in _near(at, to, distance):
            for a, b in _runs((begin[1][i + 1] - begin[1][i]) * (start[1][j + 1] - start[1][j])):
                x, y, d = _products(begin, start, i[a:b], j[a:b], far[a:b])
                for c in range(0, len(x), PAIRS_BLOCK):
                    u, v, w = x[c : c + PAIRS_BLOCK], y[c : c + PAIRS_BLOCK], d[c : c + PAIRS_BLOCK]
                    if own:
                        once = u < v
                        u, v, w = u[once], v[once], w[once]
                    yield pa.record_batch([keys.take(pa.array(u)), others.take(pa.array(v)), pa.array(w.astype(np.int32))], ["k", "k2", "distance"])

    kind = base.schema["k"].dataType.simpleString()
    near = by_cells(cells, ("_i", "_j"), run, f"k {kind}, k2 {kind}, distance int")
    return near.filter("k <> k2").select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), "distance")


#: Rows of equal fingerprints that stand as one.
ALIKE = 1 << 10


def _grouped(values: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Different values, one for each 1,024 of its rows, and the places of these: all places in the order of their values, and where each one's begin."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(values)]
    nth = np.arange(len(values)) - np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    first = np.flatnonzero(nth % ALIKE == 0)
    return ranked[first], (order, np.append(first, len(values)))


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose sizes add up to about a block."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(int(np.searchsorted(upto, upto[a] + PAIRS_BLOCK, "right")) - 1, a + 1)
        yield a, b
        a = b


def _products(begin: tuple[np.ndarray, np.ndarray], start: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each pair of values: every row of the one with every row of the other."""
    wide = start[1][j + 1] - start[1][j]
    sizes = (begin[1][i + 1] - begin[1][i]) * wide
    pair = np.repeat(np.arange(len(i)), sizes)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return begin[0][begin[1][i][pair] + nth // wide[pair]], start[0][start[1][j][pair] + nth % wide[pair]], far[pair]


def near_pairs(prints: DataFrame, distance: int, key: str = "path", phash: str = "phash", crowded: int = CROWDED) -> DataFrame:
    """Pairs a < b of 64-bit fingerprints within the distance, each once, through an equi-join of bands of bits, and of bands of the other bits where many share a value.

    Each different fingerprint is looked for once, however many rows have it; its rows meet those of its neighbours at the end. At distances whose bands tell too little apart all pairs are compared in blocks instead.
    """
    base = prints.select(F.col(key).alias("k"), F.col(phash).alias("p")).filter("p is not null")
    bands, width, flips = _banding(distance)
    if bands * len(flips) / 2**width > SELECTIVE:
        return _all_near_pairs(base, distance)
    left, right = looked_up(base.select("p").distinct(), distance, crowded)
    d = F.bit_count(F.col("p").bitwiseXOR(F.col("p2")))
    near = left.join(right, ["band", "v", "part", "u"]).filter((F.col("p") < F.col("p2")) & (d <= distance)).select("p", "p2", d.cast("int").alias("distance")).distinct()
    other = base.select(F.col("k").alias("k2"), F.col("p").alias("p2"))
    apart = base.join(near, "p").join(other, "p2").filter("k <> k2").select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), "distance")
    equal = base.join(other, F.col("p") == F.col("p2")).filter("k < k2").select(F.col("k").alias("a"), F.col("k2").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(equal)


def similar_parts(parts: DataFrame, exact: DataFrame) -> DataFrame:
    """What becomes of each part of similar files (part_id, path): its files with group_id, joining an exact group or forming a new one.

    With no file in an exact group, all form a new one; with one such group, the other files join it; with several, the other files
    form a new one if they are two. exact: path, group_id.
    """
    w = Window.partitionBy("part_id")
    joined = parts.join(exact.select("path", F.col("group_id").alias("anchor")), "path", "left")
    anchors = F.size(F.collect_set("anchor").over(w))
    fresh = F.sum(F.col("anchor").isNull().cast("int")).over(w)
    only = F.max("anchor").over(w)
    state = joined.withColumn("_anchors", anchors).withColumn("_fresh", fresh).withColumn("_only", only)
    new = F.concat(F.lit("s"), F.col("part_id").cast("string"))
    group = (
        F.when(F.col("_fresh") == 0, None)
        .when(F.col("_anchors") == 0, new)
        .when(F.col("anchor").isNotNull(), None)
        .when(F.col("_anchors") == 1, F.col("_only"))
        .when(F.col("_fresh") >= 2, new)
    )
    return state.withColumn("group_id", group).filter("group_id is not null").drop("anchor", "_anchors", "_fresh", "_only")


def keep_order() -> list[Column]:
    """Files that look original first, then the shorter path, the later change, the path's place in an alphabet."""
    original = (N.exact_key("name") == N.normalize_key("name")).cast("int")
    return [original.desc(), N.js_length("path").asc(), F.col("mtime_ms").asc(), F.collate(F.col("path"), "UNICODE").asc(), F.col("path").asc()]


def with_roles(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """Columns + role: the first in keep order is kept, the others are to delete."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*keep_order()))
    return grouped.withColumn("_r", first).withColumn("role", F.when(F.col("_r") == 1, "keep").otherwise("delete")).drop("_r")


# Reasons of an origin.
REASONS = {
    "earliest": "这组里最早出现的文件", "plain": "文件名没有副本标记，也是更早的一份", "named": "文件名带有副本、(1) 或 copy",
    "later": "文件创建时间更晚，是后来复制的", "unclear": "文件名和创建时间都接近，看不出先后",
}


def with_origins(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """Columns + origin (original, copy, same) and origin_reason."""
    copy = N.is_copy_name("name")
    born = F.when(F.coalesce("birthtime_ms", F.lit(0)) > 0, F.col("birthtime_ms")).otherwise(F.coalesce("mtime_ms", F.lit(0)))
    rows = grouped.withColumn("_copy", copy).withColumn("_born", born)
    order = Window.partitionBy(group).orderBy(F.col("_copy").cast("int"), "_born", N.js_length("path"), F.collate(F.col("path"), "UNICODE"), "path")
    rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("_first", F.first("_born").over(order))
    origin = F.when(F.col("_r") == 1, "original").when(F.col("_copy") | (F.col("_born") >= F.col("_first") + 2000), "copy").otherwise("same")
    reason = (
        F.when((F.col("_r") == 1) & F.col("_copy"), REASONS["earliest"]).when(F.col("_r") == 1, REASONS["plain"])
        .when(F.col("_copy"), REASONS["named"]).when(F.col("_born") >= F.col("_first") + 2000, REASONS["later"]).otherwise(REASONS["unclear"])
    )
    return rows.withColumn("origin", origin).withColumn("origin_reason", reason).drop("_copy", "_born", "_r", "_first")


def with_totals(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """Columns + wasted: bytes to delete in the group."""
    wasted = F.coalesce(F.sum(F.when(F.col("role") == "delete", F.col("size"))).over(Window.partitionBy(group)), F.lit(0))
    return grouped.withColumn("wasted", wasted)


def nested(grouped: DataFrame, group: str = "group_id") -> DataFrame:
    """A row for each group, with its files as an array in keep order."""
    files = [c for c in grouped.columns if c not in (group, "wasted", "kind", "group_distance")]
    rank = F.row_number().over(Window.partitionBy(group).orderBy((F.col("role") != "keep").cast("int"), *keep_order()))
    extra = [F.first(c).alias(c) for c in ("wasted", "kind", "group_distance") if c in grouped.columns]
    rows = grouped.withColumn("_r", rank).groupBy(group).agg(*extra, F.array_sort(F.collect_list(F.struct("_r", *files))).alias("files"))
    return rows.withColumn("files", F.transform("files", lambda f: f.dropFields("_r")))


def summary(grouped: DataFrame) -> DataFrame:
    """One row: groups, files to delete, bytes to gain."""
    return grouped.agg(F.countDistinct("group_id").alias("groups"), F.count(F.when(F.col("role") == "delete", 1)).alias("deletable_files"), F.coalesce(F.sum(F.when(F.col("role") == "delete", F.col("size"))), F.lit(0)).alias("wasted_bytes"))


def scan(media: DataFrame, o: ScanOptions = ScanOptions(), source: str = "path", hasher=None, reader=None, printer=None, stages: Stages | None = None) -> DataFrame:
    """All stages over media files with seq: groups in long form with role, origin, wasted, kind and distance.

    hasher, reader and printer give the hash, the capture time and, for similar pictures, the fingerprint of column `source`; columns that are there already are used as they are. Each stage is written before the next one
    reads it, so media is read once and each file by each of the three at most once: times of candidates, and of all pictures if similar ones are looked for; hashes of time groups; fingerprints of pictures in a bucket of two or more.

    stages: where they are written; its counts are the run's counters (see run_counters), and closing it deletes the result too.
    """
    from ..sources import files as S

    stages = stages or Stages(media.sparkSession)
    hasher, reader, printer = hasher or S.content_hash, reader or S.capture, printer or S.phash_embedded
    picture, seen = ~N.is_video("ext"), media.columns
    wanted = with_blocks(media, o.name_mode)
    asked = F.col("block").isNotNull() | (picture if o.similar else F.lit(False))
    listed = stages.put(wanted.filter(asked), "listed", candidates=F.count("block"))
    counts = {}
    if "capture_ms" not in seen:
        listed = listed.withColumn("_c", reader(source, "ext")).select("*", "_c.capture_ms", "_c.subsec_known", F.col("_c.source").alias("capture_source"), F.col("_c.bytes_read").alias("_bytes")).drop("_c")
        counts = {"meta_bytes": F.sum("_bytes"), "meta_files": F.count("*")}
    known = stages.put(listed, "known", **counts).drop("_bytes") if counts else listed
    timed = time_groups(known.filter("block is not null"), o)
    if "hash" not in seen:
        timed = timed.withColumn("hash", hasher(source))
    timed = stages.put(timed, "timed", hash_files=F.count("*"), hash_bytes=F.sum("size"))
    exact = exact_groups(timed, "time_group").drop("block", "time_group").withColumn("kind", F.lit("exact"))
    found = with_roles(exact).withColumn("distance", F.lit(None).cast("int"))
    if o.similar:
        found = _with_similar(known.filter(picture).drop("block"), stages.put(found, "exact"), o, source, None if "phash" in seen else printer, stages)
    else:
        stages.counts["camera_pairs_skipped"] = 0
    out = with_totals(with_origins(found))
    out = out.withColumn("group_distance", F.coalesce(F.max("distance").over(Window.partitionBy("group_id")), F.lit(0)))
    gone = F.col("role") == "delete"
    done = stages.put(out, "found", groups=F.count(F.when(F.col("role") == "keep", 1)), deletable_files=F.count(F.when(gone, 1)), wasted_bytes=F.sum(F.when(gone, F.col("size"))))
    stages.keep_only("found")
    return done


#: Counters of a run, in the order of its stages.
COUNTERS = ("candidates", "meta_files", "meta_bytes", "hash_files", "hash_bytes", "printed_files", "camera_pairs_skipped", "groups", "deletable_files", "wasted_bytes")


def run_counters(stages: Stages) -> DataFrame:
    """One row: what a run's stages counted while they were written; 0 for a stage that was not needed."""
    return stages.spark.createDataFrame([tuple(stages.counts.get(c, 0) for c in COUNTERS)], ", ".join(f"{c} bigint" for c in COUNTERS))


def _with_similar(pictures: DataFrame, exact: DataFrame, o: ScanOptions, source: str, printer, stages: Stages) -> DataFrame:
    """Exact groups, with similar pictures added or in groups of their own. printer is null where fingerprints are known."""
    buckets = anchored_buckets(pictures.filter("capture_ms is not null"), o.tolerance(), stages=stages)
    if o.match_without_time:
        key = N.name_key("name", "normalized" if o.name_mode == "ignore" else o.name_mode)
        nameless = pictures.filter("capture_ms is null").withColumn("bucket", F.concat(F.lit("n:"), key))
        buckets = buckets.unionByName(nameless.withColumn("_n", F.count("*").over(Window.partitionBy("bucket"))).filter("_n >= 2").drop("_n"))
    if printer is not None:
        buckets = buckets.withColumn("phash", printer(source))
    printed = stages.put(buckets, "printed", printed_files=F.count("*"))
    split = without_camera_pairs(phash_clusters(printed, o.distance()), "cluster", marked=True)
    parts = stages.put(split, "parts", camera_pairs_skipped=F.count(F.when(F.col("skipped"), 1))).filter("not skipped").drop("skipped")
    placed = similar_parts(parts.withColumn("part_id", F.concat_ws("#", "cluster", "part")), exact)
    ranked = with_roles(placed)
    joins = F.startswith("group_id", F.lit("e"))
    # a group's kept file has a fingerprint only if it is in a bucket itself
    keeper = exact.filter("role = 'keep'").select("path", "group_id").join(printed.select("path", F.col("phash").alias("keep_phash")), "path").select("group_id", "keep_phash")
    own = Window.partitionBy("group_id")
    kept = F.when(joins, F.col("keep_phash")).otherwise(F.max(F.when(F.col("role") == "keep", F.col("phash"))).over(own))
    away = ranked.join(keeper, "group_id", "left").withColumn("distance", F.bit_count(kept.bitwiseXOR(F.col("phash"))).cast("int")).withColumn("kind", F.lit("similar"))
    away = away.withColumn("distance", F.when(~joins & (F.col("role") == "keep"), 0).otherwise(F.col("distance"))).withColumn("role", F.when(joins, "delete").otherwise(F.col("role")))
    away = stages.put(away, "away")
    grown = away.filter(joins).select("group_id").distinct().withColumn("_grown", F.lit(True))
    old = exact.join(grown, "group_id", "left").withColumn("kind", F.when(F.col("_grown"), "similar").otherwise("exact")).drop("_grown")
    return old.unionByName(away.select(*[c for c in old.columns if c in away.columns]), allowMissingColumns=True)
