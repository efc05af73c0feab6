"""Structured Streaming: catalogues that grow as files arrive, and groups that are given out again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedupe, library
from ..operators.buckets import BucketedTable
from ..operators.stages import Stages


def incoming(spark: SparkSession, path: str, schema: str, per_batch: int = 200) -> DataFrame:
    """Rows of catalogue files (JSON lines) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def photos_table(spark: SparkSession, root: str, buckets: int = 256) -> BucketedTable:
    """The photos table that upserts() keeps."""
    return BucketedTable(spark, f"{root}/photos", library.PHOTOS, "path", buckets)


def upserts(rows: DataFrame, root: str, scan_id: int, checkpoint: str, buckets: int = 256, order: str | None = None) -> StreamingQuery:
    """Keep the photos table up to date: each micro-batch rewrites the buckets of its paths alone, and a batch that runs again changes nothing more.

    order: the column by which the last one of several rows of a path in one batch is told; without it the one with the latest change, and of equals the largest row.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table = photos_table(batch.sparkSession, root, buckets)
        stages = Stages(batch.sparkSession)
        new = stages.put(batch, "batch")  # read from its source once
        placed = new if order else new.withColumn("_order", F.struct("mtime_ms", F.to_json(F.struct(*new.columns))))
        table.upsert(placed, lambda old, fresh: library.upsert(old, fresh, scan_id, order or "_order"))
        table.tidy()
        stages.close()

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of events (ts, event_type) by window, late ones up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def latest_groups(groups: DataFrame) -> DataFrame:
    """The last version of each group (group_id, version, payload); output mode update."""
    return groups.groupBy("group_id").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))


#: A file as the state of its pre-group keeps it, and what is given out for a pre-group: its version and its groups, each the paths of one content in order.
STATE = "version bigint, path array<string>, seq array<bigint>, capture_ms array<bigint>, subsec_known array<boolean>, hash array<string>"
GROUPS = "block bigint, version bigint, groups array<array<string>>"


def _exact_groups(files: pd.DataFrame, o: dedupe.ScanOptions) -> list[list[str]]:
    """What the batch funnel finds in one pre-group: files of one content within each time group."""
    files = files.sort_values(["seq", "path"]).reset_index(drop=True)
    clusters = dedupe.cluster_by_capture(files, o.tolerance())
    missing = files.index[files["capture_ms"].isna()].tolist()
    if o.match_without_time and len(missing) >= 2:
        clusters.append(missing)
    found = []
    for cluster in clusters:
        same = files.iloc[cluster].dropna(subset=["hash"]).groupby("hash")["path"].apply(lambda p: sorted(p))
        found += [g for g in same.tolist() if len(g) >= 2]
    return sorted(found)


def growing_groups(files: DataFrame, o: dedupe.ScanOptions = dedupe.ScanOptions()) -> DataFrame:
    """Exact groups as files arrive: a stream of files (path, name, ext, size, seq, capture_ms, subsec_known, hash, gone) to a stream of (block, version, groups).

    Each pre-group is a keyed state that holds its files. Whenever files arrive or go its groups are found again and, if they changed, given out under the next version, which replaces the ones before; a pre-group that never had
    groups and has no files any more leaves no state, and one that had some only its version. After the same files, in whatever order and batches, the latest versions are what the batch funnel finds.
    """
    keyed = dedupe.with_keys(files, o.name_mode)
    columns = ["path", "seq", "capture_ms", "subsec_known", "hash"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, held = 0, {}
        if state.exists:
            version, *lists = state.get
            held = {r[0]: r for r in zip(*lists, strict=True)}
        before = _exact_groups(pd.DataFrame(list(held.values()), columns=columns), o) if len(held) > 1 else []
        for rows in batches:
            for *r, gone in rows[[*columns, "gone"]].itertuples(index=False, name=None):
                path, seq, ms, sub, content = (None if pd.isna(x) else x for x in r)
                held.pop(path, None)
                if pd.isna(gone) or not gone:
                    held[path] = (path, None if seq is None else int(seq), None if ms is None else int(ms), bool(sub), content)
        now = _exact_groups(pd.DataFrame(list(held.values()), columns=columns), o) if len(held) > 1 else []
        version += now != before
        if held or version:
            lists = [list(c) for c in zip(*held.values(), strict=True)] or [[] for _ in columns]
            state.update((int(version), *lists))
        else:
            state.remove()
        if now != before:
            yield pd.DataFrame({"block": [key[0]], "version": [int(version)], "groups": [now]})

    return keyed.select("block", *columns, "gone").groupBy("block").applyInPandasWithState(update, GROUPS, STATE, "update", "NoTimeout")
