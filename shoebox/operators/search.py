"""Search by name patterns, and duplicates by content among what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .dedupe import exact_groups, with_origins, with_roles, with_totals


def find(files: DataFrame, patterns: str | list[str], excluded: list[str] | None = None) -> DataFrame:
    """Files whose name matches a pattern, empty ones too, in no excluded directory; no other directories are pruned."""
    return files.filter(N.matches("name", patterns) & ~F.startswith("name", F.lit("._")) & ~N.is_excluded(N.dirname("path"), excluded or []))


def duplicates(files: DataFrame, patterns: str | list[str], excluded: list[str] | None = None, hasher=None, source: str = "path") -> DataFrame:
    """Groups of equal content among the files found. Names do not matter; content is read only where sizes agree."""
    same = find(files, patterns, excluded).withColumn("_n", F.count("*").over(Window.partitionBy("size"))).filter("_n >= 2").drop("_n")
    if "hash" not in files.columns:
        from ..sources.files import content_hash

        same = same.withColumn("hash", (hasher or content_hash)(source))
    return with_totals(with_origins(with_roles(exact_groups(same, "size").withColumn("kind", F.lit("exact")))))
