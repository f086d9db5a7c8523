"""Raw partitions to staged partitions."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.operators.staging import stage_rows
from shelf.scratch import materialize
from shelf.sinks.writers import overwrite_partitions
from shelf.sources.readers import dated_files, raw_volumes, staged


def high_water_mark(target: DataFrame) -> str | None:
    """Latest staged date, from the names of the partitions' files alone; it can prune partitions as a literal."""
    found = (re.search(r"/processing_date=([^/]+)/", file) for file in target.inputFiles())
    return max((unquote(m[1]) for m in found if m and m[1] != "__HIVE_DEFAULT_PARTITION__"), default=None)


def stage_dates(
    spark: SparkSession,
    raw: DataFrame,
    target: str,
    start_date: str,
    end_date: str,
    on_late: str = "drop",
    full_refresh: bool = False,
    limit: int | None = None,
) -> None:
    """Stage the dates of the range that the target does not have yet.

    With 'drop' only dates past the mark are staged; 'reprocess' stages the mark's own
    date again, whole. Touched partitions are replaced, all others stay. ``limit`` is for trial
    runs into a new target: replacing whole dates by a few of their rows is refused.
    """
    if on_late not in ("drop", "reprocess"):
        raise ValueError(f"on_late must be 'drop' or 'reprocess', not {on_late!r}")
    there = staged(spark, target)
    if limit is not None and there is not None:
        raise ValueError("a limited run must not replace staged dates; give it a target of its own")
    have = None if full_refresh else there
    if have is not None:
        mark = high_water_mark(have)
        if mark is None and on_late == "drop":
            raw = raw.where(F.lit(False))
        elif mark is not None:
            raw = raw.where(F.col("date") > mark if on_late == "drop" else F.col("date") >= mark)
    overwrite_partitions(stage_rows(raw, start_date, end_date, limit), target)


def stage_unseen(spark: SparkSession, raw_path: str, target: str, manifest: str) -> list[str]:
    """Stage the dates that have files the manifest does not know, however old they are; returns these dates.

    ``manifest`` is a table of (path, modified, bytes, date), one row a staged file. The listing of the raw files less
    the manifest says which partitions have something new; only those are read, and staged again in
    full. The files are entered last, so a run that dies is done again, with the same result.
    """
    listed = dated_files(spark, raw_path).where(F.col("date").isNotNull())
    known = staged(spark, manifest, listed.schema)
    if known is not None:
        listed = listed.join(known.select("path", "modified"), ["path", "modified"], "left_anti").select(*listed.columns)
    unseen = materialize(listed, "unseen")
    # a row a partition; as literals they prune the scan, whose files the driver lists anyway
    dates = sorted(r[0] for r in unseen.select("date").distinct().collect())
    if dates:
        overwrite_partitions(stage_rows(raw_volumes(spark, raw_path).where(F.col("date").isin(dates))), target)
        unseen.write.mode("append").parquet(manifest)
    return dates
