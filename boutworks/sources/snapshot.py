"""Export of collected matches as a snapshot that appears whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import live
from .shared import written


def export_matches(observed: DataFrame, path: str, start: str, end: str, version: str, era: str) -> dict[str, int]:
    """Write the rows of `live.snapshot_rows` as JSON lines; counts of rows written and of matches of other modes.

    Spark's committer lets the files appear at the end of the job only. A path that exists, an empty version or era, and a
    range without rows are errors; the last leaves nothing behind, since rows are made and counted before the write.
    """
    if not version.strip() or not era.strip():
        raise ValueError("version and era are required")
    rows, others = live.snapshot_rows(observed, start, end, version, era, path.rstrip("/").rpartition("/")[2])
    rows = written(rows, "snapshot-rows")
    count = rows.count()
    if not count:
        raise ValueError("no eligible ranked matches in the range")
    rows.write.mode("error").json(path)
    return {"written": count, "skipped_mode": others.count()}
