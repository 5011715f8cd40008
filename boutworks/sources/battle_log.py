"""A data source of JSON battle logs: from a folder of files, or over HTTP with a taxonomy of errors."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FetchError(Exception):
    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def error_code(status: int) -> str:
    """What an upstream status means for the collector."""
    if status in (401, 403):
        return "credentials_rejected"
    return {404: "player_not_found", 429: "rate_limited"}.get(status, "upstream_unavailable")


def fetch(base: str, tag: str, token: str = "", timeout: float = 12.0) -> list:
    """One player's log; raises FetchError with a code."""
    request = urllib.request.Request(f"{base}/players/%23{tag.lstrip('#')}/battlelog", headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            payload = json.load(response)
    except urllib.error.HTTPError as error:
        raise FetchError(error_code(error.code)) from error
    except (OSError, ValueError) as error:
        raise FetchError("upstream_unavailable" if isinstance(error, OSError) else "invalid_response") from error
    if not isinstance(payload, list):
        raise FetchError("invalid_response")
    return payload


class _Tag(InputPartition):
    def __init__(self, tag: str) -> None:
        self.tag = tag


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.token = options["base"], options.get("token", "")
        self.tags = [t for t in options.get("tags", "").split(",") if t]

    def partitions(self) -> list[_Tag]:
        return [_Tag(t) for t in self.tags]

    def read(self, partition: _Tag) -> Iterator[tuple]:
        try:
            for raw in fetch(self.base, partition.tag, self.token):
                yield partition.tag, json.dumps(raw), None
        except FetchError as error:
            yield partition.tag, None, error.code


class BattleLogSource(DataSource):
    """Options: base (URL), tags (comma-separated), token."""

    @classmethod
    def name(cls) -> str:
        return "battle_log"

    def schema(self) -> str:
        return "tag string, raw string, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from files `TAG.json`, each an array of logs: the offline way."""
    from pyspark.sql import functions as F

    files = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("name"), "value")
    logs = F.from_json("value", "array<string>")
    return files.select(F.concat(F.lit("#"), "name").alias("tag"), F.explode(logs).alias("raw"), F.lit(None).cast("string").alias("error"))
