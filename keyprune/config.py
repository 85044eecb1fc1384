"""Settings from the session's configuration or the environment: spark.keyprune.NAME, else KEYPRUNE_NAME."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    store: str = ""  # folder of the key sets
    encoding: str = "division"
    method: str = "IN_SUBQUERY"
    most_share: float = 0.5
    least_bytes: int = 256 << 20  # tables of fewer bytes are scanned as they are
    bucket_step: float = 1.0
    workers: int = 4
    timeout_s: float = 1800.0
    cell: float = 1000.0

    def __post_init__(self):
        if self.encoding not in ("division", "arrays", "bitmaps"):
            raise ValueError(f"unknown encoding {self.encoding}")
        if self.method not in ("IN", "VALUES", "IN_SUBQUERY", "TMP_TABLE_IN", "TMP_TABLE_JOIN"):
            raise ValueError(f"unknown method {self.method}")
        if not 0 < self.most_share <= 1 or self.least_bytes < 0 or self.workers < 1 or self.timeout_s <= 0 or self.cell <= 0 or self.bucket_step < 0:
            raise ValueError("a setting is out of its range")


def settings(spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> Settings:
    environment = os.environ if environment is None else environment
    found = {}
    for f in fields(Settings):
        value = (spark.conf.get(f"spark.keyprune.{f.name}", None) if spark else None) or environment.get(f"KEYPRUNE_{f.name.upper()}")
        if value is not None:
            found[f.name] = type(f.default)(value)
    return Settings(**found)
