"""Queries on other databases by JDBC, and the tables of a Parquet folder as views."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DRIVERS = {"postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"), "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"), "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC"), "duckdb": ("jdbc:duckdb:{database}", "org.duckdb.DuckDBDriver")}


def run_external(spark: SparkSession, kind: str, sql: str, timeout_s: int = 0, options: dict[str, str] | None = None, **where: object) -> DataFrame:
    """The rows of a query that another database runs; needs its JDBC driver on the class path."""
    if kind not in DRIVERS:
        raise ValueError(f"unknown database kind {kind}; known: {', '.join(DRIVERS)}")
    url, driver = DRIVERS[kind]
    return spark.read.format("jdbc").options(url=url.format(**where), driver=driver, query=sql, queryTimeout=str(timeout_s), **(options or {})).load()


class Accelerator:
    """Tables held in the executors' memory, queries on them counted; a query that fails there runs on another database, if one is named."""

    def __init__(self, spark: SparkSession, fallback: Callable[[str], DataFrame] | None = None):
        self.spark, self.fallback = spark, fallback
        self.preloaded: dict[str, float] = {}
        self.accelerated = self.fell_back = 0

    def preload(self, folder: str, names: tuple[str, ...]) -> None:
        for n in names:
            began = time.time()
            register_tables(self.spark, folder, (n,), cached=True)
            self.spark.table(n).count()  # fills the memory now
            self.preloaded[n] = time.time() - began

    def run(self, sql: str) -> DataFrame:
        try:
            df = self.spark.sql(sql)
            self.accelerated += 1
            return df
        except AnalysisException:
            if not self.fallback:
                raise
            self.fell_back += 1
            return self.fallback(sql)

    def statistics(self) -> dict:
        total = self.accelerated + self.fell_back
        return {"queries": total, "accelerated": self.accelerated, "fell_back": self.fell_back, "share": self.accelerated / total if total else 0.0, "preloaded": dict(self.preloaded)}

    def close(self) -> None:
        for n in self.preloaded:
            self.spark.catalog.uncacheTable(n)
        self.preloaded.clear()


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...], cached: bool = False) -> None:
    """Each Parquet table as a view of its name; cached: kept in memory by the executors."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
        if cached:
            spark.catalog.cacheTable(n)
