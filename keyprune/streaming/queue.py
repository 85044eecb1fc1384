"""The work queue: an append-only folder of requests, folded by aggregation, consumed by Structured Streaming."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apply import apply, by_distance, register_distances, stamps_of
from ..plans.fragments import Fragment, Options, fragments, spatial_fragments
from ..plans.sql import parse
from ..functions.distances import planar_bounds
from ..sources.folders import fs_of
from ..sources.store import FAILED, TIMEOUT, Store

LOG = "query_hash string, partition_key string, status string, seconds double, created_at timestamp"
SCHEMA = "query string, hash string, partition_key string, datatype string, key_columns string, priority long, created_at timestamp"


def folded(requests: DataFrame) -> DataFrame:
    """One row for each (hash, partition_key): priorities add up, the first request's time stays."""
    return requests.groupBy("hash", "partition_key").agg(F.sum("priority").alias("priority"), F.min("created_at").alias("created_at"))


def top(queue: DataFrame, n: int) -> DataFrame:
    return queue.orderBy(F.desc("priority"), "created_at", "hash").limit(n)


def uncached(queue: DataFrame, queries: DataFrame) -> DataFrame:
    return queue.join(queries.select(F.col("query_hash").alias("hash"), "partition_key"), ["hash", "partition_key"], "left_anti")


def cached(queue: DataFrame, queries: DataFrame) -> DataFrame:
    return queue.join(queries.select(F.col("query_hash").alias("hash"), "partition_key"), ["hash", "partition_key"], "left_semi")


def lengths(queue: DataFrame) -> DataFrame:
    return queue.groupBy("partition_key").agg(F.count("*").alias("n_waiting"))


def info(queue: DataFrame, queries: DataFrame) -> DataFrame:
    """For each partition key: sets stored, last seen, requests waiting."""
    a = queries.groupBy("partition_key").agg(F.count("*").alias("n_sets"), F.max("last_seen").alias("last_seen"))
    return a.join(lengths(queue), "partition_key", "full_outer").select("partition_key", F.coalesce("n_sets", F.lit(0)).alias("n_sets"), "last_seen", F.coalesce("n_waiting", F.lit(0)).alias("n_waiting"))


class Queue:
    """Requests fold by (hash, partition key) where they are read: pushes of one query add up their priorities. fifo: one request for each
    push, in the order of their times."""

    def __init__(self, store: Store, options: Options = Options(), workers: int = 4, timeout_s: float = 1800, limit: int | None = None, fifo: bool = False, tries: int = 3):
        self.store, self.options, self.workers, self.timeout_s, self.limit, self.fifo, self.tries = store, options, workers, timeout_s, limit, fifo, tries
        self.path = f"{store.root}/queue"

    def push(self, query: str, partition_key: str, key: dict[str, str] | str, datatype: str = "integer", priority: int = 1) -> None:
        row = self.store.spark.createDataFrame([(query, None, partition_key, datatype, json.dumps(key), priority, None)], SCHEMA)
        row.withColumn("created_at", F.current_timestamp()).withColumn("hash", F.sha1("query")).coalesce(1).write.mode("append").parquet(self.path)

    def requests(self) -> DataFrame:
        return self.store._read("queue", SCHEMA)

    def waiting(self) -> DataFrame:
        """What the folder holds, folded; those that a processor has answered are in the log."""
        return folded(self.requests())

    def clear(self) -> None:
        fs, path = fs_of(self.store.spark, self.path)
        fs.delete(path, True)

    def log(self, n: int | None = None) -> DataFrame:
        """The outcomes noted so far, newest first."""
        rows = self.store._read("log", LOG).orderBy(F.desc("created_at"), "query_hash")
        return rows.limit(n) if n is not None else rows

    def status(self) -> dict[str, int]:
        """How many requests wait, and how many fragments ended in each state."""
        ended = self.store._read("log", LOG).groupBy(F.substring_index("status", ":", 1).alias("status")).count().collect()
        return {"waiting": self.waiting().count()} | {r.status: r["count"] for r in ended}

    def process(self, checkpoint: str, n: int | None = None) -> None:
        """Consumes what is there, each file once, and returns; with n the n most urgent requests, which a note then marks as done."""
        if n is not None:
            done = self.store._read("done", "hash string, partition_key string")
            rest = self.requests().join(done, ["hash", "partition_key"], "left_anti")
            for r in self._ordered(rest).limit(n).collect():
                self._answer(r)
                self.store._note([(r.hash, r.partition_key)], "done", "hash string, partition_key string")
            return
        self._stream().trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()

    def start(self, checkpoint: str, every_s: int = 1):
        """Goes on consuming; stop() the query that it returns."""
        return self._stream().trigger(processingTime=f"{every_s} seconds").option("checkpointLocation", checkpoint).start()

    def _stream(self):
        stream = self.store.spark.readStream.schema(SCHEMA).parquet(self.path)
        return stream.writeStream.foreachBatch(lambda df, i: self._batch(df))

    def _ordered(self, df: DataFrame) -> DataFrame:
        if self.fifo:
            return df.orderBy("created_at", "hash")
        keys = ("query", "hash", "partition_key", "datatype", "key_columns")
        return df.groupBy(*keys).agg(F.sum("priority").alias("priority"), F.min("created_at").alias("created_at")).orderBy(F.desc("priority"), "created_at", "hash")

    def _batch(self, df: DataFrame) -> None:
        rows = self._ordered(df).collect()  # texts of queries
        with ThreadPoolExecutor(max(1, min(self.workers, len(rows) or 1))) as pool:
            list(pool.map(self._answer, rows))

    def _answer(self, r) -> None:
        """Adds one request's fragments; an error of the store's file system is tried again after a growing pause."""
        for attempt in range(self.tries):
            try:
                populate(self.store, r.query, r.partition_key, json.loads(r.key_columns), r.datatype, self.options, self.workers, self.timeout_s, self.limit, self._noted)
                return
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(2**attempt)

    def _noted(self, f: Fragment, partition_key: str, status: str, seconds: float) -> None:
        self.store._note([(f.hash, partition_key, status, seconds, datetime.now())], "log", LOG)


def job_name(f: Fragment, partition_key: str) -> str:
    """A fragment's job group: its partition key and the head of its hash."""
    return f"keyprune:{partition_key}:{f.hash[:16]}"


def populate(store: Store, sql: str, partition_key: str, key: dict[str, str] | str, datatype: str = "integer", options: Options = Options(), workers: int = 4, timeout_s: float = 1800, limit: int | None = None, note: Callable | None = None, force: bool = False) -> dict[str, str]:
    """Runs and stores the query's fragments that are not known yet, or whose tables have changed since; smaller ones first, so that they
    prune the larger. force: also those that are known. Returns each one's status."""
    found = fragments(sql, key, options)
    run = lambda f: apply(store, f.sql, partition_key, key, options=Options(auto_star=False))[0] if len(f.tables) > 1 else store.spark.sql(f.sql)
    return _populated(store, found, run, partition_key, datatype, workers, timeout_s, limit, note, force)


def populate_spatial(store: Store, sql: str, name: str, geometry: dict[str, tuple[str, str]], size: float, options: Options = Options(), workers: int = 4, timeout_s: float = 1800, limit: int | None = None, note: Callable | None = None, force: bool = False) -> dict[str, str]:
    """As `populate` for queries whose tables are joined by distances: the sets hold cells of a grid."""
    register_distances(store.spark)
    q = parse(sql, {})
    found = spatial_fragments(q, geometry, size, planar_bounds(q), options)

    def run(f: Fragment) -> DataFrame:
        own = parse(f.sql, {})
        return by_distance(store.spark, replace(own, select=own.select.removeprefix("DISTINCT ")), geometry, once=True)

    return _populated(store, found, run, name, "geometry", workers, timeout_s, limit, note, force)


def _populated(store: Store, found: list[Fragment], run: Callable, partition_key: str, datatype: str, workers: int, timeout_s: float, limit: int | None, note: Callable | None, force: bool) -> dict[str, str]:
    done: dict[str, str] = {}
    store.register(partition_key, datatype)
    stamps = stamps_of(store.spark, found)
    for size in sorted({len(f.tables) for f in found}):
        layer = [f for f in found if len(f.tables) == size and (force or not store.exists(f.hash, partition_key, True, stamps[f.hash]))]
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for f, status in zip(layer, pool.map(lambda f: _run(store, f, run, partition_key, datatype, timeout_s, limit, note, stamps[f.hash]), layer), strict=True):
                done[f.hash] = status
    return done


def _run(store: Store, f: Fragment, run: Callable, partition_key: str, datatype: str, timeout_s: float, limit: int | None, note: Callable | None, stamped: str) -> str:
    """One fragment as a job group of its own thread; at the timeout its jobs are cancelled until the thread has ended."""
    spark, began = store.spark, time.time()
    outcome: list[str] = []

    def work() -> None:
        spark.sparkContext.setJobGroup(job_name(f, partition_key), f.sql[:200], True)
        try:
            outcome.append(store.put(f.hash, run(f), partition_key, datatype, f.sql, limit, stamped))
        except Exception as e:  # the fragment's own failure: it is noted, and later lookups do without it
            outcome.append(f"{FAILED}: {str(e)[:200]}")

    thread = InheritableThread(target=work) if threading.current_thread() is threading.main_thread() else threading.Thread(target=work)
    thread.start()
    thread.join(timeout_s)
    if thread.is_alive():
        while thread.is_alive():  # a cancelled job may be followed by the thread's next one
            spark.sparkContext.cancelJobGroup(job_name(f, partition_key))
            thread.join(0.2)
        store.delete(f.hash, partition_key=partition_key)  # what it may have stored meanwhile
        outcome = [TIMEOUT]
    status = outcome[0].partition(":")[0]
    if status != "ok":
        store.set_status(f.hash, partition_key, status, f.sql, stamped)
    if note:
        note(f, partition_key, outcome[0], time.time() - began)
    return status
