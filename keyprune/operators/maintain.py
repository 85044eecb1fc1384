"""Upkeep of key sets, on the `queries` form (query_hash, partition_key, query, status, n_keys, last_seen)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import OK, Store


def older_than(queries: DataFrame, now: str, days: int) -> DataFrame:
    return queries.filter(F.col("last_seen") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def _over(queries: DataFrame, threshold: int, order: list) -> DataFrame:
    """Of each partition key with more than threshold sets, the excess in the given order."""
    ok = queries.filter(F.col("status") == OK)
    n = F.count("*").over(Window.partitionBy("partition_key"))
    place = F.row_number().over(Window.partitionBy("partition_key").orderBy(*order, "query_hash"))
    return ok.withColumns({"__n": n, "__p": place}).filter(F.col("__p") <= F.col("__n") - threshold).drop("__n", "__p")


def oldest_over(queries: DataFrame, threshold: int) -> DataFrame:
    return _over(queries, threshold, [F.asc("last_seen")])


def largest_over(queries: DataFrame, threshold: int) -> DataFrame:
    return _over(queries, threshold, [F.desc("n_keys")])


def large(queries: DataFrame, most: int) -> DataFrame:
    return queries.filter(F.col("n_keys") > most)


def terminated(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("status") != OK)


def overview(queries: DataFrame) -> DataFrame:
    return queries.groupBy("partition_key").agg(F.count("*").alias("n_sets"), F.sum("n_keys").alias("n_keys"), F.max("last_seen").alias("last_seen"))


def remove(store: Store, victims: DataFrame) -> int:
    """Deletes the given sets, with one note for each partition key; returns how many."""
    rows = victims.select("query_hash", "partition_key").collect()  # names of sets, not their keys
    for key in sorted({r.partition_key for r in rows}):
        store.delete(*(r.query_hash for r in rows if r.partition_key == key), partition_key=key)
    return len(rows)


def counts(store: Store) -> DataFrame:
    """partition_key, datatype, and the number of sets of each state."""
    states = store.queries().groupBy("partition_key").pivot("status", ["ok", "timeout", "failed", "null"]).count()
    return store.partitions().join(states, "partition_key", "left").na.fill(0)


def validate(store: Store) -> list[str]:
    """What is wrong with a store: sets without rows where rows are counted, notes of unknown partition keys. Empty: nothing."""
    wrong = []
    types = {r.partition_key for r in store.partitions().collect()}
    for (h, key), r in sorted(store._of().items()):
        if key not in types:
            wrong.append(f"{h}: partition key {key} is not registered")
        elif r[3] == "ok" and f"{h}-{r[6]}" not in store._folders(f"entries/{key}"):
            wrong.append(f"{h}: its rows are missing")
    return wrong


def prune(store: Store, now: str, days: int) -> int:
    return remove(store, older_than(store.queries(), now, days))


def evict(store: Store, threshold: int, largest: bool = False) -> int:
    return remove(store, (largest_over if largest else oldest_over)(store.queries(), threshold))
