"""Intersections of key sets: the keys that all given fragments share. All are lazy; `hashes` are fragments that have a set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import as_arrays, as_bitmaps, from_bitmaps


def by_division(entries: DataFrame, n: int) -> DataFrame:
    """Relational division: keys that stand in n sets. One shuffle, pre-aggregated; a single set is its own intersection."""
    if n == 1:
        return entries.select("pk")
    return entries.groupBy("pk").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("pk")


def by_semi_joins(sets: list[DataFrame]) -> DataFrame:
    """The first set held to the others, one after another."""
    return reduce(lambda a, b: a.join(b, "pk", "left_semi"), sets)


#: Salts over which an array form's keys are dealt.
SALTS = 64


def by_arrays(entries: DataFrame, n: int) -> DataFrame:
    """Intersection of arrays: each set is dealt over SALTS arrays by a hash of the key, and the arrays of one salt meet in one row."""
    salt = F.pmod(F.xxhash64("pk"), F.lit(SALTS)).alias("salt")
    sets = entries.groupBy("query_hash", salt).agg(F.array_sort(F.collect_set("pk")).alias("pks")).groupBy("salt").agg(F.collect_list("pks").alias("all")).filter(F.size("all") == n)
    shared = F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), F.array_intersect)
    return sets.select(F.explode(shared).alias("pk"))


def by_bitmaps(entries: DataFrame, n: int) -> DataFrame:
    """AND of bitmaps for each bucket of 32768 keys that all n sets have."""
    both = as_bitmaps(entries).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter(F.col("n") == n)
    return from_bitmaps(both.select("bucket", "bits"))


def by_sql(entries: DataFrame, hashes: list[str]) -> DataFrame:
    return reduce(DataFrame.intersect, [entries.filter(F.col("query_hash") == h).select("pk") for h in hashes])


def envelopes(boxes: DataFrame, buffer: float = 0.0) -> DataFrame:
    """The common rectangle of rows (xmin, ymin, xmax, ymax), each widened by buffer; no row if they share none."""
    out = boxes.agg(F.max(F.col("xmin") - buffer).alias("xmin"), F.max(F.col("ymin") - buffer).alias("ymin"), F.min(F.col("xmax") + buffer).alias("xmax"), F.min(F.col("ymax") + buffer).alias("ymax"))
    return out.filter("xmin <= xmax and ymin <= ymax")


METHODS = {"division": by_division, "arrays": by_arrays, "bitmaps": by_bitmaps}
