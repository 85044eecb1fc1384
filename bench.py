"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line. Key sets are stored before the clock starts
for the pruned runs; the same query unpruned is timed beside each, and as the engine runs it by itself: `guarded` leaves tables as
they are that are scanned faster than sets are looked up."""

import json
import os
import time

from pyspark.sql import SparkSession

from keyprune import queries as Q
from keyprune.config import Settings
from keyprune.engine import Engine
from keyprune.operators import apply as ap


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, make) -> None:
        best = []
        for _ in range(3):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        times[name] = round(min(best), 4)

    Q._tables(spark, sf)
    engine = Engine(spark)
    for name, sql, key in (("orders", Q.FLAGSHIP, Q.ORDER_KEY), ("customers", Q.CUSTOMERS, Q.CUST_KEY)):
        part = engine.partition(name, key)
        began = time.time()
        part.add(sql)
        times[f"{name}_populate"] = round(time.time() - began, 4)
        timed(f"{name}_unpruned", lambda sql=sql: spark.sql(sql))
        timed(f"{name}_guarded", lambda sql=sql, part=part: part.run(sql, least_bytes=Settings().least_bytes)[0])
        for method in (ap.IN_LIST, ap.IN_SUBQUERY, ap.TMP_TABLE_JOIN):
            timed(f"{name}_{method.lower()}", lambda sql=sql, part=part, method=method: part.run(sql, method)[0])
    for name in ("distance_join", "spatial_dwithin", "topk_per_partition", "group_having_stats", "density_full_outer", "evict_oldest", "queue_dedup_priority"):
        timed(name, lambda name=name: Q.QUERIES[name](spark, sf))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
