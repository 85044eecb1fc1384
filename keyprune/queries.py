"""Registered queries over the test tables, and the plain SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine, Grid, Partition
from .functions import distances
from .operators import apply as ap
from .operators import intersect, maintain, spatial
from .plans.fragments import Options, fragments
from .plans.sql import clean, parse
from .sources.external import register_tables
from .sources.folders import shared_folder
from .sources.store import as_arrays, as_bitmaps, from_bitmaps
from .streaming import queue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
ORDER_KEY = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
CUST_KEY = {"customer": "c_custkey", "orders": "o_custkey"}
NATION_KEY = {"nation": "n_nationkey", "customer": "c_nationkey", "supplier": "s_nationkey"}

FLAGSHIP = """SELECT o.o_orderkey, o.o_totalprice, l.l_linenumber, l.l_quantity FROM orders o, lineitem l
WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice > 400000 AND o.o_orderstatus = 'F' AND l.l_quantity >= 45 AND l.l_discount >= 0.08"""
CUSTOMERS = """SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c, orders o
WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 5000 AND o.o_orderstatus = 'F' AND o.o_totalprice > 300000"""
STAR = """SELECT n.n_name, c.c_custkey, s.s_suppkey FROM nation n, customer c, supplier s
WHERE n.n_nationkey = c.c_nationkey AND n.n_nationkey = s.s_nationkey AND c.c_acctbal > 9000 AND c.c_mktsegment = 'BUILDING' AND s.s_acctbal > 7000"""
GROUPED = """SELECT o.o_orderstatus, COUNT(*) AS n_lines, CAST(SUM(l.l_quantity) AS BIGINT) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_totalprice > 400000 AND l.l_quantity >= 45 GROUP BY o.o_orderstatus"""
NEAR = """SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM points a, points b
WHERE a.label = b.label AND a.vec_id < b.vec_id AND DIST(a.x, a.y, b.x, b.y) BETWEEN 0.01 AND 0.05"""
TRIPLES = """SELECT a.vec_id AS a_id, b.vec_id AS b_id, c.vec_id AS c_id FROM points a, points b, points c
WHERE a.vec_id < b.vec_id AND b.vec_id < c.vec_id AND DIST(a.x, a.y, b.x, b.y) < 0.03 AND DIST(a.x, a.y, c.x, c.y) < 0.04"""
POINTS = "(SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _tables(spark: SparkSession, sf_dir: str) -> None:
    register_tables(spark, sf_dir, TABLES)


def _partition(spark: SparkSession, sf_dir: str, name: str, key: dict[str, str], *added: str, options: Options = Options()) -> Partition:
    _tables(spark, sf_dir)
    part = Engine(spark, options=options).partition(name, key)
    for sql in added:
        part.add(sql, workers=1)
    return part


def _applied(sql: str, key: dict[str, str], name: str, method: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _partition(spark, sf_dir, name, key, sql).run(sql, method, **more)[0]


def p0_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _partition(spark, sf_dir, "orderkey", ORDER_KEY, FLAGSHIP)
    spark.table("orders").select(F.col("o_orderkey").alias("pk")).distinct().createOrReplaceTempView("orderkey_mv")
    return part.run(FLAGSHIP, hub_table="orderkey_mv")[0]


def _fragment(sql: str, key: dict[str, str], pick: Callable, options: Options = Options()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _tables(spark, sf_dir)
        return spark.sql(next(f.sql for f in fragments(sql, key, options) if pick(f)))

    return run


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def distance_bucket_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragment of a distance query over all pairs of points, its bounds widened to steps of 0.04; the pairs meet on a grid."""
    _points(spark, sf_dir).createOrReplaceTempView("points")
    ap.register_distances(spark)
    f = next(f for f in fragments(NEAR, {"points": "label"}, Options(bucket_step=0.04, min_size=2)) if "BETWEEN 0 AND 0.08" in f.sql)
    q = parse(f.sql, {"points": "label"})
    return ap.by_distance(spark, replace(q, select=q.select.removeprefix("DISTINCT ")), {"points": ("x", "y")}, once=True).distinct()


FRAGMENTS = fragments(FLAGSHIP, ORDER_KEY)


def _entries(spark: SparkSession, sf_dir: str) -> tuple[Partition, DataFrame, list[str]]:
    part = _partition(spark, sf_dir, "orderkey", ORDER_KEY, FLAGSHIP)
    hashes = sorted(f.hash for f in FRAGMENTS)
    return part, part.engine.store.entries("orderkey", hashes), hashes


def intersect_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e, h = _entries(spark, sf_dir)
    return intersect.by_division(e, len(h))


def intersect_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e, h = _entries(spark, sf_dir)
    return intersect.by_arrays(e, len(h))


def intersect_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e, h = _entries(spark, sf_dir)
    return intersect.by_bitmaps(e, len(h))


def intersect_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e, h = _entries(spark, sf_dir)
    return intersect.by_sql(e, h)


def populate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)[1]


def entry_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)[1]
    return as_bitmaps(e).groupBy("query_hash").agg(F.sum(F.bitmap_count("bits")).alias("n_keys"))


def copy_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets under another partition key; rows to bitmaps to rows, arrays to rows: the same sets."""
    store = _entries(spark, sf_dir)[0].engine.store
    store.copy("orderkey", "order_again")
    e = store.entries("order_again")
    a = as_arrays(e).select("query_hash", F.explode("pks").alias("pk"))
    return from_bitmaps(as_bitmaps(e)).intersect(a.select("query_hash", F.col("pk").cast("long").alias("pk")))


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _entries(spark, sf_dir)[0].engine.store
    path = f"{shared_folder(spark)}/export"
    store.export("orderkey", path)
    other = Engine(spark).store
    other.restore(path, "order_copy")
    return other.entries("order_copy")


def filter_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _entries(spark, sf_dir)[0].engine.store
    store.set_status("0" * 40, "orderkey", "timeout")
    found = store.usable([f.hash for f in FRAGMENTS] + ["0" * 40, "1" * 40], "orderkey")
    return spark.createDataFrame(sorted(found.items()), "query_hash string, n_keys long")


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)[0].engine.store.all_queries("orderkey").select("query_hash", "query")


def fragment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(f.sql, f.hash) for f in FRAGMENTS], "query string, query_hash string")
    return rows.select("query", "query_hash", (F.sha1("query") == F.col("query_hash")).alias("same"))


def fragment_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of two tables are computed over what their single-table fragments left."""
    o = Options(follow_graph=False)
    part = _partition(spark, sf_dir, "custkey", CUST_KEY, CUSTOMERS, options=o)
    two = next(f for f in fragments(CUSTOMERS, CUST_KEY, o) if len(f.tables) == 2)
    return part.engine.store.get(two.hash, "custkey")


def group_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partition(spark, sf_dir, "orderkey", ORDER_KEY, GROUPED).run(GROUPED)[0]


def _side(p: DataFrame, side: str) -> DataFrame:
    return p.select(F.col("vec_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"))


def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label within a distance, by the grid."""
    p = _points(spark, sf_dir)
    return spatial.within(_side(p, "a"), _side(p, "b"), 0.05, ("ax", "ay"), ("bx", "by")).filter("a_label = b_label AND a_id < b_id").select("a_id", "b_id")


def spatial_dwithin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way self-join over all points, each triple once, in ascending order, by the grid."""
    p = _points(spark, sf_dir).select("vec_id", "x", "y")
    a = spatial.dealt(p.toDF("a_id", "ax", "ay"), 0.04, ("ax", "ay"), ["a_id"])
    met = spatial.gathered(a, p, 0.04, ("x", "y"), F.struct("*"), "near")

    def ids(distance: float):
        def close(r):
            dx, dy = F.col("ax") - r["x"], F.col("ay") - r["y"]
            return (r["vec_id"] > F.col("a_id")) & (F.sqrt(dx * dx + dy * dy) < distance)

        return F.transform(F.filter("near", close), lambda r: r["vec_id"])

    # outer: else the optimiser works the arrays out once more, to see whether they have rows
    each = met.select("a_id", ids(0.03).alias("bs"), ids(0.04).alias("cs")).select("a_id", F.explode_outer("bs").alias("b_id"), "cs")
    return spatial.apart(each.filter("b_id IS NOT NULL")).select("a_id", "b_id", F.explode_outer("cs").alias("c_id")).filter("b_id < c_id")


def _grid(spark: SparkSession, sf_dir: str) -> Grid:
    _points(spark, sf_dir).createOrReplaceTempView("points")
    grid = Engine(spark, options=Options(max_size=2)).grid("places", {"points": ("x", "y")}, 0.02)
    grid.add(TRIPLES, workers=1)
    return grid


def apply_spatial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same triples from the query's text: its points are held to the cells that the stored fragments of one and two tables leave."""
    return _grid(spark, sf_dir).run(TRIPLES)[0]


def grid_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of the grid each stored fragment has."""
    return _grid(spark, sf_dir).engine.store.queries("places").select(F.when(F.col("query").contains("points t2"), "pair").otherwise("point").alias("fragment"), "n_keys").distinct()


def bbox_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cells(_points(spark, sf_dir), 0.05)


def bbox_envelope_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    each = p.groupBy("label").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    return intersect.envelopes(each, 0.125)


def cross_partition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different labels within a distance, over all points."""
    p = _points(spark, sf_dir)
    return spatial.within(_side(p, "a"), _side(p, "b"), 0.02, ("ax", "ay"), ("bx", "by")).filter("a_label != b_label AND a_id < b_id").select("a_id", "b_id")


def _view_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _tables(spark, sf_dir)
        return spark.sql(sql)

    return run


STATS_SQL = "SELECT c_nationkey, COUNT(*) AS n, COUNT(DISTINCT c_mktsegment) AS n_segments, MIN(c_custkey) AS first_key, MAX(c_custkey) AS last_key, ROUND(AVG(c_acctbal), 4) AS mean_balance FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 5"
FULL_SQL = "SELECT COALESCE(c.k, s.k) AS k, COALESCE(c.n, 0) AS n_customers, COALESCE(s.n, 0) AS n_suppliers, CAST(c.n AS DOUBLE) / NULLIF(s.n, 0) AS density FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k"
ILIKE_SQL = "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%mEd%' OR p_name LIKE '%red%'"
MOMENTS_SQL = "SELECT c_nationkey, ROUND(STDDEV_SAMP(c_acctbal), 4) AS sd, ROUND(VAR_POP(c_acctbal), 2) AS var, MODE() WITHIN GROUP (ORDER BY c_mktsegment) AS segment FROM customer GROUP BY c_nationkey"
LEFT_SQL = "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey"


def topk_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_orderpriority", "o_orderkey", "place")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set descriptions in the store's form, from orders: a customer's keys of each status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_custkey").cast("string").alias("query_hash"), F.col("o_orderstatus").alias("partition_key")).agg(F.count_distinct("o_orderkey").alias("n_keys"), F.max("o_orderdate").alias("last_seen")).withColumn("status", F.lit("ok"))


NOTES = "(SELECT o_custkey::VARCHAR AS query_hash, o_orderstatus AS partition_key, COUNT(DISTINCT o_orderkey) AS n_keys, MAX(o_orderdate) AS last_seen FROM orders GROUP BY 1, 2)"


def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.oldest_over(_notes(spark, sf_dir), 100).select("query_hash", "partition_key")


def evict_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.largest_over(_notes(spark, sf_dir), 100).select("query_hash", "partition_key")


def prune_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.older_than(_notes(spark, sf_dir), "1998-01-01 00:00:00", 365).select("query_hash", "partition_key")


def large_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.large(_notes(spark, sf_dir), 5).select("query_hash", "partition_key", "n_keys")


def partition_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.overview(_notes(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return queue.folded(e.select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("hash"), F.col("event_type").alias("partition_key"), F.lit(1).cast("long").alias("priority"), F.col("ts").alias("created_at")))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 2 = 0")
    return e.groupBy(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("query_hash"), F.col("event_type").alias("partition_key")).agg(F.max("ts").alias("last_seen"))


FOLDED = "(SELECT event_type || '-' || user_id::VARCHAR AS hash, event_type AS partition_key, COUNT(*)::BIGINT AS priority, MIN(ts) AS created_at, MIN(user_id) AS u FROM events GROUP BY 1, 2)"


def queue_dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir)


def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.top(_requests(spark, sf_dir), 20).select("hash", "priority")


def queue_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.uncached(_requests(spark, sf_dir), _done(spark, sf_dir)).select("hash", "partition_key", "priority")


def queue_cleanup_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.cached(_requests(spark, sf_dir), _done(spark, sf_dir)).select("hash", "partition_key", "priority")


def queue_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.lengths(_requests(spark, sf_dir))


def queue_cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.info(_requests(spark, sf_dir), _done(spark, sf_dir).filter("partition_key != 'click'"))


def queue_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the queue: two pushes of one query, one streaming run, then the pruned query."""
    part = _partition(spark, sf_dir, "orderkey", ORDER_KEY)
    q = part.enqueue(FLAGSHIP)
    part.enqueue(FLAGSHIP, 3)
    q.process(f"{shared_folder(spark)}/stream")
    return part.run(FLAGSHIP)[0]


def _with_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir)
    o = Options(add_constraints=(("orders", "o_orderpriority = '1-URGENT'"),))
    return spark.sql(next(f.sql for f in fragments(FLAGSHIP, ORDER_KEY, o) if "1-URGENT" in f.sql))


STARRED = """SELECT * FROM customer c, orders o
WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 5000 AND o.o_orderstatus = 'F' AND o.o_totalprice > 300000"""
NULL_SAFE = """SELECT C.c_custkey, o.o_orderkey FROM customer c, orders O
WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <=> 'BUILDING' AND o.o_totalprice > 400000L"""
SEMI = "SELECT c.c_custkey, c.c_name FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"


def star_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT * through a hub of all keys: no further columns."""
    part = _partition(spark, sf_dir, "custkey", CUST_KEY, STARRED)
    spark.table("customer").select(F.col("c_custkey").alias("pk")).distinct().createOrReplaceTempView("custkey_mv")
    return part.run(STARRED, hub_table="custkey_mv")[0]


def stale_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that were stored while orders held less: not used once the table has grown."""
    _tables(spark, sf_dir)
    whole = spark.table("orders")
    whole.filter("o_orderdate < '1995-01-01'").createOrReplaceTempView("orders")
    part = Engine(spark).partition("orderkey", ORDER_KEY)
    part.add(FLAGSHIP, workers=1)
    whole.createOrReplaceTempView("orders")
    return part.run(FLAGSHIP)[0]


TEXTS = ("SELECT a FROM t -- note\nWHERE b = '--  y' ORDER BY a LIMIT 3;", "SELECT a FROM t WHERE NOT (x < 3 OR y > 1 + 2 * 3)", "SELECT `a` FROM t u WHERE 3 < u.a AND (u.p = 1 OR (u.q = 2 AND u.r = 3))")
CLASSED = "SELECT * FROM u a JOIN o b ON a.k = b.k WHERE a.x = 1 AND a.k IN (1, 2) AND (a.x = 2 OR b.x = 3) AND a.id = b.uid AND DIST(a.x, b.x) < 2.5"
BOUNDED = "SELECT * FROM t a, t b, t c WHERE DIST(a.x, b.x) < 400 AND DIST(a.x, c.x) <= 300 AND DIST(b.x, c.x) BETWEEN 5 AND 650"


def cleaned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, clean(t)) for i, t in enumerate(TEXTS)], "i int, cleaned string")


def conjunct_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c.text, c.kind) for c in parse(CLASSED, "k").conjuncts], "conjunct string, kind string")


def distance_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of each pair of tables, and how far apart the points of one row can lie."""
    q = parse(BOUNDED, "k")
    return spark.createDataFrame([(a, b, d, distances.reach(q)) for a, b, d in distances.upper_bounds(q)], "a string, b string, bound double, reach double")


_IN_BOTH = FLAGSHIP + " AND o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)"


def set_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of a set, a null marker, a timeout, and of a name that it does not know."""
    store = Engine(spark).store
    store.register("k", "integer")
    store.put("set", spark.range(3), "k")
    store.set_null("none", "k")
    store.set_status("slow", "k", "timeout")
    return spark.createDataFrame([(h, store.exists(h, "k"), store.exists(h, "k", True), store.is_null(h, "k"), bool(store.usable([h], "k"))) for h in ("set", "none", "slow", "other")], "name string, there boolean, known boolean, is_null boolean, usable boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": _applied(FLAGSHIP, ORDER_KEY, "orderkey", ap.IN_SUBQUERY),
    "apply_in_list": _applied(FLAGSHIP, ORDER_KEY, "orderkey", ap.IN_LIST),
    "apply_values": _applied(FLAGSHIP, ORDER_KEY, "orderkey", ap.VALUES),
    "apply_in_subquery": _applied(CUSTOMERS, CUST_KEY, "custkey", ap.IN_SUBQUERY),
    "apply_tmp_table_in": _applied(CUSTOMERS, CUST_KEY, "custkey", ap.TMP_TABLE_IN),
    "apply_tmp_table_join": _applied(CUSTOMERS, CUST_KEY, "custkey", ap.TMP_TABLE_JOIN),
    "star_tmp_join": _applied(STARRED, CUST_KEY, "custkey", ap.TMP_TABLE_JOIN),
    "null_safe": _applied(NULL_SAFE, CUST_KEY, "custkey", ap.IN_SUBQUERY),
    "semi_join": _applied(SEMI, CUST_KEY, "custkey", ap.IN_SUBQUERY),
    "left_join_counts": _applied(LEFT_SQL, CUST_KEY, "custkey", ap.IN_SUBQUERY),
    "apply_star": _applied(STAR, NATION_KEY, "nationkey", ap.IN_SUBQUERY),
    "p0_rewrite": p0_rewrite,
    "group_pruned": group_pruned,
    "fragment_single_table": _fragment(FLAGSHIP, ORDER_KEY, lambda f: f.tables == ("orders",)),
    "fragment_two_table": _fragment(CUSTOMERS, CUST_KEY, lambda f: len(f.tables) == 2, Options(follow_graph=False)),
    "fragment_star_join": _fragment(STAR, NATION_KEY, lambda f: len(f.tables) == 3, Options(follow_graph=False)),
    "fragment_pk_condition": _fragment(FLAGSHIP + " AND o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07)", ORDER_KEY, lambda f: f.tables == ("orders",) and "l_tax" in f.sql),
    "fragment_single_condition": _fragment(FLAGSHIP, ORDER_KEY, lambda f: f.tables == ("orders",) and "o_orderstatus" not in f.sql, Options(keep_all_attributes=False)),
    "fragment_intersect_split": _fragment(_IN_BOTH, ORDER_KEY, lambda f: "s(pk)" in f.sql and "l_quantity > 40" in f.sql),
    "constraint_removed_also": _fragment(FLAGSHIP, ORDER_KEY, lambda f: f.tables == ("orders",) and "o_totalprice" not in f.sql, Options(remove_also=("o_totalprice",))),
    "constraint_added": _with_constraint,
    "constraint_removed": _fragment(FLAGSHIP, ORDER_KEY, lambda f: f.tables == ("orders",), Options(remove_all=("o_orderstatus",))),
}
QUERIES |= {f.__name__: f for f in (distance_bucket_normalized, intersect_division, intersect_arrays, intersect_bitmap, intersect_sql, populate_entries, entry_cardinality, copy_reencode, export_roundtrip, filter_existing, all_queries, fragment_hash, fragment_bootstrap, distance_join, spatial_dwithin, apply_spatial_filter, bbox_grid_cells, bbox_envelope_intersection, cross_partition_pairs, topk_per_partition, evict_oldest, evict_largest, prune_old, large_entries, partition_overview, queue_dedup_priority, queue_top, queue_uncached, queue_cleanup_cached, queue_lengths, queue_cache_info, queue_streaming)}
QUERIES |= {f.__name__: f for f in (star_hub, stale_source, cleaned_queries, conjunct_classes, distance_reach, set_states, grid_cell_counts)}
QUERIES |= {"group_having_stats": _view_sql(STATS_SQL), "density_full_outer": _view_sql(FULL_SQL), "ilike_filter": _view_sql(ILIKE_SQL), "group_moments": _view_sql(MOMENTS_SQL)}

# written by hand, not by the code under test
_LINES_TEXT = "SELECT DISTINCT t1.l_orderkey AS pk FROM lineitem t1 WHERE t1.l_discount >= 0.08 AND t1.l_quantity >= 45"
_ORDERS_TEXT = "SELECT DISTINCT t1.o_orderkey AS pk FROM orders t1 WHERE t1.o_orderstatus = ''F'' AND t1.o_totalprice > 400000"
_LINES_SQL = "SELECT DISTINCT l_orderkey AS pk FROM lineitem WHERE l_quantity >= 45 AND l_discount >= 0.08"
_ORDERS_SQL = "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'"
_BOTH_SQL = f"{_LINES_SQL} INTERSECT {_ORDERS_SQL}"
_NAMED = f"SELECT sha1('{_LINES_TEXT}') AS query_hash, pk FROM ({_LINES_SQL}) UNION ALL SELECT sha1('{_ORDERS_TEXT}'), pk FROM ({_ORDERS_SQL})"
_TEXTS = f"SELECT unnest(['{_LINES_TEXT}', '{_ORDERS_TEXT}']) AS query"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_C = "sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))"
_THREE = f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, c.vec_id AS c_id FROM {POINTS} a, {POINTS} b, {POINTS} c WHERE a.vec_id < b.vec_id AND b.vec_id < c.vec_id AND {_D} < 0.03 AND {_C} < 0.04"
_CELL = "(floor({0}.x / 0.02 + 0.5), floor({0}.y / 0.02 + 0.5))"
_OLD = "SELECT query_hash, partition_key FROM (SELECT *, count(*) OVER (PARTITION BY partition_key) AS n, row_number() OVER (PARTITION BY partition_key ORDER BY {}, query_hash) AS p FROM {}) WHERE p <= n - 100"

ORACLE: dict[str, str] = {
    **dict.fromkeys(("flagship", "apply_in_list", "apply_values", "p0_rewrite", "queue_streaming"), FLAGSHIP),
    **dict.fromkeys(("apply_in_subquery", "apply_tmp_table_in", "apply_tmp_table_join"), CUSTOMERS),
    "apply_star": STAR,
    "group_pruned": GROUPED,
    "fragment_single_table": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'",
    "fragment_two_table": "SELECT DISTINCT c_custkey AS pk FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND o_orderstatus = 'F' AND o_totalprice > 300000",
    "fragment_star_join": "SELECT DISTINCT n_nationkey AS pk FROM nation, customer, supplier WHERE n_nationkey = c_nationkey AND n_nationkey = s_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING' AND s_acctbal > 7000",
    "fragment_pk_condition": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.07)",
    "constraint_added": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "constraint_removed": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000",
    "distance_bucket_normalized": f"SELECT DISTINCT a.label AS pk FROM {POINTS} a, {POINTS} b WHERE a.label = b.label AND a.vec_id < b.vec_id AND {_D} BETWEEN 0 AND 0.08",
    **dict.fromkeys(("intersect_division", "intersect_arrays", "intersect_bitmap", "intersect_sql"), _BOTH_SQL),
    **dict.fromkeys(("populate_entries", "copy_reencode", "export_roundtrip"), _NAMED),
    **dict.fromkeys(("entry_cardinality", "filter_existing"), f"SELECT query_hash, count(*) AS n_keys FROM ({_NAMED}) GROUP BY 1"),
    "all_queries": f"SELECT sha1(query) AS query_hash, query FROM ({_TEXTS})",
    "fragment_hash": f"SELECT query, sha1(query) AS query_hash, true AS same FROM ({_TEXTS})",
    **dict.fromkeys(("star_tmp_join", "star_hub"), STARRED),
    "stale_source": FLAGSHIP,
    "null_safe": "SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AND o_totalprice > 400000",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "left_join_counts": LEFT_SQL,
    "fragment_single_condition": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_totalprice > 400000",
    "fragment_intersect_split": "SELECT DISTINCT l_orderkey AS pk FROM lineitem WHERE l_quantity > 40",
    "constraint_removed_also": "SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_orderstatus = 'F'",
    "cleaned_queries": "SELECT * FROM (VALUES (0, 'SELECT a FROM t t WHERE b = ''--  y'''), (1, 'SELECT a FROM t t WHERE x >= 3 AND y <= 7'), (2, 'SELECT a FROM t u WHERE (u.p = 1 OR u.q = 2) AND (u.p = 1 OR u.r = 3) AND u.a > 3')) AS v(i, cleaned)",
    "conjunct_classes": "SELECT * FROM (VALUES ('a.k = b.k', 'key join'), ('a.x = 1', 'attribute'), ('a.k IN (1, 2)', 'key'), ('(a.x = 2 OR b.x = 3)', 'or'), ('a.id = b.uid', 'edge'), ('DIST(a.x, b.x) < 2.5', 'edge')) AS v(conjunct, kind)",
    "distance_reach": "SELECT * FROM (VALUES ('a', 'b', 400.0::DOUBLE, 650.0::DOUBLE), ('a', 'c', 300.0, 650.0), ('b', 'c', 650.0, 650.0)) AS v(a, b, bound, reach)",
    "set_states": "SELECT * FROM (VALUES ('set', true, true, false, true), ('none', true, true, true, false), ('slow', false, true, false, false), ('other', false, false, false, false)) AS v(name, there, known, is_null, usable)",
    "grid_cell_counts": f"SELECT 'point' AS fragment, count(DISTINCT {_CELL.format('a')}) AS n_keys FROM {POINTS} a UNION SELECT 'pair', count(DISTINCT {_CELL.format('a')}) FROM {POINTS} a, {POINTS} b WHERE a.vec_id < b.vec_id AND {_D} < 0.03 UNION SELECT 'pair', count(DISTINCT {_CELL.format('a')}) FROM {POINTS} a, {POINTS} b WHERE {_D} < 0.04",
    "group_moments": "SELECT c_nationkey, round(sd, 4) AS sd, round(var, 2) AS var, segment FROM (SELECT c_nationkey, stddev_samp(c_acctbal) AS sd, var_pop(c_acctbal) AS var FROM customer GROUP BY 1) JOIN (SELECT c_nationkey, c_mktsegment AS segment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS p FROM customer GROUP BY 1, 2) WHERE p = 1) USING (c_nationkey)",
    "fragment_bootstrap": "SELECT DISTINCT c_custkey AS pk FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND o_orderstatus = 'F' AND o_totalprice > 300000",
    "distance_join": f"SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM {POINTS} a JOIN {POINTS} b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_D} < 0.05",
    **dict.fromkeys(("spatial_dwithin", "apply_spatial_filter"), _THREE),
    "bbox_grid_cells": f"SELECT floor(x / 0.05 + 0.5)::BIGINT AS gx, floor(y / 0.05 + 0.5)::BIGINT AS gy, count(*) AS n_points FROM {POINTS} GROUP BY 1, 2",
    "bbox_envelope_intersection": f"SELECT * FROM (SELECT max(x1 - 0.125) AS xmin, max(y1 - 0.125) AS ymin, min(x2 + 0.125) AS xmax, min(y2 + 0.125) AS ymax FROM (SELECT label, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM {POINTS} GROUP BY label)) WHERE xmin <= xmax AND ymin <= ymax",
    "cross_partition_pairs": f"SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM {POINTS} a, {POINTS} b WHERE a.vec_id < b.vec_id AND a.label != b.label AND {_D} < 0.02",
    "topk_per_partition": "SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "evict_oldest": _OLD.format("last_seen", NOTES),
    "evict_largest": _OLD.format("n_keys DESC", NOTES),
    "prune_old": f"SELECT query_hash, partition_key FROM {NOTES} WHERE last_seen < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY",
    "large_entries": f"SELECT query_hash, partition_key, n_keys FROM {NOTES} WHERE n_keys > 5",
    "partition_overview": f"SELECT partition_key, count(*) AS n_sets, sum(n_keys)::BIGINT AS n_keys, max(last_seen) AS last_seen FROM {NOTES} GROUP BY 1",
    "queue_dedup_priority": f"SELECT hash, partition_key, priority, created_at FROM {FOLDED}",
    "queue_top": f"SELECT hash, priority FROM {FOLDED} ORDER BY priority DESC, created_at, hash LIMIT 20",
    "queue_uncached": f"SELECT hash, partition_key, priority FROM {FOLDED} WHERE u % 2 = 1",
    "queue_cleanup_cached": f"SELECT hash, partition_key, priority FROM {FOLDED} WHERE u % 2 = 0",
    "queue_lengths": f"SELECT partition_key, count(*) AS n_waiting FROM {FOLDED} GROUP BY 1",
    "queue_cache_info": f"SELECT partition_key, coalesce(n_sets, 0) AS n_sets, last_seen, n_waiting FROM (SELECT partition_key, count(*) AS n_waiting FROM {FOLDED} GROUP BY 1) LEFT JOIN (SELECT event_type AS partition_key, count(DISTINCT user_id) AS n_sets, max(ts) AS last_seen FROM events WHERE user_id % 2 = 0 AND event_type != 'click' GROUP BY 1) USING (partition_key)",
    "group_having_stats": STATS_SQL,
    "density_full_outer": FULL_SQL,
    "ilike_filter": ILIKE_SQL,
}
