import json
import random
import re
import time

import duckdb
import pytest

from keyprune import cli, config
from keyprune import queries as Q
from keyprune.engine import Engine
from keyprune.operators import apply as ap
from keyprune.operators import intersect, maintain, spatial
from keyprune.plans.fragments import Options, fragments
from keyprune.sources import external
from keyprune.sources.store import Store
from keyprune.streaming import schedule

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in Q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["flagship", "apply_values", "apply_tmp_table_join", "p0_rewrite", "group_pruned", "intersect_bitmap", "export_roundtrip", "spatial_dwithin", "apply_spatial_filter", "queue_streaming", "evict_oldest", "queue_cache_info", "distance_bucket_normalized", "cross_partition_pairs", "stale_source", "null_safe", "semi_join", "star_tmp_join", "star_hub", "grid_cell_counts", "copy_reencode", "cleaned_queries", "set_states", "group_moments"])
def test_query_equals_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE[name])
    order = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert rows(df) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_spatial_joins_equal_brute_force(spark, duck):
    p = duck.execute(f"SELECT vec_id, label, x, y FROM {Q.POINTS}").fetchall()
    d = {(a[0], b[0]): (((a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])) ** 0.5, a[1] == b[1]) for a in p for b in p if a[0] < b[0]}
    cs = {}
    for (a, c), (far, _) in d.items():
        if far < 0.04:
            cs.setdefault(a, []).append(c)
    triples = sorted(((a, b, c) for (a, b), (far, _) in d.items() if far < 0.03 for c in cs[a] if b < c), key=str)
    assert triples and rows(Q.QUERIES["spatial_dwithin"](spark, SF)) == rows(Q.QUERIES["apply_spatial_filter"](spark, SF)) == triples
    assert rows(Q.QUERIES["cross_partition_pairs"](spark, SF)) == sorted((k for k, (far, same) in d.items() if far < 0.02 and not same), key=str)
    label = {i: x for i, x, *_ in p}
    assert rows(Q.QUERIES["distance_bucket_normalized"](spark, SF)) == sorted({(label[a],) for (a, _), (far, same) in d.items() if same and far <= 0.08}, key=str)


def test_random_queries_keep_their_rows(spark):
    rng = random.Random(5)
    Q._tables(spark, SF)
    part = Engine(spark).partition("orderkey", Q.ORDER_KEY)
    for _ in range(3):
        sql = f"SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > {rng.randint(100, 400) * 1000} AND (l.l_quantity > {rng.randint(10, 49)} OR l.l_tax < 0.01) AND NOT o.o_orderstatus = 'O'"
        part.add(sql)
        plain = rows(spark.sql(sql))
        for method in (ap.IN_LIST, ap.VALUES, ap.IN_SUBQUERY, ap.TMP_TABLE_IN, ap.TMP_TABLE_JOIN):
            df, stats = part.run(sql, method)
            assert stats.enhanced and stats.method == method and rows(df) == plain


def test_store_states(spark):
    store = Engine(spark).store
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert store.put("a", keys(0, 1, 5, 40000, 40000, None), "k") == "ok" and store.put("b", keys(0, 5, 7), "k") == "ok"
    assert store.put("big", keys(1, 2, 3), "k", limit=2) == "failed"
    assert store.put("none", keys(), "k") == "ok"
    store.set_status("slow", "k", "timeout")
    assert store.usable(["a", "b", "big", "none", "slow", "x"], "k") == {"a": 4, "b": 3, "none": 0}
    assert store.exists("a", "k") and not store.exists("slow", "k") and store.exists("slow", "k", check_query=True) and not store.exists("x", "k", True)
    e = store.entries("k", ["a", "b"])
    for got in (intersect.by_division(e, 2), intersect.by_arrays(e, 2), intersect.by_bitmaps(e, 2), intersect.by_sql(e, ["a", "b"])):
        assert rows(got) == [(0,), (5,)]
    store.put("a", keys(9), "k")
    assert rows(store.get("a", "k")) == [(9,)]
    store.delete("a", partition_key="k")
    assert store.get("a", "k") is None
    with pytest.raises(ValueError):
        store.register("k", "text")


def test_text_keys_empty_sets_and_unsupported_forms(spark):
    Q._tables(spark, SF)
    part = Engine(spark).partition("segment", {"customer": "c_mktsegment"}, "text")
    sql = "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > 9000"
    part.add(sql)
    assert rows(part.run(sql, ap.IN_LIST)[0]) == rows(spark.sql(sql))
    nothing = "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > 1e9"
    part.add(nothing)
    df, stats = part.run(nothing)
    assert stats.enhanced and df.count() == 0
    outer = "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"
    df, stats = part.run(outer)
    assert not stats.enhanced and df.count() == spark.sql(outer).count()


def test_timeout_and_limit_are_noted(spark):
    Q._tables(spark, SF)
    part = Engine(spark, options=Options()).partition("orderkey", Q.ORDER_KEY)
    assert set(part.add(Q.FLAGSHIP, limit=1).values()) == {"failed"}
    assert part.add(Q.FLAGSHIP) == {}  # known to fail: not run again
    assert set(part.add(Q.FLAGSHIP, force=True).values()) == {"ok"}
    spark.udf.register("wait_long", lambda x: time.sleep(3) or x, "long")
    slow = "SELECT o.o_orderkey FROM orders o WHERE wait_long(o.o_orderkey) > 0 AND o.o_orderkey < 50"
    assert set(part.add(slow, timeout_s=0.5).values()) == {"timeout"} and part.run(slow, options=Options(max_size=0))[1].enhanced is False
    assert part.engine.store.usable([f.hash for f in fragments(slow, Q.ORDER_KEY)], "orderkey") == {}


def test_compaction_drops_what_nothing_names_and_other_readers_see_the_rest(spark):
    store = Engine(spark).store
    for i in range(4):
        store.put("a", spark.range(i + 1), "k")
    store.put("b", spark.range(7), "k")
    store.delete("b", partition_key="k")
    other = Store(spark, store.root)
    assert other.usable(["a", "b"], "k") == {"a": 4}
    assert maintain.validate(store) == [] and store.compact() > 5 and store._folders("entries/k").__len__() == 1
    assert Store(spark, store.root).usable(["a", "b"], "k") == {"a": 4} and rows(store.get("a", "k")) == [(0,), (1,), (2,), (3,)]
    store.delete_partition("k")
    assert store.datatype("k") is None and store.keys("k") == [] and store.partitions().count() == 0


def test_queries_that_do_not_rewrite_run_as_they_are(spark):
    Q._tables(spark, SF)
    part = Engine(spark).partition("custkey", Q.CUST_KEY)
    for sql in ("SELECT c.c_custkey FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT * FROM customer NATURAL JOIN (SELECT o_custkey AS c_custkey FROM orders)", "SELECT c_custkey FROM customer TABLESAMPLE (100 PERCENT)", "SELECT c.c_custkey FROM customer c, LATERAL (SELECT c.c_acctbal + 1 AS z)", "SELECT c.c_custkey, ROW_NUMBER() OVER w AS p FROM customer c WHERE c.c_acctbal > 9000 WINDOW w AS (ORDER BY c.c_custkey)"):
        part.add(sql)
        df, stats = part.run(sql)
        assert not stats.enhanced and stats.reason and rows(df) == rows(spark.sql(sql))
    part.add(Q.CUSTOMERS)
    part.measure("customer")
    assert not part.run("SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > -10000")[1].enhanced
    part.add("SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > -10000")
    df, stats = part.run("SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > -10000")
    assert not stats.enhanced and "keys are left" in stats.reason and df.count() == spark.table("customer").count()


def test_grid_holds_points_to_cells_and_gives_regions(spark):
    Q._points(spark, SF).createOrReplaceTempView("points")
    grid = Engine(spark, options=Options(max_size=2)).grid("places", {"points": ("x", "y")}, 0.02)
    sql = "SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM points a, points b WHERE a.label = 1 AND b.label = 2 AND ST_DWithin(a.x, a.y, b.x, b.y, 0.03)"
    df, stats = grid.run(sql)
    plain = rows(df)
    assert not stats.enhanced and grid.region(sql) is None
    assert set(grid.add(sql).values()) == {"ok"}
    df, stats = grid.run(sql)
    assert stats.enhanced and stats.method == "cells" and rows(df) == plain and plain
    wkt = [r.wkt for r in grid.region(sql).collect()]
    assert wkt and all(w.startswith("POLYGON ((") and w.count(",") == 4 for w in wkt)
    assert spatial.box_of_wkb(spatial.wkb_of_box(1.0, -2.0, 3.5, 4.0)) == (1.0, -2.0, 3.5, 4.0)
    key = spark.createDataFrame([(0.051, -0.049)], "x double, y double").select(spatial.key_of("x", "y", 0.02).alias("pk"))
    assert [tuple(r) for r in spatial.cells_of(key).collect()] == [(3, -2)]


def test_command_line_and_schedules(spark, tmp_path, capsys):
    store = ["--store", str(tmp_path / "keys")]
    base = [*store, "--tables", SF, "--names", "orders", "lineitem", "--partition-key", "orderkey", "--key-columns", '{"orders": "o_orderkey", "lineitem": "l_orderkey"}']
    cli.main([*base, "add", "--query", Q.FLAGSHIP])
    cli.main([*base, "read", "--query", Q.FLAGSHIP, "--format", "json"])
    cli.main([*base, "run", "--query", Q.FLAGSHIP])
    cli.main([*base, "add", "--query", Q.GROUPED, "--queue"])
    said = capsys.readouterr().out.splitlines()
    assert set(json.loads(said[0]).values()) == {"ok"} and len(json.loads(said[1])) > 0 and json.loads(said[2])["o_orderkey"] in json.loads(said[1]) and said[-1] == "queued"
    cli.main([*base, "queue-processor", "set", "--workers", "2"])
    cli.main([*base, "queue-processor", "turn"])
    cli.main([*base, "queue-processor", "disable"])
    cli.main([*base, "queue-processor", "turn"])
    cli.main([*base, "queue-processor", "show"])
    cli.main([*base, "eviction-processor", "enable", "--threshold", "1", "--strategy", "largest"])
    cli.main([*base, "eviction-processor", "turn"])
    said = capsys.readouterr().out.splitlines()
    status = json.loads(said[2])
    assert said[:2] == ["True", "False"] and status["queue"]["workers"] == 2 and status["queue"]["enabled"] is False and status["ok"] >= 1 and int(said[3]) >= 1
    for action in (["copy", "--to", "again"], ["count"], ["status"], ["validate"], ["overview"], ["export", "--path", str(tmp_path / "out")], ["compact"], ["prune", "--days", "0", "--now", "2999-01-01 00:00:00"], ["remove-terminated"], ["queue-count"], ["queue-log"], ["queue-clear"], ["delete-partition"]):
        cli.main([*store, "--partition-key", "orderkey", "manage", *action])
    out = capsys.readouterr().out
    assert '"wrong": []' in out and "again" in out
    left = Store(spark, store[1])
    assert left.datatype("orderkey") is None and left.datatype("again") == "integer"
    with pytest.raises(ValueError):
        schedule.QueueSettings(workers=21)
    assert schedule.job_of("queue", "a-b") == "keyprune_queue_a_b"


def test_settings_and_other_databases(spark):
    found = config.settings(None, {"KEYPRUNE_STORE": "/x", "KEYPRUNE_MOST_SHARE": "0.25", "KEYPRUNE_WORKERS": "3"})
    assert (found.store, found.most_share, found.workers) == ("/x", 0.25, 3)
    with pytest.raises(ValueError):
        config.settings(None, {"KEYPRUNE_METHOD": "MAGIC"})
    with pytest.raises(ValueError):
        external.run_external(spark, "oracle", "SELECT 1")
    with pytest.raises(Exception, match="(?i)driver|class"):
        external.run_external(spark, "sqlite", "SELECT 1 AS a", database="/tmp/none.db").collect()
    fast = external.Accelerator(spark, lambda sql: spark.range(1))
    fast.preload(SF, ("nation",))
    assert fast.run("SELECT COUNT(*) AS n FROM nation").head().n == 25 and fast.run("SELECT * FROM no_such_table").count() == 1
    assert (fast.statistics()["accelerated"], fast.statistics()["fell_back"], list(fast.statistics()["preloaded"])) == (1, 1, ["nation"])
    fast.close()


def _moves_pairs(df) -> bool:
    """Whether rows that an inner join has made are dealt anew."""
    above: list[tuple[int, str]] = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        if re.search(r"Join .*Inner", line) and any("Exchange" in x for _, x in above):
            return True
        above.append((depth, line))
    return False


@pytest.fixture
def odd_points(spark, tmp_path):
    """Copies of a point, repeated ids, points without coordinates or id, NaN; no table is broadcast."""
    rng = random.Random(3)
    made = [(i, [rng.uniform(-0.1, 0.1), rng.uniform(-0.1, 0.1)], i % 3) for i in range(60)] + [(100 + i, [0.03, 0.05], 1) for i in range(12)]
    made += [(7, [0.02, 0.01], 0), (7, [0.02, 0.01], 0), (None, [0.01, 0.01], 0), (200, None, 1), (201, [0.01], 1), (202, [float("nan"), 0.0], 2)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _triples(path: str) -> list:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return sorted(con.execute(Q.ORACLE["spatial_dwithin"]).fetchall(), key=str)


def test_spatial_filter_moves_no_pairs(spark, odd_points):
    df = Q.QUERIES["apply_spatial_filter"](spark, odd_points)
    assert rows(df) == _triples(odd_points) != [] and not _moves_pairs(df)


def test_chains_of_distances_equal_brute_force(spark, odd_points):
    grid = Q._grid(spark, odd_points)
    near = " AND ".join(f"DIST({a}.x, {a}.y, {b}.x, {b}.y) <= 0.02" for a, b in ("ab", "bc", "cd"))
    sql = f"SELECT a.vec_id AS a, b.vec_id AS b, c.vec_id AS c, d.vec_id AS d FROM points a, points b, points c, points d WHERE {near} AND a.vec_id < d.vec_id"
    found, stats = grid.run(sql)
    assert rows(found) == rows(spark.sql(sql)) != [] and stats.reason == ""


def test_spatial_dwithin_moves_no_pairs(spark, odd_points):
    df = Q.QUERIES["spatial_dwithin"](spark, odd_points)
    assert rows(df) == _triples(odd_points) != [] and not _moves_pairs(df)


def _generates(df) -> list[str]:
    """The fused loops of Spark, by number, that take arrays of a run query's last plan apart."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [m or "none" for m in re.findall(r"(?:\*\((\d+)\) )?Generate (?:pos)?explode\((?:__[bc]|bs|cs)#", text)]


def test_spatial_filter_holds_one_array_at_a_time(spark, odd_points):
    df = Q.QUERIES["apply_spatial_filter"](spark, odd_points)
    loops = _generates(df)
    assert len(loops) == 2 == len(set(loops))
    # what can be said of a row and the first table is said before arrays are taken apart; what is not selected does not go on
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    apart = plan[: plan.index("Join")]
    assert apart.count("SQRT") == 2 and not re.search(r"^\W*Filter.*SQRT", apart, re.M) and re.search(r"a#\d+\.vec_id < lambda c#\d+\.vec_id", apart)


def test_distance_queries_with_other_conditions_equal_brute_force(spark, odd_points):
    grid = Q._grid(spark, odd_points)
    near = "DIST(a.x, a.y, b.x, b.y) BETWEEN 0.005 AND 0.03 AND ST_DWithin(a.x, a.y, c.x, c.y, 0.04)"
    for sql in (
        f"SELECT a.vec_id AS a, b.* , c.label AS l FROM points a, points b, points c WHERE {near} AND a.vec_id >= b.vec_id AND c.vec_id <= b.vec_id",
        f"SELECT a.vec_id AS a, b.vec_id AS b FROM points a, points b, points c WHERE {near} AND a.label + b.label > c.label AND B.label <> c.label",
        f"SELECT c.vec_id AS c, c.x - a.y AS z FROM points a, points b, points c WHERE {near} AND a.vec_id < b.vec_id AND b.vec_id < c.label * 100 AND DIST(b.x, b.y, c.x, c.y) > 0.01",
        f"SELECT b.vec_id FROM points a, points b, points c WHERE {near} AND a.label = c.label AND coalesce(a.vec_id, 1) = coalesce(c.vec_id, 1)",
    ):
        found, stats = grid.run(sql)
        assert rows(found) == rows(spark.sql(sql)) != [] and stats.reason == "", sql


def test_fragments_of_distances_make_no_pairs(spark, odd_points):
    df = Q.QUERIES["distance_bucket_normalized"](spark, odd_points)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{odd_points}/embeddings.parquet/*.parquet'")
    assert rows(df) == sorted(con.execute(Q.ORACLE["distance_bucket_normalized"]).fetchall(), key=str) != []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[: plan.index("Join")] and "exists(" in plan


def test_spatial_dwithin_holds_one_array_at_a_time(spark, odd_points):
    loops = _generates(Q.QUERIES["spatial_dwithin"](spark, odd_points))
    assert len(loops) == 2 == len(set(loops))
