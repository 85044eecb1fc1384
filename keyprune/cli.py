"""Command line: add, run, read, monitor, manage, queue, evict. python -m keyprune.cli --help"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from .config import settings
from .engine import Engine
from .operators import maintain
from .plans.fragments import Options
from .sources.external import register_tables
from .streaming.queue import Queue
from .streaming.schedule import EvictionSettings, QueueSettings, Scheduler, job_of, load, save


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyprune")
    p.add_argument("--store", help="folder of the key sets; default: spark.keyprune.store or KEYPRUNE_STORE")
    p.add_argument("--tables", help="folder of NAME.parquet tables")
    p.add_argument("--names", nargs="*", default=[], help="tables to register as views")
    p.add_argument("--partition-key", default="partition_key")
    p.add_argument("--key-columns", type=json.loads, help='column of each table as JSON, or one name: {"orders": "o_orderkey"}')
    p.add_argument("--datatype", default="integer", choices=["integer", "float", "text", "timestamp"])
    p.add_argument("--min-size", type=int, default=1)
    p.add_argument("--max-size", type=int, default=15)
    p.add_argument("--no-follow-graph", action="store_true")
    p.add_argument("--star-table")
    p.add_argument("--no-auto-star", action="store_true")
    p.add_argument("--bucket-step", type=float, default=1.0)
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("--query", required=True)
    add.add_argument("--queue", action="store_true")
    add.add_argument("--force", action="store_true", help="also fragments that are known")
    run = sub.add_parser("run", help="the query's rows, pruned")
    run.add_argument("--query", required=True)
    run.add_argument("--method", default=None)
    read = sub.add_parser("read")
    read.add_argument("--query", required=True)
    read.add_argument("--format", default="list", choices=["list", "json", "lines"])
    monitor = sub.add_parser("monitor")
    monitor.add_argument("--checkpoint", required=True)
    monitor.add_argument("--close", action="store_true", help="stop when the queue is empty")
    monitor.add_argument("--workers", type=int, default=12)
    monitor.add_argument("--timeout", type=float, default=1800)
    monitor.add_argument("--limit", type=int)
    manage = sub.add_parser("manage")
    manage.add_argument("action", choices=["overview", "export", "import", "prune", "evict-oldest", "evict-largest", "remove-large", "remove-terminated", "delete-partition", "queue-count", "queue-clear", "queue-log", "setup", "status", "count", "copy", "compact", "validate"])
    manage.add_argument("--path")
    manage.add_argument("--now", help="a timestamp; default: the current one")
    manage.add_argument("--days", type=int, default=30)
    manage.add_argument("--threshold", type=int, default=1000)
    manage.add_argument("--to", help="copy: the new partition key")
    for kind, default in (("queue", QueueSettings), ("eviction", EvictionSettings)):
        job = sub.add_parser(f"{kind}-processor", help="settings of the processor that runs on its own, one turn of it, or its status")
        job.add_argument("action", choices=["set", "show", "turn", "enable", "disable"])
        for f in fields(default):
            if f.name != "enabled":
                job.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.tables:
        register_tables(spark, a.tables, tuple(a.names))
    options = Options(a.min_size, a.max_size, not a.no_follow_graph, True, not a.no_auto_star, a.star_table, a.bucket_step)
    chosen = settings(spark)
    if not (a.store or chosen.store):
        raise SystemExit("name a store: --store, spark.keyprune.store or KEYPRUNE_STORE")
    engine = Engine(spark, a.store or chosen.store, options)
    store, name = engine.store, a.partition_key
    if a.command in ("add", "read", "run"):
        part = engine.partition(name, a.key_columns or name, a.datatype)
        if a.command == "add":
            print("queued" if a.queue and part.enqueue(a.query) else json.dumps(part.add(a.query, force=a.force)))
        elif a.command == "run":
            df, stats = part.run(a.query, a.method or chosen.method, encoding=chosen.encoding, most_share=chosen.most_share, least_bytes=chosen.least_bytes)
            for line in df.toJSON().toLocalIterator():
                print(line)
            print(stats, file=sys.stderr)
        else:
            keys = part.keys(a.query)
            values = [] if keys is None else [r.pk for r in keys.orderBy("pk").toLocalIterator()]
            print("\n".join(map(str, values)) if a.format == "lines" else json.dumps(values, default=str) if a.format == "json" else values)
    elif a.command == "monitor":
        q = Queue(store, options, a.workers, a.timeout, a.limit)
        q.process(a.checkpoint) if a.close else q.start(a.checkpoint).awaitTermination()
    elif a.command.endswith("-processor"):
        kind = a.command.partition("-")[0]
        default = QueueSettings() if kind == "queue" else EvictionSettings()
        job, turns = job_of(kind, name), Scheduler(store, name, options)
        current = load(store, job, default)
        given = {f.name: v for f in fields(default) if (v := getattr(a, f.name, None)) is not None}
        if a.action in ("set", "enable", "disable"):
            save(store, job, replace(current, **given, **({"enabled": a.action == "enable"} if a.action != "set" else {})))
        elif a.action == "turn":
            print(turns.queue_turn() if kind == "queue" else turns.eviction_turn())
        else:
            print(json.dumps(turns.status()))
    else:
        now = a.now or str(spark.sql("select current_timestamp() as t").head().t)
        actions = {
            "overview": lambda: maintain.overview(store.queries()).show(truncate=False),
            "export": lambda: store.export(name, a.path),
            "import": lambda: store.restore(a.path, name),
            "prune": lambda: print(maintain.prune(store, now, a.days)),
            "evict-oldest": lambda: print(maintain.evict(store, a.threshold)),
            "evict-largest": lambda: print(maintain.evict(store, a.threshold, True)),
            "remove-large": lambda: print(maintain.remove(store, maintain.large(store.queries(), a.threshold))),
            "remove-terminated": lambda: print(maintain.remove(store, maintain.terminated(store.queries()))),
            "delete-partition": lambda: store.delete_partition(name),
            "queue-count": lambda: print(Queue(store).waiting().count()),
            "queue-clear": lambda: Queue(store).clear(),
            "queue-log": lambda: Queue(store).log(a.threshold).show(a.threshold, truncate=False),
            "setup": lambda: store.register(name, a.datatype),
            "status": lambda: print(json.dumps(Scheduler(store, name).status() | {"wrong": maintain.validate(store)})),
            "count": lambda: maintain.counts(store).show(truncate=False),
            "copy": lambda: store.copy(name, a.to),
            "compact": lambda: print(store.compact()),
            "validate": lambda: print(json.dumps(maintain.validate(store))),
        }
        actions[a.action]()


if __name__ == "__main__":
    main()
