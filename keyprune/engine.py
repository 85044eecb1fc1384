"""The engine: add queries, look up keys, run queries pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import spatial
from .operators.apply import IN_SUBQUERY, Stats, apply, apply_spatial, keys_for, register_distances, spatial_keys
from .plans.fragments import Options
from .plans.sql import parse
from .sources.folders import shared_folder, stamp
from .sources.store import Store
from .streaming.queue import Queue, populate, populate_spatial


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, options: Options = Options()):
        self.spark, self.options = spark, options
        self.store = Store(spark, root or shared_folder(spark))

    def partition(self, name: str, key: dict[str, str] | str, datatype: str = "integer") -> Partition:
        """key: the key's column in each table, or one column name for all."""
        return Partition(self, name, key, datatype)

    def grid(self, name: str, geometry: dict[str, tuple[str, str]], cell: float) -> Grid:
        """geometry: the coordinates' columns in each table; cell: the width of the grid's cells."""
        return Grid(self, name, geometry, cell)


class Partition:
    """The engine for one partition key."""

    def __init__(self, engine: Engine, name: str, key: dict[str, str] | str, datatype: str):
        self.engine, self.name, self.key, self.datatype = engine, name, key, datatype
        self._total: tuple[str, int] | None = None
        engine.store.register(name, datatype)

    def add(self, sql: str, options: Options | None = None, **limits) -> dict[str, str]:
        """Runs and stores the query's fragments now."""
        return populate(self.engine.store, sql, self.name, self.key, self.datatype, options or self.engine.options, **limits)

    def enqueue(self, sql: str, priority: int = 1) -> Queue:
        q = Queue(self.engine.store, self.engine.options)
        q.push(sql, self.name, self.key, self.datatype, priority)
        return q

    def keys(self, sql: str, options: Options | None = None, encoding: str = "division") -> DataFrame | None:
        return keys_for(self.engine.store, sql, self.name, self.key, options or self.engine.options, encoding)[0]

    def measure(self, table: str | None = None) -> int:
        """About how many keys a table has, by default the first that names its key; counted again when the table has changed. `run` then
        leaves queries as they are whose sets hold most of them."""
        table = table or next(iter(self.key))
        df = self.engine.spark.table(table)
        now = stamp(df)
        if not self._total or self._total[0] != now:
            self._total = now, df.agg(F.approx_count_distinct(self.key if isinstance(self.key, str) else self.key[table])).head()[0]
        return self._total[1]

    def run(self, sql: str, method: str = IN_SUBQUERY, options: Options | None = None, **more) -> tuple[DataFrame, Stats]:
        total = self._total[1] if self._total else None
        return apply(self.engine.store, sql, self.name, self.key, method, options or self.engine.options, **{"total": total} | more)


class Grid:
    """The engine for points: its sets hold cells of a planar square grid."""

    def __init__(self, engine: Engine, name: str, geometry: dict[str, tuple[str, str]], cell: float):
        self.engine, self.name, self.geometry, self.cell = engine, name, geometry, cell
        engine.store.register(name, "geometry")
        register_distances(engine.spark)

    def add(self, sql: str, options: Options | None = None, **limits) -> dict[str, str]:
        return populate_spatial(self.engine.store, sql, self.name, self.geometry, self.cell, options or self.engine.options, **limits)

    def cells(self, sql: str) -> DataFrame | None:
        """Keys of the cells that points of the query's rows can lie in."""
        return spatial_keys(self.engine.store, parse(sql, {}), self.name, self.geometry, self.cell, self.engine.options)[0]

    def region(self, sql: str) -> DataFrame | None:
        """The same cells as polygons."""
        keys = self.cells(sql)
        return None if keys is None else spatial.as_wkt(keys, self.cell)

    def run(self, sql: str) -> tuple[DataFrame, Stats]:
        return apply_spatial(self.engine.store, sql, self.name, self.geometry, self.cell, self.engine.options)
