"""Key sets in Parquet: which key values each fragment can match.

Rows are long: one for each (fragment, key value). Tables only grow; for each fragment the newest version counts,
and a deleted one is a newest version of status `deleted`. An empty set is a version with n_keys = 0 and no rows:
it proves the query empty. Fragments that timed out, failed or grew too large have a status and no set; `null` marks one
that is known and has no set. Each version carries the stamp of the tables that it was computed from: a set whose tables
have changed since is not used.

The notes of all versions are kept on the driver, read once and again only where the folder has changed since, so that a
lookup runs no Spark job. `compact` writes the newest notes as one file and deletes what they have replaced.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import fs_of

OK, TIMEOUT, FAILED, NULL, DELETED = "ok", "timeout", "failed", "null", "deleted"
TYPES = {"integer": "bigint", "float": "double", "text": "string", "timestamp": "timestamp_ntz", "geometry": "bigint"}
#: Keys of a set that the driver may hold, and sets that it holds.
FEW, HELD = 20_000, 50
#: Seconds for which a listing of the notes holds; this process sees its own writes at once.
LISTED_S = 0.5
_QUERIES = "query_hash string, partition_key string, query string, status string, n_keys long, last_seen timestamp, version long, stamp string"
_PARTITIONS = "partition_key string, datatype string, version long"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[str, tuple[set[str], dict]] = {}
        self._listed: dict[str, float] = {}
        self._few: dict[tuple, frozenset] = {}

    # files

    def _folders(self, name: str) -> set[str]:
        fs, path = fs_of(self.spark, f"{self.root}/{name}")
        return {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._folders(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def _note(self, rows: list[tuple], name: str = "queries", schema: str = _QUERIES) -> None:
        """Each writer has a folder of its own, so that writers at the same time do not meet."""
        if not rows:
            return
        if name in ("queries", "partitions"):
            self._notes(name, schema)
        folder = uuid.uuid4().hex
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/{name}/{folder}")
        if name in self._known:
            seen, notes = self._known[name]
            seen.add(folder)
            _merge(notes, rows, name)

    def _notes(self, name: str, schema: str) -> dict:
        """The newest note of each name; those of folders not seen before are read in one job."""
        seen, notes = self._known.setdefault(name, (set(), {}))
        if time.monotonic() - self._listed.get(name, -1e9) < LISTED_S:
            return notes
        self._listed[name] = time.monotonic()
        fresh = self._folders(name) - seen
        if fresh:
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{x}" for x in sorted(fresh))).collect()  # a row for each version of a set, not its keys
            _merge(notes, [tuple(r) for r in rows], name)
            seen |= fresh
        return notes

    def refresh(self) -> None:
        """Forget the notes in memory, after another process has compacted the store."""
        self._known.clear()
        self._listed.clear()

    # partition keys

    def register(self, partition_key: str, datatype: str) -> None:
        """A key's type is fixed once it is known."""
        if datatype not in TYPES:
            raise ValueError(f"unknown datatype {datatype}")
        known = self.datatype(partition_key)
        if known and known != datatype:
            raise ValueError(f"{partition_key} is {known}")
        if not known:
            self._note([(partition_key, datatype, time.time_ns())], "partitions", _PARTITIONS)

    def datatype(self, partition_key: str) -> str | None:
        row = self._notes("partitions", _PARTITIONS).get(partition_key)
        return row[1] if row and row[1] != DELETED else None

    def partitions(self) -> DataFrame:
        rows = [(k, r[1]) for k, r in sorted(self._notes("partitions", _PARTITIONS).items()) if r[1] != DELETED]
        return self.spark.createDataFrame(rows, "partition_key string, datatype string")

    def delete_partition(self, partition_key: str) -> None:
        now = time.time_ns()
        self._note([(h, partition_key, "", DELETED, None, None, now, None) for h in self._of(partition_key)])
        self._note([(partition_key, DELETED, now)], "partitions", _PARTITIONS)

    # sets

    def put(self, query_hash: str, keys: DataFrame, partition_key: str, datatype: str = "integer", query: str = "", limit: int | None = None, stamp: str | None = None) -> str:
        """Stores the distinct non-null values of the first column of keys, computed once. Returns the status: `failed` beyond the limit."""
        self.register(partition_key, datatype)
        version = time.time_ns()
        values = keys.select(F.col(keys.columns[0]).cast(TYPES[datatype]).alias("pk")).filter("pk is not null").distinct()
        if limit is not None:
            values = values.limit(limit + 1)
        path = f"{self.root}/entries/{partition_key}/{query_hash}-{version}"
        values.select(F.lit(query_hash).alias("query_hash"), F.lit(version).alias("version"), "pk").write.parquet(path)
        n = self.spark.read.schema(f"query_hash string, version long, pk {TYPES[datatype]}").parquet(path).count()
        if limit is not None and n > limit:
            self._drop(path)
            self._note([(query_hash, partition_key, query, FAILED, None, None, version, stamp)])
            return FAILED
        self._note([(query_hash, partition_key, query, OK, n, datetime.now(), version, stamp)])
        return OK

    def set_status(self, query_hash: str, partition_key: str, status: str, query: str = "", stamp: str | None = None) -> None:
        self._note([(query_hash, partition_key, query, status, None, datetime.now(), time.time_ns(), stamp)])

    def set_null(self, query_hash: str, partition_key: str, query: str = "") -> None:
        """The marker of a fragment that is known and has no set."""
        self.set_status(query_hash, partition_key, NULL, query)

    def set_query(self, query_hash: str, partition_key: str, query: str) -> None:
        """The text of a stored set, its keys as they are."""
        row = self._one(query_hash, partition_key)
        if row:
            self._note([(query_hash, partition_key, query, row[3], row[4], datetime.now(), row[6], row[7])])

    def get_query(self, query_hash: str, partition_key: str) -> str | None:
        row = self._one(query_hash, partition_key)
        return row[2] if row else None

    def is_null(self, query_hash: str, partition_key: str) -> bool:
        row = self._one(query_hash, partition_key)
        return bool(row) and row[3] == NULL

    def delete(self, *query_hashes: str, partition_key: str) -> None:
        now = time.time_ns()
        self._note([(h, partition_key, "", DELETED, None, None, now, None) for h in query_hashes])

    def _of(self, partition_key: str | None = None) -> dict[str, tuple]:
        rows = self._notes("queries", _QUERIES)
        return {h if partition_key else (h, k): r for (h, k), r in rows.items() if r[3] != DELETED and partition_key in (None, k)}

    def _one(self, query_hash: str, partition_key: str) -> tuple | None:
        row = self._notes("queries", _QUERIES).get((query_hash, partition_key))
        return row if row and row[3] != DELETED else None

    def queries(self, partition_key: str | None = None) -> DataFrame:
        """The newest state of each fragment that is not deleted."""
        return self.spark.createDataFrame([r[:7] for r in self._of(partition_key).values()], _QUERIES.rpartition(",")[0])

    def keys(self, partition_key: str) -> list[str]:
        return sorted(h for h, r in self._of(partition_key).items() if r[3] == OK)

    def entries(self, partition_key: str, hashes: list[str] | None = None) -> DataFrame:
        """query_hash, pk of the newest sets, from their own folders only."""
        datatype = self.datatype(partition_key)
        names = self.keys(partition_key) if hashes is None else dict.fromkeys(hashes)
        wanted = [(h, r[6]) for h in names if (r := self._one(h, partition_key)) and r[3] == OK]
        schema = f"query_hash string, version long, pk {TYPES[datatype or 'integer']}"
        if not wanted:
            return self.spark.createDataFrame([], schema).select("query_hash", "pk")
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/entries/{partition_key}/{h}-{v}" for h, v in wanted)).select("query_hash", "pk")

    def few(self, query_hash: str, partition_key: str) -> frozenset | None:
        """A small set's keys on the driver, or None. Sets never change, so up to HELD sets of up to FEW keys stay in memory."""
        row = self._one(query_hash, partition_key)
        if not row or row[3] != OK or row[4] > FEW:
            return None
        name = (query_hash, partition_key, row[6])
        if name not in self._few:
            while len(self._few) >= HELD:
                self._few.pop(next(iter(self._few)))
            self._few[name] = frozenset(r.pk for r in self.entries(partition_key, [query_hash]).select("pk").collect())
        return self._few[name]

    def get(self, query_hash: str, partition_key: str) -> DataFrame | None:
        return self.entries(partition_key, [query_hash]).select("pk") if query_hash in self.usable([query_hash], partition_key) else None

    def exists(self, query_hash: str, partition_key: str, check_query: bool = False, stamp: str | None = None) -> bool:
        """Whether a set or null marker is there, of this stamp if one is given; with check_query also fragments known to time out or
        fail count, so that nobody runs them again."""
        row = self._one(query_hash, partition_key)
        return bool(row) and (row[3] in (OK, NULL) or check_query) and (stamp is None or row[7] in (None, stamp))

    def usable(self, hashes: list[str], partition_key: str, stamps: dict[str, str] | None = None) -> dict[str, int]:
        """The fragments among hashes that have a set, with its size. stamps: of the fragments' tables now; sets of others are stale."""
        return {h: r[4] for h in hashes if (r := self._one(h, partition_key)) and r[3] == OK and (not stamps or r[7] in (None, stamps.get(h)))}

    def all_queries(self, partition_key: str) -> DataFrame:
        return self.queries(partition_key).select("query_hash", "query", "last_seen").orderBy(F.desc("last_seen"), "query_hash")

    # upkeep

    def _drop(self, path: str) -> None:
        fs, p = fs_of(self.spark, path)
        fs.delete(p, True)

    def compact(self) -> int:
        """Writes the newest notes as one folder, deletes older notes and the sets that no note names. For times without writers or
        readers. Returns how many folders went."""
        gone = 0
        for name, schema in (("queries", _QUERIES), ("partitions", _PARTITIONS)):
            old = set(self._folders(name))
            state = 3 if name == "queries" else 1
            rows = [r for r in self._notes(name, schema).values() if r[state] != DELETED]
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")
            for x in old:
                self._drop(f"{self.root}/{name}/{x}")
            gone += len(old)
        self.refresh()
        for key in self._folders("entries"):
            named = {f"{h}-{r[6]}" for h, r in self._of(key).items() if r[3] == OK}
            for x in self._folders(f"entries/{key}") - named:
                self._drop(f"{self.root}/entries/{key}/{x}")
                gone += 1
        return gone

    def export(self, partition_key: str, path: str) -> None:
        self.entries(partition_key).write.mode("overwrite").partitionBy("query_hash").parquet(f"{path}/entries")
        notes = self.spark.createDataFrame(list(self._of(partition_key).values()), _QUERIES)
        notes.withColumn("datatype", F.lit(self.datatype(partition_key))).coalesce(1).write.mode("overwrite").parquet(f"{path}/queries")

    def restore(self, path: str, partition_key: str | None = None) -> None:
        """Reads an export, under its own or another partition key; what is here already stays. The sets' rows are read and written once."""
        notes = self.spark.read.parquet(f"{path}/queries").collect()  # a row for each set
        if not notes:
            return
        name = partition_key or notes[0].partition_key
        self.register(name, notes[0].datatype)
        version, here = time.time_ns(), self._of(name)
        fresh = [r for r in notes if r.query_hash not in here]
        ok = [r.query_hash for r in fresh if r.status == OK and r.n_keys]
        base = f"{self.root}/entries/{name}"
        if ok:
            rows = self.spark.read.schema(f"pk {TYPES[notes[0].datatype]}, query_hash string").parquet(f"{path}/entries").filter(F.col("query_hash").isin(ok))
            staging = f"{self.root}/staging/{uuid.uuid4().hex}"
            rows.select(F.col("query_hash").alias("set"), "query_hash", F.lit(version).alias("version"), "pk").write.partitionBy("set").parquet(staging)
            fs, target = fs_of(self.spark, base)
            fs.mkdirs(target)
            for h in ok:  # renames, no rows
                fs.rename(fs_of(self.spark, f"{staging}/set={h}")[1], fs_of(self.spark, f"{base}/{h}-{version}")[1])
            self._drop(staging)
        empty = self.spark.createDataFrame([], f"query_hash string, version long, pk {TYPES[notes[0].datatype]}")
        for r in fresh:
            if r.status == OK and not r.n_keys:
                empty.write.parquet(f"{base}/{r.query_hash}-{version}")
        self._note([(r.query_hash, name, r.query, r.status, r.n_keys, r.last_seen, version, r.stamp) for r in fresh])

    def copy(self, source: str, target: str) -> None:
        """A partition key's sets, with their states, under another name."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        self.export(source, path)
        self.restore(path, target)
        self._drop(path)


def _merge(notes: dict, rows: list[tuple], name: str) -> None:
    for r in rows:
        key, version = ((r[0], r[1]), 6) if name == "queries" else (r[0], 2)
        if key not in notes or notes[key][version] <= r[version]:
            notes[key] = r


def as_arrays(entries: DataFrame) -> DataFrame:
    return entries.groupBy("query_hash").agg(F.array_sort(F.collect_set("pk")).alias("pks"))


def as_bitmaps(entries: DataFrame) -> DataFrame:
    """query_hash, bucket, bits; keys from 0 on, shifted by one so that every bucket follows one formula."""
    key = F.col("pk") + 1
    checked = entries.filter(F.when(F.col("pk") < 0, F.raise_error(F.lit("bitmaps hold no negative keys"))).otherwise(F.lit(True)))
    return checked.groupBy("query_hash", F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """pk (with the other columns) of each bit that is set."""
    others = [c for c in bitmaps.columns if c not in ("bucket", "bits")]
    nibbles = bitmaps.select(*others, "bucket", F.posexplode(F.split(F.hex("bits"), "")).alias("p", "digit")).filter("digit not in ('0', '')")
    value = F.conv("digit", 16, 10).cast("int")
    byte, upper = F.floor(F.col("p") / 2), F.col("p") % 2 == 0
    bits = nibbles.select(*others, "bucket", (byte * 8 + F.when(upper, 4).otherwise(0)).alias("first"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: F.getbit(value, i) == 1)).alias("i"))
    return bits.select(*others, ((F.col("bucket") - 1) * 32768 + F.col("first") + F.col("i")).alias("pk"))
