"""Running a query over only those partitions that its stored fragments allow."""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..functions.distances import planar_bounds
from ..functions.graphs import diameter
from ..plans.fragments import Fragment, Options, cell_sql, fragments, hash_of, spatial_fragments, star_alias, strictest
from ..plans.sql import ATTRIBUTE, EDGE, Conjunct, Query, Unsupported, _split, outer_aliases, parse, render, starred, tokens
from ..sources.folders import stamp
from ..sources.store import FEW, TYPES, Store
from . import spatial
from .intersect import METHODS, by_semi_joins

IN_LIST, VALUES, IN_SUBQUERY, TMP_TABLE_IN, TMP_TABLE_JOIN = "IN", "VALUES", "IN_SUBQUERY", "TMP_TABLE_IN", "TMP_TABLE_JOIN"
#: Keys that an IN list or VALUES may hold; beyond it the keys stay a table, and Stats.method says so.
MOST_LITERALS = 10_000
#: Up to so many sets meet in semi-joins, the smallest first, which Spark broadcasts where they are small; more are divided.
FEW_SETS = 4


@dataclass(frozen=True)
class Stats:
    generated_variants: int
    cache_hits: int
    enhanced: bool
    p0_rewritten: bool = False
    method: str | None = None  # the form that was used
    reason: str = ""  # why the query ran as it is


def stamps_of(spark: SparkSession, found: list[Fragment]) -> dict[str, str]:
    """The stamp of each fragment's tables now."""
    tables = {t: stamp(spark.table(t)) for t in {t for f in found for t in f.tables if t}}
    return {f.hash: hash_of("".join(tables[t] for t in sorted(set(f.tables)))) if all(f.tables) else stamp(spark.sql(f.sql)) for f in found}


def keys_for(store: Store, sql: str, partition_key: str, key: dict[str, str] | str, options: Options = Options(), encoding: str = "division") -> tuple[DataFrame | None, int, int]:
    """(keys, fragments generated, fragments found). No keys: nothing known. An empty set among the found makes it empty."""
    keys, variants, hits, _ = _looked_up(store, sql, partition_key, key, options, encoding)
    return keys, variants, hits


def _looked_up(store: Store, sql: str, partition_key: str, key: dict[str, str] | str, options: Options, encoding: str) -> tuple[DataFrame | None, int, int, int]:
    found = fragments(sql, key, options, lookup=True)
    named = store.usable([f.hash for f in found], partition_key)
    found_here = [f for f in found if f.hash in named]
    sizes = store.usable(list(named), partition_key, stamps_of(store.spark, found_here)) if named else {}
    if not sizes:
        return None, len(found), 0, 0
    if 0 in sizes.values():
        return store.spark.createDataFrame([], f"pk {TYPES[store.datatype(partition_key)]}"), len(found), len(sizes), 0
    used = sorted((f.hash for f in strictest([f for f in found_here if f.hash in sizes])), key=lambda h: (sizes[h], h))
    if encoding == "division" and sizes[used[0]] <= FEW and (small := [k for h in used if (k := store.few(h, partition_key)) is not None]):
        # a small set bounds the keys by itself: no job looks them up
        return local_keys(store.spark, frozenset.intersection(*small), store.datatype(partition_key)), len(found), len(sizes), sizes[used[0]]
    if encoding == "division" and len(used) <= FEW_SETS:
        keys = by_semi_joins([store.entries(partition_key, [h]).select("pk") for h in used])
    else:
        keys = METHODS[encoding](store.entries(partition_key, used), len(used))
    return keys, len(found), len(sizes), sizes[used[0]]


def local_keys(spark: SparkSession, keys: frozenset, datatype: str) -> DataFrame:
    """Keys that the driver holds, as a table within the plan."""
    text = json.dumps([x if isinstance(x, str) else x.isoformat() if isinstance(x, datetime) else repr(x) for x in sorted(keys)])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<string>").cast(f"array<{TYPES[datatype]}>")).alias("pk"))


def with_hub(q: Query, hub_table: str, hub_key: str, alias: str = "p0") -> Query:
    """Key joins among the tables replaced by one join of each with a hub of all keys; a query that has a hub stays."""
    if star_alias(q, Options()) or alias in q.relations:
        return q
    group = max(q.key_groups(), key=len)
    others = [c for c in q.conjuncts if not (c.kind == "key join" and c.aliases <= group)]
    joins = [Conjunct(f"{a}.{q.key[a]} = {alias}.{hub_key}", frozenset([a, alias]), "key join") for a in sorted(group) if a in q.key]
    return replace(starred(q), relations=q.relations | {alias: hub_table}, conjuncts=tuple(others + joins), key=q.key | {alias: hub_key})


def restricted_sql(spark: SparkSession, q: Query, keys: DataFrame, method: str, only: str | None = None, root: str | None = None) -> tuple[str, str]:
    """(the query's text with its tables held to the keys, the form used); views of random names carry the keys where the text cannot.
    root: where the table forms write the keys, once for all tables that are held to them."""
    group = sorted(max(q.key_groups(), key=lambda g: (len(g & set(q.key)), sorted(g))) & set(q.key))
    targets = [only] if only else group
    if method in (IN_LIST, VALUES):
        rows = keys.limit(MOST_LITERALS + 1).collect()
        if len(rows) > MOST_LITERALS:
            method = IN_SUBQUERY
    name = f"keys_{uuid.uuid4().hex[:12]}"
    if method in (IN_LIST, VALUES):
        literals = [_literal(r[0]) for r in rows]
        if not literals:
            more = [Conjunct("1 = 0", frozenset(), ATTRIBUTE)]
        elif method == IN_LIST:
            more = [Conjunct(f"{a}.{q.key[a]} IN ({', '.join(literals)})", frozenset([a]), ATTRIBUTE) for a in targets]
        else:
            inline = ", ".join(f"({x})" for x in literals)
            more = [Conjunct(f"{a}.{q.key[a]} IN (SELECT pk FROM VALUES {inline} AS v(pk))", frozenset([a]), ATTRIBUTE) for a in targets]
        return replace(q, conjuncts=(*q.conjuncts, *more)).sql(), method
    if method in (TMP_TABLE_IN, TMP_TABLE_JOIN) and root:
        keys.distinct().write.parquet(f"{root}/temporary/{name}")
        keys = spark.read.schema(keys.schema).parquet(f"{root}/temporary/{name}")
    keys.createOrReplaceTempView(name)
    if method == TMP_TABLE_JOIN:
        joined = {f"{name}_{a}": name for a in targets}
        more = [Conjunct(f"{a}.{q.key[a]} = {name}_{a}.pk", frozenset([a]), ATTRIBUTE) for a in targets]
        return replace(starred(q), relations=q.relations | joined, conjuncts=(*q.conjuncts, *more)).sql(), method
    more = [Conjunct(f"{a}.{q.key[a]} IN (SELECT pk FROM {name})", frozenset([a]), ATTRIBUTE) for a in targets]
    return replace(q, conjuncts=(*q.conjuncts, *more)).sql(), method


def _literal(x: object) -> str:
    if isinstance(x, float):
        return f"{x!r}D" if math.isfinite(x) else f"DOUBLE('{x}')"
    if isinstance(x, bool | int):
        return repr(x)
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(x, datetime):
        return f"TIMESTAMP_NTZ '{x}'"
    raise TypeError(f"no key of type {type(x).__name__}")


def apply(store: Store, sql: str, partition_key: str, key: dict[str, str] | str, method: str = IN_SUBQUERY, options: Options = Options(min_size=2), encoding: str = "division", hub_table: str | None = None, hub_key: str | None = None, hub_alias: str = "p0", total: int | None = None, most_share: float = 0.5, least_bytes: int = 0) -> tuple[DataFrame, Stats]:
    """The query's own rows, read from the allowed partitions only. Without hits, where pruning would not be sound, where the sets leave more
    than most_share of `total` keys, where the tables' files hold less than least_bytes (a plain scan then takes less than the lookup), or where
    the rewritten text does not parse, the query as it is."""
    spark = store.spark
    try:
        q = parse(sql, key)
    except Unsupported as e:
        return spark.sql(sql), Stats(0, 0, False, reason=str(e))
    if least_bytes and not hub_table and (size := bytes_of(spark, q)) < least_bytes:
        return spark.sql(sql), Stats(0, 0, False, reason=f"tables of {size} bytes")
    keys, variants, hits, least = _looked_up(store, sql, partition_key, key, options, encoding)
    rewritten = with_hub(q, hub_table, hub_key or "pk", hub_alias) if hub_table else q
    hub = rewritten is not q
    try:
        if keys is None:
            return spark.sql(rewritten.sql() if hub else sql), Stats(variants, 0, False, hub, reason="no set is known")
        if total and least > most_share * total:
            return spark.sql(sql), Stats(variants, hits, False, reason=f"{least} of {total} keys are left")
        text, used = restricted_sql(spark, rewritten, keys, method, hub_alias if hub else None, store.root)
        return spark.sql(text), Stats(variants, hits, True, hub, used)
    except (ParseException, AnalysisException) as e:
        return spark.sql(sql), Stats(variants, hits, False, reason=f"the rewritten text failed: {str(e)[:120]}")


def bytes_of(spark: SparkSession, q: Query) -> int:
    """What Spark's statistics say of the size of the query's tables."""
    return sum(int(str(spark.table(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in set(q.relations.values()))


def register_distances(spark: SparkSession) -> None:
    """DIST and ST_DWithin on planar coordinates, as SQL functions."""
    far = "SQRT((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION DIST(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN {far}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ST_DWithin(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, d DOUBLE) RETURNS BOOLEAN RETURN {far} <= d")


def by_distance(spark: SparkSession, q: Query, geometry: dict[str, tuple[str, str]], cells: DataFrame | None = None, size: float = 1.0, once: bool = False) -> DataFrame:
    """The rows of a query whose tables are joined by planar distances, without a cross join: the rows of the table with the most bounds meet,
    cell by cell of a grid, all tables that must be near to it, as arrays, so that only rows are moved between tasks and no pairs; tables
    that are near to others alone follow in the same way. cells: keys of the cells that points may lie in. once: the caller makes the rows distinct,
    so that of a table that nothing more names it is asked whether it has a row, not which. Tables are rows of structs, so that the query's
    own texts apply."""
    bounds = planar_bounds(q)

    def one(a: str) -> DataFrame:
        df = spark.table(q.relations[a]).select(F.struct("*").alias(a))
        for c in q.conjuncts:
            if c.aliases == {a}:
                df = df.filter(c.text)
        if cells is not None and a in {x for b in bounds for x in b[:2]}:
            x, y = (f"{a}.{c}" for c in geometry[q.relations[a]])
            df = df.join(cells.select(F.col("pk").alias("__cell")), F.expr(cell_sql(x, y, size)) == F.col("__cell"), "left_semi")
        return df

    left = list(q.relations)
    hub = max(left, key=lambda a: (sum(a in b[:2] for b in bounds), -left.index(a)))
    out, have = one(hub), {hub}
    left.remove(hub)
    said = sorted((c for c in q.conjuncts if len(c.aliases) > 1), key=lambda c: "(" in c.text)  # plain comparisons first
    implied = _implied(said, {(a, f.name.lower()): f.dataType for a, t in q.relations.items() for f in spark.table(t).schema.fields if isinstance(f.dataType, AtomicType)})
    select = tokens(starred(q).select)
    while left:
        hub = hub if any(hub in b[:2] and not set(b[:2]) <= have for b in bounds) else next((a for b in bounds for a in b[:2] if a in have and not set(b[:2]) <= have), None)
        if not hub:
            raise Unsupported("tables that no distance joins")
        far: dict[str, float] = {}
        for a, b, d in bounds:
            if hub in (a, b) and not {a, b} <= have:
                new = b if a == hub else a
                far[new] = min(d, far.get(new, d))
        width = max(far.values()) or 1.0
        place = lambda a: tuple(f"{a}.{c}" for c in geometry[q.relations[a]])
        out = spatial.dealt(out, width, place(hub), [f"{a}.`{f.name}`" for a in sorted(have) for f in out.schema[a].dataType.fields if isinstance(f.dataType, AtomicType)])
        # what can be said of a row and the tables before it is said of the arrays, so that no row is made to be dropped
        tests = {a: [(c, text) for c in said + implied if a in c.aliases and c.aliases <= have | {a} and (text := _plain(c.text))] for a in far}
        told = {c for a in far for c, _ in tests[a]}
        said = [c for c in said if c not in told]
        ahead = [t for c in said for t in tokens(c.text)] + [t for b in bounds if not set(b[:2]) <= have | set(far) for a in b[:2] for t in tokens(" ".join(place(a)))]
        named = {*outer_aliases(" ".join([render(select), *(c.text for c in said)]), q.relations), *(a for b in bounds if not set(b[:2]) <= have | set(far) for a in b[:2])}
        for a in far:
            out = spatial.gathered(out, one(a), width, place(a), F.col(a), f"__{a}")
        lone: dict[str, str] = {}  # the one column that is left of a table: its array holds plain values, a third of the bytes
        for a, d in far.items():
            test = " AND ".join([_within(place(a), place(hub), d), *(text for _, text in tests[a])])
            if once and a not in named:
                out = out.filter(F.expr(f"exists(`__{a}`, {a} -> {test})")).drop(f"__{a}")
                continue
            names = out.schema[f"__{a}"].dataType.elementType.names
            kept = _needed(names, a, select + ahead)
            lone |= {a: kept[0]} if len(kept) == 1 else {}
            row = f"{a}.`{kept[0]}`" if a in lone else a if kept == names else f"named_struct({', '.join(f"'{n}', {a}.`{n}`" for n in kept)})"
            out = out.withColumn(f"__{a}", F.expr(f"transform(filter(`__{a}`, {a} -> {test}), {a} -> {row})"))
        have |= set(far) - (asked := {a for a in far if f"__{a}" in out.columns})
        left = [a for a in left if a not in have]
        for i, a in enumerate(a for a in far if a in asked):
            out = spatial.apart(out) if i else out
            # outer: else the optimiser works the array out once more, to see whether it has rows
            out = out.select("*", F.posexplode_outer(f"__{a}").alias("__i", a)).drop(f"__{a}").filter(F.col("__i").isNotNull()).drop("__i")
            out = out.withColumn(a, F.struct(F.col(a).alias(lone[a]))) if a in lone else out
            have.add(a)
            left.remove(a)
            for c in [c for c in said if c.aliases <= have]:
                out = out.filter(c.text)
                said.remove(c)
    return out.selectExpr(*(render(p) for _, p in _split(tokens(starred(q).select.replace(".*", ".*")), {","})))


def _within(xy: tuple[str, str], hub_xy: tuple[str, str], distance: float) -> str:
    """Whether a gathered row may lie within the distance of the hub's; the query's own bound follows."""
    x, y = (f"({p} - {h}) * ({p} - {h})" for p, h in zip(xy, hub_xy, strict=True))
    return f"{x} + {y} <= {distance * distance * (1 + 1e-9)!r}D"


_COLUMN = r"(\w+\.\w+)"
_COMPARED = re.compile(rf"{_COLUMN} (<=|<|>=|>|=|<>) {_COLUMN}")


def _plain(text: str) -> str | None:
    """A comparison of columns, or a bound on DIST or ST_DWithin of columns with the distance written out, since lambdas take no SQL functions."""
    if _COMPARED.fullmatch(text):
        return text
    number = r"\d+(?:\.\d+)?"
    columns = ", ".join([_COLUMN] * 4)
    if m := re.fullmatch(rf"DIST\({columns}\) ((?:<=|<|>=|>) {number}|BETWEEN {number} AND {number})", text, re.I):
        bound = m[5]
    elif m := re.fullmatch(rf"ST_DWithin\({columns}, ({number})\)", text, re.I):
        bound = f"<= CAST({m[5]} AS DOUBLE)"
    else:
        return None
    x1, y1, x2, y2 = (f"CAST({m[i]} AS DOUBLE)" for i in range(1, 5))
    return f"SQRT(({x1} - {x2}) * ({x1} - {x2}) + ({y1} - {y2}) * ({y1} - {y2})) {bound}"


def _implied(said: list[Conjunct], kinds: dict[tuple[str, str], object]) -> list[Conjunct]:
    """The comparisons that follow from those that a query states of columns of one type: a < c from a < b and b < c."""
    less: dict[tuple[str, str], bool] = {}  # (smaller, larger): never equal
    for c in said:
        if (m := _COMPARED.fullmatch(c.text)) and m[2][0] in "<>" and m[2] != "<>":
            a, b = (m[1], m[3]) if m[2][0] == "<" else (m[3], m[1])
            kind = [kinds.get((x.split(".")[0], x.split(".")[1].lower())) for x in (a, b)]
            if kind[0] is not None and kind[0] == kind[1]:
                less[a, b] = less.get((a, b), False) or "=" not in m[2]
    known = set(less)
    while more := {(a, c): s or t for (a, b), s in less.items() for (b_, c), t in less.items() if b == b_ and a != c and (a, c) not in less}:
        less |= more
    return [Conjunct(f"{a} {'<' if s else '<='} {b}", frozenset(x.split(".")[0] for x in (a, b)), EDGE) for (a, b), s in less.items() if (a, b) not in known and a.split(".")[0] != b.split(".")[0]]


def _needed(names: list[str], alias: str, ahead: list[str]) -> list[str]:
    """The columns of a row that something ahead names; one at least."""
    if any(ahead[i : i + 3] == [alias, ".", "*"] for i in range(len(ahead))):
        return names
    named = {t.strip("`").lower() for t in ahead}
    return [n for n in names if n.lower() in named] or names[:1]


def spatial_keys(store: Store, q: Query, name: str, geometry: dict[str, tuple[str, str]], size: float, options: Options = Options()) -> tuple[DataFrame | None, int, int]:
    """(cells that points of the query's rows can lie in, fragments generated, found). Each fragment's cells are widened by the query's reach:
    how far apart the points of one row can lie."""
    bounds = planar_bounds(q)
    found = spatial_fragments(q, geometry, size, bounds, options)
    sizes = store.usable([f.hash for f in found], name, stamps_of(store.spark, found))
    if not sizes:
        return None, len(found), 0
    far = diameter(bounds)
    each = [spatial.widened(store.entries(name, [h]).select("pk"), far, size) for h in sizes]
    keys = each[0]
    for more in each[1:]:
        keys = keys.join(more, "pk", "left_semi")
    return keys, len(found), len(sizes)


def apply_spatial(store: Store, sql: str, name: str, geometry: dict[str, tuple[str, str]], size: float, options: Options = Options()) -> tuple[DataFrame, Stats]:
    """As `apply` for queries whose tables are joined by distances: their points are held to the cells that stored fragments allow."""
    q = parse(sql, {})
    bounds = planar_bounds(q)
    if not bounds or q.tail or {x for b in bounds for x in b[:2]} != set(q.relations) or any(t not in geometry for t in q.relations.values()):
        return store.spark.sql(sql), Stats(0, 0, False, reason="not all tables are joined by distances")
    keys, variants, hits = spatial_keys(store, q, name, geometry, size, options)
    return by_distance(store.spark, q, geometry, keys, size), Stats(variants, hits, keys is not None, method="cells" if hits else None)
