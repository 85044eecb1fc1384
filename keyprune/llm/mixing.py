"""Mixing sources to target weights.

Sources in code-point order (null last) weigh as the given cycle of weights and share all words; a target
stops at `most` times its source's size and the excess goes to the others by weight. Every document gets a
hash-random key, of its doc_id and text; documents are range-sorted by key within their source (ranges: leading digits of the key),
a prefix sum runs over the ranges' totals and on within each range, and each source is cut at its exact
budget: whole epochs first, then the documents in key order, the last one being taken in part.

Defined results: a null text has size 0; a source without words has target 0; rows of equal key (repeated
rows) are taken one after another; a very long text is one document, cut between words; null doc_ids are keyed by
their texts; an empty table gives an empty table; `mix` keeps all columns, whatever their names but those that start with
`__keyprune_`, which are reserved; a column n_chars follows a text that is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
#: Rows of a source in one range of keys, on average.
RANGE_ROWS = 4000


_OWN = "__keyprune_"


def _keyed(docs: DataFrame, digits: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.withColumns({f"{_OWN}size": size, f"{_OWN}key": key, f"{_OWN}source": source}).withColumn(f"{_OWN}range", F.substring(f"{_OWN}key", 1, digits))


def _budgets(ranges: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """For each source and range: the words before it, the source's size, target, epochs and rest, in a struct."""
    place = Window.orderBy(F.col("source") == "", "source")
    by_fill = Window.orderBy(F.col("s") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = ranges.groupBy("source").agg(F.sum("words").alias("s"))  # one row for each source
    sources = sources.withColumn("n", F.row_number().over(place)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1))
    # the filled sources are those of the smallest size for their weight; the level rises while they are passed and then falls
    level = (F.sum("s").over(every) - F.coalesce(F.sum(most * F.col("s")).over(by_fill), F.lit(0))).cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_fill), F.lit(0))).cast("double")
    sources = sources.withColumn("level", level).withColumn("target", F.least((most * F.col("s")).cast("double"), F.max("level").over(every) * F.col("w")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("s") > 0, F.floor(budget / F.greatest("s", F.lit(1)))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("s"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    plan = F.struct("before", F.col("s").alias("source_size"), "target", "epochs", "rest").alias(f"{_OWN}plan")
    return ranges.withColumn("before", before).join(sources, "source").select(F.col("source").alias(f"{_OWN}source"), F.col("range").alias(f"{_OWN}range"), plan)


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """docs with columns of reserved names: size, plan, and the words that the last, partial epoch takes."""
    hottest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, hottest / RANGE_ROWS), 16)))
    keyed = _keyed(docs, digits)
    ranges = stored(keyed.groupBy(F.col(f"{_OWN}source").alias("source"), F.col(f"{_OWN}range").alias("range")).agg(F.sum(f"{_OWN}size").alias("words")))
    w = Window.partitionBy(f"{_OWN}source", f"{_OWN}range").orderBy(f"{_OWN}key", "doc_id", f"{_OWN}size")
    rows = keyed.join(_budgets(ranges, weights, most), [f"{_OWN}source", f"{_OWN}range"])
    before = F.col(f"{_OWN}plan.before") + F.sum(f"{_OWN}size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{_OWN}size")
    return rows.withColumn(f"{_OWN}part", F.greatest(F.lit(0), F.least(f"{_OWN}size", F.col(f"{_OWN}plan.rest") - before)).cast("long"))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = _planned(docs.select("doc_id", "source", "text"), weights, most)
    size, plan = F.col(f"{_OWN}size"), lambda x: F.col(f"{_OWN}plan.{x}")
    return rows.select("doc_id", size.alias("size"), plan("source_size").alias("source_size"), plan("target").alias("target"), (plan("epochs") * size + F.col(f"{_OWN}part")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows: one for each epoch that takes the document; the one cut at a budget ends after its last word taken."""
    rows = _planned(docs, weights, most)
    size, part, epochs = F.col(f"{_OWN}size"), F.col(f"{_OWN}part"), F.col(f"{_OWN}plan.epochs")
    copies = epochs + F.when(part > 0, 1).otherwise(0)
    rows = rows.filter(copies > 0).withColumn(f"{_OWN}epoch", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    partly = (F.col(f"{_OWN}epoch") > epochs) & (part < size)
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    new = {"text": F.when(partly, F.array_join(F.slice(words, F.lit(1), F.greatest(part, F.lit(1)).cast("int")), "")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(partly, F.length(new["text"]).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns(new).select(*docs.columns)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix', coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
weighted AS (SELECT *, (n - 1) % 3 + 1 AS w FROM sources),
levels AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE AS level
  FROM weighted WINDOW f AS (ORDER BY s / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least((3 * s)::DOUBLE, max(level) OVER () * w) AS target FROM levels),
budgets AS (SELECT *, floor(target + 0.5)::BIGINT AS b, CASE WHEN s > 0 THEN floor(target + 0.5)::BIGINT // s ELSE 0 END AS e FROM targets)
SELECT doc_id, size, s AS source_size, target,
       (e * size + greatest(0, least(size, b - e * s
         - (sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))))::BIGINT AS taken
FROM sized JOIN budgets ON sized.source IS NOT DISTINCT FROM budgets.source
"""
