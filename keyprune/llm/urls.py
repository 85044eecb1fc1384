"""URL filters: rules first, then the ratio of two character language models. DataFrame functions only.

Two smoothed variable-order Markov models, of the URLs that the rules accept and of those that they reject,
give each URL the mean over its characters of log p(accepted) - log p(rejected). Order k backs off to order
k - 1: p_k = (n(context, char) + SMOOTH * p_(k-1)) / (n(context) + SMOOTH). Counts are exact:
a position's characters of all orders are its window, and each distinct window of the table meets the counts
in joins once, its positions the result. The models learn from the URLs that a rule judges but for a part held out by a
hash, on which the threshold is calibrated: the point between the two classes' means, each as far in its own standard
deviations. Where the held-out part lacks a class, all judged URLs stand in for it.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and is scored by the
models as the empty text (0); without accepted URLs in the table all others are blocked if any is rejected,
else allowed; a score at the threshold is allowed; very long URLs are scored whole; repeated rows are judged each; an
empty table gives an empty table; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

ORDERS = 4
SMOOTH = 2.0
#: Copies of a window's ratio over which its positions are spread.
SALTS = 16
#: Ratios are summed in steps of this, in any order with one result.
UNIT = 2.0**-36
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, then path from its first slash

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def _marked(host: Column, path: Column) -> Column:
    return F.concat(F.lit("\x02" * ORDERS), host, path)


def _positions(s: Column) -> Column:
    return F.when(F.length(s) > ORDERS, F.sequence(F.lit(1), F.length(s) - ORDERS)).otherwise(F.array().cast("array<int>"))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, window, from rows (keys, s): the ORDERS characters that end in each character of s; s starts with ORDERS marks."""
    return rows.select(*keys, "s", F.explode(_positions(F.col("s"))).alias("i")).select(*keys, F.substr("s", F.col("i") + 1, F.lit(ORDERS)).alias("window"))


def learn(rows: DataFrame) -> DataFrame:
    """From columns s and ruled (null: no rule): window, allow, block, the counts of each window of any row in those that a rule judges."""
    count = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)).alias(v)
    return _windows(rows, "ruled").groupBy("window").agg(count("allow"), count("block"))


def ratios(seen: DataFrame) -> DataFrame:
    """window, ratio: log p(accepted) - log p(rejected) of its last character after the others, in UNIT."""
    out = seen.select("window")
    p = {v: F.lit(1 / 256) for v in ("allow", "block")}
    for k in range(ORDERS):
        for kind, n in (("c", k), ("g", k + 1)):
            # of the ORDERS - 1 characters before the last one the k last; for g, with the last one
            part, key = F.substr("window", F.lit(ORDERS - k), F.lit(n)), f"{kind}{k}"
            counts = seen.groupBy(part.alias(key)).agg(*(F.sum(v).alias(f"{key}_{v}") for v in p))
            out = out.withColumn(key, part).join(F.broadcast(counts) if n < 2 else counts, key).drop(key)
        p = {v: (F.col(f"g{k}_{v}") + SMOOTH * q) / (F.col(f"c{k}_{v}") + SMOOTH) for v, q in p.items()}
    return out.select("window", F.round((F.ln(p["allow"]) - F.ln(p["block"])) / UNIT).cast("long").alias("ratio"))


def scores(rows: DataFrame, found: DataFrame) -> DataFrame:
    """row, score: the mean ratio over the characters of s, of rows (row, s) that have any."""
    salted = found.select("window", "ratio", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    at = _windows(rows, "row").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    return at.join(salted, ["window", "salt"]).groupBy("row").agg((F.sum("ratio") * UNIT / F.count("*")).alias("score"))


def held_out(url: Column) -> Column:
    """Three sixteenths of all URLs, by hash: models do not learn from these, the threshold is calibrated on them."""
    return F.substring(F.md5(url), 1, 1) < "3"


def _spread(rows: list) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each verdict's scores."""
    out = {}
    for v in sorted({r.verdict for r in rows}):
        n, s, q = (sum(r[k] for r in rows if r.verdict == v) for k in ("n", "s", "q"))
        out[v] = (s / n, math.sqrt(max(0.0, q / n - (s / n) ** 2)))
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(by_rule)
    split = split.withColumns({"ruled": by_rule, "tried": held_out(F.concat("host", "path"))})
    split = stored(split.select("*", F.monotonically_increasing_id().alias("row"), _marked(F.col("host"), F.col("path")).alias("s")))
    found = stored(ratios(stored(learn(split.withColumn("ruled", F.when(~F.col("tried"), F.col("ruled")))))))
    split = stored(split.join(scores(split, found), "row", "left").drop("row", "s").withColumn("score", F.coalesce("score", F.lit(0.0))))
    judged = split.filter(F.col("ruled").isNotNull())
    parts = judged.groupBy(F.col("ruled").alias("verdict"), "tried").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")).collect()
    some = [r for r in parts if r.tried]
    spread = _spread(some if len({r.verdict for r in some}) == 2 else parts)
    if len(spread) == 2:
        a, b = spread["allow"], spread["block"]
        least = (a[0] * (b[1] + 1e-9) + b[0] * (a[1] + 1e-9)) / (a[1] + b[1] + 2e-9)
    else:
        least = float("inf") if "block" in spread else float("-inf")
    return split.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def _order_sql(k: int) -> str:
    """The counts of order k's contexts and grams, for OP6_SQL."""
    part = f"substring(win, {ORDERS - k}, {{}})"
    return f"""
c{k} AS (SELECT {part.format(k)} AS x, sum(allow) AS a, sum(block) AS b FROM seen GROUP BY 1),
g{k} AS (SELECT {part.format(k + 1)} AS x, sum(allow) AS a, sum(block) AS b FROM seen GROUP BY 1),
p{k + 1} AS (SELECT p.win, (g.a + {SMOOTH} * p.pa) / (c.a + {SMOOTH}) AS pa, (g.b + {SMOOTH} * p.pb) / (c.b + {SMOOTH}) AS pb
  FROM p{k} p JOIN c{k} c ON c.x = {part.format(k)} JOIN g{k} g ON g.x = {part.format(k + 1)}),"""


OP6_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fitted AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/' END AS rule
  FROM split),
ruled AS (
  SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
         md5(host || path)[1] < '3' AS tried, repeat(chr(2), {ORDERS}) || host || path AS s
  FROM fitted),
places AS (SELECT r, ruled, tried, substring(s, i + 1, {ORDERS}) AS win FROM (SELECT *, unnest(range(1, length(s) - {ORDERS} + 1)) AS i FROM ruled)),
seen AS (
  SELECT win, count(*) FILTER (WHERE ruled = 'allow' AND NOT tried) AS allow, count(*) FILTER (WHERE ruled = 'block' AND NOT tried) AS block
  FROM places GROUP BY win),
p0 AS (SELECT win, 1.0::DOUBLE / 256 AS pa, 1.0::DOUBLE / 256 AS pb FROM seen),{"".join(map(_order_sql, range(ORDERS)))}
ratios AS (SELECT win, round((ln(pa) - ln(pb)) * 68719476736.0)::BIGINT AS ratio FROM p{ORDERS}),
scored AS (SELECT r, sum(ratio)::DOUBLE / 68719476736.0 / count(*) AS score FROM places JOIN ratios USING (win) GROUP BY r),
judged AS (SELECT ruled.*, coalesce(score, 0.0) AS score FROM ruled LEFT JOIN scored USING (r)),
held AS (SELECT count(DISTINCT ruled) = 2 AS enough FROM judged WHERE ruled IS NOT NULL AND tried),
spread AS (
  SELECT ruled, avg(score) AS mean, stddev_pop(score) AS sd FROM judged, held WHERE ruled IS NOT NULL AND (tried OR NOT enough) GROUP BY ruled),
cut AS (
  SELECT CASE WHEN a.mean IS NOT NULL AND b.mean IS NOT NULL THEN (a.mean * (b.sd + 1e-9) + b.mean * (a.sd + 1e-9)) / (a.sd + b.sd + 2e-9)
              WHEN b.mean IS NOT NULL THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS least
  FROM (SELECT 1) LEFT JOIN spread a ON a.ruled = 'allow' LEFT JOIN spread b ON b.ruled = 'block')
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM judged, cut
"""
