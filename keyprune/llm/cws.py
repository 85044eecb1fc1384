"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A document is its words (white space splits, A-Z in lower case) weighted by their counts. For each of SAMPLES
draws every word has its own r and c from Gamma(2, 1) and its own uniform beta, all taken from hashes of the
word and the draw, 32 bits for each uniform; with weight S it gets t = floor(ln S / r + beta) and
ln a = ln c - r (t - beta) - r. The word of the smallest a is the sample, and (word, t) its value: two documents
agree in a draw with the probability of their generalised Jaccard similarity, sum of minima / sum of maxima of the
weights. Each draw keeps 23 bits of its value, six hexadecimal digits of the fingerprint.

Logarithms are the cost, and most words cannot be the sample: with p and q the products of uniforms whose negative
logarithms are r and c, a is at least 2 p (1 - q) / (1 + q) / S, and the smallest a of a document of weight W is Exp(W). A word
whose bound lies beyond SURE / W is passed over; that all of a document's words do so has the probability
exp(-SURE), 4e-18 for a draw, which then counts as 000000. A document and its edited text share their words' r and c.

Defined results: a null text counts as empty; texts without words share one fingerprint of `-` and are alike
(1) among themselves, unlike (0) all others; the order of documents is descending doc_id, null last, equal ones by text;
the last one's next document is the first (a lone document's is itself); very long texts are split whole, in one row;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, read

SAMPLES = 64
SURE = 40
_BITS = 23
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signatures(words: DataFrame, keys: list[str], kinds: int = 1, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint_0 .., from rows (keys, kind: 0 .. kinds - 1, word: its hash); a document may have texts of several kinds.
    Rows of equal keys must lie in one partition, or are shuffled. A row for each word and draw, of which the bound leaves few, costs
    less than an expression for each draw: the code stays small enough to be compiled."""
    counted = words.groupBy(*keys, "word").agg(*(F.sum((F.col("kind") == i).cast("long")).alias(f"__n{i}") for i in range(kinds)))
    whole = Window.partitionBy(*keys)
    share = F.greatest(*(F.col(f"__n{i}") / F.nullif(F.sum(f"__n{i}").over(whole), F.lit(0)) for i in range(kinds)), F.lit(0.0))
    counted = counted.select(*keys, "word", (share * float(SURE)).alias("__bound"), *(F.ln(F.nullif(f"__n{i}", F.lit(0))).alias(f"__ln{i}") for i in range(kinds)))
    lower, upper = (lambda h: (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) / 4294967296.0), (lambda h: (F.shiftrightunsigned(h, 32) + 0.5) / 4294967296.0)
    draws = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("__j")).withColumn("__one", F.xxhash64("word", "__j")).withColumn("__two", F.xxhash64("__one"))
    draws = draws.withColumns({"__p": lower("__one") * upper("__one"), "__q": lower("__two") * upper("__two")})
    draws = draws.filter("__p * 2.0D * (1.0D - __q) < __bound * (1.0D + __q)")  # -ln q is 2 (1 - q) / (1 + q) at least
    draws = draws.withColumns({"__r": -F.ln("__p"), "__lc": F.ln(-F.ln("__q")), "__three": F.xxhash64("__two")}).withColumn("__beta", lower("__three"))
    draws = draws.withColumns({f"__t{i}": F.floor(F.col(f"__ln{i}") / F.col("__r") + F.col("__beta")) for i in range(kinds)})
    place = lambda i: F.floor((F.col("__lc") - F.col("__r") * (F.col(f"__t{i}") - F.col("__beta")) - F.col("__r") + 128.0) * 4294967296.0)
    value = lambda i: F.shiftleft(place(i), _BITS).bitwiseOR(F.col("__two").bitwiseXOR(F.col(f"__t{i}")).bitwiseAND(F.lit((1 << _BITS) - 1)))
    drawn = draws.groupBy(*keys, "__j").agg(*(F.min(value(i)).alias(f"__v{i}") for i in range(kinds)))
    rows = drawn.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.struct("__j", f"__v{i}"))).alias(f"__m{i}") for i in range(kinds)), *(F.max(f"__v{i}").alias(f"__any{i}") for i in range(kinds)))
    digits = lambda i: F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda j: F.lpad(F.lower(F.hex(F.coalesce(F.try_element_at(f"__m{i}", j), F.lit(0)).bitwiseAND(F.lit((1 << _BITS) - 1)))), 6, "0"))
    return rows.select(*keys, *(F.when(F.col(f"__any{i}").isNotNull(), F.array_join(digits(i), "")).alias(f"fingerprint_{i}") for i in range(kinds)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of draws in which two fingerprints agree."""
    same = sum((F.substring(a, 6 * j + 1, 6) == F.substring(b, 6 * j + 1, 6)).cast("int") for j in range(samples))
    return F.when((a == "-") | (b == "-"), (a == b).cast("double")).otherwise(same / float(samples))


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _with_next(docs: DataFrame) -> DataFrame:
    """part, rn, head, doc_id, text, next_text. Documents lie in ranges of doc_id, each in one partition and followed there by
    a copy (head) of the first document of the range below, or of the very first."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).head()[0]
    cuts = sorted(set(cuts or []))  # fewer than n numbers
    wide = max(1, math.isqrt(len(cuts)))
    coarse = F.size(F.filter(_literal(cuts[::wide], "bigint"), lambda b: b <= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(_literal(cuts, "bigint"), (F.greatest(F.col("__c"), F.lit(1)) - 1) * wide + 1, F.lit(wide)), lambda b: b <= F.col("doc_id")))
    docs = docs.withColumn("__c", F.coalesce(coarse, F.lit(0))).withColumn("part", F.coalesce(F.when(F.col("doc_id").isNull(), -1).when(F.col("__c") == 0, 0).otherwise((F.col("__c") - 1) * wide + fine), F.lit(0))).drop("__c")
    tops = {r.part: r.top for r in docs.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # at most n + 1 rows
    order = sorted(tops, reverse=True)
    first = docs.filter(F.col("doc_id").isin([t for t in tops.values() if t is not None]) | F.col("doc_id").isNull()).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    above = F.get(_literal(order, "int"), F.pmod(F.array_position(_literal(order, "int"), F.col("part")).cast("int") - 2, F.lit(max(1, len(order)))))
    both = docs.withColumn("head", F.lit(0)).unionByName(first.withColumn("part", above).withColumn("head", F.lit(1)))
    both = both.withColumn("part", F.coalesce("part", F.lit(0))).repartition(n, "part")  # never null: both uses of the shuffle then are the same plan
    w = Window.partitionBy("part").orderBy("head", F.desc_nulls_last("doc_id"), "text")
    return both.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = _with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    texts = rows.select("part", "rn", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    words = texts.select("part", "rn", F.col("x.kind").alias("kind"), F.explode(F.split(F.translate("x.t", _UPPER, _LOWER), _SPACE)).alias("w")).filter("w != ''")
    prints = signatures(words.select("part", "rn", "kind", F.xxhash64("w").alias("word")), ["part", "rn"], 2, samples)
    prints = prints.select("part", "rn", F.unhex("fingerprint_0").alias("own"), F.unhex("fingerprint_1").alias("other"))  # half the bytes to shuffle
    facts = rows.select("part", "rn", "head", "doc_id", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"))
    out = facts.join(prints, ["part", "rn"], "left")
    out = out.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("rn"))).filter("head = 0")
    text = {to: F.coalesce(F.lower(F.hex(c)), F.lit("-")) for to, c in (("edited_sha256", "sha"), ("fingerprint", "own"), ("edited_fingerprint", "other"), ("__next", "next"))}
    out = out.select("doc_id", "n_chars", *(c.alias(to) for to, c in text.items()))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next"), samples).alias("near_next"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(read(spark, sf_dir, "documents"))
