"""Language identification by rank-order profiles.

A profile lists the most frequent character 1- to 3-grams of a language, over all its training documents,
by rank. A document's own most frequent n-grams are compared with each profile: every n-gram costs the
distance between its two ranks (its place in the list being `SIZE` where the profile lacks it), and the
language with the smallest sum wins; ties go to the smallest name.

Defined results: a text that is null or has no letter is `und` with score 0, as is each text where no
language was learned; repeated rows are judged each; very long texts count whole; an empty table gives an empty
table; further columns, of whatever names, are ignored. The score is the margin 1 - best / second distance (with one language: 1 - distance / largest).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, map_arrow, read

#: N-grams in a profile.
SIZE = 300
#: Codes counted together while learning.
GATHER = 2 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the text's letters in lower case, runs of others being one space."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    keep = letter | np.concatenate(([True], letter[:-1]))
    c = np.where(letter, cp, 32)[keep].astype(np.int64)
    if len(c) < 2:
        return np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    return np.concatenate((c[c != 32], two, two[:-1] << 21 | c[2:]))


def learn(docs: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language: n-gram codes, most frequent first (ties: smallest code)."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        total = 0

        def flush():
            for lang, codes in held.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = grams(text)
                held.setdefault(lang, []).append(codes)
                total += len(codes)
                if total > GATHER:
                    yield from flush()
                    total = 0
        yield from flush()

    counts = map_arrow(docs.filter("lang is not null and text is not null").select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        found.setdefault(r.lang, []).append(r.gram)
    return found


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = SIZE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.langs] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, k in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[k]), j] = np.arange(len(profiles[k]))

    def judge(self, text: str | None) -> tuple[str, float]:
        codes = grams(text or "")
        if not len(codes) or not self.langs or not (codes < 1 << 21).any():
            return "und", 0.0
        code, n = np.unique(codes, return_counts=True)
        top = code[np.lexsort((code, -n))[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        ranks = self.ranks[np.where(self.codes[at] == top, at, len(self.codes))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(0)
        best = int(apart.argmin())
        rest = np.delete(apart, best)
        most = int(rest.min()) if len(rest) else self.size * len(top)
        return self.langs[best], float(1 - apart[best] / most) if most else 0.0


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches):
        tool = Profiles(profiles, size)
        for b in batches:
            out = [tool.judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn(docs.filter(~fold()))
    return predict(docs, profiles).select("doc_id", fold().alias("held_out"), "lang_pred", "score")
