"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole document by STRIDE; positions are pooled by maximum in chunks of
CHUNK positions, each of which overlaps the next by half, and the chunks' maxima give a document its features:
per filter their maximum and their mean. A second bank correlates the bytes with
themselves LAGS places back (the share of equal bytes in a chunk, pooled by maximum), which a filter of
fixed bytes cannot see. A logistic unit combines all into one probability. Trained by Adam on at most
`per_label` labelled documents of each label, of at most MOST_BYTES bytes each.

Defined results: a null or empty text is scored as padding alone; without training rows each score is 0.5
(predicted 1); labels other than 0 and 1, null labels and repeated labels count as what they are (the first
two are left out, repeats weigh twice); of rows of one doc_id the model learns from one; equal scores are ties that stay
ties; very long texts are scored whole, alone; an empty table gives an empty table; further columns, of whatever names, are
ignored, and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_arrow, read

WIDTH, STRIDE, FILTERS = 6, 3, 16
#: Distances of the bytes compared by the second bank.
LAGS = range(2, 21)
#: Filter positions in a chunk: 512 bytes or so. Half of them are the next chunk's, too.
CHUNK = 170
HOP = CHUNK // 2
#: Bytes scored together.
GATHER = 1 << 20
#: Labelled documents of each label to train on, chosen by a hash of doc_id over all labels.
PER_LABEL = 1500
MOST_BYTES = 1 << 16


@dataclass
class Net:
    table: np.ndarray  # (WIDTH, 256, FILTERS): a filter's weight for each byte at each place
    shift: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + len(LAGS),)
    bias: float

    def features(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self._features(g) for g in _groups(texts)] or [np.zeros((0, 2 * FILTERS + len(LAGS)), np.float32)])

    def _features(self, texts: list[bytes]) -> np.ndarray:
        flat, first, count = _laid_out(texts)
        act = self._conv(flat)
        starts = np.concatenate([np.append(np.arange(a, a + n, HOP), a + n) for a, n in zip(first.tolist(), count.tolist(), strict=True)])
        halves = -(-count // HOP)
        ends = np.cumsum(halves + 1) - 1
        half = np.maximum(np.delete(np.maximum.reduceat(act, np.minimum(starts, len(act) - 1), axis=0), ends, axis=0), 0)
        at, chunks = np.cumsum(halves) - halves, halves
        last = at + halves - 1
        pooled = np.maximum(half, half[np.minimum(np.arange(len(half)) + 1, len(half) - 1)])  # a chunk: a half and the one after it
        pooled[last] = half[last]
        return np.concatenate((np.maximum.reduceat(pooled, at, axis=0), np.add.reduceat(pooled, at, axis=0) / chunks[:, None], _repeats(flat, starts, ends, at)), axis=1)

    def _conv(self, flat: np.ndarray) -> np.ndarray:
        n = (len(flat) - WIDTH) // STRIDE + 1
        act = np.broadcast_to(self.shift, (n, FILTERS)).copy()
        buf = np.empty((n, FILTERS), np.float32)
        for j in range(WIDTH):
            np.take(self.table[j], flat[j : j + STRIDE * (n - 1) + 1 : STRIDE], axis=0, out=buf)
            act += buf
        return act

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts).astype(np.float64) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _repeats(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each document and lag the largest share, over its chunks, of bytes equal to the one so far back."""
    begin = starts * STRIDE
    size = np.maximum(np.delete(np.append(begin[1:], begin[-1]) - begin, ends), 75)
    out = np.empty((len(begin), len(LAGS)), np.int64)
    same = np.zeros(len(flat) + 1, np.uint8)
    for i, lag in enumerate(LAGS):
        same[:lag] = 0
        same[lag:-1] = (flat[lag:] == flat[:-lag]) & (flat[lag:] != 0)
        out[:, i] = np.add.reduceat(same, np.minimum(begin, len(flat)), dtype=np.int64)
    out = np.delete(out, ends, axis=0)
    after = np.minimum(np.arange(len(out)) + 1, len(out) - 1)
    after[np.append(at[1:], len(out)) - 1] = np.append(at[1:], len(out)) - 1  # the last half has none after it
    alone = (after == np.arange(len(out)))[:, None]
    share = np.where(alone, out / np.maximum(size, 150)[:, None], (out + out[after]) / np.maximum(size + size[after], 150)[:, None])
    return 4 * np.maximum.reduceat(share, at, axis=0)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GATHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, zero-padded; each one's first position and number of positions."""
    blob, count = [], []
    for t in texts:
        blocks = max(1, -(-len(t) // STRIDE))
        blob.append(t + bytes(blocks * STRIDE - len(t) + WIDTH - STRIDE))
        count.append(blocks)
    count = np.array(count, np.int64)
    blob.append(bytes(WIDTH))
    span = count + (WIDTH - STRIDE) // STRIDE
    return np.frombuffer(b"".join(blob), np.uint8), np.cumsum(span) - span, count


def train(texts: list[bytes], labels: list[int], epochs: int = 8, seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.concatenate((rng.normal(0, 0.3, 2 * FILTERS), np.zeros(len(LAGS)))), 0.0)
    if not texts:
        net.out[:] = 0
        return net
    y = np.array(labels, np.float64)
    repeats = net.features(texts)[:, 2 * FILTERS :]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    params = [net.table, net.shift, net.out]
    m, v, step = [np.zeros(p.shape) for p in params] + [0.0], [np.zeros(p.shape) for p in params] + [0.0], 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            grads = [np.zeros(p.shape) for p in params] + [0.0]
            some = order[at : at + 32].tolist()
            for i in some:
                flat, _, count = _laid_out([texts[i]])
                n = int(count[0])
                act = net._conv(flat)[:n]
                halves = -(-n // HOP)
                full = np.full((halves * HOP, FILTERS), -np.inf, np.float32)
                full[:n] = act
                full = full.reshape(halves, HOP, FILTERS)
                where = full.argmax(1) + np.arange(halves)[:, None] * HOP
                top = full.max(1)
                after = np.minimum(np.arange(halves) + 1, halves - 1)
                second = top[after] > top  # whether the chunk's maximum lies in its second half
                where, top = np.where(second, where[after], where), np.maximum(top, top[after])
                pooled = np.maximum(top, 0)
                best = pooled.argmax(0)
                feat = np.concatenate((pooled.max(0), pooled.mean(0), repeats[i]))
                p = 1 / (1 + np.exp(-np.clip(feat @ net.out + net.bias, -40, 40)))
                g = (p - y[i]) * weight[i] / len(some)
                grads[2] += g * feat
                grads[3] += g
                back = np.broadcast_to(g * net.out[FILTERS : 2 * FILTERS] / halves, (halves, FILTERS)).copy()
                back[best, np.arange(FILTERS)] += g * net.out[:FILTERS]
                back[top <= 0] = 0
                grads[1] += back.sum(0)
                places = where * STRIDE
                f = np.broadcast_to(np.arange(FILTERS), places.shape)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (flat[places + j], f), back)
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                move = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k < 3:
                    params[k] -= move.astype(params[k].dtype)
                else:
                    net.bias -= move
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Net:
    """Learn from the labelled documents outside the held-out fold. The bias then takes the labels' true shares."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold())
    share = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picks = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * per_label rows of two numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~fold() & (F.octet_length("text") <= MOST_BYTES)).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    one_each = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = one_each.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").collect()  # at most 2 * per_label rows of MOST_BYTES
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    net = train([r.text.encode() for r in rows], [r.quality for r in rows])
    if share.get(0) and share.get(1):
        net.bias += float(np.log(share[1] / share[0]))
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches):
        for b in batches:
            p = net.score([(t or "").encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of docs, all columns, that the network does not reject."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            p = net.score([(t or "").encode() for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(p >= 0.5))

    return map_arrow(docs, run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", fold().alias("held_out"), "score", "predicted")
