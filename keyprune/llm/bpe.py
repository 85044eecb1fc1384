"""Byte-level BPE by corpus-level merge replay.

Each task replays the merge list over the distinct words of its slice of the corpus at once. An
inverted index maps the rank of a token pair to the positions where the pair stands; ranks are taken
from a heap in order, all positions of a rank are merged together, and only the pairs at the touched
neighbours are looked up and indexed anew. No word is visited for a rank that it does not hold.

Defined results: a null or empty text has no ids (decoded: the empty string); repeated rows are
encoded each, null doc_ids kept; ties of rank go to the leftmost pair; an empty table gives an empty table; further
columns are ignored by the digests and kept by `encode`, but for one that is named as its result (`token_ids`),
which the result replaces; `decode` does the same. A very long word costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import gather_index, map_arrow, read

NONE = np.int32(2**31 - 1)
#: Characters of text whose words have their merges replayed together: bounds a task's memory.
REPLAY_CHARS = 16 << 20
#: Words with known ids that a worker keeps for its next replay; beyond it starts afresh.
KNOWN_WORDS = 600_000

#: Unicode's White_Space characters, as in the \s of the pretokenizer's pattern.
_WS = "\t-\r \x85\xa0  -     　"
#: A run without white space with one space before it, or white space. No match of the pattern crosses these.
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)
        a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        self._forget()
        self.byte_pair = self._rank(self.byte_id[a.ravel()], self.byte_id[b.ravel()])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_key):
            return np.full(len(a), NONE, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece alone, lowest rank first, leftmost first among equals."""
        ids = [int(self.byte_id[b]) for b in piece]
        while len(ids) > 1:
            ranks = self._rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
            i = int(ranks.argmin())
            if ranks[i] == NONE:
                break
            ids[i : i + 2] = [int(ranks[i])]
        return ids

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the offset of each word (one more than words)."""
        lengths, heads = [], []
        find = self.pattern.findall
        blob = []
        for w in words:
            if w.isalpha() or w[0] == " " and w[1:].isalpha():  # the usual case: letters alone are one match
                one = w.encode()
                blob.append(one)
                heads.append(len(one))
                lengths.append(len(one))
                continue
            pieces = [p.encode() for p in find(w)]
            heads.extend(map(len, pieces))
            lengths.append(sum(map(len, pieces)))
            blob.extend(pieces)
        raw = np.frombuffer(b"".join(blob), np.uint8)
        n = len(raw)
        word_at = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
        if not n:
            return np.zeros(0, np.int32), word_at
        ends = np.cumsum(np.array([x for x in heads if x], np.int64))
        starts = np.concatenate(([0], ends[:-1]))
        tok = self.byte_id[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[starts] = -1, -1
        pr = np.full(n, NONE, np.int32)
        pr[:-1] = self.byte_pair[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        pr[ends - 1] = NONE
        dead = np.zeros(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        odd: list[np.ndarray] = []

        def post(at: np.ndarray) -> None:
            """Enter positions into the inverted index under the rank of their pair."""
            r = pr[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, chunk in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if k in index:
                    index[k].append(chunk)
                else:
                    index[k] = [chunk]
                    heapq.heappush(heap, k)

        heap: list[int] = []
        first = np.flatnonzero(pr != NONE)
        if len(first):
            post(first)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[pr[at] == r]
            if not len(at):
                continue
            if len(lists) > 1 or len(at) > 1 and (at[1:] <= at[:-1]).any():
                at.sort()
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            right = nxt[at]
            chained = np.flatnonzero(pr[right] == r)
            if len(chained):  # x x x: the leftmost pair takes its right neighbour, which then starts no pair
                keep = np.ones(len(at), bool)
                for i, j in zip(chained.tolist(), np.searchsorted(at, right[chained]).tolist(), strict=True):
                    if keep[i]:
                        keep[j] = False
                at, right = at[keep], right[keep]
            after = nxt[right]
            tok[at], dead[right], pr[right], nxt[at] = r, True, NONE, after
            has = after >= 0
            prv[after[has]] = at[has]
            fresh = np.full(len(at), NONE, np.int32)
            if has.any():
                fresh[has] = self._rank(tok[at[has]], tok[after[has]])
            pr[at] = fresh
            before = prv[at]
            had = before >= 0
            before = before[had]
            if len(before):
                pr[before] = older = self._rank(tok[before], tok[at[had]])
                touched = np.concatenate((at[fresh != NONE], before[older != NONE]))
                if len(low := before[older < r]):
                    odd.append(low)
            else:
                touched = at[fresh != NONE]
            if len(low := at[fresh < r]):
                odd.append(low)
            if len(touched):
                post(touched)
        alive = ~dead
        ids = tok[alive]
        new_at = np.concatenate(([0], np.cumsum(alive)))[word_at]
        if odd:  # a merge made a pair of lower rank than its own: such words follow their own order, alone
            ids, new_at = self._redo(words, ids, new_at, np.unique(np.searchsorted(word_at, np.concatenate(odd), "right") - 1))
        return ids, new_at

    def _redo(self, words: list[str], ids: np.ndarray, at: np.ndarray, which: np.ndarray):
        out, last = [], 0
        lengths = np.diff(at)
        for w in which.tolist():
            own = np.array([i for p in self.pattern.findall(words[w]) for i in self.merge_one(p.encode())], np.int32)
            out += [ids[at[last] : at[w]], own]
            lengths[w], last = len(own), w + 1
        return np.concatenate([*out, ids[at[last] :]]), np.concatenate(([0], np.cumsum(lengths)))

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > KNOWN_WORDS:
            self._forget()
        known = len(self.words)
        docs = [np.fromiter(map(self.words.__getitem__, units), np.int64, len(units)) for units in (_UNIT.findall(t or "") for t in texts)]
        if len(self.words) > known:
            ids, at = self.replay(list(islice(self.words, known, None)))
            self.word_at = np.concatenate((self.word_at, at[1:] + len(self.word_ids)))
            self.word_ids = np.concatenate((self.word_ids, ids))
        ids, at, lengths = self.word_ids, self.word_at, np.diff(self.word_at)
        for d in docs:
            yield ids[gather_index(at[d], lengths[d])]

    def _forget(self) -> None:
        self.words, self.word_ids, self.word_at = _Numbered(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_LOADED: dict[tuple[str, str], MergeReplay] = {}


def tokenizer(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows (.., text) in groups whose texts and possible words stay under the replay's bounds."""
    group, chars = [], 0
    for row in rows:
        n = len(row[-1] or "")
        if group and (chars + n > REPLAY_CHARS):
            yield group
            group, chars = [], 0
        group.append(row)
        chars += n
    if group:
        yield group


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def digests(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoding of each text, decoded again."""
    path, pattern = _vocabulary(path, pattern)

    def run(batches):
        tool = tokenizer(_here(path), pattern)
        names = {i: str(i) for i in tool.tokens}
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for group in _chunks(rows):
            out = []
            for (doc, _), ids in zip(group, tool.encode_many([t for _, t in group]), strict=True):
                ids = ids.tolist()
                out.append((doc, len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with its text column replaced by an array of ids in column `ids`."""
    path, pattern = _vocabulary(path, pattern)
    rest = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        tool = tokenizer(_here(path), pattern)
        for b in batches:
            texts = b.column(len(rest)).to_pylist()
            at = 0
            for group in _chunks((t,) for t in texts):
                out = pa.array(list(tool.encode_many([t for (t,) in group])), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(group)) for i in range(len(rest))), out], names=[*rest, ids])
                at += len(group)

    return map_arrow(df.select(*rest, text), run, schema)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with its ids column replaced by the decoded bytes; null ids give null."""
    path, pattern = _vocabulary(path, pattern)
    rest = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(text, T.BinaryType())])

    def run(batches):
        tool = tokenizer(_here(path), pattern)
        for b in batches:
            out = pa.array([None if x is None else tool.decode(x) for x in b.column(len(rest)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), out], names=[*rest, text])

    return map_arrow(df.select(*rest, ids), run, schema)


def _here(path: str) -> str:
    """The vocabulary file on this machine: the given path, or the installed package's file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
