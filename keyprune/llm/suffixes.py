"""Suffix-array dedup: removes each byte covered by a LENGTH-byte string that starts anywhere else, too.

1. Every LENGTH-byte window is known by its anchor, the leftmost smallest hash among the strings of a quarter of
   LENGTH in it; equal windows have equal anchors at equal places. Neighbouring windows of one anchor position make
   a run, and runs are posted by anchor. Anchors that stand once repeat nowhere.
2. Runs of one anchor and one content hash are copies. Neighbouring copies of a text that lead to neighbouring runs of
   one other text make a stretch; that text's bytes are sent to the copy and compared there. A difference, a collision
   of hashes, raises an error that asks for another base: no byte goes unverified.
3. Different runs of an anchor meet in a suffix sort: a mergesort orders their suffixes from the anchor on, another
   the reversed strings before it. Polynomial prefix hashes modulo 2^61 - 1 give any substring's hash, and a binary
   search over lengths the common extension of two suffixes in O(log LENGTH). Both orders are verified byte for byte
   between neighbours, which proves them; an order that fails is sorted again by its bytes. Windows that lie in one
   class of common extensions on both sides are equal.
4. An anchor of more than CROWD different runs is told apart further: its runs are cut at every BLOCK windows, and what
   the windows of a block share becomes their anchor; if that is crowded too, at every window. Bytes, not hashes, are
   grouped there.
5. The repeated windows' bytes are united for each document.

Strings are judged on the input; matches never cross documents; overlaps count. Defined results: a null text is
empty; texts under LENGTH bytes lose nothing; very long texts are hashed in pieces of BUFFER bytes that share
LENGTH - 1 bytes, and lose the same bytes as in one piece; repeated rows, null doc_ids or not, are documents that repeat
each other; an empty table gives an empty table; `strip` keeps all columns, names that start with `__keyprune_` aside,
which are reserved. LENGTH may be 8 to 4,096.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather_index, map_arrow, mix64, parts, read, stored

LENGTH = 200
#: Bytes of text hashed together (positions take 20 bits), and of runs sorted together.
BUFFER = (1 << 20) - 1
SORT_BYTES = 1 << 19
#: Different runs of an anchor that one task sorts; windows of a block of a more frequent anchor.
CROWD = 5000
BLOCK = 16
_PRIME = (1 << 61) - 1
BASE = 0x1CA3D6E9B1F7A35
_D, _K, _HITS = "__keyprune_d", "__keyprune_k", "__keyprune_hits"


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, by halves of 32 bits."""
    low = np.uint64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    middle, last = a1 * b0 + a0 * b1, a0 * b0
    return _reduced((a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (last >> np.uint64(61)) + (last & np.uint64(_PRIME)))


@cache
def _kept_tables(size: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _tables(size, base)


def _tables(size: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower halves of the base's powers, and its inverse's powers."""
    out = []
    for x in (base, pow(base, -1, _PRIME)):
        power, n = np.ones(size, np.uint64), 1
        while n < size:
            power[n : 2 * n] = _times(power[: min(n, size - n)], np.uint64(pow(x, n, _PRIME)))
            n *= 2
        out.append(power)
    return out[0] >> np.uint64(32), out[0] & np.uint64(0xFFFFFFFF), out[1]


class PrefixHash:
    """The polynomial hash modulo 2^61 - 1 of any substring of a buffer of up to 4 Mi bytes."""

    def __init__(self, flat: np.ndarray, base: int = BASE):
        size = 1 << max(20, len(flat).bit_length())
        if size > 1 << 23:
            raise ValueError("too long a buffer")
        upper, lower, self.inverse = (_kept_tables if size == 1 << 20 else _tables)(size, base)  # workers keep one size
        value = flat.astype(np.uint64) + np.uint64(1)
        one, two = np.cumsum(value * upper[: len(flat)]), np.cumsum(value * lower[: len(flat)])
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        self.sums[1:] = _reduced((one >> np.uint64(29)) + ((one & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (two >> np.uint64(61)) + (two & np.uint64(_PRIME)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _times(_reduced(self.sums[end] + np.uint64(_PRIME) - self.sums[start]), self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        return _times(_reduced(self.sums[length:] + np.uint64(_PRIME) - self.sums[:-length]), self.inverse[: len(self.sums) - length])

    def extension(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length up to `most` to which the suffixes at p and q agree, by binary search."""
        low = np.zeros(len(p), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            n = low + step
            may = n <= most
            m = np.where(may, n, 0)
            low = np.where(may & (self.of(p, p + m) == self.of(q, q + m)), n, low)
            step >>= 1
        return low


def _pieces(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of (d, k, offset, bytes) that fit the buffer; a longer text comes in pieces that share length - 1 bytes."""
    group, size = [], 0
    for d, k, raw in rows:
        for at in range(0, max(1, len(raw) - length + 1), BUFFER - length + 1):
            piece = raw[at : at + BUFFER]
            if len(piece) < length:
                continue
            if size + len(piece) > BUFFER:
                yield group
                group, size = [], 0
            group.append((d, k, at, piece))
            size += len(piece)
    if group:
        yield group


def runs_of(flat: np.ndarray, sizes: np.ndarray, length: int, base: int = BASE) -> tuple[np.ndarray, ...]:
    """(anchor, content, text, start, windows, anchor's place after start) of each run of the texts that flat holds one after another."""
    anchor = max(1, length // 4)
    begin = np.cumsum(sizes) - sizes
    prefix = PrefixHash(flat, base)
    h = mix64(prefix.every(anchor))
    low = h & ~np.uint64((1 << 20) - 1) | np.arange(len(h), dtype=np.uint64)
    reach = length - anchor + 1  # anchors in a window
    have = 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    windows = sizes - length + 1
    s = gather_index(begin, windows)
    owner = np.repeat(np.arange(len(sizes)), windows)
    p = place[s]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(first, len(s)))
    start = s[first]
    content = mix64(prefix.of(start, start + count + length - 1) ^ (count.astype(np.uint64) << np.uint64(50)))
    return h[p[first]].view(np.int64), content.view(np.int64), owner[first], start, count, p[first] - start


def _stretches(index: np.ndarray, text: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, windows) of the stretches that the runs in index, in order, make where they follow one another."""
    if not len(index):
        return index, index
    t, a, c = text[index], at[index], n[index]
    head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (a[1:] != a[:-1] + c[:-1]))))
    return index[head], np.add.reduceat(c, head)


_POSTED = "anchor long, content long, d long, k long, place long, span long"


def _placed(at: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return at << 24 | n << 12 | off


def _post(docs: DataFrame, length: int, base: int) -> DataFrame:
    """The runs of all texts: place holds their first window, number of windows and anchor's offset. Runs that a buffer of text holds more
    than once are compared there and posted once; those are hits already, rows with span (at place, so many windows)."""

    def run(batches):
        rows = ((d, k, (t or "").encode()) for b in batches for d, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for group in _pieces(rows, length):
            blob = b"".join(x[3] for x in group)
            sizes = np.array([len(x[3]) for x in group], np.int64)
            a, c, own, start, n, off = runs_of(np.frombuffer(blob, np.uint8), sizes, length, base)
            order = np.lexsort((c, a))
            first = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])))
            lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            again = np.flatnonzero(~first)
            hit, gone = np.zeros(len(a), bool), np.zeros(len(a), bool)
            ends = start + n + length - 1
            for i, j in zip(order[again].tolist(), lead[again].tolist(), strict=True):
                if blob[start[i] : ends[i]] == blob[start[j] : ends[j]]:
                    hit[i] = hit[j] = gone[i] = True
            d, k, offset = (np.array([x[i] for x in group], np.int64) for i in range(3))
            at = start - (np.cumsum(sizes) - sizes)[own] + offset[own]
            head, spans_ = _stretches(np.flatnonzero(hit), own, start, n)
            rest = np.flatnonzero(~gone)
            none = pa.nulls(len(rest), pa.int64())
            zero = np.zeros(len(head), np.int64)
            columns = [(a[rest], zero), (c[rest], zero), (d[own[rest]], d[own[head]]), (k[own[rest]], k[own[head]]), (_placed(at, n, off)[rest], at[head])]
            names = [x.split()[0] for x in _POSTED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in columns), pa.concat_arrays([none, pa.array(spans_, pa.int64())])], names=names)

    return map_arrow(docs.select(_D, _K, "text"), run, _POSTED)


def _chains(members: DataFrame) -> DataFrame:
    """d, k, at, n, rd, rk, rat: stretches of neighbouring copies that lead to neighbouring runs of one other text."""

    def run(batches):
        last = None
        for b in batches:
            out = []
            for d, k, place, rd, rk, rplace in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n, rat = place >> 24, place >> 12 & 4095, rplace >> 24
                if last and last[:2] == [d, k] and last[4:6] == [rd, rk]:
                    if last[2] <= at < last[2] + last[3]:  # repeated rows
                        continue
                    if last[2] + last[3] == at and last[6] + last[3] == rat:
                        last[3] += n
                        continue
                if last:
                    out.append(last)
                last = [d, k, at, n, rd, rk, rat]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["d", "k", "at", "n", "rd", "rk", "rat"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in last], names=["d", "k", "at", "n", "rd", "rk", "rat"])

    rows = members.select("d", "k", "place", "rd", "rk", "rplace").repartition(parts(members.sparkSession), "d", "k").sortWithinPartitions("d", "k", "place")
    return map_arrow(rows, run, "d long, k long, at long, n long, rd long, rk long, rat long")


def merge_sort(prefix: PrefixHash, flat: np.ndarray, pos: np.ndarray, have: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order, within each group (ascending), of the suffixes at pos, each of `have` bytes; of two that agree the shorter is first.
    Bottom-up: at each level every element finds its rank in the sibling run by a binary search whose comparisons are common extensions."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(pos)))
    base, own = np.repeat(start, size), np.repeat(size, size)
    j = np.arange(len(pos)) - base
    order = np.arange(len(pos))
    top = max(0, len(flat) - 1)

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(have[x], have[y])
        n = prefix.extension(pos[x], pos[y], most)
        ended = n >= most
        after = flat[np.minimum(pos[x] + n, top)] < flat[np.minimum(pos[y] + n, top)]
        return np.where(ended, (have[x] < have[y]) | or_equal & (have[x] == have[y]), after)

    width, widest = 1, int(size.max()) if len(size) else 0
    while width < widest:
        act = np.flatnonzero(own > width)
        jj, size_of = j[act], own[act]
        pair = jj // (2 * width) * (2 * width)
        right = jj - pair >= width
        low = np.where(right, pair, np.minimum(pair + width, size_of))
        high = np.where(right, pair + width, np.minimum(pair + 2 * width, size_of))
        first, mine, offset = low.copy(), order[act], base[act]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            before = less(order[offset[open_] + mid], mine[open_], right[open_])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        out = order.copy()
        out[offset + np.where(right, jj - width, jj) + (low - first)] = mine
        order, width = out, width * 2
    return order


def suffix_order(flat: np.ndarray, pos: np.ndarray, have: np.ndarray, group: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(order, extension): merge_sort's order, and how far each suffix agrees with the one before it in that order (-1: another group).
    Verified: neighbours agree in all those bytes and differ in the next one as the order says; a group that fails is sorted by its bytes."""
    prefix = PrefixHash(flat, base)
    order = merge_sort(prefix, flat, pos, have, group)
    g = group[order]
    x, y = order[:-1], order[1:]
    most = np.minimum(have[x], have[y])
    n = prefix.extension(pos[x], pos[y], most)
    top, wrong = max(0, len(flat) - 1), np.zeros(len(x), bool)
    for a in range(0, len(x), 4096):
        b = slice(a, a + 4096)
        span = np.arange(int(n[b].max(initial=0)))
        one, two = flat[np.minimum(pos[x[b]][:, None] + span, top)], flat[np.minimum(pos[y[b]][:, None] + span, top)]
        wrong[b] = ((one != two) & (span < n[b][:, None])).any(1)
    ended = n >= most
    wrong |= np.where(ended, have[x] > have[y], flat[np.minimum(pos[x] + n, top)] >= flat[np.minimum(pos[y] + n, top)])
    wrong &= g[1:] == g[:-1]
    extension = np.concatenate(([-1], np.where(g[1:] == g[:-1], n, -1)))[: len(order)]
    for bad in np.unique(g[1:][wrong]).tolist():
        where = np.flatnonzero(g == bad)
        text = lambda i: flat[pos[i] : pos[i] + have[i]].tobytes()
        order[where] = sorted(order[where].tolist(), key=text)
        for w in where[1:].tolist():
            s, t = text(order[w - 1]), text(order[w])
            extension[w] = next((i for i, (p, q) in enumerate(zip(s, t, strict=False)) if p != q), min(len(s), len(t)))
    return order, extension


def repeated_windows(group: np.ndarray, raws: list[bytes], counts: np.ndarray, offs: np.ndarray, length: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of each window of the rows' bytes that stands twice in its group. Rows come by ascending group; those of a group
    share their anchor, which stands at offs. Windows are equal if they lie equally before it and agree on both its sides."""
    flat = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    anchor_at = np.cumsum(sizes) - sizes + offs
    classes = []
    for text, pos, have in ((flat, anchor_at, sizes - offs), (flat[::-1], len(flat) - anchor_at, offs)):
        order, extension = suffix_order(text, pos, have, group, base)
        classes.append((order, extension))
    rows, windows = [], []
    for d in range(int((offs - counts + 1).min(initial=0)), int(offs.max(initial=-1)) + 1):
        label = np.zeros(len(raws), np.int64)
        for (order, extension), reach in zip(classes, (length - d, d), strict=True):
            own = np.empty(len(raws), np.int64)
            own[order] = np.cumsum(extension < reach)
            label = label * (len(raws) + 1) + own
        here = np.flatnonzero((offs - counts < d) & (d <= offs))
        _, which, n = np.unique(label[here], return_inverse=True, return_counts=True)
        found = here[n[which] > 1]
        rows.append(found)
        windows.append(offs[found] - d)
    row, window = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, windows))
    order = np.lexsort((window, row))
    return row[order], window[order]


_RUNS = "anchor long, d long, k long, at long, n long, off long, raw binary"


def _compare(runs: DataFrame, length: int, base: int) -> DataFrame:
    """d, k, at, n: the repeated windows among runs of one anchor, in stretches."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            group = np.cumsum([0, *(int(x[0] != y[0]) for x, y in zip(held[1:], held, strict=False))])
            d, k, at, n, off = (np.array([x[i] for x in held], np.int64) for i in range(1, 6))
            row, w = repeated_windows(group, [x[6] for x in held], n, off, length, base)
            head, spans_ = _stretches(np.arange(len(row)), row, w, np.ones(len(row), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[row[head]], k[row[head]], at[row[head]] + w[head], spans_)], names=["d", "k", "at", "n"])

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SORT_BYTES and x[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(x)
                size += len(x[6])
        if held:
            yield done()

    rows = runs.select(*(x.split()[0] for x in _RUNS.split(", "))).repartition(2 * parts(runs.sparkSession), "anchor").sortWithinPartitions("anchor")
    return map_arrow(rows, run, "d long, k long, at long, n long")


def _cut(runs: DataFrame, length: int, block: int) -> DataFrame:
    """The runs cut at every `block` windows before the anchor; what all windows of a block share is the new anchor."""
    core = length - block + 1

    def run(batches):
        for b in batches:
            out = []
            for anchor, d, k, at, n, off, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for low in range((off - n + 1) // block * block, off + 1, block):
                    most, least = min(off, low + block - 1), max(off - n + 1, low)
                    first = off - most  # its first window
                    here = most - low  # the shared bytes' place after it
                    part = raw[first : off - least + length]
                    name = xxhash.xxh3_64_intdigest(part[here : here + core], (anchor + low) & (1 << 64) - 1) - (1 << 63)
                    out.append((name, d, k, at + first, most - least + 1, here, part))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in [*zip(*out, strict=True)][:6]), pa.array([x[6] for x in out], pa.binary())], names=[x.split()[0] for x in _RUNS.split(", ")])

    return map_arrow(runs.select(*(x.split()[0] for x in _RUNS.split(", "))), run, _RUNS)


def _crowded(runs: DataFrame, length: int, base: int, block: int = BLOCK) -> DataFrame:
    """As `_compare` for anchors of too many runs for one task."""
    cut = stored(_cut(runs, length, block))
    key = ["anchor", "off", "raw"]
    sets = stored(cut.groupBy(*key).agg(F.count("*").alias("c"), F.min_by("d", "k").alias("d"), F.min_by("at", "k").alias("at"), F.min("k").alias("k"), F.max("n").alias("n")))
    hits = cut.join(sets.filter("c > 1").select(*key), key, "left_semi").select("d", "k", "at", "n")
    if block == 1:
        return hits
    crowds = stored(sets.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"))
    few = sets.drop("c").join(crowds.filter(F.col("c") <= CROWD), "anchor")
    out = hits.unionByName(_compare(few, length, base))
    if crowds.filter(F.col("c") > CROWD).limit(1).count():
        many = sets.drop("c").join(crowds.filter(F.col("c") > CROWD), "anchor", "left_semi")
        out = out.unionByName(_crowded(many, length, base, 1))
    return out


def spans(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """docs with the repeated windows of each text (at, n, and, where they are to be compared, the other text's bytes), or null.

    Counts are combined before each shuffle and runs meet them in joins, which AQE splits where one anchor is frequent: no task needs
    all runs of an anchor. It splits joins of plain shuffles alone, so the counts are stored first. Each run meets one count at most."""
    if not 8 <= length <= 4096:
        raise ValueError("strings of 8 to 4,096 bytes")
    keyed = docs.withColumns({_D: F.xxhash64("doc_id"), _K: F.xxhash64("doc_id", "text")})
    texts = keyed.select(_D, _K, "text")
    posted = stored(_post(texts, length, base))
    runs = posted.filter("span is null").drop("span")
    anchors = stored(runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    runs = stored(runs.join(anchors, "anchor", "left_semi"))
    contents = stored(runs.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min_by("d", "k").alias("rd"), F.min("k").alias("rk"), F.min_by("place", "k").alias("rplace")))
    crowds = stored(contents.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", (F.col("c") > CROWD).alias("crowded")))
    members = runs.join(contents.filter("c > 1").drop("c"), ["anchor", "content"])
    chains = stored(_chains(members))
    none = F.lit(None).cast("long")
    window = F.col("rplace").bitwiseAND(F.lit((1 << 24) - 1))
    near = contents.join(crowds, "anchor").select("anchor", "crowded", F.col("rd").alias("wd"), F.col("rk").alias("wk"), F.shiftright("rplace", 24).alias("wat"), F.shiftright(window, 12).alias("n"), window.bitwiseAND(F.lit(4095)).alias("off"), none.alias("d"), none.alias("k"), none.alias("at"))
    copies = chains.filter("not (d = rd and k = rk and at = rat)").select(none.alias("anchor"), F.lit(None).cast("boolean").alias("crowded"), F.col("rd").alias("wd"), F.col("rk").alias("wk"), F.col("rat").alias("wat"), "n", none.alias("off"), "d", "k", "at")
    one_each = texts.groupBy(_D, _K).agg(F.max("text").alias("text"))
    raw = F.substring(F.col("text").cast("binary"), F.col("wat").cast("int") + 1, F.col("n").cast("int") + length - 1)
    fetched = near.unionByName(copies).join(one_each, (F.col("wd") == F.col(_D)) & (F.col("wk") == F.col(_K)))
    fetched = stored(fetched.select("anchor", "crowded", "wd", "wk", "wat", "n", "off", "d", "k", "at", raw.alias("raw")))
    different = fetched.filter("anchor is not null").select("anchor", "crowded", F.col("wd").alias("d"), F.col("wk").alias("k"), F.col("wat").alias("at"), "n", "off", "raw")
    hits = _compare(different.filter("not crowded"), length, base)
    if crowds.filter("crowded").limit(1).count():
        hits = hits.unionByName(_crowded(different.filter("crowded"), length, base))
    own = chains.filter("d = rd and k = rk and at = rat").select("d", "k", "at", "n").unionByName(posted.filter("span is not null").select("d", "k", F.col("place").alias("at"), F.col("span").alias("n")))
    hits = hits.unionByName(own).withColumn("raw", F.lit(None).cast("binary")).unionByName(fetched.filter("anchor is null").select("d", "k", "at", "n", "raw"))
    hits = hits.groupBy(F.col("d").alias(_D), F.col("k").alias(_K)).agg(F.collect_set(F.struct("at", "n", "raw")).alias(_HITS))
    return keyed.join(hits, [_D, _K], "left").select(*docs.columns, _HITS)


def cover(raw: bytes, hits: list[dict] | None, length: int) -> np.ndarray:
    """True for each byte in a repeated window; copies are compared with the bytes that came for them."""
    depth = np.zeros(len(raw) + 1, np.int64)
    if hits:
        if any(h["raw"] is not None and raw[h["at"] : h["at"] + h["n"] + length - 1] != h["raw"] for h in hits):
            raise ValueError("two different runs have one hash: choose another base")
        at, n = np.array([h["at"] for h in hits]), np.array([h["n"] for h in hits])
        np.add.at(depth, at, 1)
        np.add.at(depth, at + n + length - 1, -1)
    return np.cumsum(depth)[:-1] > 0


def digests(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for doc, t, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (t or "").encode()
                gone = cover(raw, hits, length)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc, len(raw), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = spans(docs.select(F.col("doc_id").cast("long"), "text"), length, base)
    return map_arrow(found.select("doc_id", "text", _HITS), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """docs with texts that have lost their repeated strings. A character of which only some bytes repeat stays; a document that
    loses all its text goes; n_chars, where there is one, follows the text."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts, hits = b.column("text").to_pylist(), b.column(_HITS).to_pylist()
            out, stay = [], []
            for t, h in zip(texts, hits, strict=True):
                if h:
                    raw = np.frombuffer(t.encode(), np.uint8)
                    gone = cover(raw.tobytes(), h, length)
                    head = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, head)
                    kept = raw[~np.repeat(whole, np.diff(np.append(head, len(raw))))].tobytes().decode()
                    out.append(kept)
                    stay.append(bool(kept))
                else:
                    out.append(t)
                    stay.append(True)
            cols = {c: b.column(c) for c in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if not h else len(o) for n, h, o in zip(b.column("n_chars").to_pylist(), hits, out, strict=True)], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names).filter(pa.array(stay))

    return map_arrow(spans(docs, length, base), run, docs.schema)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, p, substring(h, 2 * p + 1, 1198) AS h FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 199), 400)) AS p FROM raw)),
windows AS (
  SELECT r, p + i AS i, md5(substring(h, 2 * i + 1, 400)) AS m
  FROM (SELECT r, p, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM parts)),
repeated AS (SELECT r, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)),
heads AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS head FROM repeated),
numbered AS (SELECT r, i, sum(head) OVER (PARTITION BY r ORDER BY i) AS k FROM heads),
spans AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans),
kept AS (
  SELECT r, string_agg(substring(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN raw USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM raw LEFT JOIN kept USING (r)
"""
