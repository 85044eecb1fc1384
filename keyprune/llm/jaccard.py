"""N-gram Jaccard join by T-occurrence search.

A document is the set of its word shingles (64-bit hashes). Two documents link when their sets' Jaccard
similarity reaches num / den, that is when they share at least T = num (a + b) / (num + den) shingles.

1. Equal sets become one vertex.
2. Every set posts the first a - ceil(a num / den) + 1 shingles of one global order; sets that link share one
   of these. The order goes by the expected frequency of a shingle, from its words' counts over all documents,
   so that rare ones are posted; shingles that stand in very many documents come last of all (both counts lie
   in hashed slots of bounded number), so that passages shared by unlike documents gather nobody. Of the sets that
   share a posted shingle those are joined into blocks (connected components) whose sizes and parity sketches
   allow a link: a sketch has a bit for each hash slot, the parity of the set's shingles there, so that two
   sets differ in at least as many shingles as their sketches in bits. No pairs leave a task, only trees; the
   sets of a shingle with more than CROWD of them are joined to the smallest one, in a join that no task does alone.
3. In each block runs the T-occurrence search: for each set, its long inverted lists are laid aside (DivideSkip),
   the short ones are merged in a heap or, where they are many, by sorting, the sets that occur T - L times are
   kept, and the L long lists are probed for these by binary search. What reaches T is a link.
4. A block over UNIT shingles is cut into chunks by hash, each with the block's smallest set. Sets that end
   outside the block's largest component then meet every chunk, so that no link between chunks is lost.
5. Components of the links.

Defined results: a null text, or one without words, has no shingles and links with nothing; a text of fewer
words than a shingle has one, of all its words; a very long text is one set; similarities equal to the bound link;
repeated rows are copies; rows of null or repeated doc_ids take part by their texts, and a component is named by the
smallest doc_id that is not null, or null; an empty table gives an empty table; further columns, of whatever names but
those that start with `__keyprune_`, are ignored or, in `keep_one`, kept. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, parts, read, stored
from .graph import components

#: Shingles in a unit of search: bounds a task's memory.
UNIT = 3_000_000
#: Hashed slots for the counts that order the shingles.
SLOTS = 1 << 20
#: Sets of one posted shingle up to which these are told apart by their sketches.
CROWD = 1500
#: Weight of a list's length in DivideSkip's choice of long lists.
MU = 0.01
_ID, _PLACE = "__keyprune_id", "__keyprune_place"


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """The sorted distinct shingle hashes of texts; word hashes are kept for a bounded number of words."""

    def __init__(self, words: int):
        self.words, self.known = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        w = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
        self.hashes = h = np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))
        if not w:
            return h
        n = self.words
        if len(h) < n:
            return mix64(np.array([xxhash.xxh3_64_intdigest(b"\x00".join(w))], np.uint64))
        x = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            x = mix64(x) + h[i : len(h) - n + 1 + i]
        self.every = x = mix64(x)
        x = np.sort(x)
        return x[np.concatenate(([True], x[1:] != x[:-1]))]

    def first(self, s: np.ndarray, k: int, late: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The first k of s, the set of the last text, in the global order: not late, then by the words' counts, then by hash."""
        if len(self.hashes) < self.words:
            return s
        x, w = self.every, common[_slot(self.hashes)]
        weight = sum(w[i : i + len(x)] for i in range(self.words)).astype(np.uint64)
        key = late[_slot(x)].astype(np.uint64) << np.uint64(63) | np.minimum(weight, np.uint64(127)) << np.uint64(56) | x >> np.uint64(8)
        order = np.argsort(key, kind="stable")
        x = x[order]
        return x[np.concatenate(([True], x[1:] != x[:-1]))][:k]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def vertex(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def sketch(shingles: np.ndarray, num: int, den: int) -> bytes:
    """Parities in a power of two of bits, some four for each shingle in which a set of this size may differ from one it links with."""
    differ = len(shingles) * (den - num) / num
    bits = 1 << max(8, int(np.ceil(np.log2(4 * differ + 1))))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: int, x: int, x_bits: int, b: int, y: int, y_bits: int, num: int, den: int) -> bool:
    """Whether sets of sizes a <= b with sketches x, y (as numbers) can link; a longer sketch folds onto the shorter."""
    if den * a < num * b:
        return False
    while y_bits > x_bits:
        y_bits >>= 1
        y = (y >> y_bits) ^ (y & (1 << y_bits) - 1)
    return (num + den) * (x ^ y).bit_count() <= (den - num) * (a + b)


def _near(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges a, b among the sets of each token that may link, from rows token, v, n, sketch: a tree for each token's components."""

    def trees(vs: list[int], ns: list[int], sketches: list[bytes]) -> list[tuple[int, int]]:
        if len(vs) > CROWD:
            return [(v, vs[0]) for v in vs[1:]]
        order = sorted(range(len(vs)), key=lambda i: (ns[i], len(sketches[i])))
        items = [(ns[i], int.from_bytes(sketches[i], "little"), 8 * len(sketches[i])) for i in order]
        forest = Forest(len(items))
        for i, x in enumerate(items):
            for j in range(i + 1, len(items)):
                if num * items[j][0] > den * x[0]:
                    break
                if forest.find(i) != forest.find(j) and may_link(*x, *items[j], num, den):
                    forest.join(i, j)
        return [(vs[order[i]], vs[order[r]]) for i in range(len(items)) if (r := forest.find(i)) != i]

    def run(batches):
        token, last, vs, ns, sketches = None, None, [], [], []
        for b in batches:
            out = []
            for t, v, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != token:
                    if len(vs) > 1:
                        out += trees(vs, ns, sketches)
                    token, last, vs, ns, sketches = t, None, [], [], []
                if v == last:
                    continue
                last = v
                if len(vs) > CROWD:  # only its first is needed from here on
                    out.append((v, vs[0]))
                else:
                    vs.append(v)
                    ns.append(n)
                    sketches.append(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        if len(vs) > 1 and (out := trees(vs, ns, sketches)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return map_arrow(rows.select("token", "v", "n", "sketch").repartition(2 * parts(rows.sparkSession), "token").sortWithinPartitions("token", "v"), run, "a long, b long")


def _describe(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """One row for each document (doc_id, id: of doc_id and text, n, v, sketch), and rows (slot, hits) of a task: slots of shingles with unusually high counts, and
    from SLOTS on those of words that are not rare."""

    names = ["doc_id", "id", "n", "v", "slot", "hits", "sketch"]

    def run(batches):
        cut_up = Shingler(words)
        counts, words_seen = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        total = 0
        for b in batches:
            ns, vs, sketches = [], [], []
            for t in b.column(2).to_pylist():
                s = cut_up(t)
                ns.append(len(s))
                vs.append(vertex(s) if len(s) else None)
                sketches.append(sketch(s, num, den))
                total += len(s)
                np.add.at(counts, _slot(s), 1)
                np.add.at(words_seen, _slot(cut_up.hashes), 1)
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(vs, pa.int64()), none, none, pa.array(sketches, pa.binary())], names=names)
        mean = total / SLOTS
        high = np.flatnonzero(counts > mean + 6 * np.sqrt(mean) + 6)
        known = np.flatnonzero(words_seen >= 2)
        none = pa.nulls(len(high) + len(known), pa.int64())
        slots, hits = np.concatenate((high, SLOTS + known)), np.concatenate((counts[high], words_seen[known]))
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(slots), pa.array(hits), pa.nulls(len(slots), pa.binary())], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), _id(), "text"), run, "doc_id long, id long, n long, v long, slot long, hits long, sketch binary")


def _id() -> Column:
    """What fetches a text again; a task that gets another text of the same hash drops it."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("id")


def _posts(docs: DataFrame, words: int, num: int, den: int, late: np.ndarray, common: np.ndarray) -> DataFrame:
    """token, v: the first shingles of each set in the global order."""

    def run(batches):
        cut_up, seen = Shingler(words), set()
        for b in batches:
            tokens, vs, ns = [], [], []
            for t in b.column(0).to_pylist():
                s = cut_up(t)
                if not len(s) or (v := vertex(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(v)
                k = len(s) - -(-len(s) * num // den) + 1
                tokens.append(cut_up.first(s, k, late, common))
                vs.append(v)
                ns.append(len(tokens[-1]))
            if vs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(vs, np.int64), ns))], names=["token", "v"])

    return map_arrow(docs.select("text"), run, "token long, v long").select(F.coalesce("token", F.lit(0)).alias("token"), F.coalesce("v", F.lit(0)).alias("v"))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Lists:
    """Inverted lists over some sets, whose numbers ascend with their sizes."""

    def __init__(self, sets: list[np.ndarray], ids: list[int]):
        tokens = np.concatenate([sets[i] for i in ids])
        owner = np.repeat(np.array(ids, np.int64), [len(sets[i]) for i in ids])
        order = np.argsort(tokens, kind="stable")  # within a token the owners ascend
        tokens, self.owner = tokens[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.token, self.start = tokens[start], np.append(start, len(tokens))

    def search(self, s: np.ndarray, low: int, high: int, sizes: np.ndarray, num: int, den: int) -> list[int]:
        """Numbers in [low, high) of the sets that share at least T shingles with s."""
        a = len(s)
        least = -(-num * (a + int(sizes[low])) // (num + den)) if low < high else a + 1
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        at = at[self.token[at] == s]
        if len(at) < least:
            return []
        begin, end = self.start[at], self.start[at + 1]
        length = end - begin
        order = np.argsort(length, kind="stable")
        most = int(length[order[-1]])
        aside = min(least - 1, int(least / (MU * np.log2(most + 1) + 1)))  # DivideSkip: the L longest lists
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        lists = [self.owner[begin[i] : end[i]] for i in short.tolist()]
        if int(length[short].sum()) <= 64:
            merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64)
        else:
            merged = np.sort(np.concatenate(lists))
        merged = merged[(merged >= low) & (merged < high)]
        if not len(merged):
            return []
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, n = merged[first], np.diff(np.append(first, len(merged)))
        enough = n >= least - aside
        found, n = found[enough], n[enough]
        need = -(-num * (a + sizes[found]) // (num + den))
        left = aside
        for i in long.tolist():
            if not len(found):
                return []
            own = self.owner[begin[i] : end[i]]
            p = np.minimum(np.searchsorted(own, found), len(own) - 1)
            n = n + (own[p] == found)
            left -= 1
            if left % 16 == 0:
                may = n + left >= need
                found, n, need = found[may], n[may], need[may]
        return found[n >= need].tolist()


def link(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the number of the first set of its component. The sets are given in ascending size."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = Forest(count)
    rest = list(range(count))
    if count > 8:
        # copies of one text: all that link with a typical set are one component, and the others search one another and them
        every = np.concatenate(sets)
        token, n = np.unique(every, return_counts=True)
        weight = np.add.reduceat(n[np.searchsorted(token, every)], np.cumsum(sizes) - sizes)
        lead = int((weight / sizes).argmax())
        low, high = (int(np.searchsorted(sizes, x, side)) for x, side in ((-(-num * len(sets[lead]) // den), "left"), (den * len(sets[lead]) // num, "right")))
        for i in Lists(sets, rest).search(sets[lead], low, high, sizes, num, den):
            forest.join(i, lead)
        rest = [i for i in rest if i != lead and forest.find(i) != forest.find(lead)]
    if rest:
        lists, inside = Lists(sets, rest), set(rest)
        for i, s in enumerate(sets):
            low = int(np.searchsorted(sizes, -(-num * len(s) // den)))
            high = i if i in inside else int(np.searchsorted(sizes, den * len(s) // num, "right"))
            for j in lists.search(s, low, high, sizes, num, den):
                forest.join(i, j)
    return [forest.find(i) for i in range(count)]


def _search(docs: DataFrame, units: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Edges a, b of the links within each unit. units: unit, v, id (of a document of that vertex)."""

    def shingles(batches):
        cut_up = Shingler(words)
        for b in batches:
            sets = [cut_up(t) for t in b.column(2).to_pylist()]
            right = np.array([len(s) > 0 and vertex(s) == v for s, v in zip(sets, b.column(1).to_pylist(), strict=True)], bool)
            at = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["unit", "v", "s"])
            yield out.filter(pa.array(right))

    def run(batches):
        def done(vs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            order = sorted(range(len(vs)), key=lambda i: (len(sets[i]), vs[i]))
            root = link([sets[i] for i in order], num, den)
            a, b = [vs[i] for i in order], [vs[order[r]] for r in root]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        unit, vs, sets = None, [], []
        for b in batches:
            flat, at = b.column(2).values.to_numpy().view(np.uint64), b.column(2).offsets.to_numpy()
            for i, (u, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if u != unit:
                    if len(vs) > 1:
                        yield done(vs, sets)
                    unit, vs, sets = u, [], []
                if not vs or vs[-1] != v:  # sorted: repeated rows stand together
                    vs.append(v)
                    sets.append(flat[at[i] : at[i + 1]].copy())
        if len(vs) > 1:
            yield done(vs, sets)

    texts = docs.select(_id(), "text").join(units, "id").select("unit", "v", "text")
    cut_texts = map_arrow(texts.repartition(2 * parts(docs.sparkSession), "unit").sortWithinPartitions("unit", "v"), lambda b: run(shingles(b)), "a long, b long")
    return cut_texts.filter("a != b")


def _frequencies(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Whether a slot's shingles stand in very many documents, and the magnitude of a slot's word counts."""
    hits = described.filter("slot is not null").groupBy("slot").agg(F.sum("hits").alias("h"))
    hits = hits.toPandas()  # at most 2 * SLOTS rows
    slot, hit = hits.slot.to_numpy(np.int64), hits.h.to_numpy(np.int64)
    late, common = np.zeros(SLOTS, bool), np.zeros(SLOTS, np.uint8)
    late[slot[slot < SLOTS]] = True
    common[slot[slot >= SLOTS] - SLOTS] = np.log2(hit[slot >= SLOTS]).astype(np.uint8)
    return late, common


def _named(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, id, n, root of each document; root is null without words."""
    described = stored(_describe(docs, words, num, den))
    meta = described.filter("slot is null").select("doc_id", "id", "n", "v", "sketch")
    late, common = _frequencies(described)
    posts = _posts(docs, words, num, den, late, common).repartition(parts(docs.sparkSession), "token")
    # tokens of one and the same group of sets: one of them stands for all
    shared = posts.groupBy("token").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("k"), F.sum(F.shiftright("v", 31)).alias("x")).filter("low != high")
    shared = shared.groupBy("low", "high", "k", "x").agg(F.min("token").alias("token"))
    drawn = meta.filter("v is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    few = posts.join(shared.filter(F.col("k") <= CROWD).select("token"), "token")
    near = _near(few.join(drawn, "v"), num, den)
    # no task gets all sets of a frequent shingle: each set meets the smallest in a join. One plan, so that all uses share the posts' shuffle
    crowds = shared.filter(F.col("k") > CROWD).select("token", "low")
    near = near.unionByName(posts.join(crowds, "token").filter("v != low").select(F.col("v").alias("a"), F.col("low").alias("b")))
    blocks = stored(components(near).select(F.col("node").alias("v"), F.col("root").alias("block")))
    vertices = meta.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    members = stored(blocks.join(vertices, "v"))
    heavy = stored(members.groupBy("block").agg(F.ceil(F.sum("n") / UNIT).cast("int").alias("chunks")).filter("chunks > 1"))
    members = members.join(heavy, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("v", F.lit(1)), F.col("chunks")).cast("int")
    chunk = F.when(F.col("v") == F.col("block"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    links = _search(docs, members.select(F.explode(chunk).alias("c"), "block", "v", "id").select(F.xxhash64("block", "c").alias("unit"), "v", "id"), words, num, den)
    if heavy.limit(1).count():
        links = stored(links)
        links = links.unionByName(_search(docs, _across(members.filter("chunks > 1"), components(links)), words, num, den))
    roots = components(links).select(F.col("node").alias("v"), "root")
    return stored(meta.join(roots, "v", "left").select("doc_id", "id", "n", F.coalesce("root", "v").alias("root")))


def groups(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    named = _named(docs, words, num, den)
    # stored, so that documents meet their names in a join of plain shuffles, which AQE splits where a component is large
    names = stored(named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).filter("k > 1").drop("k"))
    out = named.join(names, "root", "left")
    # a document alone is its own component
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Units in which the sets outside the largest component of a block meet all of its chunks."""
    own = stored(members.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v")))
    sizes = own.groupBy("block", "root").agg(F.count("*").alias("k"))
    main = sizes.withColumn("p", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("k"), "root"))).filter("p = 1").select("block", F.col("root").alias("main"))
    own = own.join(main, "block")
    others = own.filter("root != main")
    pieces = others.groupBy("block").agg(F.ceil(F.sum("n") / UNIT).cast("int").alias("pieces"))
    own, others = own.join(pieces, "block"), others.join(pieces, "block")
    piece, chunk = F.pmod(F.xxhash64("v", F.lit(2)), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), F.col("chunks")).cast("int")
    a = own.select("block", "v", "id", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q"))
    b = others.select("block", "v", "id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), piece.alias("q"))
    return a.unionByName(b).select(F.xxhash64("block", "c", "q", F.lit(3)).alias("unit"), "v", "id")


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (nulls last), and of the smallest hash among rows of one doc_id.
    Documents without words all stay."""
    named = _named(docs, words, num, den)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    kept = named.filter("root is not null").groupBy("root").agg(F.min(first).alias("f")).select(F.col("f.id").alias(_ID)).distinct()
    keyed = docs.withColumn(_ID, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    wordless = named.filter("root is null").select(F.col("id").alias(_ID)).distinct()
    one = keyed.join(kept, _ID, "left_semi").withColumn(_PLACE, F.row_number().over(Window.partitionBy(_ID).orderBy(F.lit(0)))).filter(F.col(_PLACE) == 1)
    return one.select(*docs.columns).unionByName(keyed.join(wordless, _ID, "left_semi").select(*docs.columns))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM cut),
named AS (SELECT doc_id, len(s)::BIGINT AS n, s, md5(array_to_string(list_sort(s), chr(10))) AS v FROM sets),
vertices AS (SELECT v, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY v),
flat AS (SELECT v, n, unnest(s) AS x FROM vertices),
links AS (
  SELECT a.v AS a, b.v AS b FROM flat a JOIN flat b ON a.x = b.x AND a.v < b.v
  GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT v, v FROM vertices UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
components AS (SELECT r.a AS v, min(d.doc_id) AS c FROM reach r JOIN named d ON d.v = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n > 0 THEN c ELSE doc_id END AS component_id FROM named LEFT JOIN components USING (v)
"""
