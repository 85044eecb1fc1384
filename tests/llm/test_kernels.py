"""The operators' kernels against brute force, without Spark."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from keyprune.llm import bpe, flac, jaccard, langid, maxent, quality, suffixes


def test_replay_equals_tiktoken():
    tool = bpe.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tool.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c'st\n\té中́😀 12 \r\x1c\x85 zq") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(5000)] + ["a" * 3000, " " * 500, "", None, "<|endoftext|>"]
    for t, ids in zip(texts, tool.encode_many(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t or "") and tool.decode(ids.tolist()) == (t or "").encode()


def test_replay_follows_order_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 290, b"bc": 310, b"cab": 280, b"abab": 320}
    tool = bpe.MergeReplay(ranks, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert [x.tolist() for x in tool.encode_many(words)] == [enc.encode_ordinary(w) for w in words]


def test_divide_skip_equals_brute_force():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 400, len(b)), b).astype(np.uint64)) for b in base for _ in range(3)]
    sets.sort(key=len)
    for num, den in ((90, 100), (8, 10), (5, 10)):
        forest = jaccard.Forest(len(sets))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared = len(np.intersect1d(a, b))
                if den * shared >= num * (len(a) + len(b) - shared):
                    forest.join(i, j)
                    x, y = (a, b) if len(a) <= len(b) else (b, a)
                    s, t = jaccard.sketch(x, num, den), jaccard.sketch(y, num, den)
                    assert jaccard.may_link(len(x), int.from_bytes(s, "little"), 8 * len(s), len(y), int.from_bytes(t, "little"), 8 * len(t), num, den)
        assert jaccard.link(sets, num, den) == [forest.find(i) for i in range(len(sets))]


def _repeated(raws, length):
    c = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    return {(j, i) for j, r in enumerate(raws) for i in range(len(r) - length + 1) if c[r[i : i + length]] > 1}


def _thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


def test_hash_is_that_of_the_prime_and_tells_thue_morse_apart():
    x = _thue_morse(2048)
    flat = np.frombuffer(x + x.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    h = suffixes.PrefixHash(flat)
    for a, b in ((0, 7), (100, 1300), (2048, 4096)):
        want = sum((int(v) + 1) * pow(suffixes.BASE, i, suffixes._PRIME) for i, v in enumerate(flat[a:b])) % suffixes._PRIME
        assert int(h.of(np.array([a]), np.array([b]))[0]) == want
    for n in (256, 1024, 2048):
        one, two = int(h.of(np.array([0]), np.array([n]))[0]), int(h.of(np.array([2048]), np.array([2048 + n]))[0])
        assert one != two and bin(one ^ two).count("1") > 10


def test_suffix_order_is_that_of_the_bytes_also_with_a_base_that_collides():
    rng = np.random.default_rng(5)
    flat = np.concatenate((rng.integers(97, 99, 400), np.frombuffer(_thue_morse(300), np.uint8), np.full(200, 97))).astype(np.uint8)
    pos = rng.integers(0, 850, 300)
    have = rng.integers(0, 50, 300)
    group = np.sort(rng.integers(0, 9, 300))
    for base in (suffixes.BASE, 1):  # base 1: every permutation collides
        order, extension = suffixes.suffix_order(flat, pos, have, group, base)
        text = [flat[p : p + n].tobytes() for p, n in zip(pos, have, strict=True)]
        assert (group[order] == group).all()
        for i in range(1, 300):
            x, y = text[order[i - 1]], text[order[i]]
            if group[i] != group[i - 1]:
                assert extension[i] == -1
            else:
                assert x <= y and extension[i] == next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_run_sort_finds_repeated_windows():
    rng = random.Random(4)
    raws, offs = [], []
    for _ in range(200):
        left, right = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(2))
        raws.append(left + b"anchor-with-more" + right)
        offs.append(len(left))
    keep = [i for i, r in enumerate(raws) if len(r) >= 20]
    raws, offs = [raws[i] for i in keep], [offs[i] for i in keep]
    # windows that hold the anchor: the first starts offs before it at most
    first = [max(0, o + 16 - 20) for o in offs]
    raws, offs = [r[f:] for r, f in zip(raws, first, strict=True)], np.array([o - f for o, f in zip(offs, first, strict=True)])
    counts = np.array([max(0, min(len(r) - 19, o + 1)) for r, o in zip(raws, offs, strict=True)])
    row, w = suffixes.repeated_windows(np.zeros(len(raws), np.int64), raws, counts, offs, 20)
    seen = Counter(r[i : i + 20] for r, n in zip(raws, counts, strict=True) for i in range(n))
    assert set(zip(row.tolist(), w.tolist(), strict=True)) == {(j, i) for j, (r, n) in enumerate(zip(raws, counts, strict=True)) for i in range(n) if seen[r[i : i + 20]] > 1}


def test_flac_round_trip_seek_and_checks():
    rng = np.random.default_rng(6)
    payloads = [flac.payload_of(t)[1] for t in (None, "", "héllo wörld " * 200, "a" * 576)] + [rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), bytes([0, 255] * 288), b"\0" * 576 * 150]
    media = flac.store(payloads)
    for p, m, back in zip(payloads, media, flac.load(media), strict=True):
        assert (back.astype(np.int16) + 128).astype(np.uint8).tobytes() == p
        for first, n in ((0, 5), (570, 10), (len(p) - 3, 9)):
            assert (flac.read_range(m, first, n) == back[first : first + n]).all()
    bad = bytearray(media[2])
    bad[-9] ^= 4
    with pytest.raises(ValueError):
        flac.load([bytes(bad)])


class _Writer:
    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def _rice(w, res, order, parts, method, escape):
    """Residuals in 2^parts partitions, the first of them with an escape code where asked."""
    w.put(method, 2)
    w.put(parts, 4)
    width, size, at = 4 + method, (len(res) + order) >> parts, 0
    for i in range(1 << parts):
        own = res[at : at + size - (0 if i else order)]
        at += len(own)
        if escape and not i:
            plain = max((abs(r).bit_length() + 1 for r in own), default=0)
            w.put((1 << width) - 1, width)
            w.put(plain, 5)
            for r in own:
                w.put(r & ((1 << plain) - 1), plain)
            continue
        k = 3 + i % 2
        w.put(k, width)
        for r in own:
            u = r << 1 if r >= 0 else (-r << 1) - 1
            w.put(1, (u >> k) + 1)
            w.put(u & ((1 << k) - 1), k)


def _made(channels, depth, kind, weights=(), shift=0, parts=0, method=0, escape=False, wasted=0, assignment=None, size_code=7):
    """One FLAC stream of one frame, without a seek table, by the format's own description."""
    n = len(channels[0])
    w = _Writer()
    w.put(0x7FFC << 1, 16)
    w.put(size_code, 4)
    w.put(0, 4)
    w.put(len(channels) - 1 if assignment is None else assignment, 4)
    w.put({8: 1, 12: 2, 16: 4, 24: 6}[depth], 3)
    w.put(0, 1)
    w.put(0, 8)
    if size_code in (6, 7):
        w.put(n - 1, 8 if size_code == 6 else 16)
    w.put(flac.crc8(w.bytes()), 8)
    coded = channels
    if assignment == 8:
        coded = [channels[0], [a - b for a, b in zip(*channels, strict=True)]]
    elif assignment == 9:
        coded = [[a - b for a, b in zip(*channels, strict=True)], channels[1]]
    elif assignment == 10:
        coded = [[(a + b) >> 1 for a, b in zip(*channels, strict=True)], [a - b for a, b in zip(*channels, strict=True)]]
    for i, x in enumerate(coded):
        bits = depth + (assignment in (8, 10) and i == 1 or assignment == 9 and i == 0)
        order = len(weights)
        w.put(0, 1)
        w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind], 6)
        w.put(1 if wasted else 0, 1)
        if wasted:
            w.put(1, wasted)
            x, bits = [v >> wasted for v in x], bits - wasted
        mask = (1 << bits) - 1
        for v in x[: {"constant": 1, "verbatim": n}.get(kind, order)]:
            w.put(v & mask, bits)
        if kind == "lpc":
            w.put(11, 4)
            w.put(shift, 5)
            for c in weights:
                w.put(c & 4095, 12)
        if kind in ("fixed", "lpc"):
            res = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(weights)) >> shift) for t in range(order, n)]
            _rice(w, res, order, parts, method, escape)
    frame = w.bytes()
    frame += int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    pcm = np.array(channels, np.int64).T.astype("<i8").copy().view(np.uint8).reshape(-1, 8)[:, : -(-depth // 8)].tobytes()
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (len(channels) - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_reads_all_kinds_of_subframes():
    rng = np.random.default_rng(9)
    wave = [int(90 * np.sin(i / 9)) + int(x) for i, x in enumerate(rng.integers(-3, 4, 192))]
    loud = [200 * x for x in wave]
    other = [x + int(d) for x, d in zip(loud, rng.integers(-20, 21, 192), strict=True)]
    lpc = {"kind": "lpc", "weights": (1900, -900, 20), "shift": 10}
    cases = [([wave], 8, {"kind": "verbatim"}), ([[7] * 192], 8, {"kind": "constant"}), ([wave], 8, lpc), ([wave], 8, lpc | {"parts": 3, "escape": True}), ([loud], 16, lpc | {"method": 1, "parts": 2, "escape": True})]
    cases += [([wave], 8, {"kind": "fixed", "weights": c, "parts": 1}) for c in ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))]
    cases += [([[x << 2 for x in wave]], 12, {"kind": "fixed", "weights": (2, -1), "wasted": 2}), ([wave], 8, {"kind": "verbatim", "size_code": 1}), ([wave], 8, {"kind": "verbatim", "size_code": 6})]
    cases += [([loud, other], 16, lpc | {"assignment": a}) for a in (None, 8, 9, 10)] + [([loud, other, wave], 24, {"kind": "verbatim"})]
    for channels, depth, how in cases:
        media = _made(channels, depth, **how)
        samples, rate, bits = flac.decode(media)
        assert samples.T.tolist() == channels and (rate, bits) == (44100, depth)
        bad = bytearray(media)
        bad[-5] ^= 1
        with pytest.raises(ValueError):
            flac.decode(bytes(bad))
    mono = _made([wave], 8, **lpc)
    own = flac.store([flac.payload_of("héllo " * 300)[1]])[0]
    assert [x.tolist() for x in flac.load([mono, own])] == [wave, flac.load([own])[0].tolist()]
    assert (flac.decode(own)[0][:, 0] == flac.load([own])[0]).all() and flac.read_range(mono, 5, 7).tolist() == wave[5:12]


def test_flac_of_more_frames_than_a_seek_table_holds(monkeypatch):
    monkeypatch.setattr(flac, "POINTS", 7)
    payload = flac.payload_of("some words in a long text " * 500)[1]
    media = flac.store([payload])[0]
    assert flac.layout(media) is None and int.from_bytes(media[43:46], "big") <= 18 * 7
    assert ((flac.load([media])[0].astype(np.int16) + 128).astype(np.uint8).tobytes()) == payload


def test_small_models():
    good, bad = ["The cat sat on a mat and slept well today."] * 30, ["BUY NOW!! CHEAP!! CLICK!!"] * 30
    net = quality.train([t.encode() for t in good + bad], [1] * 30 + [0] * 30)
    p = net.score([good[0].encode(), bad[0].encode(), b"", b"x" * 5000])
    assert p[0] > 0.5 > p[1] and ((p >= 0) & (p <= 1)).all()
    assert (quality.train([], []).score([b"", b"a"]) == 0.5).all()
    profiles = {k: [int(c) for c, _ in Counter(langid.grams(t).tolist()).most_common(300)] for k, t in (("en", "the cat and the dog of the house"), ("de", "der hund und die katze des hauses"))}
    tool = langid.Profiles(profiles)
    assert tool.judge("the dog")[0] == "en" and tool.judge("die katze")[0] == "de" and tool.judge("12 !") == ("und", 0.0) and tool.judge(None) == ("und", 0.0)
    assert maxent.words_of("A b\x1cc\n É") == [b"a", b"b\x1cc", "É".encode()]
