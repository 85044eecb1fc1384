"""The pipeline's rows against a plain version of all five stages, on whole texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from keyprune.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(docs: list[dict]) -> list[dict]:
    known = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    share = Counter(r["quality"] for r in known)
    assert max(share.values()) <= quality.PER_LABEL
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    rows = sorted((r["doc_id"], r["quality"]) for r in known if r["doc_id"] in texts)
    net = quality.train([texts[i].encode() for i, _ in rows], [q for _, q in rows])
    net.bias += float(quality.np.log(share[1] / share[0]))
    return [d for d in docs if net.score([(d["text"] or "").encode()])[0] >= 0.5]


def one_of_each(docs: list[dict]) -> list[dict]:
    sets = []
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                up[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(d["doc_id"], least.get(find(i), d["doc_id"]))
    return [d for i, d in enumerate(docs) if least[find(i)] == d["doc_id"]]


def without_repeats(docs: list[dict]) -> list[dict]:
    raws = [(d["text"] or "").encode() for d in docs]
    seen = Counter(hashlib.md5(r[i : i + 200]).digest() for r in raws for i in range(len(r) - 199))
    out = []
    for d, r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[hashlib.md5(r[i : i + 200]).digest()] > 1:
                gone[i : i + 200] = b"\1" * 200
        if not any(gone):
            out.append(d)
            continue
        kept, at = [], 0
        for c in r.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        if kept:
            out.append(d | {"text": "".join(kept), "n_chars": len(kept)})
    return out


def mixed(docs: list[dict]) -> list[dict]:
    sources = defaultdict(list)
    for d in docs:
        sources[d["source"]].append(d)
    size = {s: sum(len(WORD.findall(d["text"] or "")) for d in ds) for s, ds in sources.items()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    target, left = {}, set(size)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left) if left else 0
        full = {s for s in left if level * weight[s] > 3 * size[s]}
        if not full:
            break
        target |= {s: 3 * size[s] for s in full}
        left -= full
    target |= {s: level * weight[s] for s in left}
    out = []
    for s, ds in sources.items():
        epochs, rest = divmod(int(target[s] + 0.5), size[s])
        for d in sorted(ds, key=lambda d: hashlib.md5(f"mix{d['doc_id']}|{d['text'] or ''}".encode()).hexdigest()):
            words = list(WORD.finditer(d["text"] or ""))
            out += [d] * epochs
            part = min(rest, len(words))
            rest -= part
            if part and part == len(words):
                out.append(d)
            elif part:
                text = d["text"][: words[part - 1].end()]
                out.append(d | {"text": text, "n_chars": len(text)})
    return out


def test_rows_equal_the_plain_version(spark):
    import corpus_pipeline

    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len({d["doc_id"] for d in docs}) == len(docs)
    kept = [docs]
    for stage in (good, one_of_each, without_repeats, mixed):
        kept.append(stage(kept[-1]))
    assert len(kept[0]) > len(kept[1]) > len(kept[2])
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tool = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d["doc_id"], d["lang"], d["source"], d["n_chars"], tuple(tool.encode_ordinary(d["text"] or ""))) for d in kept[-1])
    got = Counter((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
