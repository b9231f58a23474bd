"""The pipeline's stages against brute force, each on what its predecessor kept."""

import base64
import collections
import hashlib
import re

import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline

SF = "/root/testdata/sf0.001"
UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def repeats(w):
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = [False] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            out[k : k + 5] = [True] * 5
    return sum(out)


def fingerprint(text):
    w = SPACED.findall(text.translate(UP))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stages(spark, tmp_path):
    docs, states = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    states.append({r["doc_id"]: r for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        states.append({r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, good, single, cut, clean, last = states
    for d, r in start.items():
        w = SPACED.findall(r["text"] or "")
        n = repeats(w)
        if len(w) < 10 or 100 * n > 20 * len(w):
            assert d not in good
        elif n == 0:
            assert d in good
    prints = {d: fingerprint(r["text"]) for d, r in good.items()}
    root = {d: d for d in prints}
    for _ in range(6):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert set(single) == {d for d in root if root[d] == d}
    words = {d: SPACED.findall(r["text"]) for d, r in single.items()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for d, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        assert SPACED.findall(cut[d]["text"]) == [x for x, y in zip(w, keep, strict=True) if y] and cut[d]["n_chars"] == len(cut[d]["text"])
        assert all(keep) <= (cut[d]["text"] == single[d]["text"])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = PLAIN.findall(r["text"].translate(UP))
        windows |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    leaky = {d for d, r in cut.items() for w in [PLAIN.findall(r["text"].translate(UP))] if any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))}
    assert set(clean) == set(cut) - leaky
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: r["n_tokens"] for d, r in last.items()} == {d: len(library.encode_ordinary(r["text"])) for d, r in clean.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(clean[d]["text"].encode()).hexdigest() for d, r in last.items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(clean)
