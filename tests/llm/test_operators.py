"""The ten operators against brute force, on awkward texts."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from strandline.llm import bpe, decontaminate, language_id, license_scan, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_files

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(WORDS)
TEXTS = [None, "", "   \n\t", "one", PASSAGE, PASSAGE + " tail", "head " + PASSAGE, "x" * 900, "x" * 900, "don't 'll !'s it's 'they 12½ ß Σς  á İ <|endoftext|> \x1c日本語 é" * 9, "a b " * 300, "Licensed under the Apache License, Version 2.0. CC BY CC BY the MIT License", "licensed under the apachee licence version 2 0", "\r\n".join(["same line here"] * 20), "A" * 5000 + "\n" + "é" * 700]
SHA = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long, flags int").repartition(3)


def got(df):
    return {r["doc_id"]: r for r in df.collect()}


def same(df, expected):
    found = got(df)
    assert len(found) == len(TEXTS)
    for k, want in expected.items():
        assert {c: found[k][c] for c in want} == want, (k, TEXTS[k])


def test_substring_dedup(docs):
    words = {i: SPACED.findall(t or "") for i, t in enumerate(TEXTS)}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    expected = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        expected[i] = {"n_words": len(w), "n_removed": keep.count(False), "kept_sha256": SHA(" ".join(x for x, y in zip(w, keep, strict=True) if y))}
    same(substring_dedup.removals(docs), expected)
    cut = got(substring_dedup.remove_repeats(docs))
    assert cut[5]["text"] == "tail" and cut[6]["text"] == "head " and cut[3]["text"] == "one" and cut[0]["text"] is None


def test_suffix_dedup(docs):
    raw = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    seen = collections.Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    expected = {}
    for i, b in raw.items():
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                keep[k : k + 400] = False
        expected[i] = {"n_bytes": len(b), "n_removed": int((~keep).sum()), "kept_sha256": SHA(np.frombuffer(b, np.uint8)[keep].tobytes())}
    same(suffix_dedup.removals(docs), expected)


def test_difference_cover():
    cover = suffix_dedup.difference_cover(64)
    assert {(a - b) % 64 for a in cover for b in cover} == set(range(64))


def test_decontamination(spark, docs):
    items = [(1, " ".join(WORDS[5:30])), (2, "a b"), (3, None), (4, "MIT-License"), (5, " ".join(WORDS[20:28]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(UP))
        for k in range(max(1, len(w) - 7)) if w else []:
            windows[tuple(w[k : k + 8])].add(i)
    expected = {}
    for d, t in enumerate(TEXTS):
        w = PLAIN.findall((t or "").translate(UP))
        hit, names = [False] * len(w), set()
        for key, owners in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit[k : k + len(key)] = [True] * len(key)
                    names |= owners
        expected[d] = {"n_words": len(w), "n_hit": sum(hit), "n_items": len(names), "items_sha256": SHA(",".join(sorted(map(str, names))))}
    same(decontaminate.contamination(docs, bench), expected)


def test_simhash(docs):
    prints = {}
    for d, t in enumerate(TEXTS):
        w = SPACED.findall((t or "").translate(UP))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    same(simhash.near_duplicates(docs), {d: {"fingerprint": f"{p:016x}", "component_id": root[d]} for d, p in prints.items()})


def test_simhash_links_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in base)]))
    df = spark.createDataFrame([(int(v.view(np.int64)),) for v in values], "fp long")

    def parts(pairs):
        root = {int(v.view(np.int64)): int(v.view(np.int64)) for v in values}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {k: find(k) for k in root}

    near = [(int(a.view(np.int64)), int(b.view(np.int64))) for i, a in enumerate(values) for b in values[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 4]
    for limit in (8192, 8):  # the second keys large buckets again
        links = [(r["a"], r["b"]) for r in simhash.links(df, len(values), limit).collect()]
        assert parts(links) == parts(near)
    assert {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(near, "a long, b long")).collect()} == {k: v for k, v in parts(near).items() if any(k in p for p in near)}


def test_quality(docs):
    expected = {}
    for d, t in enumerate(TEXTS):
        w, lines = SPACED.findall(t or ""), [x for x in (t or "").split("\n") if SPACED.search(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = [False] * len(w)
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                rep[k : k + 5] = [True] * 5
        failed = len(w) < 10 or 100 * sum(rep) > 20 * len(w)
        longest = max((n for a in range(len(w)) for b in range(a + 1, len(w)) if len(w) < 100 for n in [next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b)] if n >= 5), default=0)
        expected[d] = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(rep), "base_failed": failed} | ({"longest_repeat": longest} if len(w) < 100 else {})
    same(quality.assess(docs), expected)
    assert set(got(quality.keep_good(docs))) == {d for d, r in got(quality.assess(docs)).items() if r["kept"]}


def test_license_scan(docs):
    found = got(license_scan.scan(docs))
    assert (found[11]["n_base"], found[11]["first_word"], found[11]["last_word"], found[11]["base_labels"]) == (4, 3, 13, "apache,cc-by,mit")
    assert (found[12]["base_labels"], found[12]["labels"]) == ("", "apache") and found[12]["matches"][0]["edits"] == 2
    assert found[0]["n_words"] == 0 and found[0]["first_word"] is None


def test_bpe(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for d, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        expected[d] = {"n_tokens": len(ids), "ids_sha256": SHA(",".join(map(str, ids))), "decoded_sha256": SHA(t or "")}
    same(bpe.round_trip(docs, path), expected)


def test_token_files_and_counts(docs, tmp_path, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, files, counts = Tokenizer.from_file(path), 0, {}, {}
    for d, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        counts[d] = {"n_bytes": len((t or "").encode()), "n_tokens": len(ids), "over_limit": len(ids) > 2048}
        raw = np.array([*ids, 2], "<u4").tobytes()
        files[d] = {"start": start, "ids": bytearray(raw)}
        start += len(raw) // 4
    same(token_counts.counts(docs, path), counts)
    token_files.write(docs, path, f"file://{tmp_path}/set")
    same(token_files.read(spark, f"file://{tmp_path}/set"), files)
    assert zlib.crc32(token_files.unpack(*token_files.pack(np.array([0, 255, 256, 65535, 65536, 2**32 - 1])), 6).astype("<u4").tobytes()) == zlib.crc32(np.array([0, 255, 256, 65535, 65536, 2**32 - 1], "<u4").tobytes())


def test_language_id(spark, docs):
    rng = np.random.default_rng(1)
    pools = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["krtek", "zmrzl", "prst"]}
    rows = [(i, " ".join(rng.choice(pools[lang], 30)), lang) for i in range(300) for lang in [["aa", "bb"][i % 2]]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", None)], "doc_id long, text string, lang string")
    found = got(language_id.predict(df, language_id.fit(df)))
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows]) == 1
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in found.values())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (substring_dedup.removals(none), suffix_dedup.removals(none), simhash.near_duplicates(none), quality.assess(none), license_scan.scan(none), decontaminate.contamination(none, bench), token_counts.counts(none, path), language_id.predict(none, language_id.fit(none))):
        assert df.count() == 0
