"""Repeated rows, rows without doc_id, clashing columns, long texts and empty tables; several blocks, rounds and buckets."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import bpe, decontaminate, language_id, license_scan, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_files

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(3)
WORDS = ["".join(RANDOM.choices("abcdefghé", k=RANDOM.randint(1, 9))) for _ in range(3000)]
LONG = " ".join(RANDOM.choices(WORDS, k=60_000))
PASSAGE = " ".join(RANDOM.choices(WORDS, k=120))
TEXTS = [LONG, LONG[1000:9000] + " x", PASSAGE, "a " + PASSAGE, "", None, "licensed under the MIT license", " ".join(RANDOM.choices(WORDS, k=50)), "z" * 3000]
#: Text by number, and ids of which some are missing and some the same for different texts.
ROWS = [(0, 1), (0, 1), (1, None), (1, None), (2, None), (3, 7), (4, 7), (4, 8), (5, None), (5, 9), (6, 9), (6, 9), (7, None), (8, 3), (8, None)]
BYTES, WORDFILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(d, TEXTS[t], "en" if t % 2 else "fr", f"s{k}", 5, 1, 2, ["x"], "y", 0) for k, (t, d) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, grp long, fp long, rows array<string>, numbers string, _row int").repartition(3)


@pytest.fixture(scope="module")
def single(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:40])), (None, "the mit license"), (None, "the mit license"), (3, None), (4, ""), (5, "z" * 3000), (6, PASSAGE)], "item_id long, text string")


def test_every_row_is_answered_for_itself(spark, table, single):
    b = bench(spark)
    model = language_id.train(["aé b", "xyz w"], ["fr", "en"])
    for f in (lambda d: language_id.predict(d, model), license_scan.scan, quality.assess, lambda d: bpe.round_trip(d, BYTES), lambda d: token_counts.counts(d, WORDFILE), lambda d: decontaminate.contamination(d, b)):
        plain = lambda r: repr({k: v for k, v in r.asDict(True).items() if k != "doc_id"})
        one = {r["doc_id"]: plain(r) for r in f(single).collect()}
        assert collections.Counter((r["doc_id"], plain(r)) for r in f(table).collect()) == collections.Counter((d, one[t]) for t, d in ROWS)


def removed(units, size):
    """Of lists of units, one for each row: which units lie in a run of size units that begins twice or more."""
    seen = collections.Counter(h for u in units for h in (hash(tuple(u[k : k + size])) for k in range(len(u) - size + 1)))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for k in range(len(u) - size + 1):
            if seen[hash(tuple(u[k : k + size]))] > 1:
                gone[k : k + size] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 300])
def test_substrings(table, bucket_bytes):
    units = [SPACED.findall(TEXTS[t] or "") for t, _ in ROWS]
    want = collections.Counter((d, len(u), int(g.sum()), hashlib.sha256(" ".join(w for w, x in zip(u, g, strict=True) if not x).encode()).hexdigest()) for (_, d), u, g in zip(ROWS, units, removed(units, 35), strict=True))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removals(table, bucket_bytes=bucket_bytes).collect()) == want
    cut = substring_dedup.remove_repeats(table)
    assert cut.schema == table.schema and cut.count() == len(ROWS)


@pytest.mark.parametrize("how", [{}, {"rounds": 1, "bucket_bytes": 500}])
def test_suffixes(spark, table, how):
    short = {0: (LONG[:6000] + LONG[2000:7000])}
    texts = [(d, (short.get(t, TEXTS[t]) or "").encode()) for t, d in ROWS if t not in (1,)]
    df = spark.createDataFrame([(d, b.decode()) for d, b in texts], "doc_id long, text string")
    want = collections.Counter()
    for (d, b), g in zip(texts, removed([list(b) for _, b in texts], 400), strict=True):
        runs = int((g[1:] & ~g[:-1]).sum()) + int(g[:1].sum())
        want[d, len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removals(df, **how).collect()) == want


def test_a_window_in_half_of_all_documents_over_many_buckets(spark):
    """Each document sends its own windows once; the shared passage costs one entry a group and window, whatever the number of buckets."""
    own = [" ".join(f"{k}w{i}" for i in range(40)) for k in range(400)]
    df = spark.createDataFrame([(k, t + (" " + PASSAGE if k % 2 else "")) for k, t in enumerate(own)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removals(df, bucket_bytes=60).collect()}
    assert found == {k: 120 * (k % 2) for k in range(400)}


def test_near_duplicates_and_the_one_that_stays(table):
    found = simhash.near_duplicates(table).collect()
    prints = {t: next(r["fingerprint"] for r in found if r["doc_id"] == d) for t, d in ((0, 1), (3, 7), (8, 3))}
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count() <= 4
    for r in found:
        same = [x for x in found if near(x["fingerprint"], r["fingerprint"])]
        if not any(near(x["fingerprint"], r["fingerprint"]) for x in found if x not in same):
            assert r["component_id"] == min((x["doc_id"] for x in same if x["doc_id"] is not None), default=None)
    assert len(found) == len(ROWS) and len(set(prints.values())) == 3
    kept = simhash.keep_one(table)
    assert kept.schema == table.schema
    groups = {r["fingerprint"] for r in found}
    assert len({TEXTS.index(r["text"]) for r in kept.collect()}) == kept.count() <= len(groups)


@pytest.mark.parametrize("item_bytes", [4 << 20, 200])
def test_blocks_of_items(spark, table, item_bytes):
    b = bench(spark)
    one, several = ([tuple(r) for r in decontaminate.contamination(table, b, item_bytes=n).orderBy("doc_id", "n_words", "items_sha256").collect()] for n in (4 << 20, item_bytes))
    assert one == several and sum(r[3] > 0 for r in one) >= 4
    clean = decontaminate.keep_clean(table, b, item_bytes)
    assert clean.schema == table.schema and clean.count() == sum(r[3] == 0 for r in one)


def test_token_files(spark, table, tmp_path):
    """Starts follow doc_id with nulls first; rows that share an id come in some order."""
    from tokenizers import Tokenizer

    table.select("doc_id", "text").write.parquet(f"file://{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORDFILE)
    ids = {t: np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for t, x in enumerate(TEXTS)}
    found = token_files.query(spark, f"file://{tmp_path}").collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == collections.Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for t, d in ROWS)
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found[:-1])]).tolist()
    names = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert names == sorted(names)


def test_empty_tables(spark, table, tmp_path):
    none = table.limit(0)
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    bench(spark).limit(0).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert bpe.round_trip(none, BYTES).count() == token_files.query(spark, f"file://{tmp_path}").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, f"file://{tmp_path}").count() == 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert decontaminate.contamination(table, bench(spark).limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_stages_keep_the_columns_of_any_table(spark, table, tmp_path):
    bench(spark).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == table.columns, name
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")


def distance(notice, text):
    """Fewest edits between notice and any part of text."""
    row = [0] * (len(text) + 1)
    for c in notice:
        last, row[0], diag = row[:], row[0] + 1, row[0]
        for k, x in enumerate(text, 1):
            row[k] = min(last[k] + 1, row[k - 1] + 1, last[k - 1] + (c != x))
    return min(row)


def test_fuzzy_notices_by_edit_distance_over_all_places(spark):
    rng = random.Random(11)
    notices, texts = list(license_scan.NOTICES), []
    for n in notices:
        for edits in (0, len(n) // 12, len(n) // 12 + 1, len(n) // 12 + 4):
            x = list(n)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice("qxz")
            texts.append(f"{' '.join(rng.choices(WORDS[:50], k=8))} {''.join(x)} end")
    texts = [" ".join(re.findall("[a-z0-9é]+", t)) for t in texts]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in found.collect():
        near = {(label, distance(n, texts[r["doc_id"]])) for n, label in license_scan.NOTICES.items() if distance(n, texts[r["doc_id"]]) <= len(n) // license_scan.LETTERS_PER_EDIT}
        assert {m["label"] for m in r["matches"]} == {label for label, _ in near}, texts[r["doc_id"]]
        for m in r["matches"]:
            assert m["edits"] >= min(d for label, d in near if label == m["label"])
            words = texts[r["doc_id"]].split()[m["first_word"] : m["last_word"] + 1]
            assert min(distance(n, " ".join(words)) for n, label in license_scan.NOTICES.items() if label == m["label"]) <= m["edits"]


def test_ten_megabytes_of_notices_take_seconds(spark):
    import time

    df = spark.createDataFrame([(1, "so it is under an mit license " * 330_000)], "doc_id long, text string")
    began = time.time()
    r = license_scan.scan(df).drop("matches").first()
    assert r["n_base"] == 330_000 and r["last_word"] == 7 * 330_000 - 2 and time.time() - began < 60


def test_languages_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    sure = [r for r in held if not r["rejected"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in sure]) >= 0.97 and abs(np.mean([r["score"] for r in sure]) - 1) < 0.1


def test_many_rows_of_one_id_are_not_collected(spark):
    rows = [(None if k % 2 else 5, ["uno dos", "one two"][k % 2], ["es", "en"][k % 2]) for k in range(400)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=50)
    assert model is None or set(model.languages) <= {"en", "es"}
