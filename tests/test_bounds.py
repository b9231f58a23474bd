"""Index kernel against plain versions; what a task holds, and what a search makes once."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline import feature_queries, kernel_queries, queries  # noqa: F401
from strandline.functions import kmers
from strandline.operators import dealing, intervals, seeds
from strandline.plans import search
from strandline.plans.index import Index, Options

RANDOM = random.Random(11)


def test_codes_and_dust_of_every_k():
    seq = "".join(RANDOM.choices("ACGT", k=90)) + "N" + "A" * 40 + "ACAC" * 10 + "".join(RANDOM.choices("ACGT", k=60))
    for k in range(1, 32):
        at, fwd, rev = kmers.codes(seq.encode(), k)
        want = [i for i in range(len(seq) - k + 1) if "N" not in seq[i : i + k]]
        assert at.tolist() == want
        assert [kmers.text_of(c, k) for c in fwd.tolist()] == [seq[i : i + k] for i in want]
        assert [kmers.text_of(c, k) for c in rev.tolist()] == [seq[i : i + k][::-1].translate(str.maketrans("ACGT", "TGCA")) for i in want]
        assert kmers.dust_at(seq.encode(), k)[at].tolist() == [kmers.dust_of(seq[i : i + k]) for i in want]


def test_least_xor_with_repeated_and_crowded_codes():
    rng = np.random.default_rng(5)
    for bits, n in ((62, 1), (62, 3000), (42, 500), (8, 900), (4, 2)):
        value = np.sort(np.concatenate((rng.integers(0, 1 << bits, n), np.repeat(rng.integers(0, 1 << bits, 1), n // 2), (1 << bits - 1) + np.arange(min(n, 1 << bits - 1)))))
        target = np.concatenate((rng.integers(0, 1 << bits, 200), value[:50]))
        low, high = seeds.least_xor(value, target, bits)
        other = value[None, :] ^ target[:, None]
        least = other == other.min(1, keepdims=True)
        assert low.tolist() == least.argmax(1).tolist() and (high - low).tolist() == least.sum(1).tolist()


def test_seeds_pass_on_before_a_batch_is_over(monkeypatch):
    monkeypatch.setattr(seeds, "HELD_ROWS", 1000, raising=False)
    texts = ["".join(RANDOM.choices("ACGT", k=400)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["id", "seq"])
    masks = np.arange(64), np.random.default_rng(2).integers(0, 1 << 42, 64)
    for out in (list(seeds._index_seeds([batch], 21, masks, 100, 50, 25)), list(seeds._capture([batch], 21, masks))):
        assert len(out) > 2 and max(x.num_rows for x in out) < 2000
        assert set(pa.Table.from_batches(out)["id"].to_pylist()) == set(range(60))


def test_a_search_aligns_once(spark):
    text = "".join(RANDOM.choices("ACGT", k=600))
    contigs = spark.createDataFrame([("g1", 0, "c", text), ("g2", 0, "c", text[100:] + "A")], "genome_id string, seq_idx int, seq_id string, seq string")
    queries = spark.createDataFrame([("q", text[200:500])], "query string, seq string")
    found = search.search(Index.build(contigs, Options(k=21, masks=64, min_length=21)), queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert {(r["sgenome"], r["qcovGnm"]) for r in found.collect()} == {("g1", 100.0), ("g2", 100.0)}


def test_union_length_in_every_row(spark):
    rows = [(RANDOM.randrange(4), b := RANDOM.randrange(60), b + RANDOM.randrange(9)) for _ in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "g long, b long, e long")
    want = {r["g"]: r["covered"] for r in intervals.union_length(df, ["g"], "b", "e").collect()}
    assert want == {g: len({x for k, b, e in rows if k == g for x in range(b, e + 1)}) for g in want}
    out = intervals.with_union_length(df, ["g"], F.col("b"), F.col("e")).collect()
    assert len(out) == 220 and all(r["covered"] == want[r["g"]] for r in out)


def test_tasks_follow_the_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(dealing, "TASK_ROWS", 200)
    monkeypatch.setattr(seeds, "TASK_PAIRS", 5000)
    for name in ("seed_window_gaps", "seed_window_counts", "seed_distance_histogram", "hsp_numbering", "interval_merge", "coverage_union", "hsp_cluster_rollup", "fragment_shared_kmers", "top_fragments"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        parts = [int(x) for x in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)]
        assert parts and max(parts) >= n // 200, name


def test_shared_with_a_kmer_beyond_one_task(spark, monkeypatch):
    rows = [(i % 40, i % 7 if i % 3 else 0) for i in range(600)]
    df = spark.createDataFrame(rows, "left long, kmer long")
    want = {}
    for a, k in set(rows):
        for b, j in set(rows):
            if j == k:
                want[a, b] = want.get((a, b), 0) + 1
    for pairs in (100, 1_000_000):
        monkeypatch.setattr(seeds, "TASK_PAIRS", pairs, raising=False)
        found = seeds.shared(df, df.withColumnRenamed("left", "right"), "kmer", "left", "right", 2).collect()
        assert {(r["left"], r["right"]): r["n"] for r in found} == {k: v for k, v in want.items() if v >= 2}
