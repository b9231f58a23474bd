"""Memory of the exchange of strings: Arrow batches stay small, whatever a file or some groups hold."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import exchange, substring_dedup, suffix_dedup


def test_blocks_leave_in_small_batches():
    n, buckets = 400_000, 64
    rng = np.random.default_rng(7)
    hashes = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(exchange.BLOCK_GROUPS)]
    rows = pa.array([[{"text": str(k)}] for k in range(len(hashes))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(hashes)), pa.int64()), rows], ["grp", "rows"])

    def kernel(texts):
        own = hashes[int(texts[0].as_py())]
        return own, own.astype(np.uint32)

    out = list(exchange._entries([batch], kernel, [], buckets, (1, 2)))
    assert max(x.nbytes for x in out) < 1.5 * exchange.BATCH_BYTES
    found, last = {k: [] for k in range(len(hashes))}, -1
    for x in out:
        for b, *row in zip(*(c.to_pylist() for c in x.columns), strict=True):
            assert b > last and b % 2
            last = b
            names, counts, firsts, prints, checks = (np.frombuffer(v, kind) for v, kind in zip(row, ("<i8", "<u4", "<u4", "<u8", "<u4"), strict=True))
            ends = np.cumsum(counts.astype(np.int64))
            for name, first, i, j in zip(names.tolist(), firsts.tolist(), ends - counts, ends, strict=True):
                assert (checks[i:j] == prints[i:j].astype(np.uint32)).all()
                found[name].append((first, prints[i:j]))
    for k, own in enumerate(hashes):
        ranked = np.sort(own)
        wanted = ranked[exchange._bucket_of(ranked, buckets) % 2 == 1]
        assert (np.concatenate([p for _, p in found[k]]) == wanted).all()
        assert all((ranked[first : first + len(p)] == p).all() for first, p in found[k])


def test_groups_are_read_in_small_batches(spark, monkeypatch):
    pack, most = exchange._pack, exchange.BATCH_BYTES

    def watched(batches, group_bytes):
        for batch in batches:
            if batch.nbytes > 1.5 * most:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            yield from pack([batch], group_bytes)

    monkeypatch.setattr(exchange, "_pack", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 40, 1, 1).selectExpr("id doc_id", "repeat(char(cast(97 + id % 26 as int)), 500000) text")
    groups = exchange.packed(docs)
    assert spark.conf.get(key) == before
    assert sum(len(r["rows"]) for r in groups.collect()) == 40


@pytest.mark.parametrize("module, step, run", [(substring_dedup, "_digest", substring_dedup.removals), (substring_dedup, "_rewrite", substring_dedup.remove_repeats), (suffix_dedup, "_tied", suffix_dedup.removals), (suffix_dedup, "_digest", suffix_dedup.removals)])
def test_groups_meet_their_answers_in_small_batches(spark, monkeypatch, module, step, run):
    made, most = getattr(module, step), exchange.GROUP_BYTES + exchange.BATCH_BYTES

    def watched(batches, **how):
        for batch in batches:
            if batch.nbytes > 1.5 * most:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            yield from made([batch], **how)

    monkeypatch.setattr(module, step, watched)
    docs = spark.range(0, 40, 1, 4).selectExpr("id doc_id", "repeat(concat(char(cast(97 + id % 26 as int)), ' '), 500000) text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run(docs).count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
