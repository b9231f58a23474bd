"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into five consecutive segments, a ring. If two fingerprints differ in at most four bits, some segment starts a chain in which
the first l segments differ in at most floor(l * 4 / 5) bits together, for l = 1 to 5: none in the first, one at most in the first two. So the first
segment agrees, and of the two halves of the second at least one. Ten keys of a distinct fingerprint (segment, half) therefore bring every linked
pair into a common bucket; there the chain's remaining budgets prune candidates before the full Hamming count.

Copies are collapsed to distinct fingerprints before any key is made. A bucket of more than bucket_limit distinct fingerprints is keyed again by five
pieces of the bits that its key leaves open, one of which must agree, as often as it takes; a bucket thus has a bound without a candidate being
lost. Within a bucket only links that join two parts are returned, so a group of n gives n - 1 links at most. Parts are joined over the corpus by
alternating large-star and small-star steps on tables in the shared folder.

Texts that are null or without words have fingerprint zero and link like any other. Rows with a null doc_id take part; a component of such rows alone
has a null component_id. Repeated rows come back repeated. Very long texts are hashed whole. Other columns don't matter to near_duplicates(); keep_one() returns them
all. Ties: among equally near texts all are linked, and the smallest doc_id names the component. An empty table gives none.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bytescan
from strandline.llm.storage import discard, materialize

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
BUCKET_LIMIT = 8192
#: Rows that one linking task holds.
TASK_ROWS = 500_000
#: Parts into which the rows of one node or component are dealt when they meet a row about it.
SALTS = 16


def _shingles(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # bytes.lower() and split() know ASCII only: A-Z, \x20 and \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its hashes, which stand in text order."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.uint32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(batches, size: int):
    for batch in batches:
        out = []
        for part in bytescan.texts(batch.column(1)):
            lists = [_shingles(part.bytes_of(k), size) for k in range(len(part))]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            out.append(_majority(np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum())), counts))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, size=shingle_words), f"doc_id {kind}, fp long")


def _mask(low: int, high: int) -> int:
    return ((1 << (high - low)) - 1) << low


def _pieces(open_bits: int, n: int) -> list[int]:
    """n masks that share out the set bits of open_bits in order."""
    places = [k for k in range(64) if open_bits >> k & 1]
    return [reduce(lambda m, k: m | 1 << k, part.tolist(), 0) for part in np.array_split(np.array(places, int), n)]


KEY_SCHEMA = "key long, segment int, open_bits long, fp long"


def _key_rows(seed: np.ndarray | int, tag: int, fp: np.ndarray, mask: int, segment, left: np.ndarray | int):
    bits = fp & np.uint64(mask)
    key = bytescan.mix(bytescan.mix(bits + np.uint64(tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) ^ seed)
    n = len(fp)
    return [key.view(np.int64), np.broadcast_to(np.asarray(segment, np.int32), n), np.broadcast_to(np.asarray(left, np.uint64), n).view(np.int64) if np.ndim(left) else np.full(n, np.uint64(left).view(np.int64)), fp.view(np.int64)]


def _ring_keys(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for s, span in enumerate(SEGMENTS):
            first = _mask(*span)
            for h, half in enumerate(_pieces(_mask(*SEGMENTS[(s + 1) % 5]), 2)):
                rows = _key_rows(np.uint64(0), 2 * s + h + 1, fp, first | half, s, ~(first | half) & (1 << 64) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows], ["key", "segment", "open_bits", "fp"])


def _finer_keys(batches):
    """Rows of a large bucket, keyed by each of five pieces of the open bits as well."""
    for batch in batches:
        key, segment, left, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        for bits in np.unique(left):
            own = left == bits
            for j, mask in enumerate(_pieces(int(np.int64(bits).view(np.uint64)), MAX_BITS + 1)):
                rest = np.uint64(int(np.int64(bits).view(np.uint64)) & ~mask)
                rows = _key_rows(key[own].view(np.uint64), 100 + j, fp[own].view(np.uint64), mask, segment[own], rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows], ["key", "segment", "open_bits", "fp"])


def _chained(x: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which differences x keep every budget of the chain that starts at segment, and so the full one."""
    masks = np.array([_mask(*s) for s in SEGMENTS], np.uint64)
    alive = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for length in range(1, 6):
        total = total + np.bitwise_count(x[alive] & masks[(segment[alive] + length - 1) % 5])
        good = total <= length * MAX_BITS // 5
        alive, total = alive[good], total[good]
    return alive


def _links(batches):
    """Of a partition's buckets, links that join its fingerprints as all links within four bits would."""
    parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3)] for batch in batches]
    if not parts:
        return
    key, segment, fp = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((fp, key))
    key, segment, fp = key[order], segment[order], fp[order].view(np.uint64)
    label = np.arange(len(key))
    edges: list[tuple[int, int]] = []

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        i = at[label[at] != label[at + step]]
        good = i[_chained(fp[i] ^ fp[i + step], segment[i])]
        for a in good.tolist():
            x, y = root(a), root(a + step)
            if x != y:
                label[max(x, y)] = min(x, y)
                edges.append((a, a + step))
        if len(good):
            while (deeper := label[label] != label).any():
                label[deeper] = label[label[deeper]]
        step += 1
    if edges:
        a, b = np.array(edges).T
        yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def links(distinct: DataFrame, n: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that leave the same parts as all pairs within four bits."""
    spark = distinct.sparkSession
    rows, found, times = distinct.select("fp").mapInArrow(_ring_keys, KEY_SCHEMA), [], 10
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * times // TASK_ROWS))
    while True:
        large = materialize(rows.groupBy("key").count().where(F.col("count") > bucket_limit).select("key"), "large-buckets")
        more = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if more else rows
        found.append(materialize(small.repartition(tasks, "key").mapInArrow(_links, "a long, b long"), "links"))
        if not more:
            break
        rows = materialize(rows.join(large, "key", "left_semi").select("key", "segment", "open_bits", "fp").mapInArrow(_finer_keys, KEY_SCHEMA), "finer-keys")
    return reduce(DataFrame.union, found)


def _told(rows: DataFrame, about: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with about, a row for each key. The rows of a key are dealt over SALTS partitions by the hash of another column, so none gets too many."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int").alias("_salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return rows.select("*", salt).join(about.select("*", each), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b); root is the smallest node that can be reached."""
    spark = edges.sparkSession
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(e)
    while before[0]:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _told(both.where("v > u"), least, "u", "v").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _told(large, low, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        fresh = materialize(small.where("a <> b").distinct(), "edges")
        after = mark(fresh)
        discard(e)
        e = fresh
        if tuple(after) == tuple(before):
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct()) if before[0] else spark.createDataFrame([], "node long, root long")


def _parts(docs: DataFrame, shingle_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, text): fingerprints (doc_id, fp), distinct ones with the smallest doc_id of each (fp, least_id), and of those that are linked to others
    the component's smallest (fp, component_id)."""
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(links(nodes, nodes.count())).select(F.col("node").alias("fp"), "root")
    linked = materialize(nodes.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps, nodes, materialize(_told(linked, least, "root", "fp").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Of documents (doc_id, text): doc_id, fingerprint (hex), component_id."""
    fps, nodes, linked = _parts(docs, shingle_words)
    # A component of rows without doc_id alone has no id; so it matters whether a fingerprint is linked, not whether it has an id.
    named = nodes.join(linked.withColumn("_linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that with the smallest doc_id (nulls last), and of those that share it the one whose text has
    the smallest digest. Rows of different components stay even if they share a doc_id, or have none."""
    # As this orders rows and tells texts apart, the smallest of a component is in no other one.
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"))
    marked = docs.select(F.struct("*").alias("doc"), row.alias("row"))  # so that columns of docs may have any name
    _, nodes, linked = _parts(marked.select(F.col("row").alias("doc_id"), "doc.text"), shingle_words)
    alone = nodes.join(linked, "fp", "left_anti").select(F.col("least_id").alias("row"))
    kept = marked.join(alone.union(linked.select("component_id").distinct()), "row", "left_semi")
    # By id and digest, not by row: the exchange this asks for sends one row a task of many equal ones, and lets Spark split a join partition that they fill.
    return kept.select("doc", F.col("row.id").alias("id"), F.col("row.digest").alias("digest")).dropDuplicates(["id", "digest"]).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
