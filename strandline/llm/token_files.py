"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a Parquet container of blocks. A block holds consecutive documents of one shard: their ids, replaced by frequency ranks (0 is the most
frequent id of the corpus), take one to four bytes each; the lengths stand apart in control bytes, two bits an id, four ids a byte. Decoding looks
each control byte up in a table of lengths and gathers the bytes of all ids at once. Shards follow each other in ascending doc_id order, blocks and
documents within them likewise, and a block knows how many ids its shard has before it. The container is written by Spark's committer, so a lost executor
leaves no half-written part, and any store that Spark reads will do.

The tokenizer is the tokenizers library. Pre-tokens are found by pretokens.py and each distinct one is encoded by the library once for a worker's bounded
memo; texts with a special token's string are given to the library whole. A null text counts as empty and has the end id only. Null ids come first;
documents with equal doc_id come in no certain order. An empty table gives an empty file set. Other columns don't matter.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import bytescan, pretokens
from strandline.llm.storage import discard, materialize, shared_folder

END_ID = 2
BLOCK_IDS = 1 << 18
#: Ids that one sorting task holds.
SHARD_IDS = 8_000_000
#: So many shards' offsets, of twelve bytes each, are sent to all tasks at most.
BROADCAST_SHARDS = 100_000
FILE_SCHEMA = "shard int, block int, ids_before long, n_ids long, doc_ids array<{kind}>, doc_counts binary, control binary, data binary"

#: The printable character that byte-level vocabularies write for each byte; line feeds, which pre-tokens don't have, stay.
LETTERS = {b: c for c, b in pretokens.byte_letters().items() if b != 0x0A}
#: Lengths of the four ids of a control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of values below 2**32."""
    values = values.astype("<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    padded[: len(size)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Tokenizer:
    """Encodes batches as the library does; one for each Python worker."""

    def __init__(self, rules: pretokens.WordRules):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        from tokenizers import pre_tokenizers

        self.library, self.classes, self.normalize = Library.from_str(rules.content), rules.classes, rules.normalizer()
        suffix = json.loads(rules.content)["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        self.ends_word[[k for token, k in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.words = Library(self.library.model)  # for text that is normalized, split and in byte letters
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = pretokens.Memo()
        self._clear()

    def _clear(self):
        self.memo.slots.clear()
        self.flat, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[bytes]):
        """Add the ids of pre-tokens: the library gets them as one text with line feeds between, and a token that ends a word ends its ids."""
        text = b"\n".join(words).decode("latin-1").translate(LETTERS)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a pre-token has no token that ends a word")
        counts = np.diff(stops, prepend=0)
        self.starts = np.concatenate((self.starts, len(self.flat) + stops - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        plain = [self.normalize(t.decode()).encode() for t in texts]
        odd = {k for k, t in enumerate(texts) if b"<|" in t and any(s.encode() in t for s in self.specials)}
        pieces = pretokens.split([b"" if k in odd else t for k, t in enumerate(plain)], glue_blanks=False, table=self.classes)
        hashes, at, number = pieces.unique()
        if len(self.counts) > self.memo.most:
            self._clear()
        slots, new = self.memo.find(hashes)
        if len(new):
            base = len(self.counts)
            raw = pieces.data.tobytes()
            self._learn([raw[s:e] for s, e in zip(pieces.starts[at[new]].tolist(), pieces.ends[at[new]].tolist(), strict=True)])
            slots[new] = base + np.arange(len(new))
            self.memo.slots.update(zip(hashes[new].tolist(), range(base, base + len(new)), strict=True))
        own = slots[number]
        counts = self.counts[own]
        ids = self.flat[bytescan.ragged(self.starts[own], counts)]
        edges = np.concatenate(([0], np.cumsum(counts)))[pieces.first]
        if not odd:
            return ids, np.diff(edges)
        lists = [np.array(self.library.encode(texts[k].decode(), add_special_tokens=False).ids, np.uint32) if k in odd else ids[edges[k] : edges[k + 1]] for k in range(len(texts))]
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))


_TOKENIZERS: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    key = hash(shared.value.content)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(shared.value)
    return _TOKENIZERS[key]


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of counts numbers each."""
    offsets = np.concatenate(([0], np.cumsum(counts * flat.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _tokenize(batches, shared, end_id):
    for batch in batches:
        tokenizer = _tokenizer(shared)
        for part in bytescan.texts(batch.column(1)):
            ids, counts = tokenizer.encode([part.bytes_of(k) for k in range(len(part))])
            ids = np.insert(ids, np.cumsum(counts), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows.start, len(part)), _binary(ids.astype("<u4" if ids.max() > 0xFFFF else "<u2"), counts + 1), pa.array(np.full(len(part), 4 if ids.max() > 0xFFFF else 2, np.int8))], ["doc_id", "ids", "width"])


def _numbers(batch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), f"<u{w}").astype(np.uint32) for x, w in zip(batch.column(name), batch.column("width").to_pylist(), strict=True)]


def _frequencies(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = np.bincount(np.concatenate(_numbers(batch.slice(k, 512), "ids")))
            if len(part) > len(total):
                part[: len(total)] += total
                total = part
            else:
                total[: len(part)] += part
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _blocks(batches, shared):
    rank = shared.value
    shard, block, before = TaskContext.get().partitionId(), 0, 0
    held, names = [], []

    def flush():
        nonlocal block, before, held, names
        control, data = pack(rank[np.concatenate(held)])
        counts = np.fromiter(map(len, held), "<u4", len(held))
        out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([int(counts.sum())]), pa.array([[n.as_py() for n in names]], pa.list_(names[0].type)), pa.array([counts.tobytes()]), pa.array([control]), pa.array([data])], ["shard", "block", "ids_before", "n_ids", "doc_ids", "doc_counts", "control", "data"])
        block, before, held, names = block + 1, before + int(counts.sum()), [], []
        return out

    size = 0
    for batch in batches:
        for name, ids in zip(batch.column("doc_id"), _numbers(batch, "ids"), strict=True):
            held.append(ids)
            names.append(name)
            size += len(ids)
            if size >= BLOCK_IDS:
                yield flush()
                size = 0
    if held:
        yield flush()


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID) -> np.ndarray:
    """Write the file set of documents (doc_id, text) to path. Returns the id of each frequency rank, which readers need (ranks() has it from a file set)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pretokens.WordRules.read(tokenizer_file))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialize(docs.select("doc_id", "text").mapInArrow(lambda b: _tokenize(b, shared, end_id), f"doc_id {kind}, ids binary, width tinyint"), "token-ids")
    counted = tokens.select("ids", "width").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    by_rank = np.array([r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))], np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in counted) // SHARD_IDS))
    ordered = tokens.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(lambda b: _blocks(b, ranks), FILE_SCHEMA.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    discard(tokens)
    return by_rank


def ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each frequency rank, at most a row for each id of the vocabulary."""
    return np.array([r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)


def _documents(batches, shared):
    by_rank = shared.value
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["doc_counts"], "<u4").astype(np.int64)
            ids = by_rank[unpack(row["control"], row["data"], int(counts.sum()))]
            ends = np.cumsum(counts)
            starts = row["base"] + row["ids_before"] + ends - counts
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(starts), _binary(ids.astype("<u4"), counts)], ["doc_id", "start", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit integers) of a file set."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # A row for each shard of SHARD_IDS ids: the ids of all shards before it. Shards are numbered in the order of doc_id.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    if (blocks.agg(F.max("shard")).first()[0] or 0) < BROADCAST_SHARDS:
        bases = F.broadcast(bases)  # else the blocks are shuffled to them
    shared = spark.sparkContext.broadcast(ranks(spark, path))
    return blocks.join(bases, "shard").mapInArrow(lambda b: _documents(b, shared), f"doc_id {kind}, start long, ids binary")


def _checks(batches):
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark)}/strandline/token-files-{uuid.uuid4().hex}"
    write(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    found = read(spark, path)
    return found.mapInArrow(_checks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
