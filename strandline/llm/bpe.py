"""Byte-level BPE encoding and decoding with two tiers.

First tier: a minimal perfect hash over the vocabulary (bucketed displacements, buckets of one key placed directly) resolves pre-tokens that are
vocabulary entries as a whole; the found entry's fingerprint and bytes are compared. Second tier: a heap of merge ranks over linked bytes, lowest rank
first and leftmost among equals. Pre-tokens are resolved once for each batch and remembered in a bounded memo.

The ranks come from a file whose path is a parameter; it is read once by the driver and broadcast (its size is that of the vocabulary). A null text counts as
empty and has no ids. Very long texts and pre-tokens are encoded whole. Repeated rows are answered each for itself; an empty table gives none; other columns
don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import bytescan, pretokens


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths) - lengths
    return bytescan.span_hash(bytescan.rolling_prefix(bytescan.BYTE_VALUES[data]), starts, starts + lengths)


@dataclass
class PerfectHash:
    """A minimal perfect hash: displacement of each bucket (or, below zero, the slot of its only key), and the key in each slot."""

    displacement: np.ndarray
    keys: np.ndarray

    @staticmethod
    def _slots(hashes, displacement, n):
        return bytescan.mix(hashes + np.asarray(displacement).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(n)

    @classmethod
    def of(cls, hashes: np.ndarray, load: int = 4) -> PerfectHash:
        n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("two tokens have the same fingerprint")
        count = max(1, n // load)
        bucket = (hashes % np.uint64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(count + 1))
        displacement, taken = np.zeros(count, np.int64), np.full(n, -1, np.int64)
        sizes = np.diff(edges)
        tries = np.arange(256)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = cls._slots(hashes[own][None, :], (tries + base)[:, None], n).astype(np.int64)
                good = (taken[slots] < 0).all(axis=1)
                ranked = np.sort(slots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    displacement[b], taken[slots[k]] = base + k, own
                    break
                base += len(tries)
        free = iter(np.flatnonzero(taken < 0).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            displacement[b], taken[slot] = -slot - 1, order[edges[b]]
        return cls(displacement, taken)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The only key that each hash can be."""
        d = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)]
        slots = self._slots(hashes, np.maximum(d, 0), len(self.keys)).astype(np.int64)
        return self.keys[np.where(d < 0, -d - 1, slots)]


class Vocabulary:
    """Tokens by id, with what encoding and decoding look up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.classes = ranks, pretokens.rank_classes()
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        self.hashes = hash_tokens(tokens)
        self.perfect = PerfectHash.of(self.hashes)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        size = int(self.ids.max()) + 1
        self.lengths, self.starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.lengths[self.ids] = lengths
        self.starts[self.ids] = np.cumsum(lengths) - lengths

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pre-tokens (by fingerprint) that are tokens, else -1."""
        key = self.perfect.find(hashes)
        return np.where(self.hashes[key] == hashes, self.ids[key], -1)

    def token(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: merges by a heap over linked bytes."""
        n, ranks = len(piece), self.ranks
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            if not alive[k]:
                continue
            m = nxt[k]
            if m >= n or nxt[m] != end:
                continue
            alive[m] = False
            nxt[k] = end
            if end < n:
                prev[end] = k
                if (r := ranks.get(piece[k : nxt[end]])) is not None:
                    heapq.heappush(heap, (r, k, nxt[end]))
            if (p := prev[k]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : nxt[k]]])
            k = nxt[k]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[bytescan.ragged(self.starts[ids], self.lengths[ids])]


class Encoder:
    """Encodes batches; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, pretokens.Memo()
        self._clear()

    def _clear(self):
        self.memo.slots.clear()
        self.texts: list[bytes] = []
        self.flat, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: pretokens.Pieces, hashes: np.ndarray, at: np.ndarray):
        whole = self.vocabulary.whole(hashes)
        lists = []
        raw = pieces.data
        for k, s, e in zip(whole.tolist(), pieces.starts[at].tolist(), pieces.ends[at].tolist(), strict=True):
            piece = raw[s:e].tobytes()
            lists.append([k] if k >= 0 and self.vocabulary.token(k) == piece else self.vocabulary.merge(piece))
        base = len(self.texts)
        self.memo.slots.update(zip(hashes.tolist(), range(base, base + len(lists)), strict=True))
        self.texts += [b",".join(b"%d" % i for i in x) for x in lists]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))))

    def encode(self, texts: list[bytes]):
        """The ids of all texts in turn, how many each has, and for each text its ids as decimal numbers joined by commas."""
        pieces = pretokens.split(texts, glue_blanks=True, table=self.vocabulary.classes)
        hashes, at, number = pieces.unique()
        if len(self.texts) > self.memo.most:
            self._clear()
        slots, new = self.memo.find(hashes)
        if len(new):
            slots[new] = len(self.texts) + np.arange(len(new))
            self._learn(pieces, hashes[new], at[new])
        own = slots[number]
        counts = self.counts[own]
        ids = self.flat[bytescan.ragged(self.starts[own], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))[pieces.first]
        known, plain = self.texts, own.tolist()
        joined = [b",".join([known[s] for s in plain[a:b]]) for a, b in zip(pieces.first[:-1].tolist(), pieces.first[1:].tolist(), strict=True)]
        return ids, np.diff(total), joined


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _round_trip(batches, shared):
    for batch in batches:
        encoder = _encoder(shared)
        n_tokens, digests, decoded = [], [], []
        for part in bytescan.texts(batch.column(1)):
            ids, counts, joined = encoder.encode([part.bytes_of(k) for k in range(len(part))])
            n_tokens.append(counts)
            digests += [hashlib.sha256(x).hexdigest() for x in joined]
            back = encoder.vocabulary.decode(ids)
            sizes = np.concatenate(([0], np.cumsum(encoder.vocabulary.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
            decoded += [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
        if n_tokens:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_tokens)), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches, shared):
    for batch in batches:
        encoder = _encoder(shared)
        parts = [encoder.encode([part.bytes_of(k) for k in range(len(part))])[:2] for part in bytescan.texts(batch.column(1))]
        for lengths in [np.concatenate([c for _, c in parts])] if parts else []:
            values = np.concatenate([i for i, _ in parts]).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(read_ranks(path))
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Of documents (doc_id, text): doc_id and ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    return docs.select("doc_id", "text").mapInArrow(lambda b: _ids(b, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes the ids give back)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _round_trip(b, shared), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
