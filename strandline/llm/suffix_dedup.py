"""Suffix-array dedup: remove every byte of a repeated 400-byte string.

Suffixes are ordered by their first span bytes only, blockwise, with a difference cover D of period v: any two places have an offset below v at which both
fall on a cover sample (a place of a document whose number modulo v is in D).

1. Cover samples are ranked by the span - v + 1 bytes from there, one bucket at a time; only whether a rank is shared is kept.
2. A repeated string holds a cover sample of shared rank within its first v bytes, wherever it stands; all other suffixes are out without being sorted. The
   remaining suffixes are the long ties. They are dealt into buckets, in rounds, and sorted one bucket at a time; neighbours that agree in span bytes are
   repeated.
3. The repeated strings of a document unite into maximal runs, which are removed.

Orders come from 96-bit fingerprints of the strings, not from comparing bytes: equality is all that a fixed length needs, and blocks by leading bytes can't be
bounded when a passage stands in a third of all documents (README). exchange.py says how strings are exchanged and what it holds in memory.

A null text counts as empty. Texts below span bytes keep all. Rows that are repeated whole, with or without doc_id, count as occurrences of each other. Very long
texts are handled in one piece by one task. Other columns don't matter. Ties don't arise: all occurrences go. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bytescan, exchange
from strandline.llm.storage import discard

SPAN, PERIOD = 400, 256
#: Suffixes are sorted in so many rounds, each with a share of the buckets, so that one round's suffixes are on disk at a time.
ROUNDS = 3


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues whose differences give every number modulo v. Greedy: each step adds the residue with most new differences."""
    cover, have = [0], np.zeros(v, bool)
    have[0] = True
    while not have.all():
        best, gain = 0, -1
        for x in range(v):
            both = np.array([(x - y) % v for y in cover] + [(y - x) % v for y in cover])
            new = len(np.unique(both[~have[both]]))
            if new > gain:
                best, gain = x, new
        both = np.array([(best - y) % v for y in cover] + [(y - best) % v for y in cover])
        have[both] = True
        cover.append(best)
    return tuple(sorted(cover))


class _Prints:
    """Fingerprints of strings of a slice: two families, the second over runs of eight bytes."""

    def __init__(self, part: bytescan.Texts):
        self.first = bytescan.rolling_prefix(bytescan.BYTE_VALUES[part.data])
        self.second = bytescan.rolling_prefix(bytescan.gram_values(part.data), 1)

    def of(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        grams = max(size - 7, 1)
        return bytescan.span_hash(self.first, at, at + size), bytescan.span_hash(self.second, at, at + grams, 1).astype(np.uint32)


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint64), *(p[0] for p in pairs)]), np.concatenate([np.empty(0, np.uint32), *(p[1] for p in pairs)])


def _samples(part: bytescan.Texts, span: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover samples with room for a ranked string, and the text of each."""
    size, cover = span - period + 1, np.array(difference_cover(period))
    lengths = part.ends - part.starts
    blocks = np.maximum(lengths - size + period, 0) // period
    grid = (bytescan.ragged(np.zeros(len(blocks), np.int64), blocks)[:, None] * period + cover[None, :]).ravel()
    doc = np.repeat(np.arange(len(blocks)), blocks * len(cover))
    fits = grid + size <= lengths[doc]
    grid, doc = grid[fits], doc[fits]
    return grid + part.starts[doc], doc


def _ranks(texts: pa.Array, span: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group: fingerprints of what ranks its cover samples."""
    return _joined([_Prints(part).of(_samples(part, span, period)[0], span - period + 1) for part in bytescan.texts(texts)])


def _tied(batches, span: int, period: int):
    """Groups with a bit for each byte of their texts: whether the suffix that begins there has a cover sample of shared rank in its first period bytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            texts = exchange.rows_of(batch, k).field("text")
            shared, so_far, bits = exchange.Distinct(*_ranks(texts, span, period)).twice(exchange.answers(batch.column("numbers")[k].as_py())), 0, []
            for part in bytescan.texts(texts):
                at, doc = _samples(part, span, period)
                own = shared[so_far : so_far + len(at)]
                so_far += len(at)
                x, doc = at[own], doc[own]
                low, high = np.maximum(x - period + 1, part.starts[doc]), np.minimum(x, part.ends[doc] - span) + 1
                room = high > low
                edge = np.zeros(len(part.data) + 1, np.int64)
                np.add.at(edge, low[room], 1)
                np.add.at(edge, high[room], -1)
                bits.append(np.cumsum(edge[:-1]) > 0)
            ties = np.packbits(np.concatenate([np.empty(0, bool), *bits]))
            yield pa.RecordBatch.from_arrays([batch.column("grp").slice(k, 1), batch.column("rows").slice(k, 1), pa.array([ties.tobytes() if ties.any() else None], pa.binary())], ["grp", "rows", "ties"])


def _tie_places(texts: pa.Array, ties: bytes | None):
    """For slices of a group's texts: the slice, and the suffixes (by place in it) that are tied."""
    bits, so_far = np.unpackbits(np.frombuffer(ties or b"", np.uint8)).view(bool), 0
    for part in bytescan.texts(texts):
        yield part, np.flatnonzero(bits[so_far : so_far + len(part.data)]) if ties else np.empty(0, np.int64)
        so_far += len(part.data)


def _strings(texts: pa.Array, ties: bytes | None, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group: fingerprints of the strings at tied suffixes."""
    return _joined([_Prints(part).of(at, span) for part, at in _tie_places(texts, ties) if len(at)])


def _digest(batches, span: int):
    for batch in batches:
        for g in range(batch.num_rows):
            docs, ties = exchange.rows_of(batch, g), batch.column("ties")[g].as_py()
            repeated, so_far, rows = None, 0, []
            if ties:
                repeated = exchange.Distinct(*_strings(docs.field("text"), ties, span)).twice(exchange.answers(batch.column("numbers")[g].as_py()))
            for part, at in _tie_places(docs.field("text"), ties):
                gone = bytescan.covered(len(part.data), at[repeated[so_far : so_far + len(at)]], span) if len(at) else np.zeros(len(part.data), bool)
                so_far += len(at)
                for a, b in zip(part.starts.tolist(), part.ends.tolist(), strict=True):
                    own, lost = part.data[a:b], gone[a:b]
                    removed = int(lost.sum())
                    spans = int((lost[1:] & ~lost[:-1]).sum()) + int(lost[0]) if removed else 0
                    rows.append((b - a, removed, spans, hashlib.sha256(own[~lost] if removed else own).hexdigest()))
            yield pa.RecordBatch.from_arrays([docs.field("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame, span: int = SPAN, period: int = PERIOD, rounds: int = ROUNDS, bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256. period must not exceed span."""
    docs = docs.select("doc_id", "text")
    total = exchange.text_bytes(docs)
    groups = exchange.packed(docs)
    shared = exchange.repeated(groups, partial(_ranks, span=span, period=period), total, bucket_bytes=bucket_bytes)
    marked = exchange.answered(groups, [shared], total).mapInArrow(partial(_tied, span=span, period=period), groups.withColumn("ties", F.lit(None).cast("binary")).schema)
    tied = exchange.in_small_batches(marked, "tied-suffixes")
    discard(groups, shared)
    twice = [exchange.repeated(tied.where("ties is not null"), partial(_strings, span=span), total, ["ties"], (k, rounds), bucket_bytes) for k in range(rounds)]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = exchange.in_small_batches(exchange.answered(tied, twice, total).mapInArrow(partial(_digest, span=span), schema), "digests")  # a lazy result would run with batches of any size
    discard(tied, *twice)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
