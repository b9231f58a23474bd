"""Substring dedup: remove every word in a window of words that occurs more than once in the corpus.

Rabin-Karp fingerprints of all windows of window_words words go to exchange.repeated(), which finds those that occur twice, by two independent fingerprints; the
places of repeated windows merge into maximal removal intervals.

Nulls and texts without a word have no window. Rows that are repeated whole, with or without doc_id, count as occurrences of each other. Other columns are left
alone, whatever their names: documents travel as rows within groups. Very long texts are handled in one piece by one task. Ties don't arise: all occurrences go. An
empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import bytescan, exchange
from strandline.llm.storage import discard

WINDOW_WORDS = 35
#: Windows are counted in so many rounds, each with a share of the buckets, so that one round's windows are on disk at a time.
ROUNDS = 2


def _windows(part: bytescan.Texts, size: int):
    """The words of a slice, the first word of each window, fingerprints and checks of the windows."""
    found = bytescan.words(part, bytescan.WHITE)
    at, _ = bytescan.windows(found, size)
    if not len(at):
        return found, at, np.empty(0, np.uint64), np.empty(0, np.uint32)
    hashes = bytescan.window_hashes(found, at, size)
    other = bytescan.span_hash(bytescan.rolling_prefix(bytescan.BYTE_VALUES[part.data], 1), found.starts, found.ends, 1)
    checks = bytescan.span_hash(bytescan.rolling_prefix(other, 1), at, at + size, 1)
    return found, at, hashes, checks.astype(np.uint32)


def _strings(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [_windows(part, size)[2:] for part in bytescan.texts(texts)]
    return np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)]), np.concatenate([np.empty(0, np.uint32), *(p[1] for p in parts)])


def _marked(texts: pa.Array, numbers, size: int):
    """For slices of a group's texts: the texts, their words, and which words go."""
    twice, so_far = exchange.Distinct(*_strings(texts, size)).twice(exchange.answers(numbers)), 0
    for part in bytescan.texts(texts):
        found = bytescan.words(part, bytescan.WHITE)
        at, _ = bytescan.windows(found, size)
        yield part, found, bytescan.covered(len(found.starts), at[twice[so_far : so_far + len(at)]], size)
        so_far += len(at)


def _groups(batches):
    """(documents, numbers) of each group."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield exchange.rows_of(batch, k), batch.column("numbers")[k].as_py()


def _digest(batches, size: int):
    for rows, numbers in _groups(batches):
        n_words, n_removed, digests = [], [], []
        for part, found, gone in _marked(rows.field("text"), numbers, size):
            first = found.first
            before = np.concatenate(([0], np.cumsum(gone)))
            removed = before[first[1:]] - before[first[:-1]]
            n_words.append(np.diff(first))
            n_removed.append(removed)
            for k in range(len(part)):
                kept = part.bytes_of(k).split()
                if removed[k]:
                    kept = [w for w, g in zip(kept, gone[first[k] : first[k + 1]].tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches, size: int):
    for rows, numbers in _groups(batches):
        out = []
        for part, found, gone in _marked(rows.field("text"), numbers, size):
            for k in range(len(part)):
                low, high = found.first[k], found.first[k + 1]
                if gone[low:high].any():
                    keep = np.ones(part.ends[k] - part.starts[k], bool)
                    stops = np.append(found.starts[low + 1 : high], part.ends[k])  # a removed word takes the blanks behind it along
                    cut = np.flatnonzero(gone[low:high])
                    keep[bytescan.ragged(found.starts[low:high][cut] - part.starts[k], (stops - found.starts[low:high])[cut])] = False
                    out.append(part.data[part.starts[k] : part.ends[k]][keep].tobytes().decode())
                else:
                    out.append(None)
        text = rows.field("text").to_pylist()
        fresh = pa.array([t if o is None else o for t, o in zip(text, out, strict=True)], pa.string())
        names = [f.name for f in rows.type]
        yield pa.RecordBatch.from_arrays([fresh if n == "text" else rows.field(k) for k, n in enumerate(names)], names)


def _made(docs: DataFrame, size: int, bucket_bytes: int, make, schema, label: str) -> DataFrame:
    """What make gives of the groups of documents with the numbers of their repeated windows, in the shared folder: a lazy result would run with batches of any size."""
    total = exchange.text_bytes(docs)
    groups = exchange.packed(docs)
    found = [exchange.repeated(groups, partial(_strings, size=size), total, share=(k, ROUNDS), bucket_bytes=bucket_bytes) for k in range(ROUNDS)]
    out = exchange.in_small_batches(exchange.answered(groups, found, total).mapInArrow(partial(make, size=size), schema), label)
    discard(groups, *found)
    return out


def removals(docs: DataFrame, window_words: int = WINDOW_WORDS, bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _made(docs.select("doc_id", "text"), window_words, bucket_bytes, _digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", "digests")


def remove_repeats(docs: DataFrame, window_words: int = WINDOW_WORDS, bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """docs with the removed words cut out of text, each with the blanks behind it; texts that lose nothing stay as they are, byte for byte.
    A text all of whose words go becomes empty. All columns of docs are returned in their order."""
    return _made(docs, window_words, bucket_bytes, _rewrite, docs.schema, "rewritten")


def query(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
