"""Quality rules with suffix-array repetition.

Counts of words, characters, symbols and repeated lines and 5-word windows are the base. On top, a suffix array over the words of each document (prefix
doubling; all documents of a slice share one array, since words of different documents count as different) and its longest common prefixes give the
maximal repeated substrings: the longest LCP interval that holds a suffix has the larger of the suffix's two neighbouring prefixes as its length.
Repeats of at least min_repeat words are united into spans. A document is rejected if they cover more than covered_limit of its words or the longest has
more than longest_limit words, and if the base rules reject it. Only documents with a repeated window of min_repeat words, but five at most,
enter the array: the others have no repeat that counts.

A null text has no words and fails the base rules; so does an empty one. Very long texts are handled in one piece. Repeated rows are judged each for
itself, an empty table gives none, and other columns don't matter.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import bytescan

SYMBOLS = b"#*$%&|<>"
BASE_WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
MIN_REPEAT, COVERED_LIMIT, LONGEST_LIMIT = 5, 0.15, 100

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, repeat_fraction double, base_failed boolean, kept boolean"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the suffixes, and the ranks of their prefixes of 1, 2, 4, ... symbols."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    levels, length = [rank.astype(np.int64)], 1
    order = np.argsort(rank, kind="stable")
    while length < n and levels[-1].max(initial=0) < n - 1:
        rank = levels[-1]
        behind = np.zeros(n, np.int64)
        behind[:-length] = rank[length:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = pair[order[1:]] != pair[order[:-1]]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(step)
        levels.append(fresh)
        length *= 2
    return order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix of order shares with the next one."""
    n = len(order)
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        shared[same] += 1 << k
    return np.minimum(shared, n - np.maximum(a, b))


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from it that starts elsewhere too."""
    out = np.zeros(len(symbols), np.int64)
    if len(symbols) > 1:
        order, levels = suffix_array(symbols)
        shared = neighbour_prefixes(order, levels)
        out[order[:-1]] = shared
        out[order[1:]] = np.maximum(out[order[1:]], shared)
    return out


def _salted(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return bytescan.mix(values + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _repeated(found: bytescan.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of windows of size words that occur more than once in their text, and those texts."""
    at, counts = bytescan.windows(found, size)
    text = np.repeat(np.arange(len(counts)), counts)
    value = _salted(bytescan.window_hashes(found, at, size), text)
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return at[twice], np.unique(text[twice])


def measure(part: bytescan.Texts, min_repeat: int, covered_limit: float, longest_limit: int) -> list[np.ndarray]:
    found = bytescan.words(part, bytescan.WHITE)
    n_words, first = found.counts(), found.first
    edges = np.append(part.starts, len(part.data))
    word_chars = _sum_by(~bytescan.WHITE[part.data] & ((part.data & 0xC0) != 0x80), edges)
    n_symbols = _sum_by(_IS_SYMBOL[part.data], edges)
    dup_lines = np.zeros(len(part), np.int64)
    for k in range(len(part)):
        lines = [x for x in part.bytes_of(k).split(b"\n") if x and not x.isspace()]
        dup_lines[k] = len(lines) - len(set(lines))
    at, busy = _repeated(found, BASE_WINDOW)
    n_repeat = _sum_by(bytescan.covered(len(found.starts), at, BASE_WINDOW), first)
    longest, fraction = np.zeros(len(part), np.int64), np.zeros(len(part))
    if min_repeat < BASE_WINDOW:
        _, busy = _repeated(found, max(1, min_repeat))
    if len(busy):
        pick = bytescan.ragged(first[busy], n_words[busy])
        owner = np.repeat(np.arange(len(busy)), n_words[busy])
        runs = longest_repeats(_salted(found.hashes[pick], owner))
        runs[runs < min_repeat] = 0
        own = np.concatenate(([0], np.cumsum(n_words[busy])))
        begin = np.flatnonzero(runs)
        edge = np.zeros(len(runs) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + runs[begin], -1)
        fraction[busy] = _sum_by(np.cumsum(edge[:-1]) > 0, own) / n_words[busy]
        longest[busy] = np.maximum.reduceat(runs, own[:-1])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    kept = ~failed & (fraction <= covered_limit) & (longest <= longest_limit)
    return [n_words, word_chars, n_symbols, dup_lines, n_repeat, longest, fraction, failed, kept]


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _assess(batches, **limits):
    for batch in batches:
        parts = [measure(part, **limits) for part in bytescan.texts(batch.column("text"))]
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], ["doc_id", *_NAMES])


def _filter(batches, **limits):
    for batch in batches:
        parts = [measure(part, **limits)[-1] for part in bytescan.texts(batch.column("text"))]
        if parts:
            yield batch.filter(pa.array(np.concatenate(parts)))


def _limits(min_repeat, covered_limit, longest_limit):
    return {"min_repeat": min_repeat, "covered_limit": covered_limit, "longest_limit": longest_limit}


def assess(docs: DataFrame, min_repeat: int = MIN_REPEAT, covered_limit: float = COVERED_LIMIT, longest_limit: int = LONGEST_LIMIT) -> DataFrame:
    """Of documents (doc_id, text): doc_id, the base counts, longest_repeat (words), repeat_fraction, base_failed, kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_assess, **_limits(min_repeat, covered_limit, longest_limit)), f"doc_id {kind}, {_SCHEMA}")


def keep_good(docs: DataFrame, min_repeat: int = MIN_REPEAT, covered_limit: float = COVERED_LIMIT, longest_limit: int = LONGEST_LIMIT) -> DataFrame:
    """The rows of docs that assess() keeps, all columns unchanged."""
    return docs.mapInArrow(partial(_filter, **_limits(min_repeat, covered_limit, longest_limit)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
