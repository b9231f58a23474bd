"""Benchmark decontamination by winnowing.

Of the 5-grams of a text, those with the smallest fingerprint in each run of four consecutive 5-grams (all of them, in a tie) are its winnowed
fingerprints. Any eight words that document and item share contain such a run, so they share a winnowed fingerprint: every 8-word window is found.
Documents' fingerprints are joined with the items'; a hit is extended to the windows of words around it, which are compared word for word. An item of
fewer than eight words is one window; all n-grams of its length in the documents are looked up, which is winnowing with a window of one.

Items are gathered in blocks of item_bytes of text, each of which is sent to all tasks, so what is broadcast has a bound however large the benchmark
is: a larger one takes several passes over the documents. Null texts have no words. An item with a null id counts like any other and is listed as an
empty string. Rows that are repeated whole, with or without doc_id, are answered each for itself. Very long texts are searched whole. Other columns don't matter, and
keep_clean() returns them all. Ties of fingerprints are all kept by the winnowing. An empty table of documents gives none; without items nothing is hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bytescan, exchange
from strandline.llm.storage import discard, materialize

WINDOW_WORDS, GRAM_WORDS = 8, 5
ITEM_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(bytescan.PLAIN_TABLE).split()


def winnow(grams: np.ndarray, counts: np.ndarray, run: int) -> np.ndarray:
    """Which grams are smallest in some run of consecutive grams of their text. counts: grams of each text."""
    n = len(grams)
    text = np.repeat(np.arange(len(counts)), counts)
    least = np.full(max(n - run + 1, 0), np.iinfo(np.uint64).max, np.uint64)
    for k in range(run):
        np.minimum(least, grams[k : k + len(least)], out=least)
    whole = text[: len(least)] == text[run - 1 :] if n >= run else np.zeros(0, bool)
    chosen = np.zeros(n, bool)
    for k in range(run):
        chosen[k : k + len(least)] |= whole & (grams[k : k + len(least)] == least)
    short = (counts < run) & (counts > 0)  # too short for a whole run
    if short.any():
        begins = np.cumsum(counts) - counts
        for b, c in zip(begins[short], counts[short], strict=True):
            chosen[b : b + c] |= grams[b : b + c] == grams[b : b + c].min()
    return chosen


class Items:
    """Windows and fingerprints of a block of benchmark items, as arrays: some 50 bytes a window."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int = WINDOW_WORDS, gram: int = GRAM_WORDS):
        self.window, self.gram = window, gram
        self.names = np.array(sorted({name for name, _ in rows}), object)
        number = {name: k for k, name in enumerate(self.names)}
        texts = [b" ".join(words_of(text)) for _, text in rows]
        owner = np.array([number[name] for name, _ in rows], np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        part = bytescan.Texts(self.data, starts, np.append(starts[1:], len(self.data)), slice(0, len(texts)))
        found = bytescan.words(part, bytescan.PLAIN, bytescan.LOWER_VALUES)
        counts = found.counts()
        self.fingerprints: dict[int, np.ndarray] = {}  # by number of words; 0: of the windows of full length
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}  # by number of words: fingerprints in order, where one of each stands, and CSR of its owners
        for n in sorted({*counts[(counts > 0) & (counts < window)].tolist(), *([window] if (counts >= window).any() else [])}):
            if n == window:
                at, _ = bytescan.windows(found, n)
                grams, g = bytescan.windows(found, gram)
                hashes = bytescan.window_hashes(found, grams, gram)
                whole = np.repeat(counts >= window, g)
                self.fingerprints[0] = np.unique(hashes[winnow(hashes, g, window - gram + 1) & whole])
            else:
                at = found.first[:-1][counts == n]
            hashes = bytescan.window_hashes(found, at, n)
            if n < window:
                self.fingerprints[n] = np.unique(hashes)
            mine = owner[np.searchsorted(found.first, at, side="right") - 1]
            order = np.lexsort((mine, hashes))
            hashes, at, mine = hashes[order], at[order], mine[order]
            new = np.ones(len(order), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            own = new.copy()
            own[1:] |= mine[1:] != mine[:-1]
            first = at[new]
            self.windows[n] = (hashes[new], found.starts[first], found.ends[first + n - 1], np.append(np.searchsorted(np.flatnonzero(own), np.flatnonzero(new)), int(own.sum())), mine[own])

    def owners(self, n: int, hashes: np.ndarray) -> list[tuple[int, bytes, np.ndarray]]:
        """Of fingerprints of n words: number, words and owners of those that are windows of the items; the words are to be compared."""
        known, begin, end, edges, mine = self.windows[n]
        at = _lookup(hashes, known)
        slot = np.searchsorted(known, hashes[at])
        return [(k, self.data[begin[s] : end[s]].tobytes(), mine[edges[s] : edges[s + 1]]) for k, s in zip(at.tolist(), slot.tolist(), strict=True)]


def _lookup(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.empty(0, np.int64)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.flatnonzero(known[at] == values)


def _hits(part: bytescan.Texts, found: bytescan.Words, items: Items):
    """(first word, number of words, owners' numbers) of each place in the batch where a window of the items stands."""
    for n, known in items.fingerprints.items():
        size, length = (items.gram, items.window) if not n else (n, n)
        at, counts = bytescan.windows(found, size)
        if not len(at):
            continue
        grams = bytescan.window_hashes(found, at, size)
        pick = np.flatnonzero(winnow(grams, counts, items.window - items.gram + 1)) if not n else np.arange(len(at))
        seeds = at[pick[_lookup(grams[pick], known)]]
        if not len(seeds):
            continue
        # Extend: all windows of full length around a seed, within its text.
        text = np.searchsorted(found.first, seeds, side="right") - 1
        begins = (seeds[:, None] - np.arange(length - size + 1)[None, :]).ravel()
        text = np.repeat(text, length - size + 1)
        begins = np.unique(begins[(begins >= found.first[text]) & (begins + length <= found.first[text + 1])])
        for k, words, owners in items.owners(length, bytescan.window_hashes(found, begins, length)):
            b = int(begins[k])
            if b" ".join(part.data[found.starts[b] : found.ends[b + length - 1]].tobytes().translate(bytescan.PLAIN_TABLE).split()) == words:
                yield b, length, owners


def _scan(batches, shared):
    """doc_id, text and what earlier blocks found, with what this block adds."""
    items = shared.value
    for batch in batches:
        n_words, spans, names = [], [], []
        earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
        for part in bytescan.texts(batch.column("text")):
            found = bytescan.words(part, bytescan.PLAIN, bytescan.LOWER_VALUES)
            n_words.append(found.counts())
            own_spans, own_names = [[] for _ in range(len(part))], [set() for _ in range(len(part))]
            for b, length, owners in _hits(part, found, items):
                d = int(np.searchsorted(found.first, b, side="right")) - 1
                own_spans[d].append((b - int(found.first[d]), length))
                own_names[d].update(owners.tolist())
            for x, y, (old_spans, old_names) in zip(own_spans, own_names, earlier, strict=False):
                spans.append(_union([*x, *((b, e - b) for b, e in old_spans)]) if x else old_spans)
                names.append(sorted({*items.names[list(y)], *old_names}) if y else old_names)
        if n_words:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(np.concatenate(n_words)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])


def _union(spans: list) -> list[list[int]]:
    """Half-open word spans that cover what (begin, length) spans cover."""
    out: list[list[int]] = []
    for b, length in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([b, b + length])
    return out


def item_blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES):
    """Lists of (id, text) of bounded size, one at least."""
    blocks = max(1, -(-exchange.text_bytes(benchmark) // item_bytes))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull())
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, spans (half-open, of hit words, in order), items (ids of items with a window in it, sorted). Each block of items is
    a pass over the documents, whose rows carry along what it found; between passes they are written to the shared folder."""
    spark, done = docs.sparkSession, None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, spans array<array<long>>, items array<string>"
    none = F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items")
    held = None
    for rows in item_blocks(benchmark, item_bytes):
        start, old = docs.select("doc_id", "text", *none), held
        if done is not None:
            start = held = materialize(done, "decontaminated")
        if old is not None:
            discard(old)
        shared = spark.sparkContext.broadcast(Items(rows, window_words, gram_words))
        done = start.mapInArrow(lambda b, shared=shared: _scan(b, shared), schema)
    return done.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, item_bytes=item_bytes)
    return found.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, x) -> n + x[1] - x[0])").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


def _keep(batches, shared):
    for batch in batches:
        clean = []
        for part in bytescan.texts(batch.column("text")):
            found = bytescan.words(part, bytescan.PLAIN, bytescan.LOWER_VALUES)
            own = np.ones(len(part), bool)
            own[[int(np.searchsorted(found.first, b, side="right")) - 1 for b, _, _ in _hits(part, found, shared.value)]] = False
            clean.append(own)
        if clean:
            yield batch.filter(pa.array(np.concatenate(clean)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs in which no window of an item occurs, all columns unchanged. Each block of items is a pass over what the others left."""
    for k, rows in enumerate(item_blocks(benchmark, item_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))
        docs = (materialize(docs, "clean-so-far") if k else docs).mapInArrow(lambda b, shared=shared: _keep(b, shared), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
