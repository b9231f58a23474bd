"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes, hashed to buckets; non-letters count as blanks), and a linear softmax
over it gives the language. Both are trained together by stochastic gradient descent in numpy on a bounded sample: at most train_docs labelled documents
of at most train_chars characters, those with the smallest hash of id and text (rows equal in both count once). A fifth of the sample is kept from training: a temperature is fitted there,
which calibrates the probabilities, and the rejection threshold is the lowest probability at and above which at least precision of them are right.

Predictions read text alone. A text that is null or has no letter is `und` with score 0. Very long texts are read whole. Repeated rows and rows without doc_id
are answered each for itself; other columns don't matter. With an empty table, or no labelled row to learn from, nothing is learned and every row is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bytescan

SIZES = (2, 3, 4)
BUCKET_BITS, DIMENSIONS = 14, 12
TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
EPOCHS, BATCH, RATE = 8, 32, 2.0
PRECISION = 0.99
UNKNOWN = "und"

_VALUES = bytescan.BYTE_VALUES[np.frombuffer(bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)), np.uint8)]
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(SIZES))]


def subwords(part: bytescan.Texts):
    """For each n-gram size: buckets of all n-grams, in text order, and how many each text has."""
    values, lengths = _VALUES[part.data], part.ends - part.starts
    total = np.zeros(len(values), np.uint64)
    n = len(values)
    for size in range(1, max(SIZES) + 1):
        total[: n - size + 1] += values[size - 1 :] * _FACTORS[size - 1]
        if size in SIZES:
            counts = np.maximum(lengths - size + 1, 0)
            inside = np.ones(n, bool)
            for back in range(1, size):
                at = part.ends[lengths >= back] - back
                inside[at] = False
            yield ((total * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS))[inside].astype(np.int32), counts


def averages(part: bytescan.Texts, table: np.ndarray) -> np.ndarray:
    """The average row of table over the n-grams of each text."""
    out, n = np.zeros((len(part), table.shape[1])), np.zeros(len(part), np.int64)
    for buckets, counts in subwords(part):
        full = np.flatnonzero(counts)
        if len(full):
            out[full] += np.add.reduceat(table[buckets], (np.cumsum(counts) - counts)[full], axis=0)
        n += counts
    return out / np.maximum(n, 1)[:, None]


def features(texts: list[str]) -> np.ndarray:
    """Shares of the buckets among a text's n-grams."""
    out = np.zeros((len(texts), 1 << BUCKET_BITS), np.float32)
    k = 0
    for part in bytescan.texts(pa.array(texts, pa.string())):
        for buckets, counts in subwords(part):
            np.add.at(out, (k + np.repeat(np.arange(len(part)), counts), buckets), 1)
        k += len(part)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # what each bucket adds to the languages' logits: embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, average: np.ndarray) -> np.ndarray:
        return _softmax((average + self.bias) / self.temperature)


def train(texts: list[str], labels: list[str], seed: int = 7, precision: float = PRECISION) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    x = features(texts)
    order = rng.permutation(len(y))
    held, own = np.split(order, [len(y) // 5])
    embedding = rng.normal(0, 0.1, (x.shape[1], DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for k in range(0, len(own), BATCH):
            rows = own[k : k + BATCH]
            batch, rate = x[rows], RATE * (1 - done / steps)
            used = np.flatnonzero(batch.any(axis=0))
            batch = batch[:, used]
            hidden = batch @ embedding[used] * 10
            slope = _softmax(hidden @ weights + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ weights.T * 10
            weights -= rate * hidden.T @ slope
            bias -= rate * slope.sum(axis=0)
            embedding[used] -= rate * batch.T @ back
            done += 1
    table = (embedding @ weights * 10).astype(np.float32)
    test = held if len(held) else own
    logits = x[test] @ table + bias
    right = y[test]
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    correct = np.cumsum((p.argmax(axis=1) == right)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(correct >= precision)
    threshold = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, table, bias, temperature, threshold)


def _predict(batches, shared):
    model = shared.value
    for batch in batches:
        names, scores, rejected = [], [], []
        for part in bytescan.texts(batch.column(1)):
            has = np.zeros(len(part), bool)
            edges = np.append(part.starts, len(part.data))
            letters = np.concatenate(([0], np.cumsum(_IS_LETTER[part.data])))
            has[:] = letters[edges[1:]] > letters[edges[:-1]]
            for k in np.flatnonzero(~has):
                has[k] = any(c.isalpha() for c in part.bytes_of(k).decode())
            if model is None:
                has[:] = False
            else:
                p = model.probabilities(averages(part, model.table))
                best = p.argmax(axis=1)
            names += [model.languages[best[k]] if ok else UNKNOWN for k, ok in enumerate(has)]
            own = np.where(has, p.max(axis=1), 0.0) if model is not None else np.zeros(len(part))
            scores.append(own)
            rejected.append(~has | (own < (model.threshold if model is not None else 1)))
        if names:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], ["doc_id", "lang_pred", "score", "rejected"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model | None:
    """Learn from (doc_id, text, lang) outside the held-out fifth."""
    fit_on = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= train_chars))
    hashed = fit_on.select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    last = hashed.select("h").orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]  # hashes alone go to the driver, then the chosen texts
    # Rows of equal id and text count once (with the first of their languages), so train_docs rows at most are collected.
    chosen = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("x")).select("h", "x.text", "x.lang") if last is not None else None
    rows = sorted(chosen.collect(), key=tuple) if chosen is not None else []
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Of documents (doc_id, text): doc_id, lang_pred, score (calibrated probability), rejected (below the threshold, or `und`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _predict(b, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
