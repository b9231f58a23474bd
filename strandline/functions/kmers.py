"""Column functions on nucleotide text and 2-bit k-mer codes (A<C<G<T, left base most significant, k at most 31)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_K = 31
_BASES = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _BASES[_b] = _BASES[_b + 32] = _i


def dna(text: Column) -> Column:
    """Any text as bases: letters in turn, by their place in the alphabet modulo four."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


_DNA = bytes(b"ACGT"[(i - 97) % 4] if 97 <= i <= 122 else i for i in range(256)), bytes(i for i in range(256) if not 97 <= i <= 122)


def _dna(batches):
    for batch in batches:
        seq = pa.array([None if t is None else t.lower().encode().translate(*_DNA) for t in batch.column(1).to_pylist()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), seq], ["id", "seq"])


def dna_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq): dna() of every text, made by Python, which is several times as fast as regular expressions on long texts."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_dna, f"id {kind}, seq string").withColumnRenamed("id", id_col)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")


def plain_bases(seq: Column, soft_mask: bool = False, gap: int = 0) -> Column:
    """Upper case; a degenerate base becomes the first base that it stands for (B, S and Y C; K G; U T; all others A), and so does each other character A. With
    soft_mask, lower-case bases become A. With gap, runs of so many N or more stay N, so that no k-mer crosses them. Null stays null."""
    # Not upper(), which makes two characters of some.
    plain = F.translate(seq, "UBSYK", "TCCCG") if soft_mask else F.translate(seq, "acgtubsyknUBSYK", "ACGTTCCCGNTCCCG")
    if gap:
        short = "|".join(f"(?<=(?<!N)N{{{i}}})N(?=N{{0,{gap - 2 - i}}}(?!N))" for i in range(gap - 1))
        plain = F.regexp_replace(plain, short, "A")
    plain = F.regexp_replace(plain, "[^ACGTN]" if gap else "[^ACGT]", "A")
    return F.when(~seq.rlike("[^ACGT]"), seq).otherwise(plain)  # most have nothing to replace


def encode(seq: Column) -> Column:
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def base_at(code: Column, k: int, i: int) -> Column:
    return F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(3)


def prefix(code: Column, k: int, p: int) -> Column:
    return F.shiftright(code, 2 * (k - p))


def suffix(code: Column, p: int) -> Column:
    return code.bitwiseAND((1 << 2 * p) - 1)


def common_prefix(a: Column, b: Column, k: int) -> Column:
    """Bases that two codes share from the left."""
    return F.when(a == b, F.lit(k)).otherwise(F.lit(k) - F.floor((F.length(F.bin(a.bitwiseXOR(b))) + 1) / 2)).cast("int")


def has_prefix(code: Column, of: Column, k: int, p: int) -> Column:
    return prefix(code, k, p) == prefix(of, k, p)


def has_suffix(code: Column, of: Column, p: int) -> Column:
    return suffix(code, p) == suffix(of, p)


def inner(code: Column, k: int, after: int, p: int) -> Column:
    """p bases behind the first after ones."""
    return F.shiftright(code, 2 * (k - after - p)).bitwiseAND((1 << 2 * p) - 1)


def repeated_a(seq: Column) -> Column:
    """Places of A behind another A."""
    return F.length(F.regexp_replace(seq, "[^A]+|(?<![A])A", ""))


def low_complexity(code: Column, k: int, most: int = 50) -> Column:
    """Whether a code is one base only or has a DUST score above most."""
    return code.isin([homopolymer(b, k) for b in "ACGT"]) | (dust(decode(code, k)) > most)


def mismatches(a: Column, b: Column) -> Column:
    """Bases in which two codes of equal length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(0x5555555555555555)).cast("int")


def canonical(code: Column, rc: Column) -> Column:
    return F.least(code, rc)


def homopolymer(base: str, k: int) -> int:
    return sum("ACGT".index(base) << 2 * i for i in range(k))


def dust(seq: Column) -> Column:
    """Sum over 3-mers of c * (c - 1) / 2; above 50 a 31-mer counts as low in complexity."""
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(seq) - 2), lambda i: F.substring(seq, i, F.lit(3))))
    # In sorted order the n-th of equal 3-mers adds n - 1, which sums to c * (c - 1) / 2 for each kind.
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("total"))
    step = lambda acc, g: F.when(acc["last"] == g, F.struct(g.alias("last"), (acc["n"] + 1).alias("n"), (acc["total"] + acc["n"]).alias("total"))).otherwise(F.struct(g.alias("last"), F.lit(1).alias("n"), acc["total"].alias("total")))
    return F.when(F.length(seq) < 3, F.lit(0)).otherwise(F.aggregate(grams, start, step, lambda acc: acc["total"]))


def reverse(code: Column, k: int) -> Column:
    """The code of the same bases in reverse order (not the complement)."""
    return F.conv(F.reverse(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0")), 4, 10).cast("long")


def reverse_codes(code: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(code), np.int64)
    for j in range(k):
        out = out << 2 | (code >> 2 * j) & 3
    return out


def suffix_matches(a: Column, b: Column, k: int) -> Column:
    """Bases that agree after the common prefix of two codes."""
    return (F.lit(k) - common_prefix(a, b, k) - mismatches(a, b)).cast("int")


def text_of(code: int, k: int) -> str:
    """decode() of one code."""
    return "".join("ACGT"[code >> 2 * i & 3] for i in range(k - 1, -1, -1))


def dust_of(seq: str) -> int:
    """dust() of one text."""
    return sum(c * (c - 1) // 2 for c in Counter(seq[i : i + 3] for i in range(len(seq) - 2)).values())


def dust_at(seq: bytes, k: int) -> np.ndarray:
    """dust() of the k-mer at each place of seq, for those of codes(): the pairs of equal 3-mers at each distance, by running sums."""
    b = _BASES[np.frombuffer(seq, np.uint8)] & 3
    n = max(len(b) - k + 1, 0)
    out = np.zeros(n, np.int64)
    if n and k > 3:
        grams = b[:-2] << 4 | b[1:-1] << 2 | b[2:]
        for d in range(1, k - 2):
            sums = np.cumsum(grams[d:] == grams[:-d])
            out += sums[k - 3 - d : k - 3 - d + n]
            out[1:] -= sums[: n - 1]
    return out


def monotonous(seq: Column) -> Column:
    """The older complexity test: fewer than four kinds of 2-mers, and one 2-mer in k / 2 - 1 places or more, or else fewer than eight kinds of
    3-mers and one in k / 3 - 1 places or more."""
    def kinds_and_most(n: int) -> tuple[Column, Column]:
        grams = F.transform(F.sequence(F.lit(1), F.length(seq) - n + 1), lambda i: F.substring(seq, i, F.lit(n)))
        kinds = F.array_distinct(grams)
        return F.size(kinds), F.array_max(F.transform(kinds, lambda g: F.size(F.filter(grams, lambda x: x == g))))

    (two, most_two), (three, most_three), k = kinds_and_most(2), kinds_and_most(3), F.length(seq)
    frequent = (most_two >= F.floor(k / 2) - 1) | ((three < 8) & (most_three >= F.floor(k / 3) - 1))
    return F.when(k < 3, F.lit(True)).otherwise((two < 4) & frequent)


def hash64(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer mix of shifts and adds, wrapping."""
    x = x.astype(np.uint64)
    x = ~x + (x << np.uint64(21))
    x ^= x >> np.uint64(24)
    x = x + (x << np.uint64(3)) + (x << np.uint64(8))
    x ^= x >> np.uint64(14)
    x = x + (x << np.uint64(2)) + (x << np.uint64(4))
    x ^= x >> np.uint64(28)
    return x + (x << np.uint64(31))


def codes(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, codes and codes of the reverse complement of the k-mers of seq that hold bases only."""
    b = _BASES[np.frombuffer(seq, np.uint8)]
    n = len(b) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    v = b.astype(np.int64) & 3
    # By doubling: codes of 1, 2, 4, ... bases, put together to k.
    fwd, rev, have, part, back, size = None, None, 0, v, 3 - v, 1
    while True:
        if k & size:
            if have:
                fwd, rev = fwd[: len(part) - have] << 2 * size | part[have:], back[have:] << 2 * have | rev[: len(back) - have]
            else:
                fwd, rev = part, back
            have += size
        if 2 * size > k:
            break
        part, back, size = part[:-size] << 2 * size | part[size:], back[size:] << 2 * size | back[:-size], 2 * size
    if (b > 3).any():
        bad = np.concatenate(([0], np.cumsum(b > 3)))
        at = np.flatnonzero(bad[k:] == bad[:-k])
        return at, fwd[at], rev[at]
    return np.arange(n), fwd, rev


def _explode(batches, k, scale, only):
    known = only.value if only is not None else None
    for batch in batches:
        ids, pos, fwd, rev = [], [], [], []
        for i, s in enumerate(batch.column(1).to_pylist()):
            p, f, r = codes((s or "").encode(), k)
            if scale > 1:
                keep = hash64(np.minimum(f, r)) & np.uint64(scale - 1) == 0
                p, f, r = p[keep], f[keep], r[keep]
            if known is not None:
                near = np.searchsorted(known, f)
                keep = known[np.minimum(near, len(known) - 1)] == f if len(known) else np.zeros(len(f), bool)
                p, f, r = p[keep], f[keep], r[keep]
            ids.append(np.full(len(p), i))
            pos.append(p)
            fwd.append(f)
            rev.append(r)
        if ids:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), *(pa.array(np.concatenate(x)) for x in (pos, fwd, rev))], ["id", "pos", "kmer", "rc"])


def explode_kmers(df: DataFrame, id_col: str, seq_col: str, k: int, scale: int = 1, only: np.ndarray | None = None) -> DataFrame:
    """(id, pos, kmer, rc) of every k-mer of every sequence; with scale 2, 4 or 8 of those alone whose canonical code hashes to 0 modulo scale. only: sorted codes
    (a bounded number, sent to all tasks), all others are left out."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    if scale & scale - 1:
        raise ValueError("scale must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(only) if only is not None else None
    return df.select(id_col, seq_col).mapInArrow(lambda b: _explode(b, k, scale, known), f"id {kind}, pos long, kmer long, rc long").withColumnRenamed("id", id_col)


def _count(batches, k):
    for batch in batches:
        n, distinct = [], []
        for s in batch.column(1).to_pylist():
            _, f, r = codes((s or "").encode(), k)
            n.append(len(f))
            distinct.append(len(np.unique(np.minimum(f, r))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(distinct, pa.int64())], ["id", "n", "n_canonical"])


def count_kmers(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """(id, n, n_canonical): k-mers of each sequence and its distinct canonical ones, counted where the sequence stands. One without a k-mer has zeros."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, seq_col).mapInArrow(lambda b: _count(b, k), f"id {kind}, n long, n_canonical long").withColumnRenamed("id", id_col)


def sorted_codes(kmer_rows: DataFrame, most: int = 2_000_000) -> np.ndarray | None:
    """The distinct codes (kmer) in order, or None if there are more than most: so many are counted before any is brought to the driver."""
    distinct = kmer_rows.select("kmer").distinct()
    if distinct.limit(most + 1).count() > most:
        return None
    return np.sort(distinct.toPandas()["kmer"].to_numpy(np.int64))
