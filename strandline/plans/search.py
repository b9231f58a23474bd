"""Sequence search: queries against an index, and the genome comparisons built on the same parts."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import alignment, kmers, thresholds
from strandline.operators import chaining, intervals, seeds
from strandline.plans.index import Index


@dataclass(frozen=True)
class SearchOptions:
    min_prefix: int = 15
    min_single_prefix: int = 17
    max_gap: int = 50
    max_distance: int = 1000
    top_genomes: int = 0
    extend: int = 1000
    min_length: int = 50
    min_identity: float = 70
    max_evalue: float = 10
    min_query_coverage_hsp: float = 0
    min_query_coverage_genome: float = 0

    def __post_init__(self):
        if not 5 <= self.min_prefix <= 31 or self.min_single_prefix < self.min_prefix:
            raise ValueError("prefixes must be from 5 to 31, the single one not the shorter")


#: Seeds of queries (some 50 bytes each) that are sent to all tasks at most.
BROADCAST_SEEDS = 500_000


def anchors(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(query, genome_id, seq_idx, q, t, len, rc): matches of captured k-mers, begins from 0 on the forward strands."""
    k = index.options.k
    found = seeds.capture(queries.where(F.length("seq") >= k), "query", "seq", index.mask_rows, k)
    both = found.withColumn("rev", F.lit(False)).unionByName(seeds.reversed_seeds(found, index.mask_rows, k).withColumn("rev", F.lit(True)))
    # Few query seeds are sent to the index, so that it isn't shuffled; more are joined by shuffles.
    if both.count() <= BROADCAST_SEEDS:
        both = F.broadcast(both)
    m = seeds.match(both, index.seeds, k, options.min_prefix, ["mask_id", "rev"])
    # The shared bases stand at a k-mer's begin; on the reverse strand, or else in a reversed k-mer, at its end.
    begin = lambda pos, rc: F.when(F.col(rc) != F.col("rev"), F.col(pos) + k - F.col("len")).otherwise(F.col(pos)).cast("int")
    return m.select("query", F.col("s_genome_id").alias("genome_id"), F.col("s_seq_idx").alias("seq_idx"), begin("pos", "rc").alias("q"), begin("s_pos", "s_rc").alias("t"), "len", (F.col("rc") != F.col("s_rc")).alias("rc")).distinct()


CHAIN_SCHEMA = "query string, genome_id string, seq_idx int, rc boolean, chain int, score float, qb int, qe int, tb int, te int, n int"
_CHAIN_KEYS = ["query", "genome_id", "seq_idx", "rc"]
_CHAIN_ARROW = pa.schema([("query", pa.string()), ("genome_id", pa.string()), ("seq_idx", pa.int32()), ("rc", pa.bool_()), ("chain", pa.int32()), ("score", pa.float32()), *((c, pa.int32()) for c in ("qb", "qe", "tb", "te", "n"))])


def parts(batches, rows: int = 256):
    """Frames of a few rows, so that what a task makes of them passes on before it adds up."""
    for pdf in batches:
        for low in range(0, len(pdf), rows):
            yield pdf.iloc[low : low + rows]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all shuffle partitions. The number is stated since few bytes may be much work here, which adaptive coalescing can't know."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def chains(found: DataFrame, k: int, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Chains of the anchors of each query, contig and strand. Spark sorts the anchors, on disk if need be; a task holds one group at a time."""
    least = 0.1 * options.min_single_prefix**2

    def run(batches):
        anchor_rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for key, group in groupby(anchor_rows, key=lambda r: r[:4]):
            a = chaining.clear_nested(np.array([r[4:] for r in group], np.int64), k)
            for n, (path, score) in enumerate(chaining.chain(a, options.max_gap, options.max_distance, least)):
                p = a[path]
                out.append((*key, n, score, *(int(x) for x in (p[:, 0].min(), (p[:, 0] + p[:, 2]).max(), p[:, 1].min(), (p[:, 1] + p[:, 2]).max(), len(path)))))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CHAIN_ARROW, strict=True)], schema=_CHAIN_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CHAIN_ARROW, strict=True)], schema=_CHAIN_ARROW)

    return dealt(found.select(*_CHAIN_KEYS, "q", "t", "len"), *_CHAIN_KEYS).sortWithinPartitions(*_CHAIN_KEYS).mapInArrow(run, CHAIN_SCHEMA)


HIT_SCHEMA = "query string, genome_id string, seq_idx int, chain int, qb int, qe int, tb int, te int, rc boolean, cigar string, matches int, gaps int, opens int, alen int, qseq string, sseq string, align string"


def shared_regions(q: str, t: str, min_length: int, least: int = 11) -> list[tuple[int, int, int, int, int]]:
    """Regions of q and t that chains of exact matches of least bases or more hold together."""
    qp, qc, _ = kmers.codes(q.encode(), least)
    tp, tc, _ = kmers.codes(t.encode(), least)
    order = np.argsort(qc, kind="stable")
    low, high = np.searchsorted(qc[order], tc), np.searchsorted(qc[order], tc, side="right")
    n = high - low
    i = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    pairs = np.stack([qp[i], np.repeat(tp, n)], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))]
    if not len(pairs):
        return []
    new = np.ones(len(pairs), bool)
    new[1:] = (np.diff(pairs[:, 1] - pairs[:, 0]) != 0) | (np.diff(pairs[:, 0]) != 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(pairs))) + least - 1
    a = np.column_stack([pairs[first], size])
    return chaining.chain_regions(a[np.lexsort((a[:, 1], a[:, 0]))], min_length=min_length)


def texts_of(q: str, t: str, cigar: str) -> tuple[str, str, str]:
    import re

    a, b, m, i, j = [], [], [], 0, 0
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        n = int(n)
        a.append(q[i : i + n] if op != "D" else "-" * n)
        b.append(t[j : j + n] if op != "I" else "-" * n)
        m.append(("|" if op == "=" else " ") * n)
        i += n * (op != "D")
        j += n * (op != "I")
    return "".join(a), "".join(b), "".join(m)


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def hits(chained: DataFrame, queries: DataFrame, contigs: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Base-level alignments of chains: windows around them, regions of exact matches, gap-affine alignment of each."""
    e = options.extend
    joined = chained.join(queries.select("query", F.upper("seq").alias("qseq_all")), "query")
    low = F.greatest(F.lit(0), F.col("tb") - e)
    windows = joined.join(contigs.select("genome_id", "seq_idx", "seq"), ["genome_id", "seq_idx"]).select("query", "genome_id", "seq_idx", "chain", "rc", "qb", "qe", "qseq_all", low.alias("w0"), F.substring(F.col("seq"), (low + 1).cast("int"), (F.col("te") + e - low).cast("int")).alias("window"))
    names = [c.split()[0] for c in HIT_SCHEMA.split(", ")]

    def run(batches):
        for pdf in parts(batches):
            rows = []
            for r in pdf.itertuples(index=False):
                q0, q1 = max(0, r.qb - e), min(len(r.qseq_all), r.qe + e)
                q, t = r.qseq_all[q0:q1], r.window
                if r.rc:
                    t = t.translate(_COMPLEMENT)[::-1]
                for *region, _ in shared_regions(q, t, options.min_length):
                    qb, qe, tb, te = chaining.extended(q, t, tuple(region))
                    cigar, matches, gaps, opens = chaining.align(q[qb:qe], t[tb:te])
                    a, b, m = texts_of(q[qb:qe], t[tb:te], cigar)
                    if r.rc:
                        tb, te = len(t) - te, len(t) - tb
                    rows.append((r.query, r.genome_id, r.seq_idx, r.chain, q0 + qb, q0 + qe, r.w0 + tb, r.w0 + te, r.rc, cigar, matches, gaps, opens, len(m), a, b, m))
            yield pd.DataFrame(rows, columns=names)

    found = dealt(windows, "query", "genome_id", "seq_idx", "chain").mapInPandas(run, HIT_SCHEMA)
    # Of several chains that lead to one alignment the best one keeps it.
    keys = ["query", "genome_id", "seq_idx", "rc", "qb", "qe", "tb", "te"]
    return found.groupBy(*keys).agg(F.min("chain").alias("chain"), *(F.first(c).alias(c) for c in names if c not in (*keys, "chain"))).select(*names)


def search(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """queries(query, seq) against the index: a row for each alignment, with coverage, numbering and scores."""
    k = index.options.k
    chained = chains(anchors(index, queries, options), k, options)
    if options.top_genomes:
        best = chained.groupBy("query", "genome_id").agg(F.max("score").alias("s"))
        best = intervals.top(best, ["query"], [F.desc("s"), F.col("genome_id")], options.top_genomes).select("query", "genome_id")
        chained = chained.join(best, ["query", "genome_id"])
    h = hits(chained, queries, index.contigs, options)
    h = h.join(queries.select("query", F.length("seq").alias("qlen")), "query").join(index.contigs.select("genome_id", "seq_idx", F.col("seq_id").alias("sseqid"), F.col("seq_len").alias("slen")), ["genome_id", "seq_idx"])
    mism = F.col("alen") - F.col("matches") - F.col("gaps")
    bit = alignment.bits(alignment.raw_score(F.col("matches"), mism, F.col("opens"), F.col("gaps")))
    h = h.withColumn("evalue", alignment.e_value(bit, F.col("qe") - F.col("qb"), index.total_bases())).withColumn("bitscore", bit.cast("int"))
    h = h.withColumn("pident", alignment.share(F.col("matches"), F.col("alen"))).withColumn("qcovHSP", alignment.share(F.col("qe") - F.col("qb"), F.col("qlen")))
    h = h.where((F.col("evalue") <= options.max_evalue) & (F.col("pident") >= options.min_identity) & (F.col("qcovHSP") >= options.min_query_coverage_hsp))
    h = intervals.with_union_length(h, ["query", "genome_id"], F.col("qb"), F.col("qe") - 1).withColumn("qcovGnm", alignment.share(F.col("covered"), F.col("qlen"))).where(F.col("qcovGnm") >= options.min_query_coverage_genome)
    # A cluster of alignments is what comes from one chain.
    h = h.withColumn("rank_score", F.col("bitscore") * F.col("pident")).withColumn("cluster", F.struct("seq_idx", "rc", "chain"))
    h = intervals.number_hits(h, "query", "genome_id", "cluster", "rank_score", ["qb", "tb"])
    flip = F.col("rc")
    return h.select("query", "qlen", "hits", F.col("genome_id").alias("sgenome"), "sseqid", "qcovGnm", "cls", "hsp", "qcovHSP", F.col("alen").alias("alenHSP"), "pident", "gaps", (F.col("qb") + 1).alias("qstart"), F.col("qe").alias("qend"), (F.col("tb") + 1).alias("sstart"), F.col("te").alias("send"), F.when(flip, "-").otherwise("+").alias("sstr"), "slen", "evalue", "bitscore", "cigar", "qseq", "sseq", "align", "genome_rank")


def fragments(genomes: DataFrame, size: int = 1020, least: int = 100) -> DataFrame:
    """contigs(genome_id, seq_idx, seq) as non-overlapping windows: genome_id, frag (contig and begin), frag_len, seq. A shorter last one of least bases stays."""
    starts = genomes.select("genome_id", "seq_idx", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))).alias("start"))
    cut = starts.select("genome_id", F.concat_ws(":", "seq_idx", "start").alias("frag"), F.substring(F.col("seq"), F.col("start") + 1, F.lit(size)).alias("seq"))
    return cut.where(F.length("seq") >= least).withColumn("frag_len", F.length("seq"))


def fragment_pairs(a: DataFrame, b: DataFrame, k: int = 11, scale: int = 4, least: int = 3, top: int = 5) -> DataFrame:
    """(frag_a, frag_b, shared): fragments of two sides with sampled canonical k-mers in common, for each of a the best top of each genome of b."""
    name = lambda x, c: x.select(F.concat_ws("|", "genome_id", "frag").alias(c), "seq")
    canon = F.least("kmer", "rc").alias("canon")
    of_a = kmers.explode_kmers(name(a, "frag_a"), "frag_a", "seq", k, scale)
    # If a has few distinct k-mers (counted first), b's others are dropped where they stand.
    known = kmers.sorted_codes(of_a.select("kmer").union(of_a.select("rc")))
    of_b = kmers.explode_kmers(name(b, "frag_b"), "frag_b", "seq", k, scale, only=known)
    both = of_a.select("frag_a", canon).distinct().join(of_b.select("frag_b", canon).distinct(), "canon")
    both = both.groupBy("frag_a", "frag_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    # A fragment's own name holds no "|", so what stands before the last one is the genome.
    both = both.withColumn("genome", F.regexp_replace("frag_b", "\\|[^|]*$", ""))
    return intervals.top(both, ["frag_a", "genome"], [F.desc("shared"), F.col("frag_b")], top).drop("genome")


def ani(a: DataFrame, b: DataFrame, size: int = 1020, min_identity: float = 70, min_coverage: float = 15, reciprocal: bool = True, min_fraction: float = 0, min_ani: float = 0) -> DataFrame:
    """(query, subject, ANI, qAF, sAF, tANI): genomes of a against genomes of b (contigs of both), by aligned fragments, all in per cent. reciprocal keeps mutual best
    fragments alone, whose matches count for both sides in tANI; else ANI and fractions are those of each query fragment's best, and tANI has the matches of each side's
    best. An alignment's identity is that of all its columns; aligned lengths leave gaps out."""
    fa, fb = fragments(a, size), fragments(b, size)
    # The shortest fragments count as well, so the bound is that of their length.
    least = max(3, thresholds.least_shared(100, 11, 4, 0.8))
    named = lambda f, c, s: f.select(F.concat_ws("|", "genome_id", "frag").alias(c), F.col("genome_id").alias(f"g_{c}"), F.col("seq").alias(s), F.col("frag_len").alias(f"len_{c}"))
    both = fragment_pairs(fa, fb, least=least).select("frag_a", "frag_b")
    if not reciprocal:
        both = both.union(fragment_pairs(fb, fa, least=least).select("frag_b", "frag_a")).distinct()
    pairs = both.join(named(fa, "frag_a", "qa"), "frag_a").join(named(fb, "frag_b", "tb"), "frag_b")
    schema = "frag_a string, frag_b string, g_frag_a string, g_frag_b string, len_frag_a int, len_frag_b int, matches int, aligned int, columns int"

    def run(batches):
        for pdf in parts(batches):
            rows = []
            for r in pdf.itertuples(index=False):
                best = (0, 0, 0)
                for t in (r.tb, r.tb.translate(_COMPLEMENT)[::-1]):
                    for qb, qe, tb, te, _ in shared_regions(r.qa, t, 50):
                        _, matches, gaps, _ = chaining.align(r.qa[qb:qe], t[tb:te])
                        columns = (qe - qb + te - tb + gaps) // 2
                        best = max(best, (matches, columns - gaps, columns))
                if best[1]:
                    rows.append((r.frag_a, r.frag_b, r.g_frag_a, r.g_frag_b, r.len_frag_a, r.len_frag_b, *best))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    found = dealt(pairs, "frag_a", "frag_b").mapInPandas(run, schema).withColumn("pident", alignment.share(F.col("matches"), F.col("columns")))
    found = found.where((F.col("pident") >= min_identity) & (F.col("aligned") * 100 >= min_coverage * F.col("len_frag_a"))).withColumn("value", F.col("aligned") * F.col("pident"))
    wa, wb = Window.partitionBy("frag_a", "g_frag_b").orderBy(F.desc("value"), "frag_b"), Window.partitionBy("frag_b", "g_frag_a").orderBy(F.desc("value"), "frag_a")
    best = found.withColumn("ra", F.row_number().over(wa)).withColumn("rb", F.row_number().over(wb)).where("ra = 1 and rb = 1" if reciprocal else "ra = 1 or rb = 1")
    own, back = F.col("ra") == 1, F.col("rb") == 1
    total = lambda f, g, n: f.groupBy(F.col("genome_id").alias(g)).agg(F.sum("frag_len").alias(n))
    sums = best.groupBy(F.col("g_frag_a").alias("query"), F.col("g_frag_b").alias("subject")).agg(F.avg(F.when(own, F.col("pident"))).alias("ANI"), F.sum(F.when(own, F.col("aligned"))).alias("aligned"), (F.sum(F.when(own, F.col("matches"))) + F.sum(F.when(back, F.col("matches")))).alias("matches")).where("aligned is not null")
    out = sums.join(total(fa, "query", "qsize"), "query").join(total(fb, "subject", "ssize"), "subject")
    out = out.select("query", "subject", "ANI", alignment.share(F.col("aligned"), F.col("qsize")).alias("qAF"), alignment.share(F.col("aligned"), F.col("ssize")).alias("sAF"), (F.col("matches") * 100 / (F.col("qsize") + F.col("ssize"))).alias("tANI"))
    return out.where((F.col("qAF") >= min_fraction) & (F.col("ANI") >= min_ani))


_SAMPLED_SCHEMA = "frag string, genome_id string, seq_idx int, rc boolean, qb int, qe int, tb int, te int, n int"


def sampled_anchors(frags: DataFrame, contigs: DataFrame, k: int = 13, scale: int = 4, most: int = 100) -> DataFrame:
    """(frag, genome_id, seq_idx, rc, q, t): sampled canonical k-mers of fragments(frag, seq) in contigs, of each k-mer the first most places of a genome. On the
    reverse strand t counts from the contig's end. If the fragments have few distinct k-mers (counted first), the contigs' others are dropped where they stand."""
    canon = {"canon": F.least("kmer", "rc"), "back": F.col("kmer") > F.col("rc")}
    q = kmers.explode_kmers(frags, "frag", "seq", k, scale)
    both = q.select("kmer").union(q.select("rc"))
    s = kmers.explode_kmers(contigs.select(F.struct("genome_id", "seq_idx", F.length("seq").alias("n")).alias("id"), "seq"), "id", "seq", k, scale, only=kmers.sorted_codes(both))
    s = s.withColumns(canon).select("canon", "id.*", "pos", F.col("back").alias("s_back"))
    s = seeds.first_places(s, ["genome_id", "canon"], ["seq_idx", "pos"], most)
    rc = F.col("back") != F.col("s_back")
    t = F.when(rc, F.col("n") - F.col("s_pos") - k).otherwise(F.col("s_pos"))
    return q.withColumns(canon).select("frag", "pos", "canon", "back").join(s.withColumnRenamed("pos", "s_pos"), "canon").select("frag", "genome_id", "seq_idx", rc.alias("rc"), F.col("pos").cast("int").alias("q"), t.cast("int").alias("t"))


def sampled_ani(a: DataFrame, b: DataFrame, size: int = 1020, k: int = 13, scale: int = 4, most: int = 100, top_chains: int = 5, min_length: int = 50, min_identity: float = 70, min_coverage: float = 15, max_evalue: float = 1e-15) -> DataFrame:
    """(query, subject, ANI, qAF, sAF, fragments, matches): fragments of the genomes of a, placed on the contigs of b by sampled k-mers. A fragment's best chains in
    a genome, with half a fragment around them, are aligned; the one with most matched times aligned bases counts. Fractions and ANI are in per cent.
    A pair without an aligned fragment has no row."""
    name = F.concat_ws("|", "genome_id", "frag")
    fa = fragments(a, size).select(name.alias("frag"), F.col("genome_id").alias("query"), "seq", "frag_len")
    found = sampled_anchors(fa.select("frag", "seq"), b, k, scale, most)
    keys = ["frag", "genome_id", "seq_idx", "rc"]

    def chain(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for key, group in groupby(rows, key=lambda r: r[:4]):
            anchors = np.array([(*r[4:], k) for r in group], np.int64)
            out += [(*key, *map(int, region)) for region in chaining.chain_regions(anchors, min_length=min_length)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SAMPLED_TYPES, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SAMPLED_TYPES, strict=True)], names)

    names = [c.split()[0] for c in _SAMPLED_SCHEMA.split(", ")]
    chained = dealt(found, *keys).sortWithinPartitions(*keys, "q", "t").mapInArrow(chain, _SAMPLED_SCHEMA)
    chained = intervals.top(chained, ["frag", "genome_id"], [F.desc("n"), F.col("seq_idx"), F.col("rc"), F.col("qb"), F.col("tb")], top_chains)
    sizes_b = b.groupBy("genome_id").agg(F.sum(F.length("seq")).alias("ssize"))
    n, low, high = F.length("seq"), F.greatest(F.lit(0), F.col("tb") - size // 2), F.col("te") + size // 2
    begin = F.when(F.col("rc"), F.greatest(F.lit(0), n - high)).otherwise(low)
    end = F.when(F.col("rc"), n - low).otherwise(F.least(n, high))
    windows = chained.join(b.select("genome_id", "seq_idx", "seq"), ["genome_id", "seq_idx"]).select("frag", "genome_id", "rc", F.substring(F.col("seq"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("window"))
    windows = windows.join(fa.select("frag", "query", F.col("seq").alias("qseq"), "frag_len"), "frag").join(sizes_b, "genome_id")
    schema = "frag string, query string, genome_id string, frag_len int, ssize long, matches int, aligned int, columns int"

    def align(batches):
        for pdf in parts(batches):
            rows = []
            for r in pdf.itertuples(index=False):
                t = r.window.translate(_COMPLEMENT)[::-1] if r.rc else r.window
                for *region, _ in shared_regions(r.qseq, t, min_length)[:2]:
                    qb, qe, tb, te = chaining.extended(r.qseq, t, tuple(region))
                    _, matches, gaps, opens = chaining.align(r.qseq[qb:qe], t[tb:te])
                    columns = (qe - qb + te - tb + gaps) // 2
                    score = 2 * matches - 3 * (columns - matches - gaps) - 5 * opens - 2 * gaps
                    bit = ((score - score % 2) * alignment.LAMBDA - np.log(alignment.K)) / np.log(2)
                    if r.ssize * 2.0**-bit * (qe - qb) <= max_evalue:
                        rows.append((r.frag, r.query, r.genome_id, r.frag_len, r.ssize, matches, columns - gaps, columns))
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    aligned = dealt(windows, "frag", "genome_id").mapInPandas(align, schema).withColumn("pident", alignment.share(F.col("matches"), F.col("columns")))
    aligned = aligned.where((F.col("pident") >= min_identity) & (F.col("aligned") * 100 >= min_coverage * F.col("frag_len")))
    best = aligned.groupBy("frag", "query", "genome_id", "ssize").agg(F.max_by(F.struct("pident", "aligned", "matches"), F.struct((F.col("matches").cast("long") * F.col("aligned")).alias("v"), "pident")).alias("x"))
    sums = best.groupBy("query", F.col("genome_id").alias("subject"), "ssize").agg(F.avg("x.pident").alias("ANI"), F.sum("x.aligned").alias("aligned"), F.count(F.lit(1)).alias("fragments"), F.sum("x.matches").alias("matches"))
    out = sums.join(fa.groupBy("query").agg(F.sum("frag_len").alias("qsize")), "query")
    return out.select("query", "subject", "ANI", alignment.share(F.col("aligned"), F.col("qsize")).alias("qAF"), alignment.share(F.col("aligned"), F.col("ssize")).alias("sAF"), "fragments", "matches")


_SAMPLED_TYPES = [pa.string(), pa.string(), pa.int32(), pa.bool_(), *[pa.int32()] * 5]


def compare(a: DataFrame, b: DataFrame, mode: str = "sampled", **options) -> DataFrame:
    """(query, subject, ANI, qAF, sAF, tANI) of genomes of a and b (contigs). sampled: fragments of each side on the other; sAF and the matches of tANI are those of the
    way back. orthoani: mutual best fragments, see ani()."""
    if mode == "orthoani":
        return ani(a, b, **options)
    if mode != "sampled":
        raise ValueError("mode must be sampled or orthoani")
    size = lambda x, c: x.groupBy(F.col("genome_id").alias(c)).agg(F.sum(F.length("seq")).alias(f"n_{c}"))
    there = sampled_ani(a, b, **options)
    back = sampled_ani(b, a, **options).select(F.col("subject").alias("query"), F.col("query").alias("subject"), F.col("qAF").alias("back"), F.col("matches").alias("m2"))
    both = there.join(back, ["query", "subject"], "left").join(size(a, "query"), "query").join(size(b, "subject"), "subject")
    total = (F.col("matches") + F.coalesce("m2", F.lit(0))) * 100 / (F.col("n_query") + F.col("n_subject"))
    return both.select("query", "subject", "ANI", "qAF", F.coalesce("back", F.lit(0.0)).alias("sAF"), total.alias("tANI"))


def screen(index: Index, genomes: DataFrame, min_prefix: int = 17, min_fraction: float = 0.01, top: int = 10) -> DataFrame:
    """Genomes of the index that share seeds with genomes (contigs), by masks: see seeds.screen(), with rank. The masks capture from each query contig."""
    k = index.options.k
    q = genomes.where(F.length("seq") >= k).select(F.struct("genome_id", "seq_idx").alias("id"), "seq")
    found = seeds.capture(q, "id", "seq", index.mask_rows, k).select(F.col("id.genome_id").alias("query"), "mask_id", "kmer").distinct()
    found = seeds.not_low(found, "kmer", k)
    known = index.places().select("mask_id", "kmer", "genome_id").distinct()
    hits = seeds.match(found, known, k, min_prefix, ["mask_id"]).withColumnRenamed("s_genome_id", "subject")
    out = seeds.screen(hits, "query", "subject", "mask_id", index.options.masks).where(F.col("fracMasks") >= min_fraction)
    return intervals.top(out, ["query"], [F.desc("sumPrefix"), F.col("subject")], top)


def genome_search(index: Index, genomes: DataFrame, mode: str = "sampled", **options) -> DataFrame:
    """Genomes (contigs) against an index. screen: shared seeds alone. sampled, orthoani: those pairs' ANI and aligned fractions, ranked."""
    if mode == "screen":
        return screen(index, genomes, **options)
    if mode not in ("sampled", "orthoani"):
        raise ValueError("mode must be sampled, orthoani or screen")
    near = screen(index, genomes, top=options.pop("top", 10)).select("query", "subject")
    subjects = index.contigs.join(near.select(F.col("subject").alias("genome_id")).distinct(), "genome_id", "left_semi")
    out = (sampled_ani if mode == "sampled" else ani)(genomes, subjects, **options).join(near, ["query", "subject"], "left_semi")
    return seeds.ranked_ani(out, "query", "subject", "ANI", "qAF", "sAF")


def merge_results(*tables: DataFrame, query: str | None = None) -> DataFrame:
    """Results of several indexes in one: hits are added up, genomes ordered by their best alignment."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    if query is not None:
        out = out.where(F.col("query") == query)
    out = out.withColumn("best", F.max(F.col("bitscore") * F.col("pident")).over(Window.partitionBy("query", "sgenome")))
    rank = Window.partitionBy("query").orderBy(F.desc("best"), "sgenome")
    out = out.withColumn("genome_rank", F.dense_rank().over(rank))
    return out.withColumn("hits", F.max("genome_rank").over(Window.partitionBy("query"))).drop("best")
