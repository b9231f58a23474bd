"""Masks, captured seeds, seed matches, and genome-level screens built on them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import kmers
from strandline.operators import dealing


#: A k-mer with a higher DUST score is low in complexity.
MAX_DUST = 50
#: Seeds (some 40 bytes each) that a task of Python holds before it passes them on.
HELD_ROWS = 100_000


def generate_masks(spark: SparkSession, k: int, n: int, seed: int = 1) -> DataFrame:
    """masks(mask_id, code): every p-mer with 4**p <= n as a prefix in turn, with random tails; all different."""
    p = 0
    while 4 ** (p + 1) <= n:
        p += 1
    rng, found = np.random.Generator(np.random.PCG64(seed)), {}
    while len(found) < n:
        code = (len(found) % 4**p) << 2 * (k - p) | int(rng.integers(0, 4 ** (k - p)))
        found.setdefault(code, len(found))
    return spark.createDataFrame([(i, c) for c, i in found.items()], "mask_id int, code long")


def captured(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, masks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(mask, kmer, pos, rc) of one sequence, given its kmers.codes(): for each mask the k-mers of either strand with the least XOR."""
    ids, code = masks
    at, fwd, rev = found
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    value, pos, rc = np.concatenate((fwd, rev)), np.concatenate((at, at)), np.repeat([False, True], len(at))
    order = np.argsort(value)
    value, pos, rc = value[order], pos[order], rc[order]
    low, high = least_xor(value, code, 2 * k)
    n = high - low
    pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(ids, n), value[pick], pos[pick], rc[pick]


class Held:
    """Rows (row number, mask, kmer, pos, rc, ...) with the ids of the rows of batch that they come from. They go on by HELD_ROWS, so that memory doesn't follow the rows or
    texts that Spark puts into a batch."""

    def __init__(self, batch: pa.RecordBatch, names: list[str]):
        self.batch, self.names, self.out, self.n = batch, names, [], 0

    def add(self, *parts: tuple[np.ndarray, ...]):
        self.out += parts
        self.n += sum(len(x[0]) for x in parts)
        if self.n >= HELD_ROWS:
            yield from self.rest()

    def rest(self):
        if self.out:
            cols = [np.concatenate(x) for x in zip(*self.out, strict=True)]
            yield pa.RecordBatch.from_arrays([self.batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])], self.names)
        self.out, self.n = [], 0


def _capture(batches, k, masks):
    for batch in batches:
        out = Held(batch, ["id", "mask_id", "kmer", "pos", "rc"])
        for row, s in enumerate(batch.column(1)):
            found = captured(kmers.codes((s.as_py() or "").encode(), k), k, masks)
            yield from out.add((np.full(len(found[0]), row), *found))
        yield from out.rest()


#: Ranges of so many codes are compared one by one.
_FEW = 16


def least_xor(value: np.ndarray, target: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target, the range of value (sorted, not empty, codes of bits bits) with the least XOR: where a range still differs, the part that has the target's
    first differing bit."""
    low, high = np.zeros(len(target), np.int64), np.full(len(target), len(value))
    most = min(len(value).bit_length() - 1, bits)
    for n in range(2 - most % 2, most + 1, 2):  # codes that share the target's first n bits, if there are any
        begin = target >> bits - n << bits - n
        edge = np.searchsorted(value, np.concatenate((begin, begin + (1 << bits - n))))
        a, b = edge[: len(target)], edge[len(target) :]
        low, high = np.where(b > a, a, low), np.where(b > a, b, high)
    wide = lambda at: at[(high[at] - low[at] > _FEW) & (value[low[at]] != value[high[at] - 1])]
    at = wide(np.arange(len(target)))
    while len(at):
        last = value[high[at] - 1]
        top = value[low[at]] ^ last
        for shift in (1, 2, 4, 8, 16, 32):
            if shift < bits:
                top |= top >> shift
        top ^= top >> 1  # the highest bit in which the range differs
        edge = np.searchsorted(value, last & -top)  # first of the range with this bit set
        upper = target[at] & top != 0
        low[at[upper]], high[at[~upper]] = edge[upper], edge[~upper]
        at = wide(at)
    at = np.flatnonzero(value[low] != value[high - 1])
    place = low[at, None] + np.arange(_FEW)
    other = value[np.minimum(place, high[at, None] - 1)] ^ target[at, None]
    least = other == other.min(1, keepdims=True)
    low[at] += least.argmax(1)
    high[at] = low[at] + (least & (place < high[at, None])).sum(1)
    return low, high


def packed_masks(masks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and codes. A mask table has some 10,000 rows at most, whatever the genomes."""
    rows = masks.select("mask_id", "code").orderBy("mask_id").collect()
    return np.array([r["mask_id"] for r in rows], np.int64), np.array([r["code"] for r in rows], np.int64)


def nearest_masks(codes: np.ndarray, masks: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The mask with the least XOR with each code; of equal masks the first."""
    ids, code = masks
    order = np.lexsort((ids, code))
    return ids[order][least_xor(code[order], codes, 2 * k)[0]]


def _reverse(batches, k, masks):
    for batch in batches:
        at = batch.schema.get_field_index("kmer")
        turned = kmers.reverse_codes(batch.column(at).to_numpy(zero_copy_only=False), k)
        batch = batch.set_column(at, "kmer", pa.array(turned))
        yield batch.set_column(batch.schema.get_field_index("mask_id"), "mask_id", pa.array((nearest_masks(turned, masks, k) if len(turned) else turned).astype(np.int32)))


def reversed_seeds(found: DataFrame, masks: DataFrame, k: int) -> DataFrame:
    """Seeds (mask_id, kmer, ...) with the bases of each k-mer in reverse order, under the mask that is nearest to it then: prefixes of these are
    suffixes of the k-mers. Places that several masks captured come once."""
    packed = packed_masks(masks)
    return found.mapInArrow(lambda b: _reverse(b, k, packed), found.schema).distinct()


def _index_seeds(batches, k, masks, gap, step, reach):
    flat = np.array([kmers.homopolymer(b, k) for b in "ACGT" if (k - 2) * (k - 3) // 2 <= MAX_DUST])  # longer ones are low in complexity anyway
    for batch in batches:
        out = Held(batch, ["id", "mask_id", "kmer", "pos", "rc", "rev"])
        for row, text in enumerate(batch.column(1)):
            seq = text.as_py()
            raw = (seq or "").encode()
            own, dust = kmers.codes(raw, k), kmers.dust_at(raw, k)
            found = captured(own, k, masks)
            low = dust[found[2]] > MAX_DUST
            if len(flat):
                low |= np.isin(found[1], flat)
            found = [x[~low] for x in found]
            more = desert_seeds(seq or "", np.unique(found[2]).tolist(), k, masks, gap, step, reach, known=(own, dust))
            if more:
                found = [np.concatenate((x, np.array(y, x.dtype))) for x, y in zip(found, zip(*more, strict=True), strict=True)]
            # Reversed copies: a place that several masks captured comes once, since its k-mer has one nearest mask.
            _, once = np.unique(found[2] * 2 + found[3], return_index=True)
            turned = kmers.reverse_codes(found[1][once], k)
            back = (nearest_masks(turned, masks, k), turned, found[2][once], found[3][once])
            yield from out.add(*((np.full(len(part[0]), row), *part, np.full(len(part[0]), bool(n))) for n, part in enumerate((found, back))))
        yield from out.rest()


def index_seeds(df: DataFrame, id_col: str, seq_col: str, masks: DataFrame, k: int, gap: int = 100, step: int = 50, reach: int = 25) -> DataFrame:
    """(id, mask_id, kmer, pos, rc, rev): captured seeds without homopolymers and low complexity, those that desert_seeds() adds, and the reversed copies of both (rev),
    for suffix matches. A sequence's seeds depend on it alone: one pass, no shuffle."""
    packed = packed_masks(masks)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, seq_col).mapInArrow(lambda b: _index_seeds(b, k, packed, gap, step, reach), f"id {kind}, mask_id int, kmer long, pos long, rc boolean, rev boolean").withColumnRenamed("id", id_col)


def desert_seeds(seq: str, places: list[int], k: int, masks: tuple[np.ndarray, np.ndarray], gap: int = 100, step: int = 50, reach: int = 25, flank: int = 1000, max_dust: int = MAX_DUST, known=None):
    """Seeds (mask, kmer, pos, rc) for stretches of at least gap bases without any. Around each stretch the masks capture anew; every step bases the
    nearest captured k-mer within reach bases, back first, is taken: forward strand before reverse, no homopolymers or low complexity. known: kmers.codes() and kmers.dust_at() of seq, if they are known."""
    last, out = len(seq) - k, []
    if last < 0:
        return out
    ids, code = masks
    edges = [0, *sorted(places), last]
    (all_at, all_fwd, all_rev), dust = known or (kmers.codes(seq.encode(), k), kmers.dust_at(seq.encode(), k))
    for before, after in zip(edges, edges[1:], strict=False):
        if after - before < gap:
            continue
        low = max(0, before - flank)
        own = slice(*np.searchsorted(all_at, (low, after + flank + 1)))
        at, fwd, rev = all_at[own], all_fwd[own], all_rev[own]
        if not len(at):
            continue
        value, pos, rc = np.concatenate((fwd, rev)), np.concatenate((at, at)), np.repeat([False, True], len(at))
        order = np.argsort(value)
        first, end = least_xor(value[order], code, 2 * k)
        n = end - first
        picked = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        # The places that the stretch may take, forward strand first, each with the first mask that captured it.
        inside = (pos[picked] > before - reach) & (pos[picked] < after + reach)
        picked, mask = picked[inside], np.repeat(ids, n)[inside]
        once = np.unique(pos[picked] * 2 + rc[picked], return_index=True)[1]
        once = once[dust[pos[picked[once]]] <= max_dust]
        picked, mask = picked[once], mask[once].tolist()
        place, strand, kmer = pos[picked].tolist(), rc[picked].tolist(), value[picked].tolist()
        j = before + step
        while j < after:
            i = bisect_right(place, j) - 1
            if i >= 0 and place[i] > max(before, j - reach):
                i = bisect_left(place, place[i])
            else:
                i += 1
                if i == len(place) or place[i] >= min(after, j + reach):
                    j += reach + step
                    continue
            out.append((mask[i], kmer[i], place[i], strand[i]))
            j = place[i] + step
    return out


def capture(df: DataFrame, id_col: str, seq_col: str, masks: DataFrame, k: int) -> DataFrame:
    """(id, mask_id, kmer, pos, rc): for each mask the k-mer of the sequence, on either strand, that has the least XOR with it; all its places.
    masks is a table of at most some 10,000 rows, whatever the genomes, and is sent to all tasks."""
    packed = packed_masks(masks)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, seq_col).mapInArrow(lambda b: _capture(b, k, packed), f"id {kind}, mask_id int, kmer long, pos long, rc boolean").withColumnRenamed("id", id_col)


def mask_subset(masks: DataFrame, k: int, n: int) -> DataFrame:
    """The first mask of each prefix of log4(n) bases."""
    p = (n.bit_length() - 1) // 2
    if 4**p != n:
        raise ValueError("n must be a power of 4")
    w = Window.partitionBy(kmers.prefix(F.col("code"), k, p)).orderBy("mask_id")
    return masks.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def match(queries: DataFrame, seeds: DataFrame, k: int, p: int, on: list[str], code: str = "kmer") -> DataFrame:
    """Pairs of seeds with a common prefix of p bases or more: an equi-join on the prefix, then the exact length. Columns of seeds get s_ in front."""
    left = queries.withColumn("prefix", kmers.prefix(F.col(code), k, p))
    right = seeds.select(*(F.col(c).alias(c if c in on else f"s_{c}") for c in seeds.columns)).withColumn("prefix", kmers.prefix(F.col(f"s_{code}"), k, p))
    return left.join(right, [*on, "prefix"]).withColumn("len", kmers.common_prefix(F.col(code), F.col(f"s_{code}"), k)).drop("prefix")


def first_places(seeds: DataFrame, keys: list[str], pos: str, n: int) -> DataFrame:
    """At most n places of each k-mer of a genome, the first ones: the option against very frequent k-mers."""
    return seeds.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where(F.col("place") <= n).drop("place")


def screen(matches: DataFrame, query: str, genome: str, mask: str, n_masks: int) -> DataFrame:
    """(query, genome, nMasks, fracMasks, sumPrefix, avgPrefix, prefixes): the longest prefix of each mask, summed up by genome."""
    best = matches.groupBy(query, genome, mask).agg(F.max("len").alias("len"))
    return best.groupBy(query, genome).agg(F.count(F.lit(1)).alias("nMasks"), (F.count(F.lit(1)) / n_masks).alias("fracMasks"), F.sum("len").alias("sumPrefix"), F.avg("len").alias("avgPrefix"), F.array_join(F.sort_array(F.collect_list("len"), asc=False), ",").alias("prefixes"))


def screen_masks(matches: DataFrame, query: str, genome: str, mask: str) -> DataFrame:
    """(query, genome, mask, hits, longest, score): matches of each mask (255 at most), its longest prefix, and the bases of all its matches; score sums up
    over the masks to that of the genome."""
    hits = F.least(F.count(F.lit(1)), F.lit(255)).alias("hits")
    return matches.groupBy(query, genome, mask).agg(hits, F.max("len").alias("longest"), F.sum("len").alias("score"))


def not_low(df: DataFrame, code: str, k: int) -> DataFrame:
    """Rows whose k-mer is neither one base only nor low in complexity."""
    return df.where(~kmers.low_complexity(F.col(code), k))


def prefix_groups(df: DataFrame, code: str, k: int, p: int) -> DataFrame:
    """(prefix, n, first, last, common): distinct k-mers by their first p bases, two or more each, and the bases that all of a group share. Least and
    greatest code settle the latter, so no pair is formed."""
    g = df.select(code).distinct().groupBy(kmers.prefix(F.col(code), k, p).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("first"), F.max(code).alias("last"))
    return g.where("n > 1").withColumn("common", kmers.common_prefix(F.col("first"), F.col("last"), k))


def regroup_chunks(df: DataFrame, genome: str, chunks: DataFrame, sums: list[str]) -> DataFrame:
    """Rows of a genome's chunks as one row of the genome. chunks: (genome, chunk_group); a genome that is not in it stands for itself."""
    named = df.join(chunks.select(genome, "chunk_group"), genome, "left").withColumn(genome, F.coalesce("chunk_group", genome))
    return named.groupBy(genome).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums))


def ranked_ani(df: DataFrame, query: str, genome: str, ani: str = "ani", afq: str = "afq", afs: str = "afs") -> DataFrame:
    """rank of each genome of a query: by identity, then the query's and the subject's aligned fraction, all descending, then the genome."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(ani), F.desc(afq), F.desc(afs), genome)))


def sized(df: DataFrame, length: str, least: int = 0, most: int = 0) -> DataFrame:
    """Genomes of at least least bases (a fragment's size, say) and at most most, if that is given."""
    kept = df.where(F.col(length) >= least)
    return kept.where(F.col(length) <= most) if most else kept


def subseq_joined(contigs: DataFrame, regions: DataFrame, genome: str, order: str, seq: str, gap: int = 0) -> DataFrame:
    """regions (genome, start, end; 0-based, inclusive, in the coordinates of the genome's contigs joined in order with gap N between two) with subseq. Bounds are
    clamped to the genome; a region beyond it gets an empty text. Each contig gives its own part, so that no genome is put together."""
    w = Window.partitionBy(genome).orderBy(order)
    last = F.lead(order).over(w).isNull()
    part = contigs.select(genome, order, F.when(last, F.col(seq)).otherwise(F.concat(F.col(seq), F.lit("N" * gap))).alias("_part"))
    part = part.withColumn("_at", F.coalesce(F.sum(F.length("_part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = regions.join(part, genome)
    from_, to = F.greatest(F.col("start"), F.lit(0), F.col("_at")), F.least(F.col("end"), F.col("_at") + F.length("_part") - 1)
    piece = F.when(from_ <= to, F.substring(F.col("_part"), (from_ - F.col("_at") + 1).cast("int"), (to - from_ + 1).cast("int"))).otherwise("")
    pieces = both.groupBy(*regions.columns).agg(F.sort_array(F.collect_list(F.when(piece != "", F.struct(F.col("_at"), piece.alias("p"))))).alias("_p"))
    return pieces.select(*regions.columns, F.array_join("_p.p", "").alias("subseq"))


def pairs(seeds: DataFrame, genome: str, mask: str, k: int, p: int, n_masks: int, min_fraction: float) -> DataFrame:
    """Genome pairs with g1 < g2 that share seeds of p bases in enough masks. Exact: nothing is pruned early."""
    s = seeds.select(genome, mask, "kmer").distinct().withColumn("prefix", kmers.prefix(F.col("kmer"), k, p))
    a, b = s.select(F.col(genome).alias("g1"), mask, "prefix", "kmer"), s.select(F.col(genome).alias("g2"), mask, "prefix", F.col("kmer").alias("other"))
    joined = a.join(b, [mask, "prefix"]).where("g1 < g2").withColumn("len", kmers.common_prefix(F.col("kmer"), F.col("other"), k))
    best = joined.groupBy("g1", "g2", mask).agg(F.max("len").alias("len"))
    out = best.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("nMasks"), F.sum("len").alias("sumPrefix"), F.avg("len").alias("avgPrefix"))
    return out.withColumn("fracMasks", F.col("nMasks") / n_masks).where(F.col("nMasks") >= int(min_fraction * n_masks))


#: Pairs of left and right that one task makes or counts, about.
TASK_PAIRS = 2_000_000


def shared(a: DataFrame, b: DataFrame, code: str, left: str, right: str, least: int = 1) -> DataFrame:
    """(left, right, n): distinct k-mers in common. The pairs are counted first by the k-mers' numbers of rows on both sides, and made and counted by as many tasks as they
    need; a and b are read twice for that, so they should be tables or near it. If a single k-mer has more pairs than a task should make, Spark splits the skewed join."""
    a, b = (dealing.by_rows(x.select(c, code), c, code).distinct() for x, c in ((a, left), (b, right)))
    n = a.groupBy(code).agg(F.count(F.lit(1)).alias("_n")).join(b.groupBy(code).agg(F.count(F.lit(1)).alias("_m")), code).select((F.col("_n") * F.col("_m")).alias("_p"))
    total, most = n.agg(F.coalesce(F.sum("_p"), F.lit(0)), F.coalesce(F.max("_p"), F.lit(0))).first()
    parts = dealing.tasks(a, total, TASK_PAIRS)
    if most <= TASK_PAIRS:
        a, b = a.repartition(parts, code), b.repartition(parts, code)
    joined = a.join(b, code).select(left, right).repartition(parts, left, right)
    return joined.groupBy(left, right).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def query_coverage(a: DataFrame, b: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """(left, right, n, covered): shared distinct k-mers and bases of the query that they cover."""
    known = b.select(right, "kmer").join(a.select("kmer").distinct(), "kmer", "left_semi").distinct()  # few of b's k-mers are left to be made distinct
    hits = a.select(left, "kmer", "pos").join(known, "kmer")
    w = Window.partitionBy(left, right).orderBy("pos")
    step = F.least(F.lit(k), F.col("pos") - F.lag("pos").over(w))
    return hits.withColumn("step", F.coalesce(step, F.lit(k))).groupBy(left, right).agg(F.count_distinct("kmer").alias("n"), F.sum("step").cast("long").alias("covered"))


def reciprocal(hits: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are each other's best hit (ties: smaller partner)."""
    best = lambda key, other, name: hits.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), other)))
    x = best(a, b, "r1").where("r1 = 1").select(a, b, score)
    y = best(b, a, "r2").where("r2 = 1").select(a, b)
    return x.join(y, [a, b])


def ancestors(tree: DataFrame, node: str, parent: str, depth: int = 64) -> DataFrame:
    """(node, ancestor) pairs, the node itself included, by doubling: as many joins as the depth has binary digits."""
    out = tree.select(F.col(node).alias("node"), F.col(node).alias("ancestor")).union(tree.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(node, parent)).distinct()
    for _ in range(depth.bit_length()):
        wider = out.join(out.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("node", F.col("above").alias("ancestor")).distinct()
        if wider.count() == out.count():
            break
        out = wider
    return out


def by_taxon(df: DataFrame, taxon: str, closure: DataFrame, include: list[int], exclude: list[int], keep_unknown: bool = False) -> DataFrame:
    """Rows whose taxon lies under one of include (if any are given) and under none of exclude. Rows without taxon stay only if keep_unknown, whichever list is given."""
    if (include or exclude) and not keep_unknown:
        df = df.where(F.col(taxon).isNotNull())
    if include:
        inside = closure.where(F.col("ancestor").isin(include)).select(F.col("node").alias(taxon)).distinct()
        kept = df.join(inside, taxon, "left_semi")
        df = kept.unionByName(df.where(F.col(taxon).isNull())) if keep_unknown else kept
    if exclude:
        df = df.join(closure.where(F.col("ancestor").isin(exclude)).select(F.col("node").alias(taxon)).distinct(), taxon, "left_anti")
    return df


def best_first(*columns: str) -> list[Column]:
    return [F.desc(c) for c in columns]
