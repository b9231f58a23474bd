"""The index: genomes, contigs, masks and captured seeds as tables, and the utilities that read them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import kmers
from strandline.operators import intervals, seeds

#: Runs of so many N are gaps, which no seed crosses.
GAP = 5


@dataclass(frozen=True)
class Options:
    k: int = 31
    masks: int = 1024
    seed: int = 1
    min_length: int = 31
    max_genome: int = 20_000_000
    contig_interval: int = 1000
    chunks: int = 16
    max_desert: int = 100
    desert_step: int = 50

    def __post_init__(self):
        if not 10 <= self.k <= kmers.MAX_K:
            raise ValueError("k must be from 10 to 31")
        if self.desert_step < 1 or self.max_desert <= self.desert_step:
            raise ValueError("desert_step must be 1 or more and below max_desert")
        if self.masks < 4 or self.chunks < 1 or self.min_length < 1:
            raise ValueError("masks must be 4 or more, chunks and min_length 1 or more")


def valid_contigs(records: DataFrame, options: Options, exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Records (genome_id, seq_idx, seq_id, seq) as contigs with offsets, and the genomes left out (genome_id, reason)."""
    least = max(options.k, options.min_length)
    big = F.max(F.length("seq")).over(Window.partitionBy("genome_id"))
    kept = records.withColumn("largest", big).where(F.length("seq") >= least)
    for pattern in exclude:
        kept = kept.where(~F.col("seq_id").rlike(f"(?i){pattern}"))
    fine = kept.where(F.col("largest") <= options.max_genome)
    w = Window.partitionBy("genome_id").orderBy("seq_idx")
    offset = F.coalesce(F.sum(F.length("seq") + options.contig_interval).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    contigs = fine.select("genome_id", "seq_idx", "seq_id", F.length("seq").alias("seq_len"), offset.alias("offset_start"), (offset + F.length("seq") - 1).alias("offset_end"), kmers.plain_bases(F.col("seq"), gap=GAP).alias("seq"))
    state = records.withColumn("ok", F.length("seq") >= least).groupBy("genome_id").agg(F.max(F.length("seq")).alias("largest"), F.max("ok").alias("ok"))
    skipped = state.where(~F.col("ok") | (F.col("largest") > options.max_genome)).select("genome_id", F.when(F.col("ok"), "too_large_genome").otherwise("no_valid_seqs").alias("reason"))
    return contigs, skipped


def chunked(contigs: DataFrame, most: int) -> DataFrame:
    """chunk_idx of each contig: a genome's contigs in order; one with which the chunk would be longer than most begins the next, whose length begins anew. A null
    length counts as none. Lengths alone are sorted, and read in order by one task a genome in bounded memory."""
    kinds = [contigs.schema[c].dataType.simpleString() for c in ("genome_id", "seq_idx")]

    def fold(batches):
        genome, run, chunk = None, 0, 0
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name, n in zip(names, batch.column(2).to_pylist(), strict=True):
                n = n or 0
                if name != genome:
                    genome, run, chunk = name, 0, 0
                elif run + n > most:
                    run, chunk = 0, chunk + 1
                run += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["genome_id", "seq_idx", "chunk_idx"])

    ordered = contigs.select("genome_id", "seq_idx", F.col("seq_len").cast("long")).repartition("genome_id").sortWithinPartitions("genome_id", "seq_idx")
    return contigs.join(ordered.mapInArrow(fold, f"genome_id {kinds[0]}, seq_idx {kinds[1]}, chunk_idx int"), ["genome_id", "seq_idx"])


class Index:
    """Tables contigs(genome_id, seq_idx, seq_id, seq_len, offset_start, offset_end, seq), masks(mask_id, code) and
    seeds(mask_id, kmer, genome_id, seq_idx, pos, rc, rev). rev marks seeds whose bases stand in reverse order, for suffix matches."""

    def __init__(self, options: Options, contigs: DataFrame, masks: DataFrame, seed_rows: DataFrame):
        self.options, self.contigs, self.mask_rows, self.seeds = options, contigs, masks, seed_rows

    @classmethod
    def build(cls, records: DataFrame, options: Options = Options(), masks: DataFrame | None = None, exclude: list[str] = ()) -> Index:
        """exclude: patterns of contig names that are left out. The index's skipped lists the genomes left out, with reasons."""
        contigs, skipped = valid_contigs(records, options, exclude)
        masks = seeds.generate_masks(records.sparkSession, options.k, options.masks, options.seed) if masks is None else masks
        keyed = contigs.select(F.struct("genome_id", "seq_idx").alias("id"), "seq")
        found = seeds.index_seeds(keyed, "id", "seq", masks, options.k, options.max_desert, options.desert_step, options.desert_step // 2)
        index = cls(options, contigs, masks, found.select("mask_id", "kmer", "id.genome_id", "id.seq_idx", "pos", "rc", "rev"))
        index.skipped = skipped
        return index

    def places(self) -> DataFrame:
        """Seeds in the order of their bases: each captured place, without the reversed copies."""
        return self.seeds.where(~F.col("rev"))

    def save(self, path: str, force: bool = False) -> None:
        mode = "overwrite" if force else "errorifexists"
        self.contigs.write.mode(mode).parquet(f"{path}/contigs")
        self.mask_rows.coalesce(1).write.mode(mode).parquet(f"{path}/masks")
        laid = self.seeds.withColumn("mask_chunk", F.col("mask_id") % self.options.chunks)
        laid.repartition("mask_chunk", F.col("mask_id")).sortWithinPartitions("mask_id", "kmer").write.mode(mode).partitionBy("mask_chunk").parquet(f"{path}/seeds")
        self.seeds.sparkSession.createDataFrame([(json.dumps(asdict(self.options) | {"format_version": 2}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        info = json.loads(spark.read.text(f"{path}/info").first()["value"])
        if info.pop("format_version") != 2:
            raise ValueError("this index has another format")
        return cls(Options(**info), spark.read.parquet(f"{path}/contigs"), spark.read.parquet(f"{path}/masks"), spark.read.parquet(f"{path}/seeds").drop("mask_chunk"))

    def genomes(self) -> DataFrame:
        return self.contigs.groupBy("genome_id").agg(F.sum("seq_len").alias("genome_size"), F.count(F.lit(1)).alias("num_seqs"), (F.max("offset_end") + 1).alias("concat_len"))

    def total_bases(self) -> int:
        return self.contigs.agg(F.sum("seq_len")).first()[0] or 0

    def genome_details(self) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("seq_idx", "seq_len", "seq_id")))
        g = self.contigs.groupBy("genome_id").agg(F.sum("seq_len").alias("genome_size"), F.count(F.lit(1)).alias("seqs"), ordered.alias("s"))
        return g.select("genome_id", "genome_size", "seqs", F.array_join("s.seq_len", ",").alias("seqsizes"), F.array_join("s.seq_id", ",").alias("seqids"))

    def genome_seqs(self, genome_id: str) -> DataFrame:
        return self.contigs.where(F.col("genome_id") == genome_id).orderBy("seq_idx").select("seq_id", "seq")

    def kmers(self, mask_id: int | None = None, only_forward: bool = False) -> DataFrame:
        rows = self.places() if mask_id is None else self.places().where(F.col("mask_id") == mask_id)
        rows = rows.where(~F.col("rc")) if only_forward else rows
        masks = self.mask_rows.select("mask_id", "code")
        return rows.join(F.broadcast(masks), "mask_id").withColumn("prefix", kmers.common_prefix(F.col("kmer"), F.col("code"), self.options.k)).withColumn("kmer_seq", kmers.decode(F.col("kmer"), self.options.k)).drop("code")

    def masks(self) -> DataFrame:
        return self.mask_rows.withColumn("kmer_seq", kmers.decode(F.col("code"), self.options.k))

    def seed_positions(self, genomes: list[str] | None = None, min_distance: int = 0) -> DataFrame:
        rows = self.places() if genomes is None else self.places().where(F.col("genome_id").isin(genomes))
        rows = rows.select("genome_id", "seq_idx", "pos", "rc").distinct()
        out = intervals.gaps_to_previous(rows, ["genome_id", "seq_idx"], "pos")
        return out.where(F.coalesce("distance", F.lit(0)) >= min_distance)

    def seed_window_counts(self, size: int = 250, step: int = 100, max_gap: int = 0) -> DataFrame:
        """Seeds in the windows of each contig. max_gap: windows with a seed that stands further than that behind the one before are left out."""
        places = self.places().select("genome_id", "seq_idx", "pos").distinct()
        keys = ["genome_id", "seq_idx"]
        if not max_gap:
            return intervals.sliding_counts(places, keys, "pos", size, step)
        wide = F.coalesce(F.col("distance") > max_gap, F.lit(False))
        return intervals.sliding_counts(intervals.gaps_to_previous(places, keys, "pos").withColumn("gap", wide), keys, "pos", size, step, "gap")

    def subseq(self, regions: DataFrame) -> DataFrame:
        """regions(genome_id, seq_id, start, end, strand), from 1: with the subsequence, ends cut at the contig's."""
        joined = regions.join(self.contigs.select("genome_id", "seq_id", "seq", "seq_len"), ["genome_id", "seq_id"])
        start, end = F.greatest(F.lit(1), F.col("start")), F.least(F.col("seq_len"), F.col("end"))
        cut = F.substring(F.col("seq"), start.cast("int"), (end - start + 1).cast("int"))
        return joined.select(*regions.columns[:2], start.alias("start"), end.alias("end"), "strand", F.when(F.col("strand") == "-", kmers.reverse_complement(cut)).otherwise(cut).alias("subseq"))

    def subseq_of_hits(self, hsps: DataFrame, up: int = 0, down: int = 0) -> DataFrame:
        forward = F.col("sstr") == "+"
        regions = hsps.select(F.col("sgenome").alias("genome_id"), F.col("sseqid").alias("seq_id"), (F.least("sstart", "send") - F.when(forward, up).otherwise(down)).alias("start"), (F.greatest("sstart", "send") + F.when(forward, down).otherwise(up)).alias("end"), F.col("sstr").alias("strand"))
        return self.subseq(regions)

    def search(self, queries: DataFrame, options=None) -> DataFrame:
        """Alignments of queries(query, seq): see plans.search.search()."""
        from strandline.plans import search

        return search.search(self, queries, options or search.SearchOptions())

    def genome_search(self, genomes: DataFrame, mode: str = "sampled", **options) -> DataFrame:
        """Genomes (contigs) against this index: see plans.search.genome_search()."""
        from strandline.plans import search

        return search.genome_search(self, genomes, mode, **options)

    def pair(self, min_prefix: int = 17, min_fraction: float = 0.01) -> DataFrame:
        """Pairs of this index's genomes that share seeds, those with most masks first."""
        out = seeds.pairs(self.places(), "genome_id", "mask_id", self.options.k, min_prefix, self.options.masks, min_fraction)
        return out.orderBy(F.desc("nMasks"), F.desc("sumPrefix"), "g1", "g2")

    def rename_genomes(self, pattern: str, replacement: str) -> Index:
        new: Column = F.substring(F.regexp_replace("genome_id", pattern, replacement), 1, 65535)
        named = F.when(F.length(new) > 0, new).otherwise(F.raise_error(F.lit("a genome would have an empty id")))
        return Index(self.options, self.contigs.withColumn("genome_id", named), self.mask_rows, self.seeds.withColumn("genome_id", named))

    def repartition_seeds(self, n: int) -> Index:
        return Index(self.options, self.contigs, self.mask_rows, self.seeds.repartition(n, "mask_id").sortWithinPartitions("mask_id", "kmer"))

    def merge(self, other: Index) -> Index:
        if self.options != other.options:
            raise ValueError("indexes with different options can't be merged")
        return Index(self.options, self.contigs.unionByName(other.contigs), self.mask_rows, self.seeds.unionByName(other.seeds))
