"""Sinks: tab-separated results, FASTA, SAM and pairwise text. All are written by Spark tasks; an existing folder is an error unless force is set."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import alignment


def mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def tsv(df: DataFrame, path: str, force: bool = False, compression: str = "none") -> None:
    formats = {"qcovGnm": "%.3f", "qcovHSP": "%.3f", "pident": "%.3f", "evalue": "%.2e"}
    df.select(*(F.format_string(formats[c], c).alias(c) if c in formats else F.col(c) for c in df.columns)).write.mode(mode(force)).csv(path, sep="\t", header=True, compression=compression)


def wrapped(seq: Column, width: int = 60) -> Column:
    """Lines of width characters; 0 leaves one line."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n")) if width else seq


def fasta_text(df: DataFrame, header: Column, seq: Column, width: int = 60) -> DataFrame:
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), wrapped(seq, width)).alias("value"))


def sam_records(hsps: DataFrame) -> DataFrame:
    """SAM fields of alignments with cigar, qseq. The first alignment of a query (by bit score) is primary."""
    w = Window.partitionBy("query").orderBy(F.desc("bitscore"), "sgenome", "sseqid", "sstart", "qstart")
    score = alignment.score_of_bits(F.col("bitscore"))
    ranked = hsps.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead(score).over(w))
    second = F.max(F.when(F.col("n") == 1, F.col("second"))).over(Window.partitionBy("query"))
    quality = alignment.mapq(score, second, F.col("qcovHSP") / 100, F.col("pident") / 100, F.col("gaps") / F.col("alenHSP"))
    return ranked.select(F.col("query").alias("QNAME"), alignment.sam_flag(F.col("sstr") == "-", F.col("n") > 1).alias("FLAG"), F.col("sseqid").alias("RNAME"), F.least("sstart", "send").alias("POS"), F.when(F.col("n") == 1, quality).otherwise(0).alias("MAPQ"), alignment.soft_clip(alignment.swap_indels(F.col("cigar")), F.col("qstart"), F.col("qend"), F.col("qlen")).alias("CIGAR"), F.lit("*").alias("RNEXT"), F.lit(0).alias("PNEXT"), F.lit(0).alias("TLEN"), F.concat(F.expr("repeat('N', qstart - 1)"), F.replace("qseq", F.lit("-"), F.lit("")), F.expr("repeat('N', qlen - qend)")).alias("SEQ"), F.lit("*").alias("QUAL"), alignment.edit_distance(F.col("cigar")).alias("NM"), score.alias("AS"))


def sam_header(hsps: DataFrame) -> DataFrame:
    """One @SQ line for each reference."""
    return hsps.groupBy("sseqid").agg(F.max("slen").alias("slen")).select(F.concat(F.lit("@SQ\tSN:"), "sseqid", F.lit("\tLN:"), F.col("slen").cast("string")).alias("value"))


def _blocks(batches, width: int):
    for batch in batches:
        names = ["qseq", "align", "sseq", "qstart", "sstart", "send", "sstr"]
        texts = []
        for row in range(batch.num_rows):
            q, marks, s, at, first, last, strand = (batch.column(n)[row].as_py() for n in names)
            sign, blocks = -1 if strand == "-" else 1, []
            to = last if strand == "-" else first
            for i in range(0, max(len(q), 1), width):
                a, b = q[i : i + width], s[i : i + width]
                end, upto = at + len(a) - a.count("-"), to + sign * (len(b) - b.count("-"))
                blocks.append(f"Query  {at:<9d} {a} {end - 1}\n{' ' * 17}{marks[i : i + width]}\nSbjct  {to:<9d} {b} {upto - sign}\n")
                at, to = end, upto
            texts.append("\n".join(blocks))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("query", "sgenome", "sseqid", "hsp")), pa.array(texts, pa.string())], ["query", "sgenome", "sseqid", "hsp", "value"])


def pairwise_text(hsps: DataFrame, width: int = 60) -> DataFrame:
    """Blocks of query, match marks and subject with running coordinates, one row for an alignment. Each alignment is read once from its begin to its end."""
    plain = hsps.select("query", "sgenome", "sseqid", "hsp", "qseq", "align", "sseq", "qstart", "sstart", "send", "sstr")
    kinds = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns[:4])
    return plain.mapInArrow(partial(_blocks, width=width), f"{kinds}, value string")
