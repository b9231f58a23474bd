"""Readers: FASTA and FASTQ files (plain, gzip, bzip2, xz by their first bytes), result tables, pair and annotation lists, taxonomy."""

from __future__ import annotations

import bz2
import gzip
import lzma
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_SCHEMA = "path string, file_id string, seq_idx int, seq_id string, description string, seq string, quality string"
#: Columns of a table of alignments, in order; the last four are optional.
HSP_SCHEMA = "query string, qlen int, hits int, sgenome string, sseqid string, qcovGnm double, cls int, hsp int, qcovHSP double, alenHSP int, pident double, gaps int, qstart int, qend int, sstart int, send int, sstr string, slen int, evalue double, bitscore int"
ALIGNED = ", cigar string, qseq string, sseq string, align string"


def unpack(raw: bytes) -> bytes:
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(raw)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw


def parse(text: str):
    """(id, description, sequence, quality) of each record."""
    lines = text.splitlines()
    k = 0
    while k < len(lines):
        line = lines[k]
        if line.startswith(">"):
            end = k + 1
            while end < len(lines) and not lines[end].startswith(">"):
                end += 1
            name, _, rest = line[1:].partition(" ")
            yield name, rest, "".join(x.strip() for x in lines[k + 1 : end]), None
            k = end
        elif line.startswith("@") and k + 3 < len(lines):
            name, _, rest = line[1:].partition(" ")
            yield name, rest, lines[k + 1].strip(), lines[k + 3].strip()
            k += 4
        else:
            k += 1


def _records(batches, pattern):
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = re.sub(r"\.(gz|bz2|xz|zst)$", "", path.rsplit("/", 1)[-1])
            found = re.search(pattern, base)
            name = (found.group(1) if found.groups() else found.group(0)) if found else re.sub(r"\.[^.]*$", "", base)
            rows = [(path, name, k, *r) for k, r in enumerate(parse(unpack(raw).decode()))]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "file_id", "seq_idx", "seq_id", "description", "seq", "quality"])


def sequences(spark: SparkSession, path: str | list[str], glob: str | None = None, name_regexp: str = r"(?i)^(.+)\.(?:f[aq](?:st[aq])?|fna)$") -> DataFrame:
    """Records of sequence files. One file is one task's work at least; file_id is group 1 of name_regexp, else the name without its extension."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content").mapInArrow(lambda b: _records(b, name_regexp), RECORD_SCHEMA)


def files_matching(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths under a directory whose file name matches, whatever the case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return found.where(F.element_at(F.split("path", "/"), -1).rlike(f"(?i){pattern}"))


def file_list(spark: SparkSession, path: str) -> list[str]:
    return [r["value"].strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def results(spark: SparkSession, path: str, aligned: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=HSP_SCHEMA + (ALIGNED if aligned else ""))


def pair_list(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    table = spark.read.csv(path, sep="\t", header=header)
    return table.select(F.col(table.columns[0]).alias("genome1"), F.col(table.columns[1]).alias("genome2"))


def key_values(spark: SparkSession, path: str, ignore_case: bool = False) -> DataFrame:
    kv = spark.read.csv(path, sep="\t", schema="key string, value string")
    return kv.withColumn("key", F.lower("key")) if ignore_case else kv


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent) of a nodes.dmp file."""
    parts = F.split("value", r"\t\|\t")
    return spark.read.text(path).select(parts[0].cast("long").alias("taxid"), parts[1].cast("long").alias("parent"))


def masks(spark: SparkSession, path: str) -> DataFrame:
    """(mask_id, code) of a text file with a k-mer in the last column of each line."""
    from strandline.functions import kmers

    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("n")).alias("mask_id"), kmers.encode(F.element_at(F.split(F.trim("value"), r"\s+"), -1)).alias("code"))
