"""Readers and writers on small files, and the search of a file stream."""

import bz2
import gzip
import lzma
import random

import pytest
import zstandard

from strandline.plans.index import Index, Options, chunked, valid_contigs
from strandline.plans.search import SearchOptions, ani, search
from strandline.sources import readers, writers
from strandline.streaming.search import search_stream

FASTA = b">s1 first one\nACGT\nAC\n\n>s2\nGGTT\n"
FASTQ = b"@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n!!\n"


def test_sequences_of_all_packings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.fasta": FASTA, "b.fa.gz": gzip.compress(FASTA), "c.fna.bz2": bz2.compress(FASTA), "sub/d.fa.xz": lzma.compress(FASTA), "e.fa.zst": zstandard.compress(FASTA), "f.fq.gz": gzip.compress(FASTQ), "empty.fa": b""}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = readers.sequences(spark, f"file://{tmp_path}").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["seq_idx"]):
        found.setdefault(r["file_id"], []).append((r["seq_id"], r["description"], r["seq"], r["quality"]))
    fasta = [("s1", "first one", "ACGTAC", None), ("s2", "", "GGTT", None)]
    assert found == {k: fasta for k in "abcde"} | {"f": [("r1", "x", "ACGT", "IIII"), ("r2", "", "GG", "!!")]}
    named = readers.files_matching(spark, f"file://{tmp_path}", r"\.FA\.(gz|xz)$").collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in named) == ["b.fa.gz", "d.fa.xz"]


def test_small_tables(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    (tmp_path / "pairs.tsv").write_text("g1\tg2\tx\ng3\tg4\ty\n")
    (tmp_path / "kv.tsv").write_text("Ab\t1\nc\t2\n")
    (tmp_path / "masks.txt").write_text("1\tACGTA\n2\tTTTTT\n")
    (tmp_path / "files.txt").write_text("x.fa\n\ny.fa\n")
    at = f"file://{tmp_path}"
    assert [tuple(r) for r in readers.taxonomy(spark, f"{at}/nodes.dmp").collect()] == [(1, 1), (2, 1)]
    assert [tuple(r) for r in readers.pair_list(spark, f"{at}/pairs.tsv").collect()] == [("g1", "g2"), ("g3", "g4")]
    assert [tuple(r) for r in readers.key_values(spark, f"{at}/kv.tsv", ignore_case=True).collect()] == [("ab", "1"), ("c", "2")]
    assert [tuple(r) for r in readers.masks(spark, f"{at}/masks.txt").collect()] == [(1, int("01230", 4)), (2, 4**5 - 1)]
    assert readers.file_list(spark, f"{at}/files.txt") == ["x.fa", "y.fa"]


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(8)
    return "".join(rng.choice("ACGT") for _ in range(2500))


@pytest.fixture(scope="module")
def index(spark, genome):
    records = spark.createDataFrame([("g1", 0, "c0", genome)], "genome_id string, seq_idx int, seq_id string, seq string")
    return Index.build(records, Options(k=21, masks=256, min_length=21))


def test_result_files(spark, index, genome, tmp_path):
    part = genome[500:800]
    part = part[:100] + part[103:200] + ("A" if part[200] != "A" else "C") + part[201:]
    back = part.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    found = search(index, spark.createDataFrame([("f", part), ("r", back)], "query string, seq string"), SearchOptions(min_prefix=15)).cache()
    out = f"file://{tmp_path}/hits"
    plain = found.drop("genome_rank", "cigar", "qseq", "sseq", "align")
    writers.tsv(plain, out)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.tsv(plain, out)
    again = readers.results(spark, out)
    assert again.columns == plain.columns and sorted(r["query"] for r in again.collect()) == ["f", "r"]
    sam = {r["QNAME"]: r for r in writers.sam_records(found).collect()}
    assert sam["f"]["FLAG"] == 0 and sam["r"]["FLAG"] == 16
    for r in sam.values():
        assert r["POS"] == 501 and r["NM"] == 4 and r["MAPQ"] == 60 and len(r["SEQ"]) == 297
    assert [r["value"] for r in writers.sam_header(found).collect()] == ["@SQ\tSN:c0\tLN:2500"]
    text = {r["query"]: r["value"] for r in writers.pairwise_text(found).collect()}
    assert "Query  1 " in text["f"] and "Sbjct  501 " in text["f"] and text["f"].rstrip().endswith("800") and text["r"].rstrip().endswith("501")


def test_stream_answers_each_file_once(spark, index, genome, tmp_path):
    at = f"file://{tmp_path}"
    for k, begin in enumerate((100, 900)):
        spark.createDataFrame([(f"q{k}", genome[begin : begin + 200])], "query string, seq string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        search_stream(spark, index, f"{at}/in", f"{at}/out", f"{at}/state", SearchOptions(min_prefix=15)).awaitTermination(120)
    assert sorted((r["query"], r["sstart"]) for r in spark.read.parquet(f"{at}/out").collect()) == [("q0", 101), ("q1", 901)]


def test_contig_rules(spark):
    rows = [("a", 0, "c0", "ACGT" * 20), ("a", 1, "short", "ACG"), ("a", 2, "plasmid p1", "ACGT" * 30), ("b", 0, "c0", "A" * 300), ("c", 0, "c0", "AC")]
    records = spark.createDataFrame(rows, "genome_id string, seq_idx int, seq_id string, seq string")
    options = Options(k=21, min_length=21, max_genome=200, contig_interval=10)
    kept, skipped = valid_contigs(records, options, exclude=["plasmid"])
    assert [(r["genome_id"], r["seq_idx"], r["offset_start"], r["offset_end"]) for r in kept.collect()] == [("a", 0, 0, 79)]
    assert {r["genome_id"]: r["reason"] for r in skipped.collect()} == {"b": "too_large_genome", "c": "no_valid_seqs"}
    lengths = spark.createDataFrame([("g", 0, 60), ("g", 1, 30), ("g", 2, 60), ("g", 3, 40), ("g", 4, 100), ("h", 0, 90)], "genome_id string, seq_idx int, seq_len int")
    assert [r["chunk_idx"] for r in chunked(lengths, 100).orderBy("genome_id", "seq_idx").collect()] == [0, 0, 1, 1, 2, 0]


def test_ani_of_a_mutated_genome(spark, genome):
    rng = random.Random(1)
    other = "".join(rng.choice([b for b in "ACGT" if b != c]) if rng.random() < 0.05 else c for c in genome)
    side = lambda name, seq: spark.createDataFrame([(name, 0, seq)], "genome_id string, seq_idx int, seq string")
    (row,) = ani(side("x", genome), side("y", other)).collect()
    assert 93 < row["ANI"] < 97 and row["qAF"] > 90 and row["sAF"] > 90 and 85 < row["tANI"] < row["ANI"]
    (same,) = ani(side("x", genome), side("y", genome)).collect()
    assert same["ANI"] == 100 and same["qAF"] == 100 and ani(side("x", genome), side("y", other), min_ani=99).isEmpty()
