"""Sizes, screening windows, joined coordinates and SQL functions at their edges."""

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import kmers, sizes, sql
from strandline.operators import intervals, seeds


def test_sizes(spark):
    rows = [("", 0), ("  ", 0), ("10", 10), ("1.5K", 1536), (" 2 M\n", 2 << 20), ("3g", 3 << 30), ("1t", 1 << 40), ("7B", 7), ("k", 0), ("-5K", 0), ("x", None), (None, None), (".5k", 512), ("1e3", 1000)]
    got = spark.createDataFrame(rows, "t string, want long").select("t", "want", sizes.byte_size(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    n = [0, 1, 2, 3, 4, 5, 64, 65, 4096, 1 << 40, (1 << 40) + 1]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", sizes.next_power_of_two(F.col("n")).alias("p"), sizes.is_power_of_four(F.col("n")).alias("q")).collect()
    assert [(r["p"], r["q"]) for r in got] == [(1 << max(x - 1, 0).bit_length(), x in (1, 4, 64, 4096, 1 << 40)) for x in n]


def test_sql_hash_wraps_as_the_kernel_does(spark):
    sql.register(spark)
    x = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 200)
    df = spark.createDataFrame([(int(v),) for v in [0, -1, *x]], "x long")
    got = [r[0] for r in spark.sql("SELECT hash64(x) FROM {d}", d=df).collect()]
    assert np.array_equal(np.array(got, np.int64), kmers.hash64(np.array([0, -1, *x])).astype(np.int64))


def test_sql_functions_at_their_edges(spark):
    sql.register(spark)
    assert spark.sql("SELECT dust_score('AC') a, dust_score(repeat('A', 31)) b, kmer_lcp(5, 5, 31) c, revcomp('AANB') d, cigar_edit_distance('5=') e").first() == (0, 406, 31, "VNTT", 0)
    assert spark.sql("SELECT * FROM kmers('AC', 3)").count() == 0 and spark.sql("SELECT * FROM fragments('', 3, 1)").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT * FROM fragments('AACGTTG', 3, 2)").collect()] == [(0, "AAC"), (3, "GTT")]


def test_joined_coordinates(spark):
    contigs = spark.createDataFrame([("g", 0, "AAAA"), ("g", 1, "CC"), ("h", 0, "T")], "id string, i int, seq string")
    regions = spark.createDataFrame([("g", -3, 2), ("g", 2, 7), ("g", 4, 100), ("g", 50, 60), ("h", 0, 0)], "id string, start int, end int")
    got = {(r["id"], r["start"]): r["subseq"] for r in seeds.subseq_joined(contigs, regions, "id", "i", "seq", 3).collect()}
    assert got == {("g", -3): "AAA", ("g", 2): "AANNNC", ("g", 4): "NNNCC", ("g", 50): "", ("h", 0): "T"}


def test_windows_and_groups(spark):
    d = spark.createDataFrame([("a", 12)], "id string, n long")
    w = lambda n: [(r["start"], r["end"]) for r in intervals.screening_windows(d, "n", n).orderBy("window").collect()]
    assert w(1) == [(0, 12)] and w(3) == [(0, 6), (3, 9), (6, 12)]
    k = spark.createDataFrame([(0,), (0,), (1,), (5,), (64,)], "kmer long")
    assert [tuple(r) for r in seeds.prefix_groups(k, "kmer", 31, 28).collect()] == [(0, 3, 0, 5, 29)]
    low = spark.createDataFrame([(c,) for c in (kmers.homopolymer("A", 11), kmers.homopolymer("T", 11), 123456)], "kmer long")
    assert [r[0] for r in seeds.not_low(low, "kmer", 11).collect()] == [123456]
    empty = intervals.matched_share(k.where("false"), k, "kmer").first()
    assert tuple(empty) == (0, 0, None)
