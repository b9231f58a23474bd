import hashlib

from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import kmers

TEXTS = ["ACGTacgtNn-MRWSYKVHDBUmrwsykvhdbu", "stra\u00dfe \u0131 \ufb01 \u00e9\t\r\nGATTACA\u007f", "\U0001d400c\U0001f9ecg", "", None]


def test_every_document_is_converted(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["bases_md5"] for r in queries.QUERIES["base_convert"](spark, f"file://{tmp_path}").collect()}
    first = dict(zip("acgtubsyk", "ACGTTCCCG", strict=True))
    plain = lambda t: "".join(first.get(c.lower(), "A") if c.isascii() else "A" for c in t)
    assert found == {d: t if t is None else hashlib.md5(plain(t).encode()).hexdigest() for d, t in enumerate(TEXTS)}


def test_runs_of_n_stay_as_gaps(spark):
    from pyspark.sql import functions as F

    from strandline.functions import kmers

    rows = ["ANNNNC", "ANNNNNC", "NNNNNNg", "nG" + "N" * 9 + "AN", "N", "rNy", None]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, s string")
    found = [r["x"] for r in df.select("k", kmers.plain_bases(F.col("s"), gap=5).alias("x")).orderBy("k").collect()]
    assert found == ["AAAAAC", "ANNNNNC", "NNNNNNG", "AG" + "N" * 9 + "AA", "A", "AAC", None]


def test_unknown_taxa(spark):
    from strandline.operators import seeds

    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "g int, taxon int")
    closure = spark.createDataFrame([(5, 5), (6, 6), (5, 1), (6, 1)], "node int, ancestor int")
    left = lambda *x: {r["g"] for r in seeds.by_taxon(df, "taxon", closure, *x).collect()}
    assert left([], [5]) == {2} and left([], [5], True) == {2, 3} and left([1], [6]) == {1} and left([5], [], True) == {1, 3} and left([], []) == {1, 2, 3}


def test_both_ways_to_bases_agree_on_every_character(spark):
    skip = range(0xD800, 0xE000)
    texts = ["".join(chr(c) + "b" for c in range(low, low + 4096) if c not in skip) for low in range(0, 0x110000, 4096)] + ["", None, "ABC xyz", "İKſ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r["id"]: r["seq"] for r in df.select("id", kmers.dna(F.col("text")).alias("seq")).collect()}
    assert {r["id"]: r["seq"] for r in kmers.dna_of(df, "id", "text").collect()} == want
