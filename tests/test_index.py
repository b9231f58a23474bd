import random

from strandline.plans.index import Index, Options
from strandline.plans.search import SearchOptions, anchors, search


def test_save_load_and_search_on_both_strands(spark, tmp_path):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    records = spark.createDataFrame([("g1", 0, "c0", genome), ("g2", 0, "c0", "".join(rng.choice("ACGT") for _ in range(3000)))], "genome_id string, seq_idx int, seq_id string, seq string")
    Index.build(records, Options(k=21, masks=256, min_length=21)).save(f"file://{tmp_path}/index")
    index = Index.load(spark, f"file://{tmp_path}/index")
    assert {r["genome_id"]: r["genome_size"] for r in index.genomes().collect()} == {"g1": 4000, "g2": 3000}
    part = genome[1000:1600]
    back = part.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    queries = spark.createDataFrame([("fwd", part), ("rev", back)], "query string, seq string")
    found = {r["query"]: r for r in search(index, queries, SearchOptions(min_prefix=15)).collect()}
    for name, strand in (("fwd", "+"), ("rev", "-")):
        r = found[name]
        assert (r["sgenome"], r["sstr"], r["sstart"], r["send"], r["pident"], r["hits"]) == ("g1", strand, 1001, 1600, 100.0, 1)


def test_suffix_seeds_find_what_prefix_seeds_miss(spark):
    """A k-mer whose first bases differ is found by its last ones."""
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    part = list(genome[600:760])
    for k in range(0, 160, 20):
        part[k] = "ACGT"[("ACGT".index(part[k]) + 1) % 4]
    records = spark.createDataFrame([("g1", 0, "c0", genome)], "genome_id string, seq_idx int, seq_id string, seq string")
    index = Index.build(records, Options(k=21, masks=256, min_length=21))
    queries = spark.createDataFrame([("q", "".join(part))], "query string, seq string")
    found = anchors(index, queries, SearchOptions(min_prefix=13)).collect()
    true = [r for r in found if not r["rc"] and r["t"] - r["q"] == 600]
    for r in true:
        assert "".join(part)[r["q"] : r["q"] + r["len"]] == genome[r["t"] : r["t"] + r["len"]]
    assert true
    both = {r["rev"]: r["count"] for r in index.seeds.groupBy("rev").count().collect()}
    assert both[True] == index.places().select("kmer", "pos", "rc").distinct().count()


def test_extension_reaches_the_end_of_a_query(spark):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    part = genome[1000:1500]
    part = part[:6] + ("A" if part[6] != "A" else "C") + part[7:]
    records = spark.createDataFrame([("g1", 0, "c0", genome)], "genome_id string, seq_idx int, seq_id string, seq string")
    index = Index.build(records, Options(k=21, masks=256, min_length=21))
    (row,) = search(index, spark.createDataFrame([("q", part)], "query string, seq string"), SearchOptions(min_prefix=15)).collect()
    assert (row["qstart"], row["qend"], row["sstart"], row["send"]) == (1, 500, 1001, 1500) and row["cigar"] == "6=1X493="
