"""Genome search and comparison in its modes on mutated copies."""

import random

from strandline.plans.index import Index, Options
from strandline.plans.search import compare, sampled_ani

RNG = random.Random(5)
BASE = "".join(RNG.choice("ACGT") for _ in range(6000))


def mutated(seq, share, rng):
    return "".join(rng.choice("ACGT".replace(c, "")) if rng.random() < share else c for c in seq)


def turned(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def contigs(spark, rows):
    return spark.createDataFrame(rows, "genome_id string, seq_idx int, seq string")


def test_sampled_ani_finds_both_strands_and_several_contigs(spark):
    rng = random.Random(6)
    other = "".join(rng.choice("ACGT") for _ in range(6000))
    b = contigs(spark, [("same", 0, BASE), ("back", 0, turned(BASE)), ("near", 0, other), ("near", 1, mutated(BASE, 0.05, rng)), ("far", 0, other)])
    got = {r["subject"]: r for r in sampled_ani(contigs(spark, [("q", 0, BASE)]), b).collect()}
    assert set(got) == {"same", "back", "near"} and {r["fragments"] for r in got.values()} == {6}
    assert got["same"]["ANI"] == got["back"]["ANI"] == got["same"]["qAF"] == 100 and 94 < got["near"]["ANI"] < 96
    assert 95 < got["near"]["qAF"] <= 100 and 45 < got["near"]["sAF"] <= 52


def test_repeats_keep_the_first_places(spark):
    rng = random.Random(7)
    unit = "".join(rng.choice("ACGT") for _ in range(300))
    got = sampled_ani(contigs(spark, [("q", 0, unit * 4)]), contigs(spark, [("s", 0, unit * 200)]), most=100).collect()
    assert len(got) == 1 and got[0]["ANI"] == 100


def test_modes_against_an_index(spark):
    rng = random.Random(8)
    records = [(g, 0, f"{g}_0", s) for g, s in (("same", BASE), ("near", mutated(BASE, 0.04, rng)), ("far", "".join(rng.choice("ACGT") for _ in range(6000))))]
    index = Index.build(spark.createDataFrame(records, "genome_id string, seq_idx int, seq_id string, seq string"), Options(masks=256))
    query = contigs(spark, [("q", 0, BASE)])
    for mode in ("screen", "sampled", "orthoani"):
        found = index.genome_search(query, mode).orderBy("rank").collect()
        assert [r["subject"] for r in found] == ["same", "near"]
    assert {(r["g1"], r["g2"]) for r in index.pair().collect()} == {("near", "same")}
    assert index.seed_window_counts(250, 100, 100).count() <= index.seed_window_counts().count()
    assert index.search(spark.createDataFrame([("x", BASE[1000:1400])], "query string, seq string")).where("genome_rank = 1").first()["sgenome"] == "same"


def test_compare_sums_both_ways(spark):
    got = compare(contigs(spark, [("q", 0, BASE)]), contigs(spark, [("s", 0, BASE[:3060])])).collect()
    assert len(got) == 1 and got[0]["sAF"] == 100 and 49 < got[0]["qAF"] < 60 and 60 < got[0]["tANI"] <= 80
    assert compare(contigs(spark, [("q", 0, "A" * 50)]), contigs(spark, [("s", 0, "")])).collect() == []
