import random

from strandline.plans.search import ani, fragment_pairs, fragments


def contigs(spark, rows):
    return spark.createDataFrame([(g, 0, s) for g, s in rows], "genome_id string, seq_idx int, seq string")


def test_every_genome_with_a_copy_is_compared(spark):
    """More genomes hold the passage than a fragment keeps partners in one genome."""
    rng = random.Random(8)
    passage = "".join(rng.choice("ACGT") for _ in range(1000))
    subjects = contigs(spark, [(f"s|{k:02d}", passage) for k in range(12)])
    found = ani(contigs(spark, [("q", passage)]), subjects).collect()
    assert {r["subject"] for r in found} == {f"s|{k:02d}" for k in range(12)} and all(r["ANI"] == r["qAF"] == 100 for r in found)


def test_partners_are_cut_within_a_genome(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("ACGT") for _ in range(1020))
    a, b = fragments(contigs(spark, [("q", passage)])), fragments(contigs(spark, [("s", passage * 7), ("t", passage * 2)]))
    found = [r["frag_b"].split("|")[0] for r in fragment_pairs(a, b).collect()]
    assert sorted(found) == ["s"] * 5 + ["t"] * 2
