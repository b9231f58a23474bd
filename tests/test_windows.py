from strandline import kernel_queries, queries  # noqa: F401


def test_a_run_across_windows_and_one_in_the_tail_are_seen(spark, tmp_path):
    mixed = "acgtgtcaagctcatgcgatacctgaatgcgctatagctccagtc"
    texts = [mixed[:15] + "a" * 31 + mixed[:15], mixed[:40] + "a" * 31]
    spark.createDataFrame([(n, t.translate(str.maketrans("acgt", "abcd"))) for n, t in enumerate(texts)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, column, seen in (("dust_score", "dust", 406), ("low_complexity", "low", True)):
        rows = queries.QUERIES[name](spark, f"file://{tmp_path}").collect()
        assert sorted((r["item_id"], r["start"]) for r in rows) == [(n, k) for n, t in enumerate(texts) for k in range(1, len(t) - 29)]
        assert {(r["item_id"], r["start"]) for r in rows if r[column] == seen} >= {(0, 16), (1, 41)}
