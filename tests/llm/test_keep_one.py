"""One row of each component stays, whatever its doc_id."""

from strandline.llm import simhash

UNLIKE = [" ".join(f"{a}{i}" for i in range(60)) for a in "abcdef"]


def kept(spark, rows):
    df = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    found = simhash.keep_one(df)
    assert found.columns == df.columns
    return sorted((r["n"] for r in found.collect()))


def test_texts_without_id_stay_each(spark):
    assert kept(spark, [(None, t) for t in UNLIKE]) == list(range(6))


def test_no_copy_of_a_kept_text_stays(spark):
    assert kept(spark, [(None, UNLIKE[0]), (3, UNLIKE[0]), (None, UNLIKE[1]), (2, UNLIKE[0])]) == [2, 3]


def test_a_shared_id_keeps_one_of_each_component(spark):
    assert kept(spark, [(1, UNLIKE[0]), (1, UNLIKE[1]), (2, UNLIKE[0]), (2, UNLIKE[1])]) == [0, 1]


def test_equal_rows_and_empty_texts_leave_one(spark):
    assert len(kept(spark, [(None, UNLIKE[0])] * 5 + [(7, UNLIKE[1])] * 3)) == 2
    assert len(kept(spark, [(None, None), (None, ""), (None, None)])) == 1
    assert kept(spark, [(None, None), (4, "")]) == [1]
