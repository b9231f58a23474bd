"""Repeats of fewer than five words count if min_repeat says so."""

import pytest

from strandline.llm import quality

TEXTS = ["a b c x a b c y a b c z u v w", "a b p q a b r s t u v w", "a p q a r s t u v w x y", "a b c d e f g h i j k l", "", "a b c d e p a b c d e q r s t u v w"]


@pytest.mark.parametrize("least", [1, 2, 3, 4, 5, 6])
def test_repeats_of_min_repeat_words(spark, least):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality.assess(df, min_repeat=least).collect()}
    good = {r["doc_id"] for r in quality.keep_good(df, min_repeat=least).collect()}
    for d, t in enumerate(TEXTS):
        w = t.split()
        runs = [max((next((n for n in range(len(w)) if a + n >= len(w) or b + n >= len(w) or w[a + n] != w[b + n])) for b in range(len(w)) if b != a), default=0) for a in range(len(w))]
        cover = {a + i for a, n in enumerate(runs) if n >= least for i in range(n)}
        assert found[d]["longest_repeat"] == max((n for n in runs if n >= least), default=0)
        assert found[d]["repeat_fraction"] == pytest.approx(len(cover) / len(w) if w else 0)
        assert (d in good) == found[d]["kept"] == (not found[d]["base_failed"] and len(cover) <= 0.15 * len(w))
