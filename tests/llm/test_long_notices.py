"""Long notices are found with as many edits as their length allows."""

import regex

from strandline.llm import license_scan


def test_edits_follow_the_length(spark):
    rows = [(n, label, text[:k] + "q" * edits + text[k + edits :]) for n, (text, label) in enumerate(license_scan.NOTICES.items()) for edits in [len(text) // license_scan.LETTERS_PER_EDIT] for k in [text.index(" ") + 1]]
    rows.append((50, "bsd", "redistribution and use in source and binary forms with or without adaptation are permitted"))
    rows.append((51, "gpl", "under these terms of the gnu general publick licence as publishd by the free sofware fondation"))
    df = spark.createDataFrame([(n, f"before it {text} after it") for n, _, text in rows], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for n, label, text in rows:
        fits = [t for t, own in license_scan.NOTICES.items() if own == label and regex.search("(?b)(?:%s){e<=%d}" % (t, len(t) // 12), text)]
        assert fits and label in [m["label"] for m in found[n]["matches"]], (n, text)
    assert max(m["edits"] for r in found.values() for m in r["matches"]) == 7
