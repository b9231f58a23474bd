"""License scans: exact phrases, and fuzzy search for short license notices.

A notice of n characters may differ by n // letters_per_edit edits. Cut into one piece more than that, at least one piece stands unchanged in every such
occurrence (pigeonhole), so exact search for the pieces finds all places; there the regex library matches the whole notice with at most so many
edits and reports span and edits. Notices and texts are compared as lower-cased words joined by one blank.

A null text counts as empty. Very long texts are searched whole, in time that grows with their length; repeated rows, with or without doc_id, are answered each for
itself; an empty table gives none; other columns don't matter. Of places where a notice fits in several ways the regex library reports the one with fewest edits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm import bytescan

#: Phrases whose places are counted exactly, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices of public licenses, as words: the sentences by which the license texts say they are to be applied, or their names.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "gnu affero general public license": "agpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "distributed under the boost software license version 1 0": "boost",
    "made available under the terms of the eclipse public license": "epl",
    "to the extent possible under law the author has waived all copyright": "cc0",
}
#: One edit for so many characters.
LETTERS_PER_EDIT = 12


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    pieces: tuple[tuple[int, bytes], ...]

    @classmethod
    def of(cls, text: str, label: str, letters_per_edit: int) -> Notice:
        raw = text.encode()
        edits = len(raw) // letters_per_edit
        cuts = [len(raw) * k // (edits + 1) for k in range(edits + 2)]
        return cls(raw, label, edits, tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))

    def pattern(self):
        return regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(self.text, literal_spaces=True), self.edits))


def _places(haystack: bytes, needle: bytes, step: int):
    at = haystack.find(needle)
    while at >= 0:
        yield at
        at = haystack.find(needle, at + step)


def fuzzy(haystack: bytes, notices: list[Notice], patterns: list) -> list[tuple[int, int, int, int]]:
    """(begin, end, notice, edits) of occurrences. haystack: texts of words joined by a blank, each within line ends; a match keeps to its line."""
    out = []
    for k, (notice, pattern) in enumerate(zip(notices, patterns, strict=True)):
        size, edits = len(notice.text), notice.edits
        starts = sorted({at - offset for offset, piece in notice.pieces for at in _places(haystack, piece, 1)})
        done = 0
        for start in starts:
            low, high = max(start - edits, done, 0), start + size + edits
            if high - low < size - edits:
                continue
            window = haystack[low:high]
            cut = [0, *(i + 1 for i, c in enumerate(window) if c == 10), len(window) + 1]
            for a, b in zip(cut, cut[1:], strict=False):
                if b - 1 - a >= size - edits and (m := pattern.search(window[a : b - 1])):
                    out.append((low + a + m.start(), low + a + m.end(), k, sum(m.fuzzy_counts)))
                    done = low + a + m.end()
    return out


def _scan(batches, phrases: dict[str, str], notices: list[Notice]):
    patterns = [n.pattern() for n in notices]
    for batch in batches:
        rows: list[tuple] = []
        for part in bytescan.texts(batch.column(1)):
            lines = [b" ".join(part.bytes_of(k).translate(bytescan.PLAIN_TABLE).split()) for k in range(len(part))]
            hay = b"\n " + b" \n ".join(lines) + b" \n"  # each word within blanks, each text a line
            begins = np.cumsum([2, *(len(x) + 3 for x in lines)])
            exact: list[list[tuple[int, str]]] = [[] for _ in lines]
            near: list[list[dict]] = [[] for _ in lines]
            line_of = lambda at: int(np.searchsorted(begins, at, side="right")) - 1  # noqa: E731, B023
            blanks = np.flatnonzero(np.frombuffer(hay, np.uint8) == 0x20)
            before = np.searchsorted(blanks, begins)
            word_at = lambda k, at: int(np.searchsorted(blanks, at) - before[k])  # noqa: E731, B023
            for phrase, label in phrases.items():
                for at in _places(hay, b" %s " % phrase.encode(), 1):
                    k = line_of(at + 1)
                    exact[k].append((word_at(k, at + 1), label))
            for b, e, n, edits in fuzzy(hay, notices, patterns):
                k = line_of(b)
                near[k].append({"label": notices[n].label, "first_word": word_at(k, b), "last_word": word_at(k, e), "edits": edits, "similarity": 1 - edits / len(notices[n].text)})
            for k, line in enumerate(lines):
                base = sorted({label for _, label in exact[k]})
                every = sorted({*base, *(m["label"] for m in near[k])})
                at = [w for w, _ in exact[k]]
                score = 1.0 if at else max((m["similarity"] for m in near[k]), default=0.0)
                rows.append((line.count(b" ") + 1 if line else 0, len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, near[k]))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _MATCHES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())]))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, letters_per_edit: int = LETTERS_PER_EDIT) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for an exact phrase, else the best
    notice's share of unchanged characters, else 0) and matches (label, first and last word, edits, similarity of each notice found)."""
    listed = [Notice.of(t, label, letters_per_edit) for t, label in (NOTICES if notices is None else notices).items()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,edits:long,similarity:double>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, phrases=PHRASES if phrases is None else phrases, notices=listed), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
