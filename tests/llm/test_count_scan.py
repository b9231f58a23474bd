"""The counting transducer over chunks: any chunk size and any guess give the library's counts."""

from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import tokenizers

from strandline.llm import pretokens, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(Path(PATH).read_text())


@pytest.fixture(scope="module")
def pieces():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeorstn"), n)) for n in (*rng.integers(1, 30, 300), 63, 64, 65, 129, 1000, 5000)]
    return [w.encode() for w in (*words, "a" * 3000, "ab" * 700, "zq" * 65, "and")]


def spans(pieces):
    ends = np.cumsum([len(p) for p in pieces])
    return np.frombuffer(b"".join(pieces), np.uint8), ends - [len(p) for p in pieces], ends


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 100_000])
def test_any_chunks_give_the_librarys_counts(counter, pieces, chunk):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = [len(library.encode(p.decode(), add_special_tokens=False).ids) for p in pieces]
    assert counter.count(*spans(pieces), chunk) == want
    assert counter.count(*spans([]), chunk) == []


def test_a_wrong_guess_is_set_right(counter, pieces, monkeypatch):
    want = counter.count(*spans(pieces), 100_000)
    monkeypatch.setattr(token_counts, "WARM_UP", 0)
    monkeypatch.setattr(token_counts, "BLOCK", 40)
    assert counter.count(*spans(pieces), 5) == want


def test_a_megabyte_of_one_letter():
    library = tokenizers.Tokenizer.from_file(PATH)
    text = "a" * 1_000_000
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert token_counts.Texts(pretokens.WordRules.read(PATH)).count([text.encode()]).tolist() == [want]
