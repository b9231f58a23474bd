"""Tokens of every code point against the libraries, each alone, between letters, digits and blanks, and before a short form."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import bpe, pretokens, token_counts, token_files

POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
FRAMES = ("{} a{}1{}'s", "!{}\u0301{}")
#: No characters are assigned from here on but for a few marks of tags and variants.
UNASSIGNED = 0x40000


def texts():
    """64 code points to a text, each in all frames."""
    for k in range(0, len(POINTS), 64):
        yield "\n".join(f.replace("{}", c) for c in POINTS[k : k + 64] for f in (FRAMES if ord(c) < UNASSIGNED or 0xE0000 <= ord(c) < 0xE0200 else ("a{}1",)))


def test_ranks():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, every = bpe.Encoder(bpe.vocabulary(path)), list(texts())
    for k in range(0, len(every), 500):
        part = every[k : k + 500]
        ids, counts, _ = encoder.encode([t.encode() for t in part])
        wanted = [library.encode_ordinary(t) for t in part]
        assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == [i for x in wanted for i in x]


def test_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rules = Tokenizer.from_file(path), pretokens.WordRules.read(path)
    tokenizer, counter, every = token_files.Tokenizer(rules), token_counts.Texts(rules), list(texts())
    for k in range(0, len(every), 500):
        part = every[k : k + 500]
        wanted = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
        ids, counts = tokenizer.encode([t.encode() for t in part])
        assert counts.tolist() == list(map(len, wanted)) and np.array_equal(ids, [i for x in wanted for i in x])
        assert counter.count([t.encode() for t in part]).tolist() == counts.tolist()
