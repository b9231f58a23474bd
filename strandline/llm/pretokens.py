"""Pre-tokens of whole batches, found on arrays of character classes.

Unicode versions differ between Python, its regex module and the two tokenizer libraries; so the classes are asked from the library whose tokens are wanted.

Two splits are known: RANKS for the pattern of the rank files (a blank goes with what follows it, all bytes belong to a pre-token), and WORDS for
the word-ended vocabulary (lower-cased, white space dropped, digits by themselves). Tests hold both against the libraries.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

from strandline.llm import bytescan

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
_PROPERTIES = ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE))
CODE_POINTS = 0x110000


def _every() -> tuple[str, np.ndarray]:
    """All code points but surrogates, as a string and as numbers."""
    points = np.array([c for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000], "<u4")
    return points.tobytes().decode("utf-32-le"), points


@functools.cache
def rank_classes() -> np.ndarray:
    """The class of each code point as the tiktoken library's regular expressions have it: the library is asked which code points match."""
    import tiktoken

    every, _ = _every()
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    for pattern, kind in _PROPERTIES:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        matched = bytes(probe.encode_ordinary(every))
        table[np.frombuffer(matched.decode().encode("utf-32-le"), "<u4")] = kind
    return table


@functools.cache
def word_classes() -> np.ndarray:
    """The class of each code point as the tokenizers library's regular expressions have it."""
    from tokenizers import Regex, normalizers

    every, points = _every()
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    for pattern, kind in _PROPERTIES:
        marked = normalizers.Replace(Regex(pattern), "\0").normalize_str(every)
        table[points[np.frombuffer(marked.encode("utf-32-le"), "<u4") != points]] = kind
    return table


@dataclass
class Pieces:
    """data: texts, a zero byte after each; starts, ends: pre-tokens; first: pre-tokens before each text, with the total at the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def unique(self):
        """Fingerprints of the distinct pre-tokens, the place of one of each, and for every pre-token the number of its fingerprint."""
        hashes = bytescan.span_hash(bytescan.rolling_prefix(bytescan.BYTE_VALUES[self.data]), self.starts, self.ends)
        return np.unique(hashes, return_index=True, return_inverse=True)


def classes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the class of each byte (that of its character), and where each text begins."""
    raw = b"\0".join(texts) + b"\0"
    data = np.frombuffer(raw, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    if raw.isascii():
        kinds = table[data]
    else:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        kinds = table[points][np.cumsum((data & 0xC0) != 0x80) - 1]
    kinds = kinds.copy()
    kinds[begins + lengths - 1] = BREAK
    return data, kinds, begins


def _short_forms(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of the short form ('s 't 're 've 'm 'll 'd) behind the apostrophes at, or 0."""
    padded = np.append(data, [0, 0])
    a, b = padded[at + 1], padded[at + 2]
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    return np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 1, np.where(two, 2, 0))


def split(texts: list[bytes], glue_blanks: bool, table: np.ndarray) -> Pieces:
    """glue_blanks: the split RANKS, else WORDS (of texts that are normalized). table: the class of each code point."""
    data, kinds, begins = classes(texts, table)
    n = len(data)
    lead = (data & 0xC0) != 0x80
    change = np.ones(n, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    before = np.concatenate(([BREAK], kinds[:-1]))
    byte_before = np.concatenate(([0], data[:-1]))
    start = change & (kinds != BREAK)
    if glue_blanks:
        behind = np.flatnonzero(change & (before == SPACE) & (kinds != BREAK))
        last = np.maximum.accumulate(np.where(lead, np.arange(n), 0))[behind - 1]
        start[last] = True
        start[behind[data[last] == 0x20]] = False
    else:
        start &= kinds != SPACE
        start |= (kinds == NUMBER) & lead
    mark = np.flatnonzero((data == 0x27) & change & (kinds == OTHER))
    mark = mark[kinds[mark + 1] == LETTER]
    if glue_blanks:
        mark = mark[byte_before[mark] != 0x20]
    size = _short_forms(data, mark)
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    rest = (mark + 1 + size)[kinds[mark + 1 + size] == LETTER]
    start[rest] = True
    bound = start | (kinds == BREAK)
    if not glue_blanks:
        bound |= change & (kinds == SPACE)
    edges = np.flatnonzero(bound)
    own = np.flatnonzero(start[edges])
    starts = edges[own]
    ends = edges[own + 1]
    return Pieces(data, starts, ends, np.searchsorted(starts, np.append(begins, n)))


def _known(text: str) -> str:
    """NFC, then lower case character by character. (The vocabulary's normalizer also joins white space, which it then drops.)"""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@functools.cache
def asked_points(content: str) -> np.ndarray:
    """For each code point whether the library with this file must normalize the texts that hold it: Python's tables don't know it, or lower-case it otherwise."""
    from tokenizers import Tokenizer

    normalizer = Tokenizer.from_str(content).normalizer
    every = _every()[0][0x80:]
    odd = {c for c in every if unicodedata.category(c) == "Cn"}
    known = [c for c in every if c not in odd]

    def ask(cases: list[tuple[str, str]]) -> None:
        """Adds the code points of the cases (code point, text) that the library normalizes otherwise, white space aside."""
        asked = normalizer.normalize_str("\1".join(t for _, t in cases)).split("\1")
        odd.update(c for a, (c, t) in zip(asked, cases, strict=True) if "".join(a.split()) != "".join(_known(t).split()))

    marks = [c for c in known if unicodedata.category(c)[0] == "M"]
    old = [c for c in marks if unicodedata.ucd_3_2_0.combining(c)]  # long known to all
    kinds = list({unicodedata.combining(c): c for c in reversed(old)}.values())  # the first of each combining class
    ask([(c, c) for c in known])
    ask([(c, f"x{x}x") for c in marks for k in kinds for x in (c + k, k + c)])  # in the order of marks
    table = np.zeros(CODE_POINTS, bool)
    table[list(map(ord, odd))] = True
    return table


class Normalizer:
    """Normalizes as the tokenizers library does with this file: here, or by the library for texts with a code point that asked has."""

    def __init__(self, content: str, asked: np.ndarray):
        self.content, self.asked, self.library = content, asked, None

    def __call__(self, text: str) -> str:
        if text.isascii() or not self.asked[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return _known(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
        return self.library.normalizer.normalize_str(text)


@dataclass
class WordRules:
    """What workers need to split texts for a word-ended vocabulary: its file's content and the libraries' answers, made once on the driver."""

    content: str
    classes: np.ndarray
    asked: np.ndarray

    @classmethod
    def read(cls, path: str) -> WordRules:
        with open(path, encoding="utf-8") as file:
            content = file.read()
        return cls(content, word_classes(), asked_points(content))

    def normalizer(self) -> Normalizer:
        return Normalizer(self.content, self.asked)


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo:
    """Slots for pre-tokens met before, by fingerprint. It is emptied when it holds most of them, which bounds it."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.slots: dict[int, int] = {}

    def find(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, with -1 for what is new, and which are new."""
        get = self.slots.get
        out = np.fromiter((get(h, -1) for h in fingerprints.tolist()), np.int64, len(fingerprints))
        return out, np.flatnonzero(out < 0)
