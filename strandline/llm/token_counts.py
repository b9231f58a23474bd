"""Token counts by finite-state transducers.

Two deterministic transducers give the number of tokens without making tokens.

The splitter reads character classes and marks where pre-tokens begin. It has nine states, so a chunk of text is a map of nine states to nine
states; the maps of all chunks of a batch are built side by side and composed by a parallel prefix scan, after which every chunk knows its entry state and
is read once more to emit its marks.

The counter reads the bytes of all pre-tokens that are new to a worker as one stream, the last byte of each as a symbol of its own (it carries the word end and
leads back to the start). Each transition is annotated with the change in the number of tokens. The stream is cut into chunks without regard to pre-tokens; a chunk is a
map from the state at its begin to the state and the tokens of the unfinished pre-token at its end, and the maps are composed by a prefix scan too (up and down
a tree), which gives every chunk its entry. As states are many, a map is built for the entry that the bytes before the chunk suggest, and is extended
when the scan asks for another, so the result never depends on the guess. A state stands for all prefixes with the same future: for each suffix of the prefix that begins some token, the suffix's place in
the token trie, the last token of the encoding before it, and how many tokens fewer that has. The encoding of a prefix ends with the one token
whose pair with the last token before it is what the merges leave unmerged; so a transition needs only the state. Transitions are compiled when first
met, from the merges alone, and are kept until most_states states exist, which bounds memory; then compilation starts afresh.

A null text counts as empty. Special tokens' strings count as one token each, as the library has it. Very long texts are many chunks. Repeated rows are
answered each for itself; an empty table gives none; other columns don't matter.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import bytescan, pretokens

LIMIT = 2048

# Symbols of the splitter: letters that matter to short forms, other letters, apostrophe, the other classes, and bytes inside a character.
_LETTER, _STMD, _R, _V, _L, _E, _NUMBER, _MARK, _OTHER, _SPACE, _INSIDE = range(11)
# States: outside, in letters, after a number, in other characters, after an apostrophe that may start a short form, after 'r 'v 'l, after a short form.
_OUT, _IN, _NUM, _OTH, _APO, _AR, _AV, _AL, _DONE = range(9)
_HERE, _BEFORE = 1, 2  # marks: a pre-token or gap begins at this byte; one begins at the byte before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by symbol * 9 + state."""
    goto, marks = np.zeros((11, 9), np.uint8), np.zeros((11, 9), np.uint8)
    for state in range(9):
        late = _BEFORE if state in (_AR, _AV, _AL) else 0  # the short form fails: its letter begins a pre-token
        for symbol in range(11):
            to, mark = _OUT, _HERE
            if symbol == _INSIDE:
                goto[symbol, state], marks[symbol, state] = state, 0
                continue
            if symbol <= _E:
                to = _IN
                if state == _IN:
                    mark = 0
                elif state == _APO:
                    to = {_STMD: _DONE, _R: _AR, _V: _AV, _L: _AL}.get(symbol, _IN)
                    mark = 0 if to != _IN else _HERE
                elif late:
                    whole = symbol == (_L if state == _AL else _E)
                    to, mark, late_here = (_DONE, 0, 0) if whole else (_IN, 0, _BEFORE)
                    goto[symbol, state], marks[symbol, state] = to, late_here
                    continue
            elif symbol == _NUMBER:
                to = _NUM
            elif symbol == _MARK:
                to, mark = (_OTH, 0) if state in (_OTH, _APO) else (_APO, _HERE)
            elif symbol == _OTHER:
                to, mark = _OTH, 0 if state in (_OTH, _APO) else _HERE
            goto[symbol, state], marks[symbol, state] = to, mark | late
    return goto, marks


GOTO, MARKS = _splitter()
_STATES = 9
CHUNK = 64

_ASCII = np.full(128, _LETTER, np.uint8)
for _c, _s in (("s", _STMD), ("t", _STMD), ("m", _STMD), ("d", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
    _ASCII[ord(_c)] = _s
_BY_CLASS = np.array([_LETTER, _NUMBER, _SPACE, _OTHER, _SPACE], np.uint8)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Of chunk maps (rows of next states): the maps that read first, then then."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """maps[0], maps[0] then maps[1], ...: in as many steps as the number of chunks has binary digits."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step].copy(), out[step:])
        step *= 2
    return out


def split_marks(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens and gaps begin in a stream of symbols."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, _SPACE, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.int16) * _STATES
    goto, marks = GOTO.ravel(), MARKS.ravel()
    maps = np.tile(np.arange(_STATES, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = goto[row[:, None] + maps]
    scanned = prefix_scan(maps)
    state = np.concatenate(([_OUT], scanned[:-1, _OUT])).astype(np.uint8)
    emitted = np.empty_like(grid, np.uint8)
    for k, row in enumerate(grid):
        at = row + state
        emitted[k] = marks[at]
        state = goto[at]
    emitted = emitted.T.ravel()[:n]
    begins = (emitted & _HERE) > 0
    begins[:-1] |= (emitted[1:] & _BEFORE) > 0
    return begins


def split(texts: list[bytes], table: np.ndarray) -> pretokens.Pieces:
    """Pre-tokens of normalized texts."""
    data, kinds, begins = pretokens.classes(texts, table)
    symbols = _BY_CLASS[kinds]
    letter = np.flatnonzero((kinds == pretokens.LETTER) & (data < 128))
    symbols[letter] = _ASCII[data[letter]]
    symbols[(data == 0x27) & (kinds == pretokens.OTHER)] = _MARK
    symbols[(data & 0xC0) == 0x80] = _INSIDE
    edges = np.append(np.flatnonzero(split_marks(symbols)), len(data))
    token = kinds[edges[:-1]] < pretokens.BREAK
    token &= kinds[edges[:-1]] != pretokens.SPACE
    starts = edges[:-1][token]
    return pretokens.Pieces(data, starts, edges[1:][token], np.searchsorted(starts, np.append(begins, len(data))))


class Counter:
    """The counting transducer of a BPE vocabulary whose last symbol carries a word end."""

    def __init__(self, content: str, most_states: int = 400_000):
        model = json.loads(content)["model"]
        end, letters = model["end_of_word_suffix"], pretokens.byte_letters()
        vocab = model["vocab"]

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if last else token)]
            return (*body[:-1], body[-1] + 256) if last else tuple(body)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Tokens by the order in which merges make them; symbols come before all merges.
        self.order: dict[tuple[int, ...], int] = {(s,): s for s in range(512)}
        self.halves: list[tuple[int, int]] = [(s, s) for s in range(512)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = symbols(a), symbols(b)
            if a + b in vocab and left in self.order and right in self.order and left + right not in self.order:
                number = len(self.halves)
                self.order[left + right] = number
                self.halves.append((self.order[left], self.order[right]))
                self.merged[(self.order[left], self.order[right])] = number
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for seq, number in self.order.items():
            node = 0
            for s in seq:
                key = node << 9 | s
                if key not in self.trie:
                    self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.trie[key]
            self.token_at[node] = number
        self.most_states, self.pairs = most_states, {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.meanings: list[tuple] = [((0, -1, 0),)]
        self.steps: dict[int, tuple[int, int]] = {}
        self.pairs.clear()

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave tokens left and right next to each other: no merge across their border comes before one of them is whole."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        halves, merged = self.halves, self.merged
        bound = len(halves)  # merges from here on come after the pieces at the border are gone
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            # Undo the later of the two merges; when both are symbols nothing is left to undo. Ties go to the left, which merges first.
            if left > right:
                if left < 512:
                    return True
                bound, left = left, halves[left][1]
            else:
                if right < 512:
                    if left < 512:
                        return True
                    bound, left = left, halves[left][1]
                else:
                    bound, right = right + 1, halves[right][0]

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        best, gain, children = -1, 0, []
        for node, last, behind in self.meanings[state]:
            child = self.trie.get(node << 9 | symbol)
            if child is None:
                continue
            children.append((child, last, behind))
            token = self.token_at[child]
            if best < 0 and token >= 0 and (last < 0 or self.stays(last, token)):
                best, gain = token, behind + 1
        meaning = (*((c, last, behind - gain) for c, last, behind in children), (0, best, 0))
        number = self.states.get(meaning)
        if number is None:
            number = self.states[meaning] = len(self.meanings)
            self.meanings.append(meaning)
        step = self.steps[state << 9 | symbol] = (number, gain)
        return step

    def read(self, symbols: list[int], state: int = 0) -> tuple[int, int]:
        """The state after symbols and the tokens they emit."""
        steps, total = self.steps, 0
        for s in symbols:
            step = steps.get(state << 9 | s) or self.compile(state, s)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> list[int]:
        """Tokens of the pre-tokens data[starts:ends], none of them empty."""
        if not len(starts):
            return []
        symbols = data[bytescan.ragged(starts, ends - starts)].astype(np.int16)
        stops = np.cumsum(ends - starts)
        symbols[stops - 1] += 256
        begins, stops = [0, *stops.tolist()], stops.tolist()
        out: list[int] = []
        entry, at = (0, 0), 0
        for block in range(0, len(symbols), BLOCK):  # so many chunks at once, whatever the stream's length
            leaves, end = [], min(block + BLOCK, len(symbols))
            for low in range(block, end, chunk):
                high, first = min(low + chunk, end), at
                while at < len(stops) and stops[at] <= high:
                    at += 1
                begin = begins[first]
                guess = self.read(symbols[max(begin, low - WARM_UP) : low].tolist())[0] if begin < low else 0
                leaves.append(_Chunk(self, symbols[low:high], [x - low for x in stops[first:at]], guess))
            entries = _entries(leaves, entry)
            for leaf, (state, before) in zip(leaves, entries, strict=True):
                out += leaf.finished(state, before)
            entry = _then(entries[-1], leaves[-1])
        return out


BLOCK = 1 << 20
WARM_UP = 16


class _Chunk:
    """A chunk of the counter's stream as a map of states; stops: behind which of its symbols pre-tokens end."""

    def __init__(self, counter: Counter, symbols: np.ndarray, stops: list[int], guess: int):
        self.counter, self.resets = counter, bool(stops)
        self.head = symbols[: stops[0]] if stops else symbols
        symbols = symbols.tolist()
        self.body = [counter.read(symbols[a:b])[1] for a, b in zip(stops, stops[1:], strict=False)]
        self.tail = counter.read(symbols[stops[-1] :]) if stops else None
        self.known = {guess: counter.read(self.head.tolist(), guess)}

    def through_head(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.counter.read(self.head.tolist(), state)
        return self.known[state]

    def apply(self, state: int) -> tuple[int, int]:
        return self.tail if self.resets else self.through_head(state)

    def finished(self, state: int, before: int) -> list[int]:
        """Tokens of the pre-tokens that end here, if the chunk is entered in state, before tokens after the begin of a pre-token."""
        return [before + self.through_head(state)[1], *self.body] if self.resets else []


class _Joined:
    """Two neighbouring maps as one. After a reset the tokens before it are done with."""

    def __init__(self, left, right):
        self.left, self.right, self.resets = left, right, left.resets or right.resets
        self.known: dict[int, tuple[int, int]] = {}

    def apply(self, state: int) -> tuple[int, int]:
        out = self.known.get(state)
        if out is None:
            out = self.known[state] = _then(self.left.apply(state), self.right)
        return out


def _then(entry: tuple[int, int], part) -> tuple[int, int]:
    """State and tokens of the unfinished pre-token behind part, entered so."""
    state, tokens = part.apply(entry[0])
    return state, tokens if part.resets else entry[1] + tokens


def _entries(leaves: list, entry: tuple[int, int]) -> list[tuple[int, int]]:
    """State and tokens of the unfinished pre-token before each chunk, entry before the first: a prefix scan, up a tree of joined maps and down again."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([_Joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    entries = [entry]
    for level in reversed(levels[:-1]):
        entries = [entries[i // 2] if i % 2 == 0 else _then(entries[i // 2], level[i - 1]) for i in range(len(level))]
    return entries


class Texts:
    """Counts batches; one for each Python worker."""

    def __init__(self, rules: pretokens.WordRules):
        self.counter, self.memo = Counter(rules.content), pretokens.Memo()
        self.classes, self.normalize = rules.classes, rules.normalizer()
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in json.loads(rules.content)["added_tokens"]) or r"(?!)")

    def count(self, texts: list[bytes]) -> np.ndarray:
        special = np.zeros(len(texts), np.int64)
        plain, owner = [], []
        for k, raw in enumerate(texts):
            text = raw.decode()
            parts = self.specials.split(text) if b"<|" in raw else [text]
            special[k] = len(parts) - 1
            plain += [self.normalize(p).encode() for p in parts]
            owner += [k] * len(parts)
        pieces = split(plain, self.classes)
        hashes, at, number = pieces.unique()
        if len(self.memo.slots) > self.memo.most:
            self.memo.slots.clear()
        if len(self.counter.meanings) > self.counter.most_states:
            self.counter.clear()
        counts, new = self.memo.find(hashes)  # the slot of a pre-token is its count
        counts[new] = self.counter.count(pieces.data, pieces.starts[at[new]], pieces.ends[at[new]])
        self.memo.slots.update(zip(hashes[new].tolist(), counts[new].tolist(), strict=True))
        sums = np.concatenate(([0], np.cumsum(counts[number])))[pieces.first]
        return special + np.bincount(owner, np.diff(sums), minlength=len(texts)).astype(np.int64)


_WORKER: dict[int, Texts] = {}


def _count(batches, shared, limit):
    for batch in batches:
        key = hash(shared.value.content)
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Texts(shared.value)
        sizes, counts = [], []
        for part in bytescan.texts(batch.column(1)):
            sizes.append(part.ends - part.starts)
            counts.append(_WORKER[key].count([part.bytes_of(k) for k in range(len(part))]))
        if sizes:
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. tokenizer_file: a word-ended BPE vocabulary (.json)."""
    shared = docs.sparkSession.sparkContext.broadcast(pretokens.WordRules.read(tokenizer_file))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _count(b, shared, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
