import math
import random
import re

import numpy as np
import pytest

from strandline.functions import kmers, thresholds
from strandline.operators import chaining, seeds
from strandline.plans.index import Options
from strandline.plans.search import texts_of


def gotoh(q, t, mismatch=4, gap_open=6, gap_extend=2):
    far = 10**9
    n, m = len(q), len(t)
    h = [[far] * (m + 1) for _ in range(n + 1)]
    e = [[far] * (m + 1) for _ in range(n + 1)]
    f = [[far] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                e[i][j] = min(h[i - 1][j] + gap_open + gap_extend, e[i - 1][j] + gap_extend)
            if j:
                f[i][j] = min(h[i][j - 1] + gap_open + gap_extend, f[i][j - 1] + gap_extend)
            if i and j:
                h[i][j] = min(h[i][j], h[i - 1][j - 1] + (q[i - 1] != t[j - 1]) * mismatch)
            h[i][j] = min(h[i][j], e[i][j], f[i][j])
    return h[n][m]


def cost(cigar):
    return sum({"=": 0, "X": 4 * int(n), "I": 6 + 2 * int(n), "D": 6 + 2 * int(n)}[op] for n, op in re.findall(r"(\d+)([=XID])", cigar))


def test_align_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        t = "".join(c if rng.random() > 0.15 else rng.choice(["", "A", "CG"]) for c in q) or "A"
        cigar, matches, gaps, opens = chaining.align(q, t)
        a, b, m = texts_of(q, t, cigar)
        assert a.replace("-", "") == q and b.replace("-", "") == t and m.count("|") == matches and a.count("-") + b.count("-") == gaps
        assert cost(cigar) == gotoh(q, t)


def test_codes_and_bad_bases():
    at, fwd, rev = kmers.codes(b"ACGTNACG", 3)
    assert at.tolist() == [0, 1, 5] and fwd.tolist() == [6, 27, 6] and rev.tolist() == [27, 6, 27]


def test_chain_and_regions():
    a = chaining.clear_nested(np.array([[0, 100, 20], [2, 102, 10], [30, 130, 20], [60, 161, 20]]), 31)
    assert a.tolist() == [[0, 100, 20], [30, 130, 20], [60, 161, 20]]
    (path, score), = chaining.chain(a)
    assert path == [0, 1, 2] and score == pytest.approx(40 * 3 - 0.1, abs=0.2)
    assert chaining.chain_regions(a) == [(0, 80, 100, 181, 60)]


def test_options():
    with pytest.raises(ValueError):
        Options(k=32)


def test_reach_goes_past_a_mismatch_and_stops_at_unlike_bases():
    assert chaining.reach("ACGTTGCAAC", "ACGTTGCAAC") == (10, 10)
    q, t = "ACGTACCTGACTTG", "ACGTAGCTGACTTG"
    assert chaining.reach(q, t) == (14, 14)
    assert chaining.reach("AAAAAAAA", "CCCCCCCC") == (0, 0) and chaining.reach("", "ACGT") == (0, 0)


def test_extended_stays_inside_and_covers_both_ends():
    rng = random.Random(5)
    core = "".join(rng.choice("ACGT") for _ in range(200))
    q, t = core, "TT" + core[:20] + ("A" if core[20] != "A" else "C") + core[21:] + "GG"
    qb, qe, tb, te = chaining.extended(q, t, (40, 150, 42, 152))
    assert 0 <= qb <= 2 and 198 <= qe <= 200 and tb - qb == 2 and te - qe == 2


def test_nearest_masks_and_reversal_against_brute_force():
    rng = np.random.default_rng(7)
    code = np.unique(rng.integers(0, 4**12, 50))
    rng.shuffle(code)
    masks, values = (np.arange(len(code)), code), rng.integers(0, 4**12, 300)
    want = [int(np.argmin(code ^ v)) for v in values]
    assert seeds.nearest_masks(values, masks, 12).tolist() == want
    turned = kmers.reverse_codes(values, 12)
    assert (kmers.reverse_codes(turned, 12) == values).all()
    assert turned[0] == int(np.base_repr(values[0], 4).zfill(12)[::-1], 4)


def test_desert_seeds_fill_the_stretch_and_come_from_the_text():
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    ids, code = np.arange(256), np.array(sorted(rng.sample(range(4**21), 256)))
    found = list(seeds.desert_seeds(seq, [500, 2500], 21, (ids, code)))
    assert len(found) > 20
    for mask, kmer, pos, rc in found:
        part = seq[pos : pos + 21]
        part = part.translate(str.maketrans("ACGT", "TGCA"))[::-1] if rc else part
        assert kmer == int("".join(str("ACGT".index(c)) for c in part), 4) and 0 <= mask < 256
    assert list(seeds.desert_seeds(seq, list(range(0, 2980, 60)), 21, (ids, code))) == []
    assert list(seeds.desert_seeds("", [], 21, (ids, code))) == [] and list(seeds.desert_seeds("A" * 500, [], 21, (ids, code))) == []


def test_thresholds():
    n, p = 1020 - 11 + 1, 0.8**11 / 4
    mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(60)]
    want = next(k for k in range(60) if sum(mass[: k + 1]) > 0.01)
    assert thresholds.least_shared(1020, 11, 4, 0.8) == want and thresholds.least_shared(5, 11, 4, 0.8) == 1
    assert thresholds.least_shared_normal(1020, 11, 4, 0.8, 0.99) == math.floor(n * p - 2.33 * math.sqrt(n * p))
