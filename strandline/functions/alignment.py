"""Column functions on alignments: scores, identities, CIGAR text, SAM fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LAMBDA, K = 0.625, 0.41


def raw_score(matches: Column, mismatches: Column, gap_opens: Column, gap_bases: Column) -> Column:
    """+2 a match, -3 a mismatch, -(5 + 2n) a gap of n; odd scores lose one."""
    s = matches * 2 - mismatches * 3 - gap_opens * 5 - gap_bases * 2
    return s - F.pmod(s, F.lit(2))


def bits(score: Column) -> Column:
    return (score * LAMBDA - math.log(K)) / math.log(2)


def e_value(bit: Column, query_part: Column, total_bases: Column | int) -> Column:
    return F.lit(total_bases) * F.pow(F.lit(2.0), -bit) * query_part if isinstance(total_bases, int) else total_bases * F.pow(F.lit(2.0), -bit) * query_part


def score_of_bits(bit: Column) -> Column:
    return ((bit * math.log(2) + math.log(K)) / LAMBDA).cast("int")


def seed_weight(length: Column) -> Column:
    return length * length * 0.1


def gap_penalty(gap: Column) -> Column:
    return F.when(gap == 0, F.lit(0.0)).otherwise(gap * 0.1 + F.log2(gap) * 0.5)


def seed_distance(qa: Column, ta: Column, qb: Column, tb: Column) -> Column:
    """The larger of the distances of two seeds on query and target."""
    return F.greatest(F.abs(qa - qb), F.abs(ta - tb))


def seed_direction(ta: Column, tb: Column) -> Column:
    """1 if the target goes on from b to a, -1 if it goes back."""
    return F.when(ta >= tb, 1).otherwise(-1)


def seed_gap(qa: Column, ta: Column, la: Column, qb: Column, tb: Column, lb: Column) -> Column:
    """Difference of the distances on query and target; on the reverse strand the target is measured between the seeds' ends."""
    return F.abs(F.abs(qa - qb) - F.when(ta >= tb, F.abs(ta - tb)).otherwise(F.abs(ta + la - tb - lb)))


def linear_gap_penalty(gap: Column) -> Column:
    """The penalty of the banded chaining: no logarithm."""
    return gap * 0.1


def seed_overlap(qa: Column, ta: Column, la: Column, qb: Column, tb: Column) -> Column:
    """Bases that seed a, the one in front, shares with b on query or target, whichever are more; touching counts as one."""
    on = lambda a, b: F.when((b >= a) & (b <= a + la), a + la - b + 1).otherwise(0)
    return F.greatest(on(qa, qb), on(ta, tb))


def good_region(score: Column, aligned: Column, identity: Column, min_score: float, min_aligned: int, min_identity: float = 15.0) -> Column:
    """Thresholds of a chained region; whole genomes are compared with min_identity 0."""
    return (score >= min_score) & (aligned >= min_aligned) & (identity >= min_identity)


def share(part: Column, whole: Column) -> Column:
    """Per cent, 100 at most."""
    return F.least(F.lit(100.0), part / whole * 100)


def cigar_sum(cigar: Column, kinds: str) -> Column:
    """Bases of the operations in kinds."""
    found = F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{kinds}]"), 1)
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def edit_distance(cigar: Column) -> Column:
    return cigar_sum(cigar, "XID")


def swap_indels(cigar: Column) -> Column:
    return F.translate(cigar, "ID", "DI")


def gap_count(aligned: Column) -> Column:
    return F.length(aligned) - F.length(F.replace(aligned, F.lit("-"), F.lit("")))


def mapq(best: Column, second: Column, coverage: Column, identity: Column, gap_share: Column) -> Column:
    """60 for the only alignment of a query, else by the lead over the true second best; 0 to 60."""
    q = 40 * (best - second) / best * coverage * identity * (1 - gap_share)
    return F.when(second.isNull(), F.lit(60)).otherwise(F.greatest(F.lit(0), F.least(F.lit(60), F.floor(q)))).cast("int")


def sam_flag(reverse: Column, secondary: Column) -> Column:
    return (F.when(reverse, 0x10).otherwise(0) + F.when(secondary, 0x100).otherwise(0)).cast("int")


def soft_clip(cigar: Column, qstart: Column, qend: Column, qlen: Column) -> Column:
    left, right = qstart - 1, qlen - qend
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(left), cigar, clip(right))
