"""SQL functions of a session. All are SQL expressions, which Catalyst inlines; none starts Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandline.functions.alignment import LAMBDA, K

_CODE = "CAST(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT)"
_GRAMS = "array_sort(transform(sequence(1, length(s) - 2), i -> substring(s, i, 3)))"
_RUNS = "aggregate({grams}, struct('' AS last, 0 AS n, 0 AS total), (a, g) -> CASE WHEN a.last = g THEN struct(g AS last, a.n + 1 AS n, a.total + a.n AS total) ELSE struct(g AS last, 1 AS n, a.total AS total) END, a -> a.total)"
_EDITS = "aggregate(regexp_extract_all(s, '([0-9]+)[XID]', 1), 0, (a, x) -> a + CAST(x AS INT))"
#: Name and parameters, type, expression.
SCALARS = {
    "kmer_encode(s STRING)": ("BIGINT", _CODE),
    "kmer_decode(code BIGINT, k INT)": ("STRING", "translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT')"),
    "kmer_lcp(a BIGINT, b BIGINT, k INT)": ("INT", "CASE WHEN a = b THEN k ELSE k - (length(bin(a ^ b)) + 1) DIV 2 END"),
    "revcomp(s STRING)": ("STRING", "translate(reverse(s), 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn')"),
    "dust_score(s STRING)": ("INT", f"CASE WHEN length(s) < 3 THEN 0 ELSE {_RUNS.format(grams=_GRAMS)} END"),
    "bit_score(score DOUBLE)": ("DOUBLE", f"(score * {LAMBDA}D - ln({K}D)) / ln(2D)"),
    "e_value(bits DOUBLE, qlen DOUBLE, total DOUBLE)": ("DOUBLE", "total * power(2D, -bits) * qlen"),
    "cigar_edit_distance(s STRING)": ("INT", _EDITS),
}
TABLES = {
    "kmers(s STRING, k INT)": ("pos INT, kmer STRING, code BIGINT", f"SELECT p - 1, substring(s, p, k), {_CODE.replace('translate(s,', 'translate(substring(s, p, k),')} FROM explode(CASE WHEN length(s) >= k THEN sequence(1, length(s) - k + 1) END) AS t(p)"),
    "fragments(s STRING, size INT, least INT)": ("start INT, fragment STRING", "SELECT p - 1, substring(s, p, size) FROM explode(CASE WHEN length(s) > 0 THEN sequence(1, length(s), size) END) AS t(p) WHERE length(s) - p + 1 >= least"),
}


def _sum(*terms: str) -> str:
    """Addition that wraps, by halves of 32 bits, as ANSI mode makes an overflow an error."""
    low = " + ".join(f"({t} & 4294967295L)" for t in terms)
    high = " + ".join(f"shiftrightunsigned({t}, 32)" for t in terms)
    return f"(shiftleft({high} + shiftrightunsigned({low}, 32), 32) | (({low}) & 4294967295L))"


def _hash64() -> str:
    """The mix of kmers.hash64(); each step binds x once, so that the text doesn't double."""
    out = "x"
    left, right = "shiftleft(x, {})".format, "x ^ shiftrightunsigned(x, {})".format
    for step in (_sum("(~x)", left(21)), right(24), _sum("x", left(3), left(8)), right(14), _sum("x", left(2), left(4)), right(28), _sum("x", left(31))):
        out = f"transform(array({out}), x -> {step})[0]"
    return out


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, (kind, body) in (SCALARS | {"hash64(x BIGINT)": ("BIGINT", _hash64())}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")
