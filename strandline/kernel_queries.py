"""More queries of the sequence engine: code arithmetic, suffix seeds, statistics, result post-processing. As in queries.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import alignment, kmers
from strandline.operators import dealing, intervals, seeds
from strandline.plans import index as index_plan
from strandline.plans import search as plan
from strandline.queries import _CODE, _DNA, _GENOMES, _MASKS, _SPANS, ORACLES, _index, _places, genomes, items, query, some_masks, spans, table
from strandline.sources import writers

_TURNED = "translate(reverse(km), 'ACGT', 'TGCA')"


@query("SELECT l_orderkey, l_linenumber, l_orderkey >> 6 AS prefix9, l_orderkey & 63 AS suffix3, (l_orderkey >> 2) & 3 AS base10, l_orderkey >> 8 = l_partkey >> 8 AS same8, CAST(31 - bit_count((x | (x >> 1)) & 6148914691236517205) - CASE WHEN x = 0 THEN 31 ELSE 31 - (length(ltrim(bin(x), '0')) + 1) // 2 END AS INTEGER) AS later_matches FROM (SELECT *, xor(l_orderkey, l_partkey) AS x FROM lineitem)")
def kmer_affixes(spark, sf):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kmers.prefix(a, 12, 9).alias("prefix9"), kmers.suffix(a, 3).alias("suffix3"), kmers.base_at(a, 12, 10).alias("base10"), kmers.has_prefix(a, b, 12, 8).alias("same8"), kmers.suffix_matches(a, b, 31).alias("later_matches"))


@query(f"WITH {_GENOMES}, k AS (SELECT item_id, p - 1 AS pos, substr(seq, p, 18) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 16)) AS p FROM q)) SELECT item_id, pos, {_CODE.format(s='reverse(km)')} AS reversed, km AS decoded FROM k")
def kmer_reverse(spark, sf):
    k = kmers.explode_kmers(items(spark, sf), "item_id", "seq", 18)
    return k.select("item_id", "pos", kmers.reverse(F.col("kmer"), 18).alias("reversed"), kmers.decode(F.col("kmer"), 18).alias("decoded"))


@query(f"WITH {_GENOMES}, {_MASKS}, k AS (SELECT item_id, p - 1 AS pos, substr(seq, p, 18) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 16)) AS p FROM q)), a AS (SELECT item_id, pos, false AS rc, km, {_CODE.format(s='km')} AS f FROM k UNION ALL SELECT item_id, pos, true, {_TURNED}, {_CODE.format(s=_TURNED)} FROM k), c AS (SELECT item_id, mask_id, min(xor(f, code)) AS d FROM a, m GROUP BY ALL), s AS (SELECT DISTINCT a.item_id, a.pos, a.rc, a.km FROM c JOIN m USING (mask_id) JOIN a ON a.item_id = c.item_id AND a.f = xor(c.d, m.code)), r AS (SELECT item_id, pos, rc, {_CODE.format(s='reverse(km)')} AS kmer FROM s) SELECT item_id, pos, rc, kmer, arg_min(mask_id, xor(kmer, code)) AS mask_id FROM r, m GROUP BY ALL")
def reversed_seeds(spark, sf):
    masks = some_masks(spark)
    return seeds.reversed_seeds(seeds.capture(items(spark, sf), "item_id", "seq", masks, 18), masks, 18)


@query("SELECT c_custkey, s_suppkey, CAST(CASE WHEN x = 0 THEN 12 ELSE (length(bin(x)) - length(rtrim(bin(x), '0'))) // 2 END AS INTEGER) AS len FROM (SELECT c_custkey, s_suppkey, xor(c_custkey, s_suppkey) AS x FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey & 63 = s_suppkey & 63)")
def suffix_match(spark, sf):
    side = lambda name, key, nation: table(spark, sf, name).select(key, F.col(nation).alias("mask_id"), kmers.reverse(F.col(key), 12).alias("kmer"))
    return seeds.match(side("customer", "c_custkey", "c_nationkey"), side("supplier", "s_suppkey", "s_nationkey"), 12, 3, ["mask_id"]).select("c_custkey", F.col("s_s_suppkey").alias("s_suppkey"), "len")


_HASH_STEPS = (
    "((18446744073709551615::UHUGEINT - h + h * 2097152) % 18446744073709551616)",
    "xor(h, h >> 24)",
    "((h + h * 8 + h * 256) % 18446744073709551616)",
    "xor(h, h >> 14)",
    "((h + h * 4 + h * 16) % 18446744073709551616)",
    "xor(h, h >> 28)",
    "((h + h * 2147483648) % 18446744073709551616)",
)
_HASHED = ", ".join(f"h{n + 1} AS (SELECT * REPLACE (CAST({step} AS UHUGEINT) AS h) FROM h{n})" for n, step in enumerate(_HASH_STEPS))


@query(f"WITH {_GENOMES}, k AS (SELECT item_id, p - 1 AS pos, substr(seq, p, 13) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 11)) AS p FROM q)), b AS (SELECT item_id, pos, {_CODE.format(s='km')} AS kmer, {_CODE.format(s=_TURNED)} AS rc FROM k), h0 AS (SELECT *, CAST(least(kmer, rc) AS UHUGEINT) AS h FROM b), {_HASHED} SELECT item_id, pos, kmer, rc FROM h{len(_HASH_STEPS)} WHERE h % 4 = 0")
def sampled_kmers(spark, sf):
    return kmers.explode_kmers(items(spark, sf), "item_id", "seq", 13, scale=4)


@query(f"WITH {_GENOMES}, w AS (SELECT item_id, s AS start, substr(seq, s, 31) AS x FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 29)) AS s FROM q)), gr AS (SELECT item_id, start, n, substr(x, i, n) AS gram FROM (SELECT *, unnest(range(1, 33 - n)) AS i FROM (SELECT *, unnest([2, 3]) AS n FROM w))), c AS (SELECT item_id, start, n, gram, count(*) AS times FROM gr GROUP BY ALL), t AS (SELECT item_id, start, count(*) FILTER (n = 2) AS k2, count(*) FILTER (n = 3) AS k3, max(times) FILTER (n = 2) AS m2, max(times) FILTER (n = 3) AS m3 FROM c GROUP BY ALL) SELECT item_id, start, k2 < 4 AND (m2 >= 14 OR (k3 < 8 AND m3 >= 9)) AS low FROM t")
def low_complexity(spark, sf):
    """Of the window of 31 bases at every base."""
    w = items(spark, sf).where(F.length("seq") >= 31).select("item_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 30)).alias("start"))
    return w.select("item_id", F.col("start").cast("long"), kmers.monotonous(F.substring(F.col("seq"), F.col("start"), F.lit(31))).alias("low"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 * l_quantity * l_quantity, 6) AS weight, round(CASE WHEN g = 0 THEN 0 ELSE 0.1 * g + 0.5 * log2(g) END, 6) AS penalty FROM (SELECT *, CAST(l_orderkey % 7 AS DOUBLE) AS g FROM lineitem)")
def seed_scores(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("g", (F.col("l_orderkey") % 7).cast("double"))
    return li.select("l_orderkey", "l_linenumber", F.round(alignment.seed_weight(F.col("l_quantity")), 6).alias("weight"), F.round(alignment.gap_penalty(F.col("g")), 6).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN s IS NULL THEN 60 ELSE greatest(0, least(60, floor(40 * (b - s) / b * 0.5 * 0.75 * (1 - 0.25)))) END AS INTEGER) AS mapq, CAST(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linenumber > 1 THEN 256 ELSE 0 END AS INTEGER) AS flag, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS VARCHAR) || 'S' ELSE '' END || '20=' || CASE WHEN l_linenumber < 7 THEN CAST(7 - l_linenumber AS VARCHAR) || 'S' ELSE '' END AS cigar FROM (SELECT *, l_quantity + 50 AS b, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS DOUBLE) END AS s FROM lineitem)")
def sam_fields(spark, sf):
    n = F.col("l_linenumber")
    quality = alignment.mapq(F.col("l_quantity") + 50, F.when(n > 1, n.cast("double")), F.lit(0.5), F.lit(0.75), F.lit(0.25))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", quality.alias("mapq"), alignment.sam_flag(F.col("l_returnflag") == "R", n > 1).alias("flag"), alignment.soft_clip(F.lit("20="), n, n + 19, F.lit(26)).alias("cigar"))


def _distances(spark, sf):
    return intervals.gaps_to_previous(_places(spark, sf), ["grp"], "pos")


_DISTANCES = "WITH p AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos FROM lineitem), d AS (SELECT grp, pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos) AS distance FROM p)"


@query(_DISTANCES + " SELECT grp, count(*) AS n, min(distance) AS least, max(distance) AS most, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS stdev, round(quantile_cont(distance, 0.25), 6) AS q25, round(quantile_cont(distance, 0.5), 6) AS q50, round(quantile_cont(distance, 0.75), 6) AS q75 FROM d WHERE distance IS NOT NULL GROUP BY grp")
def seed_distance_spread(spark, sf):
    s = intervals.spread(_distances(spark, sf), ["grp"], "distance")
    return s.select("grp", "n", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "stdev", "q25", "q50", "q75")))


@query(_DISTANCES + " SELECT grp, (distance // 100) * 100 AS bin, count(*) AS n FROM d WHERE distance IS NOT NULL GROUP BY ALL")
def seed_distance_histogram(spark, sf):
    return intervals.histogram(_distances(spark, sf), ["grp"], "distance", 100)


@query("WITH k AS (SELECT DISTINCT l_orderkey AS frag, l_partkey AS kmer FROM lineitem), o AS (SELECT DISTINCT l_suppkey AS other, l_partkey AS kmer FROM lineitem), c AS (SELECT frag, other, count(*) AS n FROM k JOIN o USING (kmer) GROUP BY ALL HAVING count(*) >= 2) SELECT frag, other, n FROM (SELECT *, row_number() OVER (PARTITION BY frag ORDER BY n DESC, other) AS r FROM c) WHERE r <= 2")
def top_fragments(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "frag", "l_suppkey": "other", "l_partkey": "kmer"})
    return intervals.top(seeds.shared(li, li, "kmer", "frag", "other", 2), ["frag"], [F.desc("n"), F.col("other")], 2).drop("rank")


@query(f"WITH {_SPANS}, c AS (SELECT grp, count(*) AS n, min(b) AS b, max(e) AS e, CAST(sum(n) AS BIGINT) AS matched FROM s GROUP BY grp), m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), i AS (SELECT *, sum(CASE WHEN b <= before THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isl FROM m), u AS (SELECT grp, max(e) - min(b) + 1 AS size FROM i GROUP BY grp, isl), a AS (SELECT grp, CAST(sum(size) AS BIGINT) AS aligned FROM u GROUP BY grp) SELECT grp, c.n, b, e, matched, aligned, round(least(100.0, aligned / 6000.0 * 100), 6) AS coverage, round(least(100.0, CAST(matched AS DOUBLE) / aligned * 100), 6) AS identity FROM c JOIN a USING (grp)")
def hsp_cluster_rollup(spark, sf):
    s = dealing.by_rows(spans(spark, sf), "grp").withColumnRenamed("n", "matches").withColumn("size", F.lit(6000))
    out = intervals.roll_up(s, ["grp"], "b", "e", "matches", "size")
    return out.select("grp", "n", "b", "e", "matched", "aligned", F.round("coverage", 6).alias("coverage"), F.round("identity", 6).alias("identity"))


@query(f"WITH {_SPANS} SELECT x.grp, x.o AS o1, x.n AS n1, y.o AS o2, y.n AS n2 FROM s x JOIN s y ON x.grp = y.grp AND abs(x.b - y.e) <= 20")
def positions_within(spark, sf):
    s = spans(spark, sf)
    a = s.select("grp", "b", F.col("o").alias("o1"), F.col("n").alias("n1"))
    b = s.select("grp", "e", F.col("o").alias("o2"), F.col("n").alias("n2"))
    return intervals.near(a, b, "grp", "b", "e", 20).select("grp", "o1", "n1", "o2", "n2")


@query("WITH r AS (SELECT l_partkey AS query, l_suppkey AS sgenome, l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS bitscore, 80.0 + l_linenumber AS pident FROM lineitem), b AS (SELECT *, max(bitscore * pident) OVER (PARTITION BY query, sgenome) AS best FROM r), k AS (SELECT * EXCLUDE (best), dense_rank() OVER (PARTITION BY query ORDER BY best DESC, sgenome) AS genome_rank FROM b) SELECT query, sgenome, o, n, genome_rank, max(genome_rank) OVER (PARTITION BY query) AS hits FROM k")
def merge_results(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("sgenome"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("bitscore"), (F.col("l_linenumber") + 80.0).alias("pident"))
    out = plan.merge_results(*(r.where(F.col("o") % 3 == k) for k in range(3)))
    return out.select("query", "sgenome", "o", "n", F.col("genome_rank").cast("long").alias("genome_rank"), F.col("hits").cast("long").alias("hits"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
t AS (SELECT conv_id, turn, r, n AS run, 0 AS chunk_idx FROM c WHERE r = 1 UNION ALL
SELECT c.conv_id, c.turn, c.r, CASE WHEN t.run + c.n > 300 THEN c.n ELSE t.run + c.n END, t.chunk_idx + CAST(t.run + c.n > 300 AS INTEGER) FROM t JOIN c ON c.conv_id = t.conv_id AND c.r = t.r + 1)
SELECT conv_id, turn, chunk_idx FROM t""")
def genome_chunks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("genome_id"), F.col("turn").alias("seq_idx"), F.length("text").alias("seq_len"))
    return index_plan.chunked(c, 300).select(F.col("genome_id").alias("conv_id"), F.col("seq_idx").alias("turn"), "chunk_idx")


@query(f"SELECT item_id, md5('>' || item_id || chr(10) || rtrim(regexp_replace({_DNA}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS record_md5 FROM benchmark")
def fasta_records(spark, sf):
    q = items(spark, sf)
    return writers.fasta_text(q, F.col("item_id").cast("string"), F.col("seq")).select(F.regexp_extract("value", "^>(\\d+)", 1).cast("long").alias("item_id"), F.md5(F.col("value").cast("binary")).alias("record_md5"))


def _contigs(df, key, prefix):
    return df.select(F.concat(F.lit(prefix), key).alias("genome_id"), F.lit(0).alias("seq_idx"), "seq")


@query()
def genome_ani(spark, sf):
    """Benchmark items against documents: identity and aligned fractions by mutual best fragments."""
    return plan.ani(_contigs(items(spark, sf), "item_id", "item"), _contigs(genomes(spark, sf), "doc_id", "doc"), min_coverage=15)


@query()
def index_places(spark, sf):
    """All seeds of the index of the documents: captured, added where 100 bases hold none, and reversed."""
    return _index(spark, sf).seeds
