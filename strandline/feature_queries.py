"""More queries of the sequence engine with their SQL: seed geometry, code tests, sizes, screening details, reports and registered SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import alignment, kmers, sizes, sql
from strandline.operators import dealing, intervals, seeds
from strandline.plans import search
from strandline.queries import _GENOMES, genomes, items, query, table

#: Seeds of an order: places from the keys, length from the quantity, each with the line before it.
_SEEDS = "s AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 5000 AS q, l_suppkey * 7 % 5000 AS t, CAST(l_quantity AS BIGINT) AS l FROM lineitem), p AS (SELECT *, lag(q) OVER w AS q0, lag(t) OVER w AS t0, lag(l) OVER w AS l0 FROM s WINDOW w AS (PARTITION BY o ORDER BY n, q, t, l))"


def _seeds(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 5000).alias("q"), (F.col("l_suppkey") * 7 % 5000).alias("t"), F.col("l_quantity").cast("long").alias("l"))
    w = Window.partitionBy("o").orderBy("n", "q", "t", "l")
    return s.withColumns({f"{c}0": F.lag(c).over(w) for c in "qtl"}).where("q0 IS NOT NULL")


@query(f"WITH {_SEEDS} SELECT o, n, greatest(abs(q - q0), abs(t - t0)) AS distance, CASE WHEN t >= t0 THEN 1 ELSE -1 END AS direction, abs(abs(q - q0) - CASE WHEN t >= t0 THEN t - t0 ELSE abs(t + l - t0 - l0) END) AS gap, greatest(CASE WHEN q BETWEEN q0 AND q0 + l0 THEN q0 + l0 - q + 1 ELSE 0 END, CASE WHEN t BETWEEN t0 AND t0 + l0 THEN t0 + l0 - t + 1 ELSE 0 END) AS overlap, round(abs(q - q0) / 10.0, 4) AS penalty FROM p WHERE q0 IS NOT NULL")
def seed_geometry(spark, sf):
    c = F.col
    return _seeds(spark, sf).select(
        "o", "n", alignment.seed_distance(c("q"), c("t"), c("q0"), c("t0")).alias("distance"), alignment.seed_direction(c("t"), c("t0")).alias("direction"),
        alignment.seed_gap(c("q"), c("t"), c("l"), c("q0"), c("t0"), c("l0")).alias("gap"), alignment.seed_overlap(c("q0"), c("t0"), c("l0"), c("q"), c("t")).alias("overlap"),
        F.round(alignment.linear_gap_penalty(F.abs(c("q") - c("q0"))), 4).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 20000 AND l_quantity >= 20 AND l_discount * 1000 >= 15")
def good_regions(spark, sf):
    keep = alignment.good_region(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount") * 1000, 20000, 20)
    return table(spark, sf, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, (l_orderkey & 255) = (l_partkey & 255) AS same_suffix, (l_partkey >> 4) & 63 AS anchor FROM lineitem")
def kmer_parts(spark, sf):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kmers.has_suffix(a, b, 4).alias("same_suffix"), kmers.inner(b, 31, 26, 3).alias("anchor"))


@query(f"WITH {_GENOMES}, r AS (SELECT doc_id, unnest(regexp_extract_all(seq, 'A+')) AS run, FROM g) SELECT doc_id, CAST(coalesce(sum(length(run) - 1), 0) AS BIGINT) AS n FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN r USING (doc_id) GROUP BY doc_id")
def a_runs(spark, sf):
    return genomes(spark, sf).where("seq IS NOT NULL").select("doc_id", kmers.repeated_a(F.col("seq")).cast("long").alias("n"))


_DUST31 = "(SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, 30), lambda i: substr(km, i, 3))) AS g3) GROUP BY g3))"


@query(f"WITH {_GENOMES}, k AS (SELECT item_id, p - 1 AS pos, substr(seq, p, 31) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 29)) AS p FROM q)) SELECT item_id, count(*) AS n FROM k WHERE {_DUST31} <= 50 GROUP BY item_id")
def low_complexity_drop(spark, sf):
    k = kmers.explode_kmers(items(spark, sf), "item_id", "seq", 31)
    return seeds.not_low(k, "kmer", 31).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CAST(floor(CAST(p_size AS BIGINT) * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 1536 ELSE 1073741824 END) AS BIGINT) AS bytes FROM part")
def byte_sizes(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(kind == 0, size).when(kind == 1, F.concat(size, F.lit("b"))).when(kind == 2, F.concat(F.lit(" "), size, F.lit(" K"))).when(kind == 3, F.concat((F.col("p_size") * 1.5).cast("string"), F.lit("k"))).otherwise(F.concat(size, F.lit("G")))
    return table(spark, sf, "part").select("p_partkey", sizes.byte_size(text).alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey <= 1 THEN 1 ELSE 1 << CAST(length(ltrim(bin(l_partkey - 1), '0')) AS BIGINT) END AS BIGINT) AS power, l_partkey IN (SELECT CAST(pow(4, i) AS BIGINT) FROM range(31) t(i)) AS of_four FROM lineitem")
def power_sizes(spark, sf):
    n = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sizes.next_power_of_two(n).alias("power"), sizes.is_power_of_four(n).alias("of_four"))


@query("SELECT l_suppkey % 50 AS q, l_partkey % 100 AS g, l_orderkey % 16 AS mask, CAST(least(count(*), 255) AS BIGINT) AS hits, CAST(max(l_quantity) AS BIGINT) AS longest, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY ALL")
def screen_masks(spark, sf):
    m = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("q"), (F.col("l_partkey") % 100).alias("g"), (F.col("l_orderkey") % 16).alias("mask"), F.col("l_quantity").cast("long").alias("len"))
    return seeds.screen_masks(m, "q", "g", "mask")


@query("WITH g AS (SELECT l_orderkey >> 6 AS prefix, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1) SELECT *, CAST(31 - (length(ltrim(bin(xor(first, last)), '0')) + 1) // 2 AS INTEGER) AS common FROM g WHERE n > 1")
def prefix_groups(spark, sf):
    return seeds.prefix_groups(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("kmer")), "kmer", 31, 28)


@query("SELECT CASE WHEN s_nationkey < 10 THEN -s_nationkey - 1 ELSE l_suppkey END AS genome, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bases FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def chunk_regroup(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("genome"), F.col("s_nationkey").cast("long").alias("nation"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("genome"), F.col("l_quantity").cast("long").alias("bases")).join(s.select("genome"), "genome", "left_semi")
    return seeds.regroup_chunks(rows, "genome", s.where("nation < 10").select("genome", (-F.col("nation") - 1).alias("chunk_group")), ["bases"])


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_tax DESC, l_quantity DESC, l_orderkey * 8 + l_linenumber))::INTEGER AS rank FROM lineitem")
def ani_ranks(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("g", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return seeds.ranked_ani(d, "l_suppkey", "g", "l_discount", "l_tax", "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 500 AND 3000")
def sized_genomes(spark, sf):
    return seeds.sized(table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "n", 500, 3000)


@query("WITH p AS (SELECT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos, l_returnflag = 'R' AS gap FROM lineitem), e AS (SELECT grp, max(pos) AS edge FROM p GROUP BY grp), w AS (SELECT grp, gap, edge, unnest(range((pos // 100) * 100, greatest(-1, pos - 250), -100)) AS window_start FROM p JOIN e USING (grp)) SELECT grp, window_start, count(*) AS n FROM w WHERE window_start + 250 <= edge GROUP BY grp, window_start HAVING NOT bool_or(gap)")
def seed_window_gaps(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_returnflag") == "R").alias("gap"))
    p = dealing.by_rows(p, "grp")
    edge = p.groupBy("grp").agg(F.max("pos").alias("edge"))
    return intervals.sliding_counts(p.join(edge, "grp"), ["grp"], "pos", 250, 100, "gap", "edge")


@query("WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS q, l_returnflag AS g, l_linestatus AS s, lag(l_returnflag) OVER w AS g0, lag(l_linestatus) OVER w AS s0, row_number() OVER w = 1 AS new_query FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus)), m AS (SELECT *, new_query OR g <> g0 AS new_genome FROM f) SELECT o, n, new_query, new_genome, new_genome OR s <> s0 AS new_sequence, CAST(sum(CAST(new_genome AS INTEGER)) OVER (PARTITION BY q ORDER BY o, n, g, s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS genome_no FROM m")
def report_headers(spark, sf):
    d = intervals.report_headers(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_linestatus", [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")])
    return d.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "new_query", "new_genome", "new_sequence", "genome_no")


@query("SELECT count(*) AS total, count(o) AS matched, count(o) * 100.0 / count(*) AS share FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def matched_share(spark, sf):
    return intervals.matched_share(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("WITH d AS (SELECT doc_id, length(text) AS l, length(text) // 6 AS step, unnest(range(5)) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(w AS INTEGER) AS w, w * step AS b, CASE WHEN w = 4 THEN l ELSE (w + 2) * step END AS e FROM d")
def screen_windows(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("l"))
    return intervals.screening_windows(d, "l", 5).select("doc_id", F.col("window").alias("w"), F.col("start").alias("b"), F.col("end").cast("long").alias("e"))


@query("WITH j AS (SELECT conv_id, string_agg(text, 'NNNNN' ORDER BY turn) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, b AS start, b + 150 AS \"end\", md5(substr(s, CAST(greatest(b, 0) + 1 AS BIGINT), greatest(0, b + 151 - greatest(b, 0)))) AS part FROM j, (SELECT unnest([-20, 5, 100, 100000000]) AS b)")
def subseq_joined(spark, sf):
    turns = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    b = F.explode(F.array(*(F.lit(x) for x in (-20, 5, 100, 100000000)))).alias("start")
    regions = turns.select("conv_id").distinct().select("conv_id", b).withColumn("end", F.col("start") + 150)
    return seeds.subseq_joined(turns, regions, "conv_id", "turn", "text", 5).select("conv_id", "start", "end", F.md5(F.col("subseq").cast("binary")).alias("part"))


@query(f"WITH {_GENOMES}, k AS (SELECT item_id, CAST(p - 1 AS INTEGER) AS pos, substr(seq, p, 11) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 9)) AS p FROM q)) SELECT item_id, pos, km AS kmer, list_reduce(list_transform(string_split(km, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, b: a * 4 + b) AS code, km AS again, translate(reverse(km), 'ACGT', 'TGCA') AS rc FROM k")
def sql_kmers(spark, sf):
    sql.register(spark)
    q = items(spark, sf)
    return spark.sql("SELECT item_id, k.pos, k.kmer, k.code, kmer_decode(kmer_encode(k.kmer), 11) AS again, revcomp(k.kmer) AS rc FROM {q} q, LATERAL kmers(q.seq, 11) AS k", q=q)


@query(f"WITH {_GENOMES} SELECT doc_id, CAST(b AS INTEGER) AS start, md5(substr(seq, b + 1, 300)) AS part FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 300)) AS b FROM g) WHERE length(seq) - b >= 30")
def sql_fragments(spark, sf):
    sql.register(spark)
    return spark.sql("SELECT doc_id, f.start, md5(cast(f.fragment AS BINARY)) AS part FROM {g} g, LATERAL fragments(g.seq, 300, 30) AS f", g=genomes(spark, sf))


@query("SELECT l_orderkey, l_linenumber, round((CAST(l_quantity AS BIGINT) * 0.625 - ln(0.41)) / ln(2), 6) AS bits, round(1000000.0 * pow(2.0, -l_linenumber) * l_quantity, 4) AS e, CAST(l_linenumber + CAST(l_quantity AS BIGINT) AS INTEGER) AS edits, CAST(CASE WHEN l_orderkey = l_partkey THEN 31 ELSE 31 - (length(ltrim(bin(xor(l_orderkey, l_partkey)), '0')) + 1) // 2 END AS INTEGER) AS lcp FROM lineitem")
def sql_scores(spark, sf):
    sql.register(spark)
    cigar = "concat(l_linenumber, 'X9=', CAST(l_quantity AS BIGINT), 'D7=')"
    return spark.sql(f"SELECT l_orderkey, l_linenumber, round(bit_score(l_quantity), 6) AS bits, round(e_value(l_linenumber, l_quantity, 1000000), 4) AS e, cigar_edit_distance({cigar}) AS edits, kmer_lcp(l_orderkey, l_partkey, 31) AS lcp FROM {{t}}", t=table(spark, sf, "lineitem"))


def _sides(spark, sf):
    name = lambda df, key, prefix: df.select(F.concat(F.lit(prefix), key).alias("genome_id"), F.lit(0).alias("seq_idx"), "seq")
    return name(items(spark, sf), "item_id", "item"), name(genomes(spark, sf).where("seq IS NOT NULL"), "doc_id", "doc")


@query()
def genome_ani_sampled(spark, sf):
    """Benchmark items against documents: identity and aligned fractions by sampled k-mers."""
    return search.sampled_ani(*_sides(spark, sf))
