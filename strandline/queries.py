"""Queries of the sequence engine on the driver's tables, with the SQL that gives the same rows.

Documents stand for genomes and benchmark items for query sequences, by functions.kmers.dna(); intervals, positions and groups come from the
order tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import alignment, kmers
from strandline.operators import dealing, intervals, seeds
from strandline.plans import search as plan
from strandline.plans.index import Index, Options
from strandline.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 21

_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_GENOMES = f"g AS (SELECT doc_id, {_DNA} AS seq FROM documents), q AS (SELECT item_id, {_DNA} AS seq FROM benchmark)"
_CODE = "list_reduce(list_transform(string_split({s}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda a, b: a * 4 + b)"
#: Closed intervals by part: begin from the price, length from the quantity.
_SPANS = "s AS (SELECT l_partkey AS grp, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS b, CAST(floor(l_extendedprice) AS BIGINT) % 5000 + CAST(l_quantity AS BIGINT) AS e, l_orderkey AS o, l_linenumber AS n FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def genomes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a few files that can't be split; a large table is read as it is split
        docs = docs.repartition(cores)
    return kmers.dna_of(docs, "doc_id", "text")


def items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", kmers.dna(F.col("text")).alias("seq"))


def spans(spark, sf):
    b = F.floor("l_extendedprice").cast("long") % 5000
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("grp"), b.alias("b"), (b + F.col("l_quantity").cast("long")).alias("e"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))


_SHARED = f"""WITH {_GENOMES}, qk AS (SELECT DISTINCT item_id, p, substr(seq, p, {K}) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM q)),
gk AS (SELECT DISTINCT doc_id, km FROM (SELECT doc_id, substr(seq, p, {K}) AS km FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM g)) WHERE km IN (SELECT km FROM qk)),
h AS (SELECT item_id, doc_id, km, p, least({K}, coalesce(p - lag(p) OVER (PARTITION BY item_id, doc_id ORDER BY p), {K})) AS step FROM qk JOIN gk USING (km)),
t AS (SELECT item_id, doc_id, count(DISTINCT km) AS n, CAST(sum(step) AS BIGINT) AS covered FROM h GROUP BY ALL)"""


def _coverage(spark, sf):
    q = kmers.explode_kmers(items(spark, sf), "item_id", "seq", K)
    g = kmers.explode_kmers(genomes(spark, sf), "doc_id", "seq", K, only=kmers.sorted_codes(q))
    return seeds.query_coverage(q, g, "item_id", "doc_id", K)


@query(_SHARED + " SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY covered DESC, doc_id) AS r FROM t) WHERE r <= 10")
def flagship_shared_kmers(spark, sf):
    return intervals.top(_coverage(spark, sf), ["item_id"], [F.desc("covered"), F.col("doc_id")], 10).drop("rank")


@query(_SHARED + f", lens AS (SELECT item_id, length(seq) AS qlen FROM q) SELECT item_id, doc_id, covered, round(least(100.0, covered * 100.0 / qlen), 6) AS qcov FROM t JOIN lens USING (item_id)")
def query_coverage_per_genome(spark, sf):
    lens = items(spark, sf).select("item_id", F.length("seq").alias("qlen"))
    return _coverage(spark, sf).join(lens, "item_id").select("item_id", "doc_id", "covered", F.round(alignment.share(F.col("covered"), F.col("qlen")), 6).alias("qcov"))


@query(f"WITH {_GENOMES}, k AS (SELECT item_id, p - 1 AS pos, substr(seq, p, {K}) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM q)) SELECT item_id, pos, {_CODE.format(s='km')} AS kmer, {_CODE.format(s=chr(116) + 'ranslate(reverse(km), ' + chr(39) + 'ACGT' + chr(39) + ', ' + chr(39) + 'TGCA' + chr(39) + ')')} AS rc FROM k")
def kmer_enumerate(spark, sf):
    return kmers.explode_kmers(items(spark, sf), "item_id", "seq", K)


@query(f"WITH {_GENOMES}, k AS (SELECT doc_id, substr(seq, p, {K}) AS km FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM g)) SELECT doc_id, count(*) AS n, count(DISTINCT least(km, translate(reverse(km), 'ACGT', 'TGCA'))) AS n_canonical FROM k GROUP BY doc_id")
def kmer_canonical(spark, sf):
    return kmers.count_kmers(genomes(spark, sf), "doc_id", "seq", K).where("n > 0")


@query(f"WITH {_GENOMES} SELECT doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc_md5 FROM g")
def revcomp(spark, sf):
    return genomes(spark, sf).select("doc_id", F.md5(kmers.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, 'acgtubsykUBSYK', 'ACGTTCCCGTCCCG'), '[^ACGT]', 'A', 'g')) AS bases_md5 FROM documents")
def base_convert(spark, sf):
    """Bases of every document, whatever its characters. A null text has a null digest."""
    return table(spark, sf, "documents").select("doc_id", F.md5(kmers.plain_bases(F.col("text")).cast("binary")).alias("bases_md5"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey = l_partkey THEN 31 ELSE 31 - (length(ltrim(bin(xor(l_orderkey, l_partkey)), '0')) + 1) // 2 END AS INTEGER) AS lcp, CAST(bit_count((xor(l_orderkey, l_partkey) | (xor(l_orderkey, l_partkey) >> 1)) & 6148914691236517205) AS INTEGER) AS mismatches FROM lineitem")
def kmer_lcp(spark, sf):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kmers.common_prefix(a, b, 31).alias("lcp"), kmers.mismatches(a, b).alias("mismatches"))


@query(f"WITH {_GENOMES}, t AS (SELECT item_id, w, substr(seq, w + i, 3) AS g3 FROM (SELECT item_id, seq, w, unnest(range(0, 29)) AS i FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 29)) AS w FROM q))), c AS (SELECT item_id, w, g3, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, w AS start, CAST(sum(n * (n - 1) // 2) AS INTEGER) AS dust FROM c GROUP BY item_id, w")
def dust_score(spark, sf):
    """Of the window of 31 bases at every base."""
    w = items(spark, sf).where(F.length("seq") >= 31).select("item_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 30)).alias("start"))
    return w.select("item_id", F.col("start").cast("long"), kmers.dust(F.substring(F.col("seq"), F.col("start"), F.lit(31))).alias("dust"))


@query("SELECT l_orderkey, l_linenumber, round((s * 0.625 - ln(0.41)) / ln(2), 6) AS bits FROM (SELECT *, r - ((r % 2) + 2) % 2 AS s FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 20 - l_linenumber * 3 - 2 * 5 - l_linenumber * 2 AS r FROM lineitem))")
def bit_score_evalue(spark, sf):
    q = F.col("l_quantity").cast("long") * 10
    s = alignment.raw_score(q, F.col("l_linenumber").cast("long"), F.lit(2), F.col("l_linenumber").cast("long"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(alignment.bits(s), 6).alias("bits"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber + CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS INTEGER) AS edits FROM lineitem")
def cigar_edit_distance(spark, sf):
    q = F.col("l_quantity").cast("long").cast("string")
    cigar = F.concat(q, F.lit("="), F.col("l_linenumber").cast("string"), F.lit("X"), F.when(F.col("l_returnflag") == "R", F.concat(q, F.lit("D"))).otherwise(""), F.lit("5="))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", alignment.edit_distance(cigar).alias("edits"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_start, length(text) AS seq_len FROM conversations")
def contig_offsets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1000).over(w), F.lit(0)).cast("long").alias("offset_start"), F.length("text").cast("long").alias("seq_len"))


@query("SELECT doc_id, CAST(len(r) AS BIGINT) AS n_gaps, CAST(coalesce(list_sum(list_transform(r, lambda x: length(x))), 0) AS BIGINT) AS gap_bases FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^a-zA-Z]', 'N', 'g'), 'N{2,}') AS r FROM documents)")
def gap_regions(spark, sf):
    r = F.regexp_extract_all(F.regexp_replace("text", "[^a-zA-Z]", "N"), F.lit("(N{2,})"), 1)
    return table(spark, sf, "documents").select("doc_id", F.size(r).cast("long").alias("n_gaps"), F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("gap_bases"))


@query(f"WITH {_GENOMES}, f AS (SELECT doc_id, s AS start, substr(seq, s + 1, 1020) AS frag FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 1020)) AS s FROM g)) SELECT doc_id, start, length(frag) AS frag_len, md5(frag) AS frag_md5 FROM f WHERE length(frag) >= 100")
def fragments(spark, sf):
    f = plan.fragments(genomes(spark, sf).select(F.col("doc_id").alias("genome_id"), F.lit(0).alias("seq_idx"), "seq"))
    return f.select(F.col("genome_id").alias("doc_id"), F.split("frag", ":")[1].cast("long").alias("start"), F.col("frag_len").cast("long").alias("frag_len"), F.md5(F.col("seq").cast("binary")).alias("frag_md5"))


@query("SELECT doc_id, count(*) AS num_seqs, CAST(sum(length(x)) AS BIGINT) AS genome_size, CAST(max(length(x)) AS BIGINT) AS largest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) >= 31 AND NOT regexp_matches(x, '(?i)license') GROUP BY doc_id")
def genome_details(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where((F.length("x") >= 31) & ~F.col("x").rlike("(?i)license"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_seqs"), F.sum(F.length("x")).alias("genome_size"), F.max(F.length("x")).cast("long").alias("largest"))


@query("SELECT page_id, regexp_replace(url, '^https?://([^/]+)/.*$', 'g_\\1') AS genome_id FROM pages")
def rename_genomes(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://([^/]+)/.*$", "g_$1").alias("genome_id"))


_MASKS = "m AS (SELECT CAST(i AS INTEGER) AS mask_id, CAST((i % 64) * 1073741824 + (i * 2654435761) % 1073741824 AS BIGINT) AS code FROM range(0, 128) t(i))"


def some_masks(spark):
    return spark.range(128).select(F.col("id").cast("int").alias("mask_id"), ((F.col("id") % 64) * 1073741824 + (F.col("id") * 2654435761) % 1073741824).alias("code"))


@query(f"WITH {_GENOMES}, {_MASKS}, k AS (SELECT item_id, {_CODE.format(s='km')} AS f, {_CODE.format(s='translate(reverse(km), ' + chr(39) + 'ACGT' + chr(39) + ', ' + chr(39) + 'TGCA' + chr(39) + ')')} AS r FROM (SELECT item_id, substr(seq, p, 18) AS km FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 16)) AS p FROM q))), a AS (SELECT item_id, f AS kmer FROM k UNION ALL SELECT item_id, r FROM k), c AS (SELECT item_id, mask_id, min(xor(kmer, code)) AS d FROM a, m GROUP BY ALL) SELECT c.item_id, c.mask_id, xor(c.d, m.code) AS kmer, count(*) AS n FROM c JOIN m USING (mask_id) JOIN a ON a.item_id = c.item_id AND a.kmer = xor(c.d, m.code) GROUP BY ALL")
def mask_capture(spark, sf):
    found = seeds.capture(items(spark, sf), "item_id", "seq", some_masks(spark), 18)
    return found.groupBy("item_id", "mask_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MASKS} SELECT mask_id, code FROM (SELECT *, row_number() OVER (PARTITION BY code >> 32 ORDER BY mask_id) AS r FROM m) WHERE r = 1")
def mask_prefix_subset(spark, sf):
    return seeds.mask_subset(some_masks(spark), 18, 16)


@query("WITH p AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) SELECT grp, pos, pos - lag(pos) OVER (PARTITION BY grp ORDER BY pos) AS distance FROM p")
def seed_pos_distance(spark, sf):
    return intervals.gaps_to_previous(_places(spark, sf), ["grp"], "pos")


def _places(spark, sf, *by):
    """Distinct places, dealt by grp, or by other columns."""
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return dealing.by_rows(p, *(by or ["grp"])).distinct()


@query("WITH p AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) SELECT * FROM (SELECT grp, lag(pos) OVER (PARTITION BY grp ORDER BY pos) AS after, pos AS before FROM p) WHERE before - after >= 100")
def seed_desert(spark, sf):
    return intervals.deserts(_places(spark, sf), ["grp"], "pos", 100)


@query("WITH p AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos FROM lineitem), w AS (SELECT grp, unnest(range((pos // 100) * 100, greatest(-1, pos - 250), -100)) AS window_start FROM p) SELECT grp, window_start, count(*) AS n FROM w GROUP BY ALL")
def seed_window_counts(spark, sf):
    windows = 3 * table(spark, sf, "lineitem").count()  # of a place, at most
    return intervals.sliding_counts(_places(spark, sf, "grp", "pos"), ["grp"], "pos", 250, 100, parts=dealing.tasks(spark.range(0), windows, 2 * dealing.TASK_ROWS))


@query("SELECT * EXCLUDE (r) FROM (SELECT l_partkey AS kmer, l_suppkey AS grp, l_orderkey * 8 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 8 + l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def max_kmer_freq(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("kmer"), F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return seeds.first_places(rows, ["kmer", "grp"], "pos", 2)


@query("SELECT c_custkey, s_suppkey, CAST(CASE WHEN c_custkey = s_suppkey THEN 12 ELSE 12 - (length(ltrim(bin(xor(c_custkey, s_suppkey)), '0')) + 1) // 2 END AS INTEGER) AS len FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey >> 4 = s_suppkey >> 4")
def prefix_match(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("mask_id"), F.col("c_custkey").alias("kmer"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("mask_id"), F.col("s_suppkey").alias("kmer"))
    return seeds.match(q, s, 12, 10, ["mask_id"]).select("c_custkey", F.col("s_s_suppkey").alias("s_suppkey"), "len")


_TREE = "t AS (SELECT n_nationkey + 10 AS node, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, 100 FROM region UNION ALL SELECT 100, NULL)"


def _tree(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 10).alias("node"), F.col("n_regionkey").alias("parent"))
    return n.union(table(spark, sf, "region").select("r_regionkey", F.lit(100))).union(spark.sql("select 100, cast(null as int)"))


@query("SELECT c_custkey, c_nationkey + 10 AS taxid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)")
def taxid_include(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 10).alias("taxid"))
    return seeds.by_taxon(c, "taxid", seeds.ancestors(_tree(spark, sf), "node", "parent"), [1, 2], []).select("c_custkey", "taxid")


@query("SELECT c_custkey, c_nationkey + 10 AS taxid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey NOT IN (1, 2) AND c_custkey % 7 <> 0")
def taxid_exclude(spark, sf):
    """A seventh of the customers have no taxon; these go, as unknown ones are not kept."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") + 10).alias("taxid"))
    return seeds.by_taxon(c, "taxid", seeds.ancestors(_tree(spark, sf), "node", "parent"), [], [1, 2]).select("c_custkey", "taxid")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def genome_whitelist(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


_ANCHORS = "a AS (SELECT DISTINCT l_suppkey * 50 + l_partkey % 50 AS grp, l_partkey % 97 AS qb, l_partkey % 97 + 15 + l_linenumber AS qe, l_orderkey % 89 AS tb, l_orderkey % 89 + 15 + CAST(l_quantity AS BIGINT) % 8 AS te FROM lineitem)"


@query(f"WITH {_ANCHORS} SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE x.grp = y.grp AND x.qb >= y.qb AND x.qe <= y.qe AND x.tb >= y.tb AND x.te <= y.te AND (x.qb <> y.qb OR x.qe <> y.qe OR x.tb <> y.tb OR x.te <> y.te))")
def anchor_dedup(spark, sf):
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    a = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 50 + p % 50).alias("grp"), (p % 97).alias("qb"), (p % 97 + 15 + F.col("l_linenumber")).alias("qe"), (o % 89).alias("tb"), (o % 89 + 15 + F.col("l_quantity").cast("long") % 8).alias("te"))
    return intervals.not_nested(a, ["grp"], "qb", "qe", "tb", "te")


@query("WITH t AS (SELECT l_partkey AS grp, l_suppkey AS genome, round(sum(l_quantity), 4) AS score FROM lineitem GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, genome) AS rank FROM t) WHERE rank <= 3")
def topn_genomes(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("grp"), F.col("l_suppkey").alias("genome")).agg(F.round(F.sum("l_quantity"), 4).alias("score"))
    return intervals.top(g, ["grp"], [F.desc("score"), F.col("genome")], 3).withColumn("rank", F.col("rank").cast("long"))


_ISLANDS = f"WITH {_SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), i AS (SELECT *, sum(CASE WHEN b <= before THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS isl FROM m), u AS (SELECT grp, isl, min(b) AS b, max(e) AS e, count(*) AS n FROM i GROUP BY ALL)"


@query(_ISLANDS + " SELECT grp, b, e, n FROM u")
def interval_merge(spark, sf):
    return intervals.merged(dealing.by_rows(spans(spark, sf), "grp"), ["grp"], "b", "e")


@query(_ISLANDS + " SELECT grp, CAST(sum(e - b + 1) AS BIGINT) AS covered FROM u GROUP BY grp")
def coverage_union(spark, sf):
    return intervals.union_length(dealing.by_rows(spans(spark, sf), "grp"), ["grp"], "b", "e")


_HITS = "h AS (SELECT l_partkey AS query, l_suppkey AS genome, l_linenumber AS cluster, l_orderkey AS o, round(l_extendedprice, 2) AS score FROM lineitem), x AS (SELECT *, max(score) OVER (PARTITION BY query, genome, cluster) AS bc, max(score) OVER (PARTITION BY query, genome) AS bg FROM h)"


@query(f"WITH {_HITS}, y AS (SELECT query, genome, cluster, o, score, dense_rank() OVER (PARTITION BY query, genome ORDER BY bc DESC, cluster) AS cls, row_number() OVER (PARTITION BY query, genome ORDER BY bc DESC, cluster, score DESC, o) AS hsp, dense_rank() OVER (PARTITION BY query ORDER BY bg DESC, genome) AS genome_rank FROM x) SELECT *, max(genome_rank) OVER (PARTITION BY query) AS hits FROM y")
def hsp_numbering(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("genome"), F.col("l_linenumber").alias("cluster"), F.col("l_orderkey").alias("o"), F.round("l_extendedprice", 2).alias("score"))
    out = intervals.number_hits(dealing.by_rows(h, "query"), "query", "genome", "cluster", "score", ["o"])
    return out.select("query", "genome", "cluster", "o", "score", *(F.col(c).cast("long").alias(c) for c in ("cls", "hsp", "genome_rank", "hits")))


@query("SELECT DISTINCT l_partkey AS grp, CAST(l_quantity AS BIGINT) AS qb, l_linenumber AS tb, l_returnflag AS rc FROM lineitem")
def dup_alignment(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("grp"), F.col("l_quantity").cast("long").alias("qb"), F.col("l_linenumber").alias("tb"), F.col("l_returnflag").alias("rc"))
    return rows.dropDuplicates()


@query("WITH b AS (SELECT l_partkey AS query, l_suppkey AS genome, l_linenumber AS mask, max(CAST(l_quantity AS INTEGER)) AS len FROM lineitem GROUP BY ALL) SELECT query, genome, count(*) AS nMasks, round(count(*) / 7.0, 6) AS fracMasks, CAST(sum(len) AS BIGINT) AS sumPrefix, round(avg(len), 6) AS avgPrefix, string_agg(CAST(len AS VARCHAR), ',' ORDER BY len DESC) AS prefixes FROM b GROUP BY ALL")
def genome_screen(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("genome"), F.col("l_linenumber").alias("mask"), F.col("l_quantity").cast("int").alias("len"))
    return seeds.screen(m, "query", "genome", "mask", 7).withColumn("fracMasks", F.round("fracMasks", 6)).withColumn("avgPrefix", F.round("avgPrefix", 6))


@query("WITH k AS (SELECT DISTINCT l_orderkey AS frag, l_partkey AS kmer FROM lineitem), o AS (SELECT DISTINCT l_suppkey AS other, l_partkey AS kmer FROM lineitem) SELECT frag, other, count(*) AS n FROM k JOIN o USING (kmer) GROUP BY ALL HAVING count(*) >= 3")
def fragment_shared_kmers(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "frag", "l_suppkey": "other", "l_partkey": "kmer"})
    return seeds.shared(li, li, "kmer", "frag", "other", 3)


@query("WITH h AS (SELECT l_partkey AS a, l_suppkey AS b, round(sum(l_quantity), 4) AS score FROM lineitem GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r1, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS r2 FROM h) SELECT a, b, score FROM x WHERE r1 = 1 AND r2 = 1")
def reciprocal_best(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.round(F.sum("l_quantity"), 4).alias("score"))
    return seeds.reciprocal(h, "a", "b", "score")


@query("WITH s AS (SELECT DISTINCT c_nationkey AS g, c_custkey % 64 AS mask, c_custkey AS kmer FROM customer), j AS (SELECT a.g AS g1, b.g AS g2, a.mask, max(CASE WHEN a.kmer = b.kmer THEN 12 ELSE 12 - (length(ltrim(bin(xor(a.kmer, b.kmer)), '0')) + 1) // 2 END) AS len FROM s a JOIN s b ON a.mask = b.mask AND a.kmer >> 12 = b.kmer >> 12 AND a.g < b.g GROUP BY ALL) SELECT g1, g2, count(*) AS nMasks, CAST(sum(len) AS BIGINT) AS sumPrefix, round(avg(len), 6) AS avgPrefix FROM j GROUP BY ALL HAVING count(*) >= 3")
def pair_screen(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 64).alias("mask"), F.col("c_custkey").alias("kmer"))
    return seeds.pairs(s, "g", "mask", 12, 6, 64, 3 / 64).select("g1", "g2", "nMasks", "sumPrefix", F.round("avgPrefix", 6).alias("avgPrefix"))


@query("SELECT a.n_nationkey AS g1, b.n_nationkey AS g2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def combinations2(spark, sf):
    return intervals.combinations(table(spark, sf, "nation"), "n_nationkey", "g1", "g2")


@query(f"WITH {_SPANS}, u AS (SELECT grp, b, e FROM s) SELECT p.grp, p.b AS pos, u.b, u.e FROM s p JOIN u ON p.grp = u.grp AND p.b BETWEEN u.b AND u.e")
def as_of_contig(spark, sf):
    s = spans(spark, sf)
    return intervals.as_of(s.select("grp", F.col("b").alias("pos")), s.select("grp", "b", "e"), "grp", "pos", "b", "e", 50)


@query(f"WITH {_GENOMES}, r AS (SELECT doc_id, l_linenumber AS start, l_linenumber + CAST(l_quantity AS BIGINT) AS stop, l_returnflag = 'R' AS rev, seq FROM lineitem JOIN g ON l_orderkey = doc_id), c AS (SELECT doc_id, start, rev, substr(seq, start, stop - start + 1) AS x FROM r WHERE length(seq) >= stop) SELECT doc_id, start, CASE WHEN rev THEN translate(reverse(x), 'ACGT', 'TGCA') ELSE x END AS subseq FROM c")
def subseq(spark, sf):
    options = Options(k=21, min_length=1, masks=4)
    contigs = genomes(spark, sf).select(F.col("doc_id").alias("genome_id"), F.lit("c").alias("seq_id"), "seq", F.length("seq").alias("seq_len"))
    regions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("genome_id"), F.lit("c").alias("seq_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))
    inside = regions.join(contigs.select("genome_id", "seq_len"), "genome_id").where("seq_len >= end").drop("seq_len").select("genome_id", "seq_id", "start", "end", "strand")
    return Index(options, contigs, None, None).subseq(inside).select(F.col("genome_id").alias("doc_id"), "start", "subseq")


@query("SELECT doc_id, d.source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def annotate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


def _index(spark, sf, k=21, masks=256):
    g = genomes(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("genome_id"), F.lit(0).alias("seq_idx"), F.lit("c0").alias("seq_id"), "seq")
    return Index.build(g, Options(k=k, masks=masks, min_length=k))


def _queries(spark, sf):
    return items(spark, sf).select(F.concat(F.lit("item"), "item_id").alias("query"), "seq")


@query()
def search_hsps(spark, sf):
    """Benchmark items against all documents: a row for each alignment."""
    found = plan.search(_index(spark, sf), _queries(spark, sf), plan.SearchOptions(min_prefix=15))
    return found.drop("cigar", "qseq", "sseq", "align")


@query()
def chain(spark, sf):
    options = plan.SearchOptions(min_prefix=15)
    return plan.chains(plan.anchors(_index(spark, sf), _queries(spark, sf), options), 21, options)


@query()
def to_sam(spark, sf):
    return writers.sam_records(plan.search(_index(spark, sf), _queries(spark, sf)))


@query()
def to_blast(spark, sf):
    return writers.pairwise_text(plan.search(_index(spark, sf), _queries(spark, sf)))
