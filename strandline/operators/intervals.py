"""Interval operators: coverage, merging, numbering, as-of and bucketed range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import alignment


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Islands of overlapping or touching closed intervals of each key: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("island", F.sum(F.when(F.col(start) <= before, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def union_length(df: DataFrame, keys: list[str], start: str, end: str, name: str = "covered") -> DataFrame:
    return merged(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias(name))


def with_union_length(df: DataFrame, keys: list[str], start: Column, end: Column, name: str = "covered") -> DataFrame:
    """df with union_length() of its key in every row, without a join, for which df would be made twice: each interval adds what lies beyond those before it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("_new", F.greatest(F.lit(0), end - F.greatest(start - 1, F.coalesce(before, start - 1))))
    return own.withColumn(name, F.sum("_new").over(Window.partitionBy(*keys))).drop("_new")


def roll_up(df: DataFrame, keys: list[str], start: str, end: str, matched: str, length: str) -> DataFrame:
    """Of the alignments of each cluster: their number, bounds, aligned (bases in any of them), matched, and coverage of length and identity in per cent."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias(start), F.max(end).alias(end), F.sum(matched).alias("matched"), F.max(length).alias(length))
    both = sums.join(union_length(df.select(*keys, F.col(start).alias("_b"), F.col(end).alias("_e")), keys, "_b", "_e", "aligned"), keys)
    return both.withColumn("coverage", alignment.share(F.col("aligned"), F.col(length))).withColumn("identity", alignment.share(F.col("matched"), F.col("aligned")))


def spread(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, least, most, mean, population standard deviation and exact quantiles (q25, ...) of value."""
    cuts = [F.percentile(value, q).alias(f"q{round(q * 100)}") for q in quantiles]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), *cuts)


def histogram(df: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """(keys, bin, n): values in [bin, bin + width)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gaps_to_previous(df: DataFrame, keys: list[str], pos: str, name: str = "distance") -> DataFrame:
    return df.withColumn(name, F.col(pos) - F.lag(pos).over(Window.partitionBy(*keys).orderBy(pos)))


def deserts(df: DataFrame, keys: list[str], pos: str, least: int) -> DataFrame:
    """(keys, after, before) of neighbouring places at least so far apart."""
    w = Window.partitionBy(*keys).orderBy(pos)
    d = df.select(*keys, F.lag(pos).over(w).alias("after"), F.col(pos).alias("before"))
    return d.where(F.col("before") - F.col("after") >= least)


def sliding_counts(df: DataFrame, keys: list[str], pos: str, size: int, step: int, gap: str | None = None, end: str | None = None, parts: int = 0) -> DataFrame:
    """Places in each window [b, b + size), b a multiple of step; windows without any are left out. gap: a boolean column; windows with such a place are left
    out as well. end: a column, the same in all rows of a key; windows that reach beyond it are left out. parts: tasks that count, by key and window;
    else Spark settles them."""
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - size) / step) + 1) * step
    extra = [c for c in (gap, end) if c]
    at = df.select(*keys, *extra, F.explode(F.sequence(first.cast("long"), (F.floor(F.col(pos) / step) * step).cast("long"), F.lit(step).cast("long"))).alias("window_start"))
    if end:
        at = at.where(F.col("window_start") + size <= F.col(end))
    at = at.repartition(parts, *keys, "window_start") if parts else at
    out = at.groupBy(*keys, "window_start").agg(F.count(F.lit(1)).alias("n"), *([F.max(gap).alias("_gap")] if gap else []))
    return out.where(~F.coalesce("_gap", F.lit(False))).drop("_gap") if gap else out


def report_headers(df: DataFrame, query: str, genome: str, sequence: str, order: list[Column]) -> DataFrame:
    """Where a report of a query's rows, in order, needs a new heading: new_query, new_genome, new_sequence, and the genome's number genome_no."""
    w = Window.partitionBy(query).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    new_genome = first | ~F.col(genome).eqNullSafe(before(genome))
    d = df.withColumns({"new_query": first, "new_genome": new_genome, "new_sequence": new_genome | ~F.col(sequence).eqNullSafe(before(sequence))})
    return d.withColumn("genome_no", F.sum(F.col("new_genome").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def matched_share(queries: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """One row: total queries, those matched by any hit, and their share in per cent."""
    found = queries.select(key).join(hits.select(key, F.lit(1).alias("_hit")).distinct(), key, "left")
    sums = found.agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("matched"))
    return sums.withColumn("share", F.when(F.col("total") > 0, alignment.share(F.col("matched"), F.col("total"))))


def screening_windows(df: DataFrame, length: str, windows: int) -> DataFrame:
    """(window, start, end) of each row, 0-based and half open: windows of two steps, each one step behind the last; the last reaches the end, a single one is all."""
    step = F.floor(F.col(length) / (windows + 1))
    d = df.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    end = F.when(F.col("window") == windows - 1, F.col(length)).otherwise((F.col("window") + 2) * step)
    return d.withColumns({"start": (F.col("window") * step).cast("long"), "end": end.cast("long")})


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key. Spark cuts each map task's groups to n rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def as_of(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, end: str, bucket: int) -> DataFrame:
    """points with the interval of the same key that contains them: an equi-join on key and bucket, then the exact test."""
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    joined = points.withColumn("bucket", F.floor(F.col(pos) / bucket)).join(spread, [key, "bucket"])
    return joined.where((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("bucket")


def combinations(df: DataFrame, column: str, left: str, right: str) -> DataFrame:
    """All pairs of distinct values with left < right. Ranks are counted off and joined by equality, so every pair is made once and none is dropped."""
    values = df.select(column).distinct()
    ranked = values.select(column, F.row_number().over(Window.orderBy(column)).alias("_rank"))
    top = ranked.agg(F.max("_rank").alias("_top"))
    first = ranked.select(F.col(column).alias(left), "_rank", F.lit(1).alias("_one")).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    first = first.where("_rank < _top").select(left, F.explode(F.sequence(F.col("_rank") + 1, F.col("_top"))).alias("_rank"))
    return first.join(ranked.withColumnRenamed(column, right), "_rank").select(left, right)


def near(a: DataFrame, b: DataFrame, key: str, pos: str, other: str, distance: int) -> DataFrame:
    """Pairs of the same key with |pos - other| <= distance, by two buckets of width 2 * distance."""
    width = 2 * distance
    spread = b.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col(other) - distance) / width), F.floor((F.col(other) + distance) / width)))))
    return a.withColumn("bucket", F.floor(F.col(pos) / width)).join(spread, [key, "bucket"]).where(F.abs(F.col(pos) - F.col(other)) <= distance).drop("bucket")


def not_nested(df: DataFrame, keys: list[str], qb: str, qe: str, tb: str, te: str) -> DataFrame:
    """Anchors that no other anchor of the group contains on query and target; of equal ones, one stays."""
    d = df.dropDuplicates([*keys, qb, qe, tb, te])
    o = d.select(*keys, *(F.col(c).alias(f"o_{c}") for c in (qb, qe, tb, te)))
    within = (d[qb] >= o[f"o_{qb}"]) & (d[qe] <= o[f"o_{qe}"]) & (d[tb] >= o[f"o_{tb}"]) & (d[te] <= o[f"o_{te}"])
    other = (d[qb] != o[f"o_{qb}"]) | (d[qe] != o[f"o_{qe}"]) | (d[tb] != o[f"o_{tb}"]) | (d[te] != o[f"o_{te}"])
    same = reduce(Column.__and__, [d[k] == o[k] for k in keys])
    return d.join(o, same & within & other, "left_anti")


def number_hits(df: DataFrame, query: str, genome: str, cluster: str, score: str, ties: list[str]) -> DataFrame:
    """genome_rank (by its best cluster), cls and hsp within the genome, and hits, the genomes of the query."""
    g = df.withColumn("best_of_cluster", F.max(score).over(Window.partitionBy(query, genome, cluster)))
    g = g.withColumn("best_of_genome", F.max(score).over(Window.partitionBy(query, genome)))
    by = Window.partitionBy(query, genome).orderBy(F.desc("best_of_cluster"), cluster)
    g = g.withColumn("cls", F.dense_rank().over(by)).withColumn("hsp", F.row_number().over(Window.partitionBy(query, genome).orderBy(F.desc("best_of_cluster"), cluster, F.desc(score), *ties)))
    g = g.withColumn("genome_rank", F.dense_rank().over(Window.partitionBy(query).orderBy(F.desc("best_of_genome"), genome)))
    return g.withColumn("hits", F.max("genome_rank").over(Window.partitionBy(query))).drop("best_of_cluster", "best_of_genome")
