"""Measures: ranks of relevant hits, refusals, thresholds, percentiles, samples by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import stored


def share(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def hit_rates(ranked: DataFrame, graded: DataFrame, most: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """n, hit_1, hit_3, hit_5, hit_10, mrr of ``ranked`` (query_id, rank, relevant) over the queries of ``graded``."""
    keys = [*by, "query_id"]
    first = ranked.where((F.col("rank") <= most) & F.col("relevant")).groupBy(*keys).agg(F.min("rank").alias("first"))
    x = graded.join(first, keys, "left")
    rates = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return x.groupBy(*by).agg(F.count("*").alias("n"), *rates, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def confusion(refused: Column, answerable: Column) -> list[Column]:
    """Aggregates of refusing: what is rightly and wrongly refused and answered."""
    return [
        F.count_if(refused & ~answerable).alias("rightly_refused"),
        F.count_if(refused & answerable).alias("wrongly_refused"),
        F.count_if(~refused & ~answerable).alias("wrongly_answered"),
        F.count_if(~refused & answerable).alias("rightly_answered"),
    ]


def rates(x: DataFrame) -> DataFrame:
    """``confusion`` counts with precision, recall, f1, coverage, accuracy; 0 on an empty denominator."""
    rr, wr, wa, ra = (F.col(c) for c in ("rightly_refused", "wrongly_refused", "wrongly_answered", "rightly_answered"))
    x = x.withColumn("precision", share(rr, rr + wr)).withColumn("recall", share(rr, rr + wa)).withColumn("coverage", share(ra, ra + wr)).withColumn("accuracy", share(rr + ra, rr + wr + wa + ra))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    x = x.withColumn("f1", f1)
    return x.select(*[c for c in x.columns if c not in ("precision", "recall", "coverage", "accuracy", "f1")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "coverage", "accuracy")])


def sweep(rows: DataFrame, steps: int, agreements: tuple[int, ...]) -> DataFrame:
    """(step, threshold, agreement, counts and rates) of ``rows`` (score, agreement, answerable) at thresholds from the least
    score to the largest; a row meets ``steps`` times the agreements' thresholds, a stated grid."""
    ends = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row
    grid = rows.sparkSession.range(steps).select(F.col("id").alias("step")).crossJoin(F.broadcast(ends))
    grid = grid.select("step", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / steps, 6).alias("threshold"), F.explode(F.array(*[F.lit(a).cast("long") for a in agreements])).alias("least_agreement"))
    refused = (F.col("score") < F.col("threshold")) | (F.col("agreement") < F.col("least_agreement"))
    x = rows.crossJoin(F.broadcast(grid)).groupBy("step", "threshold", "least_agreement").agg(*confusion(refused, F.col("answerable")))
    return rates(x)


def best_policy(swept: DataFrame, least_coverage: float) -> DataFrame:
    """The row with the largest recall of those that cover enough; of equals the least threshold, then agreement."""
    return swept.where(F.col("coverage") >= least_coverage).orderBy(F.desc("recall"), "step", "least_agreement").limit(1)


def nearest_ranks(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 70, 90, 95, 99, 100), parts: int | None = None, floor_index: bool = False) -> DataFrame:
    """(by, n, mean, p50, ...): the value at rank ceil(p / 100 * n) of each group, or at index floor(p / 100 * (n - 1)).

    Rows are dealt by ranges of (by, value), so a large group is many ranges; only the ranges that hold a wanted rank are
    numbered. Counts per range are one row a range and group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).alias("value"))
    ranged = stored(x.repartitionByRange(parts, "by", "value").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("by", "part").agg(F.count("*").alias("m"), F.sum("value").alias("total"))
    whole = Window.partitionBy("by")
    before = F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("by", "part", "m", before.alias("before"), F.sum("m").over(whole).alias("n"), (F.sum("total").over(whole) / F.sum("m").over(whole)).alias("mean"))
    ranks = counts.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("r", F.floor((F.col("n") - 1) * F.col("p") / 100) + 1 if floor_index else F.greatest(F.ceil(F.col("n") * F.col("p") / 100), F.lit(1)))
    ranks = ranks.where((F.col("r") > F.col("before")) & (F.col("r") <= F.col("before") + F.col("m")))
    wanted = ranks.groupBy("by", "part", "before", "n", "mean").agg(F.collect_list(F.struct("p", "r")).alias("wanted"))
    here = ranged.join(F.broadcast(wanted), ["by", "part"])  # as many rows as percentiles and groups
    at = F.row_number().over(Window.partitionBy("by", "part").orderBy("value")) + F.col("before")
    found = here.withColumn("at", at).withColumn("w", F.explode("wanted")).where(F.col("w.r") == F.col("at"))
    pick = [F.max(F.when(F.col("w.p") == p, F.col("value"))).alias(f"p{p}") for p in percents]
    return found.groupBy("by").agg(F.max("n").alias("n"), F.round(F.max("mean"), 9).alias("mean"), *pick).withColumnRenamed("by", by)


def stratified(rows: DataFrame, by: str, id_col: str, target: int) -> DataFrame:
    """(by, n, take): each stratum's proportional share of ``target``, half to even, never more than it has."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.select(by, "n", F.least(F.col("n"), F.bround(F.lit(target) * F.col("n") / F.sum("n").over(Window.partitionBy()))).cast("long").alias("take"))  # one row a stratum


def stratified_rows(rows: DataFrame, by: str, id_col: str, target: int) -> DataFrame:
    """The rows of a proportional sample: in each stratum those with the least md5 of their ids."""
    take = stratified(rows, by, id_col, target).select(F.col(by).alias("of"), "n", "take")
    x = rows.join(F.broadcast(take), F.col(by).eqNullSafe(F.col("of")))  # one row a stratum
    key = F.md5(F.col(id_col).cast("string"))
    # hashes are even: what lies above three times a stratum's share can't be among the least unless it takes nearly all
    near = x.withColumn("key", key).where((F.conv(F.substring("key", 1, 8), 16, 10).cast("long") <= 3.0 * (F.col("take") + 20) / F.col("n") * (1 << 32)) | (F.col("take") * 3 > F.col("n")))
    r = F.row_number().over(Window.partitionBy("of").orderBy("key", id_col))
    return near.withColumn("r", r).where(F.col("r") <= F.col("take")).drop("of", "n", "take", "key", "r")
