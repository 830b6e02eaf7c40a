"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a fixed pseudo-random order. A copy of a document finishes at the virtual time
``words of its source so far / target of its source``; all copies are range-sorted by that time over all sources and taken
until the total budget is reached. No source is ever in one task: a source is cut into bins of its order, running sums are
taken inside the bins, and only one row per bin goes through the sums over bins.

Defined results: null or empty text has size 0 and is taken 0 times; the null source is a source, last in order; repeated
rows are separate documents; of copies that finish at one time the order of their keys decides; a text of any length is one
document; an empty table gives an empty result; columns beyond those read never matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, drop, own_name, partitions, text_key, written
from quillon.session import table

#: Weights by the order of the sources, repeating; the times a document may be used; least bins of a source.
WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 256
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight of the sum of all sizes.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.
    With sources in the order of cap / weight, those before the first that fits are at their cap, so one running sum
    does it. There is one row a source, not one a document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    by_fill = Window.orderBy("fill", F.col("source").isNull(), "source")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    x = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") <= F.col("fill"))
        .withColumn("final", F.min_by("level", F.when(F.col("fits"), F.col("fill"))).over(Window.partitionBy()))
    )
    first = F.min(F.when(F.col("fits"), F.col("fill"))).over(Window.partitionBy())
    target = F.when(F.col("fill") >= first, F.col("final") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return x.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _bins(spark: SparkSession) -> int:
    """Bins of a source: four for each partition that the session deals to, so a bin's rows follow its size, not the input's."""
    return max(BINS, 4 * partitions(spark))


def _queue(docs: DataFrame, weights: tuple[int, ...], most: int, bins: int) -> DataFrame:
    """Each document (rid, doc_id, more columns, source, size, key, source_size, target) with ``cum``, the words of its source up to it."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.monotonically_increasing_id().alias("rid"), *[c for c in docs.columns if c != "text"], size.alias("size"), key.alias("key")), "sized")
    binned = sized.withColumn("bin", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * bins / (1 << 24)).cast("int"))
    per_bin = binned.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    goal = targets(per_bin.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, most)
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bin_starts = per_bin.withColumn("before", before).select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    goal = goal.withColumnRenamed("source", "goal_source")
    offsets = bin_starts.join(goal, F.col("s").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    inside = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0))
    queued = binned.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    out = written(queued.withColumn("cum", F.col("before") + F.col("inside")).drop("bin", "inside", "before", "s", "b"), "queued")
    drop(sized)
    return out


#: The global order: virtual finish time first; what follows only settles ties.
ORDER = ("finish", "key", "doc_id", "no_source", "source", "size", "copy", "rid")


def _taken_copies(queued: DataFrame, most: int) -> DataFrame:
    """The copies that the mix takes (rid, copy, size, finish, words_upto, part), range-sorted by virtual finish time.

    All copies of all sources are dealt by ranges of their order, which is what a global sort is; a range's words are added
    up, the sums of the ranges before it (one row a range) give its start, and its own rows are summed in order.
    """
    copies = (
        queued.where("size > 0 and target > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("finish", (F.col("cum") + F.col("copy") * F.col("source_size")).cast("double") / F.col("target"))
        .withColumn("no_source", F.col("source").isNull())
    )
    ranged = written(copies.select(*ORDER).repartitionByRange(partitions(queued.sparkSession), *ORDER).withColumn("part", F.spark_partition_id()), "ranged")
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("in_part"))  # one row a range
    starts = sums.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    open_parts = starts.crossJoin(F.broadcast(budget)).where("start < budget")  # one row
    run = F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(open_parts), "part").withColumn("words_upto", F.col("start") + run)  # one row a range
    out = written(placed.where("words_upto <= budget").select("rid", "copy", "size", "finish", "words_upto", "part"), "taken")
    drop(ranged)
    return out


def _read(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return doc_columns(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The copies that the mix takes: doc_id, source, copy (0 up), size, finish, and words_upto, their place in the mix."""
    queued = _queue(_read(docs, id_col, text_col, source_col), weights, most, bins or _bins(docs.sparkSession))
    return _taken_copies(queued, most).join(queued.select("rid", "doc_id", "source"), "rid").select("doc_id", "source", "copy", "size", "finish", "words_upto")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    queued = _queue(_read(docs, id_col, text_col, source_col), weights, most, bins or _bins(docs.sparkSession))
    times = _taken_copies(queued, most).groupBy("rid").agg(F.count("*").alias("copies"))
    copies = F.coalesce("copies", F.lit(0)).cast("long")
    return queued.join(times, "rid", "left").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, in the order of the mix, all columns unchanged.

    Rows alike in doc_id, text and source are taken equally often, the mix's number of them rounded down, and stand where
    the first of them does.
    """
    spark = docs.sparkSession
    keyed = _read(docs, id_col, text_col, source_col).withColumn("text_key", text_key("text"))
    queued = _queue(keyed, weights, most, bins or _bins(spark))
    alike = ("doc_id", "text_key", "source")
    got = _taken_copies(queued, most).join(queued.select("rid", *alike), "rid").groupBy(*alike).agg(F.sort_array(F.collect_list("words_upto")).alias("upto"))
    rows = queued.groupBy(*alike).agg(F.count("*").alias("rows"))  # without a text a row has no words and is never taken
    pair = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("text_key") == F.col("t"))
    both = got.join(rows.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_key").alias("t"), "rows"), pair)
    # of rows alike only the first has ``most`` places at a time, so a list is as long as they are many, times ``most``
    places = written(both.select("doc_id", "text_key", "source", F.slice("upto", F.lit(1), F.floor(F.size("upto") / F.col("rows")).cast("int")).alias("upto")).where(F.size("upto") > 0), "places")
    drop(queued)
    names = [own_name(docs, f"mix_{n}") for n in ("id", "key", "source", "upto")]
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (text_key(text_col) == F.col(names[1])) & F.col(f"`{source_col}`").eqNullSafe(F.col(names[2]))
    out = docs.join(places.toDF(*names), same).withColumn(names[3], F.explode(names[3]))
    return out.repartitionByRange(partitions(spark), names[3]).sortWithinPartitions(names[3]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS fill, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
l AS (SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
m AS (SELECT arg_min(level, fill) FILTER (level <= fill) AS final, min(fill) FILTER (level <= fill) AS first FROM l),
t AS (SELECT source, source_size, total, coalesce(CASE WHEN fill >= first THEN final * weight ELSE CAST(cap AS DOUBLE) END, 0.0) AS target FROM l, m),
q AS (SELECT d.*, t.source_size, t.target, t.total,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(cum + copy * source_size AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
r AS (SELECT doc_id, source, size, key, total, sum(size) OVER (ORDER BY finish, key, doc_id, source IS NULL, source, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT doc_id, count(*) AS copies FROM r WHERE upto <= total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""
