"""BM25 over DataFrames: postings, document frequencies with a ceiling, ranked search, the postings budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T
from quillon.session import stored


def tokenised(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toks, len): content tokens, and their number before any ceiling."""
    toks = passages.select(F.col(id_col).alias("id"), T.content_tokens(text_col).alias("toks"))
    return toks.select("id", "toks", F.size("toks").cast("long").alias("len"))


def postings(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): tf stops at 255. Explodes straight into a map-side combined count."""
    terms = passages.select(F.col(id_col).alias("id"), F.explode(T.content_tokens(text_col)).alias("term"))
    return terms.groupBy("id", "term").agg(F.least(F.count("*"), F.lit(K.TF_MOST)).alias("tf"))


def counted(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n): how often each row's text has each of its terms, counted inside the row as runs of its sorted tokens."""
    toks = passages.select(F.col(id_col).alias("id"), F.sort_array(T.content_tokens(text_col)).alias("toks")).where(F.size("toks") > 0)
    new = F.filter(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: (i == 0) | (F.get("toks", i) != F.get("toks", i - 1)))
    runs = F.transform("new", lambda i, k: F.struct(F.get("toks", i).alias("term"), (F.coalesce(F.get("new", k + 1), F.size("toks")) - i).alias("n")))
    return toks.withColumn("new", new).select("id", F.explode(runs).alias("x")).select("id", "x.term", "x.n")


def dealt_postings(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``postings``, shuffled once: dealt by term and sorted by term and id, so that what groups or sorts terms shuffles no more.

    A row's terms are distinct already, so nothing is combined before the shuffle; rows of one id, which lie together by then, are
    one passage. The sort is all that a task holds, no table of its postings.
    """
    by = Window.partitionBy("term").orderBy("id")
    tf = F.least(F.sum("n").over(by.rangeBetween(Window.currentRow, Window.currentRow)), F.lit(K.TF_MOST))
    terms = counted(passages, id_col, text_col).repartition("term")
    return terms.select("id", "term", tf.alias("tf"), (F.row_number().over(by) - F.rank().over(by)).alias("again")).where("again = 0").select("id", "term", "tf")


def lengths(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len): content tokens before any ceiling."""
    return tokenised(passages, id_col, text_col).select("id", "len")


def stats(lens: DataFrame) -> DataFrame:
    """One row: passages, mean length."""
    return lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def _most(n: Column) -> Column:
    """Passages that a term under the ceiling may have."""
    return F.greatest(F.lit(2), F.floor(n * K.DF_CEILING))


def frequencies(posts: DataFrame, n: DataFrame, ceiling: bool = True) -> DataFrame:
    """(term, df) of the terms that at most max(2, 15 % of all) passages have, or of all terms."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    if not ceiling:
        return df
    return df.crossJoin(F.broadcast(n.select("n"))).where(F.col("df") <= _most(F.col("n"))).select("term", "df")  # one row


def scored(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, most_postings: int | None = None, ceiling: bool = True) -> DataFrame:
    """(query_id, id, score) of every passage that shares a term with the query.

    The passages are read once. Only postings of query terms are counted, and they carry their passage's length, so no other
    table of the corpus is joined. With ``most_postings`` a query reads its terms rarest first and starts no term once that many postings are read.
    Without ``ceiling`` (a user's own sources) no term is too frequent and no count is cut at 255.
    """
    return scored_postings(*met_postings(passages, queries, id_col, text_col, query_id, query_text), most_postings, ceiling)


def met_postings(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, len, term, tf, and the columns ``keep``) of the terms asked for, stored; and (query_id, term).

    One reading of the passages: each has a row of the empty term too, which no token is, so that their number and lengths are
    taken from what is stored.
    """
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(T.content_set(query_text)).alias("term"))
    toks = passages.select(F.col(id_col).alias("id"), *keep, T.content_tokens(text_col).alias("toks"))
    toks = toks.select("id", *keep, F.size("toks").cast("long").alias("len"), F.explode(F.array_append("toks", F.lit(""))).alias("term"))
    wanted = terms.select("term").union(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    return stored(toks.join(wanted, "term", "left_semi").groupBy("id", *keep, "len", "term").agg(F.count("*").alias("tf")), "postings"), terms


def scored_postings(met: DataFrame, terms: DataFrame, most_postings: int | None = None, ceiling: bool = True) -> DataFrame:
    """``scored`` of ``met_postings``."""
    one = stats(met.where("term = ''").withColumn("rows", F.explode(F.expr("sequence(1L, tf)"))))  # passages of one id and length are one row
    posts = met.where("term <> ''").select("id", "len", "term", (F.least(F.col("tf"), F.lit(K.TF_MOST)) if ceiling else F.col("tf")).alias("tf"))
    asked = terms.join(frequencies(posts, one, ceiling), "term")
    if most_postings is not None:
        before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        asked = asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_postings)
    x = asked.join(posts, "term").crossJoin(F.broadcast(one))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K.K1 * (1 - K.B + K.B * F.col("len") / F.col("avg_len"))
    part = idf * F.col("tf") * (K.K1 + 1) / (F.col("tf") + norm)
    return x.withColumn("part", part).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def top(hits: DataFrame, k: int, by: str = "query_id", score: str = "score", id_col: str = "id") -> DataFrame:
    """The best ``k`` of each query, ties by smaller id, with their rank (from 1)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rescaled(ranked: DataFrame) -> DataFrame:
    """Scores divided by the query's best, so they compare with cosines."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.round(F.when(best > 0, F.col("score") / best).otherwise(0.0), 6))


def search(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 24, most_postings: int | None = None, ceiling: bool = True) -> DataFrame:
    """BM25 top ``k``: (query_id, id, score, rank)."""
    return top(scored(passages, queries, id_col, text_col, query_id, query_text, most_postings, ceiling), k)


def sorted_postings(posts: DataFrame, n: DataFrame) -> DataFrame:
    """Postings of the terms under the ceiling, dealt by term and sorted by term and passage: the layout of a stored index.

    A term's postings are counted where they lie: ``dealt_postings`` are neither joined nor shuffled nor sorted again.
    """
    own = Window.partitionBy("term").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    posts = posts.withColumn("df", F.count("*").over(own)).where(F.col("df") <= _most(n.select("n").scalar()))
    return posts.select("term", "df", "id", "tf").sortWithinPartitions("term", "id")


def offsets(df: DataFrame, bins: int = 256) -> DataFrame:
    """(term, df, start): where each term's postings begin in the list of all, terms in order.

    Running sums inside bins of the terms' first characters' hash would break the order, so bins are ranges: the sums of the
    ranges, one row each, give their starts.
    """
    part = df.repartitionByRange(bins, "term").withColumn("part", F.spark_partition_id())
    part = stored(part, "ranges")
    sums = part.groupBy("part").agg(F.sum("df").alias("n"))
    starts = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a range
    run = F.sum("df").over(Window.partitionBy("part").orderBy("term").rowsBetween(Window.unboundedPreceding, -1))
    return part.join(F.broadcast(starts), "part").select("term", "df", (F.col("base") + F.coalesce(run, F.lit(0))).alias("start"))
