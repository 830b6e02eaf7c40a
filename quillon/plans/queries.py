"""The engine's own queries over the tables, each beside the DuckDB SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T
from quillon.operators import evaluation, fusion, gates, lexical, vectors
from quillon.plans import corpus, index, search, sources, texts
from quillon.session import table


_raw_sql, _content_sql = texts.raw_sql, texts.content_sql
_DOCS = "coalesce(text, '')"
_PARTS = """with docs as (select doc_id, {content} as toks from documents), lens as (select doc_id, len(toks) as len from docs),
one as (select count(*) as n, avg(len) as avg_len from lens),
posts as (select doc_id, term, least(count(*), 255) as tf from (select doc_id, unnest(toks) as term from docs) group by all),
freq as (select term, count(*) as df from posts, one group by term, n having count(*) <= greatest(2, floor(n * 0.15)))""".replace("{content}", _content_sql(_DOCS))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def tok_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.raw_tokens("text"), " ").alias("tokens"))


def tok_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.content_tokens("text"), " ").alias("tokens"))


def txt_numeric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.numeric_spans("text"), "|").alias("numbers"))


def txt_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens("text").alias("tokens"))


def chunk_sliding(spark: SparkSession, sf_dir: str, width: int = 200, stride: int = 120, tail: int = 60) -> DataFrame:
    """Windows of ``width`` characters; a text that fits one is one, and a later tail under ``tail`` is none."""
    at = F.when(F.length("text") <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("text") - 1, F.lit(stride)))
    d = _docs(spark, sf_dir).where("text <> ''").withColumn("at", F.explode(at)).where((F.col("at") == 0) | (F.length("text") - F.col("at") >= tail))
    return d.select("doc_id", F.col("at").cast("long").alias("start"), F.md5(F.substring("text", F.col("at") + 1, F.lit(width))).alias("chunk_md5"))


def lex_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_docs(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf")


def lex_doclen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(_docs(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), "len")


def lex_df_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return lexical.frequencies(lexical.dealt_postings(d, "doc_id", "text"), lexical.stats(lexical.lengths(d, "doc_id", "text")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text asked of all documents."""
    hits = lexical.search(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 10)
    return hits.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _nearest(spark: SparkSession, sf_dir: str, *strategies: str) -> DataFrame:
    """Every twentieth vector asked of all vectors but itself: the best 24 by each strategy's measure."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.sign_code(F.col("embedding")).alias("code"))
    return vectors.nearest(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), strategies, 24)


def vec_binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.sign_code(F.col("embedding")).alias("code"))


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "whole").withColumn("score", F.col("key") / 1e6)


def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


def vec_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "sentence").select("query_id", "vec_id", (-F.col("key")).alias("dist"), "rank")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("strategy") == "whole", F.col("key") / 1e6).otherwise(1 + F.col("key") / 64.0)
    return fusion.fuse(_nearest(spark, sf_dir, "whole", "sentence").select("query_id", "strategy", F.col("vec_id").alias("id"), score.alias("score"), "rank"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", F.col("id").alias("vec_id"), "fused", "agreement", "place")


def fusion_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.margin(_fused(spark, sf_dir))


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries with a hit of their own label among the first 1, 3, 5, 10, and the mean reciprocal rank to 10."""
    first = F.min(F.when((F.col("label") == F.col("q_label")) & (F.col("rank") <= 10), F.col("rank")))
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _cosine(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    q = hits.groupBy("query_id").agg(first.alias("first"))
    hits = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return q.agg(F.count("*").alias("n"), *hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def auc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of text length for quality. Ties share their mean rank; ranks come from one sum over distinct values, not rows."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("quality is not null and n_chars is not null")
    by = x.groupBy("n_chars").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    below = F.sum("neg").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1))
    won = F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2)
    return by.withColumn("won", won).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.coalesce(F.round(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6), F.lit(0.5)).alias("auc"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and nearest-rank percentiles of value by event type."""
    return evaluation.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value")


def dedupe_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise_space(T.nfc("text"))).alias("text_md5"))
    return d.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a turn's content words that the turn before it has."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("before", before).where("before is not null and text is not null")
    return c.select("conv_id", "turn", F.round(T.overlap(T.content_set("text"), T.content_set("before")), 6).alias("overlap"))


def gate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.input_gate("text").alias("reason"), gates.needs_support("text").alias("support"))


def gate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _fused(spark, sf_dir).where("place = 1")
    overlap = F.col("query_id") % 100 / 100  # the vectors have no words
    return top.select("query_id", gates.retrieval_gate(F.col("best_score") * 1.5, F.col("agreement"), overlap).alias("reason"))


def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best sentences of the best document for each benchmark text."""
    best = lexical.search(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 1)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    x = best.join(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id").join(asked, "query_id")
    return x.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), gates.extract_answer(F.col("query"), F.col("text")).alias("answer"))


_PAIRS = """with v as (select vec_id, label, embedding as e, list_transform(embedding, lambda x: x > 0) as s from embeddings),
p as (select q.vec_id as query_id, q.label as q_label, v.vec_id, v.label,
  round(list_sum(list_transform(list_zip(v.e, q.e), lambda z: z[1]::double * z[2]::double)), 6) as score,
  len(list_filter(list_zip(v.s, q.s), lambda z: z[1] <> z[2])) as dist from v, v q where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
cosine as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p qualify rank <= 24),
ham as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from p qualify rank <= 24),
hits as (select query_id, vec_id, 1.0 / (60 + rank) as part, score from cosine union all select query_id, vec_id, 0.9 / (60 + rank), 1 - dist / 64.0 from ham),
fused as (select query_id, vec_id, round(sum(part::double), 6) as fused, count(*) as agreement, max(score) as best from hits group by all),
placed as (select *, row_number() over (partition by query_id order by fused desc, vec_id) as place from fused qualify place <= 24)"""

QUERIES = {f.__name__: f for f in (tok_raw, tok_content, txt_numeric_spans, txt_estimate_tokens, chunk_sliding, lex_tf, lex_doclen, lex_df_ceiling, bm25_topk, vec_binarise, vec_cosine_topk, vec_hamming_topk, rrf_fuse, fusion_margin, hit_at_k, auc_ranksum, latency_percentiles, dedupe_corpus, lexical_overlap, gate_input, gate_retrieval, extract_answer)}
ORACLE_SQL = {
    "tok_raw": f"select doc_id, array_to_string({_raw_sql(_DOCS)}, ' ') as tokens from documents",
    "tok_content": f"select doc_id, array_to_string({_content_sql(_DOCS)}, ' ') as tokens from documents",
    "txt_numeric_spans": f"select doc_id, array_to_string(regexp_extract_all({_DOCS}, '{K.NUMERIC}')[1:8], '|') as numbers from documents",
    "txt_estimate_tokens": f"select doc_id, ceil((length({_DOCS}) - o) / 4.0 + o / 2.0)::bigint as tokens from (select *, length(regexp_replace({_DOCS}, '[\\x00-\\x7F]', '', 'g')) as o from documents)",
    "chunk_sliding": "with d as (select doc_id, text, unnest(case when length(text) <= 200 then [0] else range(0, length(text), 120) end) as pos from documents where text <> '') select doc_id, pos as start, md5(substring(text, pos + 1, 200)) as chunk_md5 from d where pos = 0 or length(text) - pos >= 60",
    "lex_tf": f"{_PARTS} select doc_id, term, tf from posts",
    "lex_doclen": f"{_PARTS} select doc_id, len from lens",
    "lex_df_ceiling": f"{_PARTS} select term, df from freq",
    "bm25_topk": f"""{_PARTS}, asked as (select distinct item_id, unnest({_content_sql('text')}) as term from benchmark),
        s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score
          from asked join freq using (term) join posts using (term) join lens using (doc_id), one group by all)
        select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s qualify rank <= 10""",
    "vec_binarise": "select vec_id, list_aggregate(list_transform(embedding, lambda x, i: case when x <= 0 then 0 when i = 64 then -9223372036854775808 else 2::hugeint ** (i - 1) end::hugeint), 'sum')::bigint as code from embeddings",
    "vec_cosine_topk": f"{_PAIRS} select query_id, vec_id, score, rank from cosine",
    "vec_hamming_topk": f"{_PAIRS} select query_id, vec_id, dist, rank from ham",
    "rrf_fuse": f"{_PAIRS} select query_id, vec_id, fused, agreement, place from placed",
    "fusion_margin": f"{_PAIRS}, o as (select query_id, count(*) as hits, max(fused) filter (place = 1) as top, max(fused) filter (place = 2) as second from placed group by all) select query_id, hits, top, round(case when hits < 2 then 1.0 when top <= 0 then 0.0 else (top - second) / top end, 6) as margin from o",
    "hit_at_k": f"{_PAIRS}, q as (select query_id, min(rank) filter (label = q_label and rank <= 10) as first from cosine group by all) select count(*) as n, "
    + ", ".join(f"round(avg(case when first <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in (1, 3, 5, 10))
    + ", round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr from q",
    "auc_ranksum": """with x as (select n_chars, quality from labels join documents using (doc_id)), r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from x),
        s as (select count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as n, sum(r) filter (quality = 1) as w from r) select p as positives, n as negatives, coalesce(round((w - p * (p + 1) / 2.0) / nullif(p * n, 0), 6), 0.5) as auc from s""",
    "latency_percentiles": "select event_type, count(*) as n, round(avg(value), 9) as mean, " + ", ".join(f"quantile_disc(value, {p / 100}) as p{p}" for p in (50, 70, 90, 95, 99, 100)) + " from events where value is not null group by all",
    "dedupe_corpus": f"select text_md5, min(doc_id) as doc_id, count(*) as copies from (select doc_id, md5(trim(regexp_replace(nfc_normalize({_DOCS}), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+', ' ', 'g'))) as text_md5 from documents) group by all",
    "lexical_overlap": f"""with c as (select *, lag(text) over (partition by conv_id order by turn) as before from conversations),
        t as (select conv_id, turn, list_distinct({_content_sql('text')}) as a, list_distinct({_content_sql('before')}) as b from c where before is not null and text is not null)
        select conv_id, turn, round(case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0.0 end, 6) as overlap from t""",
    "gate_retrieval": f"{_PAIRS} select query_id, case when best * 1.5 < 0.8 and not (best * 1.5 >= 0.2 and query_id % 100 / 100 >= 0.5) then 'LOW_CONFIDENCE' when agreement < 2 and query_id % 100 / 100 < 0.15 then 'NO_AGREEMENT' end as reason from placed where place = 1",
}

for module in (corpus, texts, sources, search, index):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
