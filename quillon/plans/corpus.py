"""Queries over chunks, pages, plans and measures, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T
from quillon.operators import chunking, gates, planner
from quillon.session import table

#: The full plan's lists, hits a strategy, rescored hits and candidates.
FULL = (24, 24, 16, 6144)


def _hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("doc_id"), F.col("k").cast("long").alias("k"), F.md5("chunk").alias("chunk_md5"))


def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.sentences(F.coalesce("text", F.lit(""))), "|").alias("sentences"))


def chunk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(chunking.whole(table(spark, sf_dir, "documents"), "doc_id", "text"))


def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(chunking.by_sentence(table(spark, sf_dir, "documents"), "doc_id", "text"))


def chunk_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's language and source stand for its types."""
    types = F.array_compact(F.array("lang", "source"))
    return _hashed(chunking.contextual(table(spark, sf_dir, "documents"), "doc_id", "text", types))


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(chunking.by_topic(table(spark, sf_dir, "documents"), "doc_id", "text"))


def chunk_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tagged = [f(d, "doc_id", "text").withColumn("strategy", F.lit(n)) for n, f in (("whole", chunking.whole), ("sentence", chunking.by_sentence))]
    return chunking.measures(tagged[0].unionByName(tagged[1]))


def deadline_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's plan: its price stands for the time left, its key for the user chunks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice").cast("double")) % 1200 / 100).alias("left"), (F.col("o_orderkey") % 5000).alias("chunks"))
    return o.select("o_orderkey", planner.plan(F.col("left"), F.col("chunks"), FULL).alias("p")).select("o_orderkey", "p.*")


def gate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn cites its own number and the one after, of as many as the conversation has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    return c.select("conv_id", "turn", gates.citation_gate(F.array(F.col("turn").cast("double"), F.col("turn") + 1.0), F.col("n")).alias("reason"))


def lang_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, labels, mean quality and toxic share by language and of all together."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"))
    x = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = x.rollup("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("ALL")))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of "n_chars is at least the threshold" for quality, at eight thresholds, in one pass."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("quality is not null and n_chars is not null")
    x = x.select("quality", "n_chars", F.explode(F.array(*[F.lit(50 * 2**i).cast("long") for i in range(8)])).alias("threshold"))
    said, true = F.col("n_chars") >= F.col("threshold"), F.col("quality") == 1
    return x.groupBy("threshold").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


QUERIES = {f.__name__: f for f in (txt_sentences, chunk_whole, chunk_sentence, chunk_contextual, chunk_semantic, chunk_stats_rollup, deadline_plan, gate_citations, lang_report, threshold_sweep)}

_PARTS = r"""with d as (select *, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([।.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as ss from documents)"""
_SENT = f"{_PARTS}, s as (select doc_id, unnest(ss) as chunk, generate_subscripts(ss, 1) - 1 as k from d)"


def _plan_sql() -> str:
    out = "case"
    for rung in (FULL, *planner.RUNGS, planner.FLOOR):
        p = tuple(f if v is None else v for v, f in zip(rung, FULL, strict=True))
        test = "else" if rung is planner.FLOOR else f"when budget >= {planner.SEARCH} + {p[0]} * {planner.LIST} + {p[2]} * {planner.RESCORE} then"
        out += f" {test} {{'lists': {p[0]}::bigint, 'hits': {p[1]}::bigint, 'rescored': {p[2]}::bigint, 'candidates': {p[3]}::bigint, 'degraded': {rung is not FULL}}}"
    return out + " end"


_NUMBERS = f"regexp_extract_all(text, '{K.NUMERIC}')[1:8]"
_NAMES = f"regexp_extract_all(text, '{K.LATIN_RUN}')[1:8]"
ORACLE_SQL = {
    "txt_sentences": f"{_PARTS} select doc_id, array_to_string(ss, '|') as sentences from d",
    "chunk_whole": "select doc_id, 0::bigint as k, md5(text) as chunk_md5 from documents where text <> ''",
    "chunk_sentence": f"{_SENT} select doc_id, k::bigint as k, md5(chunk) as chunk_md5 from s where length(chunk) >= {chunking.SENTENCE}",
    "chunk_contextual": f"""with a as (select doc_id, text, list_sort(list_distinct(list_filter([lang, source], lambda x: x is not null)))[1:3] as t, {_NUMBERS} as n, {_NAMES} as l from documents where text <> ''),
        u as (select *, list_filter(l, lambda x, i: list_position(l, x) = i) as names from a),
        h as (select *, concat_ws(' | ', case when len(t) > 0 then '{chunking.TYPES}' || array_to_string(t, ' ') end, case when len(n) > 0 then '{chunking.NUMBERS}' || array_to_string(n, ' ') end,
          case when len(names) > 0 then '{chunking.NAMES}' || array_to_string(names, ' ') end) as h from u)
        select doc_id, 0::bigint as k, md5(case when h <> '' then '[' || h || '] ' || text else text end) as chunk_md5 from h""",
    "chunk_stats_rollup": f"""{_SENT}, c as (select 'whole' as strategy, doc_id, text as chunk from d where text <> '' union all select 'sentence', doc_id, chunk from s where length(chunk) >= {chunking.SENTENCE}),
        x as (select strategy, doc_id, count(*) as n, sum(length(chunk)) as chars from c group by all)
        select coalesce(strategy, 'TOTAL') as strategy, sum(n)::bigint as chunks, round(sum(n) / count(*), 6) as a_text, round(sum(chars) / sum(n), 6) as mean_chars from x group by rollup (strategy)""",
    "chunk_semantic": f"""with recursive t as (select doc_id, string_split(regexp_replace(text, '([।.!?])([\\s\\x0b])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as ps from documents where text <> ''),
        p as (select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) as i from t),
        o as (select doc_id, i, piece, case when i = 1 then piece else regexp_replace(piece, '^[\\s\\x0b]+', '') end as sent from p),
        s as (select doc_id, i, sent, row_number() over (partition by doc_id order by i) as j, list_distinct(list_filter(string_split_regex(sent, '[\\s\\x0b]+'), lambda w: w <> '')) as words from o where sent <> ''),
        n as (select *, length(sent) as size, lag(words) over (partition by doc_id order by j) as last from s),
        x as (select doc_id, i, j, size, case when last is null then 1.0 when len(list_distinct(list_concat(words, last))) = 0 then 0.0 else len(list_intersect(words, last)) / len(list_distinct(list_concat(words, last))) end as near from n),
        r as (select doc_id, j, i, 0 as g, size as total from x where j = 1 union all
          select x.doc_id, x.j, x.i, case when r.total >= {chunking.SEGMENT} and x.near < {chunking.PART} then r.g + 1 else r.g end, case when r.total >= {chunking.SEGMENT} and x.near < {chunking.PART} then x.size else r.total + x.size end
          from r join x on x.doc_id = r.doc_id and x.j = r.j + 1),
        b as (select doc_id, g, min(i) as s, max(i) as e from r group by all),
        c as (select b.doc_id, g as k, regexp_replace(array_to_string(t.ps[b.s:b.e], ''), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') as chunk from b join t on t.doc_id = b.doc_id where b.doc_id in (select doc_id from s group by doc_id having count(*) >= 3)),
        q as (select *, count(*) over (partition by doc_id) as n from c where length(chunk) >= {chunking.SEGMENT})
        select doc_id, k::bigint as k, md5(chunk) as chunk_md5 from q where n >= 2""",
    "deadline_plan": f"""with o as (select o_orderkey, floor(o_totalprice::double) % 1200 / 100 as t, o_orderkey % 5000 as c from orders),
        b as (select o_orderkey, t::double - {planner.RESERVE} - {planner.TAIL}::double - {planner.LEXICAL}::double - c::double / 1000 * {planner.USER}::double as budget from o)
        select o_orderkey, p.lists, p.hits, p.rescored, p.candidates, p.degraded from (select o_orderkey, {_plan_sql()} as p from b)""",
    "gate_citations": "select conv_id, turn, case when turn < 1 or turn + 1 > count(*) over (partition by conv_id) then 'FABRICATED_CITATION' end as reason from conversations",
    "lang_report": "select coalesce(lang, 'ALL') as lang, count(*) as documents, count(quality) as labelled, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from (select coalesce(lang, 'und') as lang, quality, toxic from documents left join labels using (doc_id)) group by rollup (lang)",
    "threshold_sweep": """select threshold, count(*) filter (n_chars >= threshold and quality = 1) as tp, count(*) filter (n_chars >= threshold and quality = 0) as fp, count(*) filter (n_chars < threshold and quality = 1) as fn,
        count(*) filter (n_chars < threshold and quality = 0) as tn from labels join documents using (doc_id), (select unnest([50, 100, 200, 400, 800, 1600, 3200, 6400]::bigint[]) as threshold) where n_chars is not null and quality is not null group by all""",
}
