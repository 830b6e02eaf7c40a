"""Queries of corpus building, chunks, user sources, measures and streams, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T
from quillon.operators import chunking, evaluation, gates, lexical
from quillon.plans.texts import content_sql, sentences_sql
from quillon.session import scratch, table
from quillon.sources.store import SourceStore
from quillon.streaming import online


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


def length_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 40 to 2,000 characters, and how many are too short and too long."""
    n = F.length(T.normalise_space("text"))
    return _docs(spark, sf_dir).agg(F.count_if(n.between(40, 2000)).alias("kept"), F.count_if(n < 40).alias("short"), F.count_if(n > 2000).alias("long"))


def stratified_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified(_docs(spark, sf_dir), "source", "doc_id", 150)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_rows(_docs(spark, sf_dir), "source", "doc_id", 150).select("source", "doc_id")


def dedupe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts: the first document, and the languages that any copy came from."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.md5(T.normalise_space(T.nfc("text"))).alias("text_md5"))
    return d.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


def group_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the same roles in whatever order: the first of them."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return chunking.distinct_groups(c, "conv_id", "roles").select("conv_id")


def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms against distinct 16-bit hashes of them."""
    terms = _docs(spark, sf_dir).select(F.explode(T.content_tokens("text")).alias("term")).distinct()
    return terms.agg(F.count("*").alias("terms"), (F.count("*") - F.count_distinct(F.substring(F.md5("term"), 1, 4))).alias("collisions"))


def postings_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each term's postings begin in the list of all."""
    d = _docs(spark, sf_dir)
    df = lexical.frequencies(lexical.dealt_postings(d, "doc_id", "text"), lexical.stats(lexical.lengths(d, "doc_id", "text")))
    return lexical.offsets(df)


def postings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings, a term's together and in order of documents; summed up by term."""
    d = _docs(spark, sf_dir)
    posts = lexical.dealt_postings(d, "doc_id", "text")
    return lexical.sorted_postings(posts, lexical.stats(lexical.lengths(d, "doc_id", "text"))).groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("tf"), F.min("id").alias("first"), F.max("id").alias("last"))


def chunk_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence chunks of passages that the corpus has; others' are dropped."""
    d = _docs(spark, sf_dir)
    chunks = chunking.by_sentence(d, "doc_id", "text")
    corpus = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    return chunks.join(corpus, "id", "left_semi").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("chunks"))


def passage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds that each passage's copies were found under, in order."""
    d = _docs(spark, sf_dir).select(F.md5("text").alias("text_md5"), "source")
    return d.groupBy("text_md5").agg(F.array_join(F.sort_array(F.collect_set("source")), " ").alias("types"))


def parallel_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that every event type has, with their first event of each."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.count_distinct("event_type").alias("kinds"))  # one row
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    g = first.groupBy("user_id").agg(F.count("*").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "event_id")))).alias("by_type"))
    g = g.crossJoin(F.broadcast(kinds)).where("n = kinds")
    return g.select("user_id", F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("firsts"))


def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as a group's passages, joined up to 300 characters."""
    turn = F.struct(F.col("turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    c = chunking.by_document(g, "turns", 300)
    return c.select("conv_id", F.col("k").cast("long").alias("k"), "parent", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.md5("chunk").alias("chunk_md5"))


def chunk_document_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.triples(_docs(spark, sf_dir), "source", "doc_id", "text")
    return c.select("source", F.col("parent").alias("doc_id"), F.md5("chunk").alias("chunk_md5"))


def chunk_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a user's passages, their sources as titles."""
    c = chunking.user_chunks(_docs(spark, sf_dir), "doc_id", "text", F.col("source"))
    return c.select(F.col("id").alias("doc_id"), "strategy", F.md5("chunk").alias("chunk_md5"))


def to_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the documents; state runs through a text, so a plain version holds them in a test."""
    p = chunking.to_passages(_docs(spark, sf_dir), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), F.col("k").cast("long").alias("k"), "heading", F.md5("text").alias("text_md5"))


def chunk_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three strategies: shares, chunks a passage, and bytes of their vectors."""
    d = _docs(spark, sf_dir)
    made = (("whole", chunking.whole), ("sentence", chunking.by_sentence), ("sliding", chunking.sliding))
    tagged = [f(d, "doc_id", "text").select("id", "chunk", F.lit(n).alias("strategy")) for n, f in made]
    return chunking.shares(chunking.measures(tagged[0].union(tagged[1]).union(tagged[2])), d.count())


def quantile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(p * (n - 1)), by event type."""
    q = evaluation.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", (10, 50, 90), floor_index=True)
    return q.select("event_type", F.col("p10").alias("q10"), F.col("p50").alias("q50"), F.col("p90").alias("q90"))


def session_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_ranks(table(spark, sf_dir, "events"), "user_id", "value", (50, 70, 100)).select("user_id", "n", "mean", "p50", "p70", "p100")


def refusal_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of turns by role and reason."""
    reasons = ["EMPTY", "TOO_SHORT", "UNSAFE", "INJECTION", "GIBBERISH", "NOT_A_QUESTION"]
    c = table(spark, sf_dir, "conversations").select("role", F.coalesce(gates.input_gate("text"), F.lit("PASSED")).alias("reason"))
    return c.groupBy("role").agg(F.count("*").alias("n"), *[F.count_if(F.col("reason") == r).alias(r.lower()) for r in reasons])


def transcript_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool transcripts: six turns at most, those without an id or of another role dropped, long ones cut."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    role = lambda x: F.when(x["role"] == "assistant", "assistant_tool").when(x["role"] == "user", "tool_result")
    kept = F.filter(F.slice("t", 1, 6), lambda x: role(x).isNotNull() & (x["turn"] != 1))
    said = F.transform(kept, lambda x: F.concat_ws(":", role(x), x["turn"].cast("string"), F.md5(F.substring(x["text"], 1, 8000))))
    return g.select("conv_id", F.array_join(said, ",").alias("turns"))


def breaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker a user over the events, errors as failures: what was let through, and whether it is open after; it stays open an hour."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_type") == "error").alias("failed"))
    return online.folded(e, "user_id", ["event_id"], ["ms", "failed"], online.breaker_step(2, 3_600_000), (0, 0), "allowed boolean, open boolean")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket a user that refills 0.05 a minute; an event costs a hundredth of its value. Ms each waits."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.coalesce("value", F.lit(0.0)) / 100).alias("cost"))
    return online.folded(e, "user_id", ["event_id"], ["ms", "cost"], online.bucket_step(0.05), (0.0, -1.0), "wait double").select("user_id", "event_id", F.round("wait", 3).alias("wait"))


def partial_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as partial transcripts: which start a search."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 20).alias("text"))
    return online.folded(c, "conv_id", ["turn"], ["text"], online.partial_step, ("",), "fires boolean")


def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the events of an answer: assistants' are text, a system turn says there is too little, the rest end it."""
    kind = F.when(F.col("role") == "assistant", "t").when(F.col("role") == "system", "insufficient").otherwise("done")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), "text")
    return online.answer_events(c, "conv_id", "turn", "kind", "text").select("conv_id", F.md5("said").alias("said_md5"), "status")


def tool_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant_tool").otherwise("tool_result").alias("role"))
    return online.tool_rounds(c, "conv_id", "turn", "role")


def _store(spark: SparkSession, sf_dir: str) -> SourceStore:
    """Documents 1 to 40 pasted as sources; every fifth turned off, every seventh removed, one with another model's stamp not restored."""
    d = table(spark, sf_dir, "documents").where("doc_id between 1 and 40").select(F.col("doc_id").alias("source_id"), "text")
    store = SourceStore(spark, scratch(spark, "store"), "hashed-64")
    store.add(d, F.col("source_id") * 10)
    store.enable(F.col("source_id") % 5 == 0, False)
    store.remove(F.col("source_id") % 7 == 0)
    snapshot = store.registry.withColumn("stamp", F.when(F.col("source_id") == 3, "other").otherwise(F.col("stamp")))
    store.clear()
    store.restore(snapshot)
    store.vacuum()
    return store


def source_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after adding, turning off, removing, clearing and restoring; newest first is ``place``."""
    r = _store(spark, sf_dir).registry
    place = F.row_number().over(Window.orderBy(F.desc("added"), "source_id")).cast("long")  # one row a source
    return r.select("source_id", "title", "chars", "enabled", "status", place.alias("place"))


def source_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the sources that are on; their cutting is held by a test."""
    return _store(spark, sf_dir).passages().groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("passages"))


QUERIES = {
    f.__name__: f
    for f in (
        length_filter_stats, stratified_alloc, stratified_sample, dedupe_members, group_dedupe, hash_collisions, postings_layout, postings_sorted, chunk_parent_join, passage_types, parallel_members,
        chunk_document, chunk_document_triples, chunk_user, to_passages, chunk_storage, quantile_floor, session_percentiles, refusal_pivot, transcript_validate, breaker_islands, token_bucket,
        partial_transcripts, answer_stream, tool_loop, source_dml, source_passages,
    )
}

_T = "coalesce(text, '')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"
_NORM = rf"trim(regexp_replace({_T}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))"
_LEX = f"""with docs as (select doc_id, {content_sql(_T)} as toks from documents), one as (select count(*) as n from docs), posts as (select doc_id, term, least(count(*), 255) as tf from (select doc_id, unnest(toks) as term from docs) group by all),
freq as (select term, count(*) as df from posts, one group by term, n having count(*) <= greatest(2, floor(n * 0.15)))"""
_SENT = f"list_filter(list_transform({sentences_sql('text')}, lambda s: {_STRIP.format('s')}), lambda s: s <> '')"
_USER = f"""with d as (select doc_id, {_T} as text, coalesce(source, '') as source, regexp_extract_all({_T}, '{K.LATIN_RUN}') as ll, regexp_extract_all({_T}, '{K.NUMERIC}') as nn from documents where text <> ''),
p as (select doc_id, text, source, list_filter(ll, lambda x, i: list_position(ll, x) = i)[1:8] as l, list_filter(nn, lambda x, i: list_position(nn, x) = i)[1:8] as n, {_SENT} as ss from d),
e as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as i, len(ss) as m from p),
w as (select *, list_distinct(list_filter(string_split_regex(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]', ' ', 'g'), '[\\s\\x0b]+'), lambda x: length(x) > 2)) as ws from e),
j as (select *, lag(ws) over (partition by doc_id order by i) as last, lead(s) over (partition by doc_id order by i) as next from w),
g as (select *, sum(case when last is not null and len(last) > 0 and len(ws) > 0 and len(list_intersect(last, ws)) / len(list_distinct(list_concat(last, ws))) >= {chunking.USER_PART} then 0 else 1 end) over (partition by doc_id order by i) as grp from j),
c as (select doc_id, 'whole' as strategy, text as chunk from p
  union all select doc_id, 'contextual', concat_ws(' | ', source, case when len(l) > 0 then array_to_string(l, ' ') end, case when len(n) > 0 then array_to_string(n, ' ') end) || chr(10) || text from p
  union all select doc_id, 'sentence', s from e where m > 1 and length(s) >= {chunking.SENTENCE}
  union all select doc_id, 'sliding', s || ' ' || next from j where m > 2 and next is not null
  union all select doc_id, 'semantic', string_agg(s, ' ' order by i) from g where m > 2 group by doc_id, grp having count(*) > 1)"""
_ROLE = "case role when 'assistant' then 'assistant_tool' when 'user' then 'tool_result' end"


def _refusals() -> str:
    from quillon.plans.search import input_gate_sql

    gated = f"(select role, {input_gate_sql('q')} as reason from (select role, {_STRIP.format(_T)} as q from conversations))"
    return "select role, count(*) as n, " + ", ".join(f"count(*) filter (reason = '{r}') as {r.lower()}" for r in ("EMPTY", "TOO_SHORT", "UNSAFE", "INJECTION", "GIBBERISH", "NOT_A_QUESTION")) + f" from {gated} group by all"


_CLEAN = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\x{{a0}}', ' ', 'g'), chr(10) || chr(10), chr(1)), '([^\n\x01।.!?:;])\n([^\n\x01])', '\1 \2', 'g'), '\x01', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')").replace("{{", "{").replace("}}", "}")
ORACLE_SQL = {
    "length_filter_stats": f"select count(*) filter (n between 40 and 2000) as kept, count(*) filter (n < 40) as short, count(*) filter (n > 2000) as long from (select length({_NORM}) as n from documents)",
    "stratified_alloc": "with n as (select coalesce(source, '') as source, count(*) as n from documents group by all) select source, n, least(n, round_even(150 * n / sum(n) over (), 0))::bigint as take from n",
    "stratified_sample": """with n as (select coalesce(source, '') as source, count(*) as n from documents group by all), t as (select source, least(n, round_even(150 * n / sum(n) over (), 0))::bigint as take from n),
        r as (select coalesce(source, '') as source, doc_id, row_number() over (partition by coalesce(source, '') order by md5(doc_id::varchar), doc_id) as r from documents) select source, doc_id from r join t using (source) where r <= take""",
    "dedupe_members": f"select text_md5, min(doc_id) as doc_id, count(*) as copies, array_to_string(list_sort(list_distinct(list(lang))), ',') as languages from (select doc_id, coalesce(lang, 'und') as lang, md5({_NORM.replace(_T, f'nfc_normalize({_T})')}) as text_md5 from documents) group by all",
    "group_dedupe": "select min(conv_id) as conv_id from (select conv_id, array_to_string(list_sort(list(role)), ',') as roles from conversations group by all) group by roles",
    "hash_collisions": f"select count(*) as terms, count(*) - count(distinct substring(md5(term), 1, 4)) as collisions from (select distinct unnest({content_sql(_T)}) as term from documents)",
    "postings_layout": f"{_LEX} select term, df, coalesce(sum(df) over (order by encode(term) rows between unbounded preceding and 1 preceding), 0)::bigint as start from freq",
    "postings_sorted": f"{_LEX} select term, df, sum(tf)::bigint as tf, min(doc_id) as first, max(doc_id) as last from posts join freq using (term) group by all",
    "chunk_parent_join": f"select doc_id, count(*) as chunks from (select doc_id, unnest({_SENT}) as s from documents where text <> '' and doc_id % 7 <> 0) where length(s) >= {chunking.SENTENCE} group by all",
    "passage_types": f"select md5({_T}) as text_md5, array_to_string(list_sort(list_distinct(list(coalesce(source, '')))), ' ') as types from documents group by all",
    "parallel_members": "with f as (select user_id, event_type, min(event_id) as e from events group by all) select user_id, string_agg(event_type || ':' || e, ',' order by event_type) as firsts from f group by all having count(*) = (select count(distinct event_type) from events)",
    "chunk_document": f"""with recursive o as (select conv_id, turn, {_T} as text, length({_T}) as n, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as m from conversations),
        f as (select conv_id, turn, text, i, 0::bigint as k, n as size from o where i = 1 and m >= 2 union all
          select o.conv_id, o.turn, o.text, o.i, case when f.size + o.n > 300 then f.k + 1 else f.k end, case when f.size + o.n > 300 then o.n else f.size + o.n end from f join o on o.conv_id = f.conv_id and o.i = f.i + 1)
        select conv_id, k, min(turn) as parent, string_agg(turn, ',' order by i) as members, md5(string_agg(text, ' ' order by i)) as chunk_md5 from f group by all""",
    "chunk_document_triples": f"with o as (select coalesce(source, '') as source, doc_id, {_T} as text, (row_number() over (partition by coalesce(source, '') order by doc_id) - 1) // 3 as g from documents) select source, min(doc_id) as doc_id, md5(string_agg(text, ' ' order by doc_id)) as chunk_md5 from o group by source, g having count(*) > 1",
    "chunk_user": f"{_USER} select doc_id, strategy, md5({_STRIP.format('chunk')}) as chunk_md5 from c where length({_STRIP.format('chunk')}) >= {chunking.USER_LEAST}",
    "chunk_storage": f"""with d as (select doc_id, {_T} as text from documents where text <> ''), c as (select 'whole' as strategy, doc_id, text as chunk from d union all select 'sentence', doc_id, s from (select doc_id, unnest({_SENT}) as s from d) where length(s) >= {chunking.SENTENCE}
        union all select 'sliding', doc_id, substring(text, pos + 1, 200) from (select doc_id, text, unnest(case when length(text) <= 200 then [0] else range(0, length(text), 120) end) as pos from d) where pos = 0 or length(text) - pos >= 60),
        m as (select coalesce(strategy, 'TOTAL') as strategy, count(*) as chunks, round(sum(length(chunk)) / count(*), 6) as mean_chars from c group by rollup (strategy))
        select *, round(chunks / (select count(*) from documents), 6) as a_passage, round(chunks / max(chunks) filter (strategy = 'TOTAL') over (), 6) as share, chunks * 48 as bytes_48, chunks * 384 as bytes_384, chunks * 1536 as bytes_1536 from m""",
    "quantile_floor": "with v as (select event_type, list_sort(list(value)) as v from events where value is not null group by all) select event_type, " + ", ".join(f"v[((len(v) - 1) * {p} // 100 + 1)::int] as q{p}" for p in (10, 50, 90)) + " from v",
    "session_percentiles": "select user_id, count(*) as n, round(avg(value), 9) as mean, " + ", ".join(f"quantile_disc(value, {p / 100}) as p{p}" for p in (50, 70, 100)) + " from events where value is not null group by all",
    "refusal_pivot": _refusals(),
    "transcript_validate": f"""with t as (select *, row_number() over (partition by conv_id order by turn) as i from conversations) select conv_id, coalesce(string_agg({_ROLE} || ':' || turn || ':' || md5(substring({_T}, 1, 8000)), ',' order by i) filter (i <= 6 and turn <> 1 and {_ROLE} is not null), '') as turns from t group by all""",
    "breaker_islands": """with recursive e as (select user_id, event_id, epoch_us(ts) // 1000 as ms, event_type = 'error' as failed, row_number() over (partition by user_id order by event_id) as i from events),
        f as (select user_id, event_id, i, true as allowed, case when failed then 1 else 0 end as n, 0::bigint as opened, ms from e where i = 1 union all
          select e.user_id, e.event_id, e.i, not (f.n >= 2 and e.ms - f.opened <= 3600000),
            case when f.n >= 2 and e.ms - f.opened <= 3600000 then f.n when e.failed then (case when f.n >= 2 then 1 else f.n end) + 1 else 0 end,
            case when f.n >= 2 and e.ms - f.opened <= 3600000 then f.opened when e.failed and (case when f.n >= 2 then 1 else f.n end) + 1 >= 2 then e.ms else f.opened end, e.ms
          from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select user_id, event_id, allowed, n >= 2 as open from f""",
    "token_bucket": """with recursive e as (select user_id, event_id, (epoch_us(ts) // 1000)::double as ms, least(coalesce(value, 0) / 100, 0.05) as want, row_number() over (partition by user_id order by event_id) as i from events),
        f as (select user_id, event_id, i, 0.05 - want as held, ms as now, 0.0::double as wait from e where i = 1 union all
          select user_id, event_id, i, case when have < want then least(0.05, have + wait / 60000 * 0.05) - want else have - want end, start + wait, start + wait - ms from (
            select *, case when have < want then greatest(50.0, (want - have) / 0.05 * 60000) else 0.0 end as wait from (
              select e.*, greatest(e.ms, f.now) as start, least(0.05, f.held + (greatest(e.ms, f.now) - f.now) / 60000 * 0.05) as have from f join e on e.user_id = f.user_id and e.i = f.i + 1)))
        select user_id, event_id, round(wait, 3) as wait from f""",
    "partial_transcripts": f"""with recursive o as (select conv_id, turn, {_STRIP.format("substring(coalesce(text, ''), 1, 20)")} as t, row_number() over (partition by conv_id order by turn) as i from conversations),
        f as (select conv_id, turn, i, length(t) > 12 as fires, case when length(t) > 12 then t else '' end as held from o where i = 1 union all
          select o.conv_id, o.turn, o.i, length(o.t) > 12 and o.t <> f.held, case when length(o.t) > 12 then o.t else f.held end from f join o on o.conv_id = f.conv_id and o.i = f.i + 1) select conv_id, turn, fires from f""",
    "answer_stream": f"select conv_id, md5(coalesce(string_agg({_T}, '' order by turn) filter (role = 'assistant'), '')) as said_md5, case when count(*) filter (role = 'system') > 0 then 'insufficient' when count(*) filter (role not in ('assistant', 'system')) > 0 then 'done' else 'open' end as status from conversations group by all",
    "tool_loop": "select conv_id, least(count(*) filter (role = 'assistant'), 2)::bigint as rounds, count(*) filter (role = 'assistant') < 2 as offered from conversations group by all",
    "source_dml": rf"""with c as (select doc_id, {_CLEAN} as text from documents where doc_id between 1 and 40 and doc_id % 7 <> 0 and doc_id <> 3), l as (select *, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1], 'Pasted text') as line from c),
        b as (select *, regexp_replace(line, '^#+[\s\x0b]*', '') as t from l) select doc_id as source_id, case when length(t) > 64 then substring(t, 1, 61) || '...' else t end as title, length(text)::bigint as chars, length(text) >= 20 and doc_id % 5 <> 0 as enabled,
        case when length(text) >= 20 then 'ready' else 'error' end as status, row_number() over (order by doc_id desc) as place from b""",
}
