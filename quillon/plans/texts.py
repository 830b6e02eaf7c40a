"""Queries of the text functions, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T
from quillon.operators import gates
from quillon.session import table

DEVA = "०१२३४५६७८९"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def txt_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise_space(T.nfc("text"))).alias("text_md5"))


def txt_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.char_entropy("text"), 6).alias("bits"))


def txt_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they are, and with nine letters in Devanagari."""
    d = _docs(spark, sf_dir).withColumn("other", F.translate("text", "aeiourstn", "अएइओउरसतन"))
    return d.select("doc_id", T.dominant_script("text").alias("script"), T.script_language("text").alias("spoken"), T.dominant_script("other").alias("other_script"), T.script_language("other").alias("other_spoken"))


def txt_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their digits in Devanagari, read back."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalise_digits(F.translate("text", "0123456789", DEVA))).alias("text_md5"))


def txt_latin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.latin_runs("text"), "|").alias("runs"))


def txt_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.first_line_title("text").alias("title"))


def txt_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings among the lines of texts, plain and in capitals."""

    def line(t, i):
        shaped = F.when(i % 3 == 0, F.upper(F.call_function("replace", t, F.lit("ß"), F.lit("ss")))).when(i % 3 == 1, F.concat(F.lit("## "), t)).otherwise(F.concat(F.lit("3.2 "), t))
        return F.struct(i.cast("long").alias("line"), T.heading_of(shaped).alias("heading"))

    found = F.filter(F.transform(F.split("text", "[\\n.]"), line), lambda x: x["heading"].isNotNull())  # judged once, not again in a filter
    return _docs(spark, sf_dir).select("doc_id", F.inline_outer(found)).where("heading is not null")


def txt_specifics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(T.specifics("text"), "|").alias("specifics"))


def txt_clamp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clamp_query("text").alias("query"))


def _hindi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as they are, and every second one inside a romanised question."""
    t = _turns(spark, sf_dir)
    word = F.substring_index("text", " ", 1)
    return t.withColumn("q", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("kya "), word, F.lit(" kahan hai, batao"))).otherwise(F.col("text")))


def translit_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hindi(spark, sf_dir).select("conv_id", "turn", T.is_romanised_hindi("q").alias("romanised"))


def translit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hindi(spark, sf_dir).select("conv_id", "turn", T.fold_romanised("q").alias("folded"))


def fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.fnv1a64("n_name").alias("hash"))


def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage ids (64 bits of the normalised text) and the ids of their whole chunks (48 bits of strategy, passage and number)."""
    d = _docs(spark, sf_dir).select("doc_id", T.blake2b_hex(T.normalise_space(T.nfc("text")), F.lit(8)).alias("passage_id"))
    return d.select("doc_id", "passage_id", T.blake2b_hex(F.concat_ws(":", F.lit("whole"), "passage_id", F.lit("0")), F.lit(6)).alias("chunk_id"))


def partial_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON object that breaks off after 200 characters says of its answer."""
    cut = F.substring(F.to_json(F.struct(F.col("turn").alias("n"), F.col("text").alias("answer"))), 1, 200)
    return _turns(spark, sf_dir).select("conv_id", "turn", T.partial_json(cut, "answer").alias("answer"))


def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("<think>a\nb</think>"), "text", F.lit("<Reasoning>"), "text", F.lit("</reasoning>"))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.strip_thinking(wrapped).alias("said"))


def safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties, every third one broken: the object, or an empty one."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props")).alias("p"))
    return e.select("event_id", F.coalesce(F.get_json_object("p", "$.k"), F.lit("")).alias("k"), F.when(F.get_json_object("p", "$").isNull(), F.lit("{}")).otherwise(F.lit("object")).alias("kind"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token vectors a row, the second masked out in every other row."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", T.mean_pool(F.array("embedding", F.reverse("embedding")), F.array(F.lit(1).cast("long"), F.col("vec_id") % 2)).alias("pooled"))
    return v.select("vec_id", F.round(F.element_at("pooled", 1), 6).alias("first"), F.round(F.element_at("pooled", 64), 6).alias("last"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the sources of a prompt, its first as the query."""
    turn = F.struct("turn", F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return c.select("conv_id", F.md5(T.prompt(F.col("t")[0]["text"], F.transform("t", lambda x: F.struct(x["title"], x["text"])))).alias("prompt_md5"))


def gate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn against the two turns before it."""
    return _with_contexts(spark, sf_dir).select("conv_id", "turn", F.round(gates.grounding_score(F.col("text"), F.col("contexts")), 6).alias("coverage"), gates.grounding_gate(F.col("text"), F.col("contexts")).alias("reason"))


def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_contexts(spark, sf_dir).select("conv_id", "turn", gates.grounded_sentences(F.col("text"), F.col("contexts")).alias("kept"))


def verify_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn that cites its second context, or a third that is not there."""
    cited = F.array((F.lit(2) + (F.col("turn") % 5 == 0).cast("int")).cast("double"))
    return _with_contexts(spark, sf_dir).select("conv_id", "turn", gates.verify_generated(F.col("text"), F.col("contexts"), cited).alias("reason"))


def _with_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with two turns before them, which are their contexts; one pass over a conversation's turns."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))  # a conversation's turns
    x = c.select("conv_id", F.posexplode("t").alias("i", "x"), "t").where("i >= 2")
    return x.select("conv_id", F.col("x.turn").alias("turn"), F.col("x.text").alias("text"), F.transform(F.slice("t", F.col("i") - 1, F.lit(2)), lambda y: y["text"]).alias("contexts"))


QUERIES = {
    f.__name__: f
    for f in (
        txt_normalise, txt_entropy, txt_script, txt_digits, txt_latin_runs, txt_title, txt_heading, txt_specifics, txt_clamp_query, translit_detect, translit_fold, fnv1a64, hash_ids, partial_json,
        strip_thinking, safe_json, mean_pool, event_times, prompt_build, gate_grounding, sentence_filter, verify_generated,
    )
}

_T = "coalesce(text, '')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"


def list_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def raw_sql(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '{T.NOT_WORD}', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)"


def content_sql(c: str) -> str:
    kept = f"list_filter({raw_sql(c)}, lambda t: not list_contains({list_sql(K.STOP_EN + K.STOP_HI)}, t))"
    return f"(case when len({kept}) > 0 then {kept} else {raw_sql(c)} end)"


def script_sql(c: str) -> str:
    """Scripts and spoken languages by counts of characters, earlier ones first on a tie."""
    counted = lambda chars: f"(length({c}) - length(regexp_replace({c}, '[{chars}]', '', 'g')))"
    best = lambda rows: "list_max([" + ", ".join(f"{{'n': {counted(r)}, 'i': {-i}, 'name': '{name}'}}" for i, (name, r) in enumerate(rows)) + "])"
    return f"case when {best(K.SCRIPTS)}.n > 0 then {best(K.SCRIPTS)}.name else 'unknown' end", f"case when {best(K.SPOKEN)}.n >= 3 then {best(K.SPOKEN)}.name else 'en' end"


def sentences_sql(c: str) -> str:
    """Cut after a full stop and white space; pieces as they are."""
    return rf"string_split(regexp_replace({c}, '([।.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1))"


def specifics_sql(c: str) -> str:
    words = r"list_filter(string_split_regex(trim(s), '[\s\x0b]+'), lambda w: w <> '')"
    tagged = rf"list_transform({words}, lambda w, i: {{'i': i, 'w': regexp_replace(w, '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')}})"
    kept = rf"list_filter({tagged}, lambda x: length(x.w) >= 2 and (regexp_matches(x.w, '\p{{N}}') or (x.i > 1 and substring(x.w, 1, 1) <> lower(substring(x.w, 1, 1)))))"
    flat = f"flatten(list_transform({sentences_sql(c)}, lambda s: list_transform({kept}, lambda x: lower(x.w))))"
    return f"list_filter({flat}, lambda x, i: list_position({flat}, x) = i)"


def _zeros() -> str:
    return "".join(chr(z + i) for z in K.DIGIT_ZEROS for i in range(10))


_MARKS = list_sql(sorted({*K.SCAFFOLD, *(w for w in K.ROMANISED if w not in K.AMBIGUOUS)}))
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(q), '[^\p{L}\p{N}\p{M}\s]', ' ', 'g'), '[\s\x0b]+'), lambda w: w <> '')"
_MAP = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in K.ROMANISED.items()) + "}"
_HINDI = f"""with h as (select conv_id, turn, case when turn % 2 = 0 then 'kya ' || split_part({_T}, ' ', 1) || ' kahan hai, batao' else {_T} end as q from conversations),
w as (select *, {_WORDS} as ws from h),
m as (select *, regexp_matches(q, '[a-zA-Z]') and coalesce(len(list_filter(ws, lambda w: list_contains({_MARKS}, w))) / nullif(len(ws), 0) >= 0.3, false) as romanised from w)"""
_CONTEXTS = f"""with c as (select conv_id, turn, {_T} as text, lag({_T}) over w as b, lag({_T}, 2) over w as a from conversations window w as (partition by conv_id order by turn)),
x as (select conv_id, turn, text, a, b from c where a is not null),
y as (select *, a || ' ' || b as joined, list_distinct({content_sql('text')}) as said, list_distinct(list_concat({content_sql('a')}, {content_sql('b')})) as known, list_distinct({content_sql('b')}) as known_b from x)"""


def _overlap_sql(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then len(list_intersect({a}, {b})) / len({a}) else 0.0 end)"


def _grounding_sql(joined: str, known: str) -> str:
    flat = rf"string_split_regex(regexp_replace(lower(translate({joined}, '{_zeros()}', '{'0123456789' * len(K.DIGIT_ZEROS)}')), '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g'), '[\s\x0b]+')"
    a, b = script_sql("text")[0], script_sql(joined)[0]
    across = f"(({a}) <> ({b}) and ({a}) <> 'unknown' and ({b}) <> 'unknown')"
    found = specifics_sql("text")
    invented = rf"len(list_filter({found}, lambda w: (not {across} or regexp_matches(w, '\d')) and not list_contains({flat}, w))) > 0"
    return f"case when {invented} then 'UNGROUNDED' when not {across} and {_overlap_sql('said', known)} < 0.34 then 'UNGROUNDED' end"


_OTHER = f"translate({_T}, 'aeiourstn', 'अएइओउरसतन')"
_HEX = "lower(hex(encode(n_name)))"
ORACLE_SQL = {
    "txt_normalise": rf"select doc_id, md5(trim(regexp_replace(nfc_normalize({_T}), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))) as text_md5 from documents",
    "txt_entropy": f"select doc_id, round(coalesce(list_aggregate(string_split({_T}, ''), 'entropy'), 0), 6) as bits from documents",
    "txt_script": f"select doc_id, {script_sql(_T)[0]} as script, {script_sql(_T)[1]} as spoken, {script_sql(_OTHER)[0]} as other_script, {script_sql(_OTHER)[1]} as other_spoken from documents",
    "txt_digits": f"select doc_id, md5({_T}) as text_md5 from documents",
    "txt_latin_runs": f"select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as runs from (select doc_id, regexp_extract_all({_T}, '{K.LATIN_RUN}')[1:8] as l from documents)",
    "txt_title": rf"with l as (select doc_id, coalesce(list_filter(list_transform(string_split({_T}, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1], 'Pasted text') as line from documents), b as (select doc_id, regexp_replace(line, '^#+[\s\x0b]*', '') as t from l) select doc_id, case when length(t) > 64 then substring(t, 1, 61) || '...' else t end as title from b",
    "txt_heading": rf"""with l as (select doc_id, string_split_regex({_T}, '[\n.]') as ls from documents), e as (select doc_id, unnest(ls) as t, generate_subscripts(ls, 1) - 1 as line from l),
        s as (select doc_id, line, {_STRIP.format("case when line % 3 = 0 then upper(replace(t, 'ß', 'ss')) when line % 3 = 1 then '## ' || t else '3.2 ' || t end")} as t from e),
        h as (select *, regexp_extract(t, '^#{{1,6}}[\s\x0b]+(.{{1,90}})$', 1) as m, regexp_replace(t, '[^\p{{L}}]', '', 'g') as letters from s)
        select doc_id, line::bigint as line, case when m <> '' then {_STRIP.format('m')} else t end as heading from h
        where m <> '' or (t <> '' and length(t) <= 80 and not regexp_matches(t, '[.!?।]$') and ((length(letters) >= 3 and letters = upper(letters) and regexp_matches(letters, '[A-Z]')) or regexp_matches(t, '^\d+(\.\d+)*[\s\x0b]+[^\s\x0b]')))""",
    "txt_specifics": f"select conv_id, turn, array_to_string({specifics_sql(_T)}, '|') as specifics from conversations",
    "txt_clamp_query": f"""with c as (select doc_id, {_T} as text, substring({_T}, 1, 320) as cut from documents), l as (select *, 320 - instr(reverse(cut), ' ') as last from c)
        select doc_id, case when length(text) <= 320 then text when instr(cut, ' ') > 0 and last > 192 then {_STRIP.format('substring(cut, 1, last)')} else {_STRIP.format('cut')} end as query from l""",
    "translit_detect": f"{_HINDI} select conv_id, turn, romanised from m",
    "translit_fold": f"{_HINDI}, f as (select *, array_to_string(list_transform(list_filter(ws, lambda w: not list_contains({list_sql(K.SCAFFOLD)}, w)), lambda w: coalesce({_MAP}[w], w)), ' ') as f from m) select conv_id, turn, case when romanised and f <> '' then f else q end as folded from f",
    "fnv1a64": f"""with recursive h as (select n_nationkey, {_HEX} as b, 0 as i, 14695981039346656037::hugeint as h from nation union all
        select n_nationkey, b, i + 1, (xor(h, ('0x' || substring(b, 2 * i + 1, 2))::int::hugeint) * 1099511628211) % 18446744073709551616::hugeint from h where 2 * i < length(b))
        select n_nationkey, lower(printf('%08x', (h // 4294967296)::bigint) || printf('%08x', (h % 4294967296)::bigint)) as hash from h where 2 * i >= length(b)""",
    "strip_thinking": rf"select conv_id, turn, {_STRIP.format(f'''regexp_replace('<think>a' || chr(10) || 'b</think>' || {_T} || '<Reasoning>' || {_T} || '</reasoning>', '(?is)<think>.*?</think>|<thinking>.*?</thinking>|<reasoning>.*?</reasoning>', '', 'g')''')} as said from conversations",
    "safe_json": "with e as (select event_id, case when event_id % 3 = 0 then substring(props, 1, length(props) - 1) else props end as p from events) select event_id, case when json_valid(p) then coalesce(json_extract_string(p, '$.k'), '') else '' end as k, case when json_valid(p) then 'object' else '{}' end as kind from e",
    "mean_pool": "select vec_id, round(case when vec_id % 2 = 1 then (embedding[1]::double + embedding[64]::double) / 2 else embedding[1]::double end, 6) as first, round(case when vec_id % 2 = 1 then (embedding[1]::double + embedding[64]::double) / 2 else embedding[64]::double end, 6) as last from embeddings",
    "event_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso, epoch_us(ts) // 1000 as ms from events",
    "prompt_build": f"""with t as (select conv_id, role, {_T} as text, row_number() over (partition by conv_id order by turn) as i from conversations),
        s as (select conv_id, string_agg('[' || i || '] ' || substring(regexp_replace(coalesce(role, ''), '[<>"]', '', 'g'), 1, 120) || chr(10) || substring(text, 1, 4000), chr(10) || chr(10) order by i) filter (i <= 5) as listed, max(text) filter (i = 1) as q from t group by all)
        select conv_id, md5(listed || chr(10) || chr(10) || substring(q, 1, 1000)) as prompt_md5 from s""",
    "gate_grounding": f"{_CONTEXTS} select conv_id, turn, round({_overlap_sql('said', 'known')}, 6) as coverage, {_grounding_sql('joined', 'known')} as reason from y",
    "sentence_filter": f"{_CONTEXTS}, s as (select conv_id, turn, known, unnest(list_filter(list_transform({sentences_sql('text')}, lambda s: {_STRIP.format('s')}), lambda s: s <> '')) as s from y), n as (select *, row_number() over () as nth, list_distinct({content_sql('s')}) as w from s) select conv_id, turn, coalesce(k, '') as kept from y left join (select conv_id, turn, string_agg(s, ' ' order by nth) as k from n where {_overlap_sql('w', 'known')} >= 0.55 group by all) using (conv_id, turn)",
    "verify_generated": f"{_CONTEXTS} select conv_id, turn, case when turn % 5 = 0 then 'FABRICATED_CITATION' else {_grounding_sql('b', 'known_b')} end as reason from y",
}
