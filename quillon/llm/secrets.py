"""Secret scanning by rules and by character Markov models, in DataFrame functions only.

Three rules give the base spans. Beyond them, every run of 20 or more key characters is scored by two first-order Markov
models over 63 symbols, one of random strings and one of ordinary identifiers; a run whose mean log-likelihood ratio is
above a threshold, and that meets no base span, is a further span of kind ``markov``. Both models are counted with
DataFrame aggregations over labelled samples: what the rules find in a bounded sample of documents and digests on the
random side, the other words of those documents and joined identifier words on the ordinary side. Counting gives at most
2 * 63 * 63 rows, which become one literal table, so scoring is a lookup in an array.

Offsets come from one lazy expression, ``(.*?)(pattern)`` or the rest of the text: the lengths of its two groups add up to
code-point positions. As the rest always matches, no part of a text is searched twice.

Defined results: null text counts as empty and has no spans; null doc_ids are scanned like others but never in the training
sample; spans that start together come in the order of their kinds; repeated rows get equal results; texts of any length are
scanned whole, in time that grows as their length; an empty table gives an empty result; extra columns never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns
from quillon.session import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Documents of the training sample, chosen by hash of doc_id, and the mean log ratio (nats a character) of a secret.
SAMPLE = 2000
THRESHOLD = 0.6
SYMBOLS = 63
#: Matches that are folded together.
PART = 128
#: Words that identifiers are made of, for the ordinary side.
NAMES = tuple(
    "get set is has add remove update delete create find load save read write open close start stop user account order item price "
    "total count index value name type list map table column row file path node edge graph query result error message event handler "
    "request response client server session config option default current previous next first last buffer stream input output".split()
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(items: Column) -> Column:
    """An array in parts of PART items: folds over parts, then over the items of one, stay linear in its length."""
    some = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    return F.transform(some, lambda i: F.slice(items, i * PART + 1, F.lit(PART)))


_SPAN = "struct<start: bigint, end: bigint, value: string>"


def _matches(text: Column, pattern: str, rough: Column) -> Column:
    """array<struct<start, end, value>> of the matches of ``pattern``; value is its last group, or the match."""
    full = rf"(?s)(.*?)(?:({pattern})|\z)"
    last = 4 if pattern == ASSIGN else 2
    whole = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(full), F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "hit"), (last, "value"))])
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    none = F.expr(f"cast(array() as array<array<{_SPAN}>>)")
    shifted = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["gap"])).cast("long")
        end = (start + F.length(x["hit"])).cast("long")
        return F.struct(end.alias("at"), F.array_append(acc["all"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("all"))

    def join(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["all"], F.transform(part["all"], lambda x: shifted(x, acc["at"]))).alias("all"))

    start = lambda none: F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
    folded = lambda w: F.aggregate(F.transform(_parts(w), lambda part: F.aggregate(part, start(empty), step)), start(none), join)
    spans = F.flatten(_let(whole, folded)["all"])
    return F.when(rough, F.filter(spans, lambda x: x["start"] < x["end"])).otherwise(empty)


def _clear_of(runs: Column, spans: Column) -> Column:
    """The ``runs`` that meet no one of ``spans``, which are looked at by parts of neighbours."""
    parts = lambda s: F.transform(_parts(s), lambda p: F.struct(F.array_min(F.transform(p, lambda b: b["start"])).alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("all")))
    meets = lambda b, x: (b["start"] < x["end"]) & (x["start"] < b["end"])
    clear = lambda ps: F.filter(runs, lambda x: ~F.exists(ps, lambda p: meets(p, x) & F.exists(p["all"], lambda b: meets(b, x))))
    return F.when(F.size(spans) == 0, runs).otherwise(_let(parts(F.array_sort(spans)), clear))


def _base(text: Column) -> dict[str, Column]:
    spans = {
        "assign": F.filter(_matches(text, ASSIGN, text.rlike(ASSIGN)), lambda x: F.length(x["value"]) >= 8),
        "access": F.filter(_matches(text, ACCESS, text.contains("AKIA")), lambda x: x["end"] - x["start"] >= 16),
        # greedy runs of 32 or more are the runs that pass, so shorter ones need not be listed
        "hex": _matches(text, HEX[:-1] + "{32,}", text.rlike(HEX[:-1] + "{32}")),
    }
    return spans


def _symbols(token: Column) -> Column:
    """Symbol numbers of a run: a-z, A-Z, 0-9, and one for the rest."""
    codes = [62] * 128
    for k, (a, n) in enumerate(((97, 26), (65, 26), (48, 10))):
        for i in range(n):
            codes[a + i] = (0, 26, 52)[k] + i
    lookup = F.lit(codes)
    return F.transform(F.split(token, "", -1), lambda c: F.element_at(lookup, F.least(F.ascii(c), F.lit(127)) + 1))


def _samples(docs: DataFrame, sample: int) -> DataFrame:
    """(label, token) rows: 1 random, 0 ordinary."""
    spark = docs.sparkSession
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    some = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(text.alias("text"))  # at most ``sample`` rows
    base = _base(F.col("text"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX[:-1] + "{32,}", " ")
    found = some.select(F.explode(F.transform(F.concat(*base.values()), lambda x: x["value"])).alias("token")).select(F.lit(1).alias("label"), "token")
    words = some.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z][A-Za-z0-9+/_=-]{5,}"), F.lit(0))).alias("token")).select(F.lit(0).alias("label"), "token")
    digest = F.sha2(F.col("id").cast("string"), 256)
    strings = spark.range(600).select(F.lit(1).alias("label"), F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=", "")).otherwise(F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 24))).alias("token"))
    names = F.lit(list(NAMES))
    pick = lambda k: F.element_at(names, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(NAMES))) + 1).cast("int"))
    joined = F.when(F.col("id") % 2 == 0, F.concat_ws("_", pick(1), pick(2), pick(3))).otherwise(F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4))))
    idents = spark.range(2000).select(F.lit(0).alias("label"), joined.alias("token"))
    return found.union(words).union(strings).union(idents)


def fit_markov(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of each pair of symbols, random over ordinary, with add-one smoothing."""
    s = _samples(docs, sample).where(F.length("token") > 1).withColumn("s", _symbols(F.col("token")))
    n = F.size("s")
    pairs = F.zip_with(F.slice("s", F.lit(1), n - 1), F.slice("s", F.lit(2), n - 1), lambda a, b: a * SYMBOLS + b)
    rows = s.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()  # at most 2 * 63 * 63
    counts = [[1.0] * (SYMBOLS * SYMBOLS) for _ in range(2)]
    for r in rows:
        counts[r["label"]][r["pair"]] += r["count"]
    out = []
    for a in range(SYMBOLS):
        total = [sum(c[a * SYMBOLS : (a + 1) * SYMBOLS]) for c in counts]
        out += [math.log(counts[1][a * SYMBOLS + b] / total[1]) - math.log(counts[0][a * SYMBOLS + b] / total[0]) for b in range(SYMBOLS)]
    return out


def _ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's symbol pairs."""
    lookup = F.lit(ratios)
    pair = F.aggregate(
        _symbols(token),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.element_at(lookup, acc["last"] * SYMBOLS + s + 1)).otherwise(0.0)).alias("sum")),
    )
    return pair["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


def _tagged(rank: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, found: array<struct<start, rank, kind, end>> by start, then kind as listed.

    ``ratios`` are those of ``fit_markov`` over other documents; without them they are fitted on ``docs``.
    """
    docs = doc_columns(docs, id_col, text_col).toDF("doc_id", "text")
    ratios = ratios or fit_markov(docs, sample)
    text = F.col("text")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = _base(text)
    read = read.select("doc_id", "text", *[c.alias(k) for k, c in kinds.items()])
    runs = _matches(text, RUN, text.rlike(RUN[:-2] + "}"))
    read = read.withColumn("runs", runs)
    read = read.withColumn("markov", F.filter(_clear_of(F.col("runs"), F.concat(*kinds)), lambda x: _ratio(x["value"], ratios) >= threshold))
    tagged = [_tagged(rank, kind) for rank, kind in enumerate((*kinds, "markov"))]
    return read.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*kinds, "markov")], F.array_sort(F.concat(*tagged)).alias("found"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = scan(table(spark, sf_dir, "documents"))
    base = F.sha2(listed(F.filter("found", lambda x: x["kind"] != "markov")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), listed(F.col("found")).alias("spans"))
