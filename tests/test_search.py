"""The exact vector search against all pairs, and steps that must not grow with the square of the input or read part of it."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import vectors as V


def _all_pairs(v, q, k, skip_self):
    """The same lists by a cross join and column functions."""
    p8, scale = V.int8(F.col("embedding"))
    x = v.select("vec_id", "embedding", "code", p8.alias("p8"), scale.alias("scale")).crossJoin(q.select("query_id", F.col("embedding").alias("q"), F.col("code").alias("q_code"), V.int8_query(F.col("embedding")).alias("q8")))
    x = x.where("vec_id <> query_id") if skip_self else x
    million = lambda c: F.round(F.round(c, 6) * 1e6).cast("long")
    scores = {"whole": million(V.dot(F.col("embedding"), F.col("q"))), "sentence": -V.hamming(F.col("code"), F.col("q_code")), "semantic": million(V.int8_cosine(F.col("q8"), F.col("p8"), F.col("scale")))}
    x = x.select("query_id", "vec_id", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), c.alias("key")) for s, c in scores.items()])).alias("s")).select("query_id", "s.strategy", "vec_id", "s.key")
    rank = F.row_number().over(Window.partitionBy("query_id", "strategy").orderBy(F.desc_nulls_last("key"), "vec_id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k)


@pytest.mark.parametrize("block", [7, 16_384])
@pytest.mark.parametrize("skip_self", [True, False])
def test_nearest_is_all_pairs(spark, monkeypatch, block, skip_self):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "TASK_PAIRS", 900 if block == 7 else 1 << 31)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:180] = x[3]  # many ties, of a query too
    x[180:240] = rng.integers(-3, 4, (60, 64)) / 16 / 8  # sums that end in 5 at the seventh place
    x[240] = 0
    rows = [(int(i) * 5 - 40, v.tolist()) for i, v in enumerate(x)]
    rows[12] = (rows[12][0], None)
    rows[7] = (rows[7][0], None)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    v = v.withColumn("code", V.sign_code(F.col("embedding"))).localCheckpoint()
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    for k in (5, 320):  # 320: more than there are
        got = V.nearest(v, q, ("whole", "sentence", "semantic"), k, skip_self)
        columns = ["query_id", "strategy", "vec_id", "key", "rank"]
        got, want = (sorted(tuple(r) for r in d.select(columns).fillna(-(10**9), "key").collect()) for d in (got, _all_pairs(v, q, k, skip_self)))
        assert len(got) > 1000 and got == want


def test_searches_make_no_pairs(spark, monkeypatch):
    """No registered search joins all vectors with all queries: such a join is quadratic in rows."""
    from quillon.plans.queries import QUERIES

    for name in ("vec_cosine_topk", "vec_hamming_topk", "rrf_fuse", "fusion_margin", "hit_at_k", "gate_retrieval", "rrf_agreement", "vec_int8_rescore", "source_search"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_row_group_scan_reads_all_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from quillon.plans.queries import QUERIES

    lines = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=100)  # some sixty row groups
    got = QUERIES["row_group_scan"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) == len(lines) and len(got) == 10


def test_probe_joins_no_more_than_the_cap_of_a_list(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(i, i // 2, 0 if i % 10 else 1, int(i * 7919 % 251)) for i in range(400)], "vec_id long, parent long, list_id int, code long")
    q = spark.createDataFrame([(i, x[i].tolist(), i) for i in range(5)], "query_id long, embedding array<double>, code long")
    c = spark.createDataFrame([(i, x[-1 - i].tolist()) for i in range(2)], "list_id int, centroid array<double>")
    found = V.probe(v, q, c, 2, 10, cap=64, bits=8)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.dist))
    for n in range(5):
        near = sorted(range(2), key=lambda i: (-round(float(x[n] @ x[-1 - i]), 6), i))
        rows = sorted((near.index(0 if i % 10 else 1), i) for i in range(400))[:64]
        rows = sorted((bin(i * 7919 % 251 ^ n).count("1"), at, i) for at, i in rows)[:40]
        kept, seen = [], set()
        for dist, _, i in rows:
            if i // 2 not in seen:
                seen.add(i // 2)
                kept.append((i, dist))
        assert sorted(got[n]) == sorted(kept[:10])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [list_id" in plan  # a list is cut before it is joined


def test_scripts_and_headings_against_plain_rules(spark):
    import random
    import re

    from quillon.functions import constants as K
    from quillon.functions import text as T

    rng = random.Random(4)
    pool = "abzAZ 09.,-[`{~\u00e9\u0928\u0915\u0995\u0A15\u0627\u0D15\u1680"
    texts = [None, "", " ", "\u00e9", "12.", *("".join(rng.choices(rng.sample(pool, 5), k=rng.randrange(1, 24))) for _ in range(600))]

    def most(text, ranges, least, none):
        n, at = max((len(re.findall(f"[{r}]", text or "")), -i) for i, (_, r) in enumerate(ranges))
        return ranges[-at][0] if n >= least else none

    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    c = d.select("id", T.dominant_script("text").alias("s"), T.script_language("text").alias("l"), T.strip("text").alias("t"))
    space = "[\\s\\p{Z}\\x1c-\\x1f\\x85]+"
    c = c.join(d.select("id", F.regexp_replace("text", f"^{space}|{space}$", "").alias("by_rule")), "id")
    for r in c.collect():
        assert (r.s, r.l) == (most(texts[r.id], K.SCRIPTS, 1, "unknown"), most(texts[r.id], K.SPOKEN, 3, "en")) and r.t == r.by_rule
    # every character that the rule takes for white space, and no other
    all_of = spark.range(1, 0x3100).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("x"))
    assert all_of.where((T.strip("x") == "") != F.col("x").rlike(f"^{space}$")).count() == 0
    plan = lambda name: __import__("quillon.plans.queries").plans.queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("txt_heading").count("#{1,6}") == 1  # a line is judged once
    assert "regexp_count" not in plan("txt_script") and "regexpcount" not in plan("txt_script").lower()


def test_plain_texts_and_pages_stay_out_of_python(spark):
    """NFC and numbered entities: what they make of odd texts, and no text of a page or of Latin letters sent to a worker."""
    import re
    import unicodedata

    from quillon.functions import text as T
    from quillon.sources import web

    texts = ["", None, "caf\u00e9", "cafe\u0301", "\u1100\u1161", "\u212b", "\u0928\u093c", "a\u0323\u0302", "\u2126 plain", "\U0001d15e"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in d.select("text", T.nfc("text").alias("n")).collect():
        assert r.n == (None if r.text is None else unicodedata.normalize("NFC", r.text))
    below = "".join(map(chr, range(0x300)))
    assert all(unicodedata.normalize("NFC", a + b) == a + b for a in below[::7] for b in below)

    def plain(x):
        def one(m):
            code = int(m[1], 10) if m[1] else int(m[2], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""

        return re.sub(r"&#(\d+);|&#[xX]([0-9a-fA-F]+);", one, x)

    pages = ["", "&#", "&#;", "&#x;", "&#38;#60;", "a&#65;b&#x42;c", "&#0;&#00065;", "&#xD800;&#55296;", "&#1114111;&#1114112;", "&#x10FFFF;&#X110000;", "&#99999999999999999999999;x", "&#xfffffffffffffffffffffff;", "&#65279;z&#xFEFF;", "&#2325;&#128512;", "&#12", "x&#13;&#10;"]
    p = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = p.select("html", web._decoded(F.col("html")).alias("t"))
    for r in got.collect():
        assert r.t == plain(r.html), r.html
    assert "ArrowEvalPython" not in p.select(web.html_text("html"))._jdf.queryExecution().executedPlan().toString()


def test_bm25_reads_the_passages_once(spark):
    """What is stored gives lengths and frequencies: the plan that ranks reads no text again. Passages with one id count apart."""
    from quillon.operators import lexical
    from quillon.plans.queries import QUERIES

    for name in ("bm25_topk", "source_bm25", "source_union"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan, name
    d = spark.createDataFrame([(1, "red fox"), (1, "blue fox"), (2, "green tree"), (3, None), (4, "")], "id long, text string").fillna("", "text")
    met, terms = lexical.met_postings(d, spark.createDataFrame([(7, "fox")], "q long, text string"), "id", "text", "q", "text")
    hits = lexical.scored_postings(met, terms).collect()
    assert [(h.query_id, h.id) for h in hits] == [(7, 1)]
    assert met.where("term = ''").selectExpr("sum(tf)").first()[0] == 5


@pytest.mark.parametrize("block", [7, 100_000])
def test_shards_in_blocks_are_a_plain_fold(spark, monkeypatch, block):
    """Texts of one group in many blocks, small and large ones, null groups and repeated ids; no row holds a group's texts."""
    from quillon.sources import files

    monkeypatch.setattr(files, "SHARD_BLOCK", block)
    rng = random.Random(18)
    rows = [(i // 2 if i % 9 == 0 else i, rng.choice(["", "é" * rng.randrange(40), "x" * rng.randrange(9), "y" * 120, None]), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [(1000 + i, "", "tiny") for i in range(60)] + [(2000, "z", "one")]
    out = files.text_shards(spark.createDataFrame(rows, "doc long, text string, source string"), "doc", "text", "source", 100)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, state = [], {}
    for doc, n, source in sorted((d, len(t.encode()) + 8, s or "") for d, t, s in rows if t is not None):
        shard, held = state.get(source, (0, 0))
        want.append((source, doc, shard))
        state[source] = (shard + 1, 0) if held + n >= 100 else (shard, held + n)
    assert sorted((r["source"] or "", r["id"], r["shard"]) for r in out.collect()) == sorted(want)


def test_shard_check_folds_no_source_in_one_row(spark):
    from quillon.plans.sources import shard_check

    out = shard_check(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert all(r["complete"] for r in out.collect())


def test_shard_check_deals_one_source_over_blocks(spark, monkeypatch, tmp_path):
    """All texts in one source, some null, some without a source: no block holds much more than its share, and all are counted."""
    from quillon.plans.sources import shard_check
    from quillon.sources import files

    kept, stored = {}, files.stored
    monkeypatch.setattr(files, "SHARD_BLOCK", 100)
    monkeypatch.setattr(files, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    docs = spark.range(2000).selectExpr("id as doc_id", "case when id % 50 != 0 then repeat('x', int(id % 997) * 9) end as text", "case when id % 70 != 0 then 'one' end as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = shard_check(spark, str(tmp_path)).collect()
    want = docs.where("text is not null and source is not null").count()
    assert [tuple(r) for r in out] == [("one", want, want, True)]
    sizes = [r["count"] for r in kept["blocks"].groupBy("source", "part").count().collect()]
    assert sum(sizes) == docs.where("text is not null").count()
    assert max(sizes) < 300, sizes


def test_postings_are_shuffled_once(spark):
    """Rows of one id are one passage, counts stop at 255, and the only shuffle by a key is that of the postings by term."""
    from quillon.operators import lexical

    d = spark.createDataFrame([(1, "fox fox owl"), (1, "fox"), (2, "owl " * 300), (3, ""), (4, None), (5, "the of and"), (6, "ant"), (7, "owl")], "id long, text string")
    posts = lexical.dealt_postings(d, "id", "text")
    assert sorted(tuple(r) for r in posts.collect()) == sorted([(1, "fox", 3), (1, "owl", 1), (2, "owl", 255), (7, "owl", 1), (5, "the", 1), (5, "of", 1), (5, "and", 1), (6, "ant", 1)])
    out = lexical.sorted_postings(posts, lexical.stats(d.select("id", F.lit(1).alias("len")))).groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("tf"))
    assert sorted(tuple(r) for r in out.collect()) == sorted([("fox", 1, 3), ("the", 1, 1), ("of", 1, 1), ("and", 1, 1), ("ant", 1, 1)])  # owl: 3 of 8 are more than 2
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning") == 1, plan
