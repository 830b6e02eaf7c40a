"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillon.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        order = [c for c in columns if got[c].dtype.kind != "f"]
        got, want = (x[columns].sort_values(order, ignore_index=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_topic_segments_against_a_plain_fold(spark):
    import random
    import re

    from quillon.operators.chunking import by_topic

    rng = random.Random(3)
    pools = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    texts = [None, "", "one.", "a. b. c.", *("  ".join(" ".join(rng.choices(rng.choice(pools), k=rng.randrange(1, 16))) + rng.choice(".!?।") for _ in range(rng.randrange(1, 14))) for _ in range(300))]
    want = []
    for n, text in enumerate(texts):
        spans, at = [], 0
        for p in filter(None, re.split(r"(?<=[।.!?])\s+", text or "")):
            at = text.index(p, at)
            spans.append((at, at + len(p)))
            at += len(p)
        groups = []
        for s, e in spans:
            words = set(text[s:e].split())
            if groups and (sum(b - a for a, b in groups[-1]) < 90 or len(words & last) / len(words | last) >= 0.08):
                groups[-1].append((s, e))
            else:
                groups.append([(s, e)])
            last = words
        kept = [(n, k, text[g[0][0] : g[-1][1]].strip()) for k, g in enumerate(groups)]
        kept = [x for x in kept if len(x[2]) >= 90]
        want += kept if len(spans) >= 3 and len(kept) >= 2 else []
    got = by_topic(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    assert len(want) > 100
    assert sorted(map(tuple, got)) == want
