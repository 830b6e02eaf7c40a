"""How much retrieval fits in the time that is left: full, else the first rung that can be paid for, else the floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values in ms: held back, and cost of the tail, the lexical pass, 1000 user chunks, a search, a list, a rescored hit.
RESERVE, TAIL, LEXICAL, USER, SEARCH, LIST, RESCORE = 8, 0.6, 0.15, 0.014, 0.9, 0.04, 0.002
#: Fixed values: (lists, hits a strategy, rescored, candidates); None is what the full plan has.
RUNGS = ((12, None, None, 3072), (8, None, None, 3072), (6, 18, 16, 3072), (4, 14, 12, 2048), (3, 10, 10, 2048), (2, 8, 8, 1536), (1, 6, 6, 1024))
FLOOR = (1, 6, 4, 1024)
FIELDS = ("lists", "hits", "rescored", "candidates")


def plan(remaining: Column, user_chunks: Column, full: tuple[int, int, int, int]) -> Column:
    """struct<lists, hits, rescored, candidates, degraded>; a null time gets the floor."""
    left = remaining - RESERVE - TAIL - LEXICAL - user_chunks / 1000 * USER
    made = lambda p, degraded: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(FIELDS, p, strict=True)], F.lit(degraded).alias("degraded"))
    out = made(FLOOR, True)
    for rung in reversed((full, *RUNGS)):
        p = tuple(f if v is None else v for v, f in zip(rung, full, strict=True))
        out = F.when(left >= SEARCH + p[0] * LIST + p[2] * RESCORE, made(p, rung is not full)).otherwise(out)
    return out
