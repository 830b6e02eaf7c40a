"""Document fingerprints by improbable features, held in chained Bloom filters.

A feature is a window of 64 bytes. Its entropy level is rare if few windows of all documents have it; in every 64
consecutive windows the rarest, then leftmost, gets a vote, and windows with VOTES or more are the document's features; where
none has so many, those with most are.
Their hashes go in order into Bloom filters of 2048 bits, a new one after 128 features. Two fingerprints are as like as the
filters of the shorter chain match, on average, their best counterpart: shared bits, less those expected by chance, as a
share of the most that could be shared.

Order over all documents is by ranges of doc_id: a range's first text is also sent to the range before it, so neighbours
meet without a global window and the text is shuffled once.

Defined results: null text counts as empty; empty text has no features and an empty fingerprint, which is like an equal
one only; text shorter than a window is one feature; of windows as rare the leftmost gets the vote; a text is read in blocks
of 256 KiB, and windows across their edges are no features, the same for equal texts; null doc_ids come last, by text; repeated rows follow each other, by
text; an empty table gives an empty result; extra columns never matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, partitions
from quillon.llm.textkit import blocks, pieces, raw, run_hashes
from quillon.session import table

WIDTH = 64
NEAR = 64
VOTES = 24
BITS = 2048
PER_FILTER = 128
HASHES = 5
LEVELS = 1001
CHANCE = 0.3
_UNIT = 1024
_F = np.rint(np.arange(WIDTH + 2) * np.log2(np.maximum(np.arange(WIDTH + 2), 1)) * _UNIT).astype(np.int64)
_G = np.diff(_F, prepend=0)  # what the c-th copy of a byte adds
_TOP = int(_F[WIDTH])


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 to 1000) of every window of WIDTH bytes of a block, in whole numbers, so wherever it lies."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = (data[order].astype(np.int64) << 32) + order
    rank = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WIDTH, "left") - rank  # copies in the window that starts here
    behind[order] = rank - np.searchsorted(key, key - WIDTH, "right") + 1  # copies in the window that ends here
    change = _G[behind]
    change[WIDTH:] -= _G[ahead[: n - WIDTH]]
    return (_TOP - np.cumsum(change)[WIDTH - 1 :]) * (LEVELS - 1) // _TOP


def _inside(starts: np.ndarray, size: int, span: int) -> np.ndarray:
    """Which of ``size - span + 1`` windows lie within one document; ``starts``: where documents begin (0 first)."""
    doc = np.zeros(size, np.int64)
    np.add.at(doc, starts[(starts > 0) & (starts < size)], 1)
    doc = np.cumsum(doc)
    return doc[: size - span + 1] == doc[span - 1 :]


def histogram(column: pa.Array) -> np.ndarray:
    """Windows of whole documents by entropy level."""
    data, offsets = raw(column)
    out = np.zeros(LEVELS, np.int64)
    for a, b in blocks(data, offsets):
        level = levels(data[a:b])
        if len(level):
            lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "left")
            out += np.bincount(level[_inside(offsets[lo:hi] - a, b - a, WIDTH)], minlength=LEVELS)
    return out


def features(column: pa.Array, rarity: np.ndarray) -> list[np.ndarray]:
    """The hashes of each document's features, in order. ``rarity``: rank of each entropy level, 0 for the rarest."""
    data, offsets = raw(column)
    found: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    spare: dict[int, tuple[int, list[np.ndarray]]] = {}  # where no window has VOTES yet: the most votes, and whose they are
    for a, b in blocks(data, offsets):
        block = data[a:b]
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        edges = np.clip(offsets[first : last + 1] - a, 0, b - a)
        n = len(block) - WIDTH + 1
        if n > 0:
            whole = _inside(edges, len(block), WIDTH)
            key = np.where(whole, (rarity[levels(block)] << 32) + np.arange(n), np.int64(1) << 62)
            picked = np.zeros(0, np.int64)
            if n >= NEAR:
                least, have = key, 1
                while have < NEAR:
                    least = np.minimum(least[:-have], least[have:])
                    have *= 2
                bounded = np.concatenate([[0], np.cumsum(~whole)])
                ok = bounded[NEAR:] == bounded[: n - NEAR + 1]
                votes = np.bincount((least[ok] & 0xFFFFFFFF), minlength=n)
                picked = np.flatnonzero(votes >= VOTES)
            few = []  # documents with fewer than NEAR windows vote once
            sizes = np.diff(edges)
            for i in np.flatnonzero((sizes >= WIDTH) & (sizes < WIDTH + NEAR - 1)).tolist():
                few.append(int(key[edges[i] : edges[i + 1] - WIDTH + 1].min()) & 0xFFFFFFFF)
            picked = np.union1d(picked, np.array(few, np.int64)).astype(np.int64)
            cut = np.searchsorted(picked, edges)
            below = []
            for i in np.flatnonzero((np.diff(cut) == 0) & (sizes >= WIDTH + NEAR - 1)).tolist():
                own = votes[edges[i] : edges[i + 1] - WIDTH + 1]
                below.append((first + i, int(own.max()), np.flatnonzero(own == own.max()) + edges[i]))
            at = np.concatenate([picked, *(x[2] for x in below)])
            h = run_hashes(block, at, at + WIDTH)
            for i in np.flatnonzero(np.diff(cut)).tolist():
                found[first + i].append(h[cut[i] : cut[i + 1]])
            done = len(picked)
            for i, most, own in below:  # a long text may have parts in several blocks
                had, parts = spare.get(i, (0, []))
                if most >= had:
                    spare[i] = (most, [*(parts if most == had else []), h[done : done + len(own)]])
                done += len(own)
    short = np.diff(offsets)
    out = []
    for i, parts in enumerate(found):
        if not parts and i in spare:
            parts = spare[i][1]
        if 0 < short[i] < WIDTH:
            body = data[offsets[i] : offsets[i + 1]]
            parts = [run_hashes(body, np.array([0]), np.array([len(body)]))]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (count x BITS/8 bytes) of a document's features."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    bits = np.zeros((int(row[-1]) + 1, BITS), bool)
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def to_text(chain: np.ndarray) -> str:
    return ":".join(base64.b64encode(f.tobytes()).decode() for f in chain)


def from_text(text: str) -> np.ndarray:
    return np.array([np.frombuffer(base64.b64decode(f), np.uint8) for f in text.split(":")]) if text else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much of the shorter chain the other holds."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    in_b = np.bitwise_count(y).sum(axis=1).astype(float)
    total = 0.0
    for f in x:
        own = float(np.bitwise_count(f).sum())
        shared = np.bitwise_count(y & f).sum(axis=1)
        most = np.minimum(own, in_b)
        chance = own * in_b / BITS
        floor = chance + CHANCE * (most - chance)
        total += float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(x)


def fit_rarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level by the number of windows of all documents that have it, fewest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += histogram(piece.column(0))
        yield pa.record_batch([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "windows"])

    rows = doc_columns(docs, text_col).toDF("text").mapInArrow(count, "level long, windows long").groupBy("level").agg(F.sum("windows").alias("n")).collect()  # LEVELS rows
    n = np.zeros(LEVELS, np.int64)
    for r in rows:
        n[r["level"]] = r["n"]
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return rank


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) by ranges of doc_id, sorted, each range followed by the first row of the next (``ghost``)."""
    spark = docs.sparkSession
    n = partitions(spark)
    probabilities = [i / n for i in range(1, n)]
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", probabilities, 0.2 / n)}) if n > 1 else []
    part = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    placed = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(part).cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in placed.where("doc_id is not null").groupBy("part").agg(F.min("doc_id").alias("first")).collect())  # a row a range
    placed = placed.withColumn("ghost", F.lit(False))
    if firsts:
        # rows with null doc_id are after the last range's others, also where that range has no others
        home = [p for p, _ in firsts]
        if not docs.where("doc_id is null").isEmpty() and home[-1] != len(bounds):
            home.append(len(bounds))
        before = {first: home[i - 1] for i, (_, first) in enumerate(firsts)}
        target = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("doc_id"))
        ghosts = docs.where(F.col("doc_id").isin(list(before))).withColumn("part", target.cast("int")).withColumn("ghost", F.lit(True))
        placed = placed.union(ghosts)
    dealt = placed.repartitionById(len(bounds) + 1, "part") if hasattr(placed, "repartitionById") else placed.repartition(len(bounds) + 1, "part")
    return dealt.sortWithinPartitions("part", "ghost", F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def fingerprints(docs: DataFrame, rarity: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row: where it lies, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                yield pa.record_batch([piece.column(0), pa.array([to_text(filters(h)) for h in features(piece.column(1), rarity)])], names=["doc_id", "fingerprint"])

    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return read.mapInArrow(run, "doc_id long, fingerprint string")


def compare_neighbours(docs: DataFrame, rarity: np.ndarray, most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text (its last quarter replaced by the next document's start) and the next one."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(rows: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
        """Rows of one range in order; the last is only the next of the one before."""
        edited = []
        for (_, text), (_, after) in zip(rows[:-1], rows[1:], strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        own = [filters(h) for h in features(pa.array([t for _, t in rows], pa.large_string()), rarity)]
        theirs = [filters(h) for h in features(pa.array(edited, pa.large_string()), rarity)]
        out = [
            (doc_id, len(text), hashlib.sha256(edited[i].encode()).hexdigest(), to_text(own[i]), to_text(theirs[i]), likeness(own[i], theirs[i]), likeness(own[i], own[i + 1]))
            for i, (doc_id, text) in enumerate(rows[:-1])
        ]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, first, closed = [], 0, None, None, True

        def close(after: tuple | None) -> Iterator[pa.RecordBatch]:
            if held:
                yield from work([*held, after or first])

        for batch in batches:
            for doc_id, text, part, ghost in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = (doc_id, text or "")
                if part != now:
                    if not closed:
                        yield from close(None)
                    held, size, now, first, closed = [], 0, part, row, False
                if ghost:
                    if not closed:  # of repeated rows only the first is the next
                        yield from close(row)
                        closed = True
                    continue
                held.append(row)
                size += len(row[1])
                if size > most and len(held) > 1:
                    yield from work(held)
                    held, size = [row], len(row[1])
        if not closed:
            yield from close(None)

    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(read).select("doc_id", "text", "part", "ghost").mapInArrow(run, ddl)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_neighbours(docs, fit_rarity(docs))
