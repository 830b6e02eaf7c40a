"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives every shingle correlated ranks: at step j it draws the next slot of its own permutation with rank
j + r, so later steps can only raise a slot and a document stops as soon as no slot is above the step. Only one document
of those with equal shingle sets goes on. In a bucket all documents are first compared to one leader, not to each other;
leaders differ from band to band. Then, only in buckets that still hold more than one component, the pairs that would join
two components are compared, in blocks of bounded size and by their signatures first. Every link is confirmed on the full
sets; a block with more candidates than rows confirms them itself and gives a spanning forest of its links. No group is collected anywhere, and its pairs are never all emitted.

Sets are compared as sets of 64-bit shingle hashes.

Defined results: no words or no text gives an empty set, linked with nothing; null doc_ids are linked with nothing and
have no component; rows that repeat a doc_id and its text are one document; rows that repeat a doc_id with other texts are
documents of their own, each with its own links; a tie at the threshold is a link; of a component the smallest doc_id
names it; texts of any length are read whole, a piece at a time; an empty table gives an empty result; extra columns never
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import doc_columns, drop, own_name, text_key, written
from quillon.llm.textkit import mix, pieces, shingle_hashes, word_hashes
from quillon.session import table

BANDS, ROWS = 40, 5
#: Documents of one side of a block of pairs, and how far below the threshold a signature may lie (over five deviations).
SIDE = 1024
SLACK = 0.16
_BLOCK = ["bucket", "side", "p", "q"]
_STEP = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _times(n: int) -> np.uint64:
    return np.uint64(n * _STEP & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each document, sorted within it; first index of each document, n+1)."""
    words, first = word_hashes(column, lower)
    hashes, doc = shingle_hashes(words, first, k)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence is the one shingle
        whole = [mix(np.array([np.sum(words[first[i] : first[i + 1]] * mix(np.arange(1, counts[i] + 1, dtype=np.uint64)))], np.uint64) + np.uint64(counts[i]))[0] for i in short.tolist()]
        hashes, doc = np.append(hashes, np.array(whole, np.uint64)), np.append(doc, short)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(first)), "left")


def superminhash(hashes: np.ndarray, first: np.ndarray, m: int, together: int = 40_000) -> np.ndarray:
    """Signatures (documents x m, uint64: step << 40 | random bits) of shingle sets."""
    out = np.full((len(first) - 1, m), _NONE)
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + together, "right")) - 1)
        _signatures(hashes[first[at] : first[to]], np.repeat(np.arange(to - at), np.diff(first[at : to + 1])), out[at:to], m)
        at = to
    return out


def _signatures(h: np.ndarray, doc: np.ndarray, out: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    perm = None
    for j in range(m):
        if not len(h):
            return
        r = mix(h + _times(j + 1))
        pick = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
        rows = np.arange(len(h))
        slot = pick if perm is None else perm[rows, pick].astype(np.int64)
        np.minimum.at(flat, doc * m + slot, (np.uint64(j) << np.uint64(40)) | (r >> np.uint64(24)))
        going = out.max(axis=1) >= np.uint64(j + 1) << np.uint64(40)
        keep = going[doc]
        if j == 0:
            h, doc, pick = h[keep], doc[keep], pick[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), pick] = 0  # position j is never read again
        else:
            perm[rows, pick] = perm[rows, j]
            if not keep.all():
                h, doc, perm = h[keep], doc[keep], perm[keep]


def _band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        out = mix(out + signatures[:, r::rows][:, :bands] + np.uint64(r + 1))
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP))


def _set_ids(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits that equal sets share, whatever their order."""
    sums = []
    for salt in (1, 2):
        c = np.append(np.uint64(0), np.cumsum(mix(hashes + _times(salt)), dtype=np.uint64))
        sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
    return sums


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = shingle_sets(piece.column(1), k)
                s = superminhash(h, first, bands * rows)
                low = np.ascontiguousarray((mix(s) & np.uint64(255)).astype(np.uint8))
                a, b = _set_ids(h, first)
                edges = pa.array(np.arange(len(first)) * bands, pa.int32())
                yield pa.record_batch(
                    [piece.column(0), piece.column(2), pa.array(rid + np.arange(len(first) - 1)), pa.array(np.diff(first)), pa.array(a), pa.array(b), pa.ListArray.from_arrays(edges, pa.array(_band_hashes(s, bands, rows).view(np.int64).reshape(-1))), pa.array([x.tobytes() for x in low], pa.binary())],
                    names=["doc_id", "text_key", "node", "n", "a", "b", "bands", "sig"],
                )
                rid += len(first) - 1

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                h, first = shingle_sets(piece.column(1), k)
                a, b = _set_ids(h, first)
                yield pa.record_batch([piece.column(0), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], names=["doc_id", "a", "b", "items"])

    return run


def _forest_edges(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a spanning forest of the links (u, v): fewer than there are documents."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


def _sides(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, is_left: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, which of their pairs may be links that would join two components) of a block."""
    left = np.flatnonzero(is_left)
    right = np.flatnonzero(~is_left) if not is_left.all() else left
    ok = np.zeros((len(left), len(right)), bool)
    for k, i in enumerate(left.tolist()):
        alike = (comp[right] != comp[i]) & (np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i]))
        at = np.flatnonzero(alike)
        if len(at):
            ok[k, at] = (sig[right[at]] == sig[i]).mean(axis=1) >= threshold - slack
    return left, right, ok


def _signs(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1), *(pdf[c].to_numpy() for c in ("component", "n", "is_left"))


def _block_pairs(threshold: float, slack: float):
    """The candidate pairs of a block, or, where they outnumber its rows, one row without a pair that names the block.

    Blocks come one after the other in a partition; only the one that a batch cuts is held over to the next.
    """

    def of(pdf: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        arrays, doc = _signs(pdf), pdf["node"].to_numpy()
        us, vs, at, crowded = [], [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            left, right, ok = _sides(*(x[a:b] for x in arrays), threshold, slack)
            i, j = np.nonzero(ok)
            if len(i) > b - a:
                crowded.append(a)
            elif len(i):
                x, y = doc[a:b][left[i]], doc[a:b][right[j]]
                us.append(np.minimum(x, y))
                vs.append(np.maximum(x, y))
                at.append(np.full(len(i), a))
        blocks = pdf[_BLOCK].iloc[np.concatenate([*at, np.array(crowded, int)]).astype(int)].reset_index(drop=True)
        pair = lambda x: pd.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype("int64").tolist() + [pd.NA] * len(crowded), "Int64")
        return blocks.assign(u=pair(us), v=pair(vs))[["u", "v", *_BLOCK]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = np.zeros(len(pdf), bool)
            for c in _BLOCK:
                x = pdf[c].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            if len(cuts) > 1:
                yield of(pdf, cuts)
            held = pdf.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield of(held.reset_index(drop=True), [0, len(held)])

    return run


def _block_links(percent: int, slack: float, columns: int = 8192):
    """A spanning forest of a block's links, confirmed on full sets by counting common shingles of all its pairs at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, ok = _sides(*_signs(pdf), percent / 100, slack)
        doc, n = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        row = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["items"]])
        items, at, times = np.unique(np.concatenate(pdf["items"].to_list()), return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        wide = times[at] > 1  # a shingle of one document is common to no pair
        row, at = row[wide], at[wide]
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(items), columns):
            a, b = np.searchsorted(at, (lo, lo + columns))
            has = np.zeros((len(pdf), columns), np.float32)
            has[row[a:b], at[a:b] - lo] = 1
            common += has[left] @ has[right].T
        union = n[left][:, None] + n[right][None, :] - common
        i, j = np.nonzero(ok & (100 * common.astype(np.int64) >= percent * union.astype(np.int64)))
        return pd.DataFrame(_forest_edges(doc[left[i]], doc[right[j]]), columns=["u", "v"], dtype="int64")

    return run


def near_groups(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_key (of its text).

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``k``-word shingles (A-Z folded).
    With bands * rows = 200 slots, a pair at 0.8 shares no bucket with a chance of about 1e-7, one at 0.85 of 1e-10.
    A node of the links is a class of equal sets; it goes by the row number of one of its rows, never by a doc_id.
    """
    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = read.withColumn("text_key", text_key("text")).mapInArrow(_sketch(k, bands, rows), "doc_id long, text_key long, node long, n long, a long, b long, bands array<long>, sig binary")
    sketches = written(sketched, "sketch")
    some = sketches.where("n > 0 and doc_id is not null")
    classes = some.groupBy("a", "b", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"))
    reps = written(some.join(classes.select("node"), "node", "left_semi"), "reps")

    in_bands = reps.select("node", "n", F.explode("bands").alias("bucket"))
    lead = F.min(F.struct(F.xxhash64("node", "bucket").alias("by"), "node", "n")).alias("lead")
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("rows"), lead).where("rows > 1").select("bucket", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n"))
    buckets = written(in_bands.join(shared, "bucket"), "buckets")
    near_size = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    pairs = buckets.where((F.col("node") != F.col("leader")) & near_size).select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()
    pairs = written(pairs, "pairs")

    wanted = reps.select("node", "doc_id", "a", "b").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = read.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(k), "doc_id long, a long, b long, items array<long>").join(wanted, ["doc_id", "a", "b"])
    sets = written(sets.select("node", "items").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("y")), "v")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("u", "v")

    edges = written(confirmed(pairs), "edges")
    label = components(edges)
    rows = _open_blocks(buckets, reps, label)
    found = written(rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInPandas(_block_pairs(percent / 100, SLACK), "u long, v long, bucket long, side string, p int, q int"), "open")
    rest = found.where("u is not null").select("u", "v").distinct().join(pairs, ["u", "v"], "left_anti")
    crowded = rows.join(found.where("u is null").select(*_BLOCK), _BLOCK, "left_semi").join(sets, "node")
    more = written(confirmed(rest).union(crowded.groupBy(*_BLOCK).applyInPandas(_block_links(percent, SLACK), "u long, v long")), "edges")
    if not more.isEmpty():
        label = components(edges.union(more))

    joined = classes.join(label, "node", "left").select("a", "b", "n", "least", F.coalesce("component", "node").alias("component"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = written(joined.join(names, "component").select("a", "b", "n", "component_id"), "groups")
    for table_ in (reps, buckets, pairs, sets, found, more, edges):
        drop(table_)
    out = sketches.select("doc_id", "text_key", "n", "a", "b").join(grouped, ["a", "b", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")


def _open_blocks(buckets: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of every block of pairs of a common bucket and of different components.

    In a bucket, rows of the leader's component are the major ones. Minor rows meet major ones and each other in blocks of
    about SIDE by SIDE; major rows never meet. A row is in as many blocks as the other side has, usually one.
    """
    own = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = own.where("node = leader").select("bucket", F.col("component").alias("main")).distinct()
    minor = F.col("component") != F.col("main")
    own = own.join(heads, "bucket").withColumn("minor", minor)
    sizes = own.groupBy("bucket").agg(F.count_if("minor").alias("minors"), F.count_if(~F.col("minor")).alias("majors")).where("minors > 0")
    blocks = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    own = own.join(sizes, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), blocks("minors")).otherwise(blocks("majors"))).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), blocks("majors")).otherwise(blocks("minors")) - 1)))
    cross = own.select("bucket", F.lit("across").alias("side"), F.when(F.col("minor"), F.col("mine")).otherwise(F.col("other")).alias("p"), F.when(F.col("minor"), F.col("other")).otherwise(F.col("mine")).alias("q"), "node", "component", "n", F.col("minor").alias("is_left"))
    among = own.where("minor and other = 0 and minors > 1").withColumn("other", F.explode(F.sequence(F.lit(0), blocks("minors") - 1)))
    among = among.select("bucket", F.lit("among").alias("side"), F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "node", "component", "n", (F.col("mine") <= F.col("other")).alias("is_left"))
    return cross.union(among).join(reps.select("node", "sig"), "node")


def near_dedup(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays from each near-duplicate group, all their columns unchanged.

    Rows that repeat the smallest doc_id of a group all stay.
    """
    key, text = own_name(docs, "gone_id"), own_name(docs, "gone_text")
    gone = near_groups(docs, percent, k, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias(key), F.col("text_key").alias(text))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (text_key(text_col) == F.col(text))
    return docs.join(gone, same, "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 85).drop("text_key")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) < 5 THEN range(1, least(len(w), 1) + 1) ELSE range(1, len(w) - 3) END) AS p FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
