"""Substring deduplication with suffix automata of reference shards and matching statistics.

A word of a document goes if a window of WINDOW words that covers it also starts in a document with a smaller doc_id.

To send every shard past every document would cost the square of the corpus, so shards are met only where they can match:
the least hash of the 7-word runs in a window, its anchor, is the same wherever the window occurs. Anchors that occur in
one document only are dropped. What is left are short segments of text around shared anchors. Segments that are equal (128
bits) are one, and its words are cut once, from the text of its first document, and only where its anchor has others beside
it. They are dealt by anchor, each shard builds suffix automata of bounded size over its segments, in ascending doc_id, and
streams all its segments through them; the matching statistics give the smallest document of every window. The documents
find a segment's result by a join that skew handling can split. A segment alone at its anchor has nothing else to match, so
its smallest document is the answer without an automaton. An anchor with more segments than an automaton may hold gets
several automata, and every one of its segments is streamed through each.

Anchors go to their shards packed, a row for each bucket of a task's anchors; an anchor that several documents of one task
have is known to be shared, so it is sent once for the task and not for each document. Automata compare the words' bytes;
anchors, segments and rows go by hashes of 64 or 128 bits.

Defined results: null or empty text has no words; rows with null doc_id are neither earlier nor later than others, so they
keep all words and remove none; rows that repeat a doc_id remove nothing from each other, and each is judged by its own
text; texts of any length are read whole, a piece at a time; an empty table gives an empty result; extra columns never
matter.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, drop, partitions, release, text_key, written
from quillon.llm.textkit import mix, pieces, shingle_hashes, word_hashes
from quillon.session import table

WINDOW = 13
ANCHOR = 7
#: Windows of one segment, words of one automaton.
SEGMENT = 32
SHARD_WORDS = 120_000
#: Pairs of an anchor and a row that a task packs together.
TOGETHER = 300_000


class SuffixAutomaton:
    """Of many sequences, added in ascending order of owner: each state keeps the first, so smallest, owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [0]

    def _state(self, length: int, nxt: dict, link: int, owner: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _clone(self, p: int, c, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.owner[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list, owner: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            p, last = last, self._state(self.length[last] + 1, {}, 0, owner)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)

    def owners(self, sequence: list, window: int, none: int) -> list[int]:
        """The smallest owner of each window of ``sequence``, ``none`` where the automaton has no such window."""
        at = matched = 0
        out = []
        for i, c in enumerate(sequence):
            while at and c not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if c in self.next[at]:
                at = self.next[at][c]
                matched += 1
            while at and self.length[self.link[at]] >= window:
                at = self.link[at]
                matched = self.length[at]
            if i >= window - 1:
                out.append(self.owner[at] if matched >= window else none)
        return out


def _anchors(words: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first word) of every window of whole documents."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, _ = shingle_hashes(words, np.array([0, len(words)]), k)
    span, least, have = window - k + 1, grams, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(grams) - span + 1], least[span - have :][: len(grams) - span + 1])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return mix(least[ok]), doc[ok], ok  # least hashes are small ones; mixed, they are spread evenly


_PACKED = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("rows", pa.binary()), ("known", pa.binary())])


def _scan(window: int, k: int, buckets: int, together: int):
    """(text, row) to packed (anchor, row) pairs, dealt by anchor.

    ``known`` is 0 for an anchor that one row here has, 1 for one that more have; the pairs of the latter follow, marked 2,
    in any bucket, as they need no one else to be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn
            anchor, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            anchor, row = _distinct(anchor, row)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            many = np.diff(np.append(first, len(anchor))) > 1
            of_many = np.repeat(many, np.diff(np.append(first, len(anchor))))
            one, of_one = anchor[first], row[first]
            cuts = np.searchsorted(one, (np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)))
            parts = [(b, one[x:y], of_one[x:y], many[x:y].astype(np.uint8)) for b, (x, y) in enumerate(zip(cuts, np.append(cuts[1:], len(first)), strict=True)) if x < y]
            anchor, row = anchor[of_many], row[of_many]
            step = max(1000, -(-len(anchor) // buckets))
            for x in range(0, len(anchor), step):
                turn += 1
                part = anchor[x : x + step]
                parts.append((turn % buckets, part, row[x : x + step], np.full(len(part), 2, np.uint8)))
            for x in range(0, len(parts), 64):
                some = parts[x : x + 64]
                yield pa.record_batch([pa.array([p[0] for p in some], pa.int32()), *(pa.array([p[k].tobytes() for p in some], pa.binary()) for k in (1, 2, 3))], schema=_PACKED)

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                words, first = word_hashes(piece.column(0))
                anchor, doc, _ = _anchors(words, first, window, k)
                if len(anchor):
                    change = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
                    held.append((anchor[change], piece.column(1).to_numpy()[doc[change]]))
                    size += len(held[-1][0])
                if size >= together:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _distinct(anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((row, anchor))
    anchor, row = anchor[order], row[order]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))[: len(anchor)]
    return anchor[new], row[new]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs in the order of their buckets to (row, anchor) of the anchors that more than one row has."""

    def pairs(row: np.ndarray, anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(row), 50_000):
            yield pa.record_batch([pa.array(row[x : x + 50_000]), pa.array(anchor[x : x + 50_000].view(np.int64))], names=["row", "anchor"])

    def close(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchor, row, known = (np.concatenate(x) for x in zip(*held, strict=True))
        sure = np.unique(anchor[known == 1])
        lone = known == 0
        asked, asking = _distinct(anchor[lone], row[lone])
        first = np.append(True, asked[1:] != asked[:-1])[: len(asked)]
        number = np.cumsum(first) - 1
        met = np.bincount(number, minlength=1)[number] > 1 if len(asked) else np.zeros(0, bool)
        good = met | np.isin(asked, sure)
        yield from pairs(asking[good], asked[good])

    now, held = None, []
    for batch in batches:
        for bucket, *body in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
            anchor, row, known = (np.frombuffer(x.as_buffer(), t) for x, t in zip(body, (np.uint64, np.int64, np.uint8), strict=True))
            if len(known) and known[0] == 2:
                yield from pairs(row, anchor)
                continue
            if bucket != now and held:
                yield from close(held)
                held = []
            now = bucket
            held.append((anchor, row, known))
    if held:
        yield from close(held)


def _segment_ids(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of ``size`` words from ``begin`` on."""
    a, b = size.astype(np.uint64), mix(size.astype(np.uint64))
    for j in range(int(size.max())):
        live = np.flatnonzero(size > j)
        w = words[begin[live] + j]
        p, q = mix(np.array([2 * j + 1, 2 * j + 2], np.uint64)) | np.uint64(1)
        a[live] += w * p
        b[live] += w * q
    return mix(a).view(np.int64), mix(b).view(np.int64)


_USES = pa.schema([("anchor", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])


def _segments(window: int, k: int):
    """(doc_id, text, row, its shared anchors) to the segments around them: every occurrence, without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words, first = word_hashes(piece.column(1))
                ids, rows = np.asarray(piece.column(0)), np.asarray(piece.column(2))
                shared = piece.column(3)
                anchor, doc, at = _anchors(words, first, window, k)
                # the (document, anchor) pairs that are shared, by one sorted search
                flat = np.asarray(shared.flatten()).view(np.uint64)
                owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(shared.offsets)))
                key = lambda a, d: mix(a + mix(np.asarray(d, np.uint64) + np.uint64(1)))
                good = np.isin(key(anchor, doc), key(flat, owner))
                anchor, doc, at = anchor[good], doc[good], at[good]
                if not len(at):
                    continue
                start = np.ones(len(at), bool)
                start[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                run_at = np.flatnonzero(start)
                within = np.arange(len(at)) - np.repeat(run_at, np.diff(np.append(run_at, len(at))))
                run_at = np.flatnonzero(within % SEGMENT == 0)
                size = np.diff(np.append(run_at, len(at))) + window - 1
                begin, of = at[run_at], doc[run_at]
                seg_a, seg_b = _segment_ids(words, begin, size)
                values = (anchor[run_at].view(np.int64), seg_a, seg_b, rows[of], ids[of], (begin - first[of]).astype(np.int32), size.astype(np.int32))
                yield pa.record_batch([pa.array(v) for v in values], schema=_USES)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, segments to cut from it) to (anchor, seg_a, seg_b, doc_id, last, words)."""
    names = ("anchor", "seg_a", "seg_b", "doc_id", "last")
    for batch in batches:
        for piece in pieces(batch, "text", 2 << 20):
            wanted = piece.column(1)
            flat = wanted.flatten()
            edges = np.asarray(wanted.offsets) - (wanted.offsets[0].as_py() if len(wanted) else 0)
            at, size = (flat.field(c).to_pylist() for c in ("at", "size"))
            out = []
            for i, text in enumerate(piece.column(0)):
                words = text.as_buffer().to_pybytes().split()
                out += [b" ".join(words[at[j] : at[j] + size[j]]) for j in range(edges[i], edges[i + 1])]
            yield pa.record_batch([*(flat.field(c) for c in names), pa.array(out, pa.binary())], names=[*names, "words"])


def _shards(window: int, shard_words: int):
    """Distinct segments in the order of their anchors to (seg_a, seg_b, smallest document of each window).

    Results that can't be of use, as no document with the segment comes after one of them, are left out.
    """
    none = (1 << 63) - 1
    schema = pa.schema([("seg_a", pa.int64()), ("seg_b", pa.int64()), ("owners", pa.list_(pa.int64()))])

    def results(distinct: list[tuple]) -> Iterator[tuple]:
        """One automaton over the segments (seg_a, seg_b, owner, last, words) of whole anchors."""
        split = [x[4].split() for x in distinct]
        machine = SuffixAutomaton()
        for k in sorted(range(len(distinct)), key=lambda k: distinct[k][2]):
            machine.add(split[k], distinct[k][2])
        for (a, b, _, last, _), words in zip(distinct, split, strict=True):
            owners = machine.owners(words, window, none)
            if min(owners) < last:
                yield a, b, owners

    def large(file) -> Iterator[tuple]:
        """One anchor's segments, spilled: an automaton for each bounded part, all segments through each."""
        at = 0
        while True:
            file.seek(at)
            machine, size, part = SuffixAutomaton(), 0, []
            try:
                while size < shard_words:
                    _, _, owner, _, words = pickle.load(file)
                    part.append((owner, words.split()))
                    size += len(part[-1][1])
            except EOFError:
                pass
            if not part:
                return
            at = file.tell()
            for owner, words in sorted(part, key=lambda x: x[0]):
                machine.add(words, owner)
            file.seek(0)
            try:
                while True:
                    a, b, _, last, words = pickle.load(file)
                    owners = machine.owners(words.split(), window, none)
                    if min(owners) < last:
                        yield a, b, owners
            except EOFError:
                pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit(rows: Iterator[tuple], all_now: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal out
            for row in rows:
                out.append(row)
                if len(out) >= 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if all_now and out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        done: list[tuple] = []
        group: list[tuple] = []
        size, now, in_group, spill = 0, None, 0, None

        def close() -> Iterator[tuple]:
            nonlocal done, size, group, in_group, spill
            if spill is not None:
                for x in group:
                    pickle.dump(x, spill)
                yield from large(spill)
                spill.close()
            else:
                done += group
                size += in_group
            group, in_group, spill = [], 0, None

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "seg_a", "seg_b", "doc_id", "last", "words")]
            for anchor, *segment in zip(*columns, strict=True):
                if anchor != now:
                    yield from emit(close())
                    now = anchor
                    if size >= shard_words:
                        yield from emit(results(done))
                        done, size = [], 0
                group.append(tuple(segment))
                in_group += segment[4].count(b" ") + 1
                if in_group >= shard_words:
                    spill = spill or tempfile.TemporaryFile()  # local scratch of this task alone
                    for x in group:
                        pickle.dump(x, spill)
                    group, in_group = [], 0
        yield from emit(close())
        yield from emit(results(done), True)

    return run


def _strip(window: int, with_text: bool):
    """(doc_id, text, segments with the smallest documents of their windows, one for all or one each) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids, spans = batch.column(0).to_pylist(), batch.column(2)
            per_doc = np.asarray(spans.offsets)
            at, size, owners = (spans.flatten().field(k) for k in ("at", "size", "owners"))
            size = np.asarray(size).astype(np.int64) - window + 1
            listed = np.asarray(owners.offsets)
            owner = np.asarray(owners.flatten())
            edges = np.append(0, np.cumsum(size))
            inside = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
            place = np.repeat(np.asarray(at).astype(np.int64), size) + inside
            known = np.array([x or 0 for x in ids], np.int64)  # rows without a doc_id have no spans
            of = np.repeat(listed[:-1] - listed[:1], size) + np.where(np.repeat(np.diff(listed), size) > 1, inside, 0)
            smaller = owner[of] < np.repeat(np.repeat(known, np.diff(per_doc)), size)
            for i, text in enumerate(batch.column(1)):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                a, b = edges[per_doc[i] - per_doc[0]], edges[per_doc[i + 1] - per_doc[0]]
                hit = place[a:b][smaller[a:b]]
                lost, kept = 0, words
                if len(hit):
                    gone = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + window, minlength=len(words) + 1)
                    gone = np.cumsum(gone)[: len(words)] > 0
                    lost, kept = int(gone.sum()), [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                body = b" ".join(kept)
                values = (len(words), lost, hashlib.sha256(body).hexdigest(), body.decode("utf-8") if with_text and lost else None)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            n = 4 if with_text else 3
            yield pa.record_batch([batch.column(0), *columns[:n]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: n + 1])

    return run


def strip_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False, shard_words: int = SHARD_WORDS, together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and kept_text, null where nothing was removed)."""
    spark = docs.sparkSession
    n = partitions(spark)
    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = read.where("doc_id is not null").withColumn("row", F.xxhash64("doc_id", text_key("text")))
    packed = known.select("text", "row").mapInArrow(_scan(window, anchor, 4 * n, together), "bucket int, anchors binary, rows binary, known binary")
    hits = written(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "row long, anchor long"), "hits")
    release(spark)
    listed = lambda t, what: t.groupBy("row").agg(F.collect_list(what).alias("listed"))  # noqa: E731  no more than a document has words
    with_text = known.join(listed(hits, "anchor"), "row").select("doc_id", "text", "row", "listed")
    uses = written(with_text.mapInArrow(_segments(window, anchor), "anchor long, seg_a long, seg_b long, row long, doc_id long, at int, size int"), "uses")
    drop(hits)
    release(spark)
    first = F.min(F.struct("doc_id", "row", "at", "size")).alias("first")
    distinct = uses.groupBy("anchor", "seg_a", "seg_b").agg(first, F.max("doc_id").alias("last"))
    beside = F.count("*").over(Window.partitionBy("anchor"))
    distinct = written(distinct.select("anchor", "seg_a", "seg_b", "first.*", "last", beside.alias("beside")), "distinct")
    release(spark)
    crowded = distinct.where("beside > 1")
    parts = known.join(listed(crowded, F.struct("anchor", "seg_a", "seg_b", "doc_id", "last", "at", "size")), "row").select("text", "listed")
    parts = parts.mapInArrow(_cut, "anchor long, seg_a long, seg_b long, doc_id long, last long, words binary")
    dealt = parts.repartition(n, "anchor").sortWithinPartitions("anchor")
    several = written(dealt.mapInArrow(_shards(window, shard_words), "seg_a long, seg_b long, owners array<long>"), "owners")
    release(spark)
    owners = several.union(distinct.where("beside = 1 and doc_id < last").select("seg_a", "seg_b", F.array("doc_id")))
    found = uses.select("seg_a", "seg_b", "row", "doc_id", "at", "size").join(owners, ["seg_a", "seg_b"]).where(F.array_min("owners") < F.col("doc_id"))
    spans = written(listed(found, F.struct("at", "size", "owners")).withColumnRenamed("listed", "spans"), "spans")
    for table_ in (uses, distinct, several):
        drop(table_)
    release(spark)
    none = F.lit(None).cast("array<struct<at: int, size: int, owners: array<bigint>>>")
    both = known.join(spans, "row", "left").select("doc_id", "text", "spans").union(read.where("doc_id is null").select("doc_id", "text", none))
    return both.mapInArrow(_strip(window, kept_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win FROM g),
r AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY win) AS hit FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM r WHERE hit),
x AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.k = x.k GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""
