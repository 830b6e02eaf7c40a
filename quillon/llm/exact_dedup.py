"""Exact deduplication by Patricia-trie owners.

Every distinct text of a window of rows goes once, with its length and content hash, to the partition of that pair; there
the full byte strings are inserted into a compressed radix trie whose terminal nodes hold the owner of the text, so two
texts are one only if all their bytes agree. A trie past its byte budget spills whole subtrees to disk. Copies are
combined per window before the shuffle, so a text that a third of all rows share costs one record per window, not per row,
and each row learns its owner through its window's own class number, which no window gives to more rows than it holds.

Defined results: null text counts as empty; null doc_ids sort below every other; of repeated rows that tie in doc_id one
stays, the first read; texts of any length are compared whole; an empty table gives an empty result; columns beyond those
read never matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, drop, own_name, partitions, release, written
from quillon.session import table

#: Bytes of text that are combined before the shuffle, and that a trie holds before it spills.
WINDOW = 24 << 20
TRIE_BYTES = 48 << 20
_NODE = 250


class _Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.children = label, value, {}


class PatriciaTrie:
    """A compressed radix trie over byte strings; ``size`` is about what it holds in memory."""

    def __init__(self):
        self.root, self.size, self.terminals = _Node(b""), 0, 0

    def node(self, key: bytes) -> _Node:
        """The terminal node of ``key``, inserted if need be."""
        at, i = self.root, 0
        while i < len(key):
            child = at.children.get(key[i])
            if child is None:
                child = at.children[key[i]] = _Node(key[i:])
                self.size += len(key) - i + _NODE
                return child
            label = child.label
            if key.startswith(label, i):
                at, i = child, i + len(label)
                continue
            n = min(len(label), len(key) - i)
            same = int(np.argmax(np.frombuffer(label, np.uint8, n) != np.frombuffer(key, np.uint8, n, i))) if label[:n] != key[i : i + n] else n
            upper = at.children[key[i]] = _Node(label[:same])
            child.label = label[same:]
            upper.children[child.label[0]] = child
            self.size += _NODE
            at, i = upper, i + same
        return at

    def walk(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(key, value) of every terminal below ``node``."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, prefix = stack.pop()
            if at.value is not None:
                yield prefix, at.value
            stack += [(c, prefix + c.label) for c in at.children.values()]

    def cut(self) -> tuple[bytes, list] | None:
        """Takes out the heaviest subtree below the first branching: (its prefix, its terminals), or None if there is no branch."""
        at, prefix = self.root, b""
        while len(at.children) == 1 and at.value is None:
            (child,) = at.children.values()
            at, prefix = child, prefix + child.label
        if not at.children or (len(at.children) == 1 and at.value is None):
            return None
        weight = lambda c: sum(len(n.label) + _NODE for n in _nodes(c))
        first, child = max(at.children.items(), key=lambda x: weight(x[1]))
        self.size -= weight(child)
        del at.children[first]
        return prefix + child.label, list(self.walk(child, prefix + child.label))


def _nodes(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        yield (at := stack.pop())
        stack += at.children.values()


def _better(a: tuple, b: tuple, smallest: bool) -> bool:
    """Whether owner ``a`` goes before ``b``; an owner is (doc_id or None, row number)."""
    if a[0] is None or b[0] is None:
        return (a[0] is not None, -a[1]) > (b[0] is not None, -b[1])
    return ((-a[0] if smallest else a[0]), -a[1]) > ((-b[0] if smallest else b[0]), -b[1])


def owners(records: Iterator[tuple[bytes, tuple, int, list[int]]], smallest: bool, budget: int = TRIE_BYTES) -> Iterator[tuple[list[int], tuple, int]]:
    """Groups (key, owner, rows, refs) records by key: (refs, owner, rows) of each key; memory follows ``budget``, not the input."""
    trie, spilled = PatriciaTrie(), []
    for key, owner, rows, refs in records:
        if spilled and (file := next((f for p, f in spilled if key.startswith(p)), None)):
            pickle.dump((key, owner, rows, refs), file)
            continue
        node = trie.node(key)
        if (v := node.value) is None:
            node.value = [owner, rows, array("q", refs)]
            trie.terminals += 1
        else:
            v[1] += rows
            v[2].extend(refs)
            if _better(owner, v[0], smallest):
                v[0] = owner
        while trie.size > budget and trie.terminals > 1 and (part := trie.cut()):
            file = tempfile.TemporaryFile()  # local scratch of this task alone
            for k, v in part[1]:
                pickle.dump((k, *v), file)
            trie.terminals -= len(part[1])
            spilled.append((part[0], file))
    for _, v in trie.walk():
        yield list(v[2]), v[0], v[1]
    del trie
    for _, file in spilled:
        file.seek(0)
        yield from owners(_unpickled(file), smallest, budget)
        file.close()


def _unpickled(file) -> Iterator:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


_COMBINED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("ref", pa.int64()), ("length", pa.int64()), ("content_hash", pa.int64()), ("sha256", pa.string()), ("body", pa.binary()), ("owner", pa.int64()), ("owner_rid", pa.int64()), ("rows", pa.int64())])
_COMBINED_DDL = "kind int, doc_id long, rid long, ref long, length long, content_hash long, sha256 string, body binary, owner long, owner_rid long, rows long"


def _combine(smallest: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        n = refs = 0
        trie, ids, rids, mine = PatriciaTrie(), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal trie, ids, rids, mine
            k = len(ids)
            nulls = lambda m, t: pa.nulls(m, t)
            yield pa.record_batch([pa.array([0] * k, pa.int32()), pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(mine, pa.int64()), *[nulls(k, f.type) for f in list(_COMBINED)[4:]]], schema=_COMBINED)
            rows, held = [], 0
            for key, (owner, count, ref) in trie.walk():
                digest = hashlib.sha256(key)
                rows.append((1, None, None, ref, len(key), int.from_bytes(digest.digest()[:8], "little", signed=True), digest.hexdigest(), key, owner[0], owner[1], count))
                held += len(key)
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COMBINED, strict=True)], schema=_COMBINED)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COMBINED, strict=True)], schema=_COMBINED)
            trie, ids, rids, mine = PatriciaTrie(), [], [], []

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = text.as_buffer().to_pybytes().lower() if text.is_valid else b""  # bytes.lower() is A-Z only
                node, rid = trie.node(key), part | n
                n += 1
                if node.value is None:
                    node.value = [(doc_id, rid), 1, part | refs]
                    refs += 1
                else:
                    node.value[1] += 1
                    if _better((doc_id, rid), node.value[0], smallest):
                        node.value[0] = (doc_id, rid)
                ids.append(doc_id)
                rids.append(rid)
                mine.append(node.value[2])
                if trie.size > window or len(ids) >= 500_000:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _resolve(smallest: bool, budget: int):
    schema = pa.schema([("ref", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                d = {c: b.column(b.schema.get_field_index(c)) for c in ("body", "owner", "owner_rid", "rows", "ref")}
                rest = zip(*(d[c].to_pylist() for c in ("owner", "owner_rid", "rows", "ref")), strict=True)
                for body, (owner, rid, rows, ref) in zip(d["body"], rest, strict=True):
                    yield body.as_buffer().to_pybytes(), (owner, rid), rows, [ref]

        out: list[list] = [[], [], [], []]
        for refs, owner, rows in owners(records(), smallest, budget):
            for ref in refs:
                for column, x in zip(out, (ref, *owner, rows), strict=True):
                    column.append(x)
                if len(out[0]) >= 50_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=schema)
                    out = [[], [], [], []]
        if out[0]:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", window: int = WINDOW, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; texts are equal after lower-casing A-Z only.

    ``keep``: "largest" or "smallest", the doc_id that owns a group of equal texts.
    """
    smallest = {"largest": False, "smallest": True}[keep]
    spark = docs.sparkSession
    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text")
    both = written(read.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_combine(smallest, window), _COMBINED_DDL), "exact", "kind")
    texts = both.where("kind = 1").select("ref", "length", "content_hash", "body", "owner", "owner_rid", "rows")
    found = texts.repartition(partitions(spark), "length", "content_hash").mapInArrow(_resolve(smallest, budget), "ref long, keep_id long, keep_rid long, group_size long")
    digests = both.where("kind = 1").select("ref", F.col("sha256").alias("text_sha256"))
    members = both.where("kind = 0").select("doc_id", "rid", "ref")
    out = members.join(found, "ref").join(digests, "ref").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
    out._quillon_path = both._quillon_path  # for ``drop``, once the result is read
    return out


def _key(doc_id, digest):
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged: one of each group of equal texts."""
    key = own_name(docs, "key")
    groups = exact_groups(docs, id_col, text_col, keep)
    kept = written(groups.where("kept").select(_key(F.col("doc_id"), F.col("text_sha256")).alias(key)), "kept")
    drop(groups)
    release(docs.sparkSession)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest = F.sha2(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), upper, lower).cast("binary"), 256)
    keyed = docs.withColumn(key, _key(F.col(f"`{id_col}`"), digest))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
