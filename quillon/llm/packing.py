"""Hierarchical packing of tokenised documents into training sequences.

Documents go to tiers of context size: full windows of the longest are cut off first, what is left goes to the smallest
tier that holds it. Each tier opens windows of its own size, longest documents first; the gap of a window is filled with
the longest documents of shorter tiers that fit, and at last by cutting one, so windows are full. What a partition ends
with is split into powers of two, which need no padding. Sequences packed together are dealt into step groups that are
balanced in tokens and hold all lengths. All
of it happens in the partition in which the text is read, over a bounded number of tokens at a time: nothing is shuffled.

Defined results: null text is empty and still gets its end id; repeated rows are separate documents; of equally long
documents that read first goes first; a text of any length is cut into full windows; an empty table gives an empty result;
columns beyond those read never matter.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import Bpe
from quillon.llm.shared import doc_columns
from quillon.llm.textkit import pieces
from quillon.session import table

LONGEST = 2048
#: Shorter context sizes, and the tokens that are packed together and make one step group.
TIERS = (256, 512, 1024)
TOGETHER = 1 << 20
STEP = 32 * LONGEST


def sequences(lengths: list[int], longest: int = LONGEST, tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(sequences of (document, start, length) pieces, pieces left over); every sequence is full.

    With ``last`` nothing is left over: the rest becomes sequences whose lengths are powers of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    sizes = [*tiers, longest]
    queues: list[list[tuple[int, int, int]]] = [[] for _ in sizes]  # ascending (length, -document, start)
    tier = lambda n: bisect_right(sizes, n - 1)
    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            queues[tier(n - whole)].append((n - whole, -doc, whole))
    for q in queues:
        q.sort()

    def fill(gap: int) -> list[tuple[int, int, int]]:
        got = []
        while gap:
            for q in reversed(queues[: tier(gap) + 1]):
                if k := bisect_right(q, (gap, 1, 0)):
                    n, doc, start = q.pop(k - 1)
                    got.append((-doc, start, n))
                    gap -= n
                    break
            else:  # nothing fits whole: cut the shortest that is longer
                q = next((q for q in queues if q), None)
                if q is None:
                    break
                n, doc, start = q.pop(0)
                got.append((-doc, start, gap))
                insort(queues[tier(n - gap)], (n - gap, doc, start + gap))
                gap = 0
        return got

    rest: list[tuple[int, int, int]] = []
    for k in reversed(range(len(sizes))):
        while queues[k]:
            n, doc, start = queues[k].pop()
            window = [(-doc, start, n), *fill(sizes[k] - n)]
            if sum(p[2] for p in window) == sizes[k]:
                out.append(window)
            else:
                rest += window
    if last and rest:
        left = sum(p[2] for p in rest)
        while left:
            need = min(longest, 1 << (left.bit_length() - 1))
            left -= need
            row: list[tuple[int, int, int]] = []
            while need:
                doc, start, n = rest.pop(0)
                row.append((doc, start, min(n, need)))
                if n > need:
                    rest.insert(0, (doc, start + need, n - need))
                need -= min(n, need)
            out.append(row)
    return out, rest


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("step_id", pa.int64())]


def pack(docs: DataFrame, tokenizer: str, end: int, longest: int = LONGEST, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, together: int = TOGETHER, step: int = STEP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_id (and ids)."""
    fields = [*_FIELDS, *([("ids", pa.list_(pa.int32()))] if with_ids else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = Bpe.of(tokenizer), TaskContext.get().partitionId() << 36
        number = steps = 0
        # documents not yet wholly packed: (doc_id, ids from ``base`` on, base, tokens of the whole document)
        held: list[tuple[int | None, np.ndarray, int, int]] = []
        tokens = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number, steps
            rows, left = sequences([len(h[1]) for h in held], longest, tiers, last)
            rows.sort(key=lambda r: -sum(p[2] for p in r))
            # longest first, each to the group with fewest tokens: groups differ by one sequence at most
            loads = [(0, g) for g in range(max(1, round(sum(p[2] for r in rows for p in r) / step)))]
            out: list[list] = [[] for _ in fields]
            for row in rows:
                size, offset = sum(p[2] for p in row), 0
                load, group = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, group))
                for doc, start, n in row:
                    doc_id, ids, base, total = held[doc]
                    cut = ids[start : start + n]
                    values = (doc_id, base + start, n, zlib.crc32(cut), total, part | number, offset, size, part | (steps + group), *([cut] if with_ids else []))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                    offset += n
                number += 1
                if len(out[0]) >= 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)
                    out = [[] for _ in fields]
            if out[0]:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)
            steps += len(loads)
            held = [(held[d][0], held[d][1][s : s + n].copy(), held[d][2] + s, held[d][3]) for d, s, n in left]
            tokens = sum(len(h[1]) for h in held)

        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, first = bpe.encode(piece.column(1), end)
                ids = ids.astype("<u4")
                bounds = first.tolist()
                for k, doc_id in enumerate(piece.column(0).to_pylist()):
                    held.append((doc_id, ids[bounds[k] : bounds[k + 1]], 0, bounds[k + 1] - bounds[k]))
                    tokens += bounds[k + 1] - bounds[k]
                    if tokens >= together:
                        yield from flush(False)
        if held:
            yield from flush(True)

    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text")
    ddl = ", ".join(f"{n} long" for n, _ in _FIELDS) + ", ids array<int>" * with_ids
    return read.mapInArrow(run, ddl)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
