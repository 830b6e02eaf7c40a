"""Token-id files in Simple-8b: 64-bit words whose top four bits say how many ids of which width the other sixty hold.

File format (all little-endian): magic ``QS8B0001``; uint64 documents, ids, ids per block, blocks, words; int64 doc_id and
uint8 null flag of each document; uint64 ids of each document; uint64 first word of each block, and the number of words;
uint64 words. Selector 0 is an escape: the next word is one raw 64-bit id. Blocks start at a word, so all blocks of a
file are decoded at once with vector operations, or one alone for random access.

Defined results: null text is empty and still gets its end id; null doc_ids come last; repeated rows are separate
documents, ordered by text; a text of any length is one document in one file; an empty table gives no file and an empty
result; extra columns never matter.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import Bpe
from quillon.llm.shared import doc_columns, new_path, partitions, written
from quillon.llm.textkit import pieces
from quillon.session import table

MAGIC = b"QS8B0001"
BLOCK = 128
#: Ids of one file at least, unless its partition has fewer; one document is never split over files.
FILE_IDS = 4 << 20
#: Blocks whose selectors are found at once.
TOGETHER = 2048
#: (ids, bits) by selector 1 to 14.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def _selectors(grid: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The selector of a word that would begin at each place; past the end of a block all is zero."""
    need = np.zeros((len(grid), BLOCK + 64), np.uint8)  # the first width an id fits, as a place in LAYOUT
    need[:, :BLOCK] = np.searchsorted(limits, grid.reshape(-1), "right").reshape(grid.shape)
    most = {1: need}  # the widest need of 2, 4, ... 32 places on
    for k in (1, 2, 4, 8, 16):
        most[2 * k] = np.maximum(most[k][:, :-k], most[k][:, k:])
    best = np.zeros(grid.shape, np.uint8)
    for k, (count, _) in reversed(list(enumerate(LAYOUT, 1))):
        half = 1 << (count.bit_length() - 1)
        widest = most[half][:, :BLOCK]
        if half < count:
            widest = np.maximum(widest, most[half][:, count - half : count - half + BLOCK])
        best[widest < k] = k
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` (uint64) and the first word of each block of BLOCK ids, with the number of words last."""
    n = len(ids)
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.uint64)
    grid.reshape(-1)[:n] = ids
    left = np.full(rows, BLOCK)
    if n % BLOCK:
        left[-1] = n % BLOCK
    # the widest fit at each place: selectors from many narrow ids to few wide ones, the first that fits
    limits = np.array([1 << bits for _, bits in LAYOUT], np.uint64)
    best = np.empty((rows, BLOCK), np.uint8)
    for top in range(0, rows, TOGETHER):
        best[top : top + TOGETHER] = _selectors(grid[top : top + TOGETHER], limits)
    counts = np.array([1, *(c for c, _ in LAYOUT)])
    at = np.zeros(rows, np.int64)
    steps = []  # one word of every block that has ids left
    while len(live := np.flatnonzero(at < left)):
        k = best[live, at[live]]
        steps.append((live, at[live].copy(), k))
        at[live] += counts[k]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    row, pos, sel = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((pos, row))
    row, pos, sel = row[order], pos[order], sel[order]
    wide = 1 + (sel == 0)
    start = np.cumsum(wide) - wide
    words = np.zeros(int(wide.sum()), np.uint64)
    padded = np.zeros((rows, BLOCK + 60), np.uint64)
    padded[:, :BLOCK] = grid
    for k, (count, bits) in enumerate(LAYOUT, 1):
        here = np.flatnonzero(sel == k)
        if len(here):
            word = np.full(len(here), np.uint64(k) << np.uint64(60))
            for j in range(count):
                word |= padded[row[here], pos[here] + j] << np.uint64(j * bits)
            words[start[here]] = word
    raw = np.flatnonzero(sel == 0)
    words[start[raw] + 1] = padded[row[raw], pos[raw]]
    return words, np.append(np.append(0, np.cumsum(np.bincount(row, weights=wide, minlength=rows).astype(np.int64)))[:-1], len(words)).astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks that begin at ``offsets``."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.zeros(len(words), bool)  # the raw word after an escape has any top bits
    if (sel == 0).any():
        skip = -1
        for i in np.flatnonzero(sel == 0).tolist():
            if i != skip:
                escaped[i + 1] = True
                skip = i + 1
    head = np.flatnonzero(~escaped)
    counts = np.array([1, *(c for c, _ in LAYOUT), 0])[sel[head]]
    block = np.searchsorted(offsets[:-1], head.astype(np.uint64), "right") - 1
    upto = np.cumsum(counts) - counts
    first = np.searchsorted(block, np.arange(len(offsets) - 1), "left")
    pos = block * BLOCK + upto - upto[first][block]
    out = np.zeros((len(offsets) - 1) * BLOCK + 60, np.uint64)
    # the last word of a block may hold zeros past its end: later blocks are written over them
    for k, (count, bits) in enumerate(LAYOUT, 1):
        here = np.flatnonzero(sel[head] == k)
        word, to, end = words[head[here]], pos[here], (block[here] + 1) * BLOCK
        for j in range(count):
            ok = to + j < end
            out[to[ok] + j] = (word[ok] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    here = np.flatnonzero(sel[head] == 0)
    out[pos[here]] = words[head[here] + 1]
    return out[:n]


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids.astype(np.uint64))
    head = np.array([len(doc_ids), len(ids), BLOCK, len(offsets) - 1, len(words)], "<u8")
    known = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((MAGIC, head.tobytes(), known.tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, block, blocks, words = np.frombuffer(data, "<u8", 5, 8).astype(np.int64).tolist()
    if block != BLOCK:
        raise ValueError("unknown block size")
    at = 48
    known = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs).tolist()
    at += 9 * docs
    lengths = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at + 8 * docs)
    ids = unpack(np.frombuffer(data, "<u8", words, at + 8 * (docs + blocks + 1)), offsets, n)
    return [None if z else x for x, z in zip(known, null, strict=True)], lengths, ids


_MANIFEST = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes all texts in ascending doc_id order into files below ``folder``, a URI all executors reach.

    Returns the manifest (part, number, path, documents, ids, start): the files in order, with the ids before each. A task
    that runs twice leaves files nobody reads; only those of the attempts that counted are in the manifest.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, number = Bpe.of(tokenizer), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: tuple[list, list, list] = ([], [], [])
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, number
            path = posixpath.join(root, f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.s8b")
            with store.open_output_stream(path) as f:
                f.write(to_bytes(held[0], np.concatenate(held[1]), np.concatenate(held[2])))
            row = pa.record_batch([[part], [number], [path], [len(held[0])], [count]], schema=_MANIFEST)
            held, count, number = ([], [], []), 0, number + 1
            return row

        for batch in batches:
            for piece in pieces(batch, "text", min(4 << 20, file_ids)):
                ids, first = bpe.encode(piece.column(1), end)
                held[0].extend(piece.column(0).to_pylist())
                held[1].append(np.diff(first))
                held[2].append(ids)
                count += len(ids)
                if count >= file_ids:
                    yield flush()
        if held[0]:
            yield flush()

    spark = docs.sparkSession
    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text")
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    in_order = read.repartitionByRange(partitions(spark), F.asc_nulls_last("doc_id")).sortWithinPartitions(*order)
    manifest = written(in_order.mapInArrow(encode, "part long, number long, path string, documents long, ids long"), "manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)  # one row a file


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files of a manifest."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"]) as f:
                    doc_ids, lengths, ids = from_bytes(f.read())
                bounds = np.append(0, np.cumsum(lengths))
                small = np.ascontiguousarray(ids.astype("<u4"))
                crc = [zlib.crc32(small[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for a in range(0, len(doc_ids), 5000):
                    b = min(a + 5000, len(doc_ids))
                    columns = [pa.array(doc_ids[a:b], pa.int64()), pa.array(row["start"] + bounds[a:b]), pa.array(lengths[a:b]), pa.array(crc[a:b], pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds[a : b + 1] - bounds[a], pa.int32()), pa.array(ids[bounds[a] : bounds[b]].astype(np.int64))))
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    spark = manifest.sparkSession
    dealt = manifest.select("path", "start").repartition(partitions(spark), "path")
    return dealt.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(manifest, folder)
