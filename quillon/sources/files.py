"""Files of rows: JSON lines (strict and tolerant), sinks that resume, manifests, bounded row groups, size-bounded shards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from quillon.session import stored


def write_jsonl(df: DataFrame, path: str, *by: str) -> None:
    """One object a line, a folder for each value of ``by``."""
    df.write.partitionBy(*by).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """Lines of JSON; ``tolerant`` skips lines that are torn or malformed, else they are an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def torn_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: lines, lines that can't be read."""
    full = StructType([*schema.fields, StructField("_torn", StringType())])
    read = F.from_json("value", full, {"columnNameOfCorruptRecord": "_torn"})
    return spark.read.text(path).select(read["_torn"].alias("torn")).agg(F.count("*").alias("lines"), F.count("torn").alias("torn"))


def write_missing(df: DataFrame, path: str, by: str) -> list:
    """Writes only the partitions of ``by`` that ``path`` doesn't hold yet; returns their values (one a partition)."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(by).distinct()
        rest = df.join(done, by, "left_anti")
    except AnalysisException:  # nothing there yet
        rest = df
    new = sorted(r[0] for r in rest.select(by).distinct().collect())
    if new:
        rest.write.mode("append").partitionBy(by).parquet(path)
    return new


def row_groups(spark: SparkSession, folder: str, paths: list[str], columns: str, most: int | None = 6) -> DataFrame:
    """The first ``most`` row groups of each Parquet file of ``folder`` (a URI); a file that can't be read is skipped.

    ``columns`` is a DDL of the columns read; one task reads one file. Without ``most`` every row group is read: ``paths`` are
    whatever Spark reads, a large file's row groups go to several tasks, and a file that can't be read is an error.
    """
    if most is None:
        return spark.read.schema(columns).parquet(*paths)
    names = [f.name for f in StructType.fromDDL(columns).fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_file(path) as f:
                        got = pq.ParquetFile(f)
                        yield from got.read_row_groups(list(range(min(most, got.num_row_groups))), columns=names).select(names).to_batches()
                except (OSError, pa.ArrowInvalid, KeyError):
                    continue

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(read, columns)


def merged_manifest(old: str | None, section: str, values: dict) -> str:
    """A JSON manifest with one section replaced, so that one index's rebuild leaves the others' alone."""
    return json.dumps({**json.loads(old or "{}"), section: values}, sort_keys=True)


#: Bytes of a code and of a passage's text, and what a passage's text is taken to be.
WORD_BYTES, TEXT_BYTES = 4, 790


def expected_bytes(manifest: DataFrame) -> DataFrame:
    """``manifest`` (passages, dim, code_words, chunks, lists, terms, postings) with the bytes an index of it takes."""
    vectors = F.col("chunks") * (F.col("code_words") + 1) * WORD_BYTES + F.col("lists") * (F.col("dim") + 1) * WORD_BYTES
    lexical = F.col("terms") * 12 + F.col("postings") * 5 + F.col("passages") * 2
    table = F.col("passages") * (F.col("dim") + WORD_BYTES)
    return manifest.withColumn("bytes", (vectors + lexical + table + F.col("passages") * TEXT_BYTES).cast("long"))


#: Rows that a block of ``text_shards`` has, about.
SHARD_BLOCK = 100_000


def _closing(block: pa.Table, most: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block in order, its bytes up to each text and with it, and which text closes a shard begun with each (their number: none)."""
    block = block.sort_by([("id", "ascending"), ("n", "ascending")])
    n = block["n"].to_numpy()
    upto = np.cumsum(n)
    return block, upto, np.searchsorted(upto, upto - n + most)


def _outcomes(block: pa.Table, most: int) -> pa.Table:
    """One row. For each text that may be the first to close a shard, in order: bytes up to it, shards closed, bytes held at the end."""
    block, upto, ends = _closing(block, most)
    n, total = len(upto), int(upto[-1])
    closed, held = [0] * (n + 1), [0] * (n + 1)  # of a shard begun with that text
    for i in range(n - 1, -1, -1):
        e = int(ends[i])
        if e < n:
            closed[i], held[i] = closed[e + 1] + 1, held[e + 1]
        else:
            held[i] = total - (int(upto[i - 1]) if i else 0)
    may = min(int(ends[0]) + 1, n)
    out = {"total": [total], "upto": [upto[:may]], "closed": [[x + 1 for x in closed[1 : may + 1]]], "held": [held[1 : may + 1]]}
    longs = pa.list_(pa.int64())
    values = [pa.array(v, pa.int64() if k == "total" else longs) for k, v in out.items()]
    return pa.Table.from_arrays([*block.slice(0, 1).drop_columns(["id", "n"]).columns, *values], names=[*(c for c in block.column_names if c not in ("id", "n")), *out])


def _begun(blocks: pa.Table, most: int) -> pa.Table:
    """The shard that each block of a group goes on with, and the bytes that it holds by then."""
    blocks = blocks.sort_by("part")
    shard, held, begun = 0, 0, []
    for total, *lists in zip(blocks["total"].to_pylist(), *(blocks[c] for c in ("upto", "closed", "held"))):
        begun.append((shard, held))
        upto, closed, left = (x.values.to_numpy() for x in lists)
        first = int(np.searchsorted(upto, most - held))
        shard, held = (shard + int(closed[first]), int(left[first])) if first < len(upto) else (shard, held + total)
    blocks = blocks.drop_columns(["total", "upto", "closed", "held"])
    for name, values in zip(("shard", "held"), zip(*begun)):
        blocks = blocks.append_column(name, pa.array(values, pa.int64()))
    return blocks


def _dealt(block: pa.Table, begun: pa.Table, most: int) -> pa.Table:
    """A block's texts with their shards."""
    block, upto, ends = _closing(block, most)
    closes = np.zeros(len(upto), np.int64)
    at = int(np.searchsorted(upto, most - begun["held"][0].as_py()))
    while at < len(upto):
        closes[at] = 1
        at = int(ends[at + 1]) if at + 1 < len(upto) else len(upto)
    shard = begun["shard"][0].as_py() + np.cumsum(closes) - closes
    return block.drop_columns(["n", "part"]).append_column("shard", pa.array(shard))


def text_shards(docs: DataFrame, id_col: str, text_col: str, by: str, most: int) -> DataFrame:
    """(by, id, shard): a group's texts in order of id, a shard closing with the text that brings it to ``most`` bytes.

    A text counts its UTF-8 bytes and eight more. Only sizes are folded, in blocks that are ranges of (by, id). What a block begins
    with decides only which of its texts closes a shard first, and that is one of its first ``most`` bytes; from there on it
    is the same. So each block gives the outcome for each of these, one row a block is folded inside a group, and the blocks are
    dealt in parallel.
    """
    size = (F.octet_length(text_col) + 8).cast("long")
    most = max(most, 1)
    sizes = stored(docs.where(F.col(text_col).isNotNull()).select(by, F.col(id_col).alias("id"), size.alias("n")), "sizes")
    blocks = sizes.repartitionByRange(sizes.count() // SHARD_BLOCK + 1, by, F.asc_nulls_last("id"), "n").withColumn("part", F.spark_partition_id())
    blocks = stored(blocks, "blocks")  # ranges are cut by samples, anew for each job
    field = {f.name: f for f in blocks.schema.fields}
    key, longs = [field[by], field["part"]], [StructField(c, LongType()) for c in ("total", "shard", "held")]
    lists = [StructField(c, ArrayType(LongType())) for c in ("upto", "closed", "held")]
    outcomes = blocks.groupBy(by, "part").applyInArrow(lambda b: _outcomes(b, most), StructType([*key, longs[0], *lists]))
    begun = outcomes.groupBy(by).applyInArrow(lambda b: _begun(b, most), StructType([*key, *longs[1:]]))
    return blocks.groupBy(by, "part").cogroup(begun.groupBy(by, "part")).applyInArrow(lambda b, s: _dealt(b, s, most), StructType([field[by], field["id"], longs[1]]))
