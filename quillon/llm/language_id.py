"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent.

Features are the hashed byte 2- to 4-grams of letters and blanks of the whole text (A-Z folded, every other ASCII byte a
blank). A document is the mean of its features' embeddings; as the classifier is linear, each feature's embedding times
the weights is stored once, and a document's logits are a mean over table rows. Training runs in numpy on the driver over
a bounded sample of the labelled rows, of which executors send the counted features of the whole text, at most BUCKETS
numbers a row. A temperature and a rejection threshold are fitted on a part that is held back.

Defined results: null text, or text without any letter, is ``und`` with score 0; with no labelled row everything is
``und``; of languages with equal probability the first in order is named; null doc_ids hash as the empty text; repeated
rows get equal results and count once in training; texts of any length are read whole, in blocks; an empty table gives an
empty result; extra columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, drop, written
from quillon.llm.textkit import blocks, mix, pieces, raw
from quillon.session import table

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Bounds of the training sample: labelled documents of each language, and of all languages together.
PER_LANGUAGE = 900
MOST_ROWS = 36_000
#: Bytes of the short cut of each document that is trained beside its whole text.
SHORT = 60
EPOCHS = 5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: what each feature adds to the logits
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def features(data: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) of every n-gram of a block; ``fresh`` marks bytes at which a document begins."""
    b = _FOLD[data]
    blank = b == 32
    bad = np.zeros(len(b), bool)  # an n-gram may not run from this byte to the next
    bad[:-1] = (blank[:-1] & blank[1:]) | fresh[1:]
    h = _BYTE[b]
    broken = np.zeros(len(b), bool)
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            return
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _BYTE[b[n - 1 :]]
        broken = broken[: len(b) - n + 1] | bad[n - 2 : len(b) - 1]
        if n in GRAMS:
            at = np.flatnonzero(~broken)
            yield (mix(h[at] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), at


def logits(column: pa.Array, model: LanguageModel) -> np.ndarray:
    data, offsets = raw(column)
    n, width = len(offsets) - 1, len(model.languages)
    sums, counts = np.zeros((n, width)), np.zeros(n)
    for a, b in blocks(data, offsets):
        lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        cuts = np.clip(offsets[lo : hi + 1] - a, 0, b - a)
        fresh = np.zeros(b - a, bool)
        fresh[cuts[cuts < b - a]] = True
        for bucket, at in features(data[a:b], fresh):
            edges = np.searchsorted(at, cuts, "left")
            upto = np.zeros((len(at) + 1, width))
            np.cumsum(model.table[bucket], axis=0, out=upto[1:])
            sums[lo:hi] += upto[edges[1:]] - upto[edges[:-1]]
            counts[lo:hi] += np.diff(edges)
    return sums / np.maximum(counts, 1)[:, None] + model.bias


def counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often each occurs) of every text of a column."""
    data, offsets = raw(column)
    out = []
    for i in range(len(offsets) - 1):
        body = data[offsets[i] : offsets[i + 1]]
        total = np.zeros(BUCKETS, np.int64) if len(body) > BUCKETS else None
        found = [np.zeros(0, np.int64)]
        for a, b in blocks(body, np.array([0, len(body)])):
            here = [x for x, _ in features(body[a:b], np.zeros(b - a, bool))]
            if total is None:
                found += here
            else:
                for x in here:
                    total += np.bincount(x, minlength=BUCKETS)
        if total is None:
            out.append(np.unique(np.concatenate(found), return_counts=True))
        else:
            at = np.flatnonzero(total)
            out.append((at, total[at]))
    return out


def train(rows: list[list[tuple[np.ndarray, np.ndarray]]], labels: list[str], seed: int = 7) -> LanguageModel:
    """Fits embeddings and softmax by SGD, then temperature and rejection on every fifth document.

    ``rows``: of each document its features, of the whole text first, then of a short cut of it.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(languages)}
    order = rng.permutation(len(rows)).tolist()
    data = [(rows[i], number[labels[i]]) for i in order]
    held, fit = data[::5], [x for i, x in enumerate(data) if i % 5 or len(data) < 5]
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    w += rng.normal(0, 0.1, w.shape)
    steps = EPOCHS * len(fit) * 2
    done = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            row, y = fit[k]
            for bucket, count in row:
                rate = 0.5 * (1 - done / steps)
                done += 1
                total = count.sum()
                if not total:
                    continue
                share = count / total
                x = share @ e[bucket]
                z = x @ w + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                g = w @ p
                w -= rate * np.outer(x, p)
                bias -= 0.1 * rate * p
                # a feature's step follows its share of the document, scaled up as documents hold many
                e[bucket] -= (rate * 20) * share[:, None] * g[None, :]
    model = LanguageModel(languages, e @ w, bias)
    z = np.array([model.table[row[0][0]].T @ (row[0][1] / max(1, row[0][1].sum())) + bias for row, _ in held])
    y = np.array([y for _, y in held])

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.25, 8, 26).tolist(), key=loss)
    p = model.probabilities(z)
    right = p.argmax(axis=1) == y
    # what nearly every rightly named document exceeds; never more than an even chance
    model.reject_below = float(min(0.5, np.quantile(p.max(axis=1)[right], 0.001))) if right.any() else 0.0
    return model


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> LanguageModel:
    """A model from at most ``per_language`` labelled rows of each language and ``most_rows`` of all (one of each language at
    least), those with the least hashes of doc_id and text; rows whose crc32(doc_id as text) mod 4 is 2 are never seen."""
    read = doc_columns(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang is not null and text is not null")
    read = read.where(F.crc32(_id_text()) % 4 != 2).withColumn("by", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    counts = written(read.groupBy("lang").count(), "languages")  # one row a language
    most = max(1, min(per_language, most_rows // max(1, counts.count())))
    limit = F.lit(2.0 * most + 50) / F.col("count") * (1 << 40)
    low = read.join(counts, "lang").where(F.col("by") < limit).select("lang", "by").distinct()  # about 2 * most + 50 a language
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("by"))).where(F.col("r") <= most).select("lang", "by")
    sample = read.join(F.broadcast(chosen), ["lang", "by"]).groupBy("lang", "by").agg(F.any_value("text").alias("text"))  # at most ``most_rows`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                by, data, offsets = piece.column(1).to_numpy(), *raw(piece.column(2))
                cuts = []
                for i, k in enumerate(by.tolist()):
                    body = data[offsets[i] : offsets[i + 1]]
                    at = int(np.random.default_rng(k).integers(0, max(1, len(body) - SHORT + 1)))
                    cuts.append(body[at : at + SHORT].tobytes())
                columns = [piece.column(0), piece.column(1)]
                for found in (counted(piece.column(2)), counted(pa.array(cuts, pa.large_binary()))):
                    edges = np.append(0, np.cumsum([len(x) for x, _ in found]))
                    columns += [pa.LargeListArray.from_arrays(edges, np.concatenate([x[k] for x in found]).astype(t)).cast(pa.list_(pa.from_numpy_dtype(t))) for k, t in enumerate((np.int16, np.int32))]
                yield pa.record_batch(columns, names=["lang", "by", "bucket", "times", "short", "short_times"])

    got = sample.mapInArrow(run, "lang string, by long, bucket array<short>, times array<int>, short array<short>, short_times array<int>").toArrow()  # at most ``most_rows`` rows of BUCKETS numbers
    drop(counts)
    rows, labels = [], []
    for batch in got.to_batches():  # views of the numbers, no copies
        part = [(np.asarray(batch[c].values), np.asarray(batch[c].offsets)) for c in ("bucket", "times", "short", "short_times")]
        cut = lambda k, i: part[k][0][part[k][1][i] : part[k][1][i + 1]]  # noqa: B023, E731
        rows += [[(cut(0, i), cut(1, i)), (cut(2, i), cut(3, i))] for i in range(batch.num_rows)]
        labels += batch["lang"].to_pylist()
    order = np.lexsort((np.array(labels, str), got["by"].to_numpy())).tolist() if labels else []
    model = train([rows[i] for i in order], [labels[i] for i in order])
    del rows, got
    pa.default_memory_pool().release_unused()
    return model


def _id_text():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")


def _judge(text: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language or one past the last for ``und``, score, whether rejected) of every text."""
    known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(model.languages)
    best, score = np.full(len(text), len(model.languages)), np.zeros(len(text))
    if known.any():
        p = model.probabilities(logits(text, model))
        best = np.where(known, p.argmax(axis=1), best)
        score = np.where(known, p.max(axis=1), 0.0)
    return best, score, ~known | (score < model.reject_below)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for piece in pieces(batch, "text"):
                best, score, rejected = _judge(piece.column(1), model)
                yield pa.record_batch([piece.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    read = doc_columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all their columns unchanged; judged where they lie."""
    model = fit_languages(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                yield piece.filter(pa.array(~_judge(piece.column(at), model)[2]))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (F.crc32(_id_text()) % 4 == 2).alias("held_out")
    return predict(docs, fit_languages(docs)).select("doc_id", held_out, "lang_pred", "score", "rejected")
