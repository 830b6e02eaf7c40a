"""Language-model scoring with Brown class n-grams.

Every word of the training documents has a class. The HEAD most frequent ones are put into classes by exchange clustering on
the driver: each word moves to the class with which the class bigrams of the corpus are most likely, until no word moves.
All others are assigned in executors, PASSES times over: the classes to the left and right of each word are counted in
a table, and each word takes the class that makes these neighbours likeliest; in the first pass only head words have a class,
then the COUNTED most frequent words do. All words start in one class, which a word leaves only where its neighbours tell
more than naming another class costs, so a word seen once does not take a class by chance. The number of classes grows with the vocabulary (``class_count``). The end of a
document is a class of its own.

A word's probability is the transition from the class before it, smoothed towards the class's own frequency, times its share
of its class, each count plus one. Words that are not in the training documents count as one word of the class that has most
words seen once. Transitions come from the classes of all words. Only class bigrams and the COUNTED most frequent words reach
the driver; the rest of a document's words meet their classes and counts in a join.

Defined results: null text counts as empty, one end token; null doc_ids hash as the empty text; repeated rows are separate
documents; words equally frequent are taken in the order of their hashes, and of classes as good the first; a text of any
length is one sequence; with no training document every token is unknown; an empty table gives an empty result; extra columns
never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import doc_columns, drop, release, written
from quillon.llm.textkit import pieces, word_hashes
from quillon.session import table

HEAD = 1000
CLASSES = 48
COUNTED = 200_000
#: Words of the vocabulary with which the number of classes is CLASSES; it grows with the fourth root of the vocabulary.
CLASSED = 100_000
PASSES = 2
#: Words a task counts before it passes its counts on.
TOGETHER = 1_500_000
PRIOR = 20.0


@dataclass
class ClassModel:
    counted: np.ndarray  # sorted hashes of the counted words, and their counts
    counts: np.ndarray
    symbol_class: np.ndarray  # class of each counted word, then of words not in the table ``lookup`` and of the end
    lookup: DataFrame  # word, n, class of every word but the head's
    size_log: np.ndarray  # log10 of what a word's count + 1 is divided by, by class; 0 for the end
    tokens: int
    distinct: int
    documents: int


def class_count(types: int, classes: int = CLASSES) -> int:
    return max(classes, round(classes * (types / CLASSED) ** 0.25))


def _grow(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.append(keys, more), return_inverse=True)
    return both, np.bincount(at, weights=np.append(counts, n), minlength=len(both)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each lower-cased word, by its 64-bit hash, occurs in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        emit = lambda: pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, _ = word_hashes(piece.column(0), lower=True)
                keys, counts = _grow(keys, counts, *np.unique(words, return_counts=True))
                if len(keys) > TOGETHER:
                    yield emit()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield emit()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(texts: DataFrame, head: np.ndarray, symbol_class: np.ndarray | None = None) -> np.ndarray:
    """Bigrams of symbols: the head words, any other word, and the end, which is also what comes before the first word; or of their classes."""
    size = len(head) + 2 if symbol_class is None else int(symbol_class.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                symbols = _symbols(*word_hashes(piece.column(0), lower=True), head)
                symbols = symbols if symbol_class is None else symbol_class[symbols]
                now, n = np.unique(symbols[:-1] * size + symbols[1:], return_counts=True)
                keys, counts = _grow(keys, counts, now, n)
        yield pa.record_batch([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    pairs = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size, np.int64)
    found = pairs.toArrow()  # at most the square of HEAD + 2 or of the classes in rows
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _symbols(words: np.ndarray, first: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Symbol numbers of all documents in a row: an end before the first and after each."""
    tail, end = len(head), len(head) + 1
    at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
    known = head[at] == words if len(head) else np.zeros(len(words), bool)
    return np.append(end, np.insert(np.where(known, at, tail), first[1:], end))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int | None = None) -> np.ndarray:
    """Classes of the symbols of a bigram table, after ``rounds`` passes or when no word moves; the last two symbols keep classes of their own (the last two)."""
    size = len(bigrams)
    words, free = size - 2, max(1, min(classes, size - 2))
    by_count = np.argsort(-(bigrams.sum(axis=0)[:words]), kind="stable")
    own = np.empty(size, np.int64)
    own[by_count] = np.arange(words) % free
    own[words:] = [free, free + 1]
    k = free + 2
    member = np.zeros((size, k))
    member[np.arange(size), own] = 1
    to, frm = bigrams @ member, bigrams.T @ member  # each symbol's successors and predecessors by class
    n = member.T @ to
    least = max(1e-6, 1e-14 * float(_xlogx(np.float64(n.sum()))))  # above rounding errors, or moves could go round in a circle
    done, moved = 0, 1
    while moved and done != rounds:
        done, moved = done + 1, 0
        for w in by_count.tolist():
            a, same = own[w], float(bigrams[w, w])
            right, left = to[w].copy(), frm[w].copy()
            right[a] -= same
            left[a] -= same
            base = n.copy()  # the table without w
            base[a, :] -= right
            base[:, a] -= left
            base[a, a] -= same
            rows, columns = base.sum(axis=1) + left, base.sum(axis=0) + right
            total_r, total_c = right.sum() + same, left.sum() + same
            # with w in class c: row c gains ``right``, column c gains ``left``, their corner also w's own bigram
            gain = (_xlogx(base + right[None, :]) - _xlogx(base)).sum(axis=1) + (_xlogx(base + left[:, None]) - _xlogx(base)).sum(axis=0)
            corner = np.diag(base)
            gain += _xlogx(corner + right + left + same) - _xlogx(corner + right) - _xlogx(corner + left) + _xlogx(corner)
            gain -= _xlogx(rows + total_r) - _xlogx(rows) + _xlogx(columns + total_c) - _xlogx(columns)
            best = int(np.argmax(np.round(gain[:free], 6)))
            if best != a and gain[best] > gain[a] + least:
                moved += 1
                own[w] = best
                to[:, best] += bigrams[:, w]
                to[:, a] -= bigrams[:, w]
                frm[:, best] += bigrams[w, :]
                frm[:, a] -= bigrams[w, :]
                base[best, :] += right
                base[:, best] += left
                base[best, best] += same
                n = base
    return own


def _transitions(bigrams: np.ndarray) -> np.ndarray:
    """Probability of each class after each, smoothed towards its own frequency."""
    mass = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + len(bigrams))
    return (bigrams + PRIOR * mass[None, :]) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)


def _word_places(first: np.ndarray) -> np.ndarray:
    """Where the words are among the symbols of ``_symbols``."""
    n = len(first) - 1
    return np.arange(first[-1]) + np.repeat(np.arange(n), np.diff(first)) + 1


def assign(texts: DataFrame, known: np.ndarray, symbol_class: np.ndarray, skip: np.ndarray, bigrams: np.ndarray) -> DataFrame:
    """(word, n, class): for every word not in ``skip`` the class that makes the classes beside it in ``texts`` likeliest.

    A class other than that of all words without one (the last but one) must also make up for being named, log(classes).
    ``known``: the sorted words with a class so far; ``bigrams``: of classes, the last two those of other words and the end.
    """
    k = len(bigrams)
    p = _transitions(bigrams)
    after, before = np.log(p[:, : k - 1]), np.log(p[: k - 1]).T
    size = np.log(bigrams.sum(axis=0)[: k - 1] + 1.0)
    naming = np.append(np.full(k - 2, np.log(k - 1)), 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 16 << 20):
                words, first = word_hashes(piece.column(0), lower=True)
                cls = symbol_class[_symbols(words, first, known)]
                places = _word_places(first)
                if len(skip):
                    other = skip[np.minimum(np.searchsorted(skip, words), len(skip) - 1)] != words
                    words, places = words[other], places[other]
                u, owner = np.unique(words, return_inverse=True)
                keys, n = np.unique(np.append(owner * (2 * k) + cls[places - 1], owner * (2 * k) + k + cls[places + 1]), return_counts=True)
                edges = pa.array(np.searchsorted(keys, np.arange(len(u) + 1) * (2 * k)), pa.int32())
                columns = [pa.array(u.view(np.int64)), pa.ListArray.from_arrays(edges, pa.array((keys % (2 * k)).astype(np.int16))), pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))]
                yield pa.record_batch(columns, names=["word", "beside", "times"])

    def choose(words: np.ndarray, beside: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        u, owner = np.unique(words, return_inverse=True)
        m = np.bincount(owner * (2 * k) + beside, weights=times, minlength=len(u) * 2 * k).reshape(len(u), 2 * k)
        n = m[:, :k].sum(axis=1)
        gain = m[:, :k] @ after + m[:, k:] @ before - n[:, None] * size[None, :] - naming[None, :]
        return pa.record_batch([pa.array(u), pa.array(n.astype(np.int64)), pa.array(np.argmax(np.round(gain, 6), axis=1).astype(np.int32))], names=["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:  # sorted by word; the last word may go on in the next batch
            times = pa.array(batch.column(2)).value_lengths().to_numpy()
            more = (np.repeat(batch.column(0).to_numpy(), times), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
            words, *rest = (np.append(x, y) for x, y in zip(held, more, strict=True))
            if not len(words):
                continue
            cut = int(np.argmax(words == words[-1]))
            if cut:
                yield choose(words[:cut], *(x[:cut] for x in rest))
            held = (words[cut:], *(x[cut:] for x in rest))
        if len(held[0]):
            yield choose(*held)

    rows = texts.mapInArrow(count, "word long, beside array<short>, times array<int>")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, class int")


def fit(train: DataFrame, vocabulary: DataFrame, head: int = HEAD, classes: int = CLASSES, counted: int = COUNTED) -> ClassModel:
    """The classes of all words of ``train`` (text); ``vocabulary`` is its table of word counts."""
    spark = train.sparkSession
    documents = train.count()
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words, types = int(sums["n"] or 0), int(sums["v"])
    most = vocabulary.orderBy(F.desc("n"), "word").limit(counted).toArrow()  # at most COUNTED rows
    keys, n = most["word"].to_numpy().view(np.uint64), most["n"].to_numpy()
    top, top_n = keys[:head], n[:head]
    order = np.argsort(top)
    top, top_n = top[order], top_n[order]
    bigrams = count_bigrams(train, top)
    head_class = exchange(bigrams, class_count(types, classes))
    k = int(head_class.max()) + 1
    member = np.zeros((len(head_class), k))
    member[np.arange(len(head_class)), head_class] = 1
    known, symbol_class, lookup = top, head_class, None
    for step in range(PASSES):
        table_ = member.T @ bigrams @ member if step == 0 else count_bigrams(train, known, symbol_class)
        last = lookup
        lookup = written(assign(train, known, symbol_class, top, table_), "classes")
        if last is not None:
            drop(last)
        release(spark)
        found = lookup.orderBy(F.desc("n"), "word").limit(max(0, counted - len(top))).toArrow()  # at most COUNTED rows
        known = np.append(top, found["word"].to_numpy().view(np.uint64))
        order = np.argsort(known)
        known = known[order]
        symbol_class = np.append(np.append(head_class[: len(top)], found["class"].to_numpy())[order], [k - 2, k - 1])
    counts = np.append(top_n, found["n"].to_numpy())[order]
    size, once = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in lookup.groupBy("class").agg((F.sum("n") + F.count("*")).alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():  # a row a class
        size[r["class"]], once[r["class"]] = r["n"], r["once"]
    np.add.at(size, head_class[: len(top)], top_n + 1)
    np.add.at(once, head_class[: len(top)], top_n == 1)
    new = int(np.argmax(once[: k - 1]))
    symbol_class[-2] = new
    size[new] += 1
    size_log = np.log10(np.maximum(size, 1))
    size_log[k - 1] = 0
    return ClassModel(known, counts, symbol_class, lookup, size_log, words + documents, types + (documents > 0), documents)


def classed(docs: DataFrame, model: ClassModel) -> DataFrame:
    """``docs`` (doc_id, text, train) as doc_id, train, n_tokens, n_known, base_score, log (sum of log10 of counts + 1), seq (classes, the end first and last)."""
    counted, counts, symbol_class = model.counted, model.counts, model.symbol_class
    kind = np.uint8 if len(model.size_log) <= 256 else np.uint16
    unit, of_end, documents = float(np.log10(model.tokens + model.distinct + 1)), float(np.log10(model.documents + 1.0)), model.documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rid = TaskContext.get().partitionId() << 33, 0
        logs = np.log10(np.append(counts, 0) + 1.0)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, first = word_hashes(piece.column(1), lower=True)
                n = len(first) - 1
                symbols = _symbols(words, first, counted)
                places = _word_places(first)
                of_word = symbols[places]
                here = of_word < len(counted)
                sums = lambda x: np.diff(np.append(0, np.cumsum(x))[first])
                seq = symbol_class[symbols].astype(kind)
                ends = first + np.arange(n + 1)  # the end after a document is the one before the next
                rest, away = words[~here], (places - np.repeat(ends[:-1], np.diff(first)))[~here]
                edges = pa.array(np.append(0, np.cumsum(~here))[first], pa.int32())
                columns = [piece.column(0), piece.column(2), pa.array(part + rid + np.arange(n)), pa.array(np.diff(first) + 1), pa.array((sums(here) + (documents > 0)).astype(np.int64)), pa.array(sums(logs[np.minimum(of_word, len(counted))]))]
                columns += [pa.array([seq[a : b + 1].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())]
                columns += [pa.ListArray.from_arrays(edges, pa.array(rest.view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(away.astype(np.int32)))]
                rid += n
                yield pa.record_batch(columns, names=["doc_id", "train", "rid", "n_tokens", "known", "log", "seq", "rest", "away"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(6).to_pylist()
            away, cls = batch.column(7), batch.column(8)
            for i in np.flatnonzero(np.array(away.is_valid())).tolist():
                seq = np.frombuffer(seqs[i], kind).copy()
                seq[away[i].values.to_numpy()] = cls[i].values.to_numpy()
                seqs[i] = seq.tobytes()
            yield pa.record_batch([*batch.columns[:6], pa.array(seqs, pa.binary())], names=names)

    names = ["doc_id", "train", "n_tokens", "n_known", "log", "base_score", "seq"]
    seen = written(docs.mapInArrow(run, "doc_id long, train boolean, rid long, n_tokens long, known long, log double, seq binary, rest array<long>, away array<int>"), "seen")
    rest = seen.select("rid", F.explode(F.arrays_zip("rest", "away")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.away").alias("away"))
    met = rest.join(model.lookup, "word").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("met"), F.collect_list(F.struct("away", "class")).alias("x"))
    log = F.col("log") + F.coalesce("met", F.lit(0.0))
    base = log + F.lit(of_end) - F.col("n_tokens") * F.lit(unit)
    joined = seen.drop("rest", "away").join(met, "rid", "left")
    joined = joined.select("doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), log.alias("log"), base.alias("base_score"), "seq", F.col("x.away").alias("away"), F.col("x.class").alias("class"))
    out = written(joined.mapInArrow(fill, "doc_id long, train boolean, n_tokens long, n_known long, log double, base_score double, seq binary"), "classed")
    drop(seen)
    return out


def steps(seen: DataFrame, model: ClassModel) -> np.ndarray:
    """log10 of each class after each, less the size of the second, from the training documents of ``classed``."""
    k = len(model.size_log)
    kind = np.uint8 if k <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seq = np.frombuffer(x.as_buffer(), kind).astype(np.int64)
                out += np.bincount(seq[:-1] * k + seq[1:], minlength=k * k)
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out[at])], names=["pair", "n"])

    found = seen.where("train").select("seq").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most the square of the classes in rows
    bigrams = np.zeros(k * k, np.int64)
    bigrams[found["pair"].to_numpy()] = found["n"].to_numpy()
    return np.log10(_transitions(bigrams.reshape(k, k))) - model.size_log[None, :]


def score(seen: DataFrame, model: ClassModel, step: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of every row of ``classed``."""
    kind = np.uint8 if len(step) <= 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = (np.frombuffer(x.as_buffer(), kind) for x in batch.column(4))
            total = np.array([step[s[:-1], s[1:]].sum() for s in seqs], float) + batch.column(5).to_numpy()
            yield pa.record_batch([*batch.columns[:4], pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = seen.select("doc_id", "n_tokens", "n_known", "base_score", "seq", "log").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(mod: int = 7, rest: int = 2):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~held_out()).select("text")
    vocabulary = written(count_words(train), "vocabulary")
    model = fit(train, vocabulary)
    read = doc_columns(docs, "doc_id", "text").withColumn("train", ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train")
    seen = classed(read, model)
    return score(seen, model, steps(seen, model)).withColumn("held_out", held_out())
