"""Vectors: dot products, sign codes, Hamming, int8, PCA, k-means lists, probing, and encoders as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalise(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x / norm)


def sign_code(v: Column, word: int = 0, bits: int = 64) -> Column:
    """One 64-bit word of the signs of ``v``: bit b is v[64 * word + b] > 0."""
    part = F.slice(v, word * bits + 1, bits)
    marks = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def int8(v: Column) -> tuple[Column, Column]:
    """(values, scale): value / scale * 127, half to even, clipped; scale is the largest magnitude, 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top).otherwise(1.0)
    of = lambda one: F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x.cast("double") / one * 127))).cast("int"))
    return F.element_at(F.transform(F.array(scale), of), 1), scale  # the scale once a vector, not once a value


def int8_query(v: Column) -> Column:
    """A unit query's values times 127, half up, clipped."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.floor(x.cast("double") * 127 + 0.5).cast("double"))).cast("int"))


def int8_cosine(q: Column, p: Column, scale: Column) -> Column:
    total = F.aggregate(F.zip_with(q, p, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return total / 16129 * scale


def pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """A stated query set against all rows: the queries are the side that is sent round."""
    return vectors.crossJoin(queries)


def top_k(hits: DataFrame, k: int, score: Column, better_high: bool = True) -> DataFrame:
    order = [F.desc("score") if better_high else F.asc("score"), "vec_id"]
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


#: Queries held by one task of ``nearest``, and pairs that a task meets (more slices beyond it).
QUERY_BLOCK, TASK_PAIRS = 16_384, 1 << 31
_EMPTY, _NO_SCORE = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1


def _half_up(x: np.ndarray) -> np.ndarray:
    """``x`` times a million as whole numbers, halves of the shortest decimal away from zero: Spark's ``round(x, 6)``."""
    y = np.abs(x) * 1e6
    low = np.floor(y)
    out = low + (y - low >= 0.5)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-7 + y * 1e-15):
        out[i] = int((abs(Decimal(repr(float(x[i])))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return np.where(x < 0, -out, out).astype(np.int64)


class _Cosine:
    """Dot products; those of blocks by a matrix product, and in order only where its last bits could change the sixth place."""

    def queries(self, e: np.ndarray, code: np.ndarray | None) -> None:
        self.none = ~np.isfinite(e).all(axis=1)
        self.q = np.where(self.none[:, None], 0.0, e)
        self.most = np.sqrt((self.q * self.q).sum(axis=1).max(initial=0.0))

    def vectors(self, e: np.ndarray, code: np.ndarray | None) -> None:
        self.gone = ~np.isfinite(e).all(axis=1)
        self.v = np.where(self.gone[:, None], 0.0, e)
        self.err = 1e-9 + e.shape[1] * 1e-15 * 1e6 * self.most * np.sqrt((self.v * self.v).sum(axis=1).max(initial=0.0))  # in millionths

    def _scores(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        return self.q[a:b] @ self.v[c:d].T

    def _keys(self, s: np.ndarray, qi: np.ndarray, vj: np.ndarray) -> np.ndarray:
        y = np.abs(s) * 1e6
        near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) <= self.err + 1e-7 + y * 1e-15)
        exact = np.zeros(len(near))
        for j in range(self.q.shape[1]):
            exact += self.q[qi[near], j] * self.v[vj[near], j]
        s[near] = exact
        return _half_up(s)

    def better(self, a: int, b: int, c: int, d: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, key) of the pairs of two blocks whose key may be above the query's ``kth``."""
        s = self._scores(a, b, c, d)
        s[self.none[a:b]] = -np.inf
        s[:, self.gone[c:d]] = -np.inf
        floor = np.where(kth == _EMPTY, -np.inf, np.where(kth == _NO_SCORE, np.finfo(float).min, (kth + 0.5 - self.err - 1e-6 - np.abs(kth) * 1e-15) / 1e6))
        qi, vj = np.nonzero(s >= floor[:, None])
        s = s[qi, vj]
        scored = np.isfinite(s)
        key = np.full(len(s), _NO_SCORE)
        key[scored] = self._keys(s[scored], qi[scored] + a, vj[scored] + c)
        return qi + a, vj + c, key


class _Int8(_Cosine):
    """Products of int8 values, which are whole numbers, by a matrix product; then the vector's scale."""

    def queries(self, e: np.ndarray, code: np.ndarray | None) -> None:
        super().queries(e, code)
        self.q = np.clip(np.floor(self.q * 127 + 0.5), -128, 127)
        self.most = 1.0

    def vectors(self, e: np.ndarray, code: np.ndarray | None) -> None:
        super().vectors(e, code)
        top = np.abs(self.v).max(axis=1, initial=0.0)
        self.scale = np.where(top > 0, top, 1.0)
        self.v = np.clip(np.rint(self.v / self.scale[:, None] * 127), -128, 127)
        self.err = 1e-6

    def _scores(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        return self.q[a:b] @ self.v[c:d].T / 16129 * self.scale[c:d]

    def _keys(self, s: np.ndarray, qi: np.ndarray, vj: np.ndarray) -> np.ndarray:
        return _half_up(s)


class _Hamming:
    """Bits that differ, as keys below zero; ``code`` is (word, whether there is none)."""

    def queries(self, e: np.ndarray | None, code: np.ndarray) -> None:
        self.q, self.none = np.ascontiguousarray(code[:, 0]), code[:, 1] > 0

    def vectors(self, e: np.ndarray | None, code: np.ndarray) -> None:
        self.v, self.gone = np.ascontiguousarray(code[:, 0]), code[:, 1] > 0

    def better(self, a: int, b: int, c: int, d: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dist = np.bitwise_count(self.q[a:b, None] ^ self.v[None, c:d])
        dist[self.none[a:b]] = 254
        dist[:, self.gone[c:d]] = 254
        most = np.where(kth == _EMPTY, 255, np.where(kth == _NO_SCORE, 254, -kth)).astype(np.uint8)
        qi, vj = np.nonzero(dist < most[:, None])
        got = dist[qi, vj]
        return qi + a, vj + c, np.where(got == 254, _NO_SCORE, -got.astype(np.int64))


#: Measures by the strategy they stand for: cosine and int8 cosine times a million, and minus the Hamming distance.
MEASURES = {"whole": _Cosine, "sentence": _Hamming, "semantic": _Int8}


class _Best:
    """The best ``k`` of each query by a measure, of vectors that come in order of id."""

    def __init__(self, measure: _Cosine | _Hamming, ids: np.ndarray, k: int, skip_self: bool):
        self.measure, self.ids, self.k, self.skip_self = measure, ids, k, skip_self
        self.key, self.id = np.full((len(ids), k), _EMPTY), np.zeros((len(ids), k), np.int64)

    def meet(self, vec_ids: np.ndarray, seen: int, block: int = 1024) -> None:
        for a in range(0, len(self.ids), block):
            b, at, held = min(a + block, len(self.ids)), 0, []
            while at < len(vec_ids):
                to = min(len(vec_ids), at + min(block, max(32, seen + at)))  # few vectors as long as all of them are new bests
                qi, vj, key = self.measure.better(a, b, at, to, self.key[a:b, -1])
                other = self.ids[qi] != vec_ids[vj] if self.skip_self else slice(None)
                held.append((qi[other], vec_ids[vj[other]], key[other]))
                at = to
                if at == len(vec_ids) or sum(len(h[0]) for h in held) > 4 * self.k * (b - a) or seen + at < 8 * block:
                    self._merge(held)
                    held = []

    def _merge(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        qi, ids, key = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(qi):
            return
        met = np.unique(qi)
        q = np.concatenate([np.repeat(met, self.k), qi])
        ids, key = np.concatenate([self.id[met].reshape(-1), ids]), np.concatenate([self.key[met].reshape(-1), key])
        order = np.lexsort((ids, ~key, q))
        first = np.searchsorted(q[order], met)
        order = order[(first[:, None] + np.arange(self.k)).reshape(-1)]
        self.id[met], self.key[met] = ids[order].reshape(-1, self.k), key[order].reshape(-1, self.k)


def nearest(vectors: DataFrame, queries: DataFrame, strategies: tuple[str, ...], k: int, skip_self: bool = True) -> DataFrame:
    """(query_id, strategy, vec_id, key, rank): the exact best ``k`` by each of ``MEASURES``, ties by smaller id.

    ``vectors`` (vec_id, embedding, code), ``queries`` (query_id, embedding, code), of which Hamming distances need codes only and
    the others embeddings only. Every query meets every vector, but no pair is a row: blocks of queries are dealt with slices of
    the vectors, a task streams its slice past its block, and only each slice's best go on. ``key`` is null without a vector.
    """
    spark = vectors.sparkSession
    columns = [c for c, needed in (("embedding", {"whole", "semantic"}), ("code", {"sentence"})) if needed & set(strategies)]
    v = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), *columns)
    q = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("id"), *columns)
    n, asked = v.count(), q.count()
    blocks = max(1, -(-asked // QUERY_BLOCK))
    slices = max(1, -(-spark.sparkContext.defaultParallelism // blocks), -(-n * -(-asked // blocks) // TASK_PAIRS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    v = v.select(F.lit(1).alias("side"), "*", one_of(slices).alias("slice"), every(blocks).alias("block"))
    q = q.select(F.lit(0).alias("side"), "*", every(slices).alias("slice"), one_of(blocks).alias("block"))
    dealt = v.unionByName(q).repartitionById(blocks * slices, (F.col("block") * slices + F.col("slice")).cast("int")).sortWithinPartitions("side", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best, seen = [], None, 0

        def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {"id": batch.column("id").to_numpy()}
            if "embedding" in columns:
                e = batch.column("embedding")
                width = pc.list_value_length(e)
                some = pc.max(width).as_py() or 0
                if e.null_count or pc.min(width).as_py() != some:  # a null, or one of another length, has no score
                    e = pa.array([x if x is not None and len(x) == some else [None] * some for x in e.to_pylist()], pa.list_(pa.float64()))
                out["embedding"] = np.array(e.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(len(e), some)
            if "code" in columns:
                c = batch.column("code")
                out["code"] = np.column_stack([c.fill_null(0).to_numpy().view(np.uint64), c.is_null().to_numpy(zero_copy_only=False)]).astype(np.uint64)
            return out

        for batch in batches:
            side = batch.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if cut:
                asked.append(arrays(batch.slice(0, cut)))
            rest = batch.slice(cut)
            if not len(rest) or not asked:
                continue
            if best is None:
                ids = np.concatenate([x["id"] for x in asked])
                full = [np.concatenate([x[c] for x in asked]) if c in columns else None for c in ("embedding", "code")]
                best = []
                for s in strategies:
                    best.append(_Best(MEASURES[s](), ids, k, skip_self))
                    best[-1].measure.queries(*full)
            x = arrays(rest)
            for one in best:
                one.measure.vectors(x.get("embedding"), x.get("code"))
                one.meet(x["id"], seen)
            seen += len(rest)
        for s, one in zip(strategies, best or (), strict=bool(best)):
            for a in range(0, len(one.ids), 4096):
                key, ids = one.key[a : a + 4096].reshape(-1), one.id[a : a + 4096].reshape(-1)
                there = key != _EMPTY
                key = key[there]
                out = [np.repeat(one.ids[a : a + 4096], k)[there], ids[there]]
                yield pa.record_batch([pa.array(out[0]), pa.array([s] * len(key), pa.string()), pa.array(out[1]), pa.array(key, mask=key == _NO_SCORE)], names=["query_id", "strategy", "vec_id", "key"])

    found = dealt.mapInArrow(search, "query_id long, strategy string, vec_id long, key long")
    w = Window.partitionBy("query_id", "strategy").orderBy(F.desc_nulls_last("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long float lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def tree_sum(parts: DataFrame, fan: int = 16) -> np.ndarray:
    """The sum of the binary rows of doubles (column ``x``) of ``parts``, added up ``fan`` by ``fan`` in executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()])], names=["x"])

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "x binary")
    rows = parts.collect()  # one row a partition, ``fan`` at most
    return np.sum([np.frombuffer(r["x"]) for r in rows], axis=0)


def pca_fit(vectors: DataFrame, col: str, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, components x dim, share of variance kept), from one scan that adds up sums and products."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0.0, None, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, total, gram = n + len(x), x.sum(axis=0) + (0 if total is None else total), x.T @ x + (0 if gram is None else gram)
        if n:
            yield pa.record_batch([pa.array([np.concatenate([[n], total, gram.reshape(-1)]).tobytes()])], names=["x"])

    sums = tree_sum(vectors.where(F.col(col).isNotNull()).select(col).mapInArrow(partial, "x binary"))
    dim = int((np.sqrt(4 * len(sums) - 3) - 1) / 2 + 0.5)
    mean = sums[1 : dim + 1] / sums[0]
    cov = sums[dim + 1 :].reshape(dim, dim) / sums[0] - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]  # the largest loading is positive
    return mean, axes, float(values[order].sum() / values.sum())


def pca_project(vectors: DataFrame, col: str, mean: np.ndarray, axes: np.ndarray, out: str = "reduced") -> DataFrame:
    """Centred, projected, of unit length again."""

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        x = (np.array(s.tolist(), float) - mean) @ axes.T
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return pd.Series(list(x))

    return vectors.withColumn(out, project(col))


def stratified_sample(vectors: DataFrame, by: str, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows, as many of each value of ``by``: those with the least hashes of their ids."""
    n = vectors.groupBy(by).agg(F.count("*").alias("rows"))  # one row a value
    each = F.ceil(F.lit(most) / F.count("*").over(Window.partitionBy()))
    limit = n.select(F.col(by).alias("of"), (each / F.col("rows") * (1 << 40)).alias("limit"))
    return vectors.join(F.broadcast(limit), F.col(by).eqNullSafe(F.col("of"))).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < F.col("limit")).drop("of", "limit")


def nlist(n: int) -> int:
    """Lists of an index over ``n`` vectors."""
    return int(min(4096, max(128, round(2 * n**0.5))))


def kmeans_lists(vectors: DataFrame, col: str, k: int, seed: int = 7, rounds: int = 20) -> np.ndarray:
    """Unit centroids by spherical k-means (Lloyd): a round adds up k sums in executors, one binary row a partition."""
    first = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select(col).limit(k).toArrow()  # k rows
    start = _matrix(first[col])
    centres = start / np.maximum(np.linalg.norm(start, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        now = centres

        def add(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for batch in batches:
                x = _matrix(batch.column(0))
                if len(x):
                    np.add.at(total, (x @ now.T).argmax(axis=1), x)
            yield pa.record_batch([pa.array([total.tobytes()])], names=["x"])

        total = tree_sum(vectors.where(F.col(col).isNotNull()).select(col).mapInArrow(add, "x binary")).reshape(centres.shape)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
        if np.abs(new - centres).max() < 1e-6:
            break
        centres = new
    return centres


def assign_lists(vectors: DataFrame, col: str, centres: np.ndarray) -> DataFrame:
    """``vectors`` with ``list_id``: the centroid with the largest dot product (to six places), the earlier on a tie."""

    @F.pandas_udf("int")
    def nearest(s: pd.Series) -> pd.Series:
        return pd.Series((np.array(s.tolist(), float) @ centres.T).round(6).argmax(axis=1).astype("int32"))

    return vectors.withColumn("list_id", nearest(col))


def write_lists(vectors: DataFrame, path: str) -> None:
    """The stored layout of an index: a folder a list, so a search reads only the lists it probes."""
    vectors.repartition("list_id").sortWithinPartitions("list_id", "vec_id").write.partitionBy("list_id").parquet(path)


def nearest_lists(queries: DataFrame, centroids: DataFrame, nprobe: int, prefix: int | None = None) -> DataFrame:
    """(query_id, list_id, list_rank, and the query's columns): each query's ``nprobe`` nearest lists.

    With ``prefix`` three times as many are chosen first by that many leading dimensions.
    """
    near = queries.crossJoin(F.broadcast(centroids))  # 4096 centroids at most
    if prefix:
        lead = lambda c: F.slice(c, 1, prefix)
        near = near.withColumn("rough", F.round(dot(lead(F.col("embedding")), lead(F.col("centroid"))), 6))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "list_id"))).where(F.col("r") <= 3 * nprobe).drop("r", "rough")
    near = near.withColumn("sim", F.round(dot(F.col("embedding"), F.col("centroid")), 6)).drop("centroid")
    return near.withColumn("list_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "list_id"))).where(F.col("list_rank") <= nprobe)


def probe(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, k: int, cap: int | None = None, prefix: int | None = None, bits: int = 64) -> DataFrame:
    """IVF search: (query_id, parent, vec_id, dist, score, rank).

    ``vectors`` (vec_id, parent, list_id, code), ``queries`` (query_id, embedding, code), ``centroids`` (list_id, centroid).
    A query joins only its nearest lists, ``cap`` candidates of them in list order; they are ranked by Hamming distance,
    then list rank, then id. Of the first ``4 k`` each parent counts once, and ``k`` of these stay, so fewer may come back.
    """
    lists = nearest_lists(queries, centroids, nprobe, prefix)
    if cap:  # candidates come in order of lists and ids, so of a list no query takes more than its first ``cap``
        first = F.row_number().over(Window.partitionBy("list_id").orderBy("vec_id"))
        vectors = F.broadcast(vectors.withColumn("nth", first).where(F.col("nth") <= cap).drop("nth"))  # ``cap`` rows a list
    found = lists.select("query_id", "list_id", "list_rank", F.col("code").alias("query_code")).join(vectors, "list_id")
    if cap:
        found = found.withColumn("seen", F.row_number().over(Window.partitionBy("query_id").orderBy("list_rank", "vec_id"))).where(F.col("seen") <= cap)
    found = found.withColumn("dist", hamming(F.col("code"), F.col("query_code")))
    order = ["dist", "list_rank", "vec_id"]
    head = found.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("at") <= 4 * k)
    one = head.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "parent").orderBy("at"))).where("nth = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "parent", "vec_id", "dist", (1 - F.col("dist") / bits).alias("score"), "rank")


def flat_search(chunks: DataFrame, queries: DataFrame, k: int, pool: int = 512, bits: int = 64) -> DataFrame:
    """Exact search of user chunks: (query_id, strategy, parent, dist, score, rank).

    ``chunks`` (vec_id, strategy, parent, code) of the sources that are on. The ``pool`` nearest of all strategies together,
    of which the first ``6 k`` go to their strategies' lists: each parent once a list, ``k`` at most.
    """
    found = nearest(chunks.select("vec_id", "code"), queries.select("query_id", "code"), ("sentence",), min(pool, 6 * k), skip_self=False)
    near = found.select("query_id", "vec_id", (-F.col("key")).alias("dist"), F.col("rank").alias("at")).join(chunks.select("vec_id", "strategy", "parent"), "vec_id")
    one = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "strategy", "parent").orderBy("at"))).where("nth = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "strategy").orderBy("at")).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "strategy", "parent", "dist", (1 - F.col("dist") / bits).alias("score"), "rank")


def rescore(fused: DataFrame, queries: DataFrame, table: DataFrame, first: int = 16) -> DataFrame:
    """(query_id, id, cosine, place): the first ``first`` fused hits by int8 cosine.

    ``fused`` (query_id, id, place), ``queries`` (query_id, q8), ``table`` (id, p8, scale): one row a passage.
    """
    x = fused.where(F.col("place") <= first).select("query_id", "id", F.col("place").alias("before")).join(table, "id").join(queries, "query_id")
    x = x.withColumn("cosine", F.round(int8_cosine(F.col("q8"), F.col("p8"), F.col("scale")), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "before")).cast("long")
    return x.withColumn("place", place).select("query_id", "id", "cosine", "place")


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without weights: signed hashes of a text's words, added up. Stands in where no model is at hand."""

    def encode(texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        return out

    return encode


def embed(rows: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "passage: ", together: int = 64, out: str = "embedding", by_length: int | None = None) -> DataFrame:
    """``rows`` with unit vectors of their texts; null counts as empty.

    ``encoder`` is called once a task and gives the function that encodes a list of texts. With ``by_length`` rows are first
    dealt to that many ranges of text length and sorted, so that texts of a batch are about equally long.
    """
    if by_length:
        rows = rows.repartitionByRange(by_length, F.length(text_col)).sortWithinPartitions(F.length(text_col))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for s in batches:
            texts = [prefix + (x or "") for x in s]
            parts = [np.asarray(encode(texts[i : i + together]), float) for i in range(0, len(texts), together)]
            x = np.concatenate(parts) if parts else np.zeros((0, 1))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield pd.Series(list(x))

    return rows.withColumn(out, run(text_col))
