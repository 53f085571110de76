"""Vector operators: unit length, cosine top-k, nearest-neighbour joins.

Scores are computed with matrix products on Arrow batches inside tasks. Only the best
k rows per query leave a task, so the shuffle carries (tasks x queries x k) rows however
large the archive is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 12  # scores are compared at this precision, so equal vectors tie on every block layout
MAX_BROADCAST_QUERIES = 4096  # above this many queries the join is blocked instead
QUERY_BLOCK, VECTOR_BLOCK = 16_384, 65_536  # rows of a block pair: every vector is copied once per block of queries, and the other way round
BLOCK_VALUES = 1 << 22  # numbers of a block of vectors, so that long vectors make smaller blocks; a quarter of that for queries
LEAST_BLOCKS = 16  # blocks of queries


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x * x))


def mean_vectors(rows: DataFrame, key: list[str], vector: str, name: str) -> DataFrame:
    """Mean vector per key, by a partial aggregation over whole vectors (no exploding of dimensions)."""
    as_vector = rows.select(*key, array_to_vector(F.col(vector)).alias("_v"))
    return as_vector.groupBy(*key).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*key, vector_to_array("_m").alias(name))


def ensemble(prompts: DataFrame, query: list[str], vector: str) -> DataFrame:
    """Query vector as the re-normalised mean of its prompt vectors."""
    return mean_vectors(prompts, query, vector, "_mean").select(*query, unit(F.col("_mean")).alias(vector))


def _matrix(column) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    return rows / lengths


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    return rows / lengths


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        limit = np.partition(-scores, k - 1)[k - 1]
        chosen = np.nonzero(-scores <= limit)[0]
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]


class TopPairs:
    """The k best columns of every query among scores offered block by block, ties by the smaller column.

    Offered scores are single precision. With ``exact``, which gives the scores of (query, column) pairs in double
    precision, everything that is at most ``margin`` below the k-th best is scored again, so the result is that of the exact scores.
    """

    def __init__(self, size: int, k: int, exact=None, margin: float = 0.0):
        self.k, self.exact, self.margin = k, exact, margin
        self.limit = np.full(size, -np.inf, dtype=np.float32)
        self.query, self.column, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.pending, self.waiting = [], 0

    def offer(self, rows: np.ndarray, first: int, scores: np.ndarray) -> None:
        """Scores of the queries ``rows`` and the columns from ``first`` on."""
        width = scores.shape[1]
        if width > self.k:
            fresh = np.nonzero(np.isneginf(self.limit[rows]))[0]
            if len(fresh):  # the k-th best of what is offered first is a limit already
                self.limit[rows[fresh]] = np.partition(scores[fresh], width - self.k, axis=1)[:, width - self.k] - 2 * self.margin
        flat = np.flatnonzero(scores >= self.limit[rows][:, None])
        at, column = np.divmod(flat, width)
        self.pending.append((rows[at], column + first, scores.ravel()[flat]))
        self.waiting += len(flat)
        if self.waiting > max(3 * self.k * len(self.limit), 1 << 16):
            self.settle()

    def _ordered(self, query: np.ndarray, column: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By query, the best score first, ties by the smaller column. Without ``exact`` all three fit into one integer, which sorts many times faster."""
        width = np.uint64(int(column.max(initial=0)).bit_length())
        if self.exact is not None or len(self.limit).bit_length() + int(width) > 32:
            order = np.lexsort((column, -score, query))
            return query[order], column[order], score[order]
        flip = lambda bits: np.where(bits >> 31, bits, np.uint32(0x7FFFFFFF) - bits)  # noqa: E731  # single precision as integers that fall with it
        falling = flip((score.astype(np.float32) + np.float32(0)).view(np.uint32)).astype(np.uint64)
        keys = np.sort((query.astype(np.uint64) << (width + np.uint64(32))) | (falling << width) | column.astype(np.uint64))
        score = flip((keys >> width).astype(np.uint32)).view(np.float32).astype(np.float64)
        return (keys >> (width + np.uint64(32))).astype(np.int64), (keys & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), score

    def settle(self) -> None:
        query, column, score = (np.concatenate(parts) for parts in zip(*self.pending)) if self.pending else (self.query[:0], self.column[:0], self.score[:0])
        if self.exact is not None:
            score = np.concatenate([self.exact(query[i:i + 65_536], column[i:i + 65_536]) for i in range(0, len(query), 65_536)]) if len(query) else score
        query, column, score = np.concatenate([self.query, query]), np.concatenate([self.column, column]), np.concatenate([self.score, score.astype(np.float64)])
        query, column, score = self._ordered(query, column, score)
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = place == self.k - 1
        self.limit[query[last]] = np.maximum(self.limit[query[last]], score[last] - self.margin)
        kept = place < self.k
        self.query, self.column, self.score = query[kept], column[kept], score[kept]
        self.pending, self.waiting = [], 0


def first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k copies of every distinct row; of equal rows no more can be among the k best."""
    if len(rows) <= k:
        return np.arange(len(rows))
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    value = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.argsort(value, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(value[order], value[order])
    return np.sort(order[place < k])


def best_pairs(q: np.ndarray, v: np.ndarray, k: int, query_rows: int = 1024, columns: int = 2048, tile_rows: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers and scores of the k rows of ``v`` nearest to each of ``q`` (both of unit length), ties by row number.

    Scores are computed a tile of ``tile_rows`` by ``columns`` at a time (1 MB, which stays in a core's cache), in the same memory."""
    single_q, single_v = q.astype(np.float32), v.astype(np.float32)
    margin = 2.4e-7 * (q.shape[1] + 16)  # twice what single precision can be off by
    found, tile = [], np.empty(tile_rows * columns, np.float32)
    for start in range(0, len(q), query_rows):
        part, own = q[start:start + query_rows], single_q[start:start + query_rows]
        top = TopPairs(len(part), k, lambda i, j, part=part: np.round(np.einsum("ij,ij->i", part[i], v[j]), SCORE_DIGITS), margin)
        for first in range(0, len(v), columns):
            some = single_v[first:first + columns].T
            for low in range(0, len(part), tile_rows):
                rows = np.arange(low, min(low + tile_rows, len(part)))
                top.offer(rows, first, np.matmul(own[low:low + tile_rows], some, out=tile[:len(rows) * some.shape[1]].reshape(len(rows), -1)))
        top.settle()
        found.append((top.query + start, top.column, top.score))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, keep: list[str] | None = None,
            block_rows: int = QUERY_BLOCK, vector_rows: int = VECTOR_BLOCK) -> DataFrame:
    """Exact k nearest tiles by cosine for every query, per value of the ``keep`` columns.

    ``queries`` has query_id and query_vector, ``vectors`` tile_id and embedding. A query
    set proven small travels to every task, and the archive is neither shuffled nor
    copied. A larger set is compared block by block.
    """
    keep = keep or []
    head = queries.select("query_id", "query_vector").limit(MAX_BROADCAST_QUERIES + 1).collect()
    if len(head) <= MAX_BROADCAST_QUERIES:
        partial = _scan_scores(head, vectors, k, keep)
    else:
        most = max(BLOCK_VALUES // max(len(head[0].query_vector), 1), 4)
        partial = _block_scores(queries, vectors, k, keep, min(block_rows, most // 4), min(vector_rows, most))
    place = Window.partitionBy("query_id", *keep).orderBy(F.col("score").desc(), "tile_id")
    return partial.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= k)


def _scan_scores(head: list, vectors: DataFrame, k: int, keep: list[str]) -> DataFrame:
    query_type = dict(vectors.dtypes)
    fields = ", ".join(["query_id string", *[f"{c} {query_type[c]}" for c in keep], "tile_id string", "score double"])
    if not head:
        return vectors.sparkSession.createDataFrame([], fields)
    ids = [r[0] for r in head]
    shared = vectors.sparkSession.sparkContext.broadcast(_matrix([r[1] for r in head]))

    def score(batches):
        matrix = shared.value
        best: dict[tuple, list] = {}  # per label and query the k best of the task so far
        types = []
        for batch in batches:
            types = [(c, batch.schema.field(c).type) for c in keep]  # a label may be null
            if batch.num_rows == 0:
                continue
            names = np.asarray(batch.column("tile_id").to_pylist(), dtype=object).astype(str)
            scores = np.round(_arrow_matrix(batch.column("embedding")) @ matrix.T, SCORE_DIGITS)
            labels = list(zip(*[batch.column(c).to_pylist() for c in keep])) if keep else [()] * batch.num_rows
            groups = {}
            for position, label in enumerate(labels):
                groups.setdefault(label, []).append(position)
            for label, rows in groups.items():
                rows = np.asarray(rows)
                kept = best.setdefault(label, [None] * len(ids))
                for j in range(len(ids)):
                    picked = rows[_best(scores[rows, j], names[rows], k)]
                    found, named = scores[picked, j], names[picked]
                    if kept[j] is not None:
                        found, named = np.concatenate([kept[j][0], found]), np.concatenate([kept[j][1], named])
                        again = _best(found, named, k)
                        found, named = found[again], named[again]
                    kept[j] = found, named
        for label, kept in best.items():
            columns = {"query_id": [], **{c: [] for c in keep}, "tile_id": [], "score": []}
            for query, (found, named) in zip(ids, kept):
                columns["query_id"] += [query] * len(found)
                for c, value in zip(keep, label):
                    columns[c] += [value] * len(found)
                columns["tile_id"] += named.tolist()
                columns["score"] += found.tolist()
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("query_id", pa.string()), *types, ("tile_id", pa.string()), ("score", pa.float64())]))

    return vectors.select(*keep, "tile_id", "embedding").mapInArrow(score, fields)


def _raw(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _units(packed: pa.Table, kind: type) -> np.ndarray:
    """Unit vectors of a packed block."""
    rows = np.frombuffer(packed.column("_data")[0].as_buffer(), kind).reshape(len(packed.column("_ids")[0]), -1).astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    return rows / lengths


def _block_scores(queries: DataFrame, vectors: DataFrame, k: int, keep: list[str], block_rows: int, vector_rows: int | None = None) -> DataFrame:
    """Blocks are packed first, a row for each with its ids and the bytes of its vectors: what is copied for
    every block of the other side, sorted and handed to Python are a few large rows, not all vectors again and again."""
    from .blocks import copied, dealt

    types = dict(vectors.dtypes)
    label = F.to_json(F.struct(*keep)) if keep else F.lit("")  # never null, so a null label is a label too
    stored = vectors.select(*keep, "tile_id", "embedding").withColumn("_label", label)
    asked = queries.select("query_id", "query_vector")
    asked = asked.withColumn("_label", F.explode(stored.agg(F.collect_set("_label")).scalar()) if keep else F.lit(""))
    # columns of its own, also where the queries come from the same rows as the vectors
    asked = asked.select(F.col("query_id").alias("query_id"), F.col("query_vector").alias("query_vector"), F.col("_label").alias("_label"))
    kinds = [np.float32 if dict(df.dtypes)[c] == "array<float>" else np.float64 for df, c in ((queries, "query_vector"), (vectors, "embedding"))]
    left, right = dealt(asked, stored, ["_label"], "query_id", "tile_id", block_rows, vector_rows, LEAST_BLOCKS)

    def row_of(block: pa.Table, head: list[str], ids: pa.ChunkedArray, rows: np.ndarray) -> pa.Table:
        packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.combine_chunks())
        return pa.table([*block.select(head).slice(0, 1).columns, packed, pa.array([rows.tobytes()], pa.binary())], names=[*head, "_ids", "_data"])

    def pack_queries(block: pa.Table) -> pa.Table:
        return row_of(block, ["_label", "_lb", "_nr"], block.column("query_id"), _raw(block.column("query_vector"), kinds[0]))

    def pack_vectors(block: pa.Table) -> pa.Table:
        block = block.sort_by("tile_id")  # ties go by id, so by row number
        use = first_copies(_arrow_matrix(block.column("embedding").combine_chunks()), k)
        return row_of(block, ["_label", "_rb", "_nl", *keep], block.column("tile_id").take(pa.array(use)), _raw(block.column("embedding"), kinds[1])[use])

    kept = "".join(f"{c} {types[c]}, " for c in keep)
    left = left.groupBy("_label", "_lb").applyInArrow(pack_queries, "_label string, _lb bigint, _nr bigint, _ids array<string>, _data binary")
    right = right.groupBy("_label", "_rb").applyInArrow(pack_vectors, f"_label string, _rb bigint, _nl bigint, {kept}_ids array<string>, _data binary")
    left, right = copied(left, right)
    groups = ["_label", "_lb", "_rb"]

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        if q.num_rows == 0 or v.num_rows == 0:
            query_ids = tile_ids = pa.array([], pa.string())
            at = row = np.empty(0, np.int64)
            scores = np.empty(0)
        else:
            query_ids, tile_ids = q.column("_ids")[0].values, v.column("_ids")[0].values
            at, row, scores = best_pairs(_units(q, kinds[0]), _units(v, kinds[1]), k)
        labels = v.select(keep).take(pa.array(np.zeros(len(row), np.int64)))
        return pa.table([query_ids.take(pa.array(at)), *labels.columns, tile_ids.take(pa.array(row)), pa.array(scores)], names=["query_id", *keep, "tile_id", "score"])

    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(score, f"query_id string, {kept}tile_id string, score double")


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 20, bits: int = 4,
                        seed: int = 7, block_rows: int = 4096) -> DataFrame:
    """Approximate k nearest tiles by random-hyperplane hashing.

    A pair is compared when it shares a bucket in at least one of ``tables`` hash tables.
    Buckets are dealt into blocks, so a bucket of any size is many bounded tasks, and
    every pair of a bucket is looked at.
    """
    from .blocks import block_pairs

    def hashed(df: DataFrame, vector: str, name: str) -> DataFrame:
        @F.pandas_udf("array<string>")
        def buckets(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=object)
            rows = _matrix(batch)
            planes = np.random.default_rng(seed).standard_normal((rows.shape[1], tables * bits))
            signs = (rows @ planes > 0).astype(int).reshape(len(batch), tables, bits)
            codes = signs @ (1 << np.arange(bits))
            return pd.Series([[f"{t}:{c}" for t, c in enumerate(row)] for row in codes])

        return df.select(F.col(name), F.col(vector), F.explode(buckets(vector)).alias("bucket"))

    left, right = block_pairs(hashed(queries, "query_vector", "query_id"), hashed(vectors, "embedding", "tile_id"),
                              ["bucket"], "query_id", "tile_id", block_rows)
    groups = ["bucket", "_lb", "_rb"]

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "tile_id": [], "score": []})
        scores = np.round(_matrix(q["query_vector"]) @ _matrix(v["embedding"]).T, SCORE_DIGITS)
        names = v["tile_id"].to_numpy().astype(str)
        return pd.concat([
            pd.DataFrame({"query_id": query, "tile_id": names[p], "score": scores[i, p]})
            for i, query in enumerate(q["query_id"]) for p in [_best(scores[i], names, k)]])

    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(
        score, "query_id string, tile_id string, score double")
    unique = found.groupBy("query_id", "tile_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tile_id")
    return unique.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= k)


def euclidean_of_cosine(score: float) -> float:
    """Distance of two unit vectors whose cosine is ``score``."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * score))
