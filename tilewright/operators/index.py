"""A stored index for approximate nearest neighbours: k-means cells, product-quantised codes, exact re-ranking.

Cells grow with the square root of the archive. Every vector is stored as its cell and one byte per four dimensions of what is left
after its cell's centre. A query scans the codes of its nearest cells, and only the
best candidates are compared exactly; how many of both is measured on a sample when the index is built. Centres and code books are fitted on a sample of
about ``FIT_ROWS`` vectors (``FIT_PER_CELL`` per cell, if that is more), drawn by a hash of the id; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt
from .blocks import block_pairs
from .vectors import SCORE_DIGITS, TopPairs, _arrow_matrix, _matrix, nearest, unit

FIT_ROWS, FIT_PER_CELL, MAX_CELLS = 16_384, 32, 16_384  # cells beyond that number would make the centres too large to send
WIDTH, BOOK = 4, 256  # dimensions per byte of a code, and entries of its book
GROUP_ROWS = 524_288  # codes of the cells that one task scans for its queries; each group returns the best pairs of every query
SCAN_QUERIES, SCAN_BLOCKS = 8192, 32  # queries of such a task at most, and blocks of queries at least
TUNE_QUERIES, TUNE_K = 256, 8  # stored vectors whose nearest ones set how many cells are probed and pairs compared
PROBE_SHARE, FIND_SHARE, MAX_RERANK = 0.98, 0.95, 512


def _split(rows: np.ndarray) -> np.ndarray:
    """Rows cut into parts of WIDTH dimensions, the last one filled up: (part, row, dimension)."""
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % WIDTH)))
    return rows.reshape(len(rows), -1, WIDTH).transpose(1, 0, 2)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def _book(rows: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A code book for one part: Lloyd's rounds from evenly spread rows."""
    rows = rows[np.lexsort(rows.T)]
    book = rows[np.linspace(0, len(rows) - 1, min(BOOK, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(rows, book)
        count = np.bincount(at, minlength=len(book))
        total = np.stack([np.bincount(at, rows[:, d], len(book)) for d in range(rows.shape[1])], 1)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return np.concatenate([book, np.full((BOOK - len(book), rows.shape[1]), 1e6)])  # never the nearest


class VectorIndex:
    """Codes below ``path``, and the centres and books they are made with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/model").collect())  # bounded by MAX_CELLS and the dimensions
        self.centres = np.array([r.values for r in rows if r.kind == "centre"])
        self.books = np.array([r.values for r in rows if r.kind == "book"]).reshape(-1, BOOK, WIDTH)

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Index ``vectors`` (tile_id, embedding)."""
        spark, n = vectors.sparkSession, vectors.count()
        cells = cells or min(MAX_CELLS, max(1, math.isqrt(max(n - 1, 0)) + 1))
        share = min(1.0, max(FIT_ROWS, FIT_PER_CELL * cells) / max(n, 1))
        drawn = F.pmod(F.xxhash64(F.lit(seed), "tile_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        sample = vectors.where(drawn).select(array_to_vector(unit(F.col("embedding"))).alias("features"), "embedding").persist()
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(sample).clusterCenters()) if cells > 1 else np.zeros((1, len(sample.first().embedding)))
        shared = spark.sparkContext.broadcast(centres)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _arrow_matrix(batch.column(0))
                for i, part in enumerate(_split(rows - shared.value[_nearest(rows, shared.value)])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), pa.array(list(part))], names=["part", "values"])

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"kind": ["book"], "number": [int(pdf["part"].iloc[0])], "values": [_book(np.stack(pdf["values"])).ravel()]})

        rest = sample.select("embedding").limit(2 * max(FIT_ROWS, 1)).mapInArrow(parts, "part int, values array<double>")
        books = rest.groupBy("part").applyInPandas(learn, "kind string, number int, values array<double>")
        centre_rows = spark.createDataFrame([("centre", i, c.tolist()) for i, c in enumerate(centres)], books.schema)
        books.unionByName(centre_rows).coalesce(1).write.parquet(f"{path}/model")
        sample.unpersist()
        index = cls(spark, f"{path}")
        index._encode(vectors)
        index._tune(vectors, n, seed)
        return index

    def _tune(self, vectors: DataFrame, n: int, seed: int) -> None:
        """Store how many cells a query probes and how many pairs it compares, so that the nearest vectors of a sample of
        stored ones are found. Vectors without structure need most cells, clustered ones few."""
        asked = vectors.orderBy(F.xxhash64(F.lit(seed + 1), "tile_id"), "tile_id").limit(TUNE_QUERIES).select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        most, probes, rerank = max(TUNE_K, min(MAX_RERANK, n // 12)), 1, TUNE_K
        queries = {r.query_id: r.query_vector for r in asked.collect()}
        if queries:
            true = self.spark.createDataFrame(nearest(asked, vectors, TUNE_K).select("query_id", "tile_id").collect(), "query_id string, tile_id string")
            at = true.join(self.codes.select("tile_id", "cell"), "tile_id").collect()
            rows = _matrix([queries[r.query_id] for r in at])
            order = np.argsort(np.argsort((self.centres * self.centres).sum(1) - 2 * rows @ self.centres.T, axis=1), axis=1)
            probes = int(np.quantile(order[np.arange(len(at)), [r.cell for r in at]] + 1, PROBE_SHARE, method="higher"))
            found = true.join(self._ranked(asked, probes, most), ["query_id", "tile_id"]).select("_p").collect()
            places = sorted(r[0] for r in found)
            enough = int(np.ceil(FIND_SHARE * len(at)))
            rerank = max(TUNE_K, places[enough - 1]) if len(places) >= enough else most
        self.spark.createDataFrame([(probes, rerank)], "probes int, rerank int").write.parquet(f"{self.path}/search")

    def _settings(self, probes: int | None, rerank: int | None) -> tuple[int, int]:
        stored = self.spark.read.parquet(f"{self.path}/search").first() if probes is None or rerank is None else None
        return probes or stored.probes, rerank or stored.rerank

    def _encode(self, vectors: DataFrame) -> None:
        model = self.spark.sparkContext.broadcast((self.centres, self.books))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = model.value
            for batch in batches:
                rows = _arrow_matrix(batch.column(1))
                cell = _nearest(rows, centres)
                codes = np.stack([_nearest(p, b) for p, b in zip(_split(rows - centres[cell]), books)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["tile_id", "cell", "code"])

        coded = vectors.select("tile_id", "embedding").mapInArrow(encode, "tile_id string, cell int, code binary")
        coded.repartitionByRange("cell").sortWithinPartitions("cell", "tile_id").write.parquet(f"{self.path}/codes")

    def candidates(self, queries: DataFrame, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """The ``rerank`` best pairs of every query (query_id, query_vector) by codes of its ``probes`` nearest cells."""
        return self._ranked(queries, *self._settings(probes, rerank)).select("query_id", "tile_id")

    def _ranked(self, queries: DataFrame, probes: int, rerank: int) -> DataFrame:
        """Cells are dealt into groups of about ``GROUP_ROWS`` codes. Queries and codes of a group are dealt into pairs of blocks, so that
        a cell of any size is many bounded tasks; a query leaves a task with its best pairs of a whole group of cells.
        """
        model = self.spark.sparkContext.broadcast((self.centres, self.books))
        probes = min(probes, len(self.centres))
        codes = self.codes
        groups = min(len(self.centres), max(1, -(-codes.count() // GROUP_ROWS)))

        def near(rows: np.ndarray) -> np.ndarray:
            centres = model.value[0]
            return np.argpartition((centres * centres).sum(1) - 2 * rows @ centres.T, probes - 1, axis=1)[:, :probes]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = [np.unique(cells % groups).astype(np.int32) for cells in near(_arrow_matrix(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asked, pa.list_(pa.int32()))], names=["query_id", "query_vector", "groups"])

        asked = queries.select("query_id", "query_vector")
        asked = asked.mapInArrow(probe, f"query_id string, query_vector {dict(asked.dtypes)['query_vector']}, groups array<int>")
        left, right = block_pairs(asked.select("query_id", "query_vector", F.explode("groups").alias("group")), codes.withColumn("group", F.pmod("cell", F.lit(groups))),
                                  ["group"], "query_id", "tile_id", SCAN_QUERIES, 2 * GROUP_ROWS, SCAN_BLOCKS)

        def scan(q: pa.Table, v: pa.Table) -> pa.Table:
            at, column, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if q.num_rows and v.num_rows:
                centres, books = (x.astype(np.float32) for x in model.value)
                rows, v = _arrow_matrix(q.column("query_vector").combine_chunks()), v.sort_by([("cell", "ascending"), ("tile_id", "ascending")])
                cell = v.column("cell").to_numpy()
                code = np.frombuffer(b"".join(v.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
                stored = centres[cell]
                for i, (book, c) in enumerate(zip(books, code.T)):
                    part = stored[:, i * WIDTH:(i + 1) * WIDTH]
                    part += book[c][:, :part.shape[1]]
                starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                pieces = [(s, min(s + 2048, end)) for begin, end in zip(starts, np.r_[starts[1:], len(cell)]) for s in range(begin, end, 2048)]
                for start in range(0, len(rows), 1024):
                    own = rows[start:start + 1024]
                    asks = np.zeros((len(own), len(centres)), bool)
                    np.put_along_axis(asks, near(own), True, 1)
                    own, top = own.astype(np.float32), TopPairs(len(own), rerank)
                    for low, high in pieces:
                        wanted = np.flatnonzero(asks[:, cell[low]])
                        if len(wanted):
                            top.offer(wanted, low, own[wanted] @ stored[low:high].T)
                    top.settle()
                    at.append(top.query + start), column.append(top.column), score.append(np.round(top.score, 6))
            at, column = pa.array(np.concatenate(at)), pa.array(np.concatenate(column))
            return pa.table([q.column("query_id").take(at), v.column("tile_id").take(column), pa.array(np.concatenate(score))], names=["query_id", "tile_id", "score"])

        keys = ["group", "_lb", "_rb"]
        # the tables are small for the work they make: left to adaptive execution, few tasks would share it
        found = dealt(left, *keys).groupBy(*keys).cogroup(dealt(right, *keys).groupBy(*keys)).applyInArrow(scan, "query_id string, tile_id string, score double")
        place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tile_id")
        return found.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= rerank).select("query_id", "tile_id", "_p")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """The k nearest of the candidates by exact cosine: query_id, tile_id, score, place."""
        pairs = self.candidates(queries, probes, rerank).join(queries.select("query_id", "query_vector"), "query_id").join(vectors.select("tile_id", "embedding"), "tile_id")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = np.round((_arrow_matrix(batch.column(2)) * _arrow_matrix(batch.column(3))).sum(1), SCORE_DIGITS) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", "tile_id", "score"])

        scored = pairs.select("query_id", "tile_id", "query_vector", "embedding").mapInArrow(exact, "query_id string, tile_id string, score double")
        place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tile_id")
        return scored.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= k)
