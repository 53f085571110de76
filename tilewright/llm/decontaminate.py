"""Benchmark decontamination: containment of short test items in whole documents.

An item's set holds its 5-word shingles (A-Z lower-cased, words are runs of non-space
characters); an item of fewer words is one shingle of its own width, found wherever
its words stand consecutively in a document. An item is found in a document that holds at
least ``percent`` of its set. Items without words are in no document.

Jaccard signatures can't find 30 shingles among 20,000, so the sketch is the item's and it is
searched in the document's full set:

* Items are partitioned by size (powers of two). Items of a partition of sizes up to u are
  sketched by their k smallest hashes (bottom-k MinHash), k = u - ceil(u * percent / 100) + 1.
* An item of size n may miss m = n - ceil(n * percent / 100) shingles, so a document that holds
  enough of it holds all but m of the k smallest too. This bound has no false negatives.
* Documents are read once. Hashes pass a bitmap of fixed size (2 MB) of all item shingles,
  and only documents that hit the bitmap of a sketch send rows on: (doc_id, hash).
  The join with the item table is exact, so a bitmap that fills up costs time, not results.
* Containment is then counted exactly on the sets.

Items are told apart by id and text: those that share an id, or have none, are items of their own, reported under their id or
null. Documents with null ids are reported under a null id only if they hold an item; repeated rows
count once per id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_SPACE, Texts, Words, distinct, hit, shingles, signed
from .store import bitmap, materialise, without

WIDTH = 5


def item_shingles(items: DataFrame, percent: int = 75) -> DataFrame:
    """Rows (item, item_id, width, n, allowed, hash, in_sketch, k) of all items' sets; ``item`` stands for id and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(2))
            for first, last in texts.parts():
                words = Words(texts, first, last, NOT_SPACE)
                for width in range(1, WIDTH + 1):
                    use = words.counts == width if width < WIDTH else words.counts >= WIDTH
                    row, code = distinct(*shingles(words, width, whole=False))
                    row, code = row[use[row]], code[use[row]]
                    if not len(row):
                        continue
                    n = np.bincount(row, minlength=last - first)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    top = (1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))  # size partition: (top / 2, top]
                    k = np.minimum(top + (-top * percent) // 100 + 1, n)
                    allowed = n + (-n * percent) // 100
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(first, last - first).take(pa.array(row)) for c in (0, 1)), pa.array(np.full(len(row), width, np.int32)), pa.array(n[row]),
                         pa.array(allowed[row]), signed(code), pa.array(place < k[row]), pa.array(k[row])],
                        names=["item", "item_id", "width", "n", "allowed", "hash", "in_sketch", "k"])

    schema = "item bigint, item_id bigint, width int, n bigint, allowed bigint, hash bigint, in_sketch boolean, k bigint"
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return known.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item"), "item_id", "text").mapInArrow(rows, schema)


def contained(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """Rows doc_id, item_id, n_item (size of the item's set), n_shared, containment: every item
    of which a document holds at least ``percent``."""
    spark = docs.sparkSession
    parts = materialise(item_shingles(items, percent), "items")
    widths = sorted(r.width for r in parts.select("width").distinct().collect())
    every = spark.sparkContext.broadcast(bitmap(parts))
    sketch = spark.sparkContext.broadcast(bitmap(parts.where("in_sketch")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(1))
            for first, last in texts.parts():
                words = Words(texts, first, last, NOT_SPACE)
                for width in widths:
                    row, code = shingles(words, width, whole=False)
                    keep = hit(every.value, code)
                    row, code = row[keep], code[keep]
                    doc = np.zeros(last - first, bool)
                    doc[row[hit(sketch.value, code)]] = True
                    row, code = distinct(row[doc[row]], code[doc[row]])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(row)), signed(code)], names=["doc_id", "hash"])

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(search, "doc_id bigint, hash bigint").distinct()
    both = found.join(parts, "hash").groupBy("doc_id", "item").agg(
        F.max("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_shared"), F.sum(F.col("in_sketch").cast("bigint")).alias("in_sketch"), F.max("n").alias("n_item"),
        F.max("allowed").alias("allowed"), F.max("k").alias("k"))
    candidates = both.where("in_sketch >= greatest(1, k - allowed)")
    return candidates.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that hold no item. Rows with null ids can't be told apart and stay."""
    return without(docs, contained(docs, items, percent))
