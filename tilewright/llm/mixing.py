"""Mixing of sources to target weights, in fixed-length blocks of words.

1. The words of a source form one stream (documents in a hashed order), cut into blocks of
   ``block_words`` words; the last block of a source may be shorter.
2. Sources get shares of all words by weight. A target stops at ``most`` times the source's
   words, and the excess goes to the other sources by weight until none is above.
3. Every output shard draws a multinomial number of slots per source. A source's draws
   beyond its number of blocks due are passed on to the sources that drew too few, so
   that each ends within half a block of its target.
4. The i-th slot of a source takes the block at place i of its pseudorandom permutation
   (a new one each time round), so no block comes up more than ``ceil(most)`` times.
5. Slots and blocks are joined by source and block number.

The only rows on the driver are one per source (at most ``max_sources``; more is an error).
Null sources are a source of their own, after all others. Null texts and texts without words
have size 0 and are never taken. Repeated rows are documents of their own. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import NOT_SPACE, Texts, Words
from .store import materialise, running_start, small_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1024


@dataclass
class Source:
    name: str | None
    weight: float
    words: int
    target: float = 0.0
    blocks: int = 0
    slots: int = 0


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def share_out(sources: list[Source], most: float) -> None:
    """Targets by weight, each at most ``most`` times the source's words."""
    total = sum(s.words for s in sources)
    left, room = list(sources), float(total)
    while left:
        weight = sum(s.weight for s in left)
        full = [s for s in left if room * s.weight / weight > most * s.words]
        if not full:
            for s in left:
                s.target = room * s.weight / weight
            return
        for s in full:
            s.target = most * float(s.words)
        room -= sum(s.target for s in full)
        left = [s for s in left if s not in full]


def plan_sources(sized: DataFrame, weights: list[float], most: float, block_words: int, max_sources: int) -> list[Source]:
    """One Source per value of ``source``: by code point, null last; weights repeat."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sources = [Source(r.source, weights[i % len(weights)], r.words) for i, r in enumerate(rows)]
    share_out(sources, most)
    for s in sources:
        s.blocks = -(-s.words // block_words)
        if s.blocks:
            s.slots = min(math.floor(s.target / (s.words / s.blocks) + 0.5), math.ceil(most * s.blocks))
    return sources


def with_index(df: DataFrame, sources: list[Source]) -> DataFrame:
    """Add the number of the source; the list of sources has a checked length."""
    table = small_table(df.sparkSession, [(i, s.name, s.words, s.target) for i, s in enumerate(sources)],
                        "ix int, _name string, source_size bigint, target double")
    return df.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def permute(place: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a four-round Feistel network on the next even
    number of bits; values outside walk on along their cycle."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            x = right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(31)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def draw_slots(spark: SparkSession, sources: list[Source], shard_slots: int, seed: int) -> DataFrame:
    """Rows (shard, ix, first, n): in this shard, source ix fills its slots first..first+n-1."""
    due = np.array([s.slots for s in sources], np.int64)
    total = int(due.sum())
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(shard_slots, total - shard * shard_slots)
                drawn = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(n, due / total)
                ix = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ix), shard, np.int64)), pa.array(ix.astype(np.int32)), pa.array(drawn[ix].astype(np.int64))],
                                                 names=["shard", "ix", "drawn"])

    drawn = spark.range(shards).mapInArrow(draw, "shard bigint, ix int, drawn bigint")
    # shards in a hashed order, so that those who give up slots are spread over all of them
    drawn = running_start(drawn, ["ix"], F.pmod(F.xxhash64("shard", F.lit(seed)), F.lit(max(1, shards // BUCKET_ROWS))), ["shard"], "drawn", "first")
    names = small_table(spark, [(i, s.slots) for i, s in enumerate(sources)], "ix int, due bigint")
    drawn = drawn.join(F.broadcast(names), "ix").withColumn("n", F.greatest(F.lit(0), F.least("drawn", F.col("due") - F.col("first"))))
    drawn = materialise(drawn, "mix-drawn")
    got = {r.ix: r.n for r in drawn.groupBy("ix").agg(F.sum("n").alias("n")).collect()}
    kept = np.array([got.get(i, 0) for i in range(len(sources))], np.int64)
    ends = np.cumsum(due - kept)
    free = drawn.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("n")).alias("free")).where("free > 0")
    free = running_start(free, [], F.floor(F.col("shard") / BUCKET_ROWS), ["shard"], "free", "start")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard, start, n in zip(batch["shard"], batch["start"], batch["free"]):
                ix = int(np.searchsorted(ends, start, "right"))
                while n > 0:
                    take = int(min(n, ends[ix] - start))
                    if take:
                        rows.append((shard, ix, int(kept[ix] + start - (ends[ix] - (due[ix] - kept[ix]))), take))
                    start, n, ix = start + take, n - take, ix + 1
            yield pd.DataFrame(rows, columns=["shard", "ix", "first", "n"])

    passed_on = free.mapInPandas(fill, "shard bigint, ix int, first bigint, n bigint")
    return drawn.where("n > 0").select("shard", "ix", "first", "n").unionByName(passed_on)


def map_slots(drawn: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """Rows (shard, ix, round, block): the block that each slot takes."""
    blocks = [s.blocks for s in sources]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ix, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                for low in range(first, first + n, 65536):
                    slot = np.arange(low, min(low + 65536, first + n))
                    turn, place = slot // blocks[ix], slot % blocks[ix]
                    block = np.empty(len(slot), np.int64)
                    for t in range(int(turn[0]), int(turn[-1]) + 1):
                        block[turn == t] = permute(place[turn == t], blocks[ix], seed * 1_000_003 + ix * 4099 + t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard, np.int64)), pa.array(np.full(len(slot), ix, np.int32)),
                                                      pa.array(turn.astype(np.int32)), pa.array(block)], names=["shard", "ix", "round", "block"])

    return drawn.select("shard", "ix", "first", "n").mapInArrow(take, "shard bigint, ix int, round int, block bigint")


def in_streams(sized: DataFrame, sources: list[Source], rows: int) -> DataFrame:
    """Add ix, source_size, target and ``start``, the place of the first word in the source's stream."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // BUCKET_ROWS)))
    return running_start(with_index(sized, sources), ["ix"], bucket, ["doc_id", "size", "text_hash"], "size", "start")


def _measured(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
                       F.xxhash64("text").alias("text_hash"), *more)


def taken(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, block_words: int = 128, shard_slots: int = 4096,
          seed: int = 7, max_sources: int = 10_000) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    docs: doc_id, text, source; further columns are ignored. Returns doc_id, source, size,
    source_size, target (both of its source) and taken, one row per row of ``docs``.
    """
    spark = docs.sparkSession
    sized = materialise(_measured(docs), "mix-sizes")
    sources = plan_sources(sized, list(weights), most, block_words, max_sources)
    if not any(s.slots for s in sources):
        return with_index(sized, sources).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    streams = in_streams(sized, sources, sized.count())
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = streams.where("size > 0").withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "words", F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block_words, "start"))
    times = map_slots(draw_slots(spark, sources, shard_slots, seed), sources, seed).groupBy("ix", "block").agg(F.count(F.lit(1)).alias("times"))
    used = pieces.join(times, ["ix", "block"], "left").groupBy("ix", "start", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    empty = with_index(sized.where("size = 0"), sources).withColumn("taken", F.lit(0).cast("bigint"))
    return used.select(*columns).unionByName(empty.select(*columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, block_words: int = 128, shard_slots: int = 4096,
        seed: int = 7, max_sources: int = 10_000) -> DataFrame:
    """The mixed blocks themselves: shard, source, block, round, text (its words, joined by
    single blanks, documents in stream order), n_words and doc_ids (those it holds words of)."""
    schema = "shard bigint, source string, block bigint, round int, text string, n_words bigint, doc_ids array<bigint>"
    spark = docs.sparkSession
    sized = materialise(_measured(docs), "mix-sizes")
    sources = plan_sources(sized, list(weights), most, block_words, max_sources)
    if not any(s.slots for s in sources):
        return spark.createDataFrame([], schema)
    # texts are read again rather than stored again; their sums come from their sizes
    streams = in_streams(_measured(docs, "text").where("size > 0"), sources, sized.count())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, starts = Texts(batch.column("text")), batch.column("doc_id"), batch.column("start").to_numpy()
            for low, high in texts.parts():
                words = Words(texts, low, high, NOT_SPACE, hashes=False)
                at = starts[low + words.row] + np.arange(len(words.row)) - words.row_starts[words.row]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] // block_words != at[:-1] // block_words) | (words.row[1:] != words.row[:-1])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(at))
                data = [b" ".join(texts.bytes[words.begin[a] : words.end[b - 1]].tobytes().split()).decode() for a, b in zip(heads, tails)]
                row = low + words.row[heads]
                yield pa.RecordBatch.from_arrays([batch.column("ix").take(pa.array(row)), pa.array(at[heads] // block_words), pa.array(at[heads]),
                                                  pa.array(tails - heads), ids.take(pa.array(row)), pa.array(data, pa.string())],
                                                 names=["ix", "block", "at", "words", "doc_id", "part"])

    pieces = streams.select("ix", "start", "doc_id", "text").mapInArrow(cut, "ix int, block bigint, at bigint, words bigint, doc_id bigint, part string")
    # a block holds at most block_words pieces, so the list is bounded
    blocks = pieces.groupBy("ix", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "part"))).alias("p"), F.sum("words").alias("n_words"))
    slots = map_slots(draw_slots(spark, sources, shard_slots, seed), sources, seed)
    names = small_table(spark, [(i, s.name) for i, s in enumerate(sources)], "ix int, source string")
    return slots.join(blocks, ["ix", "block"]).join(F.broadcast(names), "ix").select(
        "shard", "source", "block", "round", F.array_join("p.part", " ").alias("text"), "n_words", F.array_distinct("p.doc_id").alias("doc_ids"))
