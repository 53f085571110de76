"""Scores of whole documents under word frequencies and a recurrent language model.

Tokens are words (runs of non-space characters, A-Z lower-cased), then one end. Words are told
apart by 64-bit hashes.

1. *Counts*: tokens of all training documents, summed per block of texts before the shuffle.
2. The most frequent ``vocabulary`` tokens, the end and one symbol for all other words form the
   model's output; its classes follow the frequencies.
3. *Training* (``gru``): all training documents once (``share`` > 1 reads one in so many), as word numbers that are stored once and dealt
   by a hash of id and text to ``rounds`` rounds of shards of about ``SHARD`` tokens. Every shard is learnt in the order of the
   hash, from the same start; the parameters are averaged by Spark with partial sums, weighted by tokens. So the model depends on the
   documents, not on how the input is split.
4. *Scoring*: each document is read as a whole, its state carried across windows. Another word's
   probability is that of the symbol times the word's share among all other words, add-half
   smoothed; so every text has a probability.
5. Counts of the most frequent tokens (at most ``known``, a bound on the broadcast) are looked up in the
   tasks. Rarer words are joined with the counts by hash, one row per document and word.

Null texts hold only the end. Null ids belong to no held-out part. Repeated rows are scored
each. Without training documents counts are zero and the model only has its two symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .kernel import NOT_SPACE, HashTable, Texts, Words, signed
from .store import discard, materialise

U = np.uint64
END = 0x0E0D0E0D0E0D0E0D  # code of the end, outside of what words are likely to hash to
SLICE = 4096
SHARD = 1 << 22  # tokens that are learnt one after the other between two averages
STREAM = 1 << 22  # tokens that a task trains on at once


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column(0))
        for first, last in texts.parts(1 << 24):
            codes, counts = np.unique(Words(texts, first, last, NOT_SPACE).code, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(np.append(codes, U(END))), pa.array(np.append(counts, last - first))], names=["code", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """Rows (code, n) of all tokens of ``docs``."""
    return materialise(docs.select("text").mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "tokens")


class Lexicon:
    """The most frequent tokens, their counts, and the totals."""

    def __init__(self, counts: DataFrame, known: int, vocabulary: int):
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.distinct = totals.n, totals.v
        # counts fall into some hundred classes; those from the top are taken while they hold at most ``known`` tokens
        counts = counts.withColumn("size", F.floor(F.log2("n") * 16))
        sizes = sorted(counts.groupBy("size").agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["size"])
        held = np.cumsum([r["v"] for r in sizes])
        least = ([0] + [r["size"] for r, v in zip(sizes, held) if v <= known])[-1] if len(sizes) and held[0] <= known else None
        top = counts.where(F.lit(False) if least is None else F.col("size") >= least).select("code", "n").toPandas().sort_values(["n", "code"], ascending=[False, True], ignore_index=True)
        if END not in top["code"].values:  # always known, however rare
            top = pd.concat([top, counts.where(F.col("code") == END).select("code", "n").toPandas()], ignore_index=True)
        self.codes, self.counts = top["code"].to_numpy(np.int64).view(U), top["n"].to_numpy(np.int64)
        chosen = self.codes[:vocabulary]
        if END not in chosen:
            chosen = np.append(chosen, U(END))
        self.table = HashTable(self.codes)
        inside = np.zeros(len(self.codes), bool)
        inside[self.table.find(chosen)[self.table.find(chosen) >= 0]] = True
        self.rest_tokens, self.rest_distinct = self.tokens - int(self.counts[inside].sum()), self.distinct - int(inside.sum())
        # words of the model by frequency; code 0 stands for all others
        places = self.table.find(chosen)
        amount = np.append(np.where(places >= 0, self.counts[places] if len(self.counts) else 0, 0), self.rest_tokens)
        order = np.argsort(-amount, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.amount, self.other = amount[order], int(rank[-1])
        self.end = int(rank[:-1][np.flatnonzero(chosen == U(END))[0]])
        self.word = np.full(len(self.codes), self.other, np.int32)
        self.word[places[places >= 0]] = rank[:-1][places >= 0]

    def base(self, n):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def share(self, n):
        return np.log10((n + 0.5) / (self.rest_tokens + 0.5 * (self.rest_distinct + 1)))

    def numbers(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.word[place] if len(self.word) else self.other, self.other).astype(np.int32)


def with_ends(words: Words, numbers: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all rows, each closed by ``end``; first place and length per row."""
    count = words.counts + 1
    first = np.cumsum(count) - count
    out = np.full(int(count.sum()), end, np.int32)
    out[np.arange(len(numbers)) + words.row] = numbers
    return out, first, count


def encoded(docs: DataFrame, lexicon: Lexicon, slots: int, share: int, seed: int) -> DataFrame:
    """Word numbers of one in ``share`` documents, each closed by the end, dealt to ``slots`` by a hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = np.int16 if len(lexicon.amount) < 1 << 15 else np.int32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            texts = Texts(batch.column(2))
            for first, last in texts.parts():
                words = Words(texts, first, last, NOT_SPACE)
                numbers, start, _ = with_ends(words, lexicon.numbers(lexicon.table.find(words.code)), lexicon.end)
                data = numbers.astype(kind)
                bounds = (np.append(start, len(data)) * data.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), column], names=["slot", "key", "words"])

    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = docs.select(key.alias("key"), "text").where(F.pmod(F.shiftrightunsigned("key", 20), F.lit(share)) == 0)
    return materialise(rows.select(F.pmod("key", F.lit(slots)).cast("int").alias("slot"), "key", "text").mapInArrow(encode, "slot int, key bigint, words binary"), "word-numbers")


def fit(docs: DataFrame, lexicon: Lexicon, hidden: int = 24, share: int = 1, rounds: int = 2, seed: int = 1, shard: int = SHARD) -> dict[str, np.ndarray]:
    """Train on one in ``share`` documents, each read in one of the rounds."""
    spark = docs.sparkSession
    model = gru.start(lexicon.amount, hidden, seed)
    shards = max(1, -(-lexicon.tokens // (share * rounds * shard)))
    stored = encoded(docs, lexicon, rounds * shards, share, seed)
    kind = np.int16 if len(lexicon.amount) < 1 << 15 else np.int32
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model, lexicon.end))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, end = shared.value
            slot, model, stream, held, n, seen = None, start, [], 0, 0, {}

            def on() -> None:
                nonlocal model, stream, held
                if held:
                    model = gru.train(model, np.concatenate(stream).astype(np.int32), end, seen=seen)
                stream, held = [], 0

            def told() -> Iterator[pa.RecordBatch]:
                on()
                flat = gru.flatten(model)
                for i in range(0, len(flat), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([float(n)]), pa.array([flat[i : i + SLICE].astype(np.float64)], pa.list_(pa.float64()))],
                                                     names=["part", "weight", "values"])

            for batch in batches:
                for own, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if own != slot:
                        if n:
                            yield from told()
                        slot, model, n, seen = own, start, 0, {}
                    words = np.frombuffer(words.as_buffer(), kind)
                    for at in range(0, len(words), STREAM):
                        stream.append(words[at : at + STREAM].copy())
                        held, n = held + len(stream[-1]), n + len(stream[-1])
                        if held >= STREAM:  # a bound on memory; Adagrad's sums go on
                            on()
            if n:
                yield from told()

        own = stored.where(F.pmod("slot", F.lit(rounds)) == turn).repartition(min(4 * shards, 20_000), "slot").sortWithinPartitions("slot", "key")
        learnt = own.select("slot", "words").mapInArrow(learn, "part int, weight double, values array<double>").select("part", "weight", array_to_vector("values").alias("values"))
        mean = learnt.groupBy("part").agg(Summarizer.mean(F.col("values"), F.col("weight")).alias("values"))
        rows = mean.select("part", vector_to_array("values").alias("values")).collect()  # one model
        if rows:
            model = gru.restore(np.concatenate([np.array(r["values"], np.float32) for r in sorted(rows, key=lambda r: r.part)]), model)
    discard(stored)
    return model


SCORED = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, times array<bigint>"


def score(docs: DataFrame, train: DataFrame, known: int = 1 << 17, vocabulary: int = 2046, hidden: int = 24, share: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row
    of ``docs`` (doc_id, text, held_out), learnt from ``train`` (doc_id, text)."""
    counts = token_counts(train)
    lexicon = Lexicon(counts, known, vocabulary)
    model = fit(train, lexicon, hidden, share)
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = shared.value
        ids = np.random.default_rng()  # row numbers only; they are stored before they are used
        base, part = lexicon.base(lexicon.counts), np.where(lexicon.word == lexicon.other, lexicon.share(lexicon.counts), 0.0)
        end_place = int(lexicon.table.find(np.array([END], U))[0])
        for batch in batches:
            texts = Texts(batch.column(1))
            for first, last in texts.parts(1 << 25):
                n = last - first
                words = Words(texts, first, last, NOT_SPACE)
                place = lexicon.table.find(words.code)
                seen = place >= 0
                sums = lambda x: np.bincount(words.row[seen], x[place[seen]], minlength=n) if seen.any() else np.zeros(n)
                plain, extra, known_words = sums(base), sums(part), np.bincount(words.row[seen], minlength=n)
                plain += base[end_place] if end_place >= 0 else lexicon.base(0)
                known_words += end_place >= 0
                numbers, start, count = with_ends(words, lexicon.numbers(place), lexicon.end)
                extra += gru.score(model, numbers, start, count, lexicon.end) / np.log(10)
                order = np.lexsort((words.code[~seen], words.row[~seen]))
                row, code = words.row[~seen][order], words.code[~seen][order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                heads = np.flatnonzero(new)
                cuts = pa.array(np.searchsorted(row[heads], np.arange(n + 1)).astype(np.int32))
                times = np.diff(np.append(heads, len(row)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.integers(-(2**63), 2**63 - 1, n)), batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(count.astype(np.int64)),
                     pa.array(known_words.astype(np.int64)), pa.array(plain), pa.array(extra), pa.ListArray.from_arrays(cuts, signed(code[heads])),
                     pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))], names=[x.split()[0] for x in SCORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", "held_out").mapInArrow(read, SCORED)
    rows = materialise(rows, "scored")
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("code"), F.col("r.times").alias("times"))
    rare = rare.join(counts, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    smooth = lambda tokens, distinct: F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(tokens + 0.5 * (distinct + 1))))
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(smooth(lexicon.tokens, lexicon.distinct)).alias("_base"),
                                   F.sum(smooth(lexicon.rest_tokens, lexicon.rest_distinct)).alias("_score"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.drop("rare", "times").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "_known"), F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"), plus("base_score", "_base"), plus("score", "_score"))
