"""Periodic runs of words: found on Re-Pair grammars, reported per document, and collapsed to their first period.

A run is a stretch of words with smallest period q (words q apart are identical, in their letter case) of at
least 12 words and two periods that can't be extended. Defined results: a null text has no words and no runs; a
null id is kept and its text is never altered; repeated rows give a row each. Words are compared
by 64-bit hashes. Texts are cut into parts of about 2 MB that share a grammar; a longer text is a part of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import LEAST, ragged, runs_of
from .kernel import EXACT_VALUE, NOT_SPACE, PLACE, STEP, Texts, U, Words, mix

HALF = LEAST // 2  # a run repeats its first six words a period later
CHUNK = 1 << 16  # words joined at a time
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_sha256 string"


def looped(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Where the planted loop of a document begins and its length in words; None: no loop."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _recurring(codes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Rows in which six consecutive words occur twice. Only they can hold a run."""
    out = np.zeros(count, bool)
    n = len(codes) - HALF + 1
    if n < 2:
        return out
    own = rows[:n] == rows[HALF - 1 :]
    keys = np.zeros(n, U)
    for j in range(HALF):
        keys += codes[j : n + j] * PLACE[j]
    keys = mix(keys + (rows[:n].astype(U) + U(1)) * STEP)[own]
    order = np.argsort(keys)
    twice = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    out[rows[:n][own][order[twice]]] = True
    return out


def _plain(texts: Texts, words: Words, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row joined by one blank, as bytes and row bounds."""
    base, top = int(texts.offsets[first]), int(texts.offsets[last])
    data = texts.bytes[base:top].copy()
    keep = NOT_SPACE[data]
    inner = words.end[:-1][words.row[1:] == words.row[:-1]] - base
    data[inner], keep[inner] = 32, True
    cuts = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], cuts[texts.offsets[first : last + 1] - base]


def _joined(texts: Texts, words: Words, index: np.ndarray) -> str:
    """SHA-256 of the words ``index`` joined by one blank."""
    digest = hashlib.sha256()
    for at in range(0, len(index), CHUNK):
        part = index[at : at + CHUNK]
        size = words.end[part] - words.begin[part]
        owner, inner = ragged(size + 1)
        place = words.begin[part][owner] + inner
        blank = inner == size[owner]
        data = texts.bytes[np.minimum(place, len(texts.bytes) - 1)]
        data[blank] = 32
        digest.update(data[: -1 if at + CHUNK >= len(index) else None].tobytes())
    return digest.hexdigest()


def find(docs: DataFrame, loops: bool = False) -> DataFrame:
    """doc_id, n_words, runs by start, then period, and the SHA-256 of the collapsed text: words that lie in a
    run behind its first period dropped, the others joined by one blank. ``loops`` plants ``looped`` first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = Texts(batch.column(1))
            for first, last in texts.parts():
                words = Words(texts, first, last, NOT_SPACE, values=EXACT_VALUE)
                count, starts = last - first, words.row_starts
                index = np.arange(len(words.code))  # the word that stands at each place
                altered = np.zeros(count, bool)
                for r in range(count) if loops else ():
                    loop = looped(int(words.counts[r]), ids[first + r])
                    if loop:
                        a, p = loop
                        low = int(starts[r]) + a
                        index[low : starts[r + 1]] = low + np.arange(starts[r + 1] - low) % p
                        altered[r] = True
                codes = words.code[index]
                runs: list[list[dict]] = [[] for _ in range(count)]
                drop = np.zeros(len(index) + 1, np.int64)
                for rows in batches_of(np.flatnonzero(_recurring(codes, words.row, count)), words.counts):
                    owner, inner = ragged(words.counts[rows] + 1)
                    breaks = inner == words.counts[rows][owner]
                    place = np.minimum(starts[rows][owner] + inner, len(codes) - 1)
                    symbols = np.unique(codes[place], return_inverse=True)[1]
                    symbols[breaks] = len(symbols) + np.arange(len(rows))
                    for a, b, q in zip(*(x.tolist() for x in runs_of(symbols, breaks))):
                        r = rows[owner[a]]
                        runs[r].append({"start": int(inner[a]), "length": b - a, "period": q})
                        low = int(starts[r] + inner[a])
                        drop[low + q] += 1
                        drop[low + b - a] -= 1
                dropped = np.cumsum(drop)[:-1] > 0
                plain, bounds = _plain(texts, words, first, last)
                digests = [
                    _joined(texts, words, index[starts[r] : starts[r + 1]][~dropped[starts[r] : starts[r + 1]]]) if altered[r] or runs[r]
                    else hashlib.sha256(plain[bounds[r] : bounds[r + 1]]).hexdigest() for r in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, count), pa.array(words.counts.astype(np.int64)),
                     pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(digests, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, SCHEMA)


def batches_of(rows: np.ndarray, counts: np.ndarray, limit: int = 1 << 18) -> list[np.ndarray]:
    """``rows`` in groups of about ``limit`` words; a longer one is a group of its own."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(counts[rows]) // limit)) + 1) if len(rows) else []


def summary(found: DataFrame) -> DataFrame:
    """One row per document of ``find``: the number of runs, the longest (ties: smallest start, then period) and digests."""
    longest = F.expr("array_max(transform(runs, x -> struct(x.length AS length, -x.start AS start, -x.period AS period)))")
    listed = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    rows = found.withColumns({"_top": longest, "_listed": listed})
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"), F.expr("1000 * _top.length div -_top.period").alias("exponent_milli"),
        F.sha2("_listed", 256).alias("runs_sha256"), "collapsed_sha256")
