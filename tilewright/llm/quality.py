"""Quality of documents: classifier evidence combined with host and path posteriors.

1. *Evidence*: two logistic models (low quality, toxic) over figures of the text: share of capitals,
   symbols, digits and table bars, word lengths, repetition of words and lines, and naive-Bayes evidence of
   its words. They are fitted on a sample of about ``fit_rows`` labelled documents, chosen by a
   hash of the id; that bound is a parameter. A sampled document's own words are
   left out of its naive-Bayes evidence.
2. *Sites*: per host, and per path of a host, the labels (or where there is none, the
   classifier's probabilities) are summed by grouped aggregation over all documents. Rates of hosts
   are shrunk toward the global rate and rates of paths toward their host's, with strengths from
   the method of moments (empirical Bayes): the fewer documents, the more. A document's own
   share is left out.
3. *Decision*: the evidence, freed from the base rate of the sample, is added to the log-odds of the
   path. A document is rejected if either probability exceeds ``limit``.

Labels of a document that is labelled repeatedly: the lowest quality and the highest toxicity.
A null label teaches nothing. Null texts are empty. A null host or path is a site of its own.
Without labels every probability is 0.5 or less and all documents are kept. Repeated rows and extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALPHANUMERIC, Texts, Words, byte_class, distinct
from .store import discard, materialise, without

U = np.uint64
BUCKET_BITS = 17  # word counts are kept per bucket of the hash: a bound on the table
NOT_NEWLINE = byte_class([(0x0A, 0x0A)])
_kinds = np.zeros((6, 256))  # capital, letter, digit, plain punctuation or space, exclamation, bar
_kinds[0, 65:91] = 1
_kinds[1, 65:91] = _kinds[1, 97:123] = _kinds[1, 128:] = 1
_kinds[2, 48:58] = 1
_kinds[3, [9, 10, 13, 32, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 1
_kinds[4, 33] = 1
_kinds[5, 124] = 1
FEATURES = ["capitals", "symbols", "digits", "exclamations", "bars", "log_words", "word_length", "distinct_words", "common_word", "repeated_lines",
            "bad_words", "bad_worst", "toxic_words", "toxic_worst", "toxic_share"]


class Evidence:
    """Documents of each label in which a bucket's words occur, and their log-likelihood ratios."""

    def __init__(self, rows: pd.DataFrame, totals: np.ndarray):
        self.counts = np.zeros((4, 1 << BUCKET_BITS))
        for i, name in enumerate(("bad", "good", "toxic", "civil")):
            self.counts[i, rows["bucket"].to_numpy(np.int64)] = rows[name]
        self.totals = totals

    def ratio(self, target: int, bucket: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Per word; ``own`` is the document's own label (1, 0, or -1 for none)."""
        yes, no = self.counts[2 * target][bucket] - (own == 1), self.counts[2 * target + 1][bucket] - (own == 0)
        n_yes, n_no = self.totals[2 * target] - (own == 1), self.totals[2 * target + 1] - (own == 0)
        out = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
        return np.where(yes + no >= 3, np.clip(out, -4, 6), 0.0)


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return distinct(words.row, words.code >> U(64 - BUCKET_BITS))


def count_words(labelled: DataFrame) -> Evidence:
    """labelled: text, bad and toxic (0, 1 or null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(0))
            label = np.stack([batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in (1, 2)])
            for first, last in texts.parts():
                row, bucket = buckets(Words(texts, first, last, ALPHANUMERIC))
                own = label[:, first:last][:, row.astype(np.int64)]
                place, back = np.unique(bucket, return_inverse=True)
                sums = [np.bincount(back, own[i] == v, minlength=len(place)) for i in (0, 1) for v in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), *[pa.array(s.astype(np.int64)) for s in sums]], names=["bucket", "bad", "good", "toxic", "civil"])

    schema = "bucket bigint, bad bigint, good bigint, toxic bigint, civil bigint"
    sums = [F.sum(k).alias(k) for k in ("bad", "good", "toxic", "civil")]
    rows = labelled.select("text", "bad", "toxic").mapInArrow(count, schema).groupBy("bucket").agg(*sums).toPandas()  # at most 2**17 rows
    n = labelled.agg(*[F.sum(F.coalesce((F.col(k) == v).cast("int"), F.lit(0))) for k in ("bad", "toxic") for v in (1, 0)]).first()
    return Evidence(rows, np.array([x or 0 for x in n], float))


def features(docs: DataFrame, evidence: Evidence) -> DataFrame:
    """docs: doc_id, host, path, text, own_bad, own_toxic (the sample's labels). One column per feature."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text"))
            own = np.stack([batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in ("own_bad", "own_toxic")])
            for first, last in texts.parts():
                n = last - first
                data = texts.bytes[int(texts.offsets[first]) : int(texts.offsets[last])]
                sizes = np.diff(texts.offsets[first : last + 1])
                starts = texts.offsets[first:last] - texts.offsets[first]
                # bytes of each kind per row: a histogram of (row, byte)
                kinds = np.zeros((n, 6))
                for low in range(0, n, 256):
                    high = min(low + 256, n)
                    row = np.repeat(np.arange(high - low), sizes[low:high])
                    part = data[int(starts[low]) : int(starts[high - 1] + sizes[high - 1])]
                    kinds[low:high] = np.bincount(row * 256 + part, minlength=(high - low) * 256).reshape(-1, 256) @ _kinds.T
                length, letters = np.maximum(sizes, 1), np.maximum(kinds[:, 1], 1)
                words = Words(texts, first, last, ALPHANUMERIC)
                lines = Words(texts, first, last, NOT_NEWLINE)
                count = np.maximum(words.counts, 1)
                row, bucket = buckets(words)
                row, bucket = row.astype(np.int64), bucket.astype(np.int64)
                kept = np.maximum(np.bincount(row, minlength=n), 1)
                order = np.lexsort((words.code, words.row))
                r, c = words.row[order], words.code[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
                most = np.zeros(n)
                np.maximum.at(most, r[new], np.diff(np.append(np.flatnonzero(new), len(r))))
                unlike = np.bincount(r[new], minlength=n)
                unlike_lines = np.bincount(distinct(lines.row, lines.code)[0].astype(np.int64), minlength=n)
                x = [kinds[:, 0] / letters, (sizes - kinds[:, 1:6].sum(1)) / length, kinds[:, 2] / length, kinds[:, 4] / length, kinds[:, 5] / length, np.log1p(words.counts),
                     np.bincount(words.row, words.end - words.begin, minlength=n) / count, unlike / count, most / count, 1 - unlike_lines / np.maximum(lines.counts, 1)]
                for target in (0, 1):
                    ratio = shared.value.ratio(target, bucket, own[target, first:last][row])
                    worst = np.full(n, -4.0)
                    np.maximum.at(worst, row, ratio)
                    x += [np.bincount(row, ratio, minlength=n) / kept, worst]
                strong = np.bincount(row, ratio > 2.5, minlength=n)
                x.append(np.log1p(strong))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, n) for k in ("doc_id", "host", "path", "own_bad", "own_toxic")] + [pa.array(v.astype(float)) for v in x],
                                                 names=["doc_id", "host", "path", "own_bad", "own_toxic", *FEATURES])

    schema = "doc_id bigint, host string, path string, own_bad int, own_toxic int, " + ", ".join(f"{k} double" for k in FEATURES)
    return docs.select("doc_id", "host", "path", "own_bad", "own_toxic", "text").mapInArrow(measure, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float, float]:
    """Weights for raw features, intercept and base rate, by Newton steps with a ridge penalty."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y):
        return np.zeros(x.shape[1]), 0.0, 0.5
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(y)), np.clip((x - mean) / scale, -10, 10)])
    w = np.zeros(z.shape[1])
    w[0] = np.log(rate / (1 - rate))
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
    return w[1:] / scale, float(w[0] - (w[1:] * mean / scale).sum()), float(rate)


def shrunk(found: DataFrame, name: str) -> DataFrame:
    """Add ``rate_<name>``: the path's rate of ``y_<name>`` without the document itself, shrunk
    toward its host's, itself shrunk toward the global one."""
    y = f"y_{name}"

    def strength(table: DataFrame, prior) -> float:
        """Method of moments over the groups: pseudo-documents that the prior is worth."""
        some = table.where("n > 1").select("n", (F.col("s") / F.col("n")).alias("r"), prior.alias("m"))
        got = some.agg(F.avg(F.pow(F.col("r") - F.col("m"), 2)).alias("spread"), F.avg(F.col("m") * (1 - F.col("m")) / F.col("n")).alias("noise"), F.avg(F.col("m") * (1 - F.col("m"))).alias("one")).first()
        if got.one is None:
            return 100.0
        between = max(got.spread - got.noise, got.one / 1000)
        return float(min(max(got.one / between - 1, 1.0), 1000.0))

    hosts = materialise(found.groupBy("host").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")), "hosts")
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (total.s + 0.5) / (total.n + 1) if total.n else 0.5
    a = strength(hosts, F.lit(mean))
    paths = found.groupBy("host", "path").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
    h = hosts.select(F.col("host").alias("_h"), F.col("s").alias("_hs"), F.col("n").alias("_hn"))
    paths = materialise(paths.join(h, F.col("host").eqNullSafe(F.col("_h"))), "paths")
    b = strength(paths, (F.col("_hs") + a * mean) / (F.col("_hn") + a))
    paths = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "s", "n", "_hs", "_hn")
    host_rate = (F.col("_hs") - F.col(y) + a * mean) / (F.col("_hn") - 1 + a)
    out = found.join(paths, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    return out.withColumn(f"rate_{name}", (F.col("s") - F.col(y) + b * host_rate) / (F.col("n") - 1 + b)).drop("_h", "_p", "_hs", "_hn", "s", "n")


def assess(docs: DataFrame, labels: DataFrame, limit: float = 0.5, fit_rows: int = 20_000) -> DataFrame:
    """docs: doc_id, text, host, path; labels: doc_id, quality (1 good, 0 bad), toxic (0, 1).

    Returns doc_id, host, path, p_bad, p_toxic, rate_bad, rate_toxic (of its path, shrunk) and kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    labels = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (1 - F.min("quality")).cast("int").alias("bad"), F.max("toxic").cast("int").alias("toxic"))
    labels = materialise(labels, "labels")
    share = min(1.0, fit_rows / max(labels.count(), 1))
    sample = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = sample.select(F.col("doc_id").alias("_id"), F.col("bad").alias("own_bad"), F.col("toxic").alias("own_toxic"))
    own = docs.join(F.broadcast(sample), docs["doc_id"] == sample["_id"], "left")  # about fit_rows rows of 16 bytes
    evidence = count_words(own.where("_id IS NOT NULL").select("text", F.col("own_bad").alias("bad"), F.col("own_toxic").alias("toxic")))
    found = measured = materialise(features(own, evidence), "features")

    fitted = found.where("own_bad IS NOT NULL OR own_toxic IS NOT NULL").select("own_bad", "own_toxic", *FEATURES).toPandas()
    found = found.drop("own_bad", "own_toxic").join(labels, "doc_id", "left")
    rates = {}
    for name, target in (("bad", "own_bad"), ("toxic", "own_toxic")):
        rows = fitted[fitted[target].notna()]
        weight, constant, rates[name] = logistic(rows[FEATURES].to_numpy(float), rows[target].to_numpy(float))
        # clipped like the training figures, so that an odd document stays within reason
        low, high = (rows[FEATURES].quantile(q).to_numpy(float) if len(rows) else np.zeros(len(FEATURES)) for q in (0, 1))
        found = found.withColumn(f"e_{name}", sum((F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col(k))) * float(w) for k, w, a, b in zip(FEATURES, weight, low, high)), F.lit(constant)))
    odds = lambda p: F.log(p / (1 - p))
    chance = lambda e: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e))))
    found = found.select("doc_id", "host", "path", "e_bad", "e_toxic", F.coalesce(F.col("bad").cast("double"), chance(F.col("e_bad"))).alias("y_bad"),
                         F.coalesce(F.col("toxic").cast("double"), chance(F.col("e_toxic"))).alias("y_toxic"))
    found = materialise(found, "evidence")
    discard(measured)
    for name in ("bad", "toxic"):
        found = shrunk(found, name)
        rate = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(f"rate_{name}")))
        base = float(np.log(rates[name] / (1 - rates[name])))
        found = found.withColumn(f"p_{name}", chance(F.col(f"e_{name}") - base + odds(rate)))
    return found.select("doc_id", "host", "path", "p_bad", "p_toxic", "rate_bad", "rate_toxic", ((F.col("p_bad") <= limit) & (F.col("p_toxic") <= limit)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host, path) -> DataFrame:
    """``docs`` without the rejected ones; rows with null ids stay."""
    judged = assess(docs.withColumns({"host": host, "path": path}), labels)
    return without(docs, judged.where(~F.col("kept")))
