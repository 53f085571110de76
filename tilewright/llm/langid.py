"""Language of whole texts by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public vocabulary (a sentencepiece
model file, read only). The probability of a word is the sum over all its segmentations into
pieces, computed by a forward algorithm; the text's is the product over its words. Pieces never
cross words, so each distinct word of a block of text is scored once.

Words are runs of letters (A-Z lower-cased; every non-ASCII byte counts as one), of any length: many words of up to
32 bytes are scored together, longer ones one by one in the log domain. All pieces of letters are used. A word begins with a word-initial piece, or with the
bare word mark. Single bytes are pieces of every language, so no word has probability zero.

Piece probabilities are estimated by expectation-maximisation (forward-backward over the
words' counts, in Spark tasks) from a sample of about ``fit_docs`` labelled documents; this bound
is a parameter. It is drawn per language by a hash of id and text: all rows of rare languages, and
the rest shared evenly by the others, at least LEAST documents each. Priors are counted over
all labelled documents.

Null texts and texts without any letter are ``und`` with score 0; so are all, if nothing is
labelled. The score is the posterior of the predicted language. Ties go to the first
language by code point. Rows with null ids may be learned from. Repeated rows and extra
columns don't matter; more than ``max_langs`` languages are an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import BASE, BYTE_VALUE, LETTERS, LOWER, Texts, Words

U = np.uint64
LONGEST = 32  # bytes of words that are scored together
PIECE_BYTES = 256  # an upper bound on the vocabulary's pieces, which is checked
TABLE_BITS = 20
LEAST = 32  # documents of a language in the sample, if it has as many
FLOOR = 0.01  # share of the uniform distribution
POWER = np.array([pow(BASE, i, 1 << 64) for i in range(PIECE_BYTES + 1)], U)
SPREAD = U(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 1, F.lit(False))


class Pieces:
    """Piece numbers by the hash of their bytes: 256 single bytes, then inner and word-initial pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        first: dict[bytes, int] = {}
        n = 256
        for i in range(model.get_piece_size()):
            if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            table, text = (first, text[1:]) if text.startswith("▁") else (inner, text)
            raw = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
            if len(raw) > PIECE_BYTES:
                raise ValueError(f"a piece of {len(raw)} bytes")
            if (not raw or LETTERS[np.frombuffer(raw, np.uint8)].all()) and raw not in table:
                table[raw], n = n, n + 1
        self.size = n
        self.longest = max(map(len, [*inner, *first]))
        self.mark = first.pop(b"", None)
        if self.mark is None:
            self.mark, self.size = n, n + 1
        self.inner, self.first = self._table(inner), self._table(first)

    def _table(self, pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
        keys, ids, probes = np.zeros(1 << TABLE_BITS, U), np.full(1 << TABLE_BITS, -1, np.int32), 1
        for raw, number in pieces.items():
            data = np.frombuffer(raw, np.uint8)
            key = (BYTE_VALUE[data] * POWER[: len(data)]).sum(dtype=U)
            at, turn = int((np.array([key]) * SPREAD)[0] >> U(64 - TABLE_BITS)), 1
            while ids[at] >= 0:
                at, turn = (at + 1) % (1 << TABLE_BITS), turn + 1
            keys[at], ids[at], probes = key, number, max(probes, turn)
        return keys, ids, probes

    @staticmethod
    def look_up(table: tuple, key: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        keys, ids, probes = table
        at = ((key * SPREAD) >> U(64 - TABLE_BITS)).astype(np.int64)
        out = ids[at]
        wrong = np.flatnonzero((out >= 0) & (keys[at] != key))
        for turn in range(1, probes):
            if not len(wrong):
                break
            near = (at[wrong] + turn) % (1 << TABLE_BITS)
            out[wrong] = ids[near]
            wrong = wrong[(ids[near] >= 0) & (keys[near] != key[wrong])]
        out[wrong] = -1
        return out


def arcs(pieces: Pieces, words: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, rows, piece numbers) of all pieces in ``words`` (rows of bytes, longest first), by
    end. Begin -1: the word mark comes first."""
    longest = int(length[0]) if len(length) else 0
    value = BYTE_VALUE[words]
    active = [int(np.searchsorted(-length, -j, "right")) for j in range(longest + 1)]  # rows of at least j bytes
    keys = [np.zeros(active[i], U) for i in range(longest)]
    yield -1, 0, np.arange(len(words)), np.full(len(words), pieces.mark)
    for end in range(1, longest + 1):
        n = active[end]
        for begin in range(max(0, end - pieces.longest), end):
            keys[begin] = keys[begin][:n] + value[:n, end - 1] * POWER[end - begin - 1]
            found = Pieces.look_up(pieces.inner, keys[begin])
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                yield begin, end, rows, found[rows]
            if begin == 0:
                found = Pieces.look_up(pieces.first, keys[0])
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield -1, end, rows, found[rows]


def forward(pieces: Pieces, words: np.ndarray, length: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word (longest first) in each language; prob: (pieces, languages)."""
    alpha = np.zeros((LONGEST + 1, len(words), prob.shape[1]))
    for begin, end, rows, ids in arcs(pieces, words, length):
        alpha[end][rows] += prob[ids] if begin < 0 else alpha[begin][rows] * prob[ids]
    return np.log(np.maximum(alpha[length, np.arange(len(words))], 1e-300))


def expected(pieces: Pieces, words: np.ndarray, length: np.ndarray, count: np.ndarray, lang: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected number of each piece per language, over all segmentations of the counted words."""
    n = len(words)
    alpha, beta = np.zeros((LONGEST + 1, n)), np.zeros((LONGEST + 1, n))
    steps = []
    for begin, end, rows, ids in arcs(pieces, words, length):
        p = prob[ids, lang[rows]]
        alpha[end][rows] += p if begin < 0 else alpha[begin][rows] * p
        steps.append((begin, end, rows, ids, p))
    whole = np.maximum(alpha[length, np.arange(n)], 1e-300)
    beta[length, np.arange(n)] = 1
    out = np.zeros(prob.shape)
    for begin, end, rows, ids, p in reversed(steps):
        after = beta[end][rows] * p
        np.add.at(out, (ids, lang[rows]), count[rows] * after * (1.0 if begin < 0 else alpha[begin][rows]) / whole[rows])
        if begin >= 0:
            beta[begin][rows] += after
    return out


def cut_words(texts: Texts, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of bytes, length, index into ``which``) of the words of up to LONGEST bytes, longest first."""
    length = words.end[which] - words.begin[which]
    owner = np.flatnonzero(length <= LONGEST)
    owner = owner[np.argsort(-length[owner], kind="stable")]
    begin, length = words.begin[which][owner], length[owner]
    at = np.minimum(begin[:, None] + np.arange(LONGEST), max(len(texts.bytes) - 1, 0))
    return texts.bytes[at], length, owner


def long_words(texts: Texts, words: Words, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(index into ``which``, bytes) of the longer words."""
    for i in np.flatnonzero(words.end[which] - words.begin[which] > LONGEST).tolist():
        yield i, texts.bytes[words.begin[which[i]] : words.end[which[i]]]


def ending(pieces: Pieces, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers by end (from 1) and length (from 1), -1 where there is none: those inside a word, and those that begin it."""
    n, width = len(word), min(pieces.longest, len(word))
    inner, value, key = np.full((n + 1, width), -1, np.int32), BYTE_VALUE[word], np.zeros(n, U)
    first = np.full(n + 1, -1, np.int32)
    for size in range(1, width + 1):
        key = key[: n - size + 1] + value[size - 1 :] * POWER[size - 1]
        inner[size:, size - 1] = Pieces.look_up(pieces.inner, key)
        first[size] = Pieces.look_up(pieces.first, key[:1])[0]
    return inner, first


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def long_forward(pieces: Pieces, word: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    """``forward`` for one word of any length; logarithms (pieces and a last row of -inf, languages). Row i of the
    result is the sum over all segmentations of the first i bytes."""
    inner, first = ending(pieces, word)
    width = inner.shape[1]
    alpha = np.full((width + len(word) + 1, log_prob.shape[1]), -np.inf)  # place 0 is row ``width``
    alpha[width] = log_prob[pieces.mark]
    for end in range(1, len(word) + 1):
        terms = log_prob[inner[end]] + alpha[width + end - 1 : end - 1 : -1]
        alpha[width + end] = _log_sum(np.concatenate([terms, log_prob[first[end]][None]]) if end <= width else terms)
    return alpha[width:]


def long_expected(pieces: Pieces, word: np.ndarray, count: float, lang: int, log_prob: np.ndarray, out: np.ndarray) -> None:
    """``expected`` for one word of any length, added to ``out``."""
    own = np.ascontiguousarray(log_prob[:, lang : lang + 1])
    inner, first = ending(pieces, word)
    n, width = len(word), inner.shape[1]
    alpha = long_forward(pieces, word, own)[:, 0]
    beta = np.full(n + width + 1, -np.inf)
    beta[n] = 0.0
    ends, sizes = np.arange(n + 1)[:, None], np.arange(1, width + 1)[None, :]
    begins = ends - sizes
    following = np.full((n, width), -1, np.int32)  # pieces by begin
    inside = begins >= 0
    following[begins[inside], np.broadcast_to(sizes - 1, inside.shape)[inside]] = inner[inside]
    for begin in range(n - 1, -1, -1):
        beta[begin] = _log_sum(own[following[begin], 0] + beta[begin + 1 : begin + width + 1])
    b, k = np.nonzero(following >= 0)
    ids = following[b, k]
    np.add.at(out, (ids, lang), count * np.exp(alpha[b] + own[ids, 0] + beta[b + k + 1] - alpha[n]))
    e = np.flatnonzero(first >= 0)
    np.add.at(out, (first[e], lang), count * np.exp(own[first[e], 0] + beta[e] - alpha[n]))
    out[pieces.mark, lang] += count * np.exp(own[pieces.mark, 0] + beta[0] - alpha[n])


def logs_of(prob: np.ndarray) -> np.ndarray:
    """Logarithms, with a last row for a piece that doesn't exist."""
    return np.log(np.concatenate([np.maximum(prob, 1e-300), np.full((1, prob.shape[1]), 1e-300)]))


class Model:
    def __init__(self, pieces: Pieces, langs: list[str], log_prior: np.ndarray, prob: np.ndarray):
        self.pieces, self.langs, self.log_prior, self.prob = pieces, langs, log_prior, prob


def _smooth(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(0), 1e-9)
    return (1 - FLOOR) * counts / total + FLOOR / len(counts)


def level(sizes: np.ndarray, total: float) -> float:
    """The bound per language at which min(size, bound) add up to ``total``, LEAST or more."""
    left, bound = float(total), np.inf
    ordered = np.sort(sizes)
    for i, size in enumerate(ordered):
        if size * (len(ordered) - i) > left:
            bound = left / (len(ordered) - i)
            break
        left -= size
    return max(bound, LEAST)


def draw(labelled: DataFrame, langs: list[str], sizes: np.ndarray, fit_docs: int) -> DataFrame:
    """The rows of ``labelled`` to learn from: the same bound for every language."""
    bound, parts = level(sizes, fit_docs), 10**12
    limits = labelled.sparkSession.createDataFrame([(x, int(min(1.0, bound / n) * parts)) for x, n in zip(langs, sizes.tolist())], "lang string, _limit bigint")
    rows = labelled.select("doc_id", "text", "lang").join(F.broadcast(limits), "lang")  # at most max_langs rows
    return rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(parts)) < F.col("_limit")).drop("_limit")


def fit(docs: DataFrame, fit_docs: int = 8000, rounds: int = 2, path: str | None = None, max_langs: int = 1000) -> Model | None:
    """A model of the languages of ``docs`` (text, lang, doc_id), None if no row has both text and lang."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()
    if not counts:
        return None
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    counts.sort(key=lambda r: r.lang)
    langs, sizes = [r.lang for r in counts], np.array([r.n for r in counts], float)
    pieces = Pieces(path or vocabulary_path())
    number = {x: i for i, x in enumerate(langs)}
    sample = draw(labelled, langs, sizes, fit_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lang = Texts(batch.column(0)), np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, last in texts.parts():
                words = Words(texts, first, last, LETTERS)
                order = np.lexsort((words.code, lang[first + words.row]))
                code, own = words.code[order], lang[first + words.row][order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
                at = np.flatnonzero(new)
                some = order[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at].astype(np.int32)), pa.array([LOWER[texts.bytes[a:b]].tobytes() for a, b in zip(words.begin[some], words.end[some])], pa.binary()),
                     pa.array(np.diff(np.append(at, len(code))))], names=["lang", "word", "n"])

    table = sample.select("text", "lang").mapInArrow(count, "lang int, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    prob = np.full((pieces.size, len(langs)), 1 / pieces.size)
    for _ in range(rounds):

        def estimate(batches: Iterator[pa.RecordBatch], prob=prob) -> Iterator[pa.RecordBatch]:
            total, log_prob = np.zeros(prob.shape), logs_of(prob)
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    part = batch.slice(low, 2000)
                    texts = Texts(pa.array(part.column(1).to_pylist(), pa.large_binary()).view(pa.large_string()))
                    spans = Words.__new__(Words)
                    spans.begin, spans.end = texts.offsets[:-1], texts.offsets[1:]
                    rows, length, owner = cut_words(texts, spans, np.arange(part.num_rows))
                    times, own = part.column(2).to_numpy().astype(float), part.column(0).to_numpy()
                    total += expected(pieces, rows, length, times[owner], own[owner], prob)
                    for i, word in long_words(texts, spans, np.arange(part.num_rows)):
                        long_expected(pieces, word, times[i], int(own[i]), log_prob, total)
            piece, own = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(total[piece, own])], names=["piece", "lang", "n"])

        rows = table.mapInArrow(estimate, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros(prob.shape)
        new[rows["piece"], rows["lang"]] = rows["n"]
        prob = _smooth(new)
    table.unpersist()
    return Model(pieces, langs, np.log(sizes / sizes.sum()), prob)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_once = max(64, 120_000 // len(model.langs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_prob = logs_of(m.prob)
        for batch in batches:
            texts = Texts(batch.column(1))
            for first, last in texts.parts(1 << 23):
                words = Words(texts, first, last, LETTERS)
                _, some, back = np.unique(words.code, return_index=True, return_inverse=True)
                logs = np.zeros((len(some), len(m.langs)))
                data, length, owner = cut_words(texts, words, some)
                for low in range(0, len(owner), at_once):
                    use = slice(low, low + at_once)
                    logs[owner[use]] = forward(m.pieces, data[use], length[use], m.prob)
                for i, word in long_words(texts, words, some):
                    logs[i] = long_forward(m.pieces, word, log_prob)[-1]
                total = np.stack([np.bincount(words.row, logs[back, k], minlength=last - first) for k in range(len(m.langs))], 1) + m.log_prior
                best = total.argmax(1)
                sure = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
                ascii_letter = np.concatenate([[0], np.cumsum(LETTERS[LOWER[texts.bytes[words.begin]]] & (texts.bytes[words.begin] < 128))]) if len(words.begin) else np.zeros(1)
                names = []
                for i in range(last - first):
                    a, b = words.row_starts[i], words.row_starts[i + 1]
                    known = b > a and (ascii_letter[b] > ascii_letter[a] or any(c.isalpha() for c in texts.text(first + i).decode()))
                    names.append(m.langs[best[i]] if known else "und")
                    if not known:
                        sure[i] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(names, pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(score, "doc_id bigint, lang_pred string, score double")
