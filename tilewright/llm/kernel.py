"""Words and word hashes of whole Arrow string columns, computed with numpy on the UTF-8 bytes.

Every separator used by the operators is an ASCII character, so texts are cut into words on
their bytes. Hashes are 64 bits wide: a polynomial over per-byte random values, then mixed.
Two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at a time; bounds the temporary arrays (about 50 bytes each), not the texts
U = np.uint64


def byte_class(pairs: list[tuple[int, int]]) -> np.ndarray:
    """Truth table of the bytes that lie in none of the ranges."""
    table = np.ones(256, bool)
    for low, high in pairs:
        table[low : high + 1] = False
    return table


NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])  # after lower-casing A-Z
LETTERS = byte_class([(0x00, 0x60), (0x7B, 0x7F)])  # after lower-casing A-Z; every non-ASCII byte counts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes ``x`` (uint64) in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


STEP = U(0x9E3779B97F4A7C15)


def step(n: int) -> np.uint64:
    return U(int(STEP) * n % 2**64)


EXACT_VALUE = mix((np.arange(256, dtype=U) + U(1)) * STEP)
BYTE_VALUE = EXACT_VALUE[LOWER]  # A-Z hash as a-z
BASE = 0xD6E8FEB86659FD93
PLACE = mix((np.arange(64, dtype=U) + U(1001)) * STEP) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """base**i modulo 2**64 for i < size."""
    out = np.empty(size, U)
    out[0], done = 1, 1
    while done < size:
        n = min(done, size - done)
        out[done : done + n] = out[:n] * U(pow(base, done, 1 << 64))
        done += n
    return out


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, PIECE + 1)
        _powers["up"], _powers["down"] = _power(BASE, size), _power(pow(BASE, -1, 1 << 64), size)
    return _powers["up"], _powers["down"]


class Texts:
    """The bytes of a string column (null: empty) and the place of each row in them."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        data = buffers[2]
        self.bytes = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
        self.offsets = offsets - first
        self.rows = len(column)

    def parts(self, limit: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
        """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
        row = 0
        while row < self.rows:
            end = int(np.searchsorted(self.offsets, self.offsets[row] + limit, "right")) - 1
            end = min(max(end, row + 1), self.rows)
            yield row, end
            row = end

    def text(self, row: int) -> bytes:
        return self.bytes[self.offsets[row] : self.offsets[row + 1]].tobytes()


class Words:
    """Words of rows first..last: begin and end byte in Texts.bytes, row (counted from first), hash."""

    def __init__(self, texts: Texts, first: int, last: int, table: np.ndarray, hashes: bool = True, values: np.ndarray = BYTE_VALUE):
        low, high = int(texts.offsets[first]), int(texts.offsets[last])
        row_starts = texts.offsets[first : last + 1]
        begins, ends, codes = [], [], []
        at = low
        while at < high:
            to = min(at + PIECE, high)
            piece = texts.bytes[at:to]
            inside = table[LOWER[piece]]
            if to < high:  # cut behind the last separator, or go on to the next one
                gaps = np.flatnonzero(~inside)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to < high and table[LOWER[texts.bytes[to]]]:
                        step = texts.bytes[to : min(to + PIECE, high)]
                        stop = np.flatnonzero(~table[LOWER[step]])
                        to = to + (int(stop[0]) if len(stop) else len(step))
                piece = texts.bytes[at:to]
                inside = table[LOWER[piece]]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            closes = inside.copy()
            closes[:-1] &= ~inside[1:]
            edges = row_starts[np.searchsorted(row_starts, at, "left") : np.searchsorted(row_starts, to, "left")] - at
            opens[edges] = inside[edges]
            inner = edges[edges > 0] - 1
            closes[inner] = inside[inner]
            b, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            if hashes:
                codes.append(hash_spans(piece, b, e, values))
            begins.append(b + at)
            ends.append(e + at)
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.begin, self.end = join(begins, np.int64), join(ends, np.int64)
        self.code = join(codes, U)
        self.row_starts = np.searchsorted(self.begin, row_starts, "left")  # first word of each row
        self.counts = np.diff(self.row_starts)
        self.row = np.repeat(np.arange(last - first), self.counts)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Hash of the bytes begin..end of ``data``, equal for equal strings; A-Z as a-z, unless by EXACT_VALUE."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    out = (total[end] - total[begin]) * down[begin]
    out += (end - begin).astype(U) * STEP
    return mix(out)


def hash_text(text: str) -> int:
    """The hash that Words gives to this word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


def shingles(words: Words, width: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``width`` consecutive words of a row. With ``whole``, a row with
    fewer words gives its whole sequence as one shingle."""
    n = len(words.code)
    codes, rows = np.empty(0, U), np.empty(0, np.int64)
    if n >= width:
        same = words.row[: n - width + 1] == words.row[width - 1 :]
        codes = np.zeros(n - width + 1, U)
        for j in range(width):
            codes += words.code[j : n - width + 1 + j] * PLACE[j]
        codes, rows = mix(codes[same] + U(width)), words.row[: n - width + 1][same]
    if whole:
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        if len(short):
            place = np.arange(width)
            use = place[None, :] < words.counts[short][:, None]
            at = np.minimum(words.row_starts[short][:, None] + place[None, :], n - 1)
            extra = mix((words.code[at] * PLACE[:width][None, :] * use.astype(U)).sum(1, dtype=U) + words.counts[short].astype(U))
            codes, rows = np.concatenate([codes, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            codes, rows = codes[order], rows[order]
    return rows, codes


def distinct(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code), sorted."""
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[new], codes[new]


def signed(codes: np.ndarray) -> pa.Array:
    """Hashes as Spark's bigint."""
    return pa.array(np.ascontiguousarray(codes).view(np.int64))


BITS = 24  # of bitmaps: 2 MB each, whatever they hold


def hit(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & U((1 << BITS) - 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0


class HashTable:
    """Place of 64-bit keys in an array: open addressing, built and searched by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slots, self.keys, self.probes = np.full(1 << self.bits, -1, np.int32), keys, 1
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # one of those that meet stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * STEP) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 where a key is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for turn in range(1, self.probes):
            if not len(wrong):
                break
            out[wrong] = self.slots[(at[wrong] + turn) & ((1 << self.bits) - 1)]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        out[wrong] = -1
        return out


def chars_before(data: np.ndarray, base: int, places: np.ndarray) -> np.ndarray:
    """Code points between byte ``base`` and each of the bytes ``places``."""
    if not len(places):
        return np.zeros(0, np.int64)
    top = int(np.max(places))
    lead = np.concatenate([[0], np.cumsum((data[base:top] & 0xC0) != 0x80)])
    return lead[np.asarray(places) - base]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of batches that are sorted by integer key columns."""
    key, group = None, []
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            own = tuple(values[:, low].tolist())
            if own != key and group:
                yield key, pa.Table.from_batches(group)
                group = []
            key = own
            group.append(batch.slice(low, high - low))
    if group:
        yield key, pa.Table.from_batches(group)
