"""Secrets in whole documents: fixed patterns, and formats inferred from what they find.

*Base*: leftmost non-overlapping matches of three patterns (below); failing matches are dropped.

*Grammar inference* (ALERGIA; Carrasco and Oncina, 1994): the credentials that the base finds are
labelled with their kind and written as strings of character classes, with an end mark. Spark counts how often
every prefix occurs, over all documents; the prefix tree of each kind keeps the nodes that at
least one in ``rare`` of its strings pass (a bound on its size, whatever the input). Going
down the tree, a node is merged with the first state whose continuations are statistically
compatible (Hoeffding bound on end and next-class frequencies, down the subtrees), or else becomes a
state. The result is one probabilistic automaton per kind. How probable a length is comes from the lengths
of the kind, widened by a quarter, so that other lengths are less likely, not ruled out.

*Scoring*: every other run of 8 or more characters of the assign alphabet is a candidate, without stops and hyphens around it.
Its likelihood under an automaton (characters of a class being equally likely) is divided by that under a
character bigram model of all candidates of the corpus, which knows how words, numbers and addresses look there. Where
the logarithm reaches ``threshold``, the run is added as kind ``format``.

Spans are in code points, end exclusive. Null texts are empty; a table without any base match
has no automata and adds nothing. Repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, Texts, chars_before
from .store import materialise

# The base patterns and least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_VALUE = 8
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_CHARS = 16
HEX_CHARS = 32
KINDS = ["assign", "access", "hex", "format"]

STEMS = [b"passw", b"secret", b"token", b"api"]  # one of them opens every assign match
TOKEN_CHARS = 8


def _members(text: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text)] = True
    return table


IS_HEX = _members(b"0123456789abcdef")
IS_TOKEN = _members(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
IS_AROUND = _members(b".-")
# character classes: digit, a-f, g-z, A-F, G-Z, each of the other token characters, anything else
CLASSES = "dxlXL+/_.=-?"
SIZES = [10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1, 161]
END = "$"
PLACE_OF = np.full(256, len(CLASSES) - 1, np.uint8)
for _low, _high, _name in ((48, 57, "d"), (97, 102, "x"), (103, 122, "l"), (65, 70, "X"), (71, 90, "L")):
    PLACE_OF[_low : _high + 1] = CLASSES.index(_name)
for _name in "+/_.=-":
    PLACE_OF[ord(_name)] = CLASSES.index(_name)
CLASS = np.frombuffer(CLASSES.encode(), np.uint8)[PLACE_OF]
EDGE = 256  # stands before and behind a candidate in the bigram model

SPAN = "struct<kind: string, start: bigint, end: bigint>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def runs(data: np.ndarray, table: np.ndarray, least: int, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, begin, end) of the maximal runs of at least ``least`` bytes of ``table`` inside one row.

    Such a run holds two neighbouring multiples of least // 2 and all between them, so only
    places where that holds are looked at closely."""
    step = least // 2
    grid = table[data[::step]]
    at = np.flatnonzero(grid[:-1] & grid[1:])
    for offset in range(1, step):
        if not len(at):
            return []
        at = at[table[data[at * step + offset]]]
    found, done = [], 0
    for place in (at * step).tolist():
        if place < done:
            continue
        row = int(np.searchsorted(bounds, place, "right")) - 1
        a, b, low, high = place, place, int(bounds[row]), int(bounds[row + 1])
        while a > low and table[data[a - 1]]:
            a -= 1
        while b < high and table[data[b]]:
            b += 1
        if b - a >= least:
            found.append((row, a, b))
        done = b
    return found


def _rows_with(data: bytes, needles: list[bytes], bounds: np.ndarray) -> np.ndarray:
    at = []
    for needle in needles:
        place = data.find(needle)
        while place >= 0:
            at.append(place)
            place = data.find(needle, place + len(needle))
    return np.unique(np.searchsorted(bounds, np.array(at, np.int64), "right") - 1)


def find(texts: Texts, first: int, last: int) -> list[list[tuple[str, int, int, bytes]]]:
    """Per row: (kind, begin, end, value) of the base matches, in bytes of the row."""
    base = int(texts.offsets[first])
    data = texts.bytes[base : int(texts.offsets[last])]
    bounds = texts.offsets[first : last + 1] - base
    found: list[list] = [[] for _ in range(last - first)]
    raw = data.tobytes()
    for row in _rows_with(LOWER[data].tobytes(), STEMS, bounds):
        for m in ASSIGN.finditer(raw[bounds[row] : bounds[row + 1]]):
            if len(m[2]) >= ASSIGN_VALUE:
                found[row].append(("assign", m.start(), m.end(), m[2]))
    for row in _rows_with(raw, [b"AKIA"], bounds):
        for m in ACCESS.finditer(raw[bounds[row] : bounds[row + 1]]):
            if len(m[0]) >= ACCESS_CHARS:
                found[row].append(("access", m.start(), m.end(), m[0]))
    for row, a, b in runs(data, IS_HEX, HEX_CHARS, bounds):
        found[row].append(("hex", a - int(bounds[row]), b - int(bounds[row]), raw[a:b]))
    return found


def candidates(texts: Texts, first: int, last: int, found: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the rows, and row, begin and end (in those bytes) of the runs that may be secrets and touch no base match."""
    base = int(texts.offsets[first])
    data = texts.bytes[base : int(texts.offsets[last])]
    bounds = texts.offsets[first : last + 1] - base
    inside = IS_TOKEN[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    wide = end - begin >= TOKEN_CHARS
    begin, end = begin[wide], end[wide]
    taken = np.zeros(len(data) + 1, np.int32)
    for row, spans in enumerate(found):
        for _, a, b, _ in spans:
            taken[bounds[row] + a] += 1
            taken[bounds[row] + b] -= 1
    if taken.any():
        covered = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
        free = covered[end] == covered[begin]
        begin, end = begin[free], end[free]
    while (at := np.flatnonzero(IS_AROUND[data[begin]] & (end - begin > 1))).size:
        begin[at] += 1
    while (at := np.flatnonzero(IS_AROUND[data[end - 1]] & (end - begin > 1))).size:
        end[at] -= 1
    wide = end - begin >= TOKEN_CHARS
    begin, end = begin[wide], end[wide]
    return data, np.searchsorted(bounds, begin, "right") - 1, begin, end


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates one after the other, and where each begins."""
    size = end - begin
    start = np.cumsum(size) - size
    return data[np.repeat(begin - start, size) + np.arange(int(size.sum()))], start


def _pairs(chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each character, and behind the last of each candidate."""
    before = np.empty(len(chars), np.int64)
    before[1:] = chars[:-1]
    before[start] = EDGE
    return before, chars[np.append(start[1:], len(chars)) - 1].astype(np.int64)


def classes(value: bytes) -> str:
    return CLASS[np.frombuffer(value, np.uint8)].tobytes().decode()


FORMATS = "kind string, value string, n bigint"
HELD = 100_000  # distinct strings that a task counts before it passes them on


def counts(docs: DataFrame) -> DataFrame:
    """How often each labelled string of classes occurs, per kind, and each pair of characters in candidates (kind '')."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(257 * 257, np.int64)
        strings: dict[tuple[str, str], int] = {}

        def told():
            keys = list(strings)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(strings.values()), pa.int64())], names=["kind", "value", "n"])
            strings.clear()
            return out

        for batch in batches:
            texts = Texts(batch.column(0))
            for first, last in texts.parts():
                found = find(texts, first, last)
                for spans in found:
                    for kind, _, _, value in spans:
                        strings[kind, text] = strings.get((kind, text := classes(value)), 0) + 1
                data, _, begin, end = candidates(texts, first, last, found)
                if len(begin):
                    chars, start = _joined(data, begin, end)
                    before, behind = _pairs(chars, start)
                    pairs += np.bincount(before * 257 + chars, minlength=257 * 257) + np.bincount(behind * 257 + EDGE, minlength=257 * 257)
                if len(strings) > HELD:
                    yield told()
        for at in np.flatnonzero(pairs).tolist():
            strings["", str(at)] = int(pairs[at])
        yield told()

    return docs.select("text").mapInArrow(search, FORMATS).groupBy("kind", "value").agg(F.sum("n").alias("n"))


class Automaton:
    """A probabilistic automaton over character classes, merged from prefix counts."""

    def __init__(self, counts: dict[str, int], alpha: float, usual: dict[str, float]):
        """counts: how many strings begin with each prefix; prefixes below an unlisted one are unlisted. usual: share of each class."""
        symbols = sorted({p[-1] for p in counts if p})
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        kids = {p: {s: counts[p + s] for s in symbols if p + s in counts} for p in counts}
        open_nodes = {p for p in counts if kids[p]}  # others are leaves: ended, or too rare to go on
        states, self.to = [""], [{}]
        self.flow: list[dict[str, float]] = [{}]
        todo = [(0, s) for s in kids[""]]
        self._pass(0, "", counts, kids, usual)
        while todo:
            state, node = todo.pop(0)
            if node not in open_nodes:
                continue  # nothing is known about what follows
            target = next((i for i, x in enumerate(states) if self._compatible(x, node, counts, kids, DEPTH)), None)
            if target is None:
                target = len(states)
                states.append(node)
                self.to.append({})
                self.flow.append({})
                todo += [(target, node + s) for s in kids[node]]
            self._pass(target, node, counts, kids, usual)
            self.to[state].setdefault(node[-1], target)
        self.free = len(states)  # where nothing is known: characters as usual in this kind
        self.to.append({})
        self.flow.append(dict(usual))
        self._tables()

    def _pass(self, state: int, node: str, counts: dict, kids: dict, usual: dict[str, float]) -> None:
        """Count what follows ``node`` into a state; what is too rare to be listed follows as usual."""
        rest = counts[node] - sum(kids[node].values())
        for s in usual:
            self.flow[state][s] = self.flow[state].get(s, 0) + kids[node].get(s, 0) + rest * usual[s]

    def _tables(self) -> None:
        """Next state and log-probability of every class in every state."""
        self.next = np.array([[to.get(s, self.free) for s in CLASSES] for to in self.to])
        seen = np.array([[flow.get(s, 0) for s in CLASSES] for flow in self.flow]) + 0.01
        self.logs = np.log(seen / seen.sum(1, keepdims=True)) - np.log(SIZES)

    def _compatible(self, a: str, b: str, counts: dict, kids: dict, depth: int) -> bool:
        n, m = counts.get(a, 0), counts.get(b, 0)
        if not depth or not kids.get(a) or not kids.get(b) or min(n, m) < 1:
            return True
        room = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        ends = lambda p, k: 1 - sum(kids[p].values()) / k
        if abs(ends(a, n) - ends(b, m)) > room:
            return False
        return all(abs(kids[a].get(s, 0) / n - kids[b].get(s, 0) / m) <= room and self._compatible(a + s, b + s, counts, kids, depth - 1)
                   for s in kids[a].keys() | kids[b].keys())

    def score(self, chars: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log-likelihood of each candidate's characters: the longest first, all at the same place together."""
        symbols, size = PLACE_OF[chars], np.diff(np.append(start, len(chars)))
        order = np.argsort(-size, kind="stable")
        total, state = np.zeros(len(start)), np.zeros(len(start), np.int64)
        open_, steps = len(order), int(size.max()) if len(size) else 0
        for step in range(min(steps, TOGETHER)):
            open_ = int(np.searchsorted(-size[order[:open_]], -step, "left"))
            at = order[:open_]
            symbol = symbols[start[at] + step]
            total[at] += self.logs[state[at], symbol]
            state[at] = self.next[state[at], symbol]
        logs, following = self.logs.tolist(), self.next.tolist()
        for i in order[: int(np.searchsorted(-size[order], -TOGETHER, "left"))].tolist():
            here, more = int(state[i]), 0.0
            for symbol in symbols[start[i] + TOGETHER : start[i] + size[i]].tolist():
                more += logs[here][symbol]
                here = following[here][symbol]
            total[i] += more
        return total


MOST_CLASSES = 64  # a prefix tree is at most that deep; longer strings go on in the merged states
DEPTH = 8  # to which subtrees are compared
TOGETHER = 1024  # characters of candidates that are read in step; the rest of longer ones one by one
WEIGHT = 20  # of single characters beside what was seen behind one
WIDTH = 0.25  # share by which lengths may differ


class Model(NamedTuple):
    automata: dict[str, Automaton]
    lengths: dict[str, tuple[np.ndarray, np.ndarray]]  # length and share of the kind
    plain: np.ndarray  # log-probability of a character behind another, in candidates of the corpus

    def is_secret(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
        if not self.automata or not len(begin):
            return np.zeros(len(begin), bool)
        chars, start = _joined(data, begin, end)
        before, behind = _pairs(chars, start)
        plain = np.add.reduceat(self.plain[before, chars], start) + self.plain[behind, EDGE]
        best = np.full(len(begin), -np.inf)
        for kind, automaton in self.automata.items():
            size, share = self.lengths[kind]
            own = np.unique(end - begin)
            near = np.exp(-0.5 * (np.log(own[:, None] / size[None, :]) / WIDTH) ** 2) / (own[:, None] * WIDTH * math.sqrt(2 * math.pi)) @ share
            best = np.maximum(best, automaton.score(chars, start) + np.log(near + 1e-12)[np.searchsorted(own, end - begin)])
        return best - plain >= threshold


def train(found: DataFrame, rare: int = 100, alpha: float = 0.05) -> Model:
    """The model from ``counts`` of all documents; at most rare * 64 * 13 prefixes per kind, 257 * 257 pairs and a
    bounded number of lengths (equal to 5 %) reach the driver."""
    found = materialise(found, "formats")
    labelled = found.where("kind != ''").withColumnRenamed("value", "classes")
    sizes = {r.kind: r.n for r in labelled.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return Model({}, {}, np.zeros((257, 257)))
    length = F.round(F.exp(F.round(F.log(F.length("classes").cast("double")) * 20) / 20))
    lengths: dict[str, list] = {k: [] for k in sizes}
    for r in labelled.groupBy("kind", length.alias("size")).agg(F.sum("n").alias("n")).collect():
        lengths[r.kind].append((r.size, r.n / sizes[r.kind]))
    least = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(2, n // rare)))]), F.col("kind"))
    ended = labelled.withColumn("classes", F.concat("classes", F.lit(END)))
    depth = F.least(F.length("classes"), F.lit(MOST_CLASSES))
    prefixes = ended.withColumn("size", F.explode(F.sequence(F.lit(0), depth))).groupBy("kind", F.expr("substring(classes, 1, size)").alias("prefix")).agg(F.sum("n").alias("n"))
    tree: dict[str, dict[str, int]] = {k: {"": n} for k, n in sizes.items()}
    for r in prefixes.where(F.col("n") >= least).collect():
        tree[r.kind][r.prefix] = r.n
    letters = labelled.select("kind", "n", F.explode(F.split("classes", "")).alias("c")).where("c != ''").groupBy("kind", "c").agg(F.sum("n").alias("n")).collect()
    usual = {k: {s: next((r.n for r in letters if (r.kind, r.c) == (k, s)), 0) / sum(r.n for r in letters if r.kind == k) for s in CLASSES} for k in sizes}
    pairs = np.zeros(257 * 257)
    for r in found.where("kind = ''").collect():
        pairs[int(r.value)] = r.n
    pairs = pairs.reshape(257, 257)
    single = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * 257)
    plain = np.log((pairs + WEIGHT * single) / (pairs.sum(1, keepdims=True) + WEIGHT))
    return Model({k: Automaton(tree[k], alpha, usual[k]) for k in tree}, {k: tuple(np.array(v, float).T) for k, v in lengths.items()}, plain)


def _all_spans(texts: Texts, first: int, last: int, model: Model, threshold: float) -> list[list[tuple[str, int, int]]]:
    """Per row: (kind, begin, end) of all spans, in bytes of the row."""
    found = find(texts, first, last)
    out = [[s[:3] for s in spans] for spans in found]
    data, row, begin, end = candidates(texts, first, last, found)
    hit = np.flatnonzero(model.is_secret(data, begin, end, threshold))
    at = texts.offsets[first : last + 1] - int(texts.offsets[first])
    for r, a, b in zip(row[hit].tolist(), begin[hit].tolist(), end[hit].tolist()):
        out[r].append(("format", a - int(at[r]), b - int(at[r])))
    return out


THRESHOLD = 10.0  # of the log-likelihood ratio: one candidate in 22,000 would reach it by chance


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (kind, start, end), sorted by start, then kind as listed in KINDS. Two passes over the texts."""
    model = train(counts(docs))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(1))
            for first, last in texts.parts():
                out = []
                for row, own in enumerate(_all_spans(texts, first, last, model, threshold), first):
                    low = int(texts.offsets[row])
                    at = chars_before(texts.bytes, low, np.array([x for s in own for x in s[1:]], np.int64) + low).tolist()
                    found = [{"kind": s[0], "start": at[2 * i], "end": at[2 * i + 1]} for i, s in enumerate(own)]
                    out.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(out, SPAN_ARROW)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(choose, f"doc_id bigint, spans array<{SPAN}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and the list of all spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias("n_" + k)
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one);
    texts without spans, null ones too, stay as they are. Two passes over the texts."""
    model = train(counts(docs))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, new = Texts(batch.column(at)), batch.column(at).to_pylist()
            for first, last in texts.parts():
                for row, found in enumerate(_all_spans(texts, first, last, model, threshold), first):
                    if found:
                        raw, done, out = texts.text(row), 0, b""
                        for a, b in sorted(s[1:] for s in found):
                            if a >= done:
                                out += raw[done:a] + mark.encode()
                            done = max(done, b)
                        new[row] = (out + raw[done:]).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)
