"""Repair of conversation structure: weighted CYK parsing of the turns against a repair grammar.

Repaired roles read ``(s?(ua)+)?`` by their initials. The grammar in Chomsky normal form has a nonterminal X(p, q) per
pair of states of that pattern, for what leads from p to q: X(p, q) -> X(p, r) X(r, q), and X(p, q) -> a turn that is kept,
given another role or deleted. Inserted turns derive nothing, so their closure is taken into every cell of one turn. A cell is a
span's cheapest (cost, audit) per nonterminal, ties by the audit. Any X(p, q) splits at every turn, so that one
split gives a span's cell: spans grow bottom-up by doubling, in short conversations within a task, in
long ones from pieces of a bounded number of turns by a tree of groupings.

Turns are taken by turn number (nulls first), then role, then text. Null roles and texts are one blank. A null conv_id is a
conversation like any other. Cheapest repairs with one audit are one repair: the number of its turns tells every role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import grouped
from .store import materialise

SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)], "x": []}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1  # costs
PIECE_BITS = 10  # a piece of a long conversation has up to 1024 turns
LISTED = 100_000  # so many long conversations are listed to every task; more are joined
CELL = "array<struct<cost: bigint, audit: string>>"

Cell = tuple  # (cost, audit) or None per pair of states, by 4 * p + q


def _least(entries: list[tuple[int, int, int, str]]) -> Cell:
    cell: list = [None] * 16
    for p, q, cost, audit in entries:
        if cell[4 * p + q] is None or (cost, audit) < cell[4 * p + q]:
            cell[4 * p + q] = (cost, audit)
    return tuple(cell)


def combine(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * 16
    for i, a in enumerate(x):
        if a is not None:
            p, r = i - i % 4, i % 4
            for q in range(4):
                b = y[4 * r + q]
                if b is not None:
                    found = (a[0] + b[0], a[1] + b[1])
                    if out[p + q] is None or found < out[p + q]:
                        out[p + q] = found
    return tuple(out)


def _closure() -> Cell:
    """Cheapest insertions between any two states; two suffice."""
    once = _least([(p, p, 0, "") for p in range(4)] + [(p, q, INSERT, "I") for kind in "ua" for p, q in MOVES[kind]])
    return combine(once, once)


CLOSURE = _closure()


@lru_cache(maxsize=None)
def leaf(letter: str) -> Cell:
    """The cell of one turn: its role's initial (x: none of them), in upper case if truncated, or d: to be deleted."""
    entries = [(p, p, DELETE, "D") for p in range(4)]
    if letter != "d":
        late = TRUNCATED if letter.isupper() else 0
        entries += [(p, q, late, "K") for p, q in MOVES[letter.lower()]]
        entries += [(p, q, REROLE + late, "R") for kind in "ua" for p, q in MOVES[kind]]
    return combine(combine(CLOSURE, _least(entries)), CLOSURE)


@lru_cache(maxsize=1 << 15)
def _short(letters: str) -> Cell:
    if len(letters) == 1:
        return leaf(letters)
    half = len(letters) + 1 >> 1
    return combine(_short(letters[:half]), _short(letters[half:]))


def parse(letters: str) -> Cell:
    """The cell of a span of turns."""
    return fold([_short(letters[i : i + 8]) for i in range(0, len(letters), 8)])


def fold(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, joined two by two."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """Cheapest repair of a whole conversation."""
    return min(x for x in (cell[4 * START + START], cell[4 * START + ASSISTANT]) if x is not None)


class Replay:
    """Turns of the repaired conversation, given the turns in order."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.odd = sum(map(audit.count, "KRI")) % 2
        self.place = 0

    def _role(self) -> str:
        self.place += 1
        return NAMES["ua"[(self.place - 1 - self.odd) % 2]]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            needed = self._role()
            yield (role if edit == "K" else needed), text


def damage(rows: DataFrame, how: Column) -> DataFrame:
    """Rows as ``how`` (0 to 19) says: 0 drops one (column ``gone``), 1 empties its text, 2 takes its sentence
    ends, 3 repeats it, 4 gives it to the user. Column ``copies`` counts the rows it stands for."""
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), how.alias("_how"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_how").isin(0, 1), "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_how") == 3, 2).otherwise(1).alias("copies"), (F.col("_how") == 0).alias("gone"))


def planted(rows: DataFrame) -> Column:
    """Damage by a checksum of conversation and turn (nulls: a blank)."""
    name = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" "))
    return F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))), F.lit(20)).cast("int")


def undamaged(rows: DataFrame) -> DataFrame:
    return damage(rows, F.lit(19))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per turn with its role's initial and fault (1: blank, 2: truncated), and keys without nulls."""
    end = F.expr(f"trim(TRAILING '{SPACE}' FROM text)")
    fault = F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    return rows.withColumns({"fault": fault, "initial": F.left("role", F.lit(1)), "nul": F.col("conv_id").isNull().cast("int"), "cid": F.coalesce("conv_id", F.lit(0))})


def _letter(initial: str, fault: int, again: bool) -> str:
    if fault == 1 or again:
        return "d"
    known = initial if initial in ("s", "u", "a") else "x"
    return known.upper() if fault == 2 else known


REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string, turns array<struct<role: string, text: string>>")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _report(conv_id: int | None, rows: pa.Table, with_turns: bool) -> dict:
    """Report of one conversation from its turns in order."""
    seen, letters, turns = set(), [], []
    out = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"conv_id": conv_id, "audit": "", "turns": [] if with_turns else None}
    numbers, digest, last = set(), hashlib.sha256(), None
    for turn, role, text, copies, gone, fault, initial in zip(*(rows[k].to_pylist() for k in ("turn", "role", "text", "copies", "gone", "fault", "initial"))):
        if gone:
            continue
        numbers.add(turn)
        for _ in range(copies):
            again = fault != 1 and (role, text) in seen
            if fault != 1:
                seen.add((role, text))
            kind = "blank" if fault == 1 else "duplicate" if again else "truncated" if fault == 2 else None
            if kind:
                out[kind] += 1
            if last is not None and last + initial not in LEGAL:
                out["illegal"] += 1
            last = initial
            letters.append(_letter(initial, fault, again))
            turns.append((role, text))
    numbers.discard(None)
    if numbers:
        out["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers)
    if letters:
        out["cost"], out["audit"] = best(parse("".join(letters)))
        replay, first = Replay(out["audit"]), True
        for made in (*(replay.turn(*t) for t in turns), replay.inserted()):
            for role, text in made:
                digest.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
                if with_turns:
                    out["turns"].append({"role": role, "text": text})
    out["repaired_sha256"] = digest.hexdigest()
    return out


def _reports(marked: DataFrame, with_turns: bool) -> DataFrame:
    """Reports of conversations of a bounded number of turns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ", 1)[0] for x in REPORT.split(", ") if ":" not in x] + ["turns"]
        found: list[dict] = []

        def flush():
            columns = [pa.array([x[k] for x in found], TURNS if k == "turns" else pa.string() if k in ("audit", "repaired_sha256") else pa.int64()) for k in names]
            return pa.RecordBatch.from_arrays(columns, names=names)

        size = 0
        for (nul, cid), rows in grouped(batches, ["nul", "cid"]):
            found.append(_report(None if nul else cid, rows, with_turns))
            size += rows.num_rows
            if size > 10_000:
                yield flush()
                found, size = [], 0
        if found:
            yield flush()

    keys = ["nul", "cid", "turn", "role", "text"]
    return marked.repartition("nul", "cid").sortWithinPartitions(*keys).select(*keys, "copies", "gone", "fault", "initial").mapInArrow(scan, REPORT)


NODE = f"nul int, cid bigint, node bigint, first string, last string, illegal bigint, cell {CELL}"
NODE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))]


def _node(key: tuple, parts: list[tuple[str, str, int, Cell]]) -> pa.RecordBatch:
    """Neighbouring spans (first and last initial, illegal pairs, cell) as one."""
    illegal = sum(x[2] for x in parts) + sum(a[1] + b[0] not in LEGAL for a, b in zip(parts[:-1], parts[1:]))
    cell = [x and {"cost": x[0], "audit": x[1]} for x in fold([x[3] for x in parts])]
    values = [*key, parts[0][0], parts[-1][1], illegal, cell]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, NODE_TYPES)], names=["nul", "cid", "node", "first", "last", "illegal", "cell"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of pieces from their turns in order."""
    for key, rows in grouped(batches, ["nul", "cid", "node"]):
        parts = zip(rows["initial"].to_pylist(), rows["fault"].to_pylist(), rows["again"].to_pylist())
        yield _node(key, [(i, i, 0, leaf(_letter(i, f, d))) for i, f, d in parts])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of neighbouring spans as one."""
    for key, rows in grouped(batches, ["nul", "cid", "parent"]):
        cells = [tuple(x and (x["cost"], x["audit"]) for x in cell) for cell in rows["cell"].to_pylist()]
        yield _node(key, list(zip(rows["first"].to_pylist(), rows["last"].to_pylist(), rows["illegal"].to_pylist(), cells)))


def _long_reports(marked: DataFrame) -> DataFrame:
    """Reports of conversations of any length: pieces of a global order, joined by a tree of groupings.

    Only the last step, SHA-256 over a conversation's turns, has to see them one after another; it holds a batch at a time.
    """
    rows = marked.where("NOT gone").withColumn("copies", F.explode(F.expr("sequence(1, copies)")))
    order = ["nul", "cid", "turn", "role", "text"]
    rows = rows.repartitionByRange("nul", "cid", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions(*order)
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()).withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64("text", "role", F.lit(1))}), "ordered-turns")
    first = rows.where("fault <> 1").groupBy("nul", "cid", "k1", "k2").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    light = rows.select("nul", "cid", "turn", "at", "initial", "fault", "k1", "k2").join(first, ["nul", "cid", "k1", "k2"], "left")
    light = light.withColumn("again", (F.col("fault") != 1) & F.coalesce(F.col("at") > F.col("_first"), F.lit(False)))
    light = materialise(light.select("nul", "cid", "turn", "at", "initial", "fault", "again"), "marked-turns")
    counts = light.groupBy("nul", "cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.expr("count_if(fault = 1)").alias("blank"),
        F.expr("count_if(again)").alias("duplicate"), F.expr("count_if(fault = 2 AND NOT again)").alias("truncated"))
    pieces = light.withColumn("node", F.shiftright("at", PIECE_BITS))
    nodes = materialise(pieces.repartition("nul", "cid", "node").sortWithinPartitions("nul", "cid", "node", "at").mapInArrow(_pieces, NODE), "cells")
    while not nodes.groupBy("nul", "cid").count().where("count > 1").isEmpty():
        above = nodes.withColumn("parent", F.shiftright("node", 8)).repartition("nul", "cid", "parent").sortWithinPartitions("nul", "cid", "parent", "node")
        nodes = materialise(above.mapInArrow(_joined, NODE), "cells")
    chosen = F.expr("array_min(filter(array(cell[0], cell[3]), x -> x IS NOT NULL))")
    ends = materialise(nodes.select("nul", "cid", "illegal", chosen.alias("_best")).select("nul", "cid", "illegal", "_best.*"), "audits")
    told = ends.select("nul", "cid", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = told.unionByName(rows.select("nul", "cid", "at", "role", "text")).repartition("nul", "cid").sortWithinPartitions("nul", "cid", "at")
    hashes = stream.mapInArrow(_digests, "nul int, cid bigint, repaired_sha256 string")
    out = ends.join(counts, ["nul", "cid"]).join(hashes, ["nul", "cid"]).withColumn("conv_id", F.when(F.col("nul") == 0, F.col("cid")))
    return out.withColumn("turns", F.lit(None).cast("array<struct<role: string, text: string>>")).select(*[x.split(" ", 1)[0] for x in REPORT.split(", ") if ":" not in x], "turns")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation from its audit and then its turns, a batch in memory at a time."""
    key, replay, digest, first = None, None, None, True

    def add(made):
        nonlocal first
        for role, text in made:
            digest.update((("" if first else "\n") + role + ":" + text).encode())
            first = False

    def done():
        add(replay.inserted())
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["nul", "cid", "repaired_sha256"])

    for batch in batches:
        for nul, cid, at, role, text in zip(*(batch.column(k).to_pylist() for k in ("nul", "cid", "at", "role", "text"))):
            if at < 0:
                if replay:
                    yield done()
                key, replay, digest, first = (nul, cid), Replay(text), hashlib.sha256(), True
            else:
                add(replay.turn(role, text))
    if replay:
        yield done()


def repair(rows: DataFrame, with_turns: bool = True, long_rows: int = 4096) -> DataFrame:
    """A report per conv_id of ``damage`` rows: gaps in its turn numbers, blank, duplicate and truncated turns, illegal
    neighbours, cost and audit (K keep, R rerole, D delete, I insert) of the cheapest repair, SHA-256 of the repaired
    ``role:text`` lines, and the repaired ``turns`` (null in conversations of more than ``long_rows`` turns,
    which are parsed over many tasks, and without ``with_turns``)."""
    marked = _marked(rows)
    long = rows.where("NOT gone").groupBy("conv_id").agg(F.sum("copies").alias("_n")).where(F.col("_n") > long_rows)
    long = materialise(long.select(F.col("conv_id").isNull().cast("int").alias("nul"), F.coalesce("conv_id", F.lit(0)).alias("cid")), "long")
    n = long.count()
    if n == 0:
        return _reports(marked, with_turns)
    listed = F.broadcast(long) if n <= LISTED else long
    return _reports(marked.join(listed, ["nul", "cid"], "left_anti"), with_turns).unionByName(_long_reports(marked.join(listed, ["nul", "cid"], "left_semi")))
