"""License notices in whole documents: exact phrases, and short notices with bounded errors.

Texts are seen as lower-cased (A-Z) words of letters, digits and non-ASCII characters, joined
by single blanks. A phrase is found where its words stand consecutively. A short notice is found
where an equal text stands up to ``errors`` insertions, deletions or substitutions (one per ten
characters):

* *Seeds*: the notice is split into errors + 1 pieces. By the pigeonhole principle every
  occurrence holds at least one piece unchanged, so an exact search for all pieces at once
  (Aho-Corasick) meets every occurrence.
* *Verification*: around each seed the regex library matches the whole notice with bounded
  errors; the best match gives the span and the number of edits. Several seeds of one
  occurrence count once; of overlapping notices the one with the fewest edits stays.

Nothing is shuffled: documents are independent of each other. Null texts are empty and have no
words, no labels and score 0; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALPHANUMERIC, LOWER, Texts, Words, chars_before, hash_text

# Exact phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Short notices as licenses ask to quote them, with their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
CHARS_PER_ERROR = 10

SCHEMA = ("doc_id bigint, n_words bigint, places array<struct<label: string, word: bigint>>, "
          "notices array<struct<label: string, start: bigint, end: bigint, errors: bigint, size: bigint>>")


@lru_cache(maxsize=4)
def _search(notices: tuple) -> tuple:
    """The automaton of all pieces and the pattern of every notice."""
    pieces, patterns = ahocorasick.Automaton(), []
    at: dict[str, list] = {}
    for i, (text, _) in enumerate(notices):
        errors = len(text) // CHARS_PER_ERROR
        cuts = [len(text) * j // (errors + 1) for j in range(errors + 2)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at.setdefault(text[a:b], []).append((i, a))
        patterns.append((regex.compile(f"(?e)(?:{regex.escape(text)}){{e<={errors}}}"), errors, len(text)))
    for piece, where in at.items():
        pieces.add_word(piece, (len(piece), where))
    pieces.make_automaton()
    return pieces, patterns


def fuzzy(plain: str, notices: tuple, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, notice, start, end, errors) in ``plain``, whose rows begin at ``bounds``."""
    pieces, patterns = _search(notices)
    done: dict[tuple[int, int], int] = {}
    found = []
    for last, (size, where) in pieces.iter(plain):
        first = last - size + 1
        row = int(np.searchsorted(bounds, first, "right")) - 1
        low, high = int(bounds[row]), int(bounds[row + 1])
        if last >= high:
            continue
        for notice, offset in where:
            if first < done.get((row, notice), -1):
                continue
            pattern, errors, length = patterns[notice]
            a, b = max(low, first - offset - errors), min(high, first - offset + length + errors)
            match = pattern.search(plain, a, b)
            if match:
                found.append((row, notice, match.start(), match.end(), sum(match.fuzzy_counts)))
                done[row, notice] = match.end()
    best = []  # of overlapping notices the one with the fewest edits, then the longest
    for x in sorted(found, key=lambda x: (x[0], x[4] / len(notices[x[1]][0]), x[2] - x[3], x[2], x[1])):
        near = best[-1][1] if best and best[-1][0] == x[0] else None
        if near is None:
            near = []
            best.append((x[0], near))
        if all(x[3] <= y[2] or x[2] >= y[3] for y in near):
            near.append(x)
    return sorted(x for _, near in best for x in near)


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, places (label and first word of every exact phrase) and notices (label,
    start and end in code points of the text, edits and length of the notice)."""
    phrases = [([np.uint64(hash_text(w)) for w in p.split()], label) for p, label in phrases]
    notices = tuple(notices)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(1))
            for first, last in texts.parts():
                words = Words(texts, first, last, ALPHANUMERIC)
                places: list[list] = [[] for _ in range(last - first)]
                for codes, label in phrases:
                    at = np.flatnonzero(words.code == codes[0])
                    for j, code in enumerate(codes[1:], 1):
                        at = at[at + j < len(words.code)]
                        at = at[(words.code[at + j] == code) & (words.row[at + j] == words.row[at])]
                    for i in at:
                        places[words.row[i]].append({"label": label, "word": int(i - words.row_starts[words.row[i]])})
                base = int(texts.offsets[first])
                data = LOWER[texts.bytes[base : int(texts.offsets[last])]]
                inside = ALPHANUMERIC[data]
                data[~inside] = 32
                keep = inside.copy()
                keep[1:] |= inside[:-1]  # one blank for a run of others
                shown = np.flatnonzero(keep)
                bounds = np.searchsorted(shown, texts.offsets[first : last + 1] - base, "left")
                notes: list[list] = [[] for _ in range(last - first)]
                for row, notice, a, b, errors in fuzzy(data[shown].tobytes().decode("latin-1"), notices, bounds):
                    span = chars_before(texts.bytes, int(texts.offsets[first + row]), np.array([base + shown[a], base + shown[b - 1] + 1]))
                    notes[row].append({"label": notices[notice][1], "start": int(span[0]), "end": int(span[1]), "errors": errors, "size": len(notices[notice][0])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(words.counts.astype(np.int64)),
                     pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                     pa.array(notes, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("size", pa.int64())])))],
                    names=["doc_id", "n_words", "places", "notices"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(search, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """One row per document of ``scan``: counts, first and last word, labels and a score: 1 for an
    exact phrase, else one less the share of edits of the best notice."""
    labels = lambda *x: F.array_join(F.array_sort(F.array_distinct(F.concat(*x))), ",")
    best = F.coalesce(F.array_max(F.transform("notices", lambda x: 1 - x["errors"] / x["size"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        labels("places.label").alias("base_labels"), labels("places.label", "notices.label").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
