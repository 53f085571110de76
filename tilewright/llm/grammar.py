"""Re-Pair grammars of word sequences, and the periodic runs that their rules cross.

A grammar is kept as places in the text: a rule X -> YZ is the begin, middle and end of its first place,
and the list of all places where the derivation has an X. Nothing is expanded.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .kernel import STEP, U, mix

LEAST = 12  # words of the shortest run
ITEMS = 1 << 21  # (rule, period) pairs looked at together; bounds the temporary arrays
PRIMES, BASES = (2**31 - 1, 2**31 - 19), (1_103_515_245, 1_220_703_125)


class Grammar(NamedTuple):
    begin: np.ndarray  # of each rule's first place
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray  # of each place in the derivation, with
    place: np.ndarray  # its first symbol


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place inside the owner for ``sizes`` items each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _preferred(number: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: those that rank above both neighbours. In a stretch of one repeated
    pair every second place is taken, since pairs there overlap."""
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    own = rank[number[first]]
    around = np.concatenate([[-1], own, [-1]])
    top = (own > 0) & (own > around[:-2]) & (own > around[2:])
    size = (np.diff(np.append(first, len(number)))[top] + 1) // 2
    owner, inner = ragged(size)
    return first[top][owner] + 2 * inner


def re_pair(ids: np.ndarray, breaks: np.ndarray) -> Grammar:
    """The grammar of the symbols ``ids``. Symbols at ``breaks`` (truth per place) are unique and end a text.

    A round replaces every pair that ranks above the pairs it overlaps, the more frequent first; frequencies
    count by powers of two and ties by a hash, so that a round shortens what repeats by a constant share.
    When no pair occurs twice, the rest of each text becomes a balanced tree of rules with one place.
    """
    seq, at = ids.astype(np.int64), np.arange(len(ids) + 1)
    top = int(seq.max()) + 1 if len(seq) else 0
    parts, rules = [], 0

    def replace(chosen: np.ndarray, kind: np.ndarray) -> None:
        nonlocal seq, at, top, rules
        _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
        parts.append((at[chosen[first]], at[chosen[first] + 1], at[chosen[first] + 2], kind + rules, at[chosen]))
        seq[chosen] = top + kind
        top, rules = top + len(first), rules + len(first)
        seq, at = np.delete(seq, chosen + 1), np.delete(at, chosen + 1)

    while len(seq) > 1:
        pair, number, count = np.unique(seq[:-1] * top + seq[1:], return_inverse=True, return_counts=True)
        rank = np.where(count > 1, (np.frexp(count)[1].astype(np.int64) << 32) | (mix(pair.astype(U) + STEP) >> U(32)).astype(np.int64), 0)
        while True:
            chosen = _preferred(number, rank)
            twice = np.bincount(number[chosen], minlength=len(count)) > 1
            if twice.any() or not len(chosen):
                break
            rank[number[chosen]] = 0  # give way to pairs that do occur twice apart
        chosen = chosen[twice[number[chosen]]]
        if not len(chosen):
            break
        replace(chosen, number[chosen])
    ends = breaks.copy()
    while True:
        alone = ends[at[:-1]]
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], alone[:-1]]), np.arange(len(seq)), 0)) if len(seq) else at[:-1]
        chosen = np.flatnonzero(((np.arange(len(seq)) - starts) % 2 == 0)[:-1] & ~alone[:-1] & ~alone[1:]) if len(seq) > 1 else np.empty(0, np.int64)
        if not len(chosen):
            break
        replace(chosen, np.arange(len(chosen)))
    join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64)
    return Grammar(*(join(k) for k in range(5)))


class Extents:
    """How far two places of a sequence agree, by prefix hashes modulo two primes and binary search."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        codes = mix(ids.astype(U) + STEP)
        for prime, base in zip(PRIMES, BASES):
            power = np.ones(len(ids) + 1, np.int64)
            done = 1
            while done < len(power):
                n = min(done, len(power) - done)
                power[done : done + n] = power[:n] * pow(base, done, prime) % prime
                done += n
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum((codes % U(prime)).astype(np.int64) * power[:-1] % prime, out=sums[1:])
            self.sums.append(sums % prime)
            self.powers.append(power)

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` symbols from i and from i + q agree."""
        out = np.ones(len(i), bool)
        for prime, sums, power in zip(PRIMES, self.sums, self.powers):
            out &= (sums[i + size] - sums[i]) % prime * power[q] % prime == (sums[i + q + size] - sums[i + q]) % prime
        return out

    def reach(self, i: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """The most symbols, up to ``limit``, by which i and i + q agree, from there on or ``back`` from there."""
        found = np.zeros(len(i), np.int64)
        for bit in reversed(range(int(limit.max()).bit_length() if len(limit) else 0)):
            more = found + (1 << bit)
            ok = np.flatnonzero(more <= limit)
            ok = ok[self.same(i[ok] - more[ok] if back else i[ok], q[ok], more[ok])]
            found[ok] = more[ok]
        return found


def _crossing(ids: np.ndarray, grams: np.ndarray, extents: Extents, g: Grammar, rules: np.ndarray) -> list[np.ndarray]:
    """(rule, begin, end, period) of the runs inside the first place of each of ``rules`` that cross its middle.

    Such a run holds a period on the right of the middle (its pivot is the middle) or on the left (the pivot
    lies a period before it). It has 6 or more agreeing places, all in a row and around the
    pivot, so that 3 agree behind or before the pivot: that is looked at first.
    """
    out = []
    for left in (False, True):
        begin, middle, end = g.begin[rules], g.middle[rules], g.end[rules]
        owner, q = ragged(np.minimum((middle - begin) if left else (end - middle), (end - begin) // 2))
        q += 1
        one = middle[owner] - (0 if left else 1)
        keep = ids[one - q if left else one] == ids[one if left else one + q]
        owner, q = owner[keep], q[keep]
        low, high, pivot = begin[owner], end[owner], middle[owner] - (q if left else 0)
        after = np.where(pivot + q + 3 <= high, grams[pivot] == grams[pivot + q], False)
        before = np.where(pivot - 3 >= low, grams[np.maximum(pivot - 3, 0)] == grams[np.maximum(pivot - 3, 0) + q], False)
        keep = after | before
        owner, q, low, high, pivot = (x[keep] for x in (owner, q, low, high, pivot))
        first = pivot - extents.reach(pivot, q, pivot - low, back=True)
        last = pivot + q + extents.reach(pivot, q, high - pivot - q)
        cut = middle[owner]
        keep = (last - first >= np.maximum(LEAST, 2 * q)) & (first < cut) & (last > cut)
        out.append(np.stack([rules[owner], first, last, q])[:, keep])
    return out


def _shortest(rule: np.ndarray, first: np.ndarray, last: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of the rows that lie in no row of the same rule with a smaller (or, earlier, an equal) period."""
    todo = np.lexsort((last - first, q, rule))
    kept = []
    while len(todo):
        lead = np.concatenate([[True], rule[todo][1:] != rule[todo][:-1]])
        head = todo[lead][np.cumsum(lead) - 1]
        kept.append(todo[lead])
        todo = todo[(first[todo] < first[head]) | (last[todo] > last[head])]
    return np.concatenate(kept) if kept else todo


def runs_of(ids: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and smallest period of every maximal run of at least LEAST symbols and two periods, by begin, then period.

    Runs are found once per rule. The lowest rule whose expansion holds a whole run has its
    middle inside the run; what rules below it see are parts of the run and fall to the merge.
    """
    g = re_pair(ids, breaks)
    grams = mix(mix(ids[:-2].astype(U) + STEP) + mix(ids[1:-1].astype(U) * STEP) * U(3) + ids[2:].astype(U)) if len(ids) > 2 else np.empty(0, U)
    grams = np.append(grams, np.arange(3, dtype=U))  # the last places begin none
    extents = Extents(ids)
    found: list[np.ndarray] = []
    wide = np.flatnonzero(g.end - g.begin >= LEAST)
    piece = np.cumsum(g.end[wide] - g.begin[wide]) // ITEMS
    for rules in np.split(wide, np.flatnonzero(np.diff(piece)) + 1) if len(wide) else []:
        found += _crossing(ids, grams, extents, g, rules)
    rule, first, last, q = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    keep = _shortest(rule, first, last, q)
    rule, first, last, q = rule[keep], first[keep] - g.begin[rule[keep]], last[keep] - g.begin[rule[keep]], q[keep]

    order = np.argsort(g.rule, kind="stable")
    places, bounds = g.place[order], np.searchsorted(g.rule[order], np.arange(len(g.begin) + 1))
    owner, inner = ragged(bounds[rule + 1] - bounds[rule])
    at = places[bounds[rule[owner]] + inner]
    first, last, q = first[owner] + at, last[owner] + at, q[owner]

    order = np.lexsort((-last, first, q))  # of equal period, those inside another go
    first, last, q = first[order], last[order], q[order]
    tall = last + np.unique(q, return_inverse=True)[1] * (len(ids) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(tall)[:-1]]) if len(tall) else tall
    keep = tall > before
    first, last, q = first[keep], last[keep], q[keep]
    order = np.lexsort((q, first))
    kept, open_ = [], []  # of different periods, those inside one of a smaller period go
    for i, a, b, p in zip(order.tolist(), first[order].tolist(), last[order].tolist(), q[order].tolist()):
        open_ = [x for x in open_ if x[1] > a]
        if not any(x[1] >= b and x[2] < p for x in open_):
            kept.append(i)
        open_.append((a, b, p))
    return first[kept], last[kept], q[kept]
