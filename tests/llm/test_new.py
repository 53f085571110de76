"""Outlier rules, conversation repair and periodic runs against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tilewright.llm import decontaminate, grammar, gru, kernel, langid, licenses, lm, mixing, neardup, outliers, quality, repair, runs, secrets, vectordup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, own bigint, cell bigint, runs string, bin int, z0 string, _own int"


def frame(spark, rows):
    """Documents of (id, text, lang, source), with columns whose names the operators use inside."""
    rows = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in rows]
    return spark.createDataFrame([(*r, 1, "w", 1, 1, "r", 1, "z", 1) for r in rows], DOCS).repartition(3)


# ---- periodic runs -------------------------------------------------------------------


def naive_runs(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    found = [(a, b, q) for (a, b), q in out.items()]
    return sorted(((a, b, q) for a, b, q in found if not any(p < q and x <= a and y >= b for x, y, p in found)), key=lambda r: (r[0], r[2]))


def sample_words(rng):
    n, alphabet = rng.randrange(0, 120), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(alphabet) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 2 + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if rng.random() < 0.2:  # a Fibonacci word: many runs
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        w = y[:n]
    return w


def test_runs_of_shared_grammars():
    rng = random.Random(0)
    for _ in range(300):
        symbols, breaks, expected = [], [], []
        for d in range(rng.randrange(1, 4)):
            w = sample_words(rng)
            expected += [(a + len(symbols), b + len(symbols), q) for a, b, q in naive_runs(w)]
            symbols += w + [1000 + d]
            breaks += [False] * len(w) + [True]
        got = [tuple(x) for x in zip(*(x.tolist() for x in grammar.runs_of(np.array(symbols), np.array(breaks))))]
        assert got == expected


def test_grammar_derives_the_text():
    rng = np.random.default_rng(0)
    for w in (np.zeros(1000, int), rng.integers(0, 4, 3000), np.resize(rng.integers(0, 90, 500), 4000)):
        g = grammar.re_pair(np.append(w, 10**6), np.append(np.zeros(len(w), bool), True))
        for r, at in zip(g.rule, g.place):  # every place reads as the rule's first one
            assert (w[at : at + g.end[r] - g.begin[r]] == w[g.begin[r] : g.end[r]]).all()
        assert ((g.begin < g.middle) & (g.middle < g.end)).all() and (g.end - g.begin).max() == len(w)


def expected_runs(doc_id, text, loops):
    w = WORD.findall(text or "")
    n = len(w)
    if loops and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = naive_runs(w)
    top = min(((-(b - a), a, q) for a, b, q in found), default=None)
    longest = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    kept = [x for i, x in enumerate(w) if not any(a + q <= i < b for a, b, q in found)]
    return (doc_id, len(found), *longest, SHA("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), SHA(" ".join(kept)))


@pytest.mark.parametrize("loops", [True, False])
def test_periodic_runs(spark, loops):
    rng = random.Random(3)
    rows = [(i, " ".join("Ab é€ 𝄞 x y".split()[k] for k in sample_words(rng)).replace(" ", rng.choice([" ", "\n\t", "  "]))) for i in range(120)]
    rows += [(200 + i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "a " * 30), (None, None), (5, "A a " * 9), (5, "A a " * 9), (403, " b" * 12), (404, "b " * 11), (405, "x" * 9000 + " y" * 5000)]
    got = runs.summary(runs.find(frame(spark, rows), loops=loops)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_runs(*r, loops)) for r in rows)
    assert runs.find(frame(spark, rows).limit(0)).collect() == []


# ---- conversation repair -------------------------------------------------------------


def naive_repair(turns):
    """Cheapest (cost, audit) by trying states turn by turn; turns: (initial, must go, truncated)."""
    moves = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
    put = lambda best, p, x: best.update({p: min(best.get(p, x), x)})

    def inserts(best):
        for _ in range(3):
            for p, (c, s) in list(best.items()):
                for k in "ua":
                    for a, b in moves[k]:
                        if a == p:
                            put(best, b, (c + 2, s + "I"))
        return best

    best = inserts({0: (0, "")})
    for initial, gone, late in turns:
        after = {}
        for p, (c, s) in best.items():
            put(after, p, (c + 3, s + "D"))
            if not gone:
                for k in "sua":
                    for a, b in moves[k]:
                        if a == p and initial == k:
                            put(after, b, (c + late, s + "K"))
                        if a == p and k != "s":
                            put(after, b, (c + 2 + late, s + "R"))
        best = inserts(after)
    return min(best[p] for p in (0, 3) if p in best)


def expected_report(rows, conv_id):
    own, text_of = [], lambda x: " " if x is None else x
    for _, turn, role, text in (r for r in rows if r[0] == conv_id):
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if h == 4 else text_of(role), text_of(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [((turn is not None, turn or 0), role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    own.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
    if not own:
        return (conv_id, 0, 0, 0, 0, 0, 0, "", SHA(""))
    turns = {t[1] for t, _, _ in own if t[0]}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, count, steps = set(), Counter(), []
    for _, role, text in own:
        said = WORD.findall(text)
        kind = "b" if not said else "d" if (role, text) in seen else "t" if said[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        count[kind] += 1
        steps.append((role[:1], kind in ("b", "d"), kind == "t"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:]))
    cost, audit = naive_repair(steps)
    size, left, lines = len(re.sub("D", "", audit)), iter(own), []
    for edit in audit:
        name = ("user", "assistant")[(len(lines) - size % 2) % 2]
        if edit == "I":
            lines.append(name + ":")
            continue
        _, role, text = next(left)
        if edit != "D":
            lines.append((role if edit == "K" else name) + ":" + text)
    return (conv_id, gaps, count["b"], count["d"], count["t"], illegal, cost, audit, SHA("\n".join(lines)))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    said = ["Yes.", "No!", "why", "", " \t", None, "fine. ", "A?b", "Über", "𝄞."]
    rows = [(c, rng.choice([None, *range(t + 1), t]), rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "", None, "USER"]), rng.choice([*said, f"Turn {t}."]))
            for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(200, t, ("user", "assistant")[t % 2], f"Line {t // 3}.") for t in range(90)] + [(None, 1, "user", "Hi."), (None, None, None, None), (0, 3, "user", "Yes."), (0, 3, "user", "Yes.")]
    rows += [(300 + c, 0, "user", "x.") for c in range(40)] + [(400, t, "system", "Same.") for t in range(60)] + [(401, 7, "user", "Same.")] * 50
    return rows


@pytest.mark.parametrize("long_rows", [4096, 5])
def test_conversation_repair(spark, conversations, long_rows, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 2 if long_rows == 5 else 10)
    df = spark.createDataFrame([(*r, 1, "x") for r in conversations], "conv_id bigint, turn bigint, role string, text string, at int, node string").repartition(4)
    found = repair.repair(repair.damage(df, repair.planted(df)), long_rows=long_rows)
    got = {r.conv_id: r for r in found.collect()}
    assert len(got) == found.count() and set(got) == {r[0] for r in conversations}
    for conv_id, r in got.items():
        assert tuple(r)[:9] == expected_report(conversations, conv_id)
        if r.turns is not None:
            assert SHA("\n".join(f"{t.role}:{t.text}" for t in r.turns)) == r.repaired_sha256
            assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.turns))
    assert repair.repair(repair.undamaged(df.limit(0))).collect() == []


def test_spans_split_anywhere():
    """The cell of a span is the same from every split."""
    rng = random.Random(1)
    for _ in range(200):
        letters = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(2, 14)))
        k = rng.randrange(1, len(letters))
        assert repair.combine(repair.parse(letters[:k]), repair.parse(letters[k:])) == repair.parse(letters)


# ---- outliers ------------------------------------------------------------------------


def expected_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    places = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), len(lines)


@pytest.fixture(scope="module")
def quality_rows():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", ".\n"]) for _ in range(n))
    rows = [(i, prose(int(10 ** rng.uniform(1, 3))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(900)]
    for i in range(0, 90, 3):  # symbols, repeated lines, one very long word
        t = rows[i][1]
        rows[i] = (i, [t.replace(" ", " $%&* "), (t[:200] + "\n") * 3 + t, t + " x" * 3 + "y" * 9000][i // 3 % 3], *rows[i][2:])
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b c"), (None, None), (None, prose(60)), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a"), (2004, "a\nb\na\n\n\nb " * 40)]


def test_statistics(spark, quality_rows):
    got = sorted(repr((r.doc_id, *(r[c] for c in outliers.STATISTICS), r.n_lines)) for r in outliers.statistics(frame(spark, quality_rows)).collect())
    assert got == sorted(repr((r[0], *expected_statistics(r[1]))) for r in quality_rows)


def naive_distances(cells):
    """Squared distances in each cell, by numpy: medians, then the nearest three quarters until no determinant falls."""
    floor = np.array(outliers.FLOOR)
    fits = {}
    for name, z in cells.items():
        low, mid, high = (np.sort(np.floor(z * 64), axis=0)[int(np.ceil(s * len(z))) - 1] for s in (0.25, 0.5, 0.75))
        fits[name] = (mid + 0.5) / 64, np.diag(np.maximum((high - low) / 64 / 1.349, floor) ** 2), np.inf
    distance = lambda name: np.einsum("ij,jk,ik->i", *[cells[name] - fits[name][0]], np.linalg.inv(fits[name][1]), cells[name] - fits[name][0])
    for _ in range(outliers.STEPS):
        falls = False
        for name, z in cells.items():
            bins = np.maximum(np.floor(32 * np.log2(np.maximum(distance(name), 1e-9))), -320)
            near = z[bins <= np.sort(bins)[int(np.ceil(outliers.SHARE * len(z))) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(floor**2)
            falls |= np.linalg.det(cov) < fits[name][2] * (1 - outliers.SETTLED)
            fits[name] = mean, cov, np.linalg.det(cov)
        if not falls:
            break
    return {name: distance(name) for name in cells}


def test_outliers_against_numpy(spark, quality_rows):
    rows = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in quality_rows if r[0] is not None and r[0] != 5]
    found = {r.doc_id: r for r in outliers.judge(frame(spark, rows), least=150).collect()}
    assert len(found) == len(rows)
    vectors = {}
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, rep, lines = expected_statistics(text)
        failed = n < 20 or 100 * rep > 30 * n
        assert found[doc_id].base_failed == failed and not (failed and found[doc_id].kept)
        if not failed:
            vectors[doc_id] = (lang, source), np.array([np.log(n), np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / lines), np.sqrt(rep / n)])
    sizes = Counter(k for k, _ in vectors.values())
    rest = Counter(k[0] for k, _ in vectors.values() if sizes[k] < 150)
    cell = lambda k: k if sizes[k] >= 150 else (k[0],) if rest[k[0]] >= 150 else "rest"
    cells = {}
    for doc_id, (k, z) in vectors.items():
        cells.setdefault(cell(k), []).append((doc_id, z))
    assert any(isinstance(k, tuple) and len(k) == 2 for k in cells) and len(cells) > 2
    rejected = 0
    large = {k: np.array([x for _, x in v]) for k, v in cells.items() if len(v) >= 150}
    expected = naive_distances(large)
    for name, members in cells.items():
        if name not in large:
            assert all(found[i].kept and found[i].distance is None for i, _ in members)
            continue
        d = expected[name]
        assert np.allclose([found[i].distance for i, _ in members], d, rtol=1e-6)
        bins = np.floor(32 * np.log2(np.maximum(d, 2**-10)))
        middle = 2 ** ((np.sort(bins)[int(np.ceil(0.5 * len(d))) - 1] + 1) / 32)
        kept = np.array([found[i].kept for i, _ in members])
        assert (kept == (d <= outliers.CUTOFF * max(1, middle / outliers.NORMAL_MEDIAN))).all()
        rejected += (~kept).sum()
    assert 10 <= rejected < 0.1 * len(rows)


def test_outliers_of_few_rows(spark):
    assert outliers.judge(frame(spark, [(1, "a b")]).limit(0)).collect() == []
    got = {r.doc_id: (r.base_failed, r.kept) for r in outliers.judge(frame(spark, [(1, "a b"), (2, " ".join(map(str, range(40)))), (3, None)])).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}


# ---- formats of secrets --------------------------------------------------------------


def test_bare_keys_of_learnt_formats_are_found(spark):
    """Keys of three labelled formats, bare, and letters alone, against ordinary text with numbers and addresses."""
    rng = random.Random(1)
    stems = ["ing", "tion", "er", "the", "con", "ent", "ap", "lo", "str", "able", "wor", "und", "pre", "is"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "", ".", ",", "-wise"])
    prose = lambda n: " ".join(word() for _ in range(n))
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    both = string.ascii_letters + string.digits
    formats = {"mixed": lambda: draw(both, 24), "prefixed": lambda: "sk-live_" + draw("0123456789abcdef", 20),
               "dotted": lambda: draw(string.ascii_uppercase, 5) + "." + draw(both, 10) + "." + draw(string.digits, 6), "letters": lambda: draw(string.ascii_lowercase, 16)}
    rows, keys = [], {}
    for make in formats.values():
        rows += [(len(rows) + i, f'{prose(40)} secret = "{make()}" {prose(20)}') for i in range(300)]
    for name, make in formats.items():
        for _ in range(100):
            keys[len(rows)] = name, make()
            rows.append((len(rows), f"{prose(20)} {keys[len(rows)][1]} {prose(20)}"))
    clean = [(len(rows) + i, f"{prose(60)} 2024-01-{i % 28 + 1:02d} mail {word()}.{word()}@example.com +49-170-{rng.randrange(10**7):07d} 10.{i % 256}.30.40 {rng.randrange(10**16):016d}") for i in range(2000)]
    rows += clean
    df = frame(spark, rows)
    model = secrets.train(secrets.counts(df.select("text")))
    assert all(len(a.next) > 2 for a in model.automata.values())  # states beside the one for what is unknown
    got = {r.doc_id: [s for s in r.spans if s.kind == "format"] for r in secrets.spans(df).collect()}
    texts = dict(rows)
    found = Counter(name for i, (name, key) in keys.items() if any(texts[i][s.start : s.end] == key for s in got[i]))
    assert min(found[n] for n in ("mixed", "prefixed", "dotted")) >= 90 and found["letters"] >= 50, found
    assert sum(len(got[i]) for i, _ in clean) <= 2  # of about 30,000 candidates
    redacted = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert sum(key in redacted[i] for i, (_, key) in keys.items()) <= 400 - sum(found.values())
    assert sum(redacted[i] != t for i, t in clean) <= 2


def test_automaton_scores_and_candidates():
    """Scores of whole arrays equal a walk by hand; candidates are what a regular expression finds beside base matches."""
    rng = random.Random(4)
    counts = Counter()
    for _ in range(500):
        text = rng.choice(["d" * 4 + "-" + "x" * 3, "lx" * 3, "XL" + "d" * 9]) + "$"
        counts.update(text[:k] for k in range(len(text) + 1))
    usual = {s: 1 / len(secrets.CLASSES) for s in secrets.CLASSES}
    automaton = secrets.Automaton(counts, 0.05, usual)
    words = [b"1234-abc", b"zaza" * 600, b"ZZ9", b"abcd?"]
    chars = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum([0] + [len(w) for w in words[:-1]])
    for w, score in zip(words, automaton.score(chars, start)):
        state, total = 0, 0.0
        for c in w:
            total += automaton.logs[state, secrets.PLACE_OF[c]]
            state = automaton.next[state, secrets.PLACE_OF[c]]
        assert abs(total - score) < 1e-6 * max(1, abs(total))
    texts = ["", "abcdefgh", None, "..longer-one.. x token=abcdefgh1 é12345678", "wxyz" * 5000, "short", "........", "A1b2C3d4"]
    column = kernel.Texts(pa.array(texts))
    data, row, begin, end = secrets.candidates(column, 0, len(texts), secrets.find(column, 0, len(texts)))
    assert [(r, data[a:b].tobytes().decode()) for r, a, b in zip(row, begin, end)] == [(1, "abcdefgh"), (3, "longer-one"), (3, "12345678"), (4, "wxyz" * 5000), (7, "A1b2C3d4")]


# ---- language model ------------------------------------------------------------------


def test_the_model_does_not_depend_on_splits(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 90)))) for i in range(400)] + [(None, "w1 w2"), (None, None), (7, "w1")]
    models = []
    for parts in (1, 8):
        docs = frame(spark, rows).repartition(parts)
        lexicon = lm.Lexicon(lm.token_counts(docs), 1 << 17, 30)
        models.append(lm.fit(docs, lexicon, hidden=6, shard=3000))  # several shards a round
        slots = lm.encoded(docs, lexicon, 6, 1, 1)
        numbers = [np.frombuffer(r.words, np.int16) for r in slots.collect()]
        assert len(numbers) == len(rows) and sum(map(len, numbers)) == lexicon.tokens and all(x[-1] == lexicon.end for x in numbers)
        assert slots.select("slot").distinct().count() == 6
    start = gru.start(lexicon.amount, 6, 1)
    for k in start:
        assert np.allclose(models[0][k], models[1][k], rtol=1e-4, atol=1e-5)
    assert not np.allclose(models[0]["hidden"], start["hidden"])


def test_rows_of_equal_keys_are_added():
    rng = np.random.default_rng(4)
    for keys, kinds in [(np.minimum(rng.geometric(0.05, 900) - 1, 50), 60), (np.zeros(40, int), 1), (np.arange(12)[::-1], 12), (np.repeat([3, 5], gru.OFTEN), 7), (rng.integers(0, 3, 5), 1 << 16)]:
        rows = rng.normal(size=(len(keys), 6))
        found, sums = gru._sums(rows, keys, kinds)
        assert sorted(found) == sorted(set(keys.tolist()))
        for k, own in zip(found, sums):
            assert own == pytest.approx(rows[keys == k].sum(0))


def test_scoring_holds_few_documents_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    count = rng.integers(1, 90, 1500)
    first = np.cumsum(count) - count
    numbers = rng.integers(0, 130, count.sum()).astype(np.int32)
    model = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru.start(np.arange(130.0) + 1, 6, 1).items()}
    held, log_prob = [], gru.log_prob
    monkeypatch.setattr(gru, "log_prob", lambda model, h, y: held.append(len(y)) or log_prob(model, h, y))
    got = gru.score(model, numbers, first, count, 0)
    assert sum(held) == count.sum() and max(held) <= 512 * gru.WINDOW
    for i in rng.integers(0, 1500, 12).tolist():  # each document by itself, a word at a time
        state, last, total = np.zeros((1, 6), np.float32), np.array([0]), 0.0
        for w in numbers[first[i] : first[i] + count[i]].tolist():
            state, _ = gru.step(model, last, state)
            last = np.array([w])
            total += log_prob(model, state, last)[0]
        assert got[i] == pytest.approx(total, rel=1e-4)
    assert len(gru.score(model, numbers, first[:0], count[:0], 0)) == 0


# ---- repeated and null ids -----------------------------------------------------------


def test_payloads_of_pages_that_share_an_id(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, "u", a), (2, "u", b), (3, "u", a), (3, "u", b), (3, "u", c), (3, "u", "short"), (4, "u", c), (None, "u", a), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.read(warc.write(pages)).collect()
    seen = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to or 0, r.payload or b"") for r in got)
    said = {(3, a): ("revisit", 1), (3, b): ("revisit", 2), (4, c): ("revisit", 3)}
    assert seen == sorted((i or 0, SHA(t or ""), *said.get((i, t), ("response", 0)), b"" if (i, t) in said else (t or "").encode()) for i, _, t in rows)


def test_items_without_id_or_with_a_shared_one(spark):
    rng = random.Random(2)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    items = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), (7, texts[0]), (8, None)], "item_id bigint, text string")
    docs = frame(spark, [(i, f"some words before {t} and after") for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.item_id or 0, r.n_item, r.n_shared) for r in decontaminate.contained(docs, items).collect()) == [(0, 7, 26, 26), (1, 7, 26, 26), (2, 0, 26, 26)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


# ---- words of any length -------------------------------------------------------------


def test_long_words_sum_all_segmentations():
    """Words beyond 32 bytes, by a sum over the first piece; expected counts by the derivative of the total."""
    pieces = langid.Pieces(langid.vocabulary_path())
    rng = np.random.default_rng(3)
    prob = rng.dirichlet(np.ones(pieces.size), 2).T
    assert pieces.longest > 12
    texts = ["internationalisierungsmassnahmenkatalogefragen", "приватизационныйдоговор", "x" * 33, "the"]
    column = kernel.Texts(pa.array(texts))
    own = kernel.Words(column, 0, len(texts), kernel.LETTERS)
    assert [i for i, _ in langid.long_words(column, own, np.arange(4))] == [0, 1, 2] and langid.cut_words(column, own, np.arange(4))[2].tolist() == [3]

    def number(table, raw):
        data = np.frombuffer(raw, np.uint8)
        return int(langid.Pieces.look_up(table, (kernel.BYTE_VALUE[data] * langid.POWER[: len(data)]).sum(dtype=np.uint64, keepdims=True))[0])

    def total(raw, prob):
        rest = [np.zeros(prob.shape[1]) for _ in raw] + [np.ones(prob.shape[1])]
        for at in range(len(raw) - 1, -1, -1):
            for end in range(at + 1, min(len(raw), at + pieces.longest) + 1):
                i = number(pieces.inner, raw[at:end])
                rest[at] = rest[at] + (prob[i] * rest[end] if i >= 0 else 0)
        out = prob[pieces.mark] * rest[0]
        for end in range(1, min(len(raw), pieces.longest) + 1):
            i = number(pieces.first, raw[:end])
            out = out + (prob[i] * rest[end] if i >= 0 else 0)
        return out

    for i, word in langid.long_words(column, own, np.arange(4)):
        raw = word.tobytes()
        assert np.exp(langid.long_forward(pieces, word, langid.logs_of(prob))[-1]) == pytest.approx(total(raw, prob), rel=1e-9)
        counts = np.zeros(prob.shape)
        langid.long_expected(pieces, word, 3.0, 1, langid.logs_of(prob), counts)
        assert not counts[:, 0].any()
        for piece in rng.choice(np.flatnonzero(counts[:, 1]), 3):
            more = prob.copy()
            more[piece] *= 1 + 1e-6
            assert counts[piece, 1] == pytest.approx(3 * (np.log(total(raw, more)[1]) - np.log(total(raw, prob)[1])) / 1e-6, rel=1e-3, abs=1e-6)
    data, length, owner = langid.cut_words(column, own, np.arange(4))
    assert langid.long_forward(pieces, data[0, : length[0]], langid.logs_of(prob))[-1] == pytest.approx(langid.forward(pieces, data, length, prob)[0])


def test_languages_of_long_words_and_clashing_names(spark):
    rng = random.Random(2)
    make = lambda stem: "".join(rng.choice(stem) for _ in range(30))
    stems = {"aa": ["mel", "tor", "nid"], "zz": ["приз", "дог", "вор"]}
    rows = [(i, make(stems[k]) + " " + make(stems[k]), k) for i, k in enumerate(["aa", "zz"] * 40)] + [(1000, "q" * 20_000, "aa"), (1001, None, "aa"), (1002, make(stems["zz"]), None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, _limit int, n string").repartition(3)
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs.where("doc_id < 1002"))).collect()}
    assert all(found[i] == k for i, _, k in rows[:80]) and found[1001] == "und" and found[1002] == "zz"


# ---- names that operators use inside -------------------------------------------------

CLASHES = ["_again", "_back", "_limit", "_page", "_own", "_id", "_h", "n", "hash", "code", "component", "component_id", "kept", "slot", "key", "digest", "size", "bucket", "spans", "words", "row", "ix", "own", "cell"]


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def test_columns_of_any_name_may_stand_beside(spark):
    """Every operator gives the same rows with and without columns named as those it makes."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "a") for i in range(4)] + [(3, texts[3], "de", "a"), (3, texts[3], "de", "a"), (None, None, None, None), (200, "token=abcdefgh1 MIT License " + prose(30), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(30)], "doc_id bigint, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    items = spark.createDataFrame([(1, " ".join(texts[5].split()[10:30])), (2, "x y")], "item_id bigint, text string")
    pages = spark.createDataFrame([(i % 6, "u", texts[i % 4] * 2) for i in range(9)], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([(i, i % 2, [float(i % 3), 1.0, 0.5]) for i in range(12)], "vec_id bigint, label int, embedding array<float>")
    talk = spark.createDataFrame([(i // 3, i % 3, ["user", "assistant"][i % 2], f"Hi {i}.") for i in range(12)], "conv_id bigint, turn bigint, role string, text string")
    hosted = lambda d: d.withColumns({"host": F.col("source"), "path": F.col("lang")})
    held = lambda d: d.withColumn("held_out", langid.held_out(F.col("doc_id"), 5))
    applied = {
        "vectors": lambda w: vectordup.near_duplicates(w(vectors)),
        "warc": lambda w: warc.read(warc.write(w(pages))),
        "language": lambda w: langid.predict(w(docs), langid.fit(w(docs))),
        "taken": lambda w: mixing.taken(w(docs), block_words=16),
        "mix": lambda w: mixing.mix(w(docs), block_words=16),
        "contained": lambda w: decontaminate.contained(w(docs), w(items)),
        "clean": lambda w: decontaminate.clean(w(docs), w(items)).select("doc_id", "text"),
        "secrets": lambda w: secrets.spans(w(docs)),
        "redact": lambda w: secrets.redact(w(docs)).select("doc_id", "text"),
        "quality": lambda w: quality.assess(w(hosted(docs)), w(labels)),
        "near": lambda w: neardup.near_duplicates(w(docs)),
        "one": lambda w: neardup.one_of_each(w(docs)).select("doc_id", "text"),
        "licenses": lambda w: licenses.scan(w(docs)),
        "model": lambda w: lm.score(w(held(docs)), w(held(docs)).where(~F.col("held_out")), vocabulary=20, hidden=4),
        "outliers": lambda w: outliers.judge(w(docs), least=10),
        "repair": lambda w: repair.repair(repair.undamaged(w(talk)), long_rows=2),
        "runs": lambda w: runs.find(w(docs), loops=True),
    }
    rounded = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    for name, apply in applied.items():
        plain, beside = (sorted(rounded(r) for r in apply(w).collect()) for w in (lambda d: d, with_clashes))
        assert plain == beside and plain, name
