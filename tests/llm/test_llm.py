"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tilewright.llm import covertree, decontaminate, groups, gru, kernel, langid, licenses, lm, mixing, neardup, quality, secrets, vectordup, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
SPACE, SPACE_OR_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE.findall(low(text))


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Documents of (id, text) or (id, text, lang, source), dealt over several partitions."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x") for r in rows]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([3, 30, 200]))) for i in range(60)]
    base = prose(rng, 120)
    rows += [(100 + i, base.upper() if i % 2 else base.replace(" ", "\n ")) for i in range(6)]
    for i in range(80):  # near copies from closely alike to just apart
        w = base.split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "ONE  two"), (405, "one two three four"), (100, base), (406, prose(rng, 20000)), (406, None)]
    return rows


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_words_and_hashes(monkeypatch, piece):
    monkeypatch.setattr(kernel, "PIECE", piece)
    rng = random.Random(2)
    for _ in range(150):
        texts = [rng.choice([None, "", "".join(rng.choice("ab \n\tAé€𝄞.9") for _ in range(rng.randrange(30))), "x" * rng.randrange(40)]) for _ in range(rng.randrange(9))]
        column = kernel.Texts(pa.array(texts, pa.string()))
        for first, last in column.parts(rng.choice([5, 50])):
            for table, pattern in ((kernel.NOT_SPACE, SPACE), (kernel.ALPHANUMERIC, SPACE_OR_WORD)):
                got = kernel.Words(column, first, last, table)
                expected = [(i, w) for i, t in enumerate(texts[first:last]) for w in pattern.findall(low(t))]
                assert [(r, bytes(kernel.LOWER[column.bytes[a:b]]).decode()) for r, a, b in zip(got.row, got.begin, got.end)] == expected
                assert [int(c) for c in got.code] == [kernel.hash_text(w) for _, w in expected]
                counts = np.bincount(kernel.shingles(got)[0], minlength=last - first)
                n = np.bincount([i for i, _ in expected], minlength=last - first) if expected else np.zeros(last - first)
                assert (counts == np.where(n >= 5, n - 4, n > 0)).all()


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    table = kernel.HashTable(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + np.uint64(1)) == -1).all() and (kernel.HashTable(keys[:0]).find(keys) == -1).all()


def test_super_min_hash_is_a_permutation_minimum():
    """The early stop changes nothing, and the share of equal slots estimates the similarity."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 300).astype(np.uint64)
    slots, low32 = 32, (1 << 32) - 1
    for n in (1, 3, 40, 300):
        expected = [2**64 - 1] * slots
        for c in codes[:n]:
            order = list(range(slots))
            for turn in range(slots):
                draw = int(kernel.mix(np.array([c]) + kernel.step(turn + 1))[0])
                k = turn + (draw & low32) % (slots - turn)
                order[turn], order[k] = order[k], order[turn]
                expected[order[turn]] = min(expected[order[turn]], turn << 32 | draw >> 32)
        got = neardup.super_min_hash(np.zeros(n, np.int64), codes[:n], 1, slots)
        assert got[0].tolist() == expected
    a, b = (neardup.super_min_hash(np.zeros(200, np.int64), x, 1, 128)[0] for x in (codes[:200], codes[50:250]))
    assert abs((a == b).mean() - 0.6) < 0.12


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4), "a", "b").collect()}
    expected = union_find({x for p in links for x in p}, links)
    assert got == {k: v for k, v in expected.items() if k != v}
    assert not groups.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect()


def check_near_duplicates(rows, got):
    sets = {}
    for i, t in rows:
        sets[i] = sets.get(i) or shingles(t)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = union_find(sets, links)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates(spark, copies):
    got = neardup.near_duplicates(frame(spark, copies + [(None, "w1 w2"), (None, None)])).collect()
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 1] and all(r.kept for r in got if r.doc_id is None)
    got = [r for r in got if r.doc_id is not None]
    assert len(got) == len(copies)
    check_near_duplicates(copies, got)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in copies)
    kept = neardup.one_of_each(frame(spark, copies + [(None, "w1 w2")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted([(False, i) for i in {r.component_id for r in got}] + [(True, 0)])
    assert not neardup.near_duplicates(frame(spark, [])).collect()


def test_links_across_components_are_found_without_leaders(spark):
    """Chains: neighbours link, ends don't, so leaders alone would leave parts."""
    rng = random.Random(5)
    w = [f"c{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(40):
        rows.append((rng.randrange(10**6), " ".join(w)))
        w = w[2:] + [f"c{rng.randrange(10**6)}" for _ in range(2)]
    check_near_duplicates(rows, neardup.near_duplicates(frame(spark, rows)).collect())


def test_containment(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n, 10**6)) for i, n in enumerate([14, 33, 57, 90, 5])] + [(10, "Two words"), (11, ""), (12, None), (None, prose(rng, 20)), (0, None)]
    items = items[:-1]
    docs = []
    for i in range(40):
        w = prose(rng, rng.choice([10, 300, 5000])).split()
        if i % 2:
            part = items[i % 5][1].split()
            for _ in range(i % 4):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "say TWO\nwords twice, two words"), (103, "two, words"), (1, docs[1][1])]
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    expected = {}
    for d, t in docs:
        for i, x in items:
            w, own = words(t), words(x)
            if i is None or not own:
                continue
            width = min(5, len(own))
            cut = lambda w: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            both = cut(own) & cut(w)
            if 100 * len(both) >= 75 * len(cut(own)):
                expected[d, i] = (len(cut(own)), len(both))
    assert got == expected and {1, 2, 3, 10} <= {i for _, i in got}
    left = {r.doc_id for r in decontaminate.clean(frame(spark, docs + [(None, "x")]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in expected} | {None}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert not decontaminate.contained(frame(spark, docs), empty).collect() and not decontaminate.contained(frame(spark, []), empty).collect()


def test_targets():
    make = lambda *x: [mixing.Source(str(i), w, n) for i, (w, n) in enumerate(x)]
    some = make((1, 1000), (2, 10), (3, 1000), (1, 0))
    mixing.share_out(some, 3)
    assert [s.target for s in some] == pytest.approx([495.0, 30.0, 1485.0, 0.0])
    assert sorted(mixing.permute(np.arange(1000), 1000, 5).tolist()) == list(range(1000)) and mixing.permute(np.arange(1), 1, 3).tolist() == [0]


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "b", "é", None])) for i in range(400)]
    rows += [(500, None, "en", "a"), (501, "", "en", "empty"), (502, prose(rng, 5000), "en", "b"), rows[0], (None, "null id", "en", "b")]
    docs = frame(spark, rows)
    first, second = (sorted(map(tuple, mixing.taken(docs, block_words=16, shard_slots=64).collect()), key=repr) for _ in range(2))
    assert first == second and len(first) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    plan = [mixing.Source(s, i % 3 + 1, sizes[s]) for i, s in enumerate(names)]
    mixing.share_out(plan, 3)
    for s in plan:
        own = [r for r in first if r[1] == s.name]
        assert all(r[3] == s.words and r[4] == pytest.approx(s.target) for r in own)
        assert abs(sum(r[5] for r in own) - s.target) <= 16 and all(r[5] <= 3 * r[2] for r in own)
    blocks = mixing.mix(docs, block_words=16, shard_slots=64).collect()
    assert sum(b.n_words for b in blocks) == sum(r[5] for r in first) and all(len(words(b.text)) == b.n_words <= 16 for b in blocks)
    taken = Counter(w for b in blocks for w in b.text.split())
    assert set(taken) <= {w for r in rows for w in SPACE.findall(r[1] or "")}
    assert not mixing.taken(frame(spark, [])).collect() and not mixing.mix(frame(spark, [(1, None)])).collect()


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets(spark):
    rng = random.Random(8)
    token = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    hexes, keys = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    texts = ["été €𝄞 " + rng.choice(['PassWord="{}"', "api_key : {}", "apikey={}", "token = '{}'", "{}", "secret{}"]).format(rng.choice([token(hexes, 40), token(hexes, 31), token(hexes, 6), "AKIA" + token(keys, 16), "AKIA" + token(keys, 11)])) + " fin"
             for _ in range(300)]
    texts += [None, "", "token=", "AKIA" * 5, "a" * 31 + "0", "passwd=" + "a1" * 5000, "abc " * 3000 + token(hexes, 32), "secret=12345678token=abcdefgh", "tokentoken=12345678",
              "mail someone.else.entirely@example2.example.com", "f" * 40 + "password:" + "9" * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "token=abcdefgh1")]
    got = secrets.digest(secrets.spans(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        own = base_spans(texts[r.doc_id] if r.doc_id is not None else "token=abcdefgh1")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in own) for k in secrets.KINDS[:3])
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == [s for s in written.split(",") if s]
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows[:-2])).collect()}
    assert not any(base_spans(t) for t in clean.values()) and clean[300] is None and clean[0].startswith("été €𝄞 ") and clean[0].endswith(" fin")
    assert not secrets.spans(frame(spark, [])).collect()
    assert secrets.digest(secrets.spans(frame(spark, [(1, "plain A1B2C3D4E5F6G7H8I9J0K1")]))).first().spans == ""


def test_inferred_format_is_added(spark):
    """Keys of the known format that no base pattern takes, here longer than their words break."""
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'x token = "{key()}" y') for i in range(200)] + [(i, prose(rng, 50) + " internationalisation-of-2-long-words") for i in range(200, 300)]
    rows += [(1000, f"see {key().upper()[:20]}{key()[:20]} here"), (1001, "x " + key()[:30] + "-" + key()[:9])]
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.spans(frame(spark, rows))).collect()}
    assert all("format" not in found[i] for i in range(300))


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "Licensed under the Apache  License, Version 2.0", "CC BY-NC 4.0; cc-by", "gnu general\npublic license gnu general public license",
             "Relased undr the MIT Licence", "é " * 50 + "Licensed undr the Apche License Version 2.0" + " z" * 500, "mit licenses", "a mit, license b", "cc byline", "This work is licensd under the GNU General Public Licence"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(frame(spark, rows))).collect()}
    for i, t in enumerate(texts):
        w = SPACE_OR_WORD.findall(low(t))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= {"", *r.labels.split(",")} and 0 <= r.score <= 1
    assert got[6].labels == "mit" and 0.8 < got[6].score < 1 and got[7].labels == "apache" and got[11].labels == "gpl" and got[10].labels == "" and got[4].labels == "cc-by"
    spans = {r.doc_id: r.notices for r in licenses.scan(frame(spark, rows)).collect()}
    (note,) = spans[7]
    assert texts[7][note.start : note.end] == "Licensed undr the Apche License Version 2.0"
    assert not licenses.scan(frame(spark, [])).collect()


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(langid.vocabulary_path())
    rng = np.random.default_rng(3)
    prob = rng.dirichlet(np.ones(pieces.size), 2).T
    column = kernel.Texts(pa.array(["theory été Internationalisation x"]))
    own = kernel.Words(column, 0, 1, kernel.LETTERS)
    data, length, owner = langid.cut_words(column, own, np.arange(len(own.begin)))
    logs = langid.forward(pieces, data, length, prob)

    def key(raw):
        data = np.frombuffer(raw, np.uint8)
        return (kernel.BYTE_VALUE[data] * langid.POWER[: len(data)]).sum(dtype=np.uint64, keepdims=True)

    def total(raw):
        """Sum over segmentations by recursion on the first piece."""
        def rest(at):
            if at == len(raw):
                return np.ones(2)
            out = np.zeros(2)
            for end in range(at + 1, min(len(raw), at + langid.PIECE_BYTES) + 1):
                i = langid.Pieces.look_up(pieces.inner, key(raw[at:end]))[0]
                if i >= 0:
                    out = out + prob[i] * memo(end)
            return out

        seen = {}

        def memo(at):
            if at not in seen:
                seen[at] = rest(at)
            return seen[at]

        out = prob[pieces.mark] * memo(0)
        for end in range(1, min(len(raw), langid.PIECE_BYTES) + 1):
            i = langid.Pieces.look_up(pieces.first, key(raw[:end]))[0]
            if i >= 0:
                out = out + prob[i] * memo(end)
        return out

    for i in range(len(owner)):
        raw = data[i, : length[i]].tobytes()
        assert np.exp(logs[i]) == pytest.approx(total(raw), rel=1e-9)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.held_out(F.col("doc_id"), 3)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs.where(~out))).collect()}
    rows = docs.select("doc_id", "lang", out.alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in tested) >= 0.97 * len(tested) and all(0 <= r.score <= 1 for r in got.values())


def test_rare_languages_and_null_ids_are_sampled(spark):
    rng = random.Random(12)
    many, few = ([f"{stem}{a}{b}" for a in "aeiou" for b in "aeiou"] for stem in ("mel", "zun"))
    rows = [(None if i % 2 else i, " ".join(rng.choices(many, k=8)), "aa") for i in range(2000)]
    rows += [(10_000 + i, " ".join(rng.choices(few, k=8)), "zz") for i in range(3)]
    docs = frame(spark, rows)
    for fit_docs in (100, 400):
        drawn = Counter((r.lang, r.doc_id is None) for r in langid.draw(docs, ["aa", "zz"], np.array([2000.0, 3.0]), fit_docs).collect())
        assert drawn["zz", False] == 3 and all(0.25 * fit_docs < drawn["aa", x] < 0.75 * fit_docs for x in (True, False))
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs, fit_docs=100)).collect()}
    assert all(found[10_000 + i] == "zz" for i in range(3)) and found[0] == "aa"
    assert langid.level(np.array([3.0, 5000.0, 7000.0]), 1003) == 500 and langid.level(np.array([3.0, 40.0]), 1000) == np.inf and langid.level(np.full(1000, 90.0), 100) == langid.LEAST


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "12 + 3 — €", None), (5, "", None), (6, "Ё" * 3000, None), (7, "LE CHIEN", None), (None, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("en", "fr") and got[7][0] == "fr" and got[None][0] == "en"
    assert langid.fit(docs.where("lang IS NULL")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_gradient():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in gru.start(np.arange(130, 0, -1) * 10, 6, 1).items()}
    x, y, h, fresh = rng.integers(0, 130, (5, 3)), rng.integers(0, 130, (5, 3)), rng.normal(size=(3, 6)), rng.random((5, 3)) < 0.2

    def loss(m):
        state, states = h, []
        for t in range(5):
            state, _ = gru.step(m, x[t], np.where(fresh[t][:, None], 0, state))
            states.append(state)
        return -gru.log_prob(m, np.concatenate(states), y.ravel()).mean()

    grad, _ = gru.gradient(model, x, y, h, fresh)
    for k in model:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in model[k].shape)
            at = (x[rng.integers(5), rng.integers(3)], at[1]) if k == "input" else at
            up, down = ({q: v.copy() for q, v in model.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-6)
    assert sum(np.exp(gru.log_prob(model, h[:1], np.array([w]))[0]) for w in range(130)) == pytest.approx(1)


def test_training_lowers_the_loss_and_windows_carry_the_state():
    stream = np.array(([3, 5, 7, 9, 1, 0] * 2000), np.int32)
    model = gru.start(np.ones(12), 8, 1)
    trained = gru.train(model, stream, 0)
    first, count = np.arange(0, 60, 6), np.full(10, 6)
    assert gru.score(trained, stream, first, count, 0).mean() > gru.score(model, stream, first, count, 0).mean() + 4
    long = np.arange(200, dtype=np.int32) % 11 + 1
    one = gru.score(trained, long, np.array([0]), np.array([200]), 0)
    state, last, total = np.zeros((1, 8), np.float32), np.array([0]), 0.0
    for w in long:
        state, _ = gru.step(trained, last, state)
        total += gru.log_prob(trained, state, np.array([w]))[0]
        last = np.array([w])
    assert one[0] == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize("known", [4, 1 << 17])
def test_language_model_scores(spark, known):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 80), 60)) for i in range(150)] + [(200, None), (201, ""), (202, "never SEEN w1 never"), (0, "w1 w2"), (203, prose(rng, 3000, 60)), (None, "w3")]
    docs = frame(spark, rows).withColumn("held_out", langid.held_out(F.col("doc_id"), 5))
    got = lm.score(docs, docs.where(~F.col("held_out")), known=known, vocabulary=20, share=2).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not out(i) for w in words(t) + [None])
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in rows:
        w = words(t) + [None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        expected[i, out(i), len(w), sum(counts[x] > 0 for x in w), total, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    empty = lm.score(docs, docs.where("false"), share=2).collect()
    assert len(empty) == len(rows) and all(r.n_known == 0 and math.isfinite(r.score) for r in empty)


def test_every_training_document_is_learnt(spark):
    for i in [0, 1, 2, 3, None]:
        docs = frame(spark, [(i, "w1 w2 w3 " * 100)])
        lexicon = lm.Lexicon(lm.token_counts(docs), 1 << 17, 20)
        model, start = lm.fit(docs, lexicon, hidden=4), gru.start(lexicon.amount, 4, 1)
        assert any((model[k] != start[k]).any() for k in model), i


def test_a_stream_in_parts_carries_the_sums():
    stream = np.array([3, 5, 7, 9, 1, 0] * 600, np.int32)
    seen, model = {}, gru.start(np.ones(12), 8, 1)
    for part in np.split(stream, 3):
        before = {k: v.copy() for k, v in seen.items()}
        model = gru.train(model, part, 0, seen=seen)
        assert all((seen[k] >= before[k]).all() for k in before) and (seen["bias"] > before.get("bias", 1e-4)).any()
    assert all(np.isfinite(v).all() for v in model.values())


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"host": F.col("source"), "path": F.col("lang")})
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    taught = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.assess(docs, taught).collect()}
    assert len(got) == docs.count()
    tested = [r for r in labels.where("doc_id % 2 = 1").collect() if not r.toxic]
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in tested) >= 0.95 * len(tested)
    assert sum(got[r.doc_id].kept for r in tested if r.quality) >= 0.97 * sum(r.quality for r in tested)


def test_quality_of_odd_rows(spark):
    rows = [(1, "some words", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "x", "en", "a"), (4, "w " * 20000, "en", "b"), (1, "some words", "en", "a")]
    docs = frame(spark, rows).withColumns({"host": F.col("source"), "path": F.col("lang")})
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (9, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert len(quality.assess(docs, labels).collect()) == len(rows)
    none = quality.assess(docs, labels.where("false")).collect()
    assert len(none) == len(rows) and all(r.kept for r in none)
    assert not quality.assess(docs.where("false"), labels).collect()


def test_sparse_sites_are_shrunk_towards_the_global_rate(spark):
    rows = [(i, f"h{i % 4}", "p", 1.0 if i % 4 == 0 else 0.0) for i in range(4000)] + [(9000, "h5", "p", 1.0), (9001, "h5", "p", 1.0)]
    got = {r.doc_id: r.rate_bad for r in quality.shrunk(spark.createDataFrame(rows, "doc_id bigint, host string, path string, y_bad double"), "bad").collect()}
    assert got[0] > 0.95 and got[1] < 0.05 and 0.25 < got[9000] < 0.9


def test_cover_tree_finds_all_close_pairs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(120, 8)), rng.normal(size=(1, 8)) + 0.1 * rng.normal(size=(90, 8)), np.ones((1, 8))])
    x = np.concatenate([x, x[:5] * 2, x[:40] + 0.02 * rng.normal(size=(40, 8))])
    unit, norm = vectordup._unit(x)
    near = unit @ unit.T >= 0.98
    tree = covertree.Tree(unit)
    for node, kids in enumerate(tree.kids):  # nested runs, radii cover
        own = tree.order[tree.first[node] : tree.last[node]]
        assert np.sqrt(((unit[own] - unit[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-12
        assert not kids or sum(tree.last[k] - tree.first[k] for k in kids) == len(own)
    got = Counter((min(a, b), max(a, b)) for i, j in covertree.close_pairs(tree, None, 0.98, (norm, norm), (x, x)) for a, b in zip(i.tolist(), j.tolist()))
    assert got == Counter((i, j) for i, j in zip(*np.nonzero(np.triu(near, 1))))
    left, right = np.arange(0, len(x), 2), np.arange(1, len(x), 2)
    got = Counter((left[a], right[b]) for i, j in covertree.close_pairs(covertree.Tree(unit[left]), covertree.Tree(unit[right]), 0.98, (norm[left], norm[right]), (x[left], x[right])) for a, b in zip(i.tolist(), j.tolist()))
    assert got == Counter((i, j) for i in left for j in right if near[i, j])


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectordup, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows, at = [], 0
    for label in (0, 1, 1, 1):
        middle = rng.normal(size=6)
        for scale in (0.02, 0.08, 3.0):
            for _ in range(30):
                rows.append((at, label, (middle + scale * rng.normal(size=6)).tolist()))
                at += 1
    rows += [(at + 1, 1, rows[70][2]), (at + 2, 1, rows[70][2]), (at + 3, 1, [2 * x for x in rows[70][2]]), (at + 4, None, rows[70][2]), (at + 5, 0, None), (at + 6, 0, [0.0] * 6), (at + 7, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (at + 8, 0, [float("nan")] * 6), (at + 9, 0, [float("inf")] * 6), (at + 10, 0, []), (at + 11, 0, [1.0, 2.0]), (at + 12, 2, [1.0, 2.0])]
    rows.append((None, 1, rows[70][2]))
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("extra", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectordup.near_duplicates(df).collect()}
    good = [(i, k, np.array(v, float)) for i, k, v in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])) >= 0.98]
    degree, root = Counter(x for p in links for x in p), union_find([r[0] for r in rows if r[0] is not None], links)
    assert got == {i: (degree[i], root[i], root[i] == i) for i in root} | {None: (0, None, True)} and len(links) > 1000
    assert not vectordup.near_duplicates(df.where("false")).collect()


def read_all(spark, paths):
    return warc.read(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_archives(spark):
    page = "<html>" + "é" * 60
    rows = [(5, "http://a b/\n", page), (3, None, page), (9, "u", page), (7, "u", "x" * 99), (8, "u", "x" * 99), (1, "u", None), (2, "u", ""), (None, "u", page), (4, "u", "big " * 200000), (9, "u", page)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, extra int").repartition(3)
    found = warc.read(warc.write(df, archive_bytes=200)).collect()
    kinds = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == page and i not in (None, 3)
        kinds[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None, None if again else raw] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found) == kinds
    assert {r.url for r in found if r.page_id == 5} == {"http://a%20b/%0A"} and {r.url for r in found if r.page_id == 3} == {None}
    assert not warc.read(warc.write(df.where("false"))).collect()


def test_zip64_and_missing_index(spark, tmp_path, monkeypatch):
    records = [zlib.compress(warc.record(i, f"http://{i}", b"p" * i, None, "2025-01-01T00:00:00Z")[0], 1, 31) for i in range(50)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(warc, "READ_BYTES", 64)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr("readme.txt", "r" * 500)
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
            f.write(b"".join(records))
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 in the end record"
    assert b"PK\x06\x06" in (tmp_path / "a.zip").read_bytes()
    got = {r.page_id: (r.payload_bytes, r.url, bytes(r.payload)) for r in read_all(spark, [str(tmp_path / "a.zip")]).collect()}
    assert got == {i: (i, f"http://{i}", b"p" * i) for i in range(50)}
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"".join(records))
    with pytest.raises(Exception, match="not stored"):
        read_all(spark, [str(tmp_path / "b.zip")]).collect()
