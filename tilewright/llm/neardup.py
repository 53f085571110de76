"""Near-duplicate documents by SuperMinHash signatures.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words are runs of
non-space characters) as 64-bit hashes; a document with fewer words is one shingle; one
without words has the empty set and is linked with nothing.

1. *Signatures* (Ertl, 2017): every shingle visits the slots in a pseudorandom order and offers
   ``round + fraction`` to the slot of that round; a slot keeps the smallest offer. Rounds are
   run for all shingles of a document at once and stop as soon as no later round can lower a
   slot, which for most documents is after one to three of them.
2. *Equal sets* are represented by their smallest id, found by one grouping on a 128-bit
   fingerprint of the set.
3. *Banding*: representatives that agree on all rows of a band are candidates. With 32 bands of 4
   rows, a pair of similarity 0.75 is missed with probability 0.684**32 = 5e-6.
4. *Verification* compares full sets. First each document is checked against the bucket leader
   (smallest id) it shares most bands with. Then only buckets that still hold several components
   are looked into again. Documents of which more than a quarter occurs nowhere else among
   them can't have a link and go; the others' sets are compared in pairs of blocks, and a
   block returns no more links than join its components. So no pair of a bucket goes
   unexamined, and no group is expanded into its pairs.
5. *Grouping*: ``groups.components``.

Null ids are linked with nothing and kept. Rows that share an id are one node. Repeated rows,
ties and empty tables need no care; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import components
from .kernel import NOT_SPACE, PLACE, STEP, Texts, Words, distinct, hit, mix, shingles, signed, step
from .store import bitmap, discard, folded, folded_column, materialise, without

U = np.uint64
SLOTS, BANDS, BLOCK = 128, 32, 1024
UNSET = U(2**64 - 1)


def super_min_hash(rows: np.ndarray, codes: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_rows, slots) of the sets given as sorted rows and distinct element hashes.
    A slot holds round << 32 | fraction; rows without elements hold UNSET."""
    out = np.full(n_rows * slots, UNSET, U)
    low = U(0xFFFFFFFF)
    draw = mix(codes + STEP)
    place = ((draw & low) % U(slots)).astype(np.int64)
    np.minimum.at(out, rows * slots + place, draw >> U(32))
    filled = np.bincount(rows, minlength=n_rows) > 0
    order = None
    for turn in range(1, slots):
        open_rows = filled & (out.reshape(n_rows, slots).max(1) >= U(turn << 32))
        if not open_rows.any():
            break
        if order is None:
            use = open_rows[rows]
            rows, codes, place = rows[use], codes[use], place[use]
            each = np.arange(len(rows))
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(rows), 1))  # each element's permutation so far
            order[each, place], order[:, 0] = 0, place
        elif not (use := open_rows[rows]).all() and use.mean() < 0.7:
            rows, codes, order = rows[use], codes[use], order[use]
            each = np.arange(len(rows))
        draw = mix(codes + step(turn + 1))
        place = turn + ((draw & low) % U(slots - turn)).astype(np.int64)
        slot = order[each, place].astype(np.int64)
        order[each, place] = order[:, turn]
        np.minimum.at(out, rows * slots + slot, (draw >> U(32)) | U(turn << 32))
    return out.reshape(n_rows, slots)


def _sets(texts: Texts, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(Words(texts, first, last, NOT_SPACE)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column(1))
        for first, last in texts.parts():
            n = last - first
            rows, codes = _sets(texts, first, last)
            counts = np.bincount(rows, minlength=n)
            prints = []
            for salt in (1, 2):
                total = np.concatenate([[U(0)], np.cumsum(mix(codes * U(salt) + step(salt)))])
                at = np.concatenate([[0], np.cumsum(counts)])
                prints.append(total[at[1:]] - total[at[:-1]])
            table = super_min_hash(rows, codes, n)
            split = table.reshape(n, BANDS, SLOTS // BANDS)
            bands = mix((split * PLACE[: SLOTS // BANDS]).sum(2, dtype=U) + np.arange(BANDS, dtype=U) * STEP)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(counts.astype(np.int64)), signed(prints[0]), signed(prints[1]),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), signed(bands.ravel()))],
                names=["doc_id", "n_shingles", "print_a", "print_b", "bands"])


SKETCH = "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>"


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and codes (the set's sorted hashes) of the documents in ``ids``. A bitmap of fixed size
    keeps most other texts from being cut up; the join behind it is exact."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(folded_column("doc_id").alias("hash"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(hit(bits.value, folded(batch.column(0).to_numpy()))))
            texts = Texts(batch.column(1))
            for first, last in texts.parts():
                rows, codes = _sets(texts, first, last)
                cuts = np.searchsorted(rows, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first),
                                                  pa.array([codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["doc_id", "codes"])

    found = docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, codes binary").join(ids, "doc_id", "left_semi")
    return materialise(found.dropDuplicates(["doc_id"]), "sets")


def enough(common, x, y, percent: int):
    return (common > 0) & (100 * common >= percent * (x + y - common))


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets overlap enough: 100 * common >= percent * union."""
    sets = sets_of(docs, materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(bool(enough(common, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(k), F.col("codes").alias(f"codes_{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "codes_a", "codes_b")
    links = materialise(both.mapInArrow(check, "a bigint, b bigint"), "verified")
    discard(sets)
    return links


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """Ids of the sets that can link with another: at least ``percent`` of the elements occur in one.

    Only elements of one set matter, so one grouping with partial sums finds them."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, codes in zip(batch.column(0), batch.column(1)):
                codes = np.frombuffer(codes.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.full(len(codes), doc_id.as_py(), np.int64))], names=["code", "doc_id"])

    alone = sets.mapInArrow(elements, "code bigint, doc_id bigint").groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("_last"))
    alone = alone.where("doc_id = _last").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    size = F.length("codes") / 8
    return sets.join(alone, "doc_id", "left").where(100 * (size - F.coalesce("alone", F.lit(0))) >= percent * size).select("doc_id")


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that meet in a bucket (``code``): full sets are compared within
    pairs of blocks of the bucket, and no more links are returned than join its components."""
    sizes = members.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "code").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "doc_id", "component")
    dealt = dealt.join(sets, "doc_id")

    def links(group: pa.Table, same: bool) -> tuple[list[int], list[int]]:
        ids, component, second = (group[k].to_numpy() for k in ("doc_id", "component", "second"))
        if len(np.unique(component)) < 2:
            return [], []
        sets = [np.frombuffer(x, U) for x in group["codes"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        root = dict.fromkeys(component.tolist())

        def top(x):
            while root[x] is not None:
                x = root[x]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        inside = np.zeros(int(number.max()) + 1, bool)
        for x in range(len(ids)) if same else np.flatnonzero(~second):
            mine = number[cuts[x] : cuts[x + 1]]
            inside[mine] = True
            common = np.add.reduceat(inside[number], cuts[:-1], dtype=np.int64)
            inside[mine] = False
            near = enough(common, sizes[x], sizes, percent) & (component != component[x])
            for y in np.flatnonzero(near if same else near & second):
                a, b = top(int(component[x])), top(int(component[y]))
                if a != b:
                    root[a] = b
                    found[0].append(int(ids[x]))
                    found[1].append(int(ids[y]))
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush():
            a, b = links(pa.Table.from_batches(group), key[1] == key[2])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("code", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                own = tuple(keys[:, low].tolist())
                if own != key and group:
                    yield flush()
                    group = []
                key = own
                group.append(batch.slice(low, high - low))
        if group:
            yield flush()

    columns = ["code", "i", "j", "second", "doc_id", "component", "codes"]
    return dealt.select(*columns).repartition("code", "i", "j").sortWithinPartitions("code", "i", "j").mapInArrow(scan, "a bigint, b bigint")


def _open(members: DataFrame) -> DataFrame:
    """Buckets that hold several components; of those with equal members the first."""
    mixed = members.groupBy("code").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("doc_id")).alias("_x"))
    mixed = mixed.where("_low != _high").groupBy("_low", "_high", "_n", "_x").agg(F.min("code").alias("code"))
    return members.join(mixed.select("code"), "code")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept; a row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = materialise(docs.mapInArrow(_sketch, SKETCH), "sketches")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")

    classes = full.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = materialise(full.select("doc_id", "print_a", "print_b").join(classes, ["print_a", "print_b"]).where("doc_id != rep").select("doc_id", "rep").distinct(), "copies")
    reps = full.join(copies, "doc_id", "left_anti")

    banded = reps.select("doc_id", F.explode("bands").alias("code"))
    hubs = banded.groupBy("code").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("_last")).where("lead != _last").drop("_last")
    buckets = materialise(banded.join(hubs, "code"), "buckets")
    stars = buckets.where("doc_id != lead").groupBy("doc_id", "lead").agg(F.count(F.lit(1)).alias("n"))
    first = stars.groupBy("doc_id").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    links = verified(docs, materialise(first, "stars"), percent)
    labels = materialise(components(links, "a", "b"), "labels")

    placed = buckets.select("code", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    members = materialise(_open(placed), "open-buckets")
    if not members.isEmpty():
        sets = sets_of(docs, members.select("doc_id").distinct())
        members = _open(members.join(linkable(sets, percent), "doc_id"))
        links = links.unionByName(materialise(across(members, sets, percent), "links-across"))
        discard(sets, labels)
        labels = components(links, "a", "b")
    discard(buckets)

    out = sketch.select("doc_id", "n_shingles").join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the documents of a group that aren't its smallest id; rows that share an id are
    one document, of which any row stays. Rows with null ids stay."""
    found = materialise(near_duplicates(docs, percent).select("doc_id", "kept").where("doc_id IS NOT NULL"), "groups")
    left = without(docs, found.where("NOT kept"))
    repeated = materialise(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "repeated")
    if repeated.isEmpty():
        return left
    same = left["doc_id"].cast("bigint") == repeated["_again"]
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))
