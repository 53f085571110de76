"""Change regions: components of changed pixels, their outlines, boxes and dates.

Work per pixel block is bounded by the block size. A region larger than a block, or a
site that holds a large share of all pixels, is put together from block-local parts
through the edges between border pixels.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import change
from ..session import cut_lineage
from .components import component_names
from .pairs import wet
from .ranges import numbered

BLOCK = 512


def _local_labels(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First pixel (row by row) of each pixel's 4-connected component within a block."""
    r0, c0 = rows.min(), cols.min()
    height, width = int(rows.max() - r0 + 1), int(cols.max() - c0 + 1)
    filled = np.zeros((height, width), dtype=bool)
    filled[rows - r0, cols - c0] = True
    none = height * width
    label = np.where(filled, np.arange(none).reshape(height, width), none)
    while True:
        least = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
            both = filled[a] & filled[b]
            low = np.where(both, np.minimum(least[a], least[b]), none)
            least[a] = np.where(both, np.minimum(least[a], low), least[a])
            least[b] = np.where(both, np.minimum(least[b], low), least[b])
        flat = np.append(least.ravel(), none)
        jumped = flat[flat[least]]
        if np.array_equal(jumped, label):
            found = label[rows - r0, cols - c0]
            return found // width + r0, found % width + c0
        label = jumped


def _blocked(pixels: DataFrame, block: int) -> DataFrame:
    return pixels.withColumns({"_br": F.floor(F.col("prow") / block), "_bc": F.floor(F.col("pcol") / block)})


COL_BITS = 31
WHOLE = ("tinyint", "smallint", "int", "bigint")


def component_code(row: Column, col: Column) -> Column:
    """A pixel as one integer that sorts row by row."""
    return F.shiftleft(row.cast("bigint"), COL_BITS).bitwiseOR(col.cast("bigint"))


def component_name(key: list[str], code: Column) -> Column:
    """Printable name of a component: its key and first pixel."""
    return F.concat_ws("|", *key, F.shiftright(code, COL_BITS), code.bitwiseAND(F.lit((1 << COL_BITS) - 1)))


def _numbered_keys(pixels: DataFrame, key: list[str]) -> tuple[DataFrame, Column]:
    """Pixels with the number of their key: the key itself if it is one whole number, else its place in the order of keys."""
    if len(key) == 1 and dict(pixels.dtypes)[key[0]] in WHOLE:
        return pixels, F.col(key[0]).cast("bigint")
    numbers = numbered(pixels.select(*key).distinct(), [], F.struct(*key), "_key").select(*[F.col(k).alias(f"_key_{k}") for k in key], "_key")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]
    return pixels.join(numbers, reduce(Column.__and__, same)).drop(*[f"_key_{k}" for k in key]), F.col("_key")


def label_components(pixels: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """4-connected components of the given pixels as (key, prow, pcol, component).

    ``component`` is the ``component_code`` of its first pixel row by row, whatever the block size, and unique per key. Blocks
    are labelled by themselves; the labels of pixels on both sides of a block's border are the edges that join
    them. An edge's ends are 64-bit integers of key, row and column, of as many bits as the pixels need.
    """
    types = dict(pixels.dtypes)
    fields = ", ".join([f"{k} {types[k]}" for k in key] + ["prow bigint", "pcol bigint", "_r bigint", "_c bigint"])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        first_row, first_col = _local_labels(pdf["prow"].to_numpy(), pdf["pcol"].to_numpy())
        return pd.DataFrame({**{k: pdf[k] for k in key}, "prow": pdf["prow"], "pcol": pdf["pcol"], "_r": first_row, "_c": first_col})

    keyed = _blocked(pixels.select(*key, F.col("prow").cast("bigint"), F.col("pcol").cast("bigint")), block)
    labelled = keyed.groupBy(*key, "_br", "_bc").applyInPandas(local, fields)
    labelled = cut_lineage(labelled.select(*key, "prow", "pcol", component_code(F.col("_r"), F.col("_c")).alias("component")))

    at_border = [F.pmod(F.col(axis), F.lit(block)).isin(0, block - 1) for axis in ("prow", "pcol")]
    border = labelled.where(at_border[0] | at_border[1])
    border, number = _numbered_keys(border, key)
    border = border.select(number.alias("_n"), *key, "prow", "pcol", "component")
    top = border.agg(F.max("_n"), F.max("prow"), F.max("pcol"), F.min(F.least("_n", "prow", "pcol"))).first()
    if top[0] is None:
        return labelled
    row_bits, col_bits = top[1].bit_length(), top[2].bit_length()
    if top[3] < 0 or top[0].bit_length() + row_bits + col_bits > 63:
        raise ValueError(f"keys up to {top[0]}, rows up to {top[1]} and columns up to {top[2]} don't fit into one integer")
    mask = (1 << COL_BITS) - 1
    node = F.shiftleft("_n", row_bits + col_bits).bitwiseOR(F.shiftleft(F.shiftright("component", COL_BITS), col_bits)).bitwiseOR(F.col("component").bitwiseAND(F.lit(mask)))
    border = cut_lineage(border.select(*key, "prow", "pcol", "_n", "component", node.alias("_node")))
    edges = None
    for axis in ("prow", "pcol"):
        low = border.where(F.pmod(F.col(axis), F.lit(block)) == block - 1).select(
            "_n", *[(F.col(x) + (1 if x == axis else 0)).alias(x) for x in ("prow", "pcol")], F.col("_node").alias("a"))
        high = border.where(F.pmod(F.col(axis), F.lit(block)) == 0).select("_n", "prow", "pcol", F.col("_node").alias("b"))
        met = low.join(high, ["_n", "prow", "pcol"]).select("a", "b")
        edges = met if edges is None else edges.unionByName(met)
    names = component_names(edges)
    if names is None:
        return labelled
    first = F.shiftright("new", col_bits).bitwiseAND(F.lit((1 << row_bits) - 1)), F.col("new").bitwiseAND(F.lit((1 << col_bits) - 1))
    renamed = border.select(*key, "component", "_node").distinct().join(names.withColumnRenamed("old", "_node"), "_node")
    renamed = renamed.select(*[F.col(k).alias(f"_to_{k}") for k in key], F.col("component").alias("_to"), component_code(*first).alias("_new"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_to_{k}")) for k in key], F.col("component") == F.col("_to"))
    return labelled.join(renamed, same, "left").select(*key, "prow", "pcol", F.coalesce("_new", "component").alias("component"))


def interior_pixel(labelled: DataFrame, key: list[str]) -> DataFrame:
    """One pixel inside each component: the middle of the longest run in its middle row."""
    span = labelled.groupBy(*key, "component").agg(F.floor((F.min("prow") + F.max("prow")) / 2).alias("_mid"))
    middle = labelled.join(span, [*key, "component"]).where(F.col("prow") == F.col("_mid"))
    along = Window.partitionBy(*key, "component").orderBy("pcol")  # one pixel row of one component
    runs = middle.withColumn("_run", F.col("pcol") - F.row_number().over(along)).groupBy(*key, "component", "prow", "_run").agg(
        F.min("pcol").alias("_start"), F.count(F.lit(1)).alias("_len"))
    best = runs.groupBy(*key, "component", "prow").agg(F.min_by(F.struct("_start", "_len"), F.struct(-F.col("_len"), F.col("_start"))).alias("_b"))
    return best.select(*key, "component", "prow", (F.col("_b._start") + F.floor((F.col("_b._len") - 1) / 2)).alias("pcol"))


def region_features(classified: DataFrame, key: list[str], height: Column | int, width: Column | int, top_lat: Column,
                    pixel_deg: float = 0.0001, min_px: int = K.MIN_COMPONENT_PX) -> tuple[DataFrame, DataFrame]:
    """Outlined change regions (``component`` is a printable name, ``label`` the component of its pixels) and their pixels.

    Each region has pixel count, ground area, box, elongation, and the type, classes and
    indices at its interior pixel; thin construction becomes a road.
    """
    height, width = F.lit(height), F.lit(width)
    sample = ["change_type", "class_b", "class_a", *[f"{n}_{s}" for s in "ba" for n in ("ndvi", "ndbi", "ndwi")]]
    changed = cut_lineage(classified.where("verified").select(*key, "prow", "pcol", *sample))
    labelled = label_components(changed, key)
    r, c = F.col("prow").cast("double"), F.col("pcol").cast("double")
    shape = labelled.groupBy(*key, "component").agg(
        F.count(F.lit(1)).alias("area_px"), F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1"),
        F.var_pop(r).alias("_vr"), F.var_pop(c).alias("_vc"), F.covar_pop(r, c).alias("_cv")).where(F.col("area_px") >= min_px)
    inside = interior_pixel(labelled, key).join(changed, [*key, "prow", "pcol"]).select(
        *key, "component", F.struct(*sample).alias("at"))
    df = shape.join(inside, [*key, "component"]).withColumns({"label": F.col("component"), "component": component_name(key, F.col("component"))})
    middle = top_lat - (F.col("r0") + F.col("r1") + 1) / 2.0 * pixel_deg
    ground = F.col("area_px") * (pixel_deg * K.M_PER_DEG) * (pixel_deg * K.M_PER_DEG * F.cos(F.radians(middle)))
    r_end, c_end = F.least(F.col("r1") + 1, height - 1), F.least(F.col("c1") + 1, width - 1)
    x, w = change.box_percent(F.col("c0"), c_end, width)
    y, h = change.box_percent(F.col("r0"), r_end, height)
    long = change.elongation(F.col("area_px"), F.col("_vr"), F.col("_vc"), F.col("_cv"))
    kind = change.refine_road(F.col("at.change_type"), long, F.col("area_px"))
    features = df.select(
        *key, "component", "label", "area_px", F.bround(ground, 1).alias("area_m2"), "r0", "c0",
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), long.alias("elongation"), kind.alias("change_type"),
        F.col("at.class_b").alias("class_b"), F.col("at.class_a").alias("class_a"),
        *[F.bround(F.col(f"at.{n}_{s}"), 3).alias(f"{n}_{s}") for s in "ba" for n in ("ndvi", "ndbi", "ndwi")],
    ).where(F.col("change_type").isin(K.MAJOR_TYPES))
    features = features.withColumn("transition_label", change.transition_label(F.col("class_b"), F.col("class_a"), F.col("change_type")))
    return cut_lineage(features), labelled  # stored once: boxes go over them several times


# unit sides around a pixel with the region on the right hand: neighbour (row, column), start and end corner (column, row)
SIDES = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]


def _next_side(ends: list, here: tuple, came: tuple | None):
    """Where two sides leave a corner, turn right: parts that touch in a corner stay apart."""
    if len(ends) == 1 or came is None:
        return ends[0]
    return max(ends, key=lambda e: came[0] * (e[1][0][1] - here[1]) - came[1] * (e[1][0][0] - here[0]))


def _chains(sides: dict, stops) -> list[list[tuple]]:
    """Sides (corner -> [(next corner, points on the way)]) chained into rings, and into open chains that
    begin and end in corners for which ``stops`` holds."""
    out = []
    order = sorted(sides, key=lambda corner: (not stops(corner), corner))
    for start in order:
        while start in sides:
            chain, here, came = [start], start, None
            while True:
                step = _next_side(sides[here], here, came)
                sides[here].remove(step)
                if not sides[here]:
                    del sides[here]
                for point in step[1]:
                    if len(chain) > 1 and _straight(chain[-2], chain[-1], point):
                        chain[-1] = point
                    else:
                        chain.append(point)
                came, here = _move(chain[-2], chain[-1]), step[0]
                if here == start or stops(here):
                    break
            out.append(chain)
    return out


def _move(a: tuple, b: tuple) -> tuple[int, int]:
    return (b[0] > a[0]) - (b[0] < a[0]), (b[1] > a[1]) - (b[1] < a[1])


def _straight(a: tuple, b: tuple, c: tuple) -> bool:
    return _move(a, b) == _move(b, c)


def _canonical(ring: list[tuple]) -> list[list[int]]:
    """A closed ring from its smallest corner on, without corners on straight lines."""
    ring = ring[:-1]
    ring = [p for i, p in enumerate(ring) if not _straight(ring[i - 1], p, ring[(i + 1) % len(ring)])]
    low = ring.index(min(ring))
    return [list(p) for p in [*ring[low:], *ring[: low + 1]]]


def outlines(labelled: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Boundary rings of every component, as corner points (column, row); the same for every block size.

    Ring 0 is the outer one; the others are holes, by their first corner. A block sees a rim of one pixel, so a
    side is drawn only where the component ends. Chains of sides stop on the lines between
    blocks; those that meet there are joined into rings, grouped by the corners they share.
    """
    types = dict(labelled.dtypes)
    names = ", ".join(f"{k} {types[k]}" for k in key)

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, component = pd.factorize(pdf["component"])
        rows, cols, own = pdf["prow"].to_numpy(), pdf["pcol"].to_numpy(), pdf["_own"].to_numpy()
        top, left = rows.min() - 1, cols.min() - 1
        grid = np.zeros((rows.max() - top + 2, cols.max() - left + 2), np.int64)
        grid[rows - top, cols - left] = codes + 1
        sides: list[dict] = [{} for _ in component]
        r, c, code = rows[own], cols[own], codes[own]
        for (dr, dc), (ax, ay), (bx, by) in SIDES:
            open_ = grid[r - top + dr, c - left + dc] != code + 1
            for row, col, which in zip(r[open_].tolist(), c[open_].tolist(), code[open_].tolist()):
                end = (col + bx, row + by)
                sides[which].setdefault((col + ax, row + ay), []).append((end, [end]))
        out = []
        for which, own_sides in enumerate(sides):
            for chain in _chains(own_sides, lambda corner: corner[0] % block == 0 or corner[1] % block == 0):
                inside = not (chain[0][0] % block == 0 or chain[0][1] % block == 0)
                out.append((component[which], inside, _canonical(chain) if inside else [list(p) for p in chain]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(out) for k in key}, "component": [x[0] for x in out], "inside": [x[1] for x in out], "points": [x[2] for x in out]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sides: dict[tuple, list] = {}
        for points in pdf["points"]:
            points = [tuple(int(v) for v in p) for p in points]
            sides.setdefault(points[0], []).append((points[-1], points[1:]))
        rings = [_canonical(chain) for chain in _chains(sides, lambda corner: False)]
        head = {k: [pdf[k].iloc[0]] * len(rings) for k in [*key, "component"]}
        return pd.DataFrame({**head, "points": rings})

    row, col = F.floor(F.col("prow") / block), F.floor(F.col("pcol") / block)
    at = lambda r, c, own: F.struct(r.alias("_br"), c.alias("_bc"), F.lit(own).alias("_own"))
    near = lambda axis, edge: F.pmod(F.col(axis), F.lit(block)) == edge
    places = F.array(at(row, col, True), F.when(near("prow", 0), at(row - 1, col, False)), F.when(near("prow", block - 1), at(row + 1, col, False)),
                     F.when(near("pcol", 0), at(row, col - 1, False)), F.when(near("pcol", block - 1), at(row, col + 1, False)))
    seen = labelled.select(*key, "prow", "pcol", "component", F.inline(F.filter(places, lambda p: p.isNotNull())))
    own_blocks = F.max(F.col("_own"))
    some = seen.groupBy(*key, "_br", "_bc").agg(own_blocks.alias("_any")).where("_any").drop("_any")  # a block of rim pixels only draws nothing
    chains = cut_lineage(seen.join(some, [*key, "_br", "_bc"]).groupBy(*key, "_br", "_bc").applyInPandas(trace, f"{names}, component {types['component']}, inside boolean, points array<array<bigint>>"))
    # chains that touch a line between blocks are grouped by the corners they share
    corner = lambda p: F.xxhash64(*[x for k in key for x in (F.col(k).isNull(), F.col(k))], "component", p[0], p[1])
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    lines = chains.where(~F.col("inside")).withColumns({"_a": corner(first), "_b": corner(last)})
    names_of = component_names(lines.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    lines = lines.withColumn("old", F.col("_a"))
    lines = lines.withColumn("_group", F.col("old")) if names_of is None else lines.join(names_of, "old", "left").withColumn("_group", F.coalesce("new", "old"))
    joined = lines.select(*key, "component", "_group", "points").groupBy(*key, "component", "_group").applyInPandas(join, f"{names}, component {types['component']}, points array<array<bigint>>")
    rings = chains.where("inside").select(*key, "component", "points").unionByName(joined)
    # holes run the other way round; the ring with the smallest corner is the outer one
    order = Window.partitionBy(*key, "component").orderBy(F.array_min("points"), F.size("points"), "points")
    return rings.withColumn("ring", F.row_number().over(order) - 1).select(*key, "component", "ring", "points")


def water_envelope(classified: DataFrame, pair: list[str], height: Column | int, width: Column | int) -> DataFrame:
    """Box around all new (or all dried) water of a pair whose water change is proven."""
    height, width = F.lit(height), F.lit(width)
    new, dry = ~wet("b") & wet("a"), wet("b") & ~wet("a")
    aggs = [F.count_if(wet("a")).alias("_a"), F.count_if(wet("b")).alias("_b")]
    for name, hit in (("new", new), ("dry", dry)):
        aggs.append(F.count_if(hit).alias(f"_n_{name}"))
        for axis in ("prow", "pcol"):
            aggs += [F.min(F.when(hit, F.col(axis))).alias(f"_lo_{axis}_{name}"), F.max(F.when(hit, F.col(axis))).alias(f"_hi_{axis}_{name}")]
    df = classified.groupBy(*pair).agg(*aggs)
    delta = F.col("_a") - F.col("_b")
    grown = (delta > 0) & (F.col("_n_new") >= K.WATER_PROOF_PX)
    shrunk = (delta < -K.WATER_PROOF_PX) & (F.col("_n_dry") >= K.WATER_PROOF_PX)
    pick = lambda stem: F.when(grown, F.col(f"{stem}_new")).otherwise(F.col(f"{stem}_dry"))
    out = df.where(grown | shrunk)
    entries = {"change_type": F.when(grown, K.WATER_EXPANSION).otherwise(K.WATER_SHRINKAGE),
               "area_m2": F.bround(pick("_n") * K.PIXEL_M2, 1)}
    for start, extent, axis, size in (("x", "w", "pcol", width), ("y", "h", "prow", height)):
        lo, hi = pick(f"_lo_{axis}"), pick(f"_hi_{axis}")
        share = lo / size * 100.0
        entries[start] = F.bround(share, 2)
        entries[extent] = F.bround(F.when(grown, F.greatest(F.lit(4), hi - lo) / size * 100.0).otherwise(
            F.least(100.0 - share, F.greatest(F.lit(6), hi - lo) / size * 100.0)), 2)
    label = F.when(grown, "Land → Water (Extension)").otherwise("Water → Land (Shrinkage)")
    return out.select(*pair, *[e.alias(n) for n, e in entries.items()], label.alias("transition_label"))


def major_boxes(features: DataFrame, water: DataFrame, pair: list[str]) -> DataFrame:
    """Boxes of at least 1000 m²; water boxes only where the pair's water change is proven."""
    df = features.join(water.select(*pair, "is_extension_proven", "is_shrinkage_proven"), pair)
    unproven = ((F.col("change_type") == K.WATER_EXPANSION) & ~F.col("is_extension_proven")) | (
        (F.col("change_type") == K.WATER_SHRINKAGE) & ~F.col("is_shrinkage_proven"))
    return df.where((F.col("area_m2") >= K.MIN_BOX_M2) & ~unproven).drop("is_extension_proven", "is_shrinkage_proven")


def archive_boxes(features: DataFrame, pair: list[str], top: int = 25) -> DataFrame:
    """Stored features shown as boxes: a known kind of change or 2000 m², largest first, top 25 per pair."""
    kinds = F.col("change_type").rlike("Construct|Road|Clear|Demo|Water")
    same = (F.col("class_b") == F.col("class_a")) & F.col("class_b").contains("Veg") & (F.col("area_m2") < K.LARGE_VEGETATION_M2)
    false_demo = F.col("change_type").contains("Demo") & F.col("class_b").rlike("Soil|Ground|Barren|Land")
    kept = features.where((F.col("change_type") != K.NO_CHANGE) & ~same & ~false_demo & (kinds | (F.col("area_m2") >= 2000.0)))
    place = Window.partitionBy(*pair).orderBy(F.col("area_m2").desc(), "component")
    return kept.withColumn("place", F.row_number().over(place).cast("bigint")).where(F.col("place") <= top)


def distinct_boxes(boxes: DataFrame, pair: list[str], window: int = 64) -> DataFrame:
    """Greedy suppression in order of area: a box overlapping a kept one by more than 0.35
    is dropped, at most 8 stay per pair.

    A pass folds over the next ``window`` boxes of each pair that no kept box suppresses,
    so a list is never longer than ``window``. Where every pair has fewer candidates, one
    pass is the whole job. Otherwise every further pass keeps at least one more box in
    each open pair, so there are at most 8.
    """
    box = F.struct((-F.col("area_m2")).alias("o"), F.col("component"), "x", "y", "w", "h")
    rest = boxes.select(*pair, box.alias("_box"))
    overlap = lambda kept, b: F.exists(kept, lambda a: change.box_iou(a, b) > K.NMS_IOU)

    def fold(start: Column) -> Column:
        return F.aggregate("_l", start, lambda acc, b: F.when((F.size(acc) >= K.MAX_BOXES) | overlap(acc, b), acc).otherwise(
            F.concat(acc, F.array(b))))

    def chosen(kept: DataFrame) -> DataFrame:
        return boxes.join(kept.select(*pair, F.inline("_k")).select(*pair, "component"), [*pair, "component"], "left_semi")

    crowded = boxes.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window)
    if crowded.isEmpty():
        listed = rest.groupBy(*pair).agg(F.sort_array(F.collect_list("_box")).alias("_l"))
        return chosen(listed.select(*pair, fold(F.slice("_l", 1, 0)).alias("_k")))

    place = Window.partitionBy(*pair).orderBy("_box")
    kept = None
    while kept is None or not rest.isEmpty():
        first = rest.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= window)
        listed = first.groupBy(*pair).agg(F.sort_array(F.collect_list("_box")).alias("_l"), F.max("_box").alias("_last"))
        if kept is None:
            done = listed.select(*pair, fold(F.slice("_l", 1, 0)).alias("_k"), "_last")
        else:
            both = kept.select(*pair, F.col("_k").alias("_before")).join(listed, pair, "left")
            done = both.select(*pair, F.when(F.col("_l").isNull(), F.col("_before")).otherwise(fold(F.col("_before"))).alias("_k"), "_last")
        kept = cut_lineage(done)
        open_pairs = kept.where((F.size("_k") < K.MAX_BOXES) & F.col("_last").isNotNull())
        rest = cut_lineage(rest.join(open_pairs, pair).where((F.col("_box") > F.col("_last")) & ~overlap(F.col("_k"), F.col("_box"))).select(*pair, "_box"))
    return chosen(kept)


def consolidated_boxes(kept: DataFrame, envelope: DataFrame, pair: list[str]) -> DataFrame:
    """At most one water box per pair, water first, then the others by area, 8 in all.

    Several water boxes become their hull with the summed area. A proven shrinkage
    envelope replaces the water box; a proven extension envelope is added where no
    expansion box exists.
    """
    is_water = F.lower(F.col("change_type")).contains("water")
    fields = ["change_type", "area_m2", "x", "y", "w", "h"]
    water = kept.where(is_water).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("change_type", F.struct(-F.col("area_m2"), F.col("component"))).alias("change_type"),
        F.sum("area_m2").alias("_area"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("_xe"), F.max(F.col("y") + F.col("h")).alias("_ye"),
        F.max("w").alias("_w"), F.max("h").alias("_h"))
    hull = lambda end, start, one: F.when(F.col("_n") == 1, F.col(one)).otherwise(
        F.bround(F.least(100.0 - F.col(start), F.col(end) - F.col(start)), 2))
    water = water.select(*pair, "change_type", F.bround("_area", 1).alias("area_m2"), "x", "y", hull("_xe", "x", "_w").alias("w"),
                         hull("_ye", "y", "_h").alias("h"), F.lit(1).alias("_class"))
    env = envelope.select(*pair, *fields)
    shrinking = env.where(F.col("change_type") == K.WATER_SHRINKAGE)
    growing = env.where(F.col("change_type") == K.WATER_EXPANSION)
    has_growth = water.where(F.col("change_type") == K.WATER_EXPANSION).select(*pair)
    extra = growing.join(has_growth, pair, "left_anti").unionByName(shrinking).withColumn("_class", F.lit(0))
    water = water.join(shrinking.select(*pair), pair, "left_anti")
    others = kept.where(~is_water).select(*pair, *fields, F.lit(2).alias("_class"), "component")
    everything = others.unionByName(water.withColumn("component", F.lit(""))).unionByName(extra.withColumn("component", F.lit("")))
    order = Window.partitionBy(*pair).orderBy("_class", F.col("area_m2").desc(), "component")
    return everything.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= K.MAX_BOXES).select(*pair, "place", *fields)


def temporal_regions(feature_pixels: DataFrame, site: list[str], pixel_deg: float, top_lat: Column) -> DataFrame:
    """Union of all pairs' regions per site and change type, with the earliest supporting date.

    ``feature_pixels`` has site, change_type, prow, pcol and date_after. The earliest date
    is kept per pixel first (one partial aggregation); a region then looks at its own
    pixels and at the corner neighbours of the same type, because regions that share only
    a corner stay apart but still touch.
    """
    key = [*site, "change_type"]
    dated = cut_lineage(feature_pixels.groupBy(*key, "prow", "pcol").agg(F.min("date_after").alias("date_after")))
    labelled = label_components(dated, key)
    corners = F.array(*[F.struct(F.lit(a).cast("bigint").alias("dr"), F.lit(b).cast("bigint").alias("dc")) for a in (-1, 1) for b in (-1, 1)])
    touching = dated.select(*key, "prow", "pcol", "date_after", F.inline(corners)).select(
        *key, (F.col("prow") + F.col("dr")).alias("prow"), (F.col("pcol") + F.col("dc")).alias("pcol"), "date_after")
    reach = dated.unionByName(touching).groupBy(*key, "prow", "pcol").agg(F.min("date_after").alias("date_after"))
    middle = top_lat - (F.min("prow") + F.max("prow") + 1) / 2.0 * pixel_deg
    ground = F.count(F.lit(1)) * (pixel_deg * K.M_PER_DEG) * (pixel_deg * K.M_PER_DEG * F.cos(F.radians(middle)))
    return labelled.join(reach, [*key, "prow", "pcol"]).groupBy(*key, "component").agg(
        F.count(F.lit(1)).alias("area_px"), F.bround(ground, 1).alias("area_m2"), F.min("date_after").alias("earliest_supported_date"))


def region_breakdown(regions: DataFrame, site: list[str]) -> DataFrame:
    """Share of the changed area per type, and the site's total."""
    per_type = regions.groupBy(*site, "change_type").agg(F.sum("area_m2").alias("area_m2"), F.count(F.lit(1)).alias("regions"))
    total = per_type.groupBy(*site).agg(F.sum("area_m2").alias("_total"))
    return per_type.join(total, site).select(
        *site, "change_type", "regions", F.bround("area_m2", 1).alias("area_m2"),
        F.bround(F.col("area_m2") / F.col("_total") * 100.0, 1).alias("percent"), F.bround("_total", 1).alias("total_area_m2"))


def site_summary(regions: DataFrame, site: list[str]) -> DataFrame:
    """Regions, earliest date, total area and the type with the largest area."""
    per_type = regions.groupBy(*site, "change_type").agg(
        F.sum("area_m2").alias("area"), F.count(F.lit(1)).alias("n"), F.min("earliest_supported_date").alias("first"))
    real = F.col("change_type") != K.NO_CHANGE
    return per_type.groupBy(*site).agg(
        F.sum("n").alias("regions"), F.min(F.when(real, F.col("first"))).alias("earliest_date"), F.bround(F.sum("area"), 1).alias("total_area_m2"),
        F.min_by(F.when(real, F.col("change_type")), F.when(real, F.struct(-F.col("area"), F.col("change_type")))).alias("dominant_type"))
