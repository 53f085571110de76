"""Rules that turn two land-cover classes into a change type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import clip, contains_any


def candidate(d_ndvi: Column, d_ndbi: Column, d_ndwi: Column, usable: Column, model: Column | None = None) -> Column:
    """Change-vector candidate, joined with an external model's mask, on usable ground."""
    spectral = (F.abs(d_ndvi) > K.CVA_NDVI) | (F.abs(d_ndbi) > K.CVA_NDBI) | (F.abs(d_ndwi) > K.CVA_NDWI)
    if model is not None:
        spectral = spectral | model
    return spectral & usable


def band_distance(pairs: list[tuple[Column, Column]]) -> Column:
    total = None
    for before, after in pairs:
        square = (after - before) * (after - before)
        total = square if total is None else total + square
    return F.sqrt(total)


def is_real_change(before: str, after: str) -> bool:
    """A class pair that is a surface change rather than noise or season."""
    pair = {before, after}
    if before == after or pair <= set(K.VEGETATION_NAMES) or pair <= set(K.UNCLASSIFIED_NAMES):
        return False
    return not (K.CONFUSION in pair and pair - {K.CONFUSION} <= set(K.SOIL_NAMES))


def change_type_of(before: str, after: str) -> str:
    """Change type of a pixel whose class moved from ``before`` to ``after``."""
    if not is_real_change(before, after):
        return K.NO_CHANGE
    if K.WATER in (before, after):
        return K.WATER_EXPANSION if after == K.WATER else K.WATER_SHRINKAGE
    land = set(K.VEGETATION_NAMES + K.SOIL_NAMES + [K.CONFUSION])
    if after in K.BUILT_NAMES and before in land:
        return K.CONSTRUCTION
    if before in K.BUILT_NAMES and after in K.SOIL_NAMES:
        return K.DEMOLITION
    if before == K.DENSE_VEGETATION and after in K.SOIL_NAMES + [K.CONFUSION]:
        return K.CLEARANCE
    return K.NO_CHANGE


def by_code(rule, before_code: Column, after_code: Column) -> Column:
    """Look a class-pair rule up by the two class codes.

    The rule is evaluated once per pair of classes when the plan is built. The column is
    a constant array and integer arithmetic, and refers to each code once. A chain of
    string comparisons would repeat the class expression dozens of times as soon as
    Catalyst pushes a filter on the result below the projections.
    """
    values = [rule(b, a) for b in K.CLASS_CODES for a in K.CLASS_CODES]
    return F.try_element_at(F.expr(f"array({', '.join(_literal(v) for v in values)})"),
                        before_code * len(K.CLASS_CODES) + after_code + 1)


def by_name(rule, before: Column, after: Column) -> Column:
    """The same rule for class names, with the older spellings of the names."""
    names = list(dict.fromkeys(K.CLASS_CODES + K.VEGETATION_NAMES + K.SOIL_NAMES + K.BUILT_NAMES + K.UNCLASSIFIED_NAMES))
    entries = ", ".join(f"{_literal(b + '>' + a)}, {_literal(rule(b, a))}" for b in names for a in names)
    return F.try_element_at(F.expr(f"map({entries})"), F.concat(before, F.lit(">"), after))


def _literal(value) -> str:
    return str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


def semantic_change(before: Column, after: Column) -> Column:
    return by_name(is_real_change, before, after)


def pixel_change_type(before: Column, after: Column) -> Column:
    return by_name(change_type_of, before, after)


def region_change_type(before: Column, after: Column, area_m2: Column) -> Column:
    """Transition of a whole region, where its ground area decides the doubtful cases."""
    veg_b, veg_a = before.isin(K.VEGETATION_NAMES), after.isin(K.VEGETATION_NAMES)
    soil_b, soil_a = before.isin(K.SOIL_NAMES), after.isin(K.SOIL_NAMES)
    built_b, built_a = before.isin(K.BUILT_NAMES), after.isin(K.BUILT_NAMES)
    conf_b, conf_a = before.contains("Confusion"), after.contains("Confusion")
    unclear_b, unclear_a = before.isin(K.UNCLASSIFIED_NAMES), after.isin(K.UNCLASSIFIED_NAMES)
    small = area_m2 < K.SMALL_CONFUSION_M2
    return (
        F.when(before == after, K.NO_CHANGE)
        .when(veg_b & veg_a & (area_m2 >= K.LARGE_VEGETATION_M2), K.VEGETATION_SHIFT)
        .when(veg_b & veg_a, K.NO_CHANGE)
        .when(conf_b & (conf_a | soil_a), K.NO_CHANGE)
        .when(soil_b & (conf_a | veg_a), K.NO_CHANGE)
        .when(conf_b & built_a & small, K.NO_CHANGE)
        .when(built_b & conf_a, K.NO_CHANGE)
        .when((unclear_b & (veg_a | unclear_a)) | (veg_b & unclear_a), K.NO_CHANGE)
        .when((veg_b | soil_b | conf_b) & built_a, K.CONSTRUCTION)
        .when((before == K.DENSE_VEGETATION) & (soil_a | conf_a), K.CLEARANCE)
        .when(veg_b & soil_a & (area_m2 >= K.LARGE_CLEARANCE_M2), K.CLEARANCE)
        .when(veg_b & soil_a, K.NO_CHANGE)
        .when(before == K.WATER, K.WATER_SHRINKAGE)
        .when(after == K.WATER, K.WATER_EXPANSION)
        .when(built_b & soil_a, K.DEMOLITION)
        .when(built_a & ~built_b, K.CONSTRUCTION)
        .otherwise(K.NO_CHANGE)
    )


def refine_road(change_type: Column, elongation: Column, area_px: Column) -> Column:
    """Long, thin construction is a road."""
    thin = (elongation >= K.ROAD_ELONGATION) & (area_px >= K.MIN_COMPONENT_PX)
    return F.when(change_type.isin(K.CONSTRUCTION, K.UNCLASSIFIED_CHANGE) & thin, K.ROAD).otherwise(change_type)


def elongation(n: Column, var_row: Column, var_col: Column, covar: Column) -> Column:
    """Axis ratio of the ellipse with the same second moments as the pixel set.

    Each pixel is a unit square, hence the 1/12 on both variances.
    """
    a, b = var_row + F.lit(1.0 / 12.0), var_col + F.lit(1.0 / 12.0)
    spread = F.sqrt((a - b) * (a - b) + F.lit(4.0) * covar * covar)
    return F.sqrt((a + b + spread) / (a + b - spread))


def transition_label(before: Column, after: Column, change_type: Column) -> Column:
    from_plants = before.contains("Vegetation")
    kind = F.lower(change_type)
    ground = ["Soil", "Barren", "Land"]
    short_b = F.when(from_plants, "Vegetation").when(contains_any(before, ground), "Ground").otherwise(before)
    short_a = (
        F.when(after.contains("Vegetation"), "Vegetation")
        .when(contains_any(after, ground), "Ground")
        .when(after.contains("Built"), "Built-up")
        .otherwise(after)
    )
    origin = F.when(from_plants, "Vegetation").otherwise("Ground")
    return (
        F.when(change_type == K.ROAD, F.concat(origin, F.lit(" → Road")))
        .when(change_type == K.CONSTRUCTION, F.concat(origin, F.lit(" → Built-up")))
        .when(change_type == K.CLEARANCE, "Vegetation → Ground")
        .when(kind.contains("expansion") | kind.contains("extension"), "Land → Water (Extension)")
        .when(kind.contains("shrinkage"), "Water → Land (Shrinkage)")
        .when(change_type == K.DEMOLITION, "Built-up → Ground")
        .when(change_type == K.VEGETATION_SHIFT, K.VEGETATION_SHIFT)
        .otherwise(F.concat(short_b, F.lit(" → "), short_a))
    )


def display_transition(before: Column, after: Column) -> Column:
    """Sentence shown beside a class pair."""
    has = lambda col, *words: contains_any(col, list(words))
    arrow = F.concat(before, F.lit(" → "), after)
    wrap = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    return (
        F.when(before == after, wrap("Stable Surface: ", before, " (Unchanged)"))
        .when(has(before, "Water") & has(after, "Water"), "Stable Surface: Water Body (Unchanged)")
        .when(has(before, "Vegetation") & has(after, "Vegetation"), wrap("🌱 Seasonal Phenology (", arrow, ")"))
        .when(has(before, "Confusion") | has(after, "Confusion"), wrap("⚠️ ", arrow, " (Spectral Ambiguity)"))
        .when(has(before, "Water"), wrap("💧 Water Shrinkage (Water → ", after, ")"))
        .when(has(after, "Water"), wrap("💧 Water Expansion (", before, " → Water)"))
        .when(has(before, "Vegetation", "Bare Soil", "Land") & has(after, "Built-up"),
              wrap("🏗️ Construction (", before, " → Built-up)"))
        .when(has(before, "Vegetation") & has(after, "Bare Soil", "Land"), wrap("🪓 Land Clearance (", arrow, ")"))
        .when(has(before, "Bare Soil", "Land") & has(after, "Vegetation"), wrap("🌱 Vegetation Growth (", arrow, ")"))
        .when(has(before, "Built-up") & has(after, "Vegetation", "Bare Soil", "Land"),
              wrap("🏚️ Demolition / Reversion (Built-up → ", after, ")"))
        .otherwise(arrow)
    )


def pair_confidence(valid_fraction: Column) -> Column:
    return clip(valid_fraction * 0.95, 0.1, 0.99)


def box_percent(low: Column, high: Column, size: Column, least: int = 4) -> tuple[Column, Column]:
    """Start and extent of a pixel span in percent of the image side."""
    start = F.bround(low / size * 100.0, 2)
    extent = F.bround(F.greatest(high - low, F.lit(least)) / size * 100.0, 2)
    return start, extent


def box_style(change_type: Column, transition: Column) -> dict[str, Column]:
    """Display colour and short label of a change box."""
    water = change_type.contains("Water") | transition.contains("Water")
    rules = [
        (change_type.contains("Road") | transition.contains("Road"), "#a855f7", F.lit("Vegetation → Road")),
        (change_type.contains("Clearance") | (transition.contains("Ground") & ~transition.contains("Built-up")),
         "#fde047", F.lit("Vegetation → Ground")),
        (water, "#38bdf8", F.when(transition.contains("Shrink"), "Water → Land").otherwise("Land → Water")),
        (change_type.contains("Demolition") | transition.contains("Demolition"), "#fb923c", F.lit("Built-up → Ground")),
        (change_type.contains("Vegetation") & change_type.contains("Shift"), "#10b981", F.lit("Vegetation Shift")),
        (change_type.contains("Unclassified"), "#6366f1", F.lit("Unclassified")),
    ]
    color, short = None, None
    for hit, hue, text in rules:
        color = F.when(hit, hue) if color is None else color.when(hit, hue)
        short = F.when(hit, text) if short is None else short.when(hit, text)
    return {"color": color.otherwise("#ef4444"), "short_type": short.otherwise("Vegetation → Built-up")}


def box_iou(first: Column, second: Column) -> Column:
    """Overlap of two percent boxes, structs with x, y, w, h."""
    width = F.least(first["x"] + first["w"], second["x"] + second["w"]) - F.greatest(first["x"], second["x"])
    height = F.least(first["y"] + first["h"], second["y"] + second["h"]) - F.greatest(first["y"], second["y"])
    inner = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    outer = first["w"] * first["h"] + second["w"] * second["h"] - inner
    return F.when((inner <= 0) | (outer <= 0), F.lit(0.0)).otherwise(inner / outer)


def is_false_demolition(change_type: Column, transition: Column, before: Column, ndvi: Column, ndbi: Column) -> Column:
    """A demolition on ground that was never built up (archive form)."""
    demolition = change_type.contains("Demo") | transition.contains("Built-up → Ground")
    bare = contains_any(before, ["Soil", "Ground", "Barren", "Land"])
    weak = F.coalesce((ndbi < 0.10) | F.coalesce(ndvi >= ndbi, F.lit(False)), F.lit(False))
    return demolition & (bare | weak)


def is_false_box(change_type: Column, transition: Column, before: Column, after: Column,
                 ndvi_b: Column, ndbi_b: Column, ndwi_a: Column) -> Column:
    """Display form: the archive rule made stricter, and water taken for construction."""
    kind, label = F.lower(change_type), F.lower(transition)
    bare = contains_any(F.lower(before), ["soil", "ground", "barren", "land"])
    weak = F.coalesce(ndvi_b >= 0.10, F.lit(False)) | F.coalesce(ndbi_b < 0.10, F.lit(False)) \
        | F.coalesce(ndvi_b >= ndbi_b, F.lit(False))
    demolition = (kind.contains("demo") | label.contains("built-up → ground")) & (bare | weak)
    building = contains_any(kind, ["construct", "road"]) | contains_any(label, ["built-up", "road"])
    wet = F.lower(after).contains("water") | F.coalesce(ndwi_a > 0.15, F.lit(False))
    return demolition | (building & wet)
