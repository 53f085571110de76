"""Bitemporal pixel work: joining two dates, classifying change, pair reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import change, spectral

BANDS = ["blue", "green", "red", "nir", "swir"]


def join_dates(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels present on both dates (the common extent)."""
    return before.join(after, keys, "inner")


def join_next_date(pixels: DataFrame, keys: list[str], step: str, values: list[str]) -> DataFrame:
    """Every pixel row (``value``_b) beside each row of the same pixel one step later (``value``_a), as a join of the
    table with itself on the keys and the next step. Rows are shuffled once, not once for each side."""
    later = F.collect_list(F.struct(*[F.col(v).alias(f"{v}_a") for v in values]))
    following = Window.partitionBy(*keys).orderBy(step).rangeBetween(1, 1)
    given = pixels.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in (*keys, step)]))
    paired = given.select(*keys, step, *values, later.over(following).alias("_later"))
    return paired.select(*keys, step, *[F.col(v).alias(f"{v}_b") for v in values], F.inline("_later"))


def attach_mask(pixels: DataFrame, mask: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Bad-pixel flag from a sparse mask table; a pixel without a mask row is clear."""
    marked = mask.select(*keys, F.col(flag))
    return pixels.join(marked, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def sanitize_mask(pixels: DataFrame, scene: list[str], bad: str, blue: str, red: str) -> DataFrame:
    """Bright dry ground is often taken for cloud. Where more than half of a scene is
    marked and the marked part is not bright in blue, keep only truly bright pixels."""
    marked = F.col(bad)
    stats = pixels.groupBy(*scene).agg(
        F.avg(marked.cast("double")).alias("_share"),
        F.avg(F.when(marked, F.col(blue))).alias("_mean_blue"),
    )
    suspicious = (F.col("_share") > 0.50) & (F.col("_mean_blue") < 0.30)
    kept = marked & (F.col(blue) > 0.35) & (F.col(red) > 0.30)
    return (
        pixels.join(stats, scene)
        .withColumn(bad, F.when(F.coalesce(suspicious, F.lit(False)), kept).otherwise(marked))
        .drop("_share", "_mean_blue")
    )


def usable() -> Column:
    return ~(F.col("bad_b") | F.col("bad_a"))


def settle(df: DataFrame, derived: list[str]) -> DataFrame:
    """Keep later filters on costly derived columns above the projection that computes them.

    Catalyst pushes a filter through a projection by copying the whole expression into
    it, which for rule chains over rule chains outgrows the 64 KB limit of generated
    code. A generator over a one-element array is a step it does not push through; it
    stays inside code generation.
    """
    kept = [c for c in df.columns if c not in derived]
    return df.select(*kept, F.inline(F.array(F.struct(*derived))))


def classify(pixels: DataFrame, model: str | None = None) -> DataFrame:
    """Indices and classes of both dates, change candidate, verified change, change type.

    One narrow chain of projections: no shuffle, all inside code generation.
    """
    df = spectral.with_indices(spectral.with_indices(pixels, "b"), "a")
    df = spectral.with_land_cover(spectral.with_land_cover(df, "b"), "a").drop("class_b", "class_a")
    delta = lambda name: F.col(f"{name}_a") - F.col(f"{name}_b")
    found = change.candidate(delta("ndvi"), delta("ndbi"), delta("ndwi"), usable(), F.col(model) if model else None)
    df = settle(df.withColumn("candidate", found), ["code_b", "code_a", "candidate"])
    codes = F.col("code_b"), F.col("code_a")
    major = change.by_code(lambda b, a: change.is_real_change(b, a) and change.change_type_of(b, a) in K.MAJOR_TYPES, *codes)
    return df.withColumns({
        "class_b": spectral.class_name(codes[0]), "class_a": spectral.class_name(codes[1]),
        "real": change.by_code(change.is_real_change, *codes), "change_type": change.by_code(change.change_type_of, *codes),
        "verified": F.col("candidate") & major,
    })


def change_by_site(classified: DataFrame, site: list[str]) -> DataFrame:
    """Pixels and share of each major change type per site.

    One shuffle of pre-aggregated rows; the site total is a window over the few rows per
    site that are left after it.
    """
    per_type = classified.groupBy(*site, F.when(F.col("verified"), F.col("change_type")).alias("change_type")).agg(
        F.count(F.lit(1)).alias("pixels")
    )
    df = per_type.withColumn("total_pixels", F.sum("pixels").over(Window.partitionBy(*site)))
    return df.where(F.col("change_type").isNotNull()).withColumn("percent", F.bround(F.col("pixels") / F.col("total_pixels") * 100.0, 2))


def filter_statistics(classified: DataFrame, pair: list[str]) -> DataFrame:
    """Candidates, rejected, verified and the rejection ratio; then the same after the
    restriction to major change types."""
    kept = F.col("candidate") & F.col("real")
    df = classified.groupBy(*pair).agg(
        F.count_if(F.col("candidate")).alias("candidate_changes"),
        F.count_if(kept).alias("semantic_changes"),
        F.count_if(F.col("verified")).alias("verified_changes"),
    )
    rejected = F.col("candidate_changes") - F.col("semantic_changes")
    return df.select(
        *pair, "candidate_changes", "semantic_changes", "verified_changes",
        (F.col("candidate_changes") - F.col("verified_changes")).alias("false_positives_rejected"),
        F.when(F.col("candidate_changes") > 0, F.bround(rejected / F.col("candidate_changes"), 4))
        .otherwise(F.lit(0.0)).alias("rejection_ratio"),
    )


def spectral_profile(classified: DataFrame, pair: list[str]) -> DataFrame:
    """Mean indices over the changed pixels before, after and their difference."""
    names = ["ndvi", "ndbi", "ndwi"]
    means = classified.groupBy(*pair).agg(*[
        F.coalesce(F.bround(F.avg(F.when(F.col("verified"), F.col(f"{n}_{s}"))), 3), F.lit(0.0)).alias(f"{n}_{s}")
        for s in ("b", "a") for n in names
    ])
    return means.withColumns({f"delta_{n}": F.bround(F.col(f"{n}_a") - F.col(f"{n}_b"), 3) for n in names})


def wet(side: str) -> Column:
    return (F.col(f"ndvi_{side}") < 0.0) | (F.col(f"code_{side}") == K.CLASS_CODES.index(K.WATER))


def water_extent(classified: DataFrame, pair: list[str]) -> DataFrame:
    """Water area on both dates, whether a change of it is proven, and the sentence."""
    counts = classified.groupBy(*pair).agg(
        F.count_if(wet("b")).alias("before_pixels"),
        F.count_if(wet("a")).alias("after_pixels"),
        F.count_if(~wet("b") & wet("a")).alias("new_water_pixels"),
        F.count_if(wet("b") & ~wet("a")).alias("dried_pixels"),
    ).withColumn("delta_pixels", F.col("after_pixels") - F.col("before_pixels"))
    delta = F.col("delta_pixels")
    grown = (delta > 0) & (F.col("new_water_pixels") >= K.WATER_PROOF_PX)
    shrunk = delta < -K.WATER_PROOF_PX
    # hectares print as in Python: no trailing zeros beyond the first decimal
    hectares = (F.bround(delta * 100 / 10000.0, 2)).cast("string")
    before, after = F.format_string("%,d", "before_pixels"), F.format_string("%,d", "after_pixels")
    proof = (
        F.when(grown, F.concat(F.lit("Water Extent Expansion Verified: +"), delta.cast("string"), F.lit(" blue pixels (+"),
                               hectares, F.lit(" ha). Before: "), before, F.lit(" px → After: "), after,
                               F.lit(f" px (>{K.WATER_PROOF_PX} px proof threshold).")))
        .when(shrunk, F.concat(F.lit("Water Extent Shrinkage: "), delta.cast("string"), F.lit(" blue pixels ("), hectares,
                               F.lit(" ha). Before: "), before, F.lit(" px → After: "), after, F.lit(" px.")))
        .otherwise(F.concat(F.lit("Water Extent Stable / Unchanged: Δ "), F.format_string("%+d", delta),
                            F.lit(" px (Baseline: "), before, F.lit(" px vs After: "), after,
                            F.lit(f" px; below {K.WATER_PROOF_PX} px threshold).")))
    )
    return counts.withColumns({
        "is_extension_proven": grown,
        "is_shrinkage_proven": shrunk,
        "status": F.when(grown, "Extended").when(shrunk, "Shrunk").otherwise("Stable"),
        "proof": proof,
    })


def pair_report(pixels: DataFrame, pair: list[str], bands: list[str], threshold: float = K.REFLECTANCE_DIFF,
                min_usable: float = K.MIN_USABLE) -> DataFrame:
    """Pixel-level change report of a pair over its usable ground."""
    distance = change.band_distance([(F.col(f"{b}_b"), F.col(f"{b}_a")) for b in bands])
    df = pixels.select(*pair, usable().alias("_ok"), distance.alias("_distance"))
    agg = df.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("total_pixels"),
        F.count_if(F.col("_ok")).alias("evaluated_pixels"),
        F.count_if(F.col("_ok") & (F.col("_distance") > threshold)).alias("_changed"),
        F.avg(F.when(F.col("_ok"), F.col("_distance"))).alias("_mean"),
    )
    valid = F.col("evaluated_pixels") / F.col("total_pixels")
    ok = valid >= min_usable
    if_ok = lambda value, other: F.when(ok, value).otherwise(other)
    return agg.select(
        *pair, "total_pixels", "evaluated_pixels",
        F.when(ok, "ok").otherwise("insufficient_coverage").alias("status"),
        F.bround(valid, 4).alias("valid_fraction"),
        F.bround((1.0 - valid) * 100.0, 2).alias("cloud_unusable_pct"),
        if_ok(F.bround(change.pair_confidence(valid), 4), F.lit(0.0)).alias("confidence"),
        if_ok(F.bround(F.col("_changed") / F.col("evaluated_pixels") * 100.0, 2), F.lit(0.0)).alias("change_percentage"),
        if_ok(F.col("_changed"), F.lit(0)).cast("bigint").alias("change_pixel_count"),
        if_ok(F.bround(F.col("_mean"), 4), F.lit(None)).alias("mean_spectral_diff"),
    )


def epoch_difference(pixels: DataFrame, pair: list[str], bands: list[str], threshold: float = K.EPOCH_DIFF) -> DataFrame:
    """Share of pixels whose display values moved by more than the threshold."""
    distance = change.band_distance([(F.col(f"{b}_b"), F.col(f"{b}_a")) for b in bands])
    return pixels.groupBy(*pair).agg(
        F.count_if(distance > threshold).alias("change_pixels"), F.count(F.lit(1)).alias("total_pixels")
    ).withColumn("change_percentage", F.bround(F.col("change_pixels") / F.col("total_pixels") * 100.0, 2))


def class_histogram(classified: DataFrame, features: DataFrame, pair: list[str]) -> DataFrame:
    """Top class before and after over changed pixels and their outlined features.

    ``features`` has class_b and class_a per outlined region. Counting happens per
    class first, so a pair of any size shrinks to a few rows before it is compared.
    """
    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*pair, F.col(f"class_{side}").alias("class")).agg(F.count(F.lit(1)).alias("n"))

    changed = classified.where(F.col("verified"))
    result = None
    for side, name in (("b", "before"), ("a", "after")):
        both = counted(changed, side).unionByName(counted(features, side))
        clear = ~F.lower(F.col("class")).contains("transitional") & ~F.lower(F.col("class")).contains("unclass")
        total = both.where(clear).groupBy(*pair, "class").agg(F.sum("n").alias("n"))
        # most frequent first, then by name, so the answer does not depend on row order
        top = total.groupBy(*pair).agg(
            F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias(f"top_{name}"),
            F.sum("n").alias(f"{name}_total"),
        )
        result = top if result is None else result.join(top, pair, "full_outer")
    return result
