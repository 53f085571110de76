"""Statistics over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import spectral
from . import quantiles
from ..functions.numeric import clip


def tile_summary(pixels: DataFrame, tile: list[str], bands: list[str], bad: str = "bad") -> DataFrame:
    """Cloud share, quality, mean indices and band ranges per tile in one aggregation.

    Means run over valid pixels; a tile without any uses the pixels that are not
    sentinels, and a tile without those uses all of them.
    """
    cols = [F.col(b) for b in bands]
    loose_bad = None
    for band in cols:
        flag = F.isnan(band) | (band < -9000)
        loose_bad = flag if loose_bad is None else loose_bad | flag
    idx = spectral.archive_indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir"))
    df = pixels.select(*tile, *bands, F.col(bad).alias("_bad"), *[e.alias(f"_{n}") for n, e in idx.items()],
                       (~(F.col(bad) | spectral.nodata_pixel(cols))).alias("_valid"), (~loose_bad).alias("_loose"))
    aggs = [F.avg(F.col("_bad").cast("double")).alias("_cloud"), F.count_if("_valid").alias("_nv"), F.count_if("_loose").alias("_nl")]
    modes = {"v": F.col("_valid"), "l": F.col("_loose"), "a": F.lit(True)}
    for mode, keep in modes.items():
        for n in idx:
            aggs.append(F.avg(F.when(keep, F.col(f"_{n}"))).alias(f"_{n}_{mode}"))
        for b in bands:
            value = F.when(keep & ~F.isnan(b) & (F.col(b) > -9000), F.col(b))
            aggs += [F.min(value).alias(f"_min_{b}_{mode}"), F.max(value).alias(f"_max_{b}_{mode}"), F.avg(value).alias(f"_mean_{b}_{mode}")]
    pick = lambda name: F.when(F.col("_nv") > 0, F.col(f"_{name}_v")).when(F.col("_nl") > 0, F.col(f"_{name}_l")).otherwise(F.col(f"_{name}_a"))
    grouped = df.groupBy(*tile).agg(*aggs)
    return grouped.select(
        *tile, F.bround("_cloud", 4).alias("cloud_pct"), F.bround(clip(1.0 - F.col("_cloud"), 0.0, 1.0), 4).alias("quality_confidence"),
        *[clip(pick(n), -1.0, 1.0).alias(f"mean_{n}") for n in idx],
        *[F.coalesce(F.bround(pick(f"{stat}_{b}"), 2), F.lit(0.0)).alias(f"{b}_{stat}") for b in bands for stat in ("min", "max", "mean")],
    )


def canvas_quality(pixels: DataFrame, scene: list[str], bad: Column) -> DataFrame:
    share = F.bround(F.avg(bad.cast("double")), 4)
    return pixels.groupBy(*scene).agg(share.alias("cloud_fraction")).withColumn(
        "valid_fraction", F.bround(1.0 - F.col("cloud_fraction"), 4))


def band_statistics(pixels: DataFrame, scene: list[str], bands: list[str], nodata: float | None, exact: bool = False) -> DataFrame:
    """Per-band statistics: all bands in one pass, turned to rows only after aggregation.

    Percentiles come from a sketch (see ``quantiles``). ``exact`` ones keep one counter per distinct
    sample value, which for digital numbers is at most 65,536 per scene and band.
    """
    shares = [0.01, 0.5, 0.99]
    aggs, entries = [F.count(F.lit(1)).alias("_n")], []
    any_bad = None
    for b in bands:
        bad = F.isnan(b) | (F.abs(F.col(b)) == float("inf"))
        if nodata is not None:
            bad = bad | (F.abs(F.col(b) - nodata) <= 1e-8 + 1e-5 * abs(nodata))
        any_bad = bad if any_bad is None else any_bad | bad
        value = F.when(~bad, F.col(b))
        aggs += [F.count(value).alias(f"_c_{b}"), F.min(value).alias(f"_lo_{b}"), F.max(value).alias(f"_hi_{b}"), F.avg(value).alias(f"_m_{b}"),
                 F.stddev_pop(value).alias(f"_s_{b}"), quantiles.state(value, shares, exact).alias(f"_p_{b}")]
        r4 = lambda e: F.coalesce(F.bround(e, 4), F.lit(0.0))
        entries.append(F.struct(
            F.lit(b).alias("band"), F.col(f"_c_{b}").alias("valid_pixels"), (F.col("_n") - F.col(f"_c_{b}")).alias("nodata_pixels"),
            r4(F.col(f"_lo_{b}")).alias("min"), r4(F.col(f"_hi_{b}")).alias("max"), r4(F.col(f"_m_{b}")).alias("mean"), r4(F.col(f"_s_{b}")).alias("std"),
            *[r4(F.element_at(quantiles.read(F.col(f"_p_{b}"), F.col(f"_c_{b}"), shares, exact), i + 1)).alias(p) for i, p in enumerate(("p1", "p50", "p99"))]))
    aggs.append(F.count_if(any_bad).alias("_any"))
    grouped = pixels.groupBy(*scene).agg(*aggs)
    return grouped.select(*scene, F.bround(F.col("_any") / F.col("_n") * 100.0, 4).alias("overall_nodata_pct"), F.inline(F.array(*entries)))


def mask_statistics(pixels: DataFrame, scene: list[str], mask: Column) -> DataFrame:
    return pixels.groupBy(*scene).agg(F.count_if(mask).alias("masked"), F.count_if(~mask).alias("clear_ground")).withColumn(
        "masked_pct", F.bround(F.col("masked") / (F.col("masked") + F.col("clear_ground")) * 100.0, 4))


def cut_points(pixels: DataFrame, scene: list[str], bands: list[str], bad: str, low: float = 0.02, high: float = 0.98,
               exact: bool = False) -> DataFrame:
    """Stretch limits per scene and band over valid pixels; over all pixels when fewer than 2 % are valid. From a sketch, or ``exact``."""
    finite = lambda b: ~F.isnan(b) & (F.abs(F.col(b)) != float("inf"))
    shares = [low, high]
    aggs = [F.avg((~F.col(bad)).cast("double")).alias("_valid")]
    for b in bands:
        for name, value in (("v", F.when(~F.col(bad) & finite(b), F.col(b))), ("a", F.when(finite(b), F.col(b)))):
            aggs += [quantiles.state(value, shares, exact).alias(f"_{name}_{b}"), F.count(value).alias(f"_n{name}_{b}")]
        aggs += [F.max(F.when(finite(b), F.col(b))).alias(f"_top_{b}")]
    grouped = pixels.groupBy(*scene).agg(*aggs)
    rows = []
    for b in bands:
        whole, valid = (quantiles.read(F.col(f"_{name}_{b}"), F.col(f"_n{name}_{b}"), shares, exact) for name in "av")
        chosen = F.when(F.col("_valid") < 0.02, whole).otherwise(valid)
        vmin = F.coalesce(F.element_at(chosen, 1).cast("double"), F.lit(0.0))
        vmax = F.coalesce(F.element_at(chosen, 2).cast("double"), F.when(F.col(f"_top_{b}") > 1.5, 3000.0).otherwise(0.3))
        flat = vmin + F.when(vmin > 1.5, 1.0).otherwise(0.01)
        rows.append(F.struct(F.lit(b).alias("band"), vmin.alias("vmin"), F.when(vmax <= vmin, flat).otherwise(vmax).alias("vmax")))
    return grouped.select(*scene, F.inline(F.array(*rows)))


def code_shares(pixels: DataFrame, scene: list[str], code: Column, names: dict[str, int]) -> DataFrame:
    """Percentage of pixels per code."""
    return pixels.groupBy(*scene).agg(
        F.count(F.lit(1)).alias("total_pixels"),
        *[F.bround(F.count_if(code == value) / F.count(F.lit(1)) * 100.0, 2).alias(name) for name, value in names.items()])


def cloud_radiance(pixels: DataFrame, scene: list[str], thick: Column, exact: bool = False) -> DataFrame:
    """Brightness of opaque cloud per colour: 90th percentile of thick pixels, else white. From a sketch, or ``exact``."""
    states = [quantiles.state(F.when(thick, F.col(b)), [0.9], exact).alias(f"_{b}") for b in K.DEFAULT_RADIANCE]
    counts = [F.count(F.when(thick, F.col(b))).alias(f"_n_{b}") for b in K.DEFAULT_RADIANCE]
    grouped = pixels.groupBy(*scene).agg(*states, *counts)
    return grouped.select(*scene, *[F.coalesce(F.element_at(quantiles.read(F.col(f"_{b}"), F.col(f"_n_{b}"), [0.9], exact), 1), F.lit(value).cast("double")).alias(f"{b}_cloud")
                                    for b, value in K.DEFAULT_RADIANCE.items()])


def preservation(pixels: DataFrame, scene: list[str], clear: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """How far clear pixels were altered: mean, root mean square and largest difference."""
    diffs = F.array(*[F.abs(F.col(after) - F.col(before)) for before, after in pairs])
    total = F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x * x)
    moved = F.size(F.filter(diffs, lambda x: x > K.CLEAR_TOLERANCE))
    n = F.lit(len(pairs))
    grouped = pixels.groupBy(*scene).agg(
        F.count_if(clear).alias("clear_pixel_count"), F.sum(F.when(clear, total)).alias("_t"), F.sum(F.when(clear, square)).alias("_s"),
        F.max(F.when(clear, F.array_max(diffs))).alias("_m"), F.sum(F.when(clear, moved)).alias("_c"))
    samples = F.col("clear_pixel_count") * n
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    mae, worst = F.col("_t") / samples, F.col("_m")
    return grouped.select(
        *scene, "clear_pixel_count", zero(F.bround(mae, 6)).alias("mae"), zero(F.bround(F.sqrt(F.col("_s") / samples), 6)).alias("rmse"),
        zero(F.bround(worst, 6)).alias("max_difference"), zero(F.bround(F.col("_c") / samples * 100.0, 4)).alias("modified_pct"),
        F.when(F.col("clear_pixel_count") == 0, "PASS (No clear pixels to evaluate)")
        .when((mae <= K.CLEAR_TOLERANCE) & (worst <= K.CLEAR_TOLERANCE), "PASS").otherwise("FAIL").alias("status"))


def vari_mean(pixels: DataFrame, tile: list[str]) -> DataFrame:
    return pixels.groupBy(*tile).agg(F.bround(F.avg(spectral.vari(F.col("red"), F.col("green"), F.col("blue"))), 4).alias("mean_vari"))
