"""Tile windows, time buckets, sampling, regridding and block neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import dealt


def stride_of(window: int, overlap: float) -> int:
    return max(1, int(round(window * (1.0 - overlap))))


def window_offsets(size: Column, window: Column, stride: Column) -> Column:
    """Start offsets at a fixed stride, and a last one flush with the edge."""
    last = size - window
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), stride.cast("bigint"))
    return F.when(last <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.concat(steps, F.array(last.cast("bigint")))))


def tile_windows(canvases: DataFrame, scene: list[str], window: int, overlap: float) -> DataFrame:
    """All windows of every canvas (columns height, width) with their row-major number."""
    size = F.least(F.lit(window), F.least("height", "width")).cast("bigint")
    stride = F.greatest(F.lit(1), F.bround(F.col("_size") * (1.0 - overlap), 0).cast("bigint"))
    df = dealt(canvases.select(*scene, "height", "width")).withColumn("_size", size)
    df = df.withColumns({"_ys": window_offsets(F.col("height"), F.col("_size"), stride), "_xs": window_offsets(F.col("width"), F.col("_size"), stride)})
    df = df.withColumn("_nx", F.size("_xs")).select("*", F.posexplode("_ys").alias("_i", "y0")).select("*", F.posexplode("_xs").alias("_j", "x0"))
    return df.select(*scene, "height", "width", F.col("_size").alias("size"), "y0", "x0",
                     (F.col("_i") * F.col("_nx") + F.col("_j") + 1).cast("bigint").alias("window_no"))


def window_bounds(windows: DataFrame, lon0: Column, lat0: Column, pixel_deg: float) -> DataFrame:
    """Geographic box and centre of each window from the canvas origin and pixel size."""
    df = windows.withColumns({
        "min_lon": lon0 + F.col("x0") * pixel_deg, "max_lon": lon0 + (F.col("x0") + F.col("size")) * pixel_deg,
        "max_lat": lat0 - F.col("y0") * pixel_deg, "min_lat": lat0 - (F.col("y0") + F.col("size")) * pixel_deg,
    })
    return df.withColumns({"centroid_lon": F.bround((F.col("min_lon") + F.col("max_lon")) / 2.0, 6),
                           "centroid_lat": F.bround((F.col("min_lat") + F.col("max_lat")) / 2.0, 6)})


def covering_windows(pixel: Column, size: Column, window: Column, stride: Column) -> Column:
    """Start offsets of all windows along one axis that cover the pixel.

    Computed from the pixel's own position: no join with the windows is needed.
    """
    last = F.greatest(size - window, F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    first_step = F.greatest(F.ceil((pixel - window + 1) / stride), zero)
    last_step = F.least(F.floor(pixel / stride), F.floor(last / stride))
    steps = F.when(first_step <= last_step, F.transform(F.sequence(first_step, last_step), lambda i: i * stride.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))
    flush = F.when((pixel >= last) & (F.pmod(last, stride.cast("bigint")) != 0), F.array(last)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(steps, flush)


def pixels_by_window(pixels: DataFrame, height: Column, width: Column, window: int, overlap: float) -> DataFrame:
    """Every pixel once per window that covers it."""
    w, s = F.lit(window), F.lit(stride_of(window, overlap))
    return pixels.withColumn("y0", F.explode(covering_windows(F.col("prow"), height, w, s))).withColumn(
        "x0", F.explode(covering_windows(F.col("pcol"), width, w, s)))


def time_buckets(ranges: DataFrame, start: str, end: str, count: int) -> DataFrame:
    """Equal sub-windows of a date range with their labels; one ``bucket_single`` for an empty range."""
    days = F.datediff(end, start)
    n = F.greatest(F.lit(1), F.least(F.lit(count), days))
    df = ranges.withColumns({"_days": days, "_n": n})
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.col("_days") <= 0, 0).otherwise(F.col("_n") - 1))))
    step = F.col("_days") / F.col("_n")
    whole = lambda e: F.floor(e).cast("int")
    label = F.when(F.col("_n") == 2, F.when(F.col("_i") == 0, "historical_T1").otherwise("recent_T2")).otherwise(
        F.concat(F.lit("time_bucket_"), (F.col("_i") + 1).cast("string")))
    begin = F.when(F.col("_days") <= 0, F.col(start)).otherwise(F.date_add(start, whole(F.col("_i") * step)))
    stop = F.when((F.col("_days") <= 0) | (F.col("_i") == F.col("_n") - 1), F.col(end)).otherwise(
        F.date_add(start, whole((F.col("_i") + 1) * step) - 1))
    return df.select(*ranges.columns, F.when(F.col("_days") <= 0, "bucket_single").otherwise(label).alias("bucket"),
                     begin.alias("bucket_start"), stop.alias("bucket_end"))


def season_windows(areas: DataFrame, years: str, season: str) -> DataFrame:
    """One date range per area and year from a month-day window such as 07-01/10-31."""
    part = lambda i: F.element_at(F.split(season, "/"), i)
    day = lambda i: F.concat_ws("-", F.col("year").cast("string"), part(i))
    return areas.withColumn("year", F.explode(years)).withColumn("date_range", F.concat(day(1), F.lit("/"), day(2)))


def _field(name: str):
    return lambda cell: cell[name]


def sample_grid(pixels: DataFrame, pair: list[str], columns: list[str], step: int) -> DataFrame:
    """Every ``step``-th row and column; one output row per grid row with its cells in order.

    A grid row has at most 255 cells (the step is the image side divided by 128).
    """
    kept = pixels.where((F.pmod("prow", F.lit(step)) == 0) & (F.pmod("pcol", F.lit(step)) == 0))
    return kept.groupBy(*pair, (F.col("prow") / step).cast("bigint").alias("grid_row")).agg(
        F.sort_array(F.collect_list(F.struct("pcol", *columns))).alias("_l")).select(
        *pair, "grid_row", *[F.transform("_l", _field(c)).alias(c) for c in columns])


def sampled_water(classified: DataFrame, pair: list[str], step: int, cell_px: int) -> DataFrame:
    """Water area estimated from the sample grid, for stored pairs without exact counts."""
    on_grid = (F.pmod("prow", F.lit(step)) == 0) & (F.pmod("pcol", F.lit(step)) == 0)
    count = lambda side: (F.count_if(on_grid & (F.col(f"code_{side}") == K.CLASS_CODES.index(K.WATER))) * cell_px)
    df = classified.groupBy(*pair).agg(count("b").alias("before_pixels"), count("a").alias("after_pixels"))
    df = df.withColumn("delta_pixels", F.col("after_pixels") - F.col("before_pixels"))
    grown, shrunk = F.col("delta_pixels") >= K.WATER_PROOF_PX, F.col("delta_pixels") <= -K.WATER_PROOF_PX
    return df.withColumns({
        "new_water_pixels": F.greatest(F.lit(0), F.col("delta_pixels")),
        "status": F.when(grown, "Extended").when(shrunk, "Shrunk").otherwise("Stable"),
        "proof": F.concat(F.lit("Water Extent "), F.when(grown, "Expansion Verified").otherwise("Stable"), F.lit(": Δ "),
                          F.format_string("%+d", "delta_pixels"), F.lit(" px.")),
    })


def regrid_nearest(pixels: DataFrame, key: list[str], values: list[str], source: int, target: int) -> DataFrame:
    """Nearest-neighbour resize: each source pixel yields the target pixels it serves."""
    scale = source / target

    def serves(axis: str) -> Column:
        low = F.ceil(F.col(axis) / scale - 0.5)
        high = F.ceil((F.col(axis) + 1) / scale - 0.5) - 1
        return F.when(low <= high, F.sequence(low, high))

    df = pixels.select(*key, *values, serves("prow").alias("_r"), F.col("pcol"))
    df = df.select(*key, *values, F.explode("_r").alias("trow"), "pcol").withColumn("tcol", F.explode(serves("pcol")))
    return df.select(*key, "trow", "tcol", *values)


def regrid_bilinear(pixels: DataFrame, key: list[str], values: list[str], source: int, target: int) -> DataFrame:
    """Bilinear enlargement: each source pixel adds its share to the targets in reach, one sum per target."""
    scale = source / target

    def shares(axis: str) -> Column:
        x = F.col(axis)
        low = F.when(x == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((x - 0.5) / scale - 0.5).cast("int")))
        high = F.when(x == source - 1, F.lit(target - 1)).otherwise(F.least(F.lit(target - 1), F.ceil((x + 1.5) / scale - 0.5).cast("int")))

        def weight(t: Column) -> Column:
            at = F.least(F.greatest((t + 0.5) * scale - 0.5, F.lit(0.0)), F.lit(float(source - 1)))
            return F.greatest(F.lit(0.0), 1.0 - F.abs(at - x))

        return F.filter(F.transform(F.sequence(low, high), lambda t: F.struct(t.cast("bigint").alias("t"), weight(t).alias("w"))), lambda s: s["w"] > 0)

    df = pixels.select(*key, *values, "pcol", F.explode(shares("prow")).alias("_r"))
    df = df.withColumn("_c", F.explode(shares("pcol")))
    weight = F.col("_r.w") * F.col("_c.w")
    return df.groupBy(*key, F.col("_r.t").alias("trow"), F.col("_c.t").alias("tcol")).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values])


def with_halo(pixels: DataFrame, halo: int, block: int) -> DataFrame:
    """Pixels keyed by block, each block also holding its neighbours' rim of ``halo`` pixels.

    With a block of 512 and a rim of 25 this copies one pixel in five, and a block is
    never larger than (512 + 2 * 25) squared, whatever the scene's size.
    """
    cells = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - halo) / block), F.floor((F.col(axis) + halo) / block)))
    return pixels.withColumn("_br", cells("prow")).withColumn("_bc", cells("pcol"))


def _block_kernel(pixels: DataFrame, scene: list[str], inputs: list[str], outputs: str, halo: int, block: int, kernel) -> DataFrame:
    """Run ``kernel(arrays, present, origin) -> arrays`` on dense blocks and return the block's own pixels."""
    types = dict(pixels.dtypes)
    fields = ", ".join([f"{k} {types[k]}" for k in scene] + ["prow bigint", "pcol bigint", outputs])
    names = [f.split()[0] for f in outputs.split(", ")]

    def run(label: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(label[-2]), int(label[-1])
        own = ((pdf["prow"] // block == br) & (pdf["pcol"] // block == bc)).to_numpy()
        if not own.any():  # only rim pixels fell into this block
            return pdf.iloc[:0][[*scene, "prow", "pcol"]].assign(**{n: pd.Series(dtype="object") for n in names})
        # the block and its rim, cropped to the pixels that exist
        (r0, r1), (c0, c1) = ((max(b * block, int(pdf[x].min())) - halo, min((b + 1) * block - 1, int(pdf[x].max())) + halo)
                              for b, x in ((br, "prow"), (bc, "pcol")))
        rows, cols = pdf["prow"].to_numpy() - r0, pdf["pcol"].to_numpy() - c0
        shape = (r1 - r0 + 1, c1 - c0 + 1)
        present = np.zeros(shape, dtype=bool)
        present[rows, cols] = True
        arrays = {}
        for name in inputs:
            dense = np.zeros(shape, dtype=pdf[name].dtype)
            dense[rows, cols] = pdf[name].to_numpy()
            arrays[name] = dense
        result = kernel(arrays, present, (r0, c0))
        kept = pdf[own]
        return pd.DataFrame({**{k: kept[k] for k in scene}, "prow": kept["prow"], "pcol": kept["pcol"],
                             **{n: result[n][rows[own], cols[own]] for n in names}})

    keyed = with_halo(pixels.select(*scene, "prow", "pcol", *inputs), halo, block)
    return keyed.groupBy(*scene, "_br", "_bc").applyInPandas(run, fields)


def _shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """Array moved by (dr, dc), empty where nothing moves in."""
    out = np.zeros_like(a)
    h, w = a.shape
    out[max(0, dr):h + min(0, dr), max(0, dc):w + min(0, dc)] = a[max(0, -dr):h + min(0, -dr), max(0, -dc):w + min(0, -dc)]
    return out


def shadow_mask(pixels: DataFrame, scene: list[str], cloud: str, dark: str, radius: int = K.SHADOW_RADIUS,
                step: int = K.SHADOW_STEP, block: int = 512) -> DataFrame:
    """Dark pixels that lie on the search lattice around a cloud pixel and are not cloud themselves."""
    reach = range(-radius, radius + 1, step)
    offsets = [(a, b) for a in reach for b in reach if a * a + b * b <= radius * radius]

    def kernel(arrays, present, origin):
        near = np.zeros_like(arrays[cloud])
        for dr, dc in offsets:
            near |= _shifted(arrays[cloud], dr, dc)
        return {"shadow": arrays[dark] & near & ~arrays[cloud]}

    return _block_kernel(pixels, scene, [cloud, dark], "shadow boolean", radius, block, kernel)


def dark_pixels(pixels: DataFrame, scene: list[str]) -> DataFrame:
    """Add ``dark``: low visible and near-infrared values, in either value range of the scene."""
    visible = (F.col("red") + F.col("green") + F.col("blue")) / 3.0
    top = pixels.groupBy(*scene).agg(F.max(F.when(~F.isnan(visible), visible)).alias("_top"))
    limit = F.when(F.col("_top") <= 1.5, K.SHADOW_DARKNESS / 10000.0).otherwise(K.SHADOW_DARKNESS)
    return pixels.join(top, scene).withColumn("dark", (visible < limit) & (F.col("nir") < limit * 1.5)).drop("_top")


def _grow(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        rows = mask | _shifted(mask, 1, 0) | _shifted(mask, -1, 0)
        mask = rows | _shifted(rows, 0, 1) | _shifted(rows, 0, -1)
    return mask


def morphology(pixels: DataFrame, scene: list[str], mask: str, erode: int = 1, dilate: int = 2, block: int = 512) -> DataFrame:
    """3x3 erosion and dilation of a mask; ground outside the image counts as empty."""
    def kernel(arrays, present, origin):
        core = arrays[mask]
        for _ in range(erode):
            rows = core & _shifted(core, 1, 0) & _shifted(core, -1, 0)
            core = rows & _shifted(rows, 0, 1) & _shifted(rows, 0, -1)
        return {"core": core, "zone": _grow(arrays[mask], dilate)}

    return _block_kernel(pixels, scene, [mask], "core boolean, zone boolean", max(erode, dilate), block, kernel)


def trimap(pixels: DataFrame, scene: list[str], prob: str, cloud: str, block: int = 512) -> DataFrame:
    """255 for the opaque core, 128 for the transition zone, else 0."""
    seeded = pixels.select(*scene, "prow", "pcol", F.col(prob).alias("_p"), ((F.col(prob) >= K.THICK_PROB) | F.col(cloud)).alias("seed"))
    shaped = morphology(seeded, scene, "seed", block=block)
    code = F.when(F.col("core"), 255).when(F.col("zone") & (F.col("_p") >= K.CLEAR_PROB), 128).otherwise(0)
    return seeded.join(shaped, [*scene, "prow", "pcol"]).select(*scene, "prow", "pcol", code.alias("trimap"))


def gaussian_fill(pixels: DataFrame, scene: list[str], values: list[str], thick: str, sigma: float = 3.0, block: int = 512) -> DataFrame:
    """Opaque-cloud pixels replaced by the Gaussian mean of their surroundings (mirrored at the image edge)."""
    radius = int(4.0 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    sizes = pixels.groupBy(*scene).agg((F.max("prow") + 1).alias("_h"), (F.max("pcol") + 1).alias("_w"))
    sized = pixels.join(sizes, scene)

    def mirrored(start: int, side: int, size: int) -> np.ndarray:
        at = np.arange(start, start + side) % (2 * size)
        return np.clip(np.where(at >= size, 2 * size - 1 - at, at) - start, 0, side - 1)

    def kernel(arrays, present, origin):
        height, width = int(arrays["_h"].max()), int(arrays["_w"].max())
        rows, cols = mirrored(origin[0], present.shape[0], height), mirrored(origin[1], present.shape[1], width)
        held = present[np.ix_(rows, cols)]
        result = {}
        for name in values:
            full = arrays[name].astype(float)[np.ix_(rows, cols)]
            for axis in (0, 1):
                full = np.apply_along_axis(lambda line: np.convolve(line, weights, mode="same"), axis, full) * held
            result[name] = np.where(arrays[thick], full, arrays[name])
        return result

    return _block_kernel(sized, scene, [*values, thick, "_h", "_w"], ", ".join(f"{v} double" for v in values), radius, block, kernel)
