"""Spectral indices and land-cover classes as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .numeric import COMPARE, clip, within


def normalized_difference(first: Column, second: Column, eps: float = K.INDEX_EPS) -> Column:
    """(first - second) / (first + second + eps), limited to [-1, 1]; NULL without both bands."""
    value = (first - second) / (first + second + F.lit(eps))
    return F.when(first.isNotNull() & second.isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def ratio_difference(first: Column, second: Column, eps: float = K.INDEX_EPS) -> Column:
    """The archive form: a zero denominator becomes eps; NULL where a band is absent."""
    total = first + second
    return (first - second) / F.when(total == 0, F.lit(eps)).otherwise(total)


def spectral_indices(green: Column, red: Column, nir: Column, swir: Column) -> dict[str, Column]:
    return {
        "ndvi": normalized_difference(nir, red),
        "ndwi": normalized_difference(green, nir),
        "ndbi": normalized_difference(swir, nir),
    }


def archive_indices(green: Column, red: Column, nir: Column, swir: Column) -> dict[str, Column]:
    return {
        "ndvi": ratio_difference(nir, red),
        "ndwi": ratio_difference(green, nir),
        "ndbi": ratio_difference(swir, nir),
    }


def vari(red: Column, green: Column, blue: Column) -> Column:
    total = green + red - blue
    return clip((green - red) / F.when(total == 0, F.lit(1e-6)).otherwise(total), -1.0, 1.0)


def reflectance(dn: Column) -> Column:
    return clip(dn / F.lit(K.DN_SCALE), 0.0, 1.5)


def auto_reflectance(value: Column, band_max: Column) -> Column:
    """Scale only where the band's maximum shows that it holds digital numbers."""
    return F.when(band_max > 10.0, reflectance(value)).otherwise(value)


def _land_cover_of(values: dict[str, float], dark: bool) -> int:
    """Class code of one set of index values: the first rule that holds."""
    rules = [K.LAND_COVER_BOXES[0], *([(K.WATER, [])] if dark else []), *K.LAND_COVER_BOXES[1:], *K.LAND_COVER_FALLBACK]
    for label, bounds in rules:
        if all(COMPARE[op](values[name], limit) for name, op, limit in bounds):
            return K.CLASS_CODES.index(label)
    return K.CLASS_CODES.index(K.CONFUSION)


@lru_cache(maxsize=1)
def _land_cover_table() -> tuple[dict[str, list[tuple[float, bool]]], list[int]]:
    """Limits of each index used by the rules, and the class of every cell between limits.

    A limit (value, strict) is passed by x > value if strict, else by x >= value. The last
    two table axes are the dark-water test and whether ndvi is above ndbi.
    """
    limits: dict[str, set] = {"ndvi": set(), "ndwi": set(), "ndbi": set()}
    for _, bounds in K.LAND_COVER_BOXES + K.LAND_COVER_FALLBACK:
        for name, op, value in bounds:
            if name in limits:
                limits[name].add((value, op in (">", "<=")))
    ordered = {name: sorted(found) for name, found in limits.items()}

    def samples(cuts: list[tuple[float, bool]]) -> list[float]:
        ends = [cuts[0][0] - 1.0, *[v for v, _ in cuts], cuts[-1][0] + 1.0]
        return [(low + high) / 2.0 for low, high in zip(ends[:-1], ends[1:])]

    cells = [
        _land_cover_of({"ndvi": v, "ndwi": w, "ndbi": b, "lead": lead}, dark)
        for v in samples(ordered["ndvi"]) for w in samples(ordered["ndwi"]) for b in samples(ordered["ndbi"])
        for dark in (False, True) for lead in (0.0, 1.0)
    ]
    return ordered, cells


def land_cover_code(ndvi: Column, ndwi: Column, ndbi: Column, nir: Column | None = None,
                    red: Column | None = None, swir: Column | None = None) -> Column:
    """Class code: index boxes in priority order, then the out-of-box rules.

    With the three reflectance bands given, very dark pixels also count as water;
    without them this is the display form of the rule.

    The rules are evaluated once per cell between their limits when the plan is built; a
    pixel only counts the limits it passes and looks its cell up. Written as one chain of
    conditions, the rules of two dates make a method of over 8000 bytes, which the JVM
    leaves to its interpreter (twenty times slower on this job).
    """
    limits, cells = _land_cover_table()

    def passed(x: Column, name: str) -> Column:
        total = None
        for value, strict in limits[name]:
            step = ((x > value) if strict else (x >= value)).cast("int")
            total = step if total is None else total + step
        return total

    dark = F.lit(0) if nir is None else within({"ndvi": ndvi, "nir": nir, "red": red, "swir": swir}, K.DARK_WATER).cast("int")
    cell = passed(ndvi, "ndvi")
    for name, x in (("ndwi", ndwi), ("ndbi", ndbi)):
        cell = cell * (len(limits[name]) + 1) + passed(x, name)
    cell = (cell * 2 + dark) * 2 + (ndvi > ndbi).cast("int") + 1
    code = F.try_element_at(F.expr(f"array({', '.join(map(str, cells))})"), cell)
    unknown = K.CLASS_CODES.index(K.CONFUSION)
    return F.when(F.isnan(ndvi + ndwi + ndbi), unknown).otherwise(F.coalesce(code, F.lit(unknown)))


def class_name(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(name) for name in K.CLASS_CODES]), code + 1)


def land_cover(*columns: Column) -> Column:
    return class_name(land_cover_code(*columns))


def with_indices(df: DataFrame, side: str) -> DataFrame:
    """Add ndvi_/ndwi_/ndbi_ columns of one side (``b`` before, ``a`` after)."""
    bands = [F.col(f"{name}_{side}") for name in ("green", "red", "nir", "swir")]
    return df.withColumns({f"{name}_{side}": expr for name, expr in spectral_indices(*bands).items()})


def with_land_cover(df: DataFrame, side: str) -> DataFrame:
    """Add code_ and class_ of one side.

    Missing values travel as NaN in columns known to be non-null, which keeps the null
    checks out of the generated comparisons.
    """
    names = ("ndvi", "ndwi", "ndbi", "nir", "red", "swir")
    filled = df.select("*", *[F.coalesce(f"{n}_{side}", F.lit(float("nan"))).alias(f"_{n}") for n in names])
    coded = filled.select(*df.columns, land_cover_code(*[F.col(f"_{n}") for n in names]).alias(f"code_{side}"))
    return coded.withColumn(f"class_{side}", class_name(F.col(f"code_{side}")))


def nodata_value(value: Column, custom: float | None = None) -> Column:
    """One sample is nodata: zero, the two sentinels, NaN, infinity, a custom value."""
    bad = (value == 0) | (value == -9999) | (value < -9000) | F.isnan(value) | (F.abs(value) == float("inf"))
    return bad if custom is None else bad | (value == custom)


def nodata_pixel(bands: list[Column], custom: float | None = None) -> Column:
    """The index form: any band holds a sentinel, or all bands are zero."""
    any_bad = None
    all_zero = None
    for band in bands:
        bad = (band == -9999) | (band < -9000) | F.isnan(band) | (F.abs(band) == float("inf"))
        if custom is not None:
            bad = bad | (band == custom)
        any_bad = bad if any_bad is None else any_bad | bad
        zero = band == 0
        all_zero = zero if all_zero is None else all_zero & zero
    return any_bad | all_zero


def resolve_roles(count: int, named: dict[str, Column], positions: list[Column]) -> dict[str, Column]:
    """Five canonical roles from the named bands, with stand-ins for the absent ones.

    ``named`` holds nullable band columns by upper-case name, ``positions`` the bands
    in file order. A NULL column means the band is absent.
    """
    def first(names: list[str], *fallback: Column | None) -> Column:
        found = [named[n] for n in names if n in named] + [f for f in fallback if f is not None]
        return F.coalesce(*found)

    at = lambda i: positions[i - 1] if 0 < i <= count else None
    nir_fallback = at(6) if count >= 6 else (at(count) if count >= 4 else at(1))
    nir = first(["B08", "B8", "B8A", "NIR", "BAND_8", "BAND_8A"], nir_fallback)
    swir = first(["B11", "B12", "SWIR", "SWIR1", "SWIR2", "BAND_11", "BAND_12"], at(8) if count >= 8 else nir)
    red_fallback = at(3) if count >= 4 else at(1)
    if count == 3 and "B01" in named:
        red = first(["B04", "B4", "RED", "BAND_4", "B05"], named["B01"], red_fallback)
    elif count >= 4:
        red = first(["B04", "B4", "RED", "BAND_4", "B05"], red_fallback)
    else:
        red = first(["B04", "B4", "RED", "BAND_4", "B05"], named.get("B01"), red_fallback)
    blue_fallback = at(1) if count >= 4 or count < 3 else at(3)
    blue = first(["B02", "B2", "BLUE", "BAND_2", "B01"], blue_fallback)
    green = first(["B03", "B3", "GREEN", "BAND_3"], at(2) if count >= 3 else (red + blue) / 2.0)
    return {"blue": blue, "green": green, "red": red, "nir": nir, "swir": swir}


def rgb_selection(visual: list[Column] | None, named: dict[str, Column], positions: list[Column]) -> list[Column]:
    """Three display channels: the true-colour image, the named bands, else by band count."""
    count = len(positions)
    if count == 1:
        fallback = [positions[0]] * 3
    elif count == 2:
        fallback = [positions[0], positions[1], positions[0]]
    else:
        fallback = positions[:3]
    channels = [named.get(n) for n in ("red", "green", "blue")]
    if count > 1 and all(c is not None for c in channels):
        complete = channels[0].isNotNull() & channels[1].isNotNull() & channels[2].isNotNull()
        chosen = [F.when(complete, c).otherwise(f) for c, f in zip(channels, fallback)]
    else:
        chosen = fallback
    if visual is None:
        return chosen
    return [F.when(visual[0].isNotNull(), v).otherwise(c) for v, c in zip(visual, chosen)]
