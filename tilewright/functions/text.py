"""Descriptions and cluster labels built from mean indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import fixed2

# --- Fixed values: landscape sentences -------------------------------------------------
OPEN_WATER = "Open surface aquatic body or major river channel with high specular water reflectance and minimal terrestrial signature."
WETLAND = "Riparian wetland or active riverbank corridor exhibiting rich soil moisture and water-tolerant flora."
PAVED = "High-density paved industrial or transport corridor (e.g. runways, logistics yards, tarmac aprons) with minimal vegetation."
URBAN = "Dense urban core or heavy commercial development characterized by concrete infrastructure, built structures, and road networks."
SUBURBAN = "Mixed suburban landscape combining residential/commercial building clusters with planned green spaces and tree canopy."
FOREST = "Dense natural woodland or thick forest canopy with high chlorophyll biomass and zero artificial built-up footprint."
CROPLAND = "Cultivated agricultural cropland or active vegetative pasture with prominent chlorophyll activity."
ARID = "Arid barren land or open cleared terrain with dry bare soil and sparse scrub, suitable for vehicle traversal or development."
SCRUB = "Semi-arid open scrubland or sparse natural grassland with moderate background soil reflectance."
MIXED = "Mixed transition terrain with balanced vegetation, soil, and low-density structural features."
UNAVAILABLE = "Spectral indices unavailable for this ground tile."
HIGH_RES = "High-resolution sub-meter reconnaissance imagery (True Color optical). Optimized for detailed tactical object, vehicle, and infrastructure identification"


def _clause(value: Column, index: str, steps: list[tuple[float, str]], last: str) -> Column:
    """Graded words for one index; NULL when the index is missing, so ``concat_ws`` drops it."""
    chain = None
    for least, words in steps:
        chain = F.when(value >= least, words) if chain is None else chain.when(value >= least, words)
    words = chain.otherwise(last)
    return F.when(value.isNotNull(), F.concat(words, F.lit(f" ({index} "), fixed2(value), F.lit(")")))


def tile_description(ndvi: Column, ndwi: Column, ndbi: Column, sensor: Column) -> Column:
    v, w, b = F.coalesce(ndvi, F.lit(0.0)), F.coalesce(ndwi, F.lit(-0.2)), F.coalesce(ndbi, F.lit(0.0))
    landscape = (
        F.when(w >= 0.25, OPEN_WATER)
        .when((w >= 0.05) & (v >= 0.20), WETLAND)
        .when((b >= 0.03) & (v < 0.18) & (w < -0.15), PAVED)
        .when((b >= 0.04) & (v < 0.24), URBAN)
        .when((b >= 0.01) & (v >= 0.20) & (v < 0.38), SUBURBAN)
        .when((v >= 0.40) & (b < -0.05), FOREST)
        .when((v >= 0.26) & (v < 0.40) & (b <= 0.02), CROPLAND)
        .when((v < 0.16) & (w < -0.20) & (b < 0.03), ARID)
        .when((v >= 0.16) & (v < 0.26) & (b <= 0.02), SCRUB)
        .otherwise(MIXED)
    )
    clauses = F.concat_ws(
        ", ",
        _clause(ndvi, "NDVI", [(0.35, "dense vegetation"), (0.18, "sparse vegetation")], "minimal vegetation"),
        _clause(ndwi, "NDWI", [(0.20, "prominent water presence"), (-0.05, "moderate moisture")], "dry surface moisture"),
        _clause(ndbi, "NDBI", [(0.04, "high built-up dominance"), (0.0, "moderate structural reflectance")],
                "non-built natural surface"),
    )
    vari = F.when(ndvi.isNotNull(), F.concat(F.lit(" (VARI visible vegetation index: "), fixed2(ndvi), F.lit(")")))
    return (
        F.when(F.lower(sensor).contains("maxar"), F.concat(F.lit(HIGH_RES), F.coalesce(vari, F.lit("")), F.lit(".")))
        .when(ndvi.isNull() & ndwi.isNull() & ndbi.isNull(), UNAVAILABLE)
        .otherwise(F.concat(landscape, F.lit(" Spectral signature reflects "), clauses, F.lit(".")))
    )


def cluster_label(number: Column, ndvi: Column, ndwi: Column, ndbi: Column) -> Column:
    terrain = (
        F.when(ndwi >= 0.15, "Aquatic & Coastal Water")
        .when(ndvi >= 0.35, "Dense Woodland & Forest Canopy")
        .when(ndvi >= 0.20, "Vegetative & Agricultural Fields")
        .when(ndbi >= 0.03, "Urban Core & Built-up Infrastructure")
        .when(ndbi >= 0.0, "Industrial / Tarmac Logistics")
        .otherwise("Open Arid & Transition Terrain")
    )
    part = lambda name, col: F.when(col.isNotNull(), F.concat(F.lit(name + " "), fixed2(col)))
    indices = F.concat_ws(", ", part("NDVI", ndvi), part("NDWI", ndwi), part("NDBI", ndbi))
    suffix = F.when(indices == "", "").otherwise(F.concat(F.lit(" ("), indices, F.lit(")")))
    return F.concat(F.lit("Cluster "), (number + 1).cast("string"), F.lit(" — "), terrain, suffix)
