"""Cloud removal over whole scenes: unmixing of thin cloud, filling of opaque cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import cloud
from . import grids, raster

BANDS = ["red", "green", "blue"]


def temporal_fill(pixels: DataFrame, later: DataFrame, scene: list[str], bands: list[str]) -> DataFrame:
    """Opaque pixels (region 3) taken from a co-registered scene; without a candidate they
    stay as observed and count as unresolved."""
    other = later.select(*scene, "prow", "pcol", *[F.col(b).alias(f"_new_{b}") for b in bands], F.lit(True).alias("_has"))
    df = pixels.join(other, [*scene, "prow", "pcol"], "left")
    thick, has = F.col("region") == K.REGION_THICK, F.coalesce("_has", F.lit(False))
    thin = F.col("region").isin(K.REGION_THIN, K.REGION_UNCERTAIN)
    code = cloud.provenance(F.col("region") == K.REGION_CLEAR, thin, thick & has, thick & ~has, F.col("region") == K.REGION_NODATA)
    return df.withColumns({**{b: F.when(thick & has, F.col(f"_new_{b}")).otherwise(F.col(b)) for b in bands}, "provenance": code}).drop(
        "_has", *[f"_new_{b}" for b in bands])


def remove_clouds(pixels: DataFrame, scene: list[str], later: DataFrame | None = None, block: int = 512) -> DataFrame:
    """Region classes, trimap, opacity, radiance, unmixed thin cloud and provenance per pixel."""
    regions = pixels.withColumn("region", cloud.cloud_region(F.col("prob"), F.col("cloud")))
    zones = grids.trimap(pixels, scene, "prob", "cloud", block=block)
    light = raster.cloud_radiance(regions, scene, F.col("region") == K.REGION_THICK, exact=True)  # byte colours: few distinct values
    df = regions.join(zones, [*scene, "prow", "pcol"]).join(light, scene).withColumn("alpha", cloud.opacity(F.col("prob"), F.col("trimap")))
    thin = F.col("region").isin(K.REGION_THIN, K.REGION_UNCERTAIN)
    df = df.withColumns({b: F.when(thin, cloud.unmix(F.col(b), F.col("alpha"), F.col(f"{b}_cloud"))).otherwise(F.col(b)) for b in BANDS})
    if later is None:
        later = df.select(*scene, "prow", "pcol", *BANDS).limit(0)
    return temporal_fill(df, later, scene, BANDS)
