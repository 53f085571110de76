"""Hooks for models that are not part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cloud


def embedding(load: Callable[[], Callable[[list], np.ndarray]], batch_rows: int = 64):
    """Vector UDF around an encoder. ``load`` runs once per task; the encoder gets at most ``batch_rows`` values at a time."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            rows = []
            for start in range(0, len(batch), batch_rows):
                rows += [v.astype(np.float32) for v in np.asarray(model(batch.iloc[start:start + batch_rows].tolist()))]
            yield pd.Series(rows, dtype=object)

    return encode


def change_mask(pixels: DataFrame, pair: list[str], columns: list[str], detect: Callable[[pd.DataFrame], np.ndarray], block: int = 512) -> DataFrame:
    """Add ``model_mask`` from a detector that sees one pixel block of a pair at a time.

    A block the detector fails on has an empty mask, so its candidates stay spectral, and
    ``model_failed`` set on its pixels.
    """
    types = dict(pixels.dtypes)
    fields = ", ".join([f"{k} {types[k]}" for k in pair] + ["prow bigint", "pcol bigint", "model_mask boolean", "model_failed boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            mask, failed = np.asarray(detect(pdf), dtype=bool), False
        except Exception:  # noqa: BLE001 - reported per pixel
            mask, failed = np.zeros(len(pdf), dtype=bool), True
        return pdf[[*pair, "prow", "pcol"]].assign(model_mask=mask, model_failed=failed)

    keyed = pixels.select(*pair, "prow", "pcol", *columns, F.floor(F.col("prow") / block).alias("_br"), F.floor(F.col("pcol") / block).alias("_bc"))
    return keyed.groupBy(*pair, "_br", "_bc").applyInPandas(run, fields)


def cloud_score(bands: dict[str, Column], model: Callable[..., pd.Series] | None = None) -> Column:
    """Cloud probability from a vectorised model over the bands, or the spectral rule where a band is missing."""
    spectral = cloud.cloud_probability(*[bands[n] for n in ("blue", "green", "red", "nir", "swir")])
    has_data = ~F.isnan(bands["red"]) & (bands["red"] > 0)
    if model is None:
        return spectral
    complete = None
    for band in bands.values():
        complete = band.isNotNull() if complete is None else complete & band.isNotNull()

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        return model(frame)

    return F.when(complete & has_data, score(F.struct(*[b.alias(n) for n, b in bands.items()]))).otherwise(spectral)
