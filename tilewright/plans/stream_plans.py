"""Streaming jobs replayed from files, and model hooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import hooks, pairs
from ..session import fresh_path
from ..sources.tables import LoggedTable
from ..streaming import jobs
from .registry import query
from .scalar_plans import SCORED_SQL, with_gaps
from .sqltext import IDX, CLS, MAJOR, pixel_type, real

c = F.col


def replay(spark, df, order: str, run, slices: int = 3) -> None:
    """Deliver rows in time slices: each slice arrives as files, then the job runs over what is new."""
    path, checkpoint = fresh_path(spark, "incoming"), fresh_path(spark, "stream")
    micros = F.unix_micros(c(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(micros, [i / slices for i in range(1, slices)]).alias("cuts")).first()["cuts"]
    number = sum((micros > cut).cast("int") for cut in cuts)
    for i in range(slices):
        df.where(number == i).write.mode("append").parquet(path)
        run(jobs.file_stream(spark, path, df.schema), checkpoint)


@query("z01_incremental_ingest", ["obs"], """SELECT tile_id, CASE WHEN cloud_pct < 0.1 THEN 2 ELSE 1 END AS version, round(1 - CASE WHEN cloud_pct < 0.1 THEN cloud_pct / 2 ELSE cloud_pct END, 4) AS quality, quality_confidence >= 0.7 AS passed_gate FROM obs""")
def z01(spark, d):
    tiles = table(spark, d, "obs").select("tile_id", "cloud_pct", "quality_confidence", "acquisition_date", F.lit(1).alias("version"))
    # a tenth of the tiles has a second version, in the same batch or a late one, some of them before the first
    again = tiles.where("cloud_pct < 0.1").withColumns({"version": F.lit(2), "cloud_pct": c("cloud_pct") / 2, "acquisition_date": F.when(c("cloud_pct") < 0.05, c("acquisition_date")).otherwise(
        c("acquisition_date") + F.make_interval(days=F.when(c("cloud_pct") < 0.07, F.lit(200)).otherwise(F.lit(-200))))})
    rows = tiles.unionByName(again)
    quality = lambda df: df.withColumns({"quality": F.round(1 - c("cloud_pct"), 4), "passed_gate": c("quality_confidence") >= 0.7, "bucket": F.pmod(F.xxhash64("tile_id"), F.lit(4))})
    stored = LoggedTable.create(fresh_path(spark, "tiles"), quality(rows).withColumn("batch", F.lit(0)).limit(0), ["bucket"])
    replay(spark, rows, "acquisition_date", lambda stream, checkpoint: jobs.ingest_into(stream, checkpoint, stored, ["tile_id"], "version", quality, most=2))
    return jobs.current(stored, ["tile_id"], "version").select("tile_id", "version", "quality", "passed_gate")


@query("z02_predecessor_pairs", ["obs"], """WITH r AS (SELECT site_key, obs_id AS before_id, mean_ndbi AS b, acquisition_date AS d1, lead(obs_id) OVER w AS after_id, lead(mean_ndbi) OVER w AS a, lead(acquisition_date) OVER w AS d2 FROM obs WHERE quality_confidence >= 0.3 WINDOW w AS (PARTITION BY site_key ORDER BY acquisition_date, obs_id))
SELECT site_key, before_id, after_id, CAST(floor((epoch_us(d2) - epoch_us(d1)) / 86400000000.0) AS BIGINT) AS elapsed_days, round(a - b, 6) AS delta_mean_ndbi FROM r WHERE after_id IS NOT NULL""")
def z02(spark, d):
    usable = table(spark, d, "obs").where("quality_confidence >= 0.3").select("site_key", "obs_id", "acquisition_date", "mean_ndbi")
    out, late, state, history = (fresh_path(spark, n) for n in ("pairs", "late", "state", "history"))
    # a few observations are stamped as delivered earlier than they were taken, so they arrive late
    sent = usable.withColumn("delivered", F.expr("CASE WHEN site_key IN ('site_3', 'site_40') THEN acquisition_date + make_interval(0, 0, 0, CAST(obs_id % 20 AS INT)) ELSE acquisition_date END"))
    fields = ("site_key", "acquisition_date", "obs_id", ["mean_ndbi"])
    replay(spark, sent, "delivered", lambda stream, checkpoint: jobs.compare_with_predecessor(stream, checkpoint, out, late, state, history, *fields))
    pairs_found = jobs.settled_pairs(spark.read.parquet(out), spark.read.parquet(late), spark.read.parquet(history), *fields)
    return pairs_found.select("site_key", "before_id", "after_id", "elapsed_days", F.round("delta_mean_ndbi", 6).alias("delta_mean_ndbi"))


@query("z03_live_coverage", ["obs"], """SELECT region_id, count(*) AS tile_count, max(acquisition_date) AS last_updated FROM obs GROUP BY region_id""")
def z03(spark, d):
    path = fresh_path(spark, "coverage")
    tiles = table(spark, d, "obs").select("region_id", "tile_id", "acquisition_date")
    replay(spark, tiles, "acquisition_date", lambda stream, checkpoint: jobs.coverage_counts(stream, checkpoint, path, ["region_id"]))
    return jobs.latest(spark, path, ["region_id"]).select("region_id", "tile_count", "last_updated")


@query("z04_job_states", None, """WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS status FROM events)
SELECT job_id, arg_max(status, (status IN ('failed', 'done'), CASE WHEN status IN ('failed', 'done') THEN -epoch_us(ts) ELSE epoch_us(ts) END)) AS status, count(*) AS events FROM e GROUP BY job_id""")
def z04(spark, d):
    events = table(spark, d, "events").select(c("user_id").alias("job_id"), "ts", F.when(c("event_type") == "error", "failed").when(c("event_type") == "purchase", "done").otherwise("running").alias("status"))
    path = fresh_path(spark, "jobs")
    replay(spark, events, "ts", lambda stream, checkpoint: jobs.job_states(stream, checkpoint, path))
    return jobs.latest(spark, path, ["job_id"]).select("job_id", "status", "events")


def _letter_counts():
    """A stand-in encoder: text length and number of e's."""
    return lambda texts: np.array([[len(t), t.count("e")] for t in texts], dtype=float)


@query("h01_embedding_hook", None, """SELECT doc_id, [length(text)::FLOAT, (length(text) - length(replace(text, 'e', '')))::FLOAT] AS embedding FROM documents""")
def h01(spark, d):
    return table(spark, d, "documents").select("doc_id", hooks.embedding(_letter_counts)("text").alias("embedding"))


def _detect(pdf):
    if int(pdf["site_id"].iloc[0]) % 5 == 0:
        raise ValueError("no model for this pair")
    return (pdf["nir_a"] - pdf["nir_b"]).abs() > 0.05


@query("h02_change_hook", ["pixels"], f"""WITH {IDX}, {CLS}, k AS (SELECT *, NOT (bad_b OR bad_a) AS usable, site_id % 5 <> 0 AND abs(nir_a - nir_b) > 0.05 AS m, {real('class_b', 'class_a')} AS is_real, {pixel_type('class_b', 'class_a')} AS change_type FROM cls)
SELECT site_id, count(*) FILTER (WHERE m) AS model_pixels, count(*) FILTER (WHERE site_id % 5 = 0) AS failed_pixels, count(*) FILTER (WHERE usable AND is_real AND change_type IN {MAJOR} AND (m OR abs(ndvi_a - ndvi_b) > 0.15 OR abs(ndbi_a - ndbi_b) > 0.12 OR abs(ndwi_a - ndwi_b) > 0.15)) AS verified FROM k GROUP BY site_id""")
def h02(spark, d):
    px = table(spark, d, "pixels")
    mask = hooks.change_mask(px, ["site_id"], ["nir_b", "nir_a"], _detect)
    df = pairs.classify(px.join(mask, ["site_id", "prow", "pcol"]), model="model_mask")
    return df.groupBy("site_id").agg(F.count_if("model_mask").alias("model_pixels"), F.count_if("model_failed").alias("failed_pixels"), F.count_if("verified").alias("verified"))


@query("h03_cloud_hook", ["canvas"], f"""WITH {SCORED_SQL} SELECT scene_id, prow, pcol,
 round(CASE WHEN isnan(red) OR red <= 0 THEN NULL WHEN noise % 4 = 1 OR noise % 5 = 2 OR noise % 3 = 0 THEN prob ELSE (blue + nir) / 20000 END, 9) AS prob FROM p""")
def h03(spark, d):
    bands = {n: c(n) for n in ("blue", "green", "red", "nir", "swir")}
    score = hooks.cloud_score(bands, lambda f: (f["blue"] + f["nir"]) / 20000)
    return with_gaps(table(spark, d, "canvas")).select("scene_id", "prow", "pcol", F.round(score, 9).alias("prob"))