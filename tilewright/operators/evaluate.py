"""Quality measures and review work lists."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall and nDCG at k per query. ``ranked`` has query_id, tile_id, rank (1-based)."""
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "tile_id").withColumn("_hit", F.lit(1)), ["query_id", "tile_id"], "left")
    return _at_k(hits, wanted, k)


def cluster_metrics(ranked: DataFrame, seeds: DataFrame, members: DataFrame, cluster: str, k: int) -> DataFrame:
    """As ``retrieval_metrics``, with all members of the seed's cluster relevant. Labels are joined to the
    k hits and counted per cluster, so the relevant pairs themselves are never made."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("relevant"))
    wanted = seeds.select("query_id", F.col(cluster).alias("_own")).join(sizes, F.col("_own") == F.col(cluster)).select("query_id", "_own", "relevant")
    hits = ranked.where(F.col("rank") <= k).join(members.select("tile_id", cluster), "tile_id").join(wanted.select("query_id", "_own"), "query_id")
    return _at_k(hits.withColumn("_hit", F.when(F.col(cluster) == F.col("_own"), 1)), wanted, k)


def _at_k(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    gain = F.col("_hit") / F.log2(F.col("rank") + 1)
    per = hits.groupBy("query_id").agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return wanted.join(per, "query_id", "left").select(
        "query_id", (F.coalesce("hits", F.lit(0)) / k).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def change_metrics(pixels: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision, recall, F1 and IoU per class, from the confusion counts."""
    confusion = pixels.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))
    side = lambda col, name: confusion.groupBy(F.col(col).alias("class")).agg(F.sum("n").alias(name))
    hit = confusion.where(F.col(predicted) == F.col(actual)).select(F.col(predicted).alias("class"), F.col("n").alias("tp"))
    df = side(predicted, "p").join(side(actual, "a"), "class", "full_outer").join(hit, "class", "left").na.fill(0)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    tp, p, a = F.col("tp"), F.col("p"), F.col("a")
    return df.select("class", tp.alias("true_positive"), ratio(tp, p).alias("precision"), ratio(tp, a).alias("recall"),
                     ratio(2 * tp, p + a).alias("f1"), ratio(tp, p + a - tp).alias("iou"))


def latency_report(log: DataFrame, key: list[str], value: str, digits: int = 3) -> DataFrame:
    """Median and 95th percentile, count and total. Values are counted at ``digits`` decimals first, so the
    percentiles see one row per distinct value, summed before the shuffle, and not the log."""
    counted = log.withColumn("_v", F.round(value, digits)).groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"))
    return counted.groupBy(*key).agg(F.sum("_n").alias("runs"), F.percentile("_v", F.lit(0.5), F.col("_n")).alias("p50"),
                                     F.percentile("_v", F.lit(0.95), F.col("_n")).alias("p95"), F.sum("_t").alias("total"))


def review_queue(items: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Pending items by weighted score."""
    score = None
    for name, weight in weights.items():
        term = F.coalesce(F.col(name), F.lit(0.0)) * weight
        score = term if score is None else score + term
    return items.where(F.col("status") == "pending").withColumn("rank_score", F.round(score, 6))


def rerank(history: DataFrame, candidates: DataFrame, features: list[str], decision: str) -> DataFrame:
    """Candidates scored by a logistic model of past decisions."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    model = LogisticRegression(featuresCol="_x", labelCol=decision, maxIter=30).fit(assemble.transform(history))
    scored = model.transform(assemble.transform(candidates))
    return scored.withColumn("rerank_score", F.element_at(vector_to_array("probability"), 2)).drop("_x", "rawPrediction", "probability", "prediction")


def ordered_bands(files: DataFrame, scene: list[str], priority: dict[str, int]) -> DataFrame:
    """Scene of several single-band files: union box, first reference system, band order by role."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in priority.items() for v in p]), F.lower("band")), F.lit(50))
    df = files.groupBy(*scene, "band").agg(
        F.min("min_lon").alias("x0"), F.min("min_lat").alias("y0"), F.max("max_lon").alias("x1"), F.max("max_lat").alias("y1"),
        F.min(F.struct("file_no", "crs")).alias("c"), F.min("file_no").alias("no"))
    # one entry per distinct band name of the scene; files that share a name share an entry
    return df.groupBy(*scene).agg(
        F.min("x0").alias("min_lon"), F.min("y0").alias("min_lat"), F.max("x1").alias("max_lon"), F.max("y1").alias("max_lat"),
        F.min("c")["crs"].alias("crs"), F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("no"), F.col("band")))).alias("_b")).withColumn(
        "band_order", F.transform("_b", lambda b: b["band"])).drop("_b")
