"""Search, discovery and clustering over tile vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import catalog, clusters, search, vectors
from ..operators.index import VectorIndex
from ..session import cut_lineage, fresh_path
from .filter_plans import SENTINELS
from .registry import query, recursive, ORACLES
from .scalar_plans import DESC_SQL, LABEL_SQL

c = F.col
K_TOP = 5


def vec(spark, d):
    return table(spark, d, "vectors")


def queries_of(spark, d):
    """One query per four vectors, as the ensemble of its four prompt vectors."""
    prompts = vec(spark, d).selectExpr("concat('q_', CAST(floor(vec_id / 4) AS BIGINT)) AS query_id", "embedding AS query_vector")
    return vectors.ensemble(prompts, ["query_id"], "query_vector")


QV = """dm AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM vectors, unnest(range(1, 65)) AS u(i)),
qm AS (SELECT 'q_' || CAST(floor(vec_id / 4) AS BIGINT) AS query_id, i, avg(x) AS x FROM dm GROUP BY ALL),
qv AS (SELECT query_id, list(x ORDER BY i) AS qvec, sqrt(sum(x * x)) AS qn FROM qm GROUP BY query_id)"""
COS = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), qvec), 12)"
CANDIDATES = f"""{QV}, sc AS (SELECT query_id, v.tile_id, collection, {COS} AS score FROM qv, vectors v),
pc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, tile_id) AS place FROM sc) WHERE place <= 25),
rk AS (SELECT query_id, tile_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM (SELECT query_id, tile_id, max(score) AS score FROM pc GROUP BY ALL))"""


def fold_sql(hydrated: str, k: int) -> str:
    """Recursive twin of the greedy place selection; ``hydrated`` names a CTE with
    query_id, rank, tile_id, score, site_key, lat, lon."""
    return f"""hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM {hydrated}),
fd AS (SELECT query_id, 0::BIGINT AS pos, []::STRUCT(tile_id VARCHAR, rank BIGINT, score DOUBLE, site VARCHAR, lat DOUBLE, lon DOUBLE)[] AS kept FROM (SELECT DISTINCT query_id FROM hr)
 UNION ALL SELECT fd.query_id, hr.pos, CASE WHEN len(kept) >= {k} OR len(list_filter(kept, lambda p: p.site = hr.site_key OR (abs(p.lat - hr.lat) < 0.002 AND abs(p.lon - hr.lon) < 0.002))) > 0 THEN kept
  ELSE list_append(kept, {{'tile_id': hr.tile_id, 'rank': hr.rank, 'score': hr.score, 'site': hr.site_key, 'lat': hr.lat, 'lon': hr.lon}}) END FROM fd JOIN hr ON hr.query_id = fd.query_id AND hr.pos = fd.pos + 1),
fl AS (SELECT query_id, unnest(kept) AS h FROM (SELECT query_id, arg_max(kept, pos) AS kept FROM fd GROUP BY query_id))"""


@query("m01_unit_vectors", ["vectors"], """WITH n AS (SELECT tile_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nn, embedding FROM vectors)
SELECT tile_id, list_transform(embedding, lambda x: round(x::DOUBLE / CASE WHEN nn = 0 THEN 1 ELSE nn END, 9)) AS unit_vector FROM n""")
def m01(spark, d):
    return vec(spark, d).select("tile_id", F.transform(vectors.unit(c("embedding")), lambda x: F.round(x, 9)).alias("unit_vector"))


@query("m05_prompt_ensemble", ["vectors"], f"""WITH {QV} SELECT query_id, list_transform(qvec, lambda x: round(x / qn, 9)) AS query_vector FROM qv""")
def m05(spark, d):
    return queries_of(spark, d).select("query_id", F.transform("query_vector", lambda x: F.round(x, 9)).alias("query_vector"))


@query("t01_search_candidates", ["vectors"], f"WITH {CANDIDATES} SELECT query_id, tile_id, round(score, 9) AS score, rank FROM rk")
def t01(spark, d):
    return search.search_vectors(queries_of(spark, d), vec(spark, d), K_TOP).select("query_id", "tile_id", F.round("score", 9).alias("score"), "rank")


@query("t01_filtered_search", ["vectors", "obs"], f"""WITH ok AS (SELECT tile_id FROM obs WHERE sensor IN {SENTINELS} AND cloud_pct <= 0.6 AND acquisition_date >= TIMESTAMP '2024-01-01 06:00:00'), {QV},
sc AS (SELECT query_id, v.tile_id, {COS} AS score FROM qv, vectors v WHERE collection = 'tile_embeddings' AND v.tile_id IN (SELECT tile_id FROM ok))
SELECT query_id, tile_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM sc) WHERE rank <= 25""")
def t01_filtered(spark, d):
    from ..operators import filters
    tiles = table(spark, d, "obs").where(filters.search_filter("sentinel-2", "2024-01-01 06:00:00", None, 0.0, 60.0))
    kept = filters.restrict(vec(spark, d).where(c("collection").isin(filters.collections_for("sentinel-2"))), tiles)
    return search.search_vectors(queries_of(spark, d), kept, K_TOP).select("query_id", "tile_id", F.round("score", 9).alias("score"), "rank")


@query("u01_collection_union", ["vectors"], """WITH u AS (SELECT tile_id, collection, (vec_id % 83) / 83 AS score FROM vectors UNION ALL SELECT tile_id, 'maxar_tile_embeddings', (vec_id % 71) / 71 FROM vectors)
SELECT tile_id, max(score)::DOUBLE AS score FROM u GROUP BY tile_id""")
def u01(spark, d):
    a = vec(spark, d).selectExpr("'q' AS query_id", "tile_id", "(vec_id % 83) / 83 AS score")
    b = vec(spark, d).selectExpr("'q' AS query_id", "tile_id", "(vec_id % 71) / 71 AS score")
    return a.unionByName(b).groupBy("query_id", "tile_id").agg(F.max("score").alias("score")).drop("query_id")


@query("j01_hydrated_hits", ["vectors", "obs"], f"""WITH {CANDIDATES} SELECT query_id, rank, tile_id, scene_id, site_key, sensor, round_even(score, 4)::DOUBLE AS score FROM rk JOIN obs USING (tile_id)""")
def j01(spark, d):
    hits = search.search_vectors(queries_of(spark, d), vec(spark, d), K_TOP)
    return search.hydrate(hits, table(spark, d, "obs")).select("query_id", "rank", "tile_id", "scene_id", "site_key", "sensor", F.bround("score", 4).alias("score"))


HYDRATED = "hy AS (SELECT query_id, rank, rk.tile_id, score, site_key, centroid_lat AS lat, centroid_lon AS lon FROM rk JOIN obs USING (tile_id))"


@query("t03_distinct_places", ["vectors", "obs"], f"WITH {CANDIDATES}, {HYDRATED}, {fold_sql('hy', K_TOP)} SELECT query_id, h.rank AS rank, h.tile_id AS tile_id, round(h.score, 9) AS score FROM fl")
def t03(spark, d):
    hits = search.hydrate(search.search_vectors(queries_of(spark, d), vec(spark, d), K_TOP), table(spark, d, "obs"))
    return search.spatially_distinct(hits, K_TOP).select("query_id", "rank", "tile_id", F.round("score", 9).alias("score"))


@query("t09_image_search", ["vectors", "obs"], f"""WITH {CANDIDATES}, {HYDRATED}, {fold_sql('hy', K_TOP)},
v AS (SELECT fl.query_id, h.tile_id AS tile_id, round_even(h.score, 4)::DOUBLE AS score, o.sensor, o.mean_ndvi + 0.0003 AS mean_ndvi, o.mean_ndwi + 0.0003 AS mean_ndwi, o.mean_ndbi + 0.0003 AS mean_ndbi FROM fl JOIN obs o ON o.tile_id = h.tile_id),
x AS (SELECT *, coalesce(mean_ndvi, 0) AS v, coalesce(mean_ndwi, -0.2) AS w, coalesce(mean_ndbi, 0) AS b FROM v)
SELECT query_id, tile_id, score, {DESC_SQL} AS spot_description FROM x WHERE score >= 0.65""")
def t09(spark, d):
    tiles = table(spark, d, "obs").withColumns({f"mean_{n}": c(f"mean_{n}") + 0.0003 for n in ("ndvi", "ndwi", "ndbi")})
    found = search.search(queries_of(spark, d), vec(spark, d), tiles, K_TOP, cutoff=0.65)
    return found.select("query_id", "tile_id", F.bround("score", 4).alias("score"), "spot_description")


SIMILAR = """sc AS (SELECT s.tile_id AS query_id, v.tile_id, v.collection, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 12) AS score FROM vectors s, vectors v),
pc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, tile_id) AS place FROM sc) WHERE place <= 20),
rk AS (SELECT query_id, tile_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS rank FROM pc WHERE score >= 0.3 AND tile_id <> query_id)"""


@query("t02_similar_tiles", ["vectors", "obs"], f"WITH {SIMILAR}, {HYDRATED.replace('FROM rk JOIN obs USING (tile_id)', 'FROM rk JOIN obs USING (tile_id) WHERE rank <= 20')}, {fold_sql('hy', 10)} SELECT query_id, h.rank AS rank, h.tile_id AS tile_id, round(h.score, 9) AS score FROM fl")
def t02(spark, d):
    v = vec(spark, d)
    out = search.similar_tiles(v.select("tile_id"), v, table(spark, d, "obs"), 10, 0.3)
    return out.select("query_id", "rank", "tile_id", F.round("score", 9).alias("score"))


@query("t04_newest_page", ["obs"], """SELECT tile_id, acquisition_date, (SELECT count(*) FROM obs) AS total FROM obs ORDER BY acquisition_date DESC, obs_id LIMIT 100 OFFSET 200""")
def t04(spark, d):
    return search.page(table(spark, d, "obs"), [c("acquisition_date").desc(), c("obs_id")], 100, 200).select("tile_id", "acquisition_date", "total")


@query("j03_cluster_cards", ["vectors", "obs"], """WITH cl AS (SELECT 'cluster_' || cluster_no AS cluster_id, CASE WHEN cluster_no % 2 = 0 THEN 'Label ' || cluster_no END AS label, min(tile_id) || CASE WHEN cluster_no % 3 = 0 THEN 'x' ELSE '' END AS representative_tile_id, count(*) AS tile_count FROM vectors GROUP BY cluster_no)
SELECT cluster_id, coalesce(label, 'Cluster ' || cluster_id) AS label, representative_tile_id, tile_count, centroid_lat, sensor FROM cl LEFT JOIN obs ON obs.tile_id = representative_tile_id""")
def j03(spark, d):
    cl = vec(spark, d).groupBy("cluster_no").agg(F.min("tile_id").alias("t"), F.count(F.lit(1)).alias("tile_count")).selectExpr(
        "concat('cluster_', cluster_no) AS cluster_id", "CASE WHEN cluster_no % 2 = 0 THEN concat('Label ', cluster_no) END AS label",
        "concat(t, CASE WHEN cluster_no % 3 = 0 THEN 'x' ELSE '' END) AS representative_tile_id", "tile_count")
    return clusters.cluster_cards(cl, table(spark, d, "obs")).select("cluster_id", "label", "representative_tile_id", "tile_count", "centroid_lat", "sensor")


@query("j07_orphans", ["vectors", "obs"], """SELECT v.tile_id, 'tile' AS missing FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN tile_id || '_x' ELSE tile_id END AS tile_id FROM vectors) v WHERE v.tile_id NOT IN (SELECT tile_id FROM obs)
UNION ALL SELECT tile_id, 'vector' FROM obs WHERE tile_id NOT IN (SELECT CASE WHEN vec_id % 9 = 0 THEN tile_id || '_x' ELSE tile_id END FROM vectors)""")
def j07(spark, d):
    v = vec(spark, d).selectExpr("CASE WHEN vec_id % 9 = 0 THEN concat(tile_id, '_x') ELSE tile_id END AS tile_id")
    return search.orphans(v, table(spark, d, "obs"))


MEDOIDS = """ce AS (SELECT cluster_no, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM vectors, unnest(range(1, 65)) AS u(i) GROUP BY ALL), cv AS (SELECT cluster_no, list(m ORDER BY i) AS centre FROM ce GROUP BY cluster_no),
aw AS (SELECT cluster_no, tile_id, round(list_distance(CAST(embedding AS DOUBLE[]), centre), 9) AS away FROM vectors JOIN cv USING (cluster_no)),
md AS (SELECT cluster_no, min_by(tile_id, (away, tile_id)) AS representative_tile_id, count(*) AS tile_count, min(away) AS medoid_distance FROM aw GROUP BY cluster_no)"""


@query("a21_medoids", ["vectors"], f"WITH {MEDOIDS} SELECT * FROM md")
def a21(spark, d):
    return clusters.medoids(vec(spark, d), "cluster_no")


@query("a21_cluster_profile", ["vectors", "obs"], f"""WITH {MEDOIDS}, fx AS (SELECT cluster_no, avg(mean_ndvi) AS v, avg(mean_ndwi) AS w, avg(mean_ndbi) AS b, max(sensor) AS sensor FROM vectors LEFT JOIN obs USING (tile_id) GROUP BY cluster_no), j AS (SELECT *, cluster_no AS n FROM md JOIN fx USING (cluster_no))
SELECT cluster_no, representative_tile_id, tile_count, round(v, 9) AS avg_ndvi, round(w, 9) AS avg_ndwi, round(b, 9) AS avg_ndbi, sensor, {LABEL_SQL} AS label FROM j""")
def a21_profile(spark, d):
    df = clusters.cluster_profile(vec(spark, d), table(spark, d, "obs"), "cluster_no")
    return df.select("cluster_no", "representative_tile_id", "tile_count", *[F.round(f"avg_{n}", 9).alias(f"avg_{n}") for n in ("ndvi", "ndwi", "ndbi")], "sensor", "label")


@query("a22_cluster_totals", ["vectors", "obs"], """WITH l AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE cluster_no END AS lab FROM vectors)
SELECT count(DISTINCT lab) FILTER (WHERE lab <> -1) AS clusters, count(*) FILTER (WHERE lab <> -1) AS clustered_tiles, count(*) FILTER (WHERE lab = -1) AS noise_tiles, max(acquisition_date) AS last_run FROM l LEFT JOIN obs USING (tile_id)""")
def a22(spark, d):
    df = vec(spark, d).withColumn("lab", F.expr("CASE WHEN vec_id % 7 = 0 THEN -1 ELSE cluster_no END")).join(table(spark, d, "obs").select("tile_id", "acquisition_date"), "tile_id", "left")
    return df.agg(F.count_distinct(F.when(c("lab") != -1, c("lab"))).alias("clusters"), F.count_if(c("lab") != -1).alias("clustered_tiles"),
                  F.count_if(c("lab") == -1).alias("noise_tiles"), F.max("acquisition_date").alias("last_run"))


@query("j08_cluster_members", ["vectors"], f"""WITH {MEDOIDS} SELECT representative_tile_id AS seed_id, v.tile_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 9) AS score
FROM md JOIN vectors s ON s.tile_id = md.representative_tile_id JOIN vectors v ON v.cluster_no = md.cluster_no""")
def j08(spark, d):
    v = vec(spark, d)
    seeds = clusters.medoids(v, "cluster_no").select(c("representative_tile_id").alias("tile_id")).join(v, "tile_id")
    return search.cluster_members(seeds, v)


@query("j14_exact_neighbours", ["vectors"], f"""WITH {SIMILAR.split('pc AS')[0].rstrip().rstrip(',')} SELECT query_id, tile_id, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS place FROM sc) WHERE place <= 8""")
def j14(spark, d):
    v = vec(spark, d)
    q = v.select(c("tile_id").alias("query_id"), c("embedding").alias("query_vector"))
    return vectors.nearest(q, v, 8).select("query_id", "tile_id", F.round("score", 9).alias("score"), "place")


def indexed(spark, d):
    v = vec(spark, d)
    return v, v.select(c("tile_id").alias("query_id"), c("embedding").alias("query_vector")), VectorIndex.build(v, fresh_path(spark, "index"))


@query("j15_approximate_neighbours")
def j15(spark, d):
    v, q, index = indexed(spark, d)
    return index.search(q, v, 8).select("query_id", "tile_id", F.round("score", 9).alias("score"), "place")


# checked is what the index promises: of the 8 nearest tiles 90 % are found, and a tenth of all pairs at most is compared exactly
@query("j15_index_recall", ["vectors"], "SELECT count(*) AS queries, true AS finds_enough, true AS compares_few FROM vectors")
def j15_recall(spark, d):
    v, q, index = indexed(spark, d)
    true = vectors.nearest(q, v, 8).select("query_id", "tile_id")
    pairs = cut_lineage(index.candidates(q))
    # the search ranks its candidates by the same exact scores and ties, so of the true nearest it finds just those that are candidates
    hits = true.join(pairs.withColumn("found", F.lit(1)), ["query_id", "tile_id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("found").alias("found"))
    n = v.agg(F.count(F.lit(1)).alias("queries"))
    return pairs.agg(F.count(F.lit(1)).alias("compared")).join(F.broadcast(hits)).join(F.broadcast(n)).select(
        "queries", (c("found") >= 0.9 * c("wanted")).alias("finds_enough"), (c("compared") <= 0.1 * c("queries") * c("queries")).alias("compares_few"))


# cluster numbers are arbitrary: checked is that every tile is in the cluster whose mean vector is nearest
@query("m02_kmeans", ["vectors"], "SELECT tile_id, true AS at_nearest FROM vectors")
def m02(spark, d):
    labels = clusters.kmeans_labels(vec(spark, d), 5)
    points = vec(spark, d).select("tile_id", vectors.unit(c("embedding")).alias("v")).join(labels, "tile_id")
    centres = vectors.mean_vectors(points, ["label"], "v", "centre").agg(F.collect_list(F.struct("label", "centre")).alias("all"))  # five rows
    away = F.transform("all", lambda x: F.struct(F.round(vectors.euclidean(c("v"), x["centre"]), 6).alias("d"), x["label"].alias("label")))
    best = F.array_min(F.transform(away, lambda x: x["d"]))
    own = F.element_at(F.filter(away, lambda x: x["label"] == c("label")), 1)["d"]
    return points.join(F.broadcast(centres)).select("tile_id", (own <= best + 1e-3).alias("at_nearest"))


@query("m03_density_clusters", ["vectors"], """WITH u AS (SELECT tile_id, list_transform(embedding, lambda x: round(x::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END, 9)) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM vectors)),
p AS MATERIALIZED (SELECT a.tile_id AS a, b.tile_id AS b FROM u a, u b WHERE list_distance(a.v, b.v) <= 0.9), core AS MATERIALIZED (SELECT a FROM p GROUP BY a HAVING count(*) >= 5),
e AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), r(id, c) AS (SELECT a, a FROM core UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id), z AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS label FROM m GROUP BY c HAVING count(*) >= 5)
SELECT tile_id, coalesce(label, -1) AS label FROM u LEFT JOIN m ON id = tile_id LEFT JOIN z USING (c)""")
def m03(spark, d):
    return clusters.density_labels(vec(spark, d), 0.9, 5, 5)


@query("m04_cluster_strategy")
def m04(spark, d):
    return clusters.cluster_archive(vec(spark, d), 0.9)


@query("k08_cluster_write_back", ["obs", "vectors"], """SELECT tile_id, CASE WHEN vec_id % 7 <> 0 THEN 'cluster_' || (cluster_no + 1) END AS cluster_id FROM obs LEFT JOIN vectors USING (tile_id)""")
def k08(spark, d):
    from ..sources import sinks
    labels = vec(spark, d).withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN -1 ELSE cluster_no END"))
    out = clusters.write_back(table(spark, d, "obs").select("tile_id", "site_key"), labels)
    return sinks.write_and_read(out, "tiles_clustered").select("tile_id", "cluster_id")


for _name in ("m03_density_clusters", "t03_distinct_places", "t09_image_search", "t02_similar_tiles"):
    ORACLES[_name] = recursive(ORACLES[_name])
