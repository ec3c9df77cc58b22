"""Vectors and clusters, with SQL where order does not decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl, geo, vectors
from .catalog import query


@query("""WITH x AS (SELECT id, regexp_replace(lower(text),'\\s+','','g') AS f FROM messages WHERE text <> ''), g AS (SELECT id, f[i:i+n-1] AS gram, count(*) AS c FROM (SELECT id, f, n, unnest(range(1, length(f)-n+2)) AS i FROM x, (SELECT unnest([1,2,3]) AS n)) WHERE f <> '' GROUP BY 1,2),
s AS (SELECT id, cast(cast('0x'||substr(sha256(gram),1,8) AS bigint) % 384 AS integer) AS index, sum(CASE WHEN cast('0x'||substr(sha256(gram),9,2) AS integer) % 2 = 0 THEN c ELSE -c END) AS v FROM g GROUP BY 1,2 HAVING v <> 0), n AS (SELECT id, sqrt(cast(sum(v*v) AS double)) AS norm FROM s GROUP BY 1)
SELECT s.id, s.index, cast(v AS double)/norm AS value FROM s JOIN n USING (id)""")
def hashed_text_vectors(t):
    return cl.text_vectors(t("messages").where("text <> ''"), "id", "text")


@query("SELECT id, sha256(text) AS content_hash FROM messages WHERE trim(text) <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM messages WHERE message_type = 'image' AND text IS NOT NULL)")
def texts_to_embed(t):
    """Messages whose content no image message bears, as texts without a vector yet."""
    m = t("messages").select("id", "text", "message_type")
    have = m.where("message_type = 'image' and text is not null").select(F.sha2("text", 256).alias("content_hash")).distinct()
    existing = m.withColumn("content_hash", F.sha2("text", 256)).join(have, "content_hash", "left_semi").select("id", "content_hash", F.lit("a").alias("embedding_model"))
    return cl.unhashed(m, existing, ["id"], "text", "a").select("id", "content_hash")


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def vector_bytes(t):
    """Vectors written as bytes and read again."""
    rows = t("embeddings").select("vec_id", F.size("embedding").alias("d"), cl.encoded(F.col("embedding")).alias("b"))
    read = rows.select("vec_id", cl.decoded(F.col("b"), F.col("d")).alias("v"))
    return read.select("vec_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).cast("double").alias("first"), F.get("v", F.lit(63)).cast("double").alias("last"))


@query("SELECT media_id, max(greatest(0::double, least(1::double, cast(embedding[1] AS double)*4))) AS score FROM media_vectors WHERE status='success' GROUP BY 1")
def best_vector_of_media(t):
    scores = t("media_vectors").where("status = 'success'").select("media_id", "embedding_type", (F.get("embedding", F.lit(0)).cast("double") * 4).alias("s"))
    return cl.best_of_each(scores, "media_id", "embedding_type", "s").select("media_id", "score")


_EDGES = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id<b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])>=0.4"
_ROOTS = f"e AS ({_EDGES}), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), q(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT g.b, q.root FROM q JOIN g ON g.a=q.id WHERE q.root<g.b), r AS (SELECT id, min(root) AS root FROM q GROUP BY 1)"


def _edges(t):
    return vectors.threshold_edges(t("embeddings"), "vec_id", "embedding", 0.4)


@query(f"WITH RECURSIVE {_ROOTS} SELECT id, root FROM r")
def vector_components(t):
    return cl.components(t("embeddings").select(F.col("vec_id").alias("id")), _edges(t))


@query(f"""WITH RECURSIVE {_ROOTS}, k AS (SELECT root FROM r GROUP BY 1 HAVING count(*)>=3), c AS (SELECT r.root AS cluster, r.id, unnest(v.embedding)::DOUBLE AS x, generate_subscripts(v.embedding,1) AS i FROM r JOIN k USING (root) JOIN embeddings v ON v.vec_id=r.id), m AS (SELECT cluster, i, avg(x) AS m FROM c GROUP BY 1,2), n AS (SELECT cluster, sqrt(sum(m*m)) AS norm FROM m GROUP BY 1),
d AS (SELECT cluster, id, sum(x*m) AS dot, sqrt(sum(x*x)) AS own FROM c JOIN m USING (cluster, i) GROUP BY 1,2), f AS (SELECT cluster, id, round(1-dot/(own*norm),6) AS distance FROM d JOIN n USING (cluster)), a AS (SELECT cluster, arg_min(id,(distance,id)) AS one, round(greatest(0::double,least(1-avg(distance),1::double)),4) AS confidence FROM f GROUP BY 1)
SELECT cluster, id, distance, confidence, id=one AS is_representative FROM f JOIN a USING (cluster)""")
def vector_clusters(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cl.vector_clusters(rows, _edges(t), 3)


@query("WITH r AS (SELECT q.vec_id AS case_id, q.label=v.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id%20=0 AND v.vec_id<>q.vec_id), b AS (SELECT case_id, min(CASE WHEN relevant THEN rank END) AS rank FROM r WHERE rank<=5 GROUP BY 1) SELECT count(*) AS cases, avg(CASE WHEN rank<=1 THEN 1.0::double ELSE 0 END) AS top1, avg(CASE WHEN rank<=3 THEN 1.0::double ELSE 0 END) AS recall3, avg(CASE WHEN rank<=5 THEN 1.0::double ELSE 0 END) AS recall5 FROM b")
def retrieval_benchmark(t):
    """Whether the nearest vectors of each 20th one bear its label: top-1 accuracy and recall at 3 and 5."""
    from ..operators.statistics import ranking_metrics

    v = t("embeddings")
    near = vectors.cosine_top(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    of = lambda name, label: v.select(F.col("vec_id").alias(name), F.col("label").alias(label))
    rows = near.join(of("query_id", "ql"), "query_id").join(of("vec_id", "vl"), "vec_id")
    return ranking_metrics(rows.select(F.col("query_id").alias("case_id"), "rank", (F.col("ql") == F.col("vl")).alias("relevant")))


@query("SELECT 'lp_media_'||id AS id, id AS media_id, coalesce(captured_at,fallback_captured_at) AS captured_at, gps_lat AS lat, gps_lon AS lon, 'exact_private' AS privacy_level FROM media WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND coalesce(captured_at,fallback_captured_at) <> ''")
def location_points(t):
    return cl.location_points(t("media"))


@query()
def gps_clusters(t):
    """Leader clusters of 100 metres; they depend on order, so there is no SQL."""
    return cl.place_clusters(cl.location_points(t("media"))).select("cluster_id", "point_count", F.round("centroid_lat", 7).alias("centroid_lat"), F.round("centroid_lon", 7).alias("centroid_lon"), F.round("radius_m", 3).alias("radius_m"), "first_seen_at", "last_seen_at")


@query()
def gps_candidates(t):
    """Candidates for places with the registered place next to each."""
    made = cl.place_candidates(cl.location_points(t("media")))
    places = t("places").select(F.col("id").alias("place_id"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), "radius_m")
    near = geo.nearest_within(made.select("cluster_id", "lat", "lon"), "cluster_id", places, "place_id", 0.01).select("cluster_id", "place_id")
    return made.join(near, "cluster_id", "left")


@query("SELECT id, CASE WHEN privacy_level='sensitive' THEN '非表示' ELSE printf('%.3f, %.3f', lat, lon) END AS shown, printf('%.6f, %.6f', lat, lon) AS exact, printf('%.4f,%.4f', lat, lon) AS cell FROM places")
def coordinate_labels(t):
    c = F.col
    return t("places").select("id", cl.coordinate_label(c("lat"), c("lon"), c("privacy_level"), False).alias("shown"), cl.coordinate_label(c("lat"), c("lon"), c("privacy_level"), True).alias("exact"), geo.coarse(c("lat"), c("lon")).alias("cell"))


@query("WITH k AS (SELECT 'pc_'||substr(place_id,7) AS cluster_id, count(*) AS point_count, CASE WHEN count(*)>20 THEN 'reviewed' ELSE 'unreviewed' END AS status FROM media_places GROUP BY 1) SELECT k.cluster_id, k.point_count, k.status, p.id AS place_id, p.display_name, coalesce(p.hidden,0)=1 AS hidden FROM k LEFT JOIN places p USING (cluster_id) WHERE point_count>=2 AND p.id IS NOT NULL")
def cluster_listing(t):
    made = t("media_places").groupBy(F.concat(F.lit("pc_"), F.substr("place_id", F.lit(7))).alias("cluster_id")).agg(F.count("*").alias("point_count"))
    made = made.withColumn("status", F.when(F.col("point_count") > 20, "reviewed").otherwise("unreviewed"))
    return cl.cluster_listing(made, t("places"), named=True, least=2).select("cluster_id", "point_count", "status", "place_id", "display_name", "hidden")


@query("SELECT p.id AS person_id, count(DISTINCT pc.cluster_id) AS clusters, count(DISTINCT fm.face_id) AS faces FROM persons p LEFT JOIN person_clusters pc ON pc.person_id = p.id LEFT JOIN face_members fm ON fm.cluster_id = pc.cluster_id GROUP BY 1")
def person_cluster_overview(t):
    sizes = t("person_clusters").join(t("face_members"), "cluster_id").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("face_id").alias("faces"))
    own = t("person_clusters").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("cluster_id").alias("clusters"))
    return t("persons").select("id").join(own, "id", "left").join(sizes, "id", "left").fillna(0).select(F.col("id").alias("person_id"), "clusters", "faces")


@query("SELECT f.id, f.media_id, f.review_status, coalesce(m.captured_at,m.fallback_captured_at) AS captured_at FROM faces f JOIN media m ON m.id=f.media_id WHERE f.status='success' AND f.review_status='pending'")
def face_listing(t):
    m = t("media").select(F.col("id").alias("media_id"), F.coalesce("captured_at", "fallback_captured_at").alias("captured_at"))
    return t("faces").where("status = 'success' and review_status = 'pending'").join(m, "media_id").select("id", "media_id", "review_status", "captured_at")


@query("SELECT c.id AS cluster_id, fm.face_id, fm.distance_to_centroid, f.media_id, pc.person_id FROM face_clusters c JOIN face_members fm ON fm.cluster_id=c.id JOIN faces f ON f.id=fm.face_id LEFT JOIN person_clusters pc ON pc.cluster_id=c.id WHERE c.status='reviewed'")
def cluster_details(t):
    c = t("face_clusters").where("status = 'reviewed'").select(F.col("id").alias("cluster_id"))
    f = t("faces").select(F.col("id").alias("face_id"), "media_id")
    return c.join(t("face_members"), "cluster_id").join(f, "face_id").join(t("person_clusters").select("cluster_id", "person_id"), "cluster_id", "left").select("cluster_id", "face_id", "distance_to_centroid", "media_id", "person_id")


@query("SELECT count(*) AS unlinked FROM face_clusters c WHERE status='reviewed' AND NOT EXISTS (SELECT 1 FROM person_clusters p WHERE p.cluster_id=c.id AND p.is_verified=1)")
def unlinked_clusters(t):
    linked = t("person_clusters").where("is_verified = 1").select(F.col("cluster_id").alias("id"))
    return t("face_clusters").where("status = 'reviewed'").join(linked, "id", "left_anti").agg(F.count("*").alias("unlinked"))
