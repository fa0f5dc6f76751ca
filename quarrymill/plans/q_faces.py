"""Queries of vectors, clusters and the face plans (V*, D01, D02, D09, D10, D17-D19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.scalars import thresholds
from quarrymill.operators import vectors as ve

from . import pipelines
from .base import query

_DOT = "list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[]))"
_KNN = (
    "SELECT query_id, id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, "
    + _DOT.format("a", "b")
    + " AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round("
    + _DOT.format("a", "b")
    + ", 12) DESC, b.vec_id) AS r FROM ({0}) a, ({1}) b WHERE a.vec_id <> b.vec_id) WHERE r <= {2}"
)
_POOL = "SELECT * FROM vectors WHERE status IN ('unconfirmed', 'suggested')"
_CONFIRMED = "SELECT * FROM vectors WHERE status = 'confirmed'"


def _scored(near):
    return near.select("query_id", "id", F.round("score", 6).alias("score"))


@query("V01_V11_similar", "SELECT vec_id, round(score, 6) AS score FROM (SELECT b.vec_id, " + _DOT.format("a", "b") + " AS score FROM vectors a, vectors b WHERE a.vec_id = 3 AND b.status = 'confirmed' ORDER BY 2 DESC, 1 LIMIT 25) WHERE score >= 0.2")
def similar(c):
    three = [float(x) for x in c.vectors.filter("vec_id = 3").select("embedding").first()[0]]
    return ve.similar_to(c.vectors.filter("status = 'confirmed'"), three, 25, 0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("V02_V05_J10_W03_knn_confirmed", _KNN.format(_POOL, _CONFIRMED, 15))
def knn_confirmed(c):
    return _scored(ve.knn(c.vectors.filter("status IN ('unconfirmed', 'suggested')"), c.vectors.filter("status = 'confirmed'"), 15))


@query("V03_nearest_ignored", "SELECT query_id, id, score FROM (" + _KNN.format(_POOL, "SELECT * FROM vectors WHERE status = 'ignored'", 1) + ") WHERE score >= 0.295")
def nearest_ignored(c):
    return _scored(ve.nearest_ignored(c.vectors.filter("status IN ('unconfirmed', 'suggested')"), c.vectors.filter("status = 'ignored'"), 0.3))


@query("V06_propagated", "SELECT query_id, id, score FROM (" + _KNN.format(_POOL, "SELECT * FROM vectors WHERE label = 3 AND status = 'confirmed'", 1) + ") WHERE score >= 0.295")
def propagated(c):
    near = ve.knn(c.vectors.filter("status IN ('unconfirmed', 'suggested')"), c.vectors.filter("label = 3 AND status = 'confirmed'"), 1)
    return _scored(near.filter(F.col("score") >= 0.3 - ve.EDGE_SLACK))


_EDGES = "SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM (" + _KNN.format("SELECT * FROM vectors", "SELECT * FROM vectors", 30) + ") WHERE score >= 0.4 GROUP BY 1, 2"


@query("V07_neighbour_graph", _EDGES)
def neighbour_graph(c):
    return ve.neighbour_graph(c.vectors, 30, 0.4).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "V09_components",
    f"WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a), l AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node) SELECT node, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM l",
)
def components(c):
    return ve.numbered_clusters(ve.connected_components(ve.neighbour_graph(c.vectors, 30, 0.4)))


@query("V10_A28_centroids")
def centroids(c):
    found = ve.centroids(c.vectors.filter("status = 'confirmed'"))
    return found.select("label", "part", "n", F.round(F.element_at("embedding", 1), 4).alias("first"))


_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE round(" + _DOT.format("a", "b") + ", 12) >= 0.4"


@query(
    "V12_dbscan",
    f"WITH RECURSIVE e AS ({_NEAR}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON r.other = u.a), l AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node) SELECT node, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM l",
)
def dbscan(c):
    return ve.numbered_clusters(ve.dbscan_pairs(c.vectors, 0.6))


@query("V13_J11_A12_candidates", "SELECT vec_id, label, round(score, 6) AS score FROM (SELECT a.vec_id, b.label, max(" + _DOT.format("a", "b") + ") AS score FROM vectors a, vectors b WHERE a.status = 'unconfirmed' AND b.status = 'confirmed' GROUP BY 1, 2) WHERE score >= 0.15")
def candidates(c):
    prototypes = c.vectors.filter("status = 'confirmed'").select("label", "embedding")
    found = ve.person_candidates(c.vectors.filter("status = 'unconfirmed'"), prototypes, 0.15)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("D01_sweep")
def sweep(c):
    threshold, margin, floor = thresholds(0.65)
    said = pipelines.sweep(c.vectors, ve.centroids(c.vectors.filter("status = 'confirmed'")), threshold - 0.4, margin - 0.04, floor - 0.4, 0.2)
    return said.select("vec_id", "person", F.round("best_match_score", 3).alias("best"), "decision")


@query("D02_sweeps")
def sweeps(c):
    threshold, margin, floor = thresholds(0.65)
    return pipelines.sweeps(c.vectors, ve.centroids, threshold - 0.4, margin - 0.04, floor - 0.4).groupBy("status").agg(F.count("*").alias("n"))


_VOTES = f"""
WITH ch AS (SELECT * FROM (SELECT label AS cluster, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM vectors WHERE status = 'unconfirmed') WHERE r <= 8),
nn AS (SELECT a.cluster, b.label AS person, {_DOT.format("a", "b")} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format("a", "b")}, 12) DESC, b.vec_id) AS r FROM ch a, vectors b WHERE b.status = 'confirmed' AND a.vec_id <> b.vec_id),
said AS (SELECT cluster, person, count(*) AS votes, sum(score) AS s FROM nn WHERE r <= 5 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, round(s, 9) DESC, person) AS r FROM said),
z AS (SELECT cluster, count(*) AS n FROM ch GROUP BY 1)
SELECT cluster, person, votes, round(s / votes, 4) AS average, votes / n AS agreement, s / votes >= 0.1 AND votes / n >= 0.2 AS assign FROM w JOIN z USING (cluster) WHERE r = 1"""


@query("V08_W04_A14_A15_D09_D10_cluster_votes", _VOTES)
def cluster_votes(c):
    members = c.vectors.filter("status = 'unconfirmed'").select(F.col("label").alias("cluster"), "vec_id", "embedding")
    said = pipelines.cluster_suggestions(members, c.vectors.filter("status = 'confirmed'"), 8, 5)
    kept = pipelines.auto_assignable(said, 0.1, 0.2)
    return said.join(kept.select("cluster", F.lit(True).alias("assign")), "cluster", "left").select("cluster", "person", "votes", F.round("average", 4).alias("average"), "agreement", F.coalesce("assign", F.lit(False)).alias("assign"))


@query(
    "J18_X25_D19_matched_boxes",
    "WITH o AS (SELECT a.id, b.id AS other, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM faces a JOIN faces b ON a.photo_id = b.photo_id AND a.id <> b.id AND a.status = 'unconfirmed' AND b.status <> 'unconfirmed') SELECT id, min(other) AS match_id FROM o WHERE s - i > 0 AND i / (s - i) > 0.1 GROUP BY id",
)
def matched_boxes(c):
    return pipelines.matched_boxes(c.faces.filter("status = 'unconfirmed'"), c.faces.filter("status <> 'unconfirmed'"), 0.1)


@query(
    "D17_J09_before_birth",
    "SELECT f.id, CASE WHEN e.id IS NULL THEN f.person_tag_id END AS person_tag_id, CASE WHEN e.id IS NULL THEN f.status ELSE 'unconfirmed' END AS status FROM faces f LEFT JOIN (SELECT f.id FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.status = 'suggested' AND f.person_tag_id % 3 = 0 AND CAST(p.taken_at AS DATE) < DATE '1997-06-01') e ON e.id = f.id",
)
def before_birth(c):
    births = c.tags.filter("is_person AND id % 3 = 0").select(F.col("id").alias("born_id"), F.lit("1997-06-01").cast("date").alias("born"))
    return pipelines.before_birth(c.faces, c.photos, births).select("id", "person_tag_id", "status")


@query("D18_archived", "SELECT id, CASE WHEN status = 'unconfirmed' AND (det_score < 0.2 OR w < 40 OR h < 40) THEN 'ignored' ELSE status END AS status FROM faces")
def archived(c):
    from quarrymill.operators.filters import bad_face
    from quarrymill.operators.mutations import update_where

    return update_where(c.faces, (F.col("status") == "unconfirmed") & bad_face(0.2, 40), status=F.lit("ignored")).select("id", "status")


#: One prototype a person: the unit mean of the unit vectors of the confirmed faces.
_MEANS = """
WITH u AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM vectors WHERE status = 'confirmed' AND embedding IS NOT NULL),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM u GROUP BY 1),
m AS (SELECT label, i, avg(x / norm) AS x, count(*) AS n FROM u JOIN n USING (vec_id) GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS norm, max(n) AS n FROM m GROUP BY 1),
s AS (SELECT vec_id, label, n, list_dot_product(CAST(f.embedding AS DOUBLE[]), c.v) / c.norm AS score FROM (SELECT vec_id, embedding FROM vectors WHERE status IN ('unconfirmed', 'suggested')) f, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS rank FROM s)
"""


@query("V04_nearest_persons", _MEANS + "SELECT vec_id, label AS person, round(score, 6) AS score FROM r WHERE rank <= 5")
def nearest_persons(c):
    means = ve.centroids(c.vectors.filter("status = 'confirmed'"), clusters=1).withColumn("vec_id", F.col("label").cast("long"))
    near = ve.knn(c.vectors.filter("status IN ('unconfirmed', 'suggested')"), means, 5, skip_same=False)
    return near.select(F.col("query_id").alias("vec_id"), F.col("id").cast(dict(means.dtypes)["label"]).alias("person"), F.round("score", 6).alias("score"))


@query("A28_person_means", _MEANS + "SELECT label, n, round(v[1] / norm, 6) AS first FROM c")
def person_means(c):
    return ve.centroids(c.vectors.filter("status = 'confirmed'"), clusters=1).select("label", "n", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query(
    "D01_sweep_over_faces",
    f"""
WITH conf AS (SELECT vec_id, label, embedding, photo_id FROM vectors WHERE status = 'confirmed'),
refs AS (SELECT vec_id, label, embedding FROM vectors WHERE status = 'confirmed' AND (best_match_score IS NULL OR best_match_score >= 0.2)),
pool AS (SELECT vec_id, label, embedding, photo_id FROM vectors WHERE status IN ('unconfirmed', 'suggested') AND (det_score IS NULL OR det_score >= 0.2) AND w >= 25 AND h >= 27 AND (blur_score IS NULL OR blur_score >= 3)),
ig AS (SELECT a.vec_id FROM pool a, vectors b WHERE b.status = 'ignored' AND a.vec_id <> b.vec_id GROUP BY 1 HAVING max({_DOT.format("a", "b")}) >= 0.335 - 0.005),
nn AS (SELECT a.vec_id, b.label AS person, round({_DOT.format("a", "b")}, 12) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format("a", "b")}, 12) DESC, b.vec_id) AS r FROM pool a, refs b WHERE a.vec_id NOT IN (SELECT vec_id FROM ig)),
v AS (SELECT vec_id, person, count(*) AS votes, max(score) AS score FROM nn WHERE r <= 15 GROUP BY 1, 2),
b AS (SELECT *, coalesce(lead(score) OVER w, 0) AS runner_up, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, person)),
o AS (SELECT label AS person, count(*) AS faces FROM conf GROUP BY 1),
j AS (SELECT b.*, pool.photo_id, pool.label AS before, date_add(DATE '2000-01-01', INTERVAL (photo_id % 900) DAY) < DATE '2001-01-01' AND person % 3 = 0 AS early,
 greatest(least(0.335, 0.25), 0.335 - least(1.0, greatest(0.0, (coalesce(faces, 0) - 20) / 280)) * 0.085) AS needed FROM b JOIN pool USING (vec_id) LEFT JOIN o USING (person) WHERE k = 1),
d AS (SELECT *, CASE WHEN early THEN 'unchanged' WHEN CAST(format('{{:.2f}}', score) AS DOUBLE) >= needed AND votes >= 2 AND score - runner_up >= 0.01 THEN 'confirmed' WHEN score >= 0.2 THEN 'suggested' ELSE 'unchanged' END AS said FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY photo_id, person, said ORDER BY score DESC, vec_id) AS turn FROM d),
x AS (SELECT *, CASE WHEN said = 'confirmed' AND person % 4 <> 1 AND (turn > 1 OR EXISTS (SELECT 1 FROM conf WHERE conf.photo_id = t.photo_id AND conf.label = t.person)) THEN 'unconfirmed' ELSE said END AS decision FROM t)
SELECT vec_id, CASE decision WHEN 'unchanged' THEN before WHEN 'unconfirmed' THEN NULL ELSE person END AS person, round(score, 4) AS best, decision FROM x
UNION ALL SELECT vec_id, NULL, NULL, 'ignored' FROM ig""",
)
def sweep_over_faces(c):
    """The pool of confirmed faces themselves, where no prototypes are there yet, with birth dates, quality gates and twins."""
    from quarrymill.operators.filters import good_face, reference_face

    faces = c.vectors.withColumn("taken_at", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("photo_id") % 900).cast("int")))
    people = c.vectors.select(F.col("label").alias("person")).distinct()
    births = people.filter("person % 3 = 0").withColumn("born", F.lit("2001-01-01").cast("date"))
    prototypes = c.vectors.filter("status = 'confirmed'").select("label", "vec_id", "embedding", "best_match_score")
    said = pipelines.sweep(faces, prototypes, 0.335, 0.01, 0.25, 0.2, births=births, gate=good_face(0.2, 0, 3) & (F.col("w") >= 25) & F.coalesce(F.col("h") >= 27, F.lit(False)), reference=reference_face(0.2), twins=people.filter("person % 4 = 1"))
    return said.select("vec_id", "person", F.col("best_match_score").alias("best"), "decision")


@query("V02_V04_graph_index", "SELECT count(*) AS queries, TRUE AS reached FROM vectors WHERE status IN ('unconfirmed', 'suggested')")
def graph_index(c):
    """Nearest confirmed faces from graphs into which half of them were inserted later: whether 0.95 of the exact ones are found."""
    from quarrymill.operators import graph_index as gi
    from quarrymill.operators.lineage import fresh_path

    confirmed, asked = c.vectors.filter("status = 'confirmed'").select("vec_id", "embedding"), c.vectors.filter("status IN ('unconfirmed', 'suggested')").select("vec_id", "embedding")
    table = gi.create_index(confirmed.filter("vec_id % 2 = 0"), fresh_path(c.spark, "graphs"), buckets=max(4, -(-confirmed.count() // gi.BUCKET_ROWS)))
    gi.insert_vectors(table, confirmed)
    table.vacuum()
    near, exact = gi.nearest(table, asked, 15), ve.knn(asked, confirmed, 15)
    hits = exact.join(near.withColumn("hit", F.lit(1)).drop("score"), ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    return asked.agg(F.count("*").alias("queries")).crossJoin(F.broadcast(hits)).select("queries", (F.col("hits") >= 0.95 * F.col("n")).alias("reached"))  # one row each


@query("V12_V07_radius_join", "SELECT a.vec_id AS a, b.vec_id AS b, round(" + _DOT.format("a", "b") + ", 6) AS score FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE round(" + _DOT.format("a", "b") + ", 12) >= 0.45")
def radius_join(c):
    from quarrymill.operators.radius_join import within_radius

    return within_radius(c.vectors, 0.45, pivots=16).select("a", "b", F.round("score", 6).alias("score"))


_DETECTED = f"""
WITH det AS (SELECT f.id AS det_id, photo_id, x, y, w, h, det_score, embedding FROM faces f JOIN embeddings e ON e.vec_id = f.id % 500 WHERE status = 'unconfirmed' AND coalesce(det_score, 1) >= 0.1),
kn AS (SELECT id, photo_id, x, y, w, h, id % 2 = 0 AS has_vector, CASE WHEN id % 3 > 0 THEN person_tag_id END AS person, status FROM faces WHERE status <> 'unconfirmed'),
ov AS (SELECT d.det_id, k.id, greatest(0, least(d.x + d.w, k.x + k.w) - greatest(d.x, k.x)) * greatest(0, least(d.y + d.h, k.y + k.h) - greatest(d.y, k.y)) AS i, d.w * d.h + k.w * k.h AS s FROM det d JOIN kn k ON k.photo_id = d.photo_id),
met AS (SELECT det_id, min(id) AS face FROM ov WHERE i > 0 AND i / (s - i) > 0.1 GROUP BY 1),
best AS (SELECT det_id, arg_min(label, (-score, vec_id)) AS who, max(score) AS score FROM (SELECT d.det_id, c.vec_id, c.label, round({_DOT.format("d", "c")}, 12) AS score FROM det d, vectors c WHERE c.status = 'confirmed') GROUP BY 1),
ign AS (SELECT det_id FROM (SELECT d.det_id, round({_DOT.format("d", "c")}, 12) AS score FROM det d, vectors c WHERE c.status = 'ignored') GROUP BY 1 HAVING max(score) >= 0.5)
"""


def _detected(c):
    e = c.table("embeddings").select("vec_id", "embedding")
    found = c.faces.filter("status = 'unconfirmed'").join(e, F.col("id") % 500 == F.col("vec_id")).select(F.col("id").alias("det_id"), "photo_id", "x", "y", "w", "h", "det_score", "embedding")
    known = c.faces.filter("status <> 'unconfirmed'").select("id", "photo_id", "x", "y", "w", "h", (F.col("id") % 2 == 0).alias("has_vector"), F.when(F.col("id") % 3 > 0, F.col("person_tag_id")).alias("person"), "status")
    return pipelines.detected(found, known, c.vectors.filter("status = 'confirmed'"), c.vectors.filter("status = 'ignored'"), 0.5, 0.3, 0.1, 0.1)


@query(
    "D19_faces_met_by_a_scan",
    _DETECTED
    + """, f AS (SELECT m.face, arg_max(d.det_score, m.det_id) AS score, min(m.det_id) AS first_det FROM met m JOIN det d USING (det_id) GROUP BY 1)
SELECT k.id, round(f.score, 4) AS det_score, CASE WHEN NOT has_vector THEN first_det END AS det_id, coalesce(k.person, CASE WHEN NOT has_vector AND b.score >= 0.3 THEN b.who END) AS person,
CASE WHEN k.person IS NULL AND NOT has_vector AND b.score >= 0.3 THEN CASE WHEN b.score >= 0.5 THEN 'confirmed' ELSE 'suggested' END ELSE k.status END AS status FROM f JOIN kn k ON k.id = f.face LEFT JOIN best b ON b.det_id = f.first_det""",
)
def faces_met(c):
    return _detected(c)[0]


@query(
    "D19_new_faces_of_a_scan",
    _DETECTED
    + """SELECT d.det_id, d.photo_id, CASE WHEN i.det_id IS NULL AND b.score >= 0.3 THEN b.who END AS person, CASE WHEN i.det_id IS NOT NULL THEN 'ignored' WHEN b.score >= 0.5 THEN 'confirmed' WHEN b.score >= 0.3 THEN 'suggested' ELSE 'unconfirmed' END AS status,
CASE WHEN i.det_id IS NULL AND b.score >= 0.3 THEN CAST(format('{:.2f}', b.score) AS DOUBLE) END AS best_match_score FROM det d LEFT JOIN best b USING (det_id) LEFT JOIN ign i USING (det_id) WHERE d.det_id NOT IN (SELECT det_id FROM met)""",
)
def new_faces(c):
    return _detected(c)[1]
