"""Registered queries: clustering, anomaly detection, cluster metrics, PCA (K1–K13, T10/T11 wide, A13–A15)."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.operators import anomaly as AN
from scoutml.operators import cluster as CL
from scoutml.operators import cluster_metrics as CM
from scoutml.operators import hierarchy as HI
from scoutml.operators import leaderboard as LB
from scoutml.plans.fixtures import embedding_vectors

EPS, MIN_SAMPLES, LOF_K, CONTAMINATION = 1.15, 4, 10, 0.1


def _points(spark, sf) -> DataFrame:
    return embedding_vectors(spark, sf).select(F.col("row_id").alias("id"), "x", F.col("label").alias("cluster"))


def _labelings(spark, sf) -> dict[str, DataFrame]:
    """Three labelings of the embeddings: the given label, a single group, and
    the given label with classes >= 2 marked as noise."""
    p = _points(spark, sf)
    return {
        "label": p,
        "single": p.withColumn("cluster", F.lit(0)),
        "noisy": p.withColumn("cluster", F.when(F.col("cluster") < 2, F.col("cluster")).otherwise(F.lit(-1))),
    }


def silhouette_exact(spark, sf):
    """K8 (euclidean, exact) of the given labels."""
    return CM.silhouette_exact(_points(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


def silhouette_sq(spark, sf):
    """K8 in the squared-euclidean form (O(n k))."""
    return CM.silhouette_squared(_points(spark, sf)).select(F.round("silhouette", 6).alias("silhouette"))


def davies_bouldin(spark, sf):
    return CM.davies_bouldin(_points(spark, sf)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def calinski_harabasz(spark, sf):
    return CM.calinski_harabasz(_points(spark, sf)).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


def _scores(spark, sf) -> DataFrame:
    out = None
    for name, pts in _labelings(spark, sf).items():
        s = CM.score(pts).select(F.lit(name).alias("labeling"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def cluster_score_guard(spark, sf):
    """Metrics are null below two clusters; noise rows are left out."""
    return _scores(spark, sf).select("labeling", "silhouette", "davies_bouldin", F.round("calinski_harabasz", 2).alias("calinski_harabasz"))


def composite_score(spark, sf):
    """0.5 sil - 0.3 db + 0.2 ch with null-only defaults."""
    s = _scores(spark, sf)
    return s.select("labeling", F.round(CM.composite(F.col("silhouette"), F.col("davies_bouldin"), F.col("calinski_harabasz")), 3).alias("composite"))


def leaderboard_unsup(spark, sf):
    """A5, unsupervised: the labelings by silhouette, those without one last, in order of submission."""
    rows = _scores(spark, sf).withColumn("submit_order", F.array_position(F.array(*[F.lit(x) for x in ("label", "single", "noisy")]), F.col("labeling")))
    return LB.order(rows, True, "silhouette").select("position", F.col("labeling").alias("name"), "silhouette")


def cluster_counts(spark, sf):
    """Clusters found and noise points per labeling."""
    out = None
    for name, pts in _labelings(spark, sf).items():
        s = CM.counts(pts).select(F.lit(name).alias("labeling"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def _label_centres(pts: DataFrame) -> np.ndarray:
    c = CM.centroids(pts).orderBy("cluster").collect()
    return np.array([r["c"] for r in c], dtype=float)


def kmeans_assign(spark, sf):
    """K1 assignment step: nearest of the per-label centres."""
    p = _points(spark, sf)
    return CL.assign_nearest(p, _label_centres(p)).select(F.col("id").alias("row_id"), "cluster")


def lof(spark, sf):
    """K6 with k = 10."""
    return AN.lof_scores(_points(spark, sf), LOF_K).select(F.col("id").alias("row_id"), F.round("lof", 6).alias("lof"))


def contamination_cut(spark, sf):
    """K7 + F11: rows whose LOF exceeds the 90th percentile are anomalies."""
    s = AN.lof_scores(_points(spark, sf), LOF_K)
    return AN.contamination_cut(s, "lof", CONTAMINATION).select(F.col("id").alias("row_id"), "is_anomaly")


def dbscan_core(spark, sf):
    """K2 core step: neighbours within eps (self included) and the core flag."""
    deg = CL.neighbor_counts(_points(spark, sf).select("id", "x"), EPS)
    return deg.select(F.col("id").alias("row_id"), "n_neighbors", (F.col("n_neighbors") >= MIN_SAMPLES).alias("is_core"))


def dbscan(spark, sf):
    """K2: cluster per row (-1 = noise)."""
    return CL.dbscan(_points(spark, sf).select("id", "x"), EPS, MIN_SAMPLES).select(F.col("id").alias("row_id"), "cluster")


def kmeans(spark, sf):
    """K1: k = 10, k-means||, 5 restarts (lowest cost kept); labels per row."""
    lab = CL.kmeans(_points(spark, sf).select("id", "x"), 10, n_init=5)
    return lab.select(F.col("id").alias("row_id"), "cluster")


def gmm_full(spark, sf):
    return CL.gmm_full(_points(spark, sf).select("id", "x"), 4).select(F.col("id").alias("row_id"), "cluster")


def _gmm(cov):
    def q(spark, sf):
        lab, hist = CL.gmm_em(_points(spark, sf).select("id", "x"), 4, cov)
        return lab.select(F.col("id").alias("row_id"), "cluster")
    q.__doc__ = f"K4 with {cov} covariance: EM by aggregations."
    return q


def _agglo(linkage):
    def q(spark, sf):
        return HI.agglomerative(_points(spark, sf).select("id", "x"), 10, linkage).select(F.col("id").alias("row_id"), "cluster")
    q.__doc__ = f"K3 {linkage} linkage, 10 clusters."
    return q


def isolation_forest(spark, sf):
    """K5: scores and the contamination flag (10 %)."""
    s = AN.isolation_forest(_points(spark, sf).select("id", "x"), n_estimators=100)
    return AN.contamination_cut(s, "score", CONTAMINATION).select(F.col("id").alias("row_id"), "score", "is_anomaly")


def pca_embeddings(spark, sf):
    """T10/T11 on wide data: 2-D coordinates of the z-scored embeddings and ratios."""
    from scoutml.operators import prepare as PR

    e = embedding_vectors(spark, sf)
    d = e.select(F.size("x")).first()[0]
    wide = e.select("row_id", *[F.col("x")[j].alias(f"f{j}") for j in range(d)])
    z = PR.standard_scale(wide, [f"f{j}" for j in range(d)])
    coords, ratios = PR.pca_project(z, [f"f{j}" for j in range(d)], 2, keep=["row_id"])
    return coords.withColumn("ratios", F.lit(json.dumps([round(r, 4) for r in ratios])))


def pca_scatter(spark, sf):
    """PCA coordinates joined to each algorithm's own labels by row id."""
    from scoutml.operators import prepare as PR

    e = embedding_vectors(spark, sf)
    d = e.select(F.size("x")).first()[0]
    wide = e.select("row_id", *[F.col("x")[j].alias(f"f{j}") for j in range(d)])
    coords, _ = PR.pca_project(PR.standard_scale(wide, [f"f{j}" for j in range(d)]), [f"f{j}" for j in range(d)], 2, keep=["row_id"])
    lab = kmeans_assign(spark, sf)
    return coords.join(lab, "row_id").select("row_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"), "cluster")


def unsup_leaderboard(spark, sf):
    """The unsupervised run over all six algorithms with its full number of trials, ranked by silhouette."""
    from scoutml.plans.unsupervised import run_unsupervised

    res = run_unsupervised(embedding_vectors(spark, sf).select("row_id", "x"), ALL_ALGOS, key_col="row_id", vector_col="x")
    return res["leaderboard"]


ALL_ALGOS = ["K-Means", "DBSCAN", "Agglomerative", "Gaussian Mixture", "Isolation Forest", "Local Outlier Factor"]

QUERIES = {
    "silhouette_exact": silhouette_exact, "silhouette_sq": silhouette_sq, "davies_bouldin": davies_bouldin,
    "calinski_harabasz": calinski_harabasz, "cluster_score_guard": cluster_score_guard, "composite_score": composite_score,
    "cluster_counts": cluster_counts, "leaderboard_unsup": leaderboard_unsup, "kmeans_assign": kmeans_assign, "lof_scores": lof, "contamination_cut": contamination_cut,
    "dbscan_core": dbscan_core, "dbscan": dbscan, "kmeans": kmeans, "gmm_full": gmm_full, "gmm_diag": _gmm("diag"),
    "gmm_spherical": _gmm("spherical"), "gmm_tied": _gmm("tied"), "agglomerative_single": _agglo("single"),
    "agglomerative_ward": _agglo("ward"), "agglomerative_average": _agglo("average"),
    "agglomerative_complete": _agglo("complete"), "isolation_forest": isolation_forest,
    "pca_embeddings": pca_embeddings, "pca_scatter": pca_scatter, "unsup_leaderboard": unsup_leaderboard,
}


# ---------------------------------------------------------------- oracles
_E = "(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_CENT = f"""cen AS (SELECT label, list(m ORDER BY j) AS c FROM (
    SELECT label, j, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM {_E}) GROUP BY label, j)
  GROUP BY label)"""


def _sil_sql(lab: str, digits: int = 6, squared: bool = False) -> str:
    dist = "list_distance(a.x, b.x)" + ("^2" if squared else "")
    return f"""WITH p AS (SELECT id, x, {lab} AS c FROM {_E}), v AS (SELECT * FROM p WHERE c <> -1),
pr AS (SELECT a.id, a.c AS own, b.c, sum({dist}) AS s, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id, a.c, b.c),
sz AS (SELECT c, count(*) AS n FROM v GROUP BY c),
r AS (SELECT v.id, max(CASE WHEN pr.c = v.c THEN pr.s / pr.n END) AS a, min(CASE WHEN pr.c <> v.c THEN pr.s / pr.n END) AS b,
             any_value(sz.n) AS n_own
      FROM v LEFT JOIN pr ON pr.id = v.id JOIN sz ON sz.c = v.c GROUP BY v.id)
SELECT round(avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), {digits}) AS silhouette FROM r"""


_DB = f"""WITH {_CENT},
s AS (SELECT e.label, avg(list_distance(e.x, cen.c)) AS s FROM {_E} e JOIN cen USING (label) GROUP BY e.label),
pairs AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r
          FROM cen a JOIN cen b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM pairs"""

_CH = f"""WITH {_CENT},
g AS (SELECT list(m ORDER BY j) AS g FROM (SELECT j, avg(v) AS m FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS j FROM {_E}) GROUP BY j)),
w AS (SELECT sum(list_distance(e.x, cen.c)^2) AS w, count(*) AS n FROM {_E} e JOIN cen USING (label)),
b AS (SELECT sum(sz.n * list_distance(cen.c, g.g)^2) AS b, count(*) AS k FROM cen, g, (SELECT label, count(*) AS n FROM {_E} GROUP BY label) sz
      WHERE sz.label = cen.label)
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM w, b"""

_LABELINGS = {"label": "label", "single": "0", "noisy": "CASE WHEN label < 2 THEN label ELSE -1 END"}

_COUNTS = " UNION ALL ".join(
    f"""SELECT '{n}' AS labeling, CAST(count(DISTINCT CASE WHEN c <> -1 THEN c END) AS INTEGER) AS n_clusters_found,
        CAST(count(*) FILTER (WHERE c = -1) AS INTEGER) AS n_noise_points FROM (SELECT {e} AS c FROM embeddings)"""
    for n, e in _LABELINGS.items())

_LOF = f"""WITH nn AS (SELECT lid, rid, d FROM (
    SELECT a.id AS lid, b.id AS rid, list_distance(a.x, b.x) AS d,
           row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r
    FROM {_E} a JOIN {_E} b ON a.id <> b.id) WHERE r <= {LOF_K}),
kd AS (SELECT lid AS id, max(d) AS kd FROM nn GROUP BY lid),
lrd AS (SELECT nn.lid AS id, 1.0 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.id = nn.rid GROUP BY nn.lid),
lof AS (SELECT nn.lid AS id, avg(o.lrd) / any_value(p.lrd) AS lof FROM nn JOIN lrd o ON o.id = nn.rid JOIN lrd p ON p.id = nn.lid GROUP BY nn.lid)"""

ORACLE = {
    "silhouette_exact": _sil_sql("label"),
    "silhouette_sq": _sil_sql("label", squared=True),
    "davies_bouldin": _DB,
    "calinski_harabasz": _CH,
    "cluster_counts": _COUNTS,
    "kmeans_assign": f"""WITH {_CENT}
SELECT id AS row_id, CAST(label_c AS INTEGER) AS cluster FROM (
  SELECT e.id, cen.label AS label_c, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.x, cen.c), cen.label) AS r
  FROM {_E} e, cen) WHERE r = 1""",
    "lof_scores": _LOF + " SELECT id AS row_id, round(lof, 6) AS lof FROM lof",
    "contamination_cut": _LOF + f""", cutv AS (SELECT quantile_cont(lof, {1 - CONTAMINATION}) AS q FROM lof)
SELECT id AS row_id, CAST(lof > q AS INTEGER) AS is_anomaly FROM lof, cutv""",
    "dbscan_core": f"""SELECT a.id AS row_id, count(*) AS n_neighbors, count(*) >= {MIN_SAMPLES} AS is_core
FROM {_E} a JOIN {_E} b ON list_distance(a.x, b.x) <= {EPS} GROUP BY a.id""",
}


def _metrics_sql(lab: str) -> str:
    """silhouette / davies_bouldin / calinski_harabasz (each rounded to 4) of one labeling; nulls below two clusters."""
    v = f"(SELECT id, x, c FROM (SELECT id, x, {lab} AS c FROM {_E}) WHERE c <> -1)"
    return f"""(WITH v AS {v},
pr AS (SELECT a.id, a.c AS own, b.c, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id, a.c, b.c),
sz AS (SELECT c, count(*) AS n FROM v GROUP BY c),
r AS (SELECT v.id, max(CASE WHEN pr.c = v.c THEN pr.s / pr.n END) AS a, min(CASE WHEN pr.c <> v.c THEN pr.s / pr.n END) AS b,
             any_value(sz.n) AS n_own FROM v LEFT JOIN pr ON pr.id = v.id JOIN sz ON sz.c = v.c GROUP BY v.id),
sil AS (SELECT avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM r),
cen AS (SELECT c, list(m ORDER BY j) AS cx FROM (SELECT c, j, avg(val) AS m FROM (
          SELECT c, unnest(x) AS val, generate_subscripts(x, 1) AS j FROM v) GROUP BY c, j) GROUP BY c),
sc AS (SELECT v.c, avg(list_distance(v.x, cen.cx)) AS s FROM v JOIN cen USING (c) GROUP BY v.c),
db AS (SELECT avg(r) AS db FROM (SELECT a.c, max((sa.s + sb.s) / list_distance(a.cx, b.cx)) AS r
        FROM cen a JOIN cen b ON a.c <> b.c JOIN sc sa ON sa.c = a.c JOIN sc sb ON sb.c = b.c GROUP BY a.c)),
g AS (SELECT list(m ORDER BY j) AS g FROM (SELECT j, avg(val) AS m FROM (SELECT unnest(x) AS val, generate_subscripts(x, 1) AS j FROM v) GROUP BY j)),
w AS (SELECT sum(list_distance(v.x, cen.cx)^2) AS w, count(*) AS n FROM v JOIN cen USING (c)),
bt AS (SELECT sum(sz.n * list_distance(cen.cx, g.g)^2) AS b, count(*) AS k FROM cen, g, sz WHERE sz.c = cen.c),
ch AS (SELECT CASE WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END AS ch FROM w, bt),
ok AS (SELECT (SELECT count(*) FROM sz) >= 2 AND (SELECT count(*) FROM v) >= 2 AS ok)
SELECT CASE WHEN ok THEN round(sil, 4) END AS silhouette, CASE WHEN ok THEN round(db, 4) END AS davies_bouldin,
       CASE WHEN ok THEN round(ch, 4) END AS calinski_harabasz FROM sil, db, ch, ok)"""


_GUARD = " UNION ALL ".join(f"SELECT '{n}' AS labeling, * FROM {_metrics_sql(e)}" for n, e in _LABELINGS.items())

ORACLE["cluster_score_guard"] = f"""SELECT labeling, silhouette, davies_bouldin, round(calinski_harabasz, 2) AS calinski_harabasz
FROM ({_GUARD})"""
ORACLE["leaderboard_unsup"] = f"""SELECT CAST(row_number() OVER (ORDER BY silhouette DESC NULLS LAST, list_position(['label', 'single', 'noisy'], labeling)) AS INTEGER) AS position,
  labeling AS name, silhouette FROM ({_GUARD})"""
ORACLE["composite_score"] = f"""SELECT labeling, round(0.5 * coalesce(silhouette, -1.0) - 0.3 * coalesce(davies_bouldin, 10.0)
    + 0.2 * coalesce(calinski_harabasz, 0.0), 3) AS composite FROM ({_GUARD})"""


ORACLE["dbscan"] = f"""WITH RECURSIVE
pairs AS (SELECT a.id AS lid, b.id AS rid FROM {_E} a JOIN {_E} b ON list_distance(a.x, b.x) <= {EPS}),
core AS (SELECT lid AS id FROM pairs GROUP BY lid HAVING count(*) >= {MIN_SAMPLES}),
edges AS (SELECT lid, rid FROM pairs WHERE lid IN (SELECT id FROM core) AND rid IN (SELECT id FROM core)),
reach(id, r) AS (SELECT id, id FROM core UNION SELECT reach.id, edges.rid FROM reach JOIN edges ON edges.lid = reach.r),
comp AS (SELECT id, min(r) AS comp FROM reach GROUP BY id),
num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comp)),
core_lab AS (SELECT comp.id, num.cluster FROM comp JOIN num USING (comp)),
border AS (SELECT p.lid AS id, min(c.cluster) AS cluster FROM pairs p JOIN core_lab c ON c.id = p.rid
           WHERE p.lid NOT IN (SELECT id FROM core) GROUP BY p.lid),
lab AS (SELECT * FROM core_lab UNION ALL SELECT * FROM border)
SELECT e.id AS row_id, CAST(coalesce(lab.cluster, -1) AS INTEGER) AS cluster FROM {_E} e LEFT JOIN lab USING (id)"""
