"""Queries for distances, quantiles and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import distance as D
from folioscope.operators import neighbours as N
from folioscope.operators.quantiles import group_quantiles
from folioscope.plans import sql as Q
from folioscope.plans.catalog_text import MAX_FEATURES, tokens
from folioscope.plans.centroid_model import CentroidModel, fit_centroid_model
from folioscope.plans.registry import Tables, register

CENTROIDS = "WITH " + Q.centroids(MAX_FEATURES)
MODEL = "WITH " + Q.class_model(MAX_FEATURES)


def centroid_model(t: Tables) -> CentroidModel:
    return fit_centroid_model(tokens(t), "doc_id", "lang", "tokens", MAX_FEATURES)


def measured(t: Tables) -> DataFrame:
    m = centroid_model(t)
    return D.centroid_distance(m.documents, "lang", "features", m.size).select("doc_id", "lang", "distance_to_centroid")


@register(
    "d1_centroid_distance",
    CENTROIDS + " SELECT doc_id, lang, round(d, 6) AS distance_to_centroid FROM documents LEFT JOIN dist USING (doc_id)",
)
def centroid_distance(t: Tables) -> DataFrame:
    return measured(t).withColumn("distance_to_centroid", F.round("distance_to_centroid", 6))


@register(
    "j3_class_centroid_lookup",
    CENTROIDS + """ SELECT doc_id, count(*) AS n_terms, round(sum(w.w * s), 6) AS product
    FROM w JOIN cs USING (lang, term) GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    from folioscope.operators.vectorize import vector_entries

    m = centroid_model(t)
    rows = D.dense_rows(m.sums, "lang", m.size)
    joined = m.documents.join(D.measured_broadcast(rows, D.broadcast_rows(m.size)), "lang")
    entries = joined.select("doc_id", "values", vector_entries("features").alias("e"))
    out = entries.select(
        "doc_id", F.size("e").cast("long").alias("n_terms"), F.round(D.dot(F.col("e"), F.col("values")), 6).alias("product")
    )
    return out.where(F.col("n_terms") > 0)


FLAGGED = CENTROIDS + """,
full_d AS (SELECT doc_id, lang, coalesce(d, 1.0) AS d FROM documents LEFT JOIN dist USING (doc_id)),
q AS (SELECT lang, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3, count(*) AS n
      FROM full_d GROUP BY lang),
flagged AS (SELECT doc_id, lang, d, n >= 4 AND d > q3 + 1.5 * (q3 - q1) AS far FROM full_d JOIN q USING (lang))"""


@register(
    "d2_centroid_outliers",
    FLAGGED + " SELECT doc_id, lang, round(d, 6) AS distance_au_centre, far AS is_outlier_centroid FROM flagged",
)
def centroid_outliers(t: Tables) -> DataFrame:
    m = centroid_model(t)
    out = D.centroid_outliers(m.documents, "lang", "features", m.size)
    return out.select("doc_id", "lang", F.round("distance_au_centre", 6).alias("distance_au_centre"), "is_outlier_centroid")


INTRA = """intra AS (SELECT lang, n, CASE WHEN n < 2 THEN 0.0 ELSE 1 - (sq - nz) / (n * (n - 1))::DOUBLE END AS d FROM
  (SELECT lang, count(*) AS n FROM documents GROUP BY lang) JOIN (SELECT lang, sum(s * s) AS sq FROM cs GROUP BY lang)
  USING (lang) JOIN (SELECT lang, count(DISTINCT doc_id) AS nz FROM w GROUP BY lang) USING (lang))"""


@register("d3_intra_class_distance", f"{CENTROIDS}, {INTRA} SELECT lang, n, round(d, 6) AS intra_distance FROM intra")
def intra_class_distance(t: Tables) -> DataFrame:
    m = centroid_model(t)
    out = D.intra_class_distance(m.documents, "lang", "features")
    return out.withColumn("intra_distance", F.round("intra_distance", 6))


@register(
    "j4_within_class_pairs",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    p AS (SELECT a.label, a.vec_id AS u, b.vec_id AS v, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c
          FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY ALL)
    SELECT label, (SELECT count(*) FROM embeddings k WHERE k.label = p.label) AS n, round(1 - avg(c), 6) AS intra_distance
    FROM p GROUP BY label""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    vectors = t.embeddings.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return D.intra_class_distance(vectors, "label", "v").withColumn("intra_distance", F.round("intra_distance", 6))


PAIRS = """norms AS (SELECT class, sqrt(sum(coef * coef)) AS z FROM coef GROUP BY class),
between_d AS (SELECT a.class AS class_a, b.class AS class_b,
  CASE WHEN a.class = b.class THEN 0 ELSE 1 - coalesce((SELECT sum(x.coef * y.coef) FROM coef x JOIN coef y USING (feature)
    WHERE x.class = a.class AND y.class = b.class), 0) / (a.z * b.z) END AS dist FROM norms a CROSS JOIN norms b)"""


@register("j5_class_pairs", f"{MODEL}, {PAIRS} SELECT class_a, class_b, round(dist, 6) AS dist FROM between_d")
def _(t: Tables) -> DataFrame:
    return D.class_pair_distance(centroid_model(t).coefficient_table()).withColumn("dist", F.round("dist", 6))


MATRIX = f"""{MODEL}, {PAIRS}, {INTRA},
matrix AS (SELECT class_a, class_b, CASE WHEN class_a = class_b THEN d ELSE dist END AS dist
           FROM between_d JOIN intra ON lang = class_a)"""


def matrix(t: Tables) -> DataFrame:
    m = centroid_model(t)
    return D.dissimilarity(m.coefficient_table(), D.intra_class_distance(m.documents, "lang", "features"), "lang")


@register("d4_dissimilarity_matrix", MATRIX + " SELECT class_a, class_b, round(dist, 6) AS dist FROM matrix")
def dissimilarity(t: Tables) -> DataFrame:
    return matrix(t).withColumn("dist", F.round("dist", 6))


@register("a19_grand_mean", MATRIX + " SELECT round(avg(dist), 6) AS grand_mean FROM matrix")
def _(t: Tables) -> DataFrame:
    return D.grand_mean(matrix(t)).withColumn("grand_mean", F.round("grand_mean", 6))


BOX_SQL = """box AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM v GROUP BY g),
inside AS (SELECT v.g, x, q1, median, q3, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS ok
  FROM v JOIN box USING (g))
SELECT g, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(x) FILTER (ok), 6) AS whisker_low, round(max(x) FILTER (ok), 6) AS whisker_high,
  count(*) FILTER (NOT ok) AS n_fliers FROM inside GROUP BY g"""


def rounded_box(box: DataFrame, label: str) -> DataFrame:
    measures = [F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
    return box.select(F.col(label).alias("g"), *measures, "n_fliers")


@register("a20_box_plot", f"{CENTROIDS}, v AS (SELECT lang AS g, d AS x FROM documents JOIN dist USING (doc_id)), {BOX_SQL}")
def _(t: Tables) -> DataFrame:
    return rounded_box(D.box_plot(measured(t), "lang", "distance_to_centroid"), "lang")


@register(
    "a20_box_plot_prices",
    f"WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders), {BOX_SQL}",
)
def box_plot_prices(t: Tables) -> DataFrame:
    return rounded_box(D.box_plot(t.orders, "o_orderpriority", "o_totalprice"), "o_orderpriority")


@register(
    "l22_quantiles",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3
    FROM events GROUP BY event_type""",
)
def group_quantile_query(t: Tables) -> DataFrame:
    q = group_quantiles(t.events, "event_type", "value", [0.25, 0.75])
    return q.select("event_type", "n", F.round(F.get("q", F.lit(0)), 6).alias("q1"), F.round(F.get("q", F.lit(1)), 6).alias("q3"))


@register(
    "w4_n_largest",
    CENTROIDS + " SELECT doc_id, lang, round(d, 6) AS distance_to_centroid FROM documents JOIN dist USING (doc_id) ORDER BY d DESC, doc_id LIMIT 15",
)
def _(t: Tables) -> DataFrame:
    top = D.furthest(measured(t), "distance_to_centroid", "doc_id", 15)
    return top.withColumn("distance_to_centroid", F.round("distance_to_centroid", 6))


@register(
    "w5_arg_max",
    CENTROIDS + " SELECT doc_id, round(d, 6) AS distance_to_centroid FROM dist ORDER BY d DESC, doc_id LIMIT 1",
)
def _(t: Tables) -> DataFrame:
    best = D.most_distant(measured(t), "distance_to_centroid", "doc_id")
    return best.select("doc_id", F.round("distance_to_centroid", 6).alias("distance_to_centroid"))


NEIGHBOURS = """WITH pt AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
pairs AS (SELECT a.id, a.label, b.id AS other, b.label AS other_label,
  row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS rk
  FROM pt a CROSS JOIN pt b),
near AS (SELECT * FROM pairs WHERE rk <= 10)"""


def plane(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y")
    )


@register("j6_nearest_neighbours", NEIGHBOURS + " SELECT id AS vec_id, other AS neighbour, rk AS rank FROM near")
def _(t: Tables) -> DataFrame:
    points = plane(t)
    near = N.nearest_labels(points, "vec_id", "label", "x", "y", 10)
    joined = points.join(near, (points.x == near["_x"]) & (points.y == near["_y"]))
    long = joined.select("vec_id", F.posexplode("neighbours").alias("pos", "p"))
    return long.select("vec_id", F.col("p.id").alias("neighbour"), (F.col("pos") + 1).cast("long").alias("rank"))


@register(
    "d5_neighbour_outliers",
    NEIGHBOURS + """, votes AS (SELECT id, other_label, count(*) AS n FROM near GROUP BY id, other_label),
    won AS (SELECT id, other_label, row_number() OVER (PARTITION BY id ORDER BY n DESC, other_label) AS r FROM votes)
    SELECT pt.id AS vec_id, pt.label, other_label AS parti_geographique, pt.label <> other_label AS is_outlier_knn
    FROM pt JOIN won ON won.id = pt.id AND r = 1""",
)
def neighbour_outliers(t: Tables) -> DataFrame:
    return N.neighbour_outliers(plane(t), "vec_id", "label", "x", "y", 10).drop("x", "y")
