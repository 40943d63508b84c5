"""Parts of larger results over whole tables: lookups, ranks, labels, marks, scaling, and models with given numbers."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from voxfare.functions import stats
from voxfare.operators import clusters, propensity, ranking, voice
from voxfare.plans.registry import query, rounded


@query(
    "lookup_other_names",
    """SELECT l_orderkey, l_linenumber, l_quantity, s_name, s_nationkey FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON l_suppkey = s_suppkey""",
)
def lookup_other_names(t):
    """Supplier columns on every line; a third of the suppliers are unknown."""
    known = t.supplier.filter("s_suppkey % 3 > 0").select("s_suppkey", "s_name", "s_nationkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return ranking.lookup_left(lines, known, "l_suppkey", "s_suppkey").drop("l_suppkey")


@query(
    "row_number_rank",
    """SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n DESC, p_brand) AS INTEGER) AS rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""",
)
def row_number_rank(t):
    counts = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return ranking.row_numbers(counts, [F.desc("n"), F.asc("p_brand")])


@query(
    "feature_display_names",
    """WITH f AS (SELECT DISTINCT 'seat_' || lang AS feature, 'Cabin: ' || upper(lang[1]) || lang[2:] AS label FROM documents
        UNION ALL SELECT DISTINCT 'traveller_' || source, 'Traveller: ' || upper(source[1]) || source[2:] FROM documents
        UNION ALL SELECT DISTINCT 'emotion_' || event_type, 'Emotion: ' || upper(event_type[1]) || event_type[2:] FROM events
        UNION ALL SELECT DISTINCT 'feat_wifi', 'Wi-Fi Score' FROM events UNION ALL SELECT DISTINCT 'own_' || event_type, 'Own ' || upper(event_type[1]) || event_type[2:] FROM events)
      SELECT feature, label FROM f""",
)
def feature_display_names(t):
    def named(df, prefix, c):
        return df.select(F.concat(F.lit(prefix), c).alias("feature"))

    each = [named(t.documents, "seat_", "lang"), named(t.documents, "traveller_", "source"), named(t.events, "emotion_", "event_type"), named(t.events, "own_", "event_type"), t.events.select(F.lit("feat_wifi").alias("feature"))]
    return ranking.union_all(*each).distinct().withColumn("label", propensity.display_name("feature"))


@query(
    "significance_marks",
    """SELECT mark, effect, count(*) AS n FROM (SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p IS NOT NULL THEN 'ns' END AS mark,
        CASE WHEN d >= 0.8 THEN 'Large' WHEN d >= 0.5 THEN 'Medium' WHEN d >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect
        FROM (SELECT nullif(l_discount * l_tax * 8, 0) AS p, abs(l_quantity - 25) / 25 AS d FROM lineitem)) GROUP BY 1, 2""",
)
def significance_marks(t):
    p = F.nullif(F.col("l_discount") * F.col("l_tax") * 8, F.lit(0.0))
    d = (F.col("l_quantity") - 25) / 25
    marked = t.lineitem.select(stats.stars(p).alias("mark"), stats.effect_label(d).alias("effect"))
    return marked.groupBy("mark", "effect").agg(F.count(F.lit(1)).alias("n"))


@query(
    "standardised",
    """SELECT l_returnflag, round(avg(z), 6) AS mean_z, round(stddev_samp(z), 6) AS sd_z, round(max(z), 6) AS max_z
      FROM (SELECT l_returnflag, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS z FROM lineitem) GROUP BY l_returnflag""",
)
def standardised(t):
    full = propensity.assemble(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    scaled = propensity.fit_scaler(full).transform(full).select("l_returnflag", vector_to_array("scaled")[1].alias("z"))
    out = scaled.groupBy("l_returnflag").agg(F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"), F.max("z").alias("max_z"))
    return rounded(out, "mean_z", "sd_z", "max_z")


@query(
    "cluster_sums_fixed",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
      a AS (SELECT v.vec_id, v.e, arg_min(c.vec_id, (pow(list_distance(v.e, c.e), 2), c.vec_id)) AS own, min(pow(list_distance(v.e, c.e), 2)) AS d FROM v, v c WHERE c.vec_id < 7 GROUP BY v.vec_id, v.e)
      SELECT CAST(own AS INTEGER) AS cluster_id, count(*) AS n, round(sum(list_sum(e)), 4) AS total, round(sum(list_dot_product(e, e)), 4) AS squares, round((SELECT sum(d) FROM a), 4) AS cost FROM a GROUP BY own""",
)
def cluster_sums_fixed(t):
    """Rows, sums and cost of seven clusters around given centres."""
    points = clusters.as_vector(t.embeddings, "embedding").select("vec_id", "features")
    first = [r["features"].toArray() for r in points.filter("vec_id < 7").orderBy("vec_id").collect()]  # seven rows
    c = clusters.cluster_sums(points, "features", {0: np.stack(first)})[0]
    rows = [(k, int(c.n[k]), round(float(c.sums[k].sum()), 4), round(float(c.squares[k]), 4), round(c.cost, 4)) for k in range(7) if c.n[k]]
    return t.spark.createDataFrame(rows, "cluster_id int, n bigint, total double, squares double, cost double")


@query(
    "model_comparison_fixed",
    """WITH s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS actual, CAST(l_quantity > 25 AS INTEGER) AS a_p, l_quantity / 50 AS a_s, CAST(l_discount > 0.05 AS INTEGER) AS b_p, l_discount * 10 AS b_s FROM lineitem),
      l AS (SELECT 'a' AS model, actual, a_p AS p, a_s AS v FROM s UNION ALL SELECT 'b', actual, b_p, b_s FROM s),
      k AS (SELECT model, count(*) FILTER (actual = 1 AND p = 1) AS tp, count(*) FILTER (actual = 0 AND p = 0) AS tn, count(*) FILTER (actual = 0 AND p = 1) AS fp, count(*) FILTER (actual = 1 AND p = 0) AS fn FROM l GROUP BY model),
      c AS (SELECT model, v, count(*) FILTER (actual = 1) AS pos, count(*) FILTER (actual = 0) AS neg FROM l GROUP BY 1, 2),
      r AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY v DESC) AS cp FROM c),
      u AS (SELECT model, sum((cp - pos + pos / 2) * neg) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY model)
      SELECT model, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tn / (2 * tn + fn + fp), 6) AS f1_no, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_yes, round(auc, 6) AS auc FROM k JOIN u USING (model)""",
)
def model_comparison_fixed(t):
    """Two scores of every line as if two models had made them."""
    scored = t.lineitem.select(
        (F.col("l_returnflag") == "R").cast("int").alias("actual"), (F.col("l_quantity") > 25).cast("int").alias("a_predicted"), (F.col("l_quantity") / 50).alias("a_proba"),
        (F.col("l_discount") > 0.05).cast("int").alias("b_predicted"), (F.col("l_discount") * 10).alias("b_proba"),
    )
    return rounded(propensity.comparison(scored, ["a", "b"]), "accuracy", "f1_no", "f1_yes", "auc")


@query(
    "linear_shap_fixed",
    """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem)
      SELECT 'quantity' AS feature, round(avg(abs((l_quantity - q) * 0.5)), 6) AS mean_abs_phi FROM lineitem, m
      UNION ALL SELECT 'discount', round(avg(abs((l_discount - d) * -3.0)), 6) FROM lineitem, m UNION ALL SELECT 'tax', round(avg(abs((l_tax - x) * 0.0)), 6) FROM lineitem, m""",
)
def linear_shap_fixed(t):
    """Contributions under given coefficients."""
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    rows = t.lineitem.select("l_orderkey", array_to_vector(x).alias("scaled"))
    phi = propensity.linear_shap(SimpleNamespace(coefficients=[0.5, -3.0, 0.0]), rows, rows, ["quantity", "discount", "tax"], key="l_orderkey")
    return rounded(propensity.global_shap(phi), "mean_abs_phi")


# Leaves of two trees: value, and per feature the interval (low, high] and the share of training weight that followed it.
Q, D = (0, 1)
LEAVES = [
    {"value": 1.0, "path": {Q: (-np.inf, 25.0, 0.5), D: (-np.inf, 0.05, 0.6)}}, {"value": -2.0, "path": {Q: (-np.inf, 25.0, 0.5), D: (0.05, np.inf, 0.4)}},
    {"value": 0.5, "path": {Q: (25.0, np.inf, 0.5)}}, {"value": 4.0, "path": {D: (-np.inf, 0.02, 0.3)}}, {"value": 0.25, "path": {D: (0.02, np.inf, 0.7)}},
]


@query(
    "tree_shap_fixed",
    """WITH x AS (SELECT CAST(l_quantity <= 25 AS DOUBLE) AS q, CAST(l_quantity > 25 AS DOUBLE) AS nq, CAST(l_discount <= 0.05 AS DOUBLE) AS d, CAST(l_discount > 0.05 AS DOUBLE) AS nd, CAST(l_discount <= 0.02 AS DOUBLE) AS e FROM lineitem),
      p AS (SELECT 1.0 * (q - 0.5) * (0.6 + d) / 2 - 2.0 * (q - 0.5) * (0.4 + nd) / 2 + 0.5 * (nq - 0.5) AS quantity,
        1.0 * (d - 0.6) * (0.5 + q) / 2 - 2.0 * (nd - 0.4) * (0.5 + q) / 2 + 4.0 * (e - 0.3) + 0.25 * (1 - e - 0.7) AS discount FROM x)
      SELECT 'quantity' AS feature, round(avg(abs(quantity)), 6) AS mean_abs_phi FROM p UNION ALL SELECT 'discount', round(avg(abs(discount)), 6) FROM p""",
)
def tree_shap_fixed(t):
    """Shapley values under two given trees."""
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    return rounded(propensity.global_shap(propensity.leaf_shap(LEAVES, t.lineitem, ["quantity", "discount"], "l_orderkey", x)), "mean_abs_phi")


@query(
    "cluster_frequencies",
    """SELECT source, count(*) AS frequency, round_even(count(*) * 100.0 / (SELECT count(*) FROM documents), 1) AS pct_of_total FROM documents GROUP BY source""",
)
def cluster_frequencies(t):
    return clusters.frequencies(t.documents, "source")


@query(
    "labelled_rows",
    """SELECT doc_id, d.source, label FROM documents d LEFT JOIN (SELECT source, 'Topic ' || upper(source) AS label FROM documents GROUP BY source HAVING count(*) % 3 > 0) l ON d.source = l.source""",
)
def labelled_rows(t):
    """The label of its cluster on each row; some clusters have none."""
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n % 3 > 0")
    labels = sizes.select("source", F.concat(F.lit("Topic "), F.upper("source")).alias("label"))
    return voice.with_label(t.documents.select("doc_id", "source"), labels, "source").select("doc_id", "source", "label")
