"""Distribution and correlation plans: D1-D9."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from kiln.functions.columns import round_all
from kiln.operators import corr, dist
from kiln.plans.registry import query
from kiln.plans.tables import LI_SQL, lineitem_nulls, table

_HIST = """WITH s AS (SELECT min({c}) lo, max({c}) hi, count({c}) n FROM {t}),
w AS (SELECT lo, n, CASE WHEN hi > lo THEN (hi - lo) / {b} ELSE 1.0 END AS w FROM s),
c AS (SELECT CAST(least(floor(({c} - lo) / w), {b} - 1) AS INTEGER) AS bin, count(*) AS cnt
      FROM {t}, w WHERE {c} IS NOT NULL GROUP BY 1)
SELECT CAST(g.range AS INTEGER) AS bin, round(lo + g.range * w, 6) AS lo, round(lo + (g.range + 1) * w, 6) AS hi,
       coalesce(cnt, 0) AS count, round(coalesce(cnt, 0) / (n * w), 6) AS density
FROM range({b}) g CROSS JOIN w LEFT JOIN c ON c.bin = g.range"""


@query("histogram_counts", _HIST.format(c="value", t="events", b=20))
def q_histogram_counts(spark, sf):
    return round_all(dist.histogram(table(spark, sf, "events"), "value", 20))


@query("histogram_density", _HIST.format(c="l_extendedprice", t="lineitem", b=50))
def q_histogram_density(spark, sf):
    return round_all(dist.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50))


_KDE = """WITH s AS (SELECT min(value) lo, max(value) hi, count(value) n, stddev_samp(value) sd FROM events),
p AS (SELECT lo, (hi - lo) / 99 AS step, n, sd * pow(n, -0.2) AS h FROM s),
g AS (SELECT CAST(range AS INTEGER) AS point, lo + range * step AS x, n, h FROM range(100), p)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - e.value) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g, events e WHERE e.value IS NOT NULL GROUP BY point, x, n, h"""


@query("kde_curve", _KDE)
def q_kde_curve(spark, sf):
    return round_all(dist.kde_curve(table(spark, sf, "events"), "value", 100))


def _box_sql(c, t):
    return f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round((SELECT min({c}) FROM {t} WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round((SELECT max({c}) FROM {t} WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  (SELECT count({c}) FROM {t} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) q1, CAST(quantile_cont({c}, 0.5) AS DOUBLE) med,
             CAST(quantile_cont({c}, 0.75) AS DOUBLE) q3 FROM {t})"""


@query("box_stats", _box_sql("value", "events") + "\nUNION ALL\n" + _box_sql("user_id", "events"))
def q_box_stats(spark, sf):
    return round_all(dist.box_stats(table(spark, sf, "events"), ["value", "user_id"]))


_BOX_LINES = "\nUNION ALL\n".join(
    f"SELECT 'box' AS part, '{c}' AS name, {c} AS x, CAST(NULL AS DOUBLE) AS density FROM ({_box_sql('value', 'events')}) b"
    for c in ("q1", "median", "q3", "whisker_low", "whisker_high"))


@query("violin", f"SELECT 'curve' AS part, CAST(point AS VARCHAR) AS name, x, density FROM ({_KDE}) k\nUNION ALL\n{_BOX_LINES}")
def q_violin(spark, sf):
    return round_all(dist.violin_table(table(spark, sf, "events"), "value", 100))


_EVENT = "event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))


@query("outlier_flag_zscore", f"""SELECT {_EVENT}, round((value - m) / s, 6) AS zscore,
  abs((value - m) / s) > 3 AS is_outlier
FROM events, (SELECT avg(value) m, stddev_pop(value) s FROM events) st WHERE value IS NOT NULL""")
def q_outlier_flag_zscore(spark, sf):
    return round_all(dist.outlier_flag_zscore(_events(spark, sf), "value", 3.0))


@query("outlier_flag_iqr", f"""SELECT {_EVENT},
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM events, (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events) st
WHERE value IS NOT NULL""")
def q_outlier_flag_iqr(spark, sf):
    return dist.outlier_flag_iqr(_events(spark, sf), "value", 1.5)


PEARSON = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(cols, pair_sql, diag_sql):
    parts = []
    for a in cols:
        parts.append(f"SELECT '{a}' AS column_a, '{a}' AS column_b, {diag_sql(a)} AS corr")
    for a, b in permutations(cols, 2):
        parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {pair_sql(a, b)} AS corr")
    return "\nUNION ALL\n".join(parts)


def _diag(a, src):
    return f"(SELECT CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END FROM {src} t)"


@query("corr_pearson", _matrix_sql(
    PEARSON, lambda a, b: f"(SELECT round(corr({a}, {b}), 6) FROM {LI_SQL} t)", lambda a: _diag(a, LI_SQL)))
def q_corr_pearson(spark, sf):
    return round_all(corr.pearson_matrix(lineitem_nulls(spark, sf), PEARSON))


SPEARMAN = ["l_quantity", "l_extendedprice", "l_discount"]


def _spearman_pair(a, b):
    return (f"(SELECT round(corr(ra, rb), 6) FROM (SELECT "
            f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM {LI_SQL} t WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")


@query("corr_spearman", _matrix_sql(SPEARMAN, _spearman_pair, lambda a: _diag(a, LI_SQL)))
def q_corr_spearman(spark, sf):
    return round_all(corr.spearman_matrix(lineitem_nulls(spark, sf), SPEARMAN))


KENDALL = ["p_size", "p_retailprice", "p_partkey"]


def _kendall_pair(a, b):
    t = (f"(SELECT row_number() OVER (ORDER BY p_partkey) AS id, CAST({a} AS DOUBLE) AS x, "
         f"CAST({b} AS DOUBLE) AS y FROM part WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return (f"(SELECT round((c - d) / sqrt((n0 - tx) * (n0 - ty)), 6) FROM "
            f"(SELECT sum(CASE WHEN (t1.x - t2.x) * (t1.y - t2.y) > 0 THEN 1 ELSE 0 END) AS c, "
            f"sum(CASE WHEN (t1.x - t2.x) * (t1.y - t2.y) < 0 THEN 1 ELSE 0 END) AS d "
            f"FROM {t} t1 JOIN {t} t2 ON t1.id < t2.id), "
            f"(SELECT sum(k * (k - 1) / 2) AS tx FROM (SELECT count(*) AS k FROM {t} GROUP BY x)), "
            f"(SELECT sum(k * (k - 1) / 2) AS ty FROM (SELECT count(*) AS k FROM {t} GROUP BY y)), "
            f"(SELECT count(*) * (count(*) - 1) / 2 AS n0 FROM {t}))")


@query("corr_kendall", _matrix_sql(KENDALL, _kendall_pair, lambda a: _diag(a, "part")))
def q_corr_kendall(spark, sf):
    return round_all(corr.kendall_matrix(table(spark, sf, "part"), KENDALL))


# Each pair of lineitem columns with gaps, on its own complete rows.  In SQL the table is collapsed to distinct (x, y) with
# their counts before the self-join.
KENDALL_WIDE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _kendall_counted(a, b):
    t = f"(SELECT {a} AS x, {b} AS y, count(*) AS k FROM {LI_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)"
    ties = lambda c: f"(SELECT sum(k * (k - 1) / 2) FROM (SELECT {c}, sum(k) AS k FROM {t} GROUP BY {c}))"
    return (f"(SELECT round(s / sqrt((n0 - {ties('x')}) * (n0 - {ties('y')})), 6) FROM "
            f"(SELECT sum(sign(t1.x - t2.x) * sign(t1.y - t2.y) * t1.k * t2.k) / 2 AS s FROM {t} t1, {t} t2), "
            f"(SELECT sum(k) * (sum(k) - 1) / 2 AS n0 FROM {t}))")


@query("corr_kendall_lineitem", _matrix_sql(KENDALL_WIDE, _kendall_counted, lambda a: _diag(a, LI_SQL)))
def q_corr_kendall_lineitem(spark, sf):
    """Kendall's tau-b of six column pairs with gaps, in the same jobs."""
    return round_all(corr.kendall_matrix(lineitem_nulls(spark, sf), KENDALL_WIDE))
