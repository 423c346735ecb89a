"""Queries over tracks, gt_divisions, cycles and dataset_manifest: cycles, trees, metrics, consistency, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import hierarchy, quality, review
from cellweave.operators import lineage as lin
from cellweave.plans.candidates import _rounded
from cellweave.session import table


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.track_rows(table(spark, sf_dir, "tracks"))


def _divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.division_rows(table(spark, sf_dir, "gt_divisions"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.intervals(table(spark, sf_dir, "dataset_manifest"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(lin.links(_divisions(spark, sf_dir)))


def cycles_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    exited = table(spark, sf_dir, "cycles").where("end_cause = 'exited'")
    return lin.cycles(_tracks(spark, sf_dir), _divisions(spark, sf_dir), exited)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depths(lin.links(_divisions(spark, sf_dir))).select("dataset_id", F.col("node").alias("track_id"), F.col("depth").alias("generation"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.roots(_tracks(spark, sf_dir), _divisions(spark, sf_dir))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.leaves(_tracks(spark, sf_dir), _divisions(spark, sf_dir))


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all tracks that are in cycles."""
    return lin.descendants_of(lin.links(_divisions(spark, sf_dir)), table(spark, sf_dir, "cycles"), inclusive=False)


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.ancestors_of(_tree(spark, sf_dir), table(spark, sf_dir, "cycles"))


def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between each track of cycles and the parent's parent."""
    c = table(spark, sf_dir, "cycles").select("dataset_id", "track_id", "parent_id").distinct()
    up = c.select("dataset_id", F.col("track_id").alias("parent_id"), F.col("parent_id").alias("a"))
    pairs = c.join(up, ["dataset_id", "parent_id"]).where("a IS NOT NULL").select("dataset_id", F.col("track_id").alias("b"), "a").distinct()
    return lin.path_between(_tree(spark, sf_dir), pairs).select("dataset_id", "a", "b", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def mother_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.mother_branch(_tracks(spark, sf_dir), _divisions(spark, sf_dir), _manifest(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "tracks").select("dataset_id", "track_id"), table(spark, sf_dir, "cycles").where("complete_cycle").select("dataset_id", "track_id")


def trackset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.union_of(*_sets(spark, sf_dir))


def trackset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.intersection_of(*_sets(spark, sf_dir))


def trackset_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.difference_of(*_sets(spark, sf_dir))


def cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lin.metrics(_tracks(spark, sf_dir), _manifest(spark, sf_dir)))


def length_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lin.length_flags(_tracks(spark, sf_dir), _divisions(spark, sf_dir)))


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.gap_segments(_tracks(spark, sf_dir))


def swimlanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.swimlanes(table(spark, sf_dir, "cycles").distinct())


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's row as its label in that frame."""
    return _tracks(spark, sf_dir).where("area IS NOT NULL").groupBy("dataset_id", "t", "label").agg(F.max("area").alias("area"))


def qc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.basic_checks(_cells(spark, sf_dir), least=60.0))


def manifest_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of scored that no manifest row names."""
    known = table(spark, sf_dir, "dataset_manifest").select("dataset_id")
    return table(spark, sf_dir, "scored").select("dataset_id").where("dataset_id IS NOT NULL").distinct().join(known, "dataset_id", "left_anti")


def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.dendrogram(_tree(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (dendrogram, cycles_table, generations, roots, leaves, descendants, ancestors, path_between, mother_branch, trackset_union, trackset_intersect, trackset_minus, cycle_metrics, length_flags, gap_segments, swimlanes, qc_all, manifest_unknown)
}

_T = """WITH RECURSIVE tr AS (
  SELECT DISTINCT dataset_id, track_id, t, label, CASE WHEN isnan(y) THEN NULL ELSE y END AS y, CASE WHEN isnan(area) THEN NULL ELSE area END AS area, CASE WHEN isnan(axis_len) THEN NULL ELSE axis_len END AS axis_len
  FROM tracks WHERE dataset_id IS NOT NULL AND track_id IS NOT NULL AND t IS NOT NULL),
dv AS (
  SELECT dataset_id, mother_track_id, t_div, d1_track_id, d2_track_id FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, mother_track_id ORDER BY t_div NULLS FIRST, d1_track_id NULLS FIRST, d2_track_id NULLS FIRST) AS k FROM gt_divisions WHERE dataset_id IS NOT NULL AND mother_track_id >= 1)
  WHERE k = 1),
l AS (
  SELECT DISTINCT dataset_id, p, c FROM (SELECT dataset_id, mother_track_id AS p, d1_track_id AS c FROM dv UNION ALL SELECT dataset_id, mother_track_id, d2_track_id FROM dv) WHERE c >= 1),
least_ AS (SELECT dataset_id, c, min(p) AS p FROM l GROUP BY ALL),
nodes AS (SELECT dataset_id, p AS n FROM l UNION SELECT dataset_id, c FROM l),
g(dataset_id, n, depth, path) AS (
  SELECT dataset_id, n, 0, [CAST(n AS BIGINT)] FROM nodes ANTI JOIN least_ ON nodes.dataset_id = least_.dataset_id AND nodes.n = least_.c
  UNION ALL SELECT least_.dataset_id, least_.c, g.depth + 1, list_append(g.path, CAST(least_.c AS BIGINT)) FROM g JOIN least_ ON g.dataset_id = least_.dataset_id AND g.n = least_.p),
reach(dataset_id, a, d) AS (SELECT dataset_id, p, c FROM l UNION SELECT reach.dataset_id, reach.a, l.c FROM reach JOIN l ON reach.dataset_id = l.dataset_id AND reach.d = l.p),
mf AS (SELECT dataset_id, min(CASE WHEN isnan(frame_interval_min) THEN NULL ELSE frame_interval_min END) AS i FROM dataset_manifest WHERE dataset_id IS NOT NULL GROUP BY ALL),
sp AS (SELECT dataset_id, track_id, min(t) AS birth_t, max(t) AS end_t, count(DISTINCT t) AS n_frames FROM tr GROUP BY ALL),
fst AS (SELECT dataset_id, track_id, t, label, axis_len FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, track_id ORDER BY t, label) AS k FROM tr) WHERE k = 1),
lst AS (SELECT dataset_id, track_id, t, label, axis_len FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, track_id ORDER BY t DESC, label DESC) AS k FROM tr) WHERE k = 1)
"""


def _f(x: str) -> str:
    return f"CAST(CAST(round({x}, 12) AS FLOAT) AS DOUBLE)"


_CELLS = """, ce AS (SELECT dataset_id, t, label, max(area) AS area FROM tr WHERE area IS NOT NULL GROUP BY ALL),
hv AS (SELECT dataset_id, t, count(*) AS n, sum(area) AS area FROM ce GROUP BY ALL),
sq AS (SELECT dataset_id, unnest(range(min(t), max(t) + 1)) AS t FROM hv GROUP BY dataset_id),
sm AS (SELECT sq.dataset_id, CAST(sq.t AS INTEGER) AS t, coalesce(n, 0) AS n, coalesce(area, 0) AS area FROM sq LEFT JOIN hv ON sq.dataset_id = hv.dataset_id AND sq.t = hv.t),
bt AS (SELECT a.dataset_id, a.t, a.n - b.n AS dn, (a.area - b.area) / greatest(b.area, 1.0) AS da FROM sm a JOIN sm b ON a.dataset_id = b.dataset_id AND a.t = b.t + 1),
li AS (SELECT dataset_id, t, quantile_cont(area, 0.01) AS lo, quantile_cont(area, 0.99) AS hi FROM ce GROUP BY ALL HAVING count(*) >= 3)
"""

SQL = {
    "dendrogram": _T
    + """, lf AS (SELECT dataset_id, path, row_number() OVER (PARTITION BY dataset_id ORDER BY path) - 1 AS rank FROM g ANTI JOIN least_ ON g.dataset_id = least_.dataset_id AND g.n = least_.p),
u AS (SELECT dataset_id, unnest(path) AS n, rank FROM lf), ab AS (SELECT dataset_id, n, (min(rank) + max(rank)) / 2 AS place FROM u GROUP BY ALL)
SELECT g.dataset_id, CAST(g.n AS BIGINT) AS track_id, CAST(depth AS INTEGER) AS depth, CAST(place AS DOUBLE) AS place FROM g JOIN ab ON g.dataset_id = ab.dataset_id AND g.n = ab.n""",
    "cycles_table": _T
    + """, ex AS (SELECT DISTINCT dataset_id, track_id FROM cycles WHERE end_cause = 'exited' AND track_id >= 0), mo AS (SELECT DISTINCT dataset_id, mother_track_id AS track_id FROM dv),
j AS (SELECT sp.*, least_.p AS parent_id, CASE WHEN nodes.n IS NULL THEN 0 ELSE g.depth END AS generation, end_t - birth_t + 1 - n_frames AS n_gap_frames, least_.p IS NOT NULL AS birth_observed,
    CASE WHEN mo.track_id IS NOT NULL THEN 'divided' WHEN ex.track_id IS NOT NULL THEN 'exited' ELSE 'censored' END AS end_cause
  FROM sp LEFT JOIN least_ ON sp.dataset_id = least_.dataset_id AND sp.track_id = least_.c LEFT JOIN nodes ON sp.dataset_id = nodes.dataset_id AND sp.track_id = nodes.n LEFT JOIN g ON sp.dataset_id = g.dataset_id AND sp.track_id = g.n
    LEFT JOIN mo ON sp.dataset_id = mo.dataset_id AND sp.track_id = mo.track_id LEFT JOIN ex ON sp.dataset_id = ex.dataset_id AND sp.track_id = ex.track_id)
SELECT *, birth_observed AND end_cause = 'divided' AND n_gap_frames = 0 AS complete_cycle FROM j""",
    "generations": _T + "SELECT nodes.dataset_id, CAST(nodes.n AS BIGINT) AS track_id, CAST(depth AS INTEGER) AS generation FROM nodes LEFT JOIN g ON nodes.dataset_id = g.dataset_id AND nodes.n = g.n",
    "roots": _T + "SELECT DISTINCT dataset_id, track_id FROM tr ANTI JOIN l ON tr.dataset_id = l.dataset_id AND tr.track_id = l.c",
    "leaves": _T + "SELECT DISTINCT dataset_id, track_id FROM tr ANTI JOIN dv ON tr.dataset_id = dv.dataset_id AND tr.track_id = dv.mother_track_id",
    "descendants": _T + "SELECT dataset_id, CAST(a AS BIGINT) AS track_id, CAST(d AS BIGINT) AS descendant FROM reach SEMI JOIN cycles ON reach.dataset_id = cycles.dataset_id AND reach.a = cycles.track_id WHERE a <> d",
    "ancestors": _T + "SELECT * FROM (SELECT dataset_id, CAST(n AS BIGINT) AS track_id, unnest(path) AS ancestor FROM g SEMI JOIN cycles ON g.dataset_id = cycles.dataset_id AND g.n = cycles.track_id) WHERE ancestor <> track_id",
    "path_between": _T
    + """, pr AS (SELECT DISTINCT c.dataset_id, c.track_id AS b, u.parent_id AS a FROM cycles c JOIN cycles u ON c.dataset_id = u.dataset_id AND c.parent_id = u.track_id WHERE u.parent_id IS NOT NULL),
j AS (SELECT pr.*, gb.path AS pb, ga.path AS pa FROM pr LEFT JOIN g gb ON pr.dataset_id = gb.dataset_id AND pr.b = gb.n LEFT JOIN g ga ON pr.dataset_id = ga.dataset_id AND pr.a = ga.n)
SELECT dataset_id, a, b, array_to_string(CASE WHEN list_position(pb, a) > 0 THEN pb[list_position(pb, a):] WHEN list_position(pa, b) > 0 THEN pa[list_position(pa, b):] ELSE [] END, '/') AS path FROM j""",
    "mother_branch": _T
    + """, en AS (SELECT dataset_id, coalesce(min(nullif(trim(open_end), '')), '') = 'high' AS high FROM dataset_manifest WHERE dataset_id IS NOT NULL GROUP BY dataset_id),
bo AS (SELECT dataset_id, track_id, t, y FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, track_id ORDER BY t, label, x NULLS FIRST, y NULLS FIRST) AS k FROM (SELECT tr.*, CASE WHEN isnan(tk.x) THEN NULL ELSE tk.x END AS x FROM tr JOIN (SELECT DISTINCT dataset_id, track_id, t, label, x FROM tracks) tk USING (dataset_id, track_id, t, label))) WHERE k = 1),
st AS (SELECT dataset_id, track_id FROM (SELECT bo.*, row_number() OVER (PARTITION BY bo.dataset_id ORDER BY t, CASE WHEN coalesce(high, FALSE) THEN y ELSE -y END NULLS FIRST, track_id) AS k FROM bo LEFT JOIN en ON bo.dataset_id = en.dataset_id) WHERE k = 1),
ch AS (SELECT dv.dataset_id, dv.mother_track_id AS p, CASE WHEN coalesce(CASE WHEN coalesce(high, FALSE) THEN b.y < a.y ELSE b.y > a.y END, FALSE) THEN d2_track_id ELSE d1_track_id END AS c
  FROM dv LEFT JOIN en ON dv.dataset_id = en.dataset_id LEFT JOIN bo a ON dv.dataset_id = a.dataset_id AND dv.d1_track_id = a.track_id LEFT JOIN bo b ON dv.dataset_id = b.dataset_id AND dv.d2_track_id = b.track_id),
br(dataset_id, track_id, step) AS (SELECT dataset_id, track_id, 0 FROM st UNION ALL SELECT ch.dataset_id, ch.c, step + 1 FROM br JOIN ch ON br.dataset_id = ch.dataset_id AND br.track_id = ch.p AND ch.c >= 1 WHERE step < 1000)
SELECT dataset_id, track_id, min(step) AS step FROM br GROUP BY dataset_id, track_id""",
    "trackset_union": "SELECT dataset_id, track_id FROM tracks UNION SELECT dataset_id, track_id FROM cycles WHERE complete_cycle",
    "trackset_intersect": "SELECT dataset_id, track_id FROM tracks INTERSECT SELECT dataset_id, track_id FROM cycles WHERE complete_cycle",
    "trackset_minus": "SELECT dataset_id, track_id FROM tracks EXCEPT SELECT dataset_id, track_id FROM cycles WHERE complete_cycle",
    "cycle_metrics": _T
    + f""", r AS (SELECT tr.*, coalesce(i, 1) AS i, CASE WHEN axis_len > 0 THEN ln(axis_len) END AS v FROM tr LEFT JOIN mf USING (dataset_id)),
q AS (SELECT dataset_id, track_id, (max(t) - min(t) + 1) * max(i) AS cycle_time, regr_slope(v, t * i) AS s, regr_r2(v, t * i) AS r2, count(v) AS n, var_pop(v) AS vp FROM r GROUP BY ALL)
SELECT q.dataset_id, q.track_id, {_f("cycle_time")} AS cycle_time, {_f("fst.axis_len")} AS birth_length, {_f("lst.axis_len - fst.axis_len")} AS added_length, CASE WHEN n >= 2 THEN {_f("s")} END AS growth_rate,
  CASE WHEN n >= 2 AND vp > 0 THEN {_f("r2")} END AS growth_rate_r2, n AS growth_rate_n
FROM q JOIN fst USING (dataset_id, track_id) JOIN lst USING (dataset_id, track_id)""",
    "length_flags": _T
    + f""", w AS (SELECT *, lead(t) OVER o AS t2, lead(label) OVER o AS l2, lead(axis_len) OVER o AS a2 FROM tr WINDOW o AS (PARTITION BY dataset_id, track_id ORDER BY t, label)),
dd AS (SELECT dv.*, m.label AS ml, m.axis_len AS ma, x.label AS l1, x.t AS t1, y.label AS lb2, y.t AS ty, CASE WHEN x.axis_len > 0 THEN x.axis_len END AS a1, CASE WHEN y.axis_len > 0 THEN y.axis_len END AS ay
  FROM dv JOIN lst m ON dv.dataset_id = m.dataset_id AND dv.mother_track_id = m.track_id LEFT JOIN fst x ON dv.dataset_id = x.dataset_id AND dv.d1_track_id = x.track_id LEFT JOIN fst y ON dv.dataset_id = y.dataset_id AND dv.d2_track_id = y.track_id
  WHERE m.axis_len > 0)
SELECT dataset_id, 'drop_without_division' AS kind, t, t2 AS t_next, track_id AS src_track_id, label AS src_label, track_id AS dst1_track_id, l2 AS dst1_label, CAST(NULL AS INTEGER) AS dst2_track_id, CAST(NULL AS INTEGER) AS dst2_label,
  {_f("axis_len")} AS length_before, {_f("a2")} AS length_after, {_f("1 - a2 / axis_len")} AS drop_frac FROM w WHERE t2 = t + 1 AND axis_len > 0 AND 1 - a2 / axis_len >= 0.3
UNION ALL SELECT dataset_id, 'division_without_drop', t_div, coalesce(least(t1, ty), t_div + 1), mother_track_id, ml, d1_track_id, l1, d2_track_id, lb2, {_f("ma")}, {_f("greatest(a1, ay)")}, {_f("1 - greatest(a1, ay) / ma")}
FROM dd WHERE 1 - greatest(a1, ay) / ma < 0.3""",
    "gap_segments": """WITH o AS (SELECT DISTINCT dataset_id, track_id, t FROM tracks WHERE dataset_id IS NOT NULL AND track_id IS NOT NULL AND t IS NOT NULL),
n AS (SELECT *, coalesce(CAST(t - lag(t) OVER w > 1 AS INTEGER), 0) AS k FROM o WINDOW w AS (PARTITION BY dataset_id, track_id ORDER BY t)),
s AS (SELECT *, sum(k) OVER (PARTITION BY dataset_id, track_id ORDER BY t) AS segment FROM n)
SELECT dataset_id, track_id, CAST(segment AS BIGINT) AS segment, min(t) AS from_t, max(t) AS to_t, count(*) AS n_frames FROM s GROUP BY dataset_id, track_id, segment""",
    "swimlanes": """WITH c AS (SELECT DISTINCT * FROM cycles) SELECT c.dataset_id, c.track_id, c.parent_id, c.generation, c.birth_t, c.end_t, c.end_cause, p.end_t AS parent_end_t
FROM c LEFT JOIN c p ON c.dataset_id = p.dataset_id AND c.parent_id = p.track_id""",
    "qc_all": _T
    + _CELLS
    + f"""SELECT dataset_id, t AS frame, 'error' AS severity, 'empty_frame' AS check_name, CAST(NULL AS INTEGER) AS label_id, 'n_labels' AS metric_name, 0.0::DOUBLE AS metric_value, 0.0::DOUBLE AS threshold FROM sm WHERE n = 0
UNION ALL SELECT dataset_id, t, 'warning', 'small_label', label, 'area', {_f("area")}, 60.0 FROM ce WHERE area < 60
UNION ALL SELECT dataset_id, t, 'warning', 'cell_count_jump', NULL, 'count_change', dn, 2 FROM bt WHERE abs(dn) > 2
UNION ALL SELECT dataset_id, t, 'warning', 'total_area_jump', NULL, 'area_change', {_f("da")}, 0.5 FROM bt WHERE abs(da) > 0.5
UNION ALL SELECT ce.dataset_id, ce.t, 'info', 'area_outlier', label, 'area', {_f("area")}, {_f("CASE WHEN area < lo THEN lo ELSE hi END")} FROM ce JOIN li ON ce.dataset_id = li.dataset_id AND ce.t = li.t WHERE area < lo OR area > hi""",
    "manifest_unknown": "SELECT DISTINCT dataset_id FROM scored ANTI JOIN dataset_manifest USING (dataset_id) WHERE dataset_id IS NOT NULL",
}
