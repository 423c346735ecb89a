"""The queries of the general training-data problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import hierarchy, orphans, spikes
from cellweave.session import table


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = table(spark, sf_dir, "gt_divisions"), table(spark, sf_dir, "cycles")
    return hierarchy.lineage_links(*tables), hierarchy.lineage_nodes(*tables)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = orphans.division_references(table(spark, sf_dir, "gt_divisions"))
    return orphans.orphan_references(references, orphans.track_states(table(spark, sf_dir, "tracks"), table(spark, sf_dir, "removed_tracks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycles_of(_links(spark, sf_dir)[0])[0].select("dataset_id", F.col("node").cast("int").alias("track_id"))


def p2_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks that are their own ancestors, with the least track of those that reach each other."""
    return hierarchy.cycles_of(_links(spark, sf_dir)[0])[0].withColumnRenamed("node", "track_id")


def p2_back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that close the cycles."""
    return hierarchy.cycles_of(_links(spark, sf_dir)[0])[1]


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, root, depth and path of every track, with links or without; the path as text, so that it compares as a plain value."""
    h = hierarchy.paths(*_links(spark, sf_dir))
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return h.select("dataset_id", F.col("node").alias("track_id"), "parent", "root", F.col("depth").cast("bigint").alias("depth"), path.alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every track, a row for each."""
    return hierarchy.descendants(_links(spark, sf_dir)[0]).withColumnRenamed("node", "track_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, sf_dir, "consistency_flags"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("dataset_id", "t_div", "mother_track_id", "ref_field", "ref_track_id", "state").distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p2_cycles, p2_back_links, p3_found, p4_found, p4_counts)}

_LINKS = """
WITH RECURSIVE l AS (
  SELECT DISTINCT dataset_id, CAST(p AS BIGINT) AS p, CAST(c AS BIGINT) AS c FROM (
    SELECT dataset_id, mother_track_id AS p, d1_track_id AS c FROM gt_divisions
    UNION ALL SELECT dataset_id, mother_track_id, d2_track_id FROM gt_divisions
    UNION ALL SELECT dataset_id, parent_id, track_id FROM cycles)
  WHERE p >= 1 AND c >= 1 AND dataset_id IS NOT NULL),
r(dataset_id, a, d) AS (
  SELECT dataset_id, p, c FROM l
  UNION SELECT r.dataset_id, r.a, l.c FROM r JOIN l ON r.dataset_id = l.dataset_id AND r.d = l.p)
"""

_PATHS = _LINKS.rstrip() + """,
n AS (
  SELECT DISTINCT dataset_id, CAST(t AS BIGINT) AS t FROM (
    SELECT dataset_id, unnest([mother_track_id, d1_track_id, d2_track_id]) AS t FROM gt_divisions UNION ALL SELECT dataset_id, unnest([track_id, parent_id]) FROM cycles)
  WHERE t >= 1 AND dataset_id IS NOT NULL),
m AS (SELECT dataset_id, c, min(p) AS p FROM l GROUP BY ALL),
g(dataset_id, t, root, depth, path) AS (
  SELECT n.dataset_id, n.t, n.t, 0::BIGINT, CAST(n.t AS VARCHAR) FROM n ANTI JOIN m ON n.dataset_id = m.dataset_id AND n.t = m.c
  UNION ALL SELECT m.dataset_id, m.c, g.root, g.depth + 1, g.path || '/' || m.c FROM g JOIN m ON g.dataset_id = m.dataset_id AND g.t = m.p)
"""

_STATES = """
WITH refs AS (
  SELECT dataset_id, t_div, mother_track_id, unnest(['d1_track_id', 'd2_track_id']) AS ref_field, unnest([d1_track_id, d2_track_id]) AS ref_track_id, loaded_at
  FROM (SELECT dataset_id, t_div, mother_track_id, d1_track_id, d2_track_id, min(loaded_at) AS loaded_at FROM gt_divisions GROUP BY ALL)),
rows_ AS (SELECT dataset_id, track_id, min(loaded_at) AS f, max(loaded_at) AS l FROM tracks GROUP BY ALL),
gone AS (SELECT dataset_id, track_id, max(removed_at) AS g FROM removed_tracks GROUP BY ALL),
s AS (
  SELECT refs.*, CASE WHEN gone.track_id IS NOT NULL AND (rows_.track_id IS NULL OR g > l) THEN 'deleted' WHEN rows_.track_id IS NULL THEN 'missing'
    WHEN f > loaded_at THEN 'late' END AS state
  FROM refs LEFT JOIN rows_ ON refs.dataset_id = rows_.dataset_id AND ref_track_id = rows_.track_id
    LEFT JOIN gone ON refs.dataset_id = gone.dataset_id AND ref_track_id = gone.track_id
  WHERE ref_track_id IS NOT NULL)
"""

SQL = {
    "p2_found": _LINKS + "SELECT DISTINCT dataset_id, CAST(a AS INTEGER) AS track_id FROM r WHERE a = d",
    "p2_cycles": _LINKS
    + "SELECT r.dataset_id, r.a AS track_id, min(r.d) AS cycle FROM r JOIN r b ON r.dataset_id = b.dataset_id AND r.a = b.d AND r.d = b.a GROUP BY r.dataset_id, r.a",
    "p2_descendants": _LINKS + "SELECT dataset_id, a AS track_id, d AS descendant FROM r",
    "p2_hierarchy": _PATHS
    + """SELECT n.dataset_id, n.t AS track_id, m.p AS parent, g.root, g.depth, g.path
FROM n LEFT JOIN m ON n.dataset_id = m.dataset_id AND n.t = m.c LEFT JOIN g ON n.dataset_id = g.dataset_id AND n.t = g.t""",
    "p4_found": _STATES + "SELECT DISTINCT dataset_id, t_div, mother_track_id, ref_field, ref_track_id, state FROM s WHERE state IS NOT NULL",
    "p4_counts": _STATES
    + "SELECT 'gt_divisions' AS table_name, strftime(loaded_at, '%Y-%m') AS month, ref_field, state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY ALL",
}
