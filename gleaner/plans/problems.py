"""The training-data queries of the core: timestamps and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.snapshots import snapshot_changes
from gleaner.operators.timestamps import found_stamps
from gleaner.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_stamps(*[table(spark, folder, t) for t in ("candidates", "sitemap_entries", "domain_patterns")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "program_snapshots"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found}
# A program's last delivery of each snapshot; meta as a JSON value with its keys in order.
SQL: dict[str, str] = {
    "p4_found": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, program_key ORDER BY delivered_at DESC) AS rn FROM program_snapshots),
l AS (SELECT snapshot_no, program_key, meta, list_distinct(urls) AS urls FROM n WHERE rn = 1),
v AS (SELECT snapshot_no, program_key, array_agg(j.fullkey || '=' || j.type || '=' || CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN '' ELSE coalesce(j.atom::VARCHAR, '') END ORDER BY j.fullkey) AS value FROM l, json_tree(meta) j GROUP BY ALL),
f AS (SELECT l.*, v.value FROM l LEFT JOIN v USING (snapshot_no, program_key)),
s AS (SELECT DISTINCT snapshot_no FROM program_snapshots WHERE snapshot_no > (SELECT min(snapshot_no) FROM program_snapshots)),
a AS (SELECT s.snapshot_no, x.program_key, 'now' AS side, x.value, x.urls FROM s JOIN f x ON x.snapshot_no = s.snapshot_no),
b AS (SELECT s.snapshot_no, x.program_key, x.value, x.urls FROM s JOIN f x ON x.snapshot_no = s.snapshot_no - 1),
j AS (SELECT coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.program_key, b.program_key) AS program_key, a.program_key IS NOT NULL AS has, b.program_key IS NOT NULL AS had, a.value AS value, b.value AS before, a.urls AS urls, b.urls AS gone
  FROM a FULL JOIN b ON a.snapshot_no = b.snapshot_no AND a.program_key = b.program_key)
SELECT snapshot_no, program_key, '' AS url, CASE WHEN NOT had THEN 'added' WHEN NOT has THEN 'removed' ELSE 'changed' END AS what FROM j WHERE NOT had OR NOT has OR value IS DISTINCT FROM before
UNION ALL SELECT snapshot_no, program_key, u, 'added' FROM (SELECT snapshot_no, program_key, unnest([x for x in urls if NOT list_contains(gone, x)]) AS u FROM j WHERE has AND had) WHERE u IS NOT NULL
UNION ALL SELECT snapshot_no, program_key, u, 'removed' FROM (SELECT snapshot_no, program_key, unnest([x for x in gone if NOT list_contains(urls, x)]) AS u FROM j WHERE has AND had) WHERE u IS NOT NULL""",
}
