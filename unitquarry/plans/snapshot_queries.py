"""Queries on snapshots, with their SQL."""

from unitquarry.operators.snapshots import snapshot_changes
from unitquarry.sources.tables import table


def p4_found(spark, d):
    return snapshot_changes(table(spark, d, "chunks"), table(spark, d, "releases"))


QUERIES = {"p4_found": p4_found}

ORACLE = {
    "p4_found": r"""
WITH r AS (
  SELECT library, version, lower(unit_name) AS u, section AS s, chunk_type AS t, lower(identifier) AS i,
    list_sort(list(DISTINCT coalesce('t' || regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), 'null'))) AS c
  FROM chunks GROUP BY ALL),
v AS (
  SELECT library, version, row_number() OVER (PARTITION BY library ORDER BY released_at) AS n
  FROM releases SEMI JOIN chunks USING (library, version)),
n AS (SELECT r.*, v.n FROM r JOIN v USING (library, version)),
p AS (SELECT a.library, a.version AS av, a.n AS an FROM v a WHERE a.n > 1)
SELECT n.library, n.version, u AS unit_name, s AS section, t AS chunk_type, i AS identifier, 'added' AS change_kind
FROM n WHERE n.n > 1 AND NOT EXISTS (
  SELECT 1 FROM n b WHERE b.library = n.library AND b.n = n.n - 1 AND b.u = n.u AND b.s = n.s AND b.t = n.t AND b.i = n.i)
UNION ALL
SELECT p.library, p.av, u, s, t, i, 'removed' FROM n JOIN p ON p.library = n.library AND n.n = p.an - 1 WHERE NOT EXISTS (
  SELECT 1 FROM n b WHERE b.library = n.library AND b.n = n.n + 1 AND b.u = n.u AND b.s = n.s AND b.t = n.t AND b.i = n.i)
UNION ALL
SELECT n.library, n.version, n.u, n.s, n.t, n.i, 'changed' FROM n JOIN n b
  ON b.library = n.library AND b.n = n.n - 1 AND b.u = n.u AND b.s = n.s AND b.t = n.t AND b.i = n.i AND b.c <> n.c
"""
}
