"""Queries of state that follows each user's events, over tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.plans.catalog import query
from mnemoframe.sources.tables import read
from mnemoframe.streaming import absence

UNTIL = 1706745600000  # 2024-02-01 UTC, after the last event

Z4 = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS k FROM (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events) WHERE ms <= {UNTIL}),
 r AS (SELECT user_id, k, ms AS seen, NULL::BIGINT AS since, 0e0 AS mean, 0e0 AS old, 0 AS total, 0e0 AS allowed, false AS gone FROM o WHERE k = 1 UNION ALL
  SELECT user_id, k, ms, seen, CASE WHEN NOT absent THEN mean WHEN total = 0 THEN CAST(ms - seen AS DOUBLE) ELSE mean * 0.8e0 + (ms - seen) * (1 - 0.8e0) END, mean, total + CAST(absent AS INT), lim, absent
  FROM (SELECT *, ms - seen > lim AS absent FROM (SELECT r.user_id, o.k, o.ms, r.seen, r.mean, r.total, greatest({absence.HOUR}, CASE WHEN r.mean = 0 THEN {absence.FIRST_MEAN} ELSE r.mean END * 1.5e0) AS lim FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))),
 lasts AS (SELECT *, greatest({absence.HOUR}, CASE WHEN mean = 0 THEN {absence.FIRST_MEAN} ELSE mean END * 1.5e0) AS lim FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
 SELECT user_id, 'absent' AS kind, since, since + CAST(floor(allowed) AS BIGINT) + 1 AS "at", NULL::BIGINT AS duration_ms, NULL AS level, round(old, 3) AS mean_ms FROM r WHERE gone UNION ALL
 SELECT user_id, 'returned', since, seen, seen - since, CASE WHEN seen - since > greatest({72 * absence.HOUR}, CASE WHEN old = 0 THEN {absence.FIRST_MEAN} ELSE old END * 24) THEN 'very long' WHEN seen - since > greatest({24 * absence.HOUR}, CASE WHEN old = 0 THEN {absence.FIRST_MEAN} ELSE old END * 8) THEN 'long' ELSE 'short' END, round(mean, 3) FROM r WHERE gone UNION ALL
 SELECT user_id, 'absent', seen, seen + CAST(floor(lim) AS BIGINT) + 1, NULL, NULL, round(mean, 3) FROM lasts WHERE {UNTIL} - seen > lim"""


@query("z4_absences", Z4)
def _(spark, d):
    return absence.absences(read(spark, d, "events"), UNTIL).withColumn("mean_ms", F.round("mean_ms", 3))
