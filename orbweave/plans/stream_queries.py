"""The streaming operators run over a table as a bounded input."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.plans.adapters import table
from orbweave.streaming import markers as S

QUERIES = {
    "windowed_counts": lambda s, d: S.windowed_counts(table(s, d, "events")).withColumn("value", F.bround("value", 4)),
    "sessions": lambda s, d: S.sessions(table(s, d, "events")).select("user_id", "n", "start"),
}

ORACLE_SQL = {
    "windowed_counts": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "sessions": """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, count(*) AS n, min(ts) AS start FROM g GROUP BY user_id, k""",
}
