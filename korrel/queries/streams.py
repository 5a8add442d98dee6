"""Stream windows over events, run as batches."""

from __future__ import annotations

from korrel.queries.registry import query
from korrel.session import load
from korrel.streaming import events as E


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return E.tumbling(load(spark, sf_dir, "events"))


@query("stream_sessions", "SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(CASE WHEN last IS NULL OR ts >= last + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)) GROUP BY user_id, s")
def sessions(spark, sf_dir):
    return E.sessions(load(spark, sf_dir, "events"))
