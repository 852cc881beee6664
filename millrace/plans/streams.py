"""Streams run to their end over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from ..streaming import posts as sp
from .registry import Tables, query


def event_stream(t: Tables) -> DataFrame:
    """The event files as a stream; the brackets make the path a pattern, as a file source wants."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")


def run_to_end(stream: DataFrame, stem: str) -> DataFrame:
    """All rows a stream emits for the files there are."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, stem)
    (stream.writeStream.format("parquet").outputMode("append").option("path", out)
     .option("checkpointLocation", new_path(spark, f"{stem}-state")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_daily_posts", """WITH e AS (SELECT *, max(ts) OVER () AS newest FROM events)
   SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS day, count(*) AS n,
          round(avg(CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN -1.0 END), 6) AS score
   FROM e WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= newest GROUP BY 1""")
def _(t):
    """Days that closed: their end lies a day or more behind the newest event."""
    kind = F.col("event_type")
    days = sp.daily_posts(event_stream(t), "ts", kind == "click", kind.isin("click", "error"), "1 day")
    return run_to_end(days, "daily").select("day", "n", F.round("score", 6).alias("score"))


@query("stream_filter", """WITH RECURSIVE n AS MATERIALIZED (SELECT event_type AS s, event_id AS id, value AS z,
     row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
   k(s, i, id, x, p) AS (SELECT s, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM (SELECT DISTINCT s FROM n)
   UNION ALL SELECT k.s, n.i, n.id, CASE WHEN abs(k.x - n.z) >= 30 THEN 0.382::DOUBLE * n.z + 0.618::DOUBLE * k.x ELSE k.x END
     + (k.p + 1e-5::DOUBLE) / (k.p + 1e-5::DOUBLE + 0.1::DOUBLE) * (n.z - k.x),
     (1 - (k.p + 1e-5::DOUBLE) / (k.p + 1e-5::DOUBLE + 0.1::DOUBLE)) * (k.p + 1e-5::DOUBLE)
   FROM k JOIN n ON n.s = k.s AND n.i = k.i + 1)
   SELECT s AS event_type, id AS event_id, round(x, 4) AS smooth FROM k WHERE i > 0""")
def _(t):
    smooth = sp.kalman_stream(event_stream(t), "value", "event_id", "event_type")
    return run_to_end(smooth, "filter").select("event_type", "event_id", F.round("smooth", 4).alias("smooth"))
