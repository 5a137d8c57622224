"""Registered queries: scans over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelwright.queries.labels import part_labels
from labelwright.queries.tables import new_folder, table
from labelwright.session import dealt, ensure_checkpoint_dir
from labelwright.streaming.labels import scan_stream, status_counts
from labelwright.streaming.panels import late_panels, merged_panels


def streaming_scan(spark, d):
    """Parts read as a stream of labels, scanned, and written out; the written scan is counted."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/part.parquet").schema
    parts = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(str(d))
    scanned = scan_stream(part_labels(dealt(parts))).select("p_partkey", "overall_status", F.size("issues").alias("n_issues"))
    query = (
        scanned.writeStream.format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("overall_status").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("n_issues").alias("n_issues"))


def delivered(spark, deliveries, plan):
    """What ``plan`` writes of tables that arrive one after another, and how many rows came late.

    The stream is stopped after each delivery and goes on from its checkpoint with the next.
    """
    folder, late = new_folder(spark, "stream"), 0
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{folder}/in")
        query = (
            plan(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).writeStream.format("parquet")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        late += late_panels(query)
    return spark.read.parquet(f"{folder}/out"), late


def day_of(c):
    return F.floor(F.unix_seconds(c) / 86400).cast("long")


def streaming_status_counts(spark, d):
    """Verdicts per ten minutes over parts that arrive one a minute; the last row only closes the others' periods."""
    minute = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("p_partkey"))
    parts = table(spark, d, "part")
    last = parts.agg(F.max("p_partkey").alias("p_partkey")).select(
        *[(F.col(c) + 1000 if c == "p_partkey" else F.lit(None)).cast(t).alias(c) for c, t in parts.dtypes])

    def plan(arriving):
        scanned = scan_stream(part_labels(dealt(arriving))).select("overall_status", minute.alias("at"))
        return status_counts(scanned, "at").select(
            F.unix_seconds("period.start").alias("period_second"), "overall_status", "n_labels")

    return delivered(spark, [parts, last], plan)[0]


EVENT_FIELDS = ["click", "view", "purchase"]


def streaming_panel_merge(spark, d):
    """Events as panels of their user's package, in three deliveries out of order, some sent twice, some late."""
    events = table(spark, d, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    panels = events.select(
        "user_id", "event_id", F.timestamp_micros(micros).alias("at"),
        *[F.when(F.col("event_type") == f, F.col("value")).alias(f) for f in EVENT_FIELDS])
    held_back = F.col("event_id") % 50 == 7
    day = F.floor(F.unix_seconds("at") / 86400) - 19723
    first = panels.where((day < 15) & ~held_back)
    second = panels.where((day >= 15) | ((day == 14) & (held_back | (F.col("event_id") % 10 == 3))))
    # The last row only closes the periods of the others.
    closing = panels.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(
        *[(F.col("at") if c == "at" else F.lit(None)).cast(t).alias(c) for c, t in panels.dtypes])
    third = panels.where((day < 14) & held_back)
    out, late = delivered(
        spark, [first, second, third, closing], lambda p: merged_panels(p, "user_id", "event_id", "at", EVENT_FIELDS))
    return out.select(
        "user_id", day_of("period_start").alias("period_day"), "n_panels", *EVENT_FIELDS, F.lit(late).cast("long").alias("n_late"))


QUERIES = {
    "streaming_scan": streaming_scan, "streaming_status_counts": streaming_status_counts, "streaming_panel_merge": streaming_panel_merge,
}

_EVENT_DAY = "CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT)"
_LATE = f"event_id % 50 = 7 AND {_EVENT_DAY} - 19723 < 14"

ORACLE = {
    "streaming_status_counts": """
        WITH p AS (SELECT (100 - p_size) / 100.0 AS conf, 600 * ((1704067200 + 60 * p_partkey) // 600) AS period_second FROM part)
        SELECT CAST(period_second AS BIGINT) AS period_second,
          CASE WHEN conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END AS overall_status, count(*) AS n_labels
        FROM p GROUP BY ALL""",
    "streaming_panel_merge": f"""
        WITH e AS (SELECT user_id, event_id, ts, value, event_type, {_EVENT_DAY} AS period_day, {_LATE} AS late FROM events)
        SELECT user_id, period_day, count(*) AS n_panels, """ + ", ".join(
            f"arg_min(value, (ts, event_id)) FILTER (event_type = '{f}' AND value IS NOT NULL) AS {f}" for f in EVENT_FIELDS) + """,
          (SELECT count(*) FROM e WHERE late) AS n_late
        FROM e WHERE NOT late GROUP BY user_id, period_day""",
    "streaming_scan": """
        WITH p AS (SELECT (100 - p_size) / 100.0 AS conf,
            1 + CAST(p_partkey % 2 = 0 AS INT) + CAST(p_partkey % 5 = 0 AS INT) + CAST(p_partkey % 7 = 0 AS INT) AS n_missing,
            1 + CAST(p_partkey % 2 <> 0 AS INT) + CAST(p_partkey % 5 <> 0 AS INT) + CAST(p_partkey % 7 <> 0 AS INT)
              + 3 * CAST(p_partkey % 3 <> 0 AS INT) AS n_fields FROM part),
        s AS (SELECT *, CASE WHEN conf < 0.5 THEN 'FAIL' WHEN conf >= 0.7 THEN 'PASS' ELSE 'UNCERTAIN' END AS overall_status FROM p)
        SELECT overall_status, count(*) AS n_labels,
          CAST(sum(n_missing + CASE WHEN overall_status = 'PASS' THEN 0 ELSE n_fields END) AS BIGINT) AS n_issues
        FROM s GROUP BY 1""",
}
