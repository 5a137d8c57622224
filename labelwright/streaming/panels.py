"""Packages whose panels arrive one at a time: repeats are dropped, panels merged, late ones counted.

Both steps are built-in stateful operators.  Repeats are found by (package,
panel), so a package with very many panels spreads; the merge combines in each
task before its shuffle and keeps one row of state per package and period,
however many panels that has.  The watermark closes periods and frees the state
of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merged_panels(
    panels: DataFrame, package: str, panel: str, time: str, fields: list[str], period: str = "1 day", late: str = "2 days",
) -> DataFrame:
    """One row per package and period: n_panels and the earliest value of each field that is not null.

    A panel sent again counts once while the watermark has not passed its time
    by another ``late``; ties in time go to the smaller panel id.  Panels older
    than the watermark are left out (``late_panels`` counts them).  Rows come
    out when the watermark passes the end of their period.  Batch tables give
    the same rows, with nothing late and repeats dropped by (package, panel).
    """
    once = panels.withWatermark(time, late) if panels.isStreaming else panels
    once = once.dropDuplicatesWithinWatermark([package, panel]) if panels.isStreaming else once.dropDuplicates([package, panel])
    first = [
        F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(F.col(time), F.col(panel)))).alias(f) for f in fields]
    merged = once.groupBy(package, F.window(time, period).alias("period")).agg(F.count(F.lit(1)).alias("n_panels"), *first)
    return merged.select(package, F.col("period.start").alias("period_start"), "n_panels", *fields)


def late_panels(query: StreamingQuery) -> int:
    """Rows the watermark turned away, over the progress reports the query still holds."""
    return sum(int(state["numRowsDroppedByWatermark"]) for report in query.recentProgress for state in report["stateOperators"])
