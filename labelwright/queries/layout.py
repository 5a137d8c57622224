"""Registered queries: layout, measures and image quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.fixed.label_patterns import ORIENTATION_WORDS
from labelwright.functions import measures as ms
from labelwright.operators import layout as ly
from labelwright.operators import orientation as og
from labelwright.queries.tables import SECONDS_SQL, case, seconds, table, text
from labelwright.sources.images import sharpness


def zone_partition(spark, d):
    rows = table(spark, d, "events").withColumn("zone", ms.zone((seconds() % 3600).cast("double"), 3600.0))
    return rows.groupBy("event_type", "zone").agg(F.count(F.lit(1)).alias("n_blocks"))


def column_clusters(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", seconds().cast("double").alias("x"))
    out = ly.column_clusters(rows, ["user_id"], F.col("x"), F.lit(600.0), [F.col("event_id")], 3000.0)
    return out.select("event_id", "user_id", "column_id")


def reading_order(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "user_id", (F.floor(seconds() / 86400) * 100).cast("double").alias("x"),
        (seconds() % 86400).cast("double").alias("y"))
    out = ly.reading_order(rows, ["user_id"], F.col("x"), F.col("y"), F.lit(50.0), [F.col("event_id")])
    return out.select("event_id", "user_id", "column_id", "reading_rank")


def reading_order_null_keys(spark, d):
    """A third of the users have no id: they are one group."""
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"),
        (F.floor(seconds() / 86400) * 100).cast("double").alias("x"), (seconds() % 86400).cast("double").alias("y"))
    out = ly.reading_order(rows, ["user_id"], F.col("x"), F.col("y"), F.lit(50.0), [F.col("event_id")])
    return out.select("event_id", "column_id", "reading_rank")


def label_layout(spark, d):
    """Blocks of one label per part, put into reading order inside the row."""
    key, size = F.col("p_partkey"), F.col("p_size")

    def block(x, y, w, name):
        box = F.array(*[v.cast("double") for v in (x, y, w, F.lit(18))])
        return F.struct(
            F.lit(None).cast("string").alias("block_id"), F.lit(name).alias("text"), F.lit(0.9).alias("confidence"),
            box.alias("bbox"))

    labels = table(spark, d, "part", even=True).select("p_partkey", F.array(
        block(F.lit(0), size * 10, F.lit(100), "A"), block(key % 60 + 100, F.lit(300), F.lit(50), "B"),
        block(F.lit(0), F.lit(255), F.lit(100), "C"), block(key % 200 + 150, size * 20, F.lit(30), "D"),
    ).alias("blocks"))
    b = F.col("blocks")
    return ly.analyze_layout(labels).select(
        "p_partkey", F.array_join(F.transform(b, lambda x: x["text"]), "").alias("reading"),
        F.array_join(F.transform(b, lambda x: x["layout_position"]), ",").alias("zones"),
        F.array_join(F.transform(b, lambda x: x["block_id"]), ",").alias("ids"))


def font_height_rule(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(ms.numeral_height(
        F.col("l_quantity") * 10, case(line % 4, F.lit("g"), F.lit("KG "), F.lit("ml"), F.lit("litre")),
        (F.col("l_partkey") % 60 + 5).cast("int"), (F.col("l_suppkey") % 7 * 100 + 400).cast("int")).alias("h"))
    return rows.groupBy("h.unit", "h.status", "h.required_min_mm").agg(
        F.count(F.lit(1)).alias("n_labels"), F.round(F.avg("h.est_height_mm"), 3).alias("mean_height"),
        F.round(F.avg("h.font_ratio_pdp_pct"), 3).alias("mean_ratio"))


def bounding_box(spark, d):
    a, b, c = (F.col("l_quantity").cast("int"), F.col("l_linenumber"), (F.col("l_suppkey") % 50).cast("int"))
    polygon = F.when(F.col("l_returnflag") != "R", F.array(
        F.array(a, b), F.array(a + c, b), F.array(a + c, b + a), F.array(a, b + c)))
    rows = table(spark, d, "lineitem").select("l_returnflag", ms.bounding_box(polygon).alias("box"))
    return rows.groupBy("l_returnflag").agg(*[
        F.sum(F.col("box")[i].cast("bigint")).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])


def orientation_score(spark, d):
    docs = table(spark, d, "documents", even=True)
    score = ms.orientation_score(F.col("text"), F.col("n_chars") % 20, (F.col("doc_id") % 10) / F.lit(10.0))
    return docs.select("doc_id", F.round(score, 6).alias("score"))


def orientation_turns(spark, d):
    """Conversations as images: their turns are text blocks, dealt over four probes; the first is also read with label words."""
    turn = F.col("turn")
    words = case(turn % 4, F.lit("mrp rs net qty "), F.lit("batch "), F.lit("fssai lic "), F.lit("exp "))
    blocks = table(spark, d, "conversations").select(
        F.col("conv_id").alias("image_id"), ((F.col("conv_id") + turn) % 4 * 90).alias("angle"), turn.alias("block_ord"),
        F.concat(F.when(F.col("conv_id") % 3 == 0, words).otherwise(F.lit("")), F.col("text")).alias("text"),
        (F.char_length("text") % 11 / F.lit(10.0)).alias("confidence"))
    return og.turns(og.probe_scores(blocks))


def image_quality(spark, d):
    q = ms.image_quality(F.col("p_size") * 100, F.col("p_size") * 60, F.col("p_partkey") * 1000)
    return table(spark, d, "part").select("p_partkey", q.alias("q")).select(
        "p_partkey", "q.megapixels", "q.size_kb", "q.quality_label")


def image_sharpness(spark, d):
    """Sharpness of each vector drawn as an 8 by 8 grey picture."""
    e = table(spark, d, "embeddings", even=True)
    pixel = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("int"))
    raw = F.unhex(F.array_join(F.transform(pixel, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    score = sharpness(F.col("pixels"), F.lit(8), F.lit(8), F.lit(1))
    return e.select("vec_id", raw.alias("pixels")).select("vec_id", score.alias("sharpness"))


def camera_urls(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(text("  ", F.regexp_replace("url", "^https?://", "")))
    return table(spark, d, "pages").select("page_id", ms.url_with_scheme(url).alias("url"))


QUERIES = {
    "zone_partition": zone_partition,
    "column_clusters": column_clusters,
    "reading_order": reading_order,
    "reading_order_null_keys": reading_order_null_keys,
    "label_layout": label_layout,
    "font_height_rule": font_height_rule,
    "bounding_box": bounding_box,
    "orientation_score": orientation_score,
    "orientation_turns": orientation_turns,
    "image_quality": image_quality,
    "image_sharpness": image_sharpness,
    "camera_urls": camera_urls,
}

_CLUSTERS = """
  b AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY user_id ORDER BY x, event_id) > gap THEN 1 ELSE 0 END AS brk FROM e),
  c AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS column_id FROM b)
"""
_PIXELS = "list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1.0) * 127.5) AS INTEGER))"


def _at(r: str, c: str) -> str:
    """Pixel of an 8 by 8 picture with mirrored borders."""
    fold = "(CASE WHEN {0} < 0 THEN 1 WHEN {0} > 7 THEN 6 ELSE {0} END)"
    return f"px[({fold.format(r)} * 8 + {fold.format(c)} + 1)::BIGINT]"


_R, _C = "(i // 8)", "(i % 8)"
_LAPLACE = (f"{_at(f'({_R} - 1)', _C)} + {_at(f'({_R} + 1)', _C)} + {_at(_R, f'({_C} - 1)')} + {_at(_R, f'({_C} + 1)')}"
            f" - 4 * {_at(_R, _C)}")

_LABEL_WORDS = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in ORIENTATION_WORDS)

ORACLE = {
    "zone_partition": f"""
        SELECT event_type, CASE WHEN r < 0.25 THEN 'top' WHEN r > 0.8 THEN 'bottom' ELSE 'middle' END AS zone, count(*) AS n_blocks
        FROM (SELECT event_type, ({SECONDS_SQL} % 3600) / 3600.0 AS r FROM events) GROUP BY 1, 2""",
    "column_clusters": f"""
        WITH e AS (SELECT event_id, user_id, {SECONDS_SQL} AS x, 600 AS w, 3000 AS gap FROM events), {_CLUSTERS}
        SELECT event_id, user_id, column_id FROM c""",
    "reading_order": f"""
        WITH e AS (SELECT event_id, user_id, {SECONDS_SQL} // 86400 * 100 AS x, {SECONDS_SQL} % 86400 AS y, 50 AS w, 40 AS gap FROM events),
        {_CLUSTERS}
        SELECT event_id, user_id, column_id,
          row_number() OVER (PARTITION BY user_id ORDER BY column_id, y, x, event_id) AS reading_rank FROM c""",
    "reading_order_null_keys": f"""
        WITH e AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id, {SECONDS_SQL} // 86400 * 100 AS x,
                     {SECONDS_SQL} % 86400 AS y, 50 AS w, 40 AS gap FROM events),
        {_CLUSTERS}
        SELECT event_id, column_id, row_number() OVER (PARTITION BY user_id ORDER BY column_id, y, x, event_id) AS reading_rank FROM c""",
    "label_layout": """
        WITH b AS (
          SELECT p_partkey, 'A' AS name, 0 AS ord, 0 AS x, p_size * 10 AS y, 100 AS w FROM part UNION ALL
          SELECT p_partkey, 'B', 1, p_partkey % 60 + 100, 300, 50 FROM part UNION ALL
          SELECT p_partkey, 'C', 2, 0, 255, 100 FROM part UNION ALL
          SELECT p_partkey, 'D', 3, p_partkey % 200 + 150, p_size * 20, 30 FROM part),
        g AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY p_partkey ORDER BY x, ord) > 40 THEN 1 ELSE 0 END AS brk FROM b),
        c AS (SELECT *, sum(brk) OVER (PARTITION BY p_partkey ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS col FROM g)
        SELECT p_partkey, string_agg(name, '' ORDER BY col, y, x, ord) AS reading,
          string_agg(CASE WHEN y / 1000.0 < 0.25 THEN 'top' WHEN y / 1000.0 > 0.8 THEN 'bottom' ELSE 'middle' END, ',' ORDER BY col, y, x, ord) AS zones,
          string_agg('blk_00' || (ord + 1), ',' ORDER BY col, y, x, ord) AS ids
        FROM c GROUP BY p_partkey""",
    "font_height_rule": """
        WITH h AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' ELSE 'litre' END AS unit,
            l_quantity * 10 * CASE WHEN l_linenumber % 4 IN (1, 3) THEN 1000.0 ELSE 1.0 END AS base,
            (l_partkey % 60 + 5) / CAST(l_suppkey % 7 * 100 + 400 AS DOUBLE) AS ratio FROM lineitem),
        q AS (SELECT *, CAST(CASE WHEN base <= 50 THEN 1 WHEN base <= 200 THEN 2 WHEN base <= 1000 THEN 4 ELSE 6 END AS DOUBLE) AS required_min_mm FROM h)
        SELECT unit, CASE WHEN ratio * 150.0 >= required_min_mm * CAST(0.8 AS DOUBLE) THEN 'PASS' ELSE 'FAIL' END AS status, required_min_mm,
          count(*) AS n_labels, round(avg(round_even(ratio * 150.0, 1)), 3) AS mean_height,
          round(avg(round_even(ratio * 100, 2)), 3) AS mean_ratio
        FROM q GROUP BY 1, 2, 3""",
    "bounding_box": """
        WITH p AS (SELECT l_returnflag, CAST(floor(l_quantity) AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_suppkey % 50 AS c FROM lineitem)
        SELECT l_returnflag,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE a END) AS BIGINT) AS x,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE b END) AS BIGINT) AS y,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 50 ELSE c + 1 END) AS BIGINT) AS w,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 20 ELSE greatest(a, c) + 1 END) AS BIGINT) AS h
        FROM p GROUP BY l_returnflag""",
    "orientation_turns": f"""
        WITH b AS (SELECT conv_id AS image_id, (conv_id + turn) % 4 * 90 AS angle, turn,
            CASE WHEN conv_id % 3 = 0 THEN CASE turn % 4 WHEN 0 THEN 'mrp rs net qty ' WHEN 1 THEN 'batch ' WHEN 2 THEN 'fssai lic ' ELSE 'exp ' END ELSE '' END || text AS text,
            coalesce(length(text) % 11 / 10.0, 0) AS confidence FROM conversations),
        p AS (SELECT image_id, angle, lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS t, count(*) FILTER (confidence >= 0.7) AS hc, avg(confidence) AS mean
            FROM b GROUP BY ALL),
        s AS (SELECT image_id, angle, hc, {_LABEL_WORDS} AS kw, ({_LABEL_WORDS}) * 10.0 + hc + mean * 5.0 AS score FROM p),
        w AS (SELECT image_id, coalesce(max(kw) FILTER (angle = 0), 0) AS kw, coalesce(max(hc) FILTER (angle = 0), 0) AS hc,
            coalesce(max(score) FILTER (angle = 0), 0) AS s0, coalesce(max(score) FILTER (angle = 90), 0) AS s90,
            coalesce(max(score) FILTER (angle = 180), 0) AS s180, coalesce(max(score) FILTER (angle = 270), 0) AS s270 FROM s GROUP BY image_id)
        SELECT image_id, CASE WHEN kw >= 4 AND hc >= 10 THEN 0 WHEN s90 > s0 * 1.3 AND s90 > 15 THEN 90 WHEN s270 > s0 * 1.3 AND s270 > s90 AND s270 > 15 THEN 270
          WHEN s0 < 10 AND s180 > s0 * 1.4 AND s180 > 15 THEN 180 ELSE 0 END AS turn FROM w""",
    "orientation_score": f"""
        SELECT doc_id, round(({' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ORIENTATION_WORDS)}) * 10.0
          + (n_chars % 20) * 1.0 + (doc_id % 10) / 10.0 * 5.0, 6) AS score FROM documents""",
    "image_quality": """
        WITH q AS (SELECT p_partkey, round_even(CAST(p_size * 100 AS DOUBLE) * (p_size * 60) / 1000000.0, 2) AS megapixels,
            round_even(p_partkey * 1000 / 1024.0, 1) AS size_kb FROM part)
        SELECT p_partkey, megapixels, size_kb, CASE WHEN megapixels >= 4.0 THEN 'Ultra High Res (4K / 4MP+) — Ideal for fine print'
          WHEN megapixels >= 1.5 THEN 'Full HD (1080p) — Great clarity for food labels'
          WHEN megapixels >= 0.8 THEN 'Standard HD (720p) — Moderate detail'
          ELSE 'Low Resolution (640x480) — Small fonts may be blurry' END AS quality_label FROM q""",
    "image_sharpness": f"""
        WITH p AS (SELECT vec_id, {_PIXELS} AS px FROM embeddings),
        l AS (SELECT vec_id, unnest(list_transform(range(64), lambda i: {_LAPLACE})) AS v FROM p)
        SELECT vec_id, round(least(1.0, greatest(0.05, var_pop(v) / 500.0)), 3) AS sharpness FROM l GROUP BY vec_id""",
    "camera_urls": """
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'http://' || regexp_replace(url, '^https?://', '') END AS url FROM pages""",
}
