"""Files in and out, images, plug-ins and streams."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from labelwright.functions.measures import image_quality
from labelwright.operators import corpus as cp
from labelwright.operators.blocks import explode_blocks
from labelwright.sources import catalogues as ct
from labelwright.sources import images as im
from labelwright.sources import labels as lb
from labelwright.streaming.labels import scan_stream, status_counts, stream_ocr_json

BLOCK = {"block_id": "b1", "text": "MRP Rs. 5", "confidence": 0.9, "bbox": [0, 0, 10, 5]}


def png(path, img):
    """A grey or colour picture as a PNG file."""
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_ocr_documents(spark, tmp_path):
    for i, doc in enumerate([{"image_id": "a", "text_blocks": [BLOCK]}, {"image_id": "b", "text_blocks": [], "ocr_blocks": [BLOCK, BLOCK]},
                             {"blocks": [BLOCK]}, {"image_id": "d", "text_blocks": []}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    got = {r.image_id: len(r.blocks) for r in lb.read_ocr_json(spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "b": 2, "pkg_scan": 1, "d": 0}


def test_block_lists_and_tables(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([BLOCK, BLOCK]))
    one = lb.read_block_lists(spark, str(tmp_path)).first()
    assert one.image_id == "unknown_image" and [b.text for b in one.blocks] == ["MRP Rs. 5"] * 2
    rows = explode_blocks(lb.read_block_lists(spark, str(tmp_path)))
    again = lb.blocks_from_rows(rows, "image_id", "block_ord").first()
    assert [b.text for b in again.blocks] == ["MRP Rs. 5"] * 2
    many = rows.unionByName(rows.withColumn("image_id", F.lit(None).cast("string")))
    assert sorted(len(r.blocks) for r in lb.blocks_from_rows(many, "image_id", "block_ord").collect()) == [2, 2]


def test_text_documents(spark, tmp_path):
    (tmp_path / "r.txt").write_text("one---PAGE_BREAK---two")
    docs = lb.read_text_documents(spark, str(tmp_path))
    row = docs.first()
    assert (row.document_id, row.is_valid, row.status) == ("doc_r.txt", True, "validated")
    assert [r.text for r in cp.split_pages(docs.select("document_id", "text")).orderBy("page_number").collect()] == ["one", "two"]


def test_catalogue_files(spark, tmp_path):
    rule = {"rule_id": "R", "rule_name": "n", "rule_number": "1", "mandatory": True, "description": "d", "keywords": ["k"]}
    (tmp_path / "rules.json").write_text(json.dumps({"domain": "x", "rules": [rule, rule]}))
    (tmp_path / "bare.json").write_text(json.dumps([rule]))
    assert ct.read_rules(spark, str(tmp_path / "rules.json")).count() == 2
    assert ct.read_rules(spark, str(tmp_path / "bare.json")).first().keywords == ["k"]
    chunks = cp.provisions(spark)
    ct.write_chunks(chunks, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 38
    ct.write_json(chunks.limit(3), str(tmp_path / "json"))
    ct.write_text(chunks, "text", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 38


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    png(tmp_path / "noise.png", rng.integers(0, 255, (40, 60, 3), dtype=np.uint8))
    png(tmp_path / "flat.png", np.full((40, 60, 3), 90, np.uint8))
    shots = im.read_images(spark, str(tmp_path))
    got = {r.image_id: r for r in shots.select("image_id", "height", "width", "channels", im.sharpness(
        F.col("pixels"), F.col("height"), F.col("width"), F.col("channels")).alias("s")).collect()}
    assert (got["flat.png"].height, got["flat.png"].width, got["flat.png"].channels) == (40, 60, 3)
    assert got["flat.png"].s == 0.05 and got["noise.png"].s == 1.0
    clean = im.preprocess(shots, dewarp=True, cleaners=[np.copy], dots=True)
    assert clean.select(F.length("pixels")).distinct().first()[0] == 40 * 60 * 3
    size = im.read_image_bytes(spark, str(tmp_path)).join(
        shots.select("path", "width", "height").withColumn("path", F.col("path")), "path", "left").first()
    assert size.length > 0


def test_dot_bridging_joins_strokes():
    dots = np.zeros((3, 6), np.uint8)
    dots[1, [1, 3]] = 255
    assert im._bridge_dots(dots)[1].tolist() == [0, 255, 255, 255, 255, 0]
    flat = np.tile(np.arange(8, dtype=np.uint8) * 10, (2, 1))
    assert im._unroll(flat, 50.0).shape == flat.shape


def test_ocr_plug_in(spark, tmp_path):
    png(tmp_path / "big.png", np.zeros((40, 2560, 3), np.uint8))

    def start():
        return lambda img: [([[0, 0], [9, 0], [9, 4], [0, 4]], f" w{img.shape[1]} ", 0.87654)]

    shots = im.read_images(spark, str(tmp_path))
    found = im.detect_blocks(shots, start)
    b = found.first().blocks[0]
    assert (b.text, b.confidence, b.bbox, b.block_id) == ("w1280", 0.8765, [0.0, 0.0, 20.0, 10.0], "blk_001")
    doc = im.structured(shots, found, F.lit("2024-01-01T00:00:00Z")).first()
    assert doc.image_metadata.width == 2560 and len(doc.text_blocks) == 1


def test_pdf_plug_in(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"p1|p2")
    pages = im.read_pdf_pages(spark, str(tmp_path), lambda: lambda content: content.decode().split("|"))
    assert [(r.pdf_page_index, r.page_text) for r in pages.collect()] == [(1, "p1"), (2, "p2")]


def test_image_quality(spark):
    q = spark.range(1).select(image_quality(F.lit(1920), F.lit(1080), F.lit(10240)).alias("q")).first().q
    assert (q.megapixels, q.size_kb) == (2.07, 10.0) and q.quality_label.startswith("Full HD")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"image_id": str(i), "text_blocks": [BLOCK]}) for i in range(4)))
    scanned = scan_stream(stream_ocr_json(spark, str(tmp_path / "in"))).select("image_id", "overall_status")
    q = scanned.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("overall_status = 'PASS'").count() == 4
    timed = scanned.withColumn("at", F.current_timestamp())
    assert status_counts(timed, "at").isStreaming
