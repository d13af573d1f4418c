"""The jobs from crawl to answers, over replayed sites, and the options that steer them."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanwork.config import Options
from gleanwork.operators import crawl, index
from gleanwork.plans import jobs
from gleanwork.sources import extract, pictures

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

SITE = {
    "https://example.com/robots.txt": "Sitemap: https://example.com/top.xml",
    "https://example.com/top.xml": "<loc>https://example.com/more.xml</loc><loc>https://example.com/a</loc>",
    "https://example.com/more.xml": "<loc>https://example.com/b</loc><loc>https://example.com/b</loc><loc>https://example.com/over-the-cap</loc>",
    "https://example.com/a": '<title>A</title><p>The cat sat on the mat and the dog ran away from it.</p><a href="/c">c</a><a href="/f.pdf">f</a><img src="/i.png" alt="schedule"><img src="/gone.png">',
    "https://example.com/b": "<p>Stock markets fell today as prices rose again in all the shops.</p><![x[y]]><a href=/lost>",
    "https://example.com/c": "<p>The cat sat on the mat and the dog ran away from it.</p>",
    "https://example.com/start": "<p>Nothing but the beginning of everything that follows from here.</p>",
}


def make_text():
    return lambda url: (200, "text/html", SITE[url])


def make_bytes():
    def get(url, headers):
        assert headers["Referer"] == "https://example.com/a"
        return 200, None, {"/f.pdf": b"pdf of many words " * 20, "/i.png": b"600x500"}[url.removeprefix("https://example.com")]

    return get


class Sizes:
    """Pictures are their own sizes."""

    def decode(self, content):
        w, h = map(int, content.decode().split("x"))
        return (h, w), h, w

    def resize(self, picture, height, width):
        return height, width


def reader():
    # As many boxes as the side is long in hundreds, with coordinates of the scaled picture.
    return lambda p: [([(0, 0), (p[1], 0), (p[1], 1), (0, 1)], f"w{k}", 0.9) for k in range(p[1] // 100)]


def test_jobs(spark, tmp_path):
    options = Options(allowed_hosts=("example.com",), start_urls=("https://example.com/start",), requests_per_second=1000, sitemap_cap=2, structured_size=16, ocr_size=8, ocr_overlap=0.0, mode="plain", top_k=2, min_chars=3)
    options = replace(options, **{k: str(tmp_path / k) for k in ("bronze", "documents", "chunks", "vectors")})
    at = F.lit("2025-01-01").cast("timestamp")
    first = jobs.collect(spark, options, make_text, make_bytes, at)
    assert first["pages"] == 4 and first["assets"] == 2 and first["failed"] == 1 and first["odd"] == 1
    assert not crawl.read_raw(spark, f"{options.bronze}/raw", "html").filter(F.col("url").contains("lost")).count()
    log = {(r["stage"], r["url"]) for r in spark.read.parquet(f"{options.bronze}/manifest.log").collect()}
    assert log == {("asset", "https://example.com/gone.png"), ("links", "https://example.com/b")}
    # A second run fetches pages again, assets not.
    assert jobs.collect(spark, options, make_text, make_bytes, at)["assets"] == 0

    pdf = extract.extract_pdf(lambda: lambda c: {"markdown": c.decode()})
    assert jobs.build_documents(spark, options, at, pdf=pdf, reader=reader, decoder=Sizes) == {"added": 6, "failed": 0}
    assert jobs.build_documents(spark, options, at, pdf=pdf, reader=reader, decoder=Sizes)["added"] == 0
    docs = {r["source_url"].rsplit("/", 1)[1]: r for r in spark.read.parquet(options.documents).collect()}
    assert set(docs) == {"a", "b", "c", "start", "f.pdf", "i.png"}
    assert docs["i.png"]["text_full"] == " ".join(f"w{k}" for k in range(10)) and docs["f.pdf"]["source_type"] == "pdf_md"

    assert jobs.build_chunks(spark, options)["chunks"] > len(docs)
    counted = jobs.build_vectors(spark, options)
    assert counted["total"] == counted["kept"] + counted["filtered"] and counted["added"] == counted["kept"] and jobs.build_vectors(spark, options)["added"] == 0
    asked = spark.createDataFrame([(1, "cat on the mat")], "query_id long, query string")
    answer = jobs.ask(spark, options, asked, index.embed, lambda: str.upper).first()
    assert len(answer["sources"]) <= 2 and any(u.endswith(("/a", "/c")) for u in answer["sources"]) and answer["answer"] == answer["prompt"].upper()


def test_readings_are_scaled(spark):
    """The gate reads at most 800 pixels a side, the text reader 1.8 or 1.2 times the size; polygons are the picture's own."""
    rows = spark.createDataFrame([(1, b"600x500"), (2, b"2000x400"), (3, b"no picture"), (4, None)], "id int, content binary")
    for scale, boxes in ((pictures.gate_scale, {1: 6, 2: 8}), (pictures.text_scale, {1: 10, 2: 24})):
        got = {r["id"]: r["r"] for r in rows.select("id", pictures.reading(scale, reader, Sizes)(F.col("content")).alias("r")).collect()}
        assert {i: len(got[i]["boxes"]) for i in (1, 2)} == boxes and got[3]["img_h"] is None and got[4]["boxes"] is None
        assert (got[2]["img_w"], got[2]["img_h"]) == (2000, 400) and max(p["x"] for p in got[2]["boxes"][0]["poly"]) == 2000
