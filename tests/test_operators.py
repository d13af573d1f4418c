from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanwork import schema as S
from gleanwork.config import Options
from gleanwork.functions import text as T
from gleanwork.operators import chunk, crawl, dedup, documents, index, links, normalize, report, retrieve
from gleanwork.sources import extract, fetch, records, sitemap
from gleanwork.streaming import ingest as stream



def now():
    return F.lit("2025-01-01").cast("timestamp")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- Chunks ---------------------------------------------------------------------------------------


def by_chars(size, overlap, per=3.6):
    """How the built-in path counts: windows of a text, and whether it fits."""
    width, shared = int(size * per), int(overlap * per)
    step = max(1, width - shared if size > overlap else width)

    def cut(t):
        out, i = [], 0
        while t:
            out.append(t[i : i + width])
            if i + width >= len(t):
                return out
            i += step
        return out

    return cut, lambda t: int(len(t) / per) <= size


def model(text, size, overlap, per_token=4, per=3.6):
    """The rules by recursion over what is left of a segment's parts."""
    cut, fits = by_chars(size, overlap, per)

    def gather(held, sep, parts):
        if not parts:
            return [held] * bool(held)
        longer, rest = held + sep * bool(held) + parts[0], parts[1:]
        if fits(longer):
            return gather(longer, sep, rest)
        if not held:
            return cut(parts[0]) + gather("", sep, rest)
        again = held[len(held) - min(len(held), per_token * overlap) :] + parts[0]
        windows = [again] if fits(again) else cut(again)
        return [held, *windows[:-1], *gather(windows[-1], sep, rest)]

    def cascade(segment, seps):
        if fits(segment):
            return [segment]
        if not seps:
            return cut(segment)
        if seps[0] not in segment:
            return cascade(segment, seps[1:])
        return [c for s in gather("", seps[0], segment.split(seps[0])) for c in cascade(s, seps[1:])]

    return cascade(text, ["\n\n", "\n", ". ", " "])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.ก", max_size=120), min_size=10, max_size=40))
def test_native_chunks_follow_the_rules(spark, texts):
    rows = spark.createDataFrame([(i, t, 5, 1 + i % 3 if i % 5 else 0) for i, t in enumerate(texts)], "i int, t string, size int, overlap int")
    got = {r["i"]: r["c"] for r in rows.select("i", chunk.chunks(F.col("t"), F.col("size"), F.col("overlap")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model(t, 5, 1 + i % 3 if i % 5 else 0), t


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.ก", max_size=150), st.integers(1, 12), st.integers(0, 5))
def test_split_text_follows_the_rules(text, size, overlap):
    """With a character as a token, the tokenizer path is the built-in one with three characters of overlap a token."""
    assert chunk.split_text(text, size, overlap, list, "".join) == model(text, size, overlap, 3, 1)


def test_long_windows_are_split_again():
    """A tokenizer that counts a text beginning with b twice: windows that come out too long are taken to the next separator."""
    encode = lambda t: list(t) * (2 if t.startswith("b") else 1)
    got = chunk.split_text("aaaa\nabbb bb", 4, 0, encode, "".join)
    assert got == ["aaaa", "abbb", " bb"] and chunk.split_text("xx\nbb b", 4, 0, encode, "".join) == ["xx", "bb", "b", "bb", "b"]


def test_split_text_with_a_tokenizer():
    encode, decode = str.split, " ".join
    assert chunk.split_text("a b c", 3, 1, encode, decode) == ["a b c"]
    assert chunk.split_text("a b\nc d\ne", 2, 0, encode, decode) == ["a b", "c d", "e"]
    assert chunk.split_text("a b c d e", 2, 1, list, "".join)[0] == "a"
    assert chunk.split_text("abcdef", 4, 1, list, "".join) == ["abcd", "def"]


def test_hard_chunks(spark):
    rows = spark.createDataFrame([("abcdefg",), ("",), ("ab",)], "t string")
    assert [r[0] for r in rows.select(chunk.hard_chunks(F.col("t"), 3, 1)).collect()] == [["abc", "cde", "efg"], [], ["ab"]]
    assert [r[0] for r in rows.select(chunk.hard_chunks(F.col("t"), 3, 3)).collect()] == [["abc", "def", "g"], [], ["ab"]]
    assert [r[0] for r in rows.select(chunk.hard_chunks(F.col("t"), 0, 0)).collect()] == [["abcdefg"], [""], ["ab"]]


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("h1", "u", "html", "# A\n\nb", None), ("", "v", "text", "", "plain"), (None, "w", "image", " ", None), ("h1", "z", "html", "later", None)], "content_hash string, source_url string, source_type string, text_full string, text string")
    got = {r["id"]: r for r in chunk.chunk_documents(docs).collect()}
    assert set(got) == {"h1:0", f"{hashlib.sha1(b'v').hexdigest()}:0"}
    assert got["h1:0"]["text"] == "# A\n\nb" and got["h1:0"]["profile"] == "structured" and got["h1:0"]["chunk_total"] == 1
    assert chunk.chunk_documents(docs).schema.fieldNames() == S.CHUNK.fieldNames()


# --- Dedup and normalising ------------------------------------------------------------------------


def test_keep_first_of_null_keys_and_ties(spark):
    """Rows with a null key all stay; of tied rows, one; both ways to do it agree."""
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), ("k", 2, "b"), ("k", 1, "c"), ("k", 1, "c"), ("j", None, "d"), ("j", 5, "e"), ("i", 1, "f")], "k string, i int, t string").repartition(3)
    expected = [("i", 1, "f"), ("j", None, "d"), ("k", 1, "c"), (None, 1, "a"), (None, 1, "a")]
    assert rows_of(dedup.keep_first(rows, "k", "i")) == expected and rows_of(dedup.keep_first_wide(rows, "k", "i")) == expected
    assert dedup.keep_first_wide(rows.limit(0), "k", "i").count() == 0


def test_repeated_records_are_deduped(spark):
    """Rows that are equal in id and text are told apart; one is kept."""
    rows = spark.createDataFrame([("1", "same"), ("1", "same"), ("0", "other"), ("2", "same"), (None, "")], "id string, text string").repartition(3)
    judged = normalize.judged(rows, Options(dedup="sha1_text"))
    assert tuple(normalize.counters(judged).first()) == (5, 2, 1, 2, 0) and judged.columns == ["id", "text", "embed_text", "outcome"]
    assert rows_of(normalize.embeddable(judged).select("id")) == [("0",), ("1",)]
    plain = spark.createDataFrame([("x",), ("",), ("y",)], "text string").coalesce(1)
    assert rows_of(normalize.embeddable(normalize.judged(plain)).select("id", "text")) == [("1", "x"), ("3", "y")]
    with pytest.raises(ValueError):
        normalize.judged(rows, Options(token_mode="words", min_tokens=1))


def test_keep_first_under_repartition(spark):
    rows = spark.createDataFrame([(k % 7, i, f"t{i}") for i, k in enumerate(range(200))], "k long, i long, t string")
    for n in (1, 5):
        assert rows_of(dedup.keep_first(rows.repartition(n), "k", "i")) == sorted((i, i, f"t{i}") for i in range(7))


def test_incremental(spark):
    old = spark.createDataFrame([("aaaaaaaa", None), (None, "bbbbbbbb"), ("x", None)], "sha1 string, hash string")
    seen = dedup.known_hashes(old)
    assert rows_of(seen) == [("aaaaaaaa",), ("bbbbbbbb",)]
    new = spark.createDataFrame([("aaaaaaaa", 1, "p"), ("cccccccc", 3, "p"), ("cccccccc", 2, "q")], "content_hash string, id long, source_type string")
    assert rows_of(dedup.dedup_incremental(new, seen, "content_hash", "id").select("id")) == [(2,)]
    assert rows_of(dedup.dedup_incremental(new, seen, "content_hash", "id", "source_type").select("id")) == [(1,), (2,), (3,)]


def test_normalise(spark, tmp_path):
    lines = [{"id": "1", "text": "same text", "source_url": "u"}, {"id": "2", "text": "same text"}, {"id": "3", "text": " "}, {"id": None, "text": "other one", "metadata": {"source_url": "m"}}]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{broken", json.dumps({"id": "5", "text": "x"})]))
    from pyspark.sql.types import StringType, StructField, StructType

    kind = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("source_url", StringType()), StructField("metadata", StructType([StructField("source_url", StringType())]))])
    rows = normalize.judged(records.read_jsonl(spark, str(tmp_path), kind), Options(dedup="sha1_text", min_chars=2), "id")
    total = normalize.counters(rows).first().asDict()
    assert total == {"total": 6, "kept": 2, "filtered": 2, "deduped": 1, "malformed": 1}
    assert total["kept"] + total["filtered"] + total["deduped"] + total["malformed"] == total["total"]
    assert [(r["id"], r["metadata"]["url"]) for r in normalize.embeddable(rows).orderBy("id").collect()] == [("1", "u"), ("None", "m")]
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path), kind, strict=True).collect()


# --- Pages ----------------------------------------------------------------------------------------

PAGE = """<html><head><title> T &amp; t </title><link rel="Canonical" href="/d/home"></head><body>
<a href="a.html#x">1</a><a href="/a.html">2</a><a href="https://else.net/">3</a><a href="b.pdf">4</a><a href="#top">5</a><a href="JavaScript:x">6</a>
<img src="i.PNG" alt=" one "><img srcset="j.jpg 1x, k.webp 2x"><picture><source srcset="l.gif 2x"></picture><source srcset="no.gif">
<div style="background-image: url('m.bmp')" data-href="c.pdf?x=1"></div><img src="i.PNG#f" alt="again"><script>var s = '<a href="no.html">'</script></body></html>"""


def test_links(spark):
    found = links.parse_page(PAGE, "https://e.com/d/", ("e.com",))
    assert found["links"] == ["https://e.com/d/a.html", "https://e.com/a.html", "https://e.com/d/b.pdf"]
    assert found["pdfs"] == ["https://e.com/d/b.pdf", "https://e.com/d/c.pdf?x=1"]
    assert [i["url"].rsplit("/", 1)[1] for i in found["images"]] == ["i.PNG", "j.jpg", "k.webp", "l.gif", "m.bmp"]
    assert found["images"][0] == {"url": "https://e.com/d/i.PNG", "alt": "one", "src_hint": "i.PNG"}
    assert (found["canonical"], found["title"]) == ("https://e.com/d/home", "T & t")
    assert links.parse_page(None, None) == {"links": [], "pdfs": [], "images": [], "canonical": None, "title": None, "error": None}


def test_extract_and_documents(spark):
    html = "<head><title>N</title><meta property='article:published_time' content='2024-01-02'></head><nav>menu</nav><p>one <b>two</b></p><p>three</p><script>no</script>"
    assert extract.plain_html(html) == {"text": "one two\nthree", "title": "N", "published_at": "2024-01-02", "updated_at": None}
    pages = spark.createDataFrame([("https://e.com/a", html), ("https://e.com/b", html), ("https://e.com/c", "<nav>x</nav>"), ("https://e.com/d", None)], "url string, html string")
    docs = documents.corpus([documents.html_documents(pages, now())])
    assert [(r["source_url"], r["text_full"], r["title"]) for r in docs.collect()] == [("https://e.com/a", "one two\nthree", "N")]


def test_pdf_and_image_documents(spark):
    good = "Readable English text of a page. " * 10
    kind = "url string, page string, markdown string, plain string, pages array<struct<own:string,plain:string,ocr:string>>"
    pages = [(good, None, None), ("é" * 200, good.upper(), None), ("", "", "read by eye"), (None, None, None)]
    rows = [("1", "p", good, None, None), ("2", "p", "é" * 400, "| a |\n|---|\n" + good, None), ("3", "p", "", None, pages), ("4", "p", None, None, [(None, None, None)]), ("5", "p", None, None, None)]
    got = {r["source_url"]: r for r in documents.pdf_documents(spark.createDataFrame(rows, kind), now()).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert got["1"]["text_full"] == good.strip() and not got["1"]["has_tables"] and got["2"]["has_tables"]
    assert got["3"]["text_full"] == good.strip() + good.upper().strip() + "read by eye"
    box = lambda t, c: {"poly": [{"x": 0.0, "y": 0.0}, {"x": 400.0, "y": 0.0}, {"x": 400.0, "y": 400.0}], "text": t, "conf": c}
    boxes = "array<struct<poly:array<struct<x:double,y:double>>,text:string,conf:double>>"
    images = spark.createDataFrame([("u", "p", "", "", 400, 500, [box("Timetable", 0.9)], [box("Time", 0.91234), box("table", 0.8)]), ("v", "p", "", "", 300, 500, [box("Timetable", 0.9)], [])], f"url string, page string, alt string, src_hint string, img_h int, img_w int, boxes {boxes}, read {boxes}")
    docs = documents.image_documents(images, now()).collect()
    assert [(r["text_full"], r["ocr_avg_conf"], r["ocr_text_area_ratio"]) for r in docs] == [("Time table", 0.856, 0.8)]
    both = documents.corpus([documents.image_documents(images, now()), documents.pdf_documents(spark.createDataFrame(rows, kind), now())])
    assert both.count() == 4 and set(both.columns) <= set(S.DOCUMENT.fieldNames())


def test_injected_engines(spark):
    files = spark.createDataFrame([(1, b"text"), (2, b""), (3, None)], "id int, content binary")

    def pdf():
        return lambda c: {"markdown": c.decode(), "pages": [{"own": "o", "plain": None, "ocr": "x"}]} if c else 1 / 0

    got = {r["id"]: r["p"] for r in files.select("id", extract.extract_pdf(pdf)(F.col("content")).alias("p")).collect()}
    assert got[1]["markdown"] == "text" and got[1]["plain"] is None and got[1]["pages"][0]["own"] == "o" and got[2]["markdown"] is None and got[3]["pages"] is None

    def ocr():
        return lambda c: {"img_h": 1, "img_w": len(c), "boxes": [{"poly": [{"x": 0.0, "y": 1.0}], "text": "t", "conf": 0.5}]}

    row = files.filter("id = 1").select(extract.read_picture(ocr)(F.col("content")).alias("o")).first()["o"]
    assert (row["img_w"], row["boxes"][0]["text"], row["boxes"][0]["poly"][0]["y"]) == (4, "t", 1.0)


def test_sitemaps(spark):
    robots = spark.createDataFrame([("https://e.com", "User-agent: *\nSITEMAP: https://e.com/s.xml\nsitemap:\n"), ("https://f.com", None)], "origin string, body string")
    assert ("https://e.com", "https://e.com/s.xml") in rows_of(sitemap.discover_sitemaps(robots)) and sitemap.discover_sitemaps(robots).count() == 7
    many = "<x>" + "".join(f"<loc>https://e.com/{i}</loc>" for i in range(20_005))
    assert spark.range(1).select(F.size(sitemap.locations(F.lit(many), ("e.com",)))).first()[0] == 20_000
    bodies = spark.createDataFrame([("https://e.com/s.xml", "<loc>https://e.com/t.xml</loc><loc>https://e.com/a</loc>"), ("https://e.com/t.xml", "<loc>https://e.com/s.xml</loc><loc>https://e.com/b</loc><loc>https://x.net/</loc>")], "url string, body string")
    starts = spark.createDataFrame([("https://e.com/s.xml",), ("https://e.com/z",)], "url string")
    assert rows_of(sitemap.expand(starts, bodies, ("e.com",))) == [("https://e.com/a",), ("https://e.com/b",), ("https://e.com/z",)]


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d"), ("d", "e"), ("x", "y"), (None, "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows_of(crawl.bfs(edges, start, 10)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows_of(crawl.bfs(edges, start, 1)) == [("a", 0), ("b", 1), ("c", 1)]
    assert crawl.bfs(edges, start, 10, max_nodes=2).count() == 2


def test_crawl_and_manifest(spark):
    pages = {"": '<a href="/a"></a><a href="/f.pdf">', "a": '<a href="/b"></a><a href="/"></a><img src="/i.png" alt="x">', "b": '<a href="/c"></a>', "c": "end"}
    bodies = spark.createDataFrame([(f"https://example.com/{k}", v) for k, v in pages.items()], "url string, body string")
    starts = spark.createDataFrame([("http://example.com/#x",)], "url string")
    options = Options(allowed_hosts=("example.com",), max_depth=2)
    out = crawl.crawl(starts, fetch.fetch_from(bodies), lambda p: links.discover(p, hosts=options.allowed_hosts), options)
    assert rows_of(out["pages"].select("url", "depth")) == [("https://example.com/", 0), ("https://example.com/a", 1), ("https://example.com/b", 2)]
    assert rows_of(out["assets"].select("url", "kind", "alt")) == [("https://example.com/f.pdf", "pdf", None), ("https://example.com/i.png", "image", "x")]
    m = crawl.manifest(out["pages"], out["assets"], now())
    assert records.manifest_pages(m).count() == 3 and records.manifest_assets(m.withColumn("src_hint", F.col("src_hint")), "image").count() == 1
    capped = crawl.crawl(starts, fetch.fetch_from(bodies), lambda p: links.discover(p), Options(allowed_hosts=("example.com",), max_pages=2))
    assert capped["pages"].count() == 2
    assert crawl.crawl(starts.limit(0), fetch.fetch_from(bodies), links.discover, options)["pages"].count() == 0


@pytest.mark.parametrize("limit", [1, 3, 5, 8, None])
def test_max_pages_counts_pages_that_answer(spark, limit):
    """Of ten pages the last five answer; those that don't are told, and none is lost for them."""
    urls = [f"https://example.com/{k}" for k in range(10)]
    bodies = spark.createDataFrame([(u, "<p>x</p>") for u in urls[5:]], "url string, body string")
    out = crawl.crawl(spark.createDataFrame([(u,) for u in urls], "url string"), fetch.fetch_from(bodies), links.discover, Options(allowed_hosts=("example.com",), max_pages=limit))
    assert rows_of(out["pages"].select("url")) == [(u,) for u in urls[5:][: limit or 5]]
    assert {r["url"] for r in out["failed"].collect()} >= set(urls[:5])


def test_links_are_resolved_against_the_canonical_url():
    page = links.parse_page('<a href="c"></a><link rel="canonical" href="/a/b/"><a href="/d"></a>', "https://e.com/x/y")
    assert page["links"] == ["https://e.com/a/b/c", "https://e.com/d"] and page["canonical"] == "https://e.com/a/b/" and page["error"] is None
    assert links.parse_page('<a href="c"></a>', "https://e.com/x/y")["links"] == ["https://e.com/x/c"]


def test_odd_markup_costs_one_page(spark):
    pages = spark.createDataFrame([("https://e.com/1", '<a href="/a"></a><![foo[x]]><a href="/b"></a>'), ("https://e.com/2", '<a href="/c"></a>'), ("https://e.com/3", None)], "url string, html string")
    got = {r["url"][-1]: r["found"] for r in links.discover(pages).collect()}
    assert got["1"]["links"] == ["https://e.com/a"] and got["1"]["error"] and got["2"]["links"] == ["https://e.com/c"] and got["2"]["error"] is None and got["3"]["links"] == []


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "k int").repartition(7)
    assert [(r["k"], r["n"]) for r in crawl.numbered(rows, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_download(spark, tmp_path):
    """Assets are tried once per page that mentions them until one attempt succeeds; bytes are stored and read back."""
    kind = "url string, kind string, page string, alt string, src_hint string, depth int, at int"
    rows = [("https://e.com/a.pdf", "pdf", "p1", None, None, 0, 0), ("https://e.com/a.pdf", "pdf", "p2", None, None, 1, 0), ("https://e.com/b.png", "image", "p1", "x", "b.png", 0, 1), ("https://e.com/c.png", "image", "p1", "", "", 0, 2), ("https://e.com/old.png", "image", "p1", "", "", 0, 3), (None, "image", "p1", "", "", 0, 4)]

    def make():
        def get(url, headers):
            if url.endswith("a.pdf") and headers["Referer"] == "p1":
                return 403, None, None
            if url.endswith("c.png"):
                raise OSError
            return 200, "x", url.encode()

        return get

    seen = spark.createDataFrame([("https://e.com/old.png",)], "url string")
    found, failed = fetch.download(spark.createDataFrame(rows, kind), make, 1000, seen)
    assert [(r["url"], r["page"], bytes(r["body"])) for r in found.orderBy("url").collect()] == [("https://e.com/a.pdf", "p2", b"https://e.com/a.pdf"), ("https://e.com/b.png", "p1", b"https://e.com/b.png")]
    assert rows_of(failed.select("url", "status")) == [("https://e.com/c.png", None)]
    once, lost = fetch.download(spark.createDataFrame(rows, kind), make, 1000, seen, attempts=1)
    assert once.count() == 1 and lost.count() == 2
    pages = spark.createDataFrame([("https://e.com/", "<p>ü</p>")], "canonical string, html string")
    for _ in range(2):
        crawl.write_raw(crawl.raw_files(pages, found), str(tmp_path / "raw"))
    assert [bytes(r["content"]).decode() for r in crawl.read_raw(spark, str(tmp_path / "raw"), "html").collect()] == ["<p>ü</p>"]
    assert rows_of(crawl.read_raw(spark, str(tmp_path / "raw"), "pdf").select("path", "url")) == [(hashlib.sha1(b"https://e.com/a.pdf").hexdigest() + ".pdf", "https://e.com/a.pdf")]


def test_fetcher_and_limiter(spark):
    slots = fetch.Slots(2.0)
    assert [slots.book(h, t) for h, t in (("a", 0.0), ("a", 0.0), ("b", 0.1), ("a", 0.2), ("a", 9.0))] == [0, 0.5, 0, 0.8, 0]

    def make():
        def get(url):
            if url.endswith("bad"):
                raise OSError
            return 200, "text/html", url[::-1]

        return get

    urls = spark.createDataFrame([("https://e.com/ok",), ("https://e.com/bad",)], "url string")
    assert rows_of(fetch.fetch_all(make, 100)(urls).select("url", "status")) == [("https://e.com/bad", None), ("https://e.com/ok", 200)]


# --- Vectors --------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[3] = x[4]
    x[5] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 3, 5)], "query_id long, query_vector array<float>")
    got = rows_of(retrieve.top_k_many(rows, asked, 4, block_bytes=130).select("query_id", "rank", "id"))
    y = x.astype(np.float64)
    y /= np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None]
    expected = [(q, r + 1, int(i)) for q in (0, 3, 5) for r, i in enumerate(np.lexsort((np.arange(60), -np.round(y @ y[q], 12)))[:4])]
    assert got == sorted(expected)
    assert [r["id"] for r in retrieve.top_k(rows.filter("size(embedding) = 8"), x[0].tolist(), 4).orderBy("rank").collect()] == [i for q, _, i in expected if q == 0]
    assert retrieve.top_k_many(rows, asked, 1000).count() == 3 * 60
    assert retrieve.top_k_many(rows, asked.limit(0), 4).count() == 0


def test_search_keeps_the_smallest_ids_of_equal_vectors(spark):
    """Many equal vectors, more than are kept and more than a slice holds, in many batches."""
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, size=(400, 3)).astype(np.float32)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(400), x)], "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "query_id long, query_vector array<float>")
    vectors = {r["id"]: np.array(r["embedding"], float) for r in rows.collect()}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in vectors.items()}
    slices = retrieve.SLICE, retrieve.QUERIES
    try:
        retrieve.SLICE, retrieve.QUERIES = 16, 7
        got = retrieve.top_k_many(rows, asked, 5).collect()
    finally:
        retrieve.SLICE, retrieve.QUERIES = slices
    for q in range(30):
        own = x[q].astype(float) / (np.linalg.norm(x[q]) or 1)
        expected = sorted(unit, key=lambda i: (-round(float(unit[i] @ own), 9), i))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == expected


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.1)], "query_id long, rank int, s double")
    got = retrieve.rerank(rows, F.col("s"), 3).orderBy("rank").collect()
    assert [(r["rank"], r["retrieval_rank"]) for r in got] == [(1, 2), (2, 1), (3, 3)]


def test_index_search_and_answers(spark, tmp_path):
    path = str(tmp_path / "vectors")
    kind = "id string, text string, metadata struct<url:string>"
    records_ = spark.createDataFrame([("1", "the cat sat on the mat", {"url": "a"}), ("2", "stock markets fell today", {"url": "b"}), ("3", "a cat and a mat", {"url": "a"})], kind)
    assert index.read_vectors(spark, path).count() == 0
    records.write_table(index.new_vectors(records_, index.read_vectors(spark, path)), path, append=True)
    assert index.new_vectors(records_, index.read_vectors(spark, path)).count() == 0
    vectors = index.read_vectors(spark, path)
    asked = spark.createDataFrame([(7, "cat on mat")], "query_id long, query string")
    hits = retrieve.search(vectors, asked, index.embed, Options(mode="plain", top_k=2)).orderBy("rank").collect()
    assert [r["id"] for r in hits][0] in ("1", "3") and 0 <= hits[0]["score"] <= 1
    reranked = retrieve.search(vectors, asked, index.embed, Options(mode="rerank", initial_k=3, final_k=2))
    assert {r["url"] for r in reranked.collect()} == {"a"}
    out = retrieve.answer(asked, reranked, lambda: lambda p: f"{len(p)} characters").first()
    assert out["sources"] == ["a"] and out["prompt"].count("[source] a") == 2 and out["answer"] == f"{len(out['prompt'])} characters"
    only_b = retrieve.search(vectors, asked, index.embed, Options(mode="plain"), where=F.col("metadata.url") == "b")
    assert [r["id"] for r in only_b.collect()] == ["2"]
    with pytest.raises(ValueError):
        retrieve.search(vectors, asked, index.embed, Options(mode="other"))
    loaded = str(tmp_path / "loaded")
    assert index.load(spark, loaded, records_.union(records_)) == {"added": 3, "total": 3} and index.declared_metric(spark, loaded) == "cosine"
    assert index.load(spark, loaded, records_.union(spark.createDataFrame([("9", "z", {"url": None})], kind))) == {"added": 1, "total": 4}
    assert index.delete_source(spark, loaded, "a") == 2 and index.declared_metric(spark, loaded) == "cosine" and index.read_vectors(spark, loaded).count() == 2
    with pytest.raises(Exception):  # a path that holds something else isn't taken for an empty table
        (tmp_path / "odd").write_text("no table")
        index.read_vectors(spark, str(tmp_path / "odd")).count()
    assert index.delete_source(spark, path, "none") == 0 and index.delete_source(spark, path, "a") == 2
    assert rows_of(index.read_vectors(spark, path).select("id")) == [("2",)]
    fresh = spark.createDataFrame([("4", "new", {"url": "b"}), ("5", "newer", {"url": "c"})], kind)
    assert index.update_source(spark, path, fresh) == 2
    assert rows_of(index.read_vectors(spark, path).select("id")) == [("4",), ("5",)]


def test_answers_by_brute_force(spark):
    """Embedding, search, reranking and prompts of many questions against the same steps one by one."""
    rng = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(60)])
    texts = [" ".join(rng.choice(words, 12)) for _ in range(80)]
    vectors = spark.createDataFrame([(f"c{i}", t, {"url": f"u{i % 7}"}) for i, t in enumerate(texts)], "id string, text string, metadata struct<url:string>").withColumn("embedding", index.embed(F.col("text")))
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 5))) for q in range(9)], "query_id long, query string")
    hits = retrieve.search(vectors, asked, index.embed, Options(initial_k=20, final_k=4)).collect()
    answers = {r["query_id"]: r for r in retrieve.answer(asked, spark.createDataFrame(hits), lambda: lambda p: p[-5:]).collect()}
    model = index.HashEmbedder()
    known = model(texts).astype(np.float64)
    for q, text in ((r["query_id"], r["query"]) for r in asked.collect()):
        sims = known @ model([text])[0].astype(np.float64)
        first = sorted(range(80), key=lambda i: -sims[i])[:20]
        scores = dict(zip(first, retrieve.overlap_reranker([(text, texts[i]) for i in first])))
        best = sorted(first, key=lambda i: -scores[i])[:4]
        own = sorted((h for h in hits if h["query_id"] == q), key=lambda h: h["rank"])
        assert [h["id"] for h in own] == [f"c{i}" for i in best] and np.allclose([h["score"] for h in own], [scores[i] for i in best])
        contexts = "\n\n---\n\n".join(f"[source] u{i % 7}\n{texts[i]}" for i in best)
        assert answers[q]["prompt"] == retrieve.PROMPT % (text, contexts) and answers[q]["sources"] == [*dict.fromkeys(f"u{i % 7}" for i in best)] and answers[q]["answer"] == contexts[-5:]


# --- Reports, records, streams --------------------------------------------------------------------


def test_reports(spark):
    rows = spark.createDataFrame([("a", "xxxx"), ("a", "xxxxx"), (None, None)], "k string, text string")
    assert rows_of(report.breakdown(rows, F.col("k"))) == [("a", 2, 66.67, "key"), ("total", 3, 100.0, "total"), ("unknown", 1, 33.33, "unknown")]
    named = spark.createDataFrame([("total",), ("unknown",), (None,)], "k string")
    assert rows_of(report.breakdown(named, F.col("k")).select("key", "n", "kind")) == [("total", 1, "key"), ("total", 3, "total"), ("unknown", 1, "key"), ("unknown", 1, "unknown")]
    assert rows_of(report.breakdown(named.limit(0), F.col("k"))) == [("total", 0, None, "total")]
    assert tuple(report.totals(rows).first()) == (3, 9, 3, 3.0, 1.0)


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([("1", "ไทย   line", None)], "id string, text string, title string")
    records.write_jsonl(rows, path)
    records.write_jsonl(rows, path, append=True)
    back = records.well_formed(records.read_documents(spark, path))
    assert [(r["id"], r["text"]) for r in back.collect()] == [("1", "ไทย   line")] * 2


def test_manifest_join(spark):
    m = spark.createDataFrame([("page", None, "u", "c", "x/1.html", None), ("page", None, "u", None, "x/2.html", None), ("asset", "pdf", "p", None, None, "y/a.pdf"), ("asset", "image", "i", None, None, "")], "record string, asset_type string, url string, canonical string, html_path string, path string")
    m = m.selectExpr("*", "cast(null as string) page", "cast(null as string) alt", "cast(null as string) src_hint", "current_timestamp() ts")
    files = spark.createDataFrame([("file:/raw/x/1.html", b"h"), ("file:/raw/z/1.html", b"other"), ("file:/raw/y/a.pdf", b"p")], "path string, content binary")
    assert [(r["url"], bytes(r["content"])) for r in records.with_content(records.manifest_pages(m), files).collect()] == [("c", b"h")]
    assert [bytes(r["content"]) for r in records.with_content(records.manifest_assets(m, "pdf"), files).collect()] == [b"p"]
    assert records.manifest_assets(m, "image").count() == 0
    moved = records.manifest_pages(m).withColumn("path", F.lit("C:\\old\\a.pdf"))
    assert records.with_content(moved, files).count() == 0
    assert [bytes(r["content"]) for r in records.with_content(moved, files.filter("path NOT LIKE '%z/%'"), by_name=True).collect()] == [b"p"]
    with pytest.raises(ValueError):
        records.with_content(moved, files, by_name=True)


def test_stream(spark, tmp_path):
    kind = "id long, content_hash string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "aaaaaaaa"), (2, "aaaaaaaa"), (3, "bbbbbbbb")], [(4, "bbbbbbbb"), (5, "cccccccc")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        q = stream.ingest(stream.read_stream(spark, source, spark.createDataFrame([], kind).schema), out, str(tmp_path / "checkpoint"))
        q.awaitTermination()
    assert rows_of(spark.read.parquet(out).select("id")) == [(1,), (3,), (5,)]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert T.SEPARATORS[0] == "\n\n"
