"""The registered queries, each over whole tables, with DuckDB SQL for what SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..functions import ocr as O
from ..functions import text as T
from ..functions import tokens as K
from ..functions import url as U
from ..functions import vector as V
from ..operators import chunk, crawl, documents, index, links, normalize, report, retrieve
from ..operators.dedup import dedup_incremental, keep_first
from ..sources import sitemap
from ..sources.fetch import fetch_from
from ..storage import cut, new_path
from .registry import query

HOSTS = ("example.com", "example.org")
WIDTH, SHARED = 1843, 219  # characters of 512 tokens, and of an overlap of 61
SIM = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"
VECTORS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, v, label AS query_label FROM e WHERE vec_id % 20 = 0)"
ROUNDED = "round({}, 4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _queries(e: DataFrame) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 20."""
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


# --- Search ---------------------------------------------------------------------------------------


@query(f"""
WITH {VECTORS}, s AS (SELECT query_id, vec_id, {SIM} AS sim FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(sim, 4) AS sim, round((sim + 1) / 2, 4) AS score01 FROM r WHERE rank <= 5
""")
def vector_topk_plain(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = retrieve.top_k_many(e, _queries(e), 5, "vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("sim", 4).alias("sim"), F.round(V.score01(F.col("sim")), 4).alias("score01"))


@query(f"""
WITH {VECTORS}, s AS (SELECT query_id, vec_id, {SIM} AS sim FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(sim, 4) AS sim FROM r WHERE rank <= 50
""")
def vector_topk_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieve.top_k_many(e, _queries(e), 50, "vec_id").withColumn("sim", F.round("sim", 4))


@query(f"""
WITH {VECTORS}, s AS (SELECT query_id, vec_id, {SIM} AS sim FROM q, e WHERE label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(sim, 4) AS sim FROM r WHERE rank <= 5
""")
def vector_topk_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieve.top_k_many(e.filter("label = 1"), _queries(e), 5, "vec_id").withColumn("sim", F.round("sim", 4))


@query(f"""
WITH {VECTORS}, s AS (SELECT query_id, query_label, vec_id, label, {SIM} AS sim FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS retrieval_rank FROM s),
c AS (SELECT *, CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS score FROM r WHERE retrieval_rank <= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS rank FROM c)
SELECT query_id, vec_id, rank::INT AS rank, retrieval_rank::INT AS retrieval_rank, score FROM f WHERE rank <= 10
""")
def rerank_two_stage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = _queries(e)
    hits = retrieve.top_k_many(e, q, 50, "vec_id").join(q.select("query_id", "query_label"), "query_id").join(e.select("vec_id", "label"), "vec_id")
    score = F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.25)
    return retrieve.rerank(hits, score, 10).select("query_id", "vec_id", "rank", "retrieval_rank", "score")


@query(f"""
WITH {VECTORS}, s AS (SELECT query_id, vec_id, {SIM} AS sim FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s),
h AS (SELECT query_id, rank, '[source] ' || d.source || chr(10) || d.text AS c FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rank <= 5)
SELECT query_id, sha1('Use nothing but the sources below. If they do not hold the answer, say that it was not found.' || chr(10)
  || 'Be brief, write in the language of the question, and name the addresses of the sources used.' || chr(10) || chr(10)
  || 'Question: ' || query_id || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg(c, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS prompt_sha1
FROM h GROUP BY query_id
""")
def context_prompt(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "source", "text")
    hits = retrieve.top_k_many(e, _queries(e), 5, "vec_id").join(docs, "vec_id")
    hits = hits.withColumn("context", retrieve.context(F.col("source"), F.col("text")))
    out = retrieve.assembled(hits)
    return out.select("query_id", F.sha1(retrieve.prompt(F.col("query_id").cast("string"), F.col("contexts"))).alias("prompt_sha1"))


# --- Dedup ----------------------------------------------------------------------------------------


@query("SELECT doc_id, sha1(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.sha1(F.col("text")).alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS content_hash FROM documents GROUP BY 2")
def dedup_keep_first(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.sha1(F.col("text")).alias("content_hash"))
    return keep_first(rows, "content_hash", "doc_id")


@query("""
WITH h AS (SELECT doc_id, source, sha1(text) AS content_hash FROM documents),
seen AS (SELECT content_hash FROM h WHERE source < 'src5')
SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE source >= 'src5' AND content_hash NOT IN (SELECT content_hash FROM seen) GROUP BY content_hash
""")
def dedup_incremental_run(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", T.sha1(F.col("text")).alias("content_hash"))
    seen = rows.filter("source < 'src5'").select("content_hash")
    return dedup_incremental(rows.filter("source >= 'src5'").drop("source"), seen, "content_hash", "doc_id")


@query("SELECT min(doc_id) AS doc_id, source, sha1(text) AS content_hash FROM documents GROUP BY source, sha1(text)")
def dedup_per_source(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", T.sha1(F.col("text")).alias("content_hash"))
    return dedup_incremental(rows, None, "content_hash", "doc_id", scope="source")


# --- Gates and structure --------------------------------------------------------------------------

UNREADABLE = r"""length(regexp_replace(text, '[A-Za-z0-9\x{0E00}-\x{0E7F}\s.,;:''"!?()\[\]{}\-_/\\@#%&*+|=<>~`°–—…·•]', '', 'g')) / greatest(length(text), 1)::DOUBLE"""
FEEDS = "(length(text) - length(replace(text, chr(10), '')))"
STRUCTURED = rf"""(regexp_matches(text, '(?m)^\s*#{{1,6}}\s+.+') OR regexp_matches(text, '(?is)<\s*table[\s>].*?>')
  OR (regexp_matches(text, '(?m)^\s*\|.*\|\s*$') AND regexp_matches(text, '(?m)^\s*\|\s*:?-{{3,}}.*\|\s*$')) OR ({FEEDS} >= 3 AND {FEEDS} / greatest(length(text), 1)::DOUBLE > 0.002))"""
QC = f"(text <> '' AND length(text) >= 150 AND NOT contains(text, chr(65533)) AND {UNREADABLE} < 0.05)"


@query(f"SELECT doc_id, round({UNREADABLE}, 4) AS unreadable, {QC} AS ok FROM documents")
def qc_ok(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.unreadable_share(F.col("text")), 4).alias("unreadable"), T.qc_ok(F.col("text"), 150).alias("ok"))


@query(f"SELECT doc_id, {STRUCTURED} AS structured FROM documents")
def looks_structured(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.looks_structured(F.col("text")).alias("structured"))


KIND = "CASE WHEN source < 'src4' THEN 'html' WHEN source < 'src8' THEN 'image' ELSE 'pdf_md' END"


def _kind():
    return F.expr(KIND)


@query(f"""
WITH p AS (SELECT doc_id, CASE WHEN {KIND} <> 'image' AND {STRUCTURED} THEN 'structured' ELSE 'ocr_raw' END AS profile FROM documents)
SELECT doc_id, profile, CASE profile WHEN 'structured' THEN 512 ELSE 256 END::INT AS size, CASE profile WHEN 'structured' THEN 61 ELSE 51 END::INT AS overlap FROM p
""")
def profile_params(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.profile(_kind(), F.col("text")).alias("profile"))
    return rows.select("doc_id", "profile", T.profile_size(F.col("profile")).alias("size"), T.profile_overlap(F.col("profile")).alias("overlap"))


TABLES = (
    (-1, "| a | b |\n|---|:--:|\n| 1 | 2 |"),
    (-2, "| a | b |\n|--|--|"),
    (-3, "<TABLE><tr></tr></TABLE>"),
    (-4, "| a | b |\ntext"),
    (-5, "  | a |  \n :--- "),
    (-6, ""),
)


@query(r"""
WITH rows(doc_id, text) AS (VALUES (-1, E'| a | b |\n|---|:--:|\n| 1 | 2 |'), (-2, E'| a | b |\n|--|--|'), (-3, '<TABLE><tr></tr></TABLE>'), (-4, E'| a | b |\ntext'), (-5, E'  | a |  \n :--- '), (-6, '')),
a AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM rows),
l AS (SELECT doc_id, text, [trim(x) for x in string_split(text, chr(10))] AS lines FROM a),
p AS (SELECT doc_id, text, lines, unnest(range(1, len(lines))) AS i FROM l),
c AS (SELECT doc_id, lines[i] AS a, [trim(x) for x in string_split(lines[i + 1], '|') if trim(x) <> ''] AS cells FROM p),
t AS (SELECT doc_id FROM c WHERE starts_with(a, '|') AND ends_with(a, '|') AND len(cells) > 0
  AND len([x for x in cells if regexp_full_match(x, '[-: ]+') AND length(replace(replace(x, ':', ''), ' ', '')) >= 3]) = len(cells))
SELECT doc_id::BIGINT AS doc_id, contains(lower(text), '<table') OR doc_id IN (SELECT doc_id FROM t) AS has_table FROM a
""")
def md_has_table(spark, sf_dir):
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in TABLES])))
    return _docs(spark, sf_dir).select("doc_id", "text").union(extra).select("doc_id", T.md_has_table(F.col("text")).alias("has_table"))


@query("SELECT doc_id, floor(length(text) / 3.6::DOUBLE)::BIGINT AS tokens, length(text)::BIGINT AS chars FROM documents")
def token_approx(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.approx_tokens(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS preview FROM documents")
def preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(rf"""
WITH g AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\x{{0E00}}-\x{{0E7F}}]', '', 'g')) AS thai FROM documents)
SELECT doc_id, coalesce(length(text) >= 150 AND greatest(latin, thai) / greatest(n, 1)::DOUBLE >= 0.70, false) AS usable FROM g
""")
def usable_th_en(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.usable_th_en(F.col("text")).alias("usable"))


@query(rf"""
WITH g AS (SELECT doc_id, source, text, length(text) AS n, {QC} AS qc,
  length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents),
a AS (SELECT *, qc AND ((n >= 150 AND latin / greatest(letters, 1)::DOUBLE >= 0.65) OR n >= 300) AS ok FROM g)
SELECT doc_id, CASE WHEN source < 'src5' AND ok THEN 'markdown' WHEN ok THEN 'plain' ELSE 'pages' END AS step FROM a
""")
def pdf_cascade(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", documents.pdf_step(F.when(F.col("source") < "src5", text), text).alias("step"))


# --- Chunks ---------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {WIDTH}) / {WIDTH - SHARED}::DOUBLE))::BIGINT + 1)) AS i FROM documents WHERE text <> '')
SELECT doc_id, i::INT AS chunk_index, sha1(substr(text, i * {WIDTH - SHARED} + 1, {WIDTH})) AS chunk_sha1 FROM c
""")
def hard_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunk.hard_chunks(F.col("text"), WIDTH, SHARED)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.sha1("c").alias("chunk_sha1"))


def _chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(T.sha1(F.col("text")).alias("content_hash"), F.col("source").alias("source_url"), _kind().alias("source_type"), "text")
    return chunk.chunk_documents(docs)


_WINDOWS = "[substr({t}, i * step + 1, width) for i in range(0, greatest(0, ceil((length({t}) - width) / step::DOUBLE))::BIGINT + 1)]"
CHUNKS = rf"""
d AS (SELECT sha1(text) AS parent, trim(text, E' \t\n\r\v\f') AS text, {KIND} AS kind FROM documents WHERE trim(text, E' \t\n\r\v\f') <> '' QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY source, {KIND}) = 1),
e AS (SELECT parent, text, CASE WHEN kind <> 'image' AND {STRUCTURED} THEN 'structured' ELSE 'ocr_raw' END AS profile FROM d),
p AS (SELECT *, CASE profile WHEN 'structured' THEN 512 ELSE 256 END AS size, CASE profile WHEN 'structured' THEN 61 ELSE 51 END AS overlap,
  CASE WHEN contains(text, E'\n\n') THEN E'\n\n' WHEN contains(text, E'\n') THEN E'\n' WHEN contains(text, '. ') THEN '. ' WHEN contains(text, ' ') THEN ' ' END AS sep FROM e),
w AS (SELECT *, floor(size * 3.6::DOUBLE)::BIGINT AS width, floor(size * 3.6::DOUBLE)::BIGINT - floor(overlap * 3.6::DOUBLE)::BIGINT AS step FROM p),
f AS (SELECT *, list_reduce([{{'gone': []::VARCHAR[], 'held': ''}}] || [{{'gone': []::VARCHAR[], 'held': x}} for x in string_split(text, sep)], lambda a, x: CASE
  WHEN floor(length(CASE WHEN a.held = '' THEN x.held ELSE a.held || sep || x.held END) / 3.6::DOUBLE) <= size THEN {{'gone': a.gone, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || sep || x.held END}}
  WHEN a.held = '' THEN {{'gone': a.gone || {_WINDOWS.format(t="x.held")}, 'held': ''}}
  WHEN floor(length(right(a.held, 4 * overlap) || x.held) / 3.6::DOUBLE) <= size THEN {{'gone': a.gone || [a.held], 'held': right(a.held, 4 * overlap) || x.held}}
  ELSE {{'gone': a.gone || [a.held] || {_WINDOWS.format(t="(right(a.held, 4 * overlap) || x.held)")}[:-2], 'held': {_WINDOWS.format(t="(right(a.held, 4 * overlap) || x.held)")}[-1]}} END) AS s FROM w),
c AS (SELECT parent, profile, CASE WHEN floor(length(text) / 3.6::DOUBLE) <= size THEN [text] WHEN sep IS NULL THEN {_WINDOWS.format(t="text")} WHEN s.held = '' THEN s.gone ELSE s.gone || [s.held] END AS pieces FROM f),
chunks AS (SELECT parent || ':' || (i - 1) AS id, profile, (i - 1)::INT AS chunk_index, len(pieces)::INT AS chunk_total, pieces[i] AS text FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM c))
"""


@query(f"WITH {CHUNKS} SELECT id, profile, chunk_index, chunk_total, floor(length(text) / 3.6::DOUBLE)::INT AS n_tokens, sha1(text) AS text_sha1 FROM chunks")
def separator_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "profile", "chunk_index", "chunk_total", "n_tokens", F.sha1("text").alias("text_sha1"))


@query(f"""
WITH {CHUNKS}, g AS (SELECT profile, count(*) AS n FROM chunks GROUP BY 1), t AS (SELECT profile, n, 'key' AS kind FROM g UNION ALL SELECT 'total', sum(n), 'total' FROM g)
SELECT profile, n::BIGINT AS n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM g), 2) AS share_pct, kind FROM t
""")
def chunks_by_profile(spark, sf_dir):
    return report.breakdown(_chunks(spark, sf_dir), F.col("profile"), "profile")


@query("""
WITH r AS (SELECT conv_id || ':' || turn AS id, text, role FROM conversations),
f AS (SELECT *, trim(text, E' \\t\\n\\r\\v\\f') <> '' AND length(text) >= 20 AND floor(length(text) / 3.6::DOUBLE) >= 8 AS ok FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY ok, sha1(text) ORDER BY id) AS n FROM f)
SELECT id, text, role AS url FROM k WHERE ok AND n = 1
""")
def normalize_embeddable(spark, sf_dir):
    return normalize.embeddable(_judged(spark, sf_dir)).select("id", "text", "metadata.url")


def _judged(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.col("role").alias("source_url"))
    return normalize.judged(rows, Options(dedup="sha1_text", min_chars=20, min_tokens=8))


@query("""
WITH f AS (SELECT text, trim(text, E' \\t\\n\\r\\v\\f') <> '' AND length(text) >= 20 AND floor(length(text) / 3.6::DOUBLE) >= 8 AS ok FROM conversations)
SELECT count(*) AS total, count(DISTINCT text) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS filtered, count(*) FILTER (ok) - count(DISTINCT text) FILTER (ok) AS deduped, 0::BIGINT AS malformed FROM f
""")
def normalize_counters(spark, sf_dir):
    return normalize.counters(_judged(spark, sf_dir))


# --- URLs, links, crawl ---------------------------------------------------------------------------

#: A url in normal form, in SQL: see functions/url.py.
CANONICAL = r"""
p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'a', 'p', 'q']) AS x FROM pages),
k AS (SELECT page_id, x, list_sort([{'k': split_part(t, '=', 1), 'v': CASE WHEN contains(t, '=') THEN substr(t, strpos(t, '=') + 1) ELSE '' END} for t in string_split(x.q, '&')
  if t <> '' AND split_part(t, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'fbclid', 'gclid', '_gl', 'ref')]) AS kv FROM p),
c AS (SELECT page_id, CASE WHEN lower(x.s) = 'http' THEN 'https' ELSE lower(x.s) END || '://' || lower(x.a) || regexp_replace(CASE WHEN x.p = '' THEN '/' ELSE replace(x.p, ' ', '%20') END, '/index\.html?$', '/')
  || CASE WHEN len(kv) = 0 THEN '' ELSE '?' || array_to_string([kv[i].k || '=' || replace(kv[i].v, ' ', '+') for i in range(1, len(kv) + 1) if i = 1 OR kv[i].k <> kv[i - 1].k], '&') END AS canonical FROM k)
"""


@query(f"WITH {CANONICAL} SELECT page_id, canonical FROM c")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


ALLOWED = r"regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*\.)?example\.(com|org)([/?#:]|$)')"


@query(f"SELECT page_id, {ALLOWED} AS allowed FROM pages")
def host_allowed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.host_allowed(F.col("url"), HOSTS).alias("allowed"))


@query(f"""
WITH {CANONICAL}, a AS (SELECT page_id, canonical FROM c JOIN pages USING (page_id) WHERE {ALLOWED})
SELECT canonical AS url, min(page_id) AS ordinal FROM a GROUP BY canonical
""")
def seed_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ordinal"))
    return crawl.seeds(pages, pages.limit(0), Options(allowed_hosts=HOSTS)).select("url", "ordinal")


HREFS = r"""SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages"""


@query(f"SELECT page_id, href, count(*)::BIGINT AS n FROM ({HREFS}) GROUP BY ALL")
def extract_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(links.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT DISTINCT page_id, regexp_extract(url, '^[^:]*://[^/?#]*') || href AS dst FROM ({HREFS})")
def link_targets(spark, sf_dir):
    """The parser's path: hrefs resolved against their page; all of them begin with a slash in this table."""
    found = links.discover(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.explode("found.links").alias("dst"))


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.title(F.col("html")).alias("title"))


@query(rf"""
WITH l AS (SELECT href FROM ({HREFS}) UNION ALL SELECT unnest(['/a.PDF', '/b.pdf?x=1', '/c.jpeg#f', '/d.tif', '/pdf', '/e.png.html']))
SELECT CASE WHEN regexp_matches(href, '(?i)\.pdf([?#].*)?$') THEN 'pdf' WHEN regexp_matches(href, '(?i)\.(png|jpe?g|webp|gif|bmp|tiff?)([?#].*)?$') THEN 'image' ELSE 'page' END AS kind, count(*)::BIGINT AS n FROM l GROUP BY 1
""")
def asset_classify(spark, sf_dir):
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("/a.PDF", "/b.pdf?x=1", "/c.jpeg#f", "/d.tif", "/pdf", "/e.png.html")))).alias("href"))
    rows = table(spark, sf_dir, "pages").select(F.explode(links.hrefs(F.col("html"))).alias("href")).union(more)
    return rows.groupBy(U.asset_class(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE h AS (SELECT DISTINCT page_id::VARCHAR AS p, href AS d FROM ({HREFS})), g AS (SELECT p AS src, d AS dst FROM h UNION ALL SELECT d, p FROM h),
walk(node, depth) AS (SELECT page_id::VARCHAR, 0 FROM pages WHERE page_id % 20 = 0 UNION SELECT g.dst, depth + 1 FROM walk JOIN g ON g.src = walk.node WHERE depth < 10)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node
""")
def crawl_bfs(spark, sf_dir):
    """Pages and what they link to, both ways, from the stated seeds, the pages whose id is divisible by 20, to the crawl's default depth."""
    pages = table(spark, sf_dir, "pages")
    h = pages.select(F.col("page_id").cast("string").alias("src"), F.explode(links.hrefs(F.col("html"))).alias("dst"))
    return crawl.bfs(h.union(h.select("dst", "src")), pages.filter("page_id % 20 = 0").select(F.col("page_id").cast("string").alias("node")), Options().max_depth)


@query(f"SELECT DISTINCT url FROM pages WHERE {ALLOWED}")
def sitemap_locs(spark, sf_dir):
    """Every page's url, in sitemaps of 50 that others list, with white space around it."""
    pages = table(spark, sf_dir, "pages").select("url", (F.floor(F.col("page_id") / 50)).alias("part"))
    loc = F.concat(F.lit("<url><LOC>\n "), F.col("url"), F.lit(" </LOC></url>"))
    name = F.concat(F.lit("https://example.com/map-"), F.col("part").cast("string"), F.lit(".xml"))
    maps = pages.groupBy("part").agg(F.array_join(F.collect_list(loc), "").alias("body")).select(name.alias("url"), "body")
    root = maps.agg(F.array_join(F.collect_list(F.concat(F.lit("<loc>"), F.col("url"), F.lit("</loc>"))), "").alias("body")).select(F.lit("https://example.com/sitemap.xml").alias("url"), "body")
    return sitemap.expand(root.select("url"), root.union(maps), HOSTS)


@query(f"""
WITH {CANONICAL}, a AS (SELECT canonical AS url, min(page_id) AS page_id FROM c JOIN pages USING (page_id) WHERE {ALLOWED} GROUP BY 1),
l AS (SELECT DISTINCT a.url, h.href FROM a JOIN ({HREFS}) AS h USING (page_id))
SELECT a.url AS canonical, 0::INT AS depth, count(href)::INT AS n_links FROM a LEFT JOIN l USING (url) GROUP BY a.url
""")
def crawl_pages(spark, sf_dir):
    """A crawl over the stored pages from all of them; of pages with the same canonical url, the first is stored."""
    pages = table(spark, sf_dir, "pages")
    stored = keep_first(pages.select(U.canonical_url(F.col("url")).alias("url"), "page_id", F.col("html").alias("body")), "url", "page_id")
    options = Options(allowed_hosts=HOSTS, max_depth=1, max_pages=None)
    out = crawl.crawl(pages.select("url"), fetch_from(stored.select("url", "body")), lambda p: links.discover(p, hosts=HOSTS), options)
    return out["pages"].select("canonical", "depth", F.size("found.links").alias("n_links"))


@query(f"""
WITH {CANONICAL}, a AS (SELECT DISTINCT canonical AS url FROM c JOIN pages USING (page_id) WHERE {ALLOWED}),
n AS (SELECT url, row_number() OVER (ORDER BY url) AS i, sha1(url) < '8' AS answers FROM a)
SELECT url FROM n WHERE answers QUALIFY row_number() OVER (ORDER BY i) <= 40
""")
def crawl_capped(spark, sf_dir):
    """A crawl that ends after 40 pages have answered, where half of the urls never do."""
    pages = table(spark, sf_dir, "pages")
    stored = pages.select(U.canonical_url(F.col("url")).alias("url"), F.lit("<p>x</p>").alias("body")).filter(F.sha1("url") < "8").distinct()
    options = Options(allowed_hosts=HOSTS, max_depth=0, max_pages=40)
    return crawl.crawl(pages.select("url"), fetch_from(stored), links.discover, options)["pages"].select("url")


# --- Pictures -------------------------------------------------------------------------------------


BOX = "(p_size * 8 + p_partkey % 7)::DOUBLE * (20 + p_partkey % 50)::DOUBLE"
PICTURES = "SELECT p_partkey AS id, 300 + p_partkey % 90 AS img_h, 400 + p_partkey % 300 AS img_w, p_partkey % 8 AS n, (p_partkey % 10) / 10.0::DOUBLE AS conf, p_name AS alt, p_brand AS words FROM part"


def _boxes(spark, sf_dir):
    """Made-up OCR results from the parts' columns: p_partkey % 8 equal boxes each, on either side of each limit of the gate."""
    key = F.col("p_partkey")
    x, y = (F.col("p_size") * 8 + key % 7).cast("double"), (20 + key % 50).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    poly = F.array(point(F.lit(0.0), F.lit(0.0)), point(x, F.lit(0.0)), point(x, y), point(F.lit(0.0), y))
    box = F.struct(poly.alias("poly"), F.col("p_brand").alias("text"), ((key % 10) / 10.0).alias("conf"))
    boxes = F.array_repeat(box, (key % 8).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("id"), (300 + key % 90).alias("img_h"), (400 + key % 300).alias("img_w"), boxes.alias("boxes"), F.col("p_name").alias("alt"))


@query(f"""
WITH p AS ({PICTURES}), b AS (SELECT p_partkey AS id, {BOX} AS area FROM part)
SELECT id, img_h >= 320 AND CASE WHEN n = 0 THEN contains(lower(alt), 'a') ELSE n >= 6 OR (n * area / (img_h * img_w) >= 0.08 AND conf >= 0.5) OR contains(lower(words), '#1') END AS infographic FROM p JOIN b USING (id)
""")
def ocr_gate(spark, sf_dir):
    keywords = F.when(F.size("boxes") == 0, O.is_infographic(F.col("img_h"), F.col("img_w"), F.col("boxes"), F.col("alt"), F.lit(""), ("a",)))
    return _boxes(spark, sf_dir).select("id", F.coalesce(keywords, O.is_infographic(F.col("img_h"), F.col("img_w"), F.col("boxes"), F.col("alt"), F.lit(""), ("#1",))).alias("infographic"))


@query(f"""
WITH p AS ({PICTURES}), b AS (SELECT p_partkey AS id, {BOX} AS area FROM part)
SELECT id, round(n * area / (img_h * img_w), 4) AS ratio, CASE WHEN n = 0 THEN 0.0 ELSE round(conf, 3) END::DOUBLE AS conf FROM p JOIN b USING (id)
""")
def poly_area(spark, sf_dir):
    ratio = O.area_ratio(F.col("boxes"), F.col("img_h"), F.col("img_w"))
    return _boxes(spark, sf_dir).select("id", F.round(ratio, 4).alias("ratio"), F.round(O.mean_confidence(F.col("boxes")), 3).alias("conf"))


# --- Reports and maintenance ----------------------------------------------------------------------


def _report_sql(key: str, rows: str) -> str:
    return f"""
WITH g AS (SELECT {key} AS key, count(*) AS n FROM {rows} GROUP BY 1),
t AS (SELECT coalesce(key, 'unknown') AS key, n, CASE WHEN key IS NULL THEN 'unknown' ELSE 'key' END AS kind FROM g UNION ALL SELECT 'total', sum(n), 'total' FROM g)
SELECT key, n::BIGINT AS n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM g), 2) AS share_pct, kind FROM t
"""


@query(_report_sql("lang", "documents"))
def report_by_lang(spark, sf_dir):
    return report.breakdown(_docs(spark, sf_dir), F.col("lang"))


@query(_report_sql("source", "documents"))
def report_by_source(spark, sf_dir):
    return report.breakdown(_docs(spark, sf_dir), F.col("source"))


@query(_report_sql("lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1))", "pages"))
def report_by_domain(spark, sf_dir):
    return report.breakdown(table(spark, sf_dir, "pages"), documents.domain(F.col("url")))


@query(_report_sql("CASE WHEN contains(text, '|') THEN 'with_bars' ELSE 'without' END", "documents"))
def report_by_bars(spark, sf_dir):
    return report.breakdown(_docs(spark, sf_dir), F.when(F.contains("text", F.lit("|")), "with_bars").otherwise("without"))


@query("""
SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4.0::DOUBLE)::BIGINT)::BIGINT AS tokens,
  round(avg(length(text)), 1) AS avg_chars, round(avg(ceil(length(text) / 4.0::DOUBLE)), 1) AS avg_tokens FROM documents
""")
def report_totals(spark, sf_dir):
    return report.totals(_docs(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The path of a vector table with a row per document."""
    path = new_path(spark, "vectors")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", F.struct(F.col("source").alias("url")).alias("metadata"))
    docs.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).write.parquet(path)
    return path


@query("SELECT doc_id::VARCHAR AS id, source AS url FROM documents WHERE source IS DISTINCT FROM 'src3'")
def delete_by_url(spark, sf_dir):
    path = _written(spark, sf_dir)
    index.delete_source(spark, path, "src3")
    return index.read_vectors(spark, path).select("id", "metadata.url")


@query("SELECT doc_id::VARCHAR AS id, source AS url FROM documents WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT 'new', 'src3'")
def update_by_url(spark, sf_dir):
    path = _written(spark, sf_dir)
    fresh = spark.range(1).select(F.lit("new").alias("id"), F.lit("renewed").alias("text"), F.struct(F.lit("src3").alias("url")).alias("metadata"))
    index.update_source(spark, path, fresh)
    return index.read_vectors(spark, path).select("id", "metadata.url")


@query("""
SELECT DISTINCT conv_id::VARCHAR AS id, 1::INT AS times FROM conversations
""")
def index_load(spark, sf_dir):
    """Two loads into a new table: first turns, then all others, of which only conversations that it lacks come in, each once."""
    path, turns = new_path(spark, "vectors"), table(spark, sf_dir, "conversations")
    records = turns.select(F.col("conv_id").cast("string").alias("id"), F.left("text", F.lit(40)).alias("text"), F.struct("role").alias("metadata"), "turn")
    records = records.withColumn("metadata", F.struct(F.col("metadata.role").alias("url")))
    for some in (records.filter("turn = 0"), records.filter("turn > 0")):
        index.load(spark, path, some.drop("turn"))
    return index.read_vectors(spark, path).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("times"))


def _html_documents(spark, sf_dir):
    return documents.corpus([documents.html_documents(table(spark, sf_dir, "pages"), F.lit("2025-01-01").cast("timestamp"))])


HTML_TEXT = r"""
a AS (SELECT url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(html, E'\t\n\r', '   '), '<!--.*?-->', '', 'gs'), '<head\b.*?</head>', '', 'gis'), '<(script|style)\b.*?</(script|style)>', '', 'gis'), '<nav\b.*?</nav>', chr(10), 'gis') AS t FROM pages),
b AS (SELECT url, html, regexp_replace(regexp_replace(t, '</?(p|br|div|article|h1|footer|ul|li|body|html)\b[^>]*>', chr(10), 'gi'), '<[/!]?[a-z][^>]*>', '', 'gi') AS t FROM a),
c AS (SELECT url, html, [trim(regexp_replace(x, '[\s\x{0B}\x{00A0}]+', ' ', 'g')) for x in string_split(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'), chr(10))] AS ls FROM b),
d AS (SELECT url, array_to_string([x for x in ls if x <> ''], chr(10)) AS text, replace(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), '&amp;', '&') AS title FROM c)
"""


@query(f"""
WITH {HTML_TEXT}
SELECT sha1(url) AS id, url AS source_url, sha1(text) AS content_hash, title, length(text)::INT AS n_chars FROM d WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY url) = 1
""")
def html_documents(spark, sf_dir):
    """SQL repeats the parser by the tags and entities that these pages have."""
    return _html_documents(spark, sf_dir).select("id", "source_url", "content_hash", "title", F.length("text_full").alias("n_chars"))


@query()
def rag_answers(spark, sf_dir):
    """No SQL, as embedder and reranker are functions: pages to documents, chunks, vectors; every benchmark item asked against them. The tests repeat it by brute force."""
    records = normalize.embeddable(normalize.judged(chunk.chunk_documents(_html_documents(spark, sf_dir))))
    vectors = records.select("id", "text", "metadata", index.embed(F.col("text")).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = cut(retrieve.search(vectors, asked, index.embed), "hits")
    best = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), " ").alias("hits"))
    return retrieve.answer(asked, hits).join(best, "query_id").select("query_id", "hits", F.array_join("sources", " ").alias("sources"), F.sha1("prompt").alias("prompt_sha1"))
