"""The queries opN_<name>: each operator over its whole table, and DuckDB SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exactdedup, langid, linededup, packing, quality, simhash, substring, urlfilter, warc
from .common import held_out, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of op1: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(r, ("host", "path", "verdict"))]) for r in RULES])
    return urlfilter.url_filter(table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(values)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exactdedup.normalised(F.col("text")), 256)
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"), extra={"text_sha256": digest})


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    found = langid.identify(docs, langid.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4, 2)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("items", lambda i: i.cast("string")), " ")
    return found.select("doc_id", "contaminated", items.alias("items"), F.round("best_score", 4).alias("best_score"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op1_url_filter": r"""
WITH rules(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
""",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM e
""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT d.doc_id, p, word, c.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) AS d LEFT JOIN c USING (doc_id, p)),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op9_line_dedup": r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, list_distinct([w for w in string_split_regex(lower(ls[i]), '[\x20\x09-\x0D]+') if w <> '']) AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
w AS (SELECT doc_id, i, len(ws) AS n, unnest(ws) AS w FROM l WHERE len(ws) > 0),
f AS (SELECT w, row_number() OVER (ORDER BY count(*), w) AS rarity FROM w GROUP BY w),
p AS (SELECT doc_id, i, n, w FROM w JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY rarity) <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT y.doc_id AS yd, y.i AS yi, x.doc_id AS xd, x.i AS xi FROM p AS x JOIN p AS y ON x.w = y.w AND (x.doc_id, x.i) < (y.doc_id, y.i) AND x.n * 4 <= y.n * 5 AND y.n * 4 <= x.n * 5),
g AS (SELECT DISTINCT yd AS doc_id, yi AS i FROM c JOIN l AS a ON a.doc_id = xd AND a.i = xi JOIN l AS b ON b.doc_id = yd AND b.i = yi WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (len(a.ws) + len(b.ws))),
o AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string([ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(gone, i)], chr(10)) END, '')) AS kept_sha256
FROM t LEFT JOIN o USING (doc_id)
""",
    "op10_decontamination": r"""
WITH r AS (SELECT item_id, text, regexp_extract(regexp_replace(regexp_replace(text, '\s+$', ''), '[.?!]+$', ''), '(?s)^(.*[.?!:\n])\s*(\S.*)$', ['q', 'a']) AS x, floor(log2(length(text) + 64.0) / 3) AS cls FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, cls, text, regexp_extract_all(lower(x.q), '[\p{L}\p{N}_]+') AS q, regexp_extract_all(lower(x.a), '[\p{L}\p{N}_]+') AS a FROM r),
i AS (SELECT item_id, cls, CASE WHEN len(q) > 0 AND len(a) > 0 THEN q ELSE regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') END AS q, CASE WHEN len(q) > 0 AND len(a) > 0 THEN a ELSE [] END AS a FROM s),
parts AS (SELECT item_id, cls, part, ws, least(5, len(ws)) AS n FROM (SELECT item_id, cls, 'q' AS part, q AS ws FROM i UNION ALL SELECT item_id, cls, 'a', a FROM i UNION ALL SELECT item_id, cls, 'w', q || a FROM i) WHERE len(ws) > 0),
sh AS (SELECT DISTINCT item_id, cls, part, n, array_to_string(ws[k:k + n - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM parts)),
size AS (SELECT item_id, part, count(*) AS size FROM sh GROUP BY ALL),
step AS (SELECT cls, max(len(ws)) AS step, count(*) AS items, avg(len(ws)) AS mean FROM parts WHERE part = 'w' GROUP BY cls),
f AS (SELECT item_id, cls, len(ws) AS len, w, count(*) AS f FROM (SELECT item_id, cls, ws, unnest(ws) AS w FROM parts WHERE part = 'w') GROUP BY ALL),
df AS (SELECT cls, w, count(*) AS n FROM f GROUP BY ALL),
imp AS (SELECT item_id, w, ln(1 + (items - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS v FROM f JOIN df USING (cls, w) JOIN step USING (cls)),
share AS (SELECT item_id, w, v / sum(v) OVER (PARTITION BY item_id) AS v FROM imp),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
ds AS (SELECT doc_id, n, k - 1 AS pos, array_to_string(ws[k:k + n - 1], ' ') AS sh FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM sh))),
m AS (SELECT doc_id, item_id, part, sh, pos, n, cls, step FROM ds JOIN sh USING (n, sh) JOIN step USING (cls)),
mp AS (SELECT *, pos // step AS p FROM m UNION ALL SELECT *, pos // step - 1 FROM m WHERE pos >= step AND pos + n <= (pos // step + 1) * step),
o AS (SELECT doc_id, item_id, p, part, count(DISTINCT sh) AS c FROM mp GROUP BY ALL),
h AS (SELECT doc_id, item_id, p, coalesce(max(c) FILTER (part = 'q'), 0) AS q, coalesce(max(c) FILTER (part = 'a'), 0) AS a, coalesce(max(c) FILTER (part = 'w'), 0) AS w FROM o GROUP BY ALL),
z AS (SELECT item_id, max(size) FILTER (part = 'q') AS q, coalesce(max(size) FILTER (part = 'a'), 0) AS a, max(size) FILTER (part = 'w') AS w FROM size GROUP BY ALL),
held AS (SELECT doc_id, item_id, p FROM h JOIN z USING (item_id) WHERE (5 * h.q >= 4 * z.q AND 5 * h.a >= 4 * z.a) OR (5 * h.w >= 4 * z.w AND CASE WHEN z.a > z.q THEN 5 * h.a >= 4 * z.a ELSE 5 * h.q >= 4 * z.q END)),
terms AS (SELECT DISTINCT doc_id, item_id, p, unnest(ws[p * step + 1:(p + 2) * step]) AS w FROM held JOIN d USING (doc_id) JOIN (SELECT DISTINCT item_id, cls FROM parts) USING (item_id) JOIN step USING (cls)),
score AS (SELECT doc_id, item_id, p, sum(v) AS score FROM terms JOIN share USING (item_id, w) GROUP BY ALL),
g AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ' ') AS items, round(max(score), 4) AS best_score FROM score GROUP BY doc_id)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, '') AS items, coalesce(best_score, 0.0::DOUBLE) AS best_score FROM d LEFT JOIN g USING (doc_id)
""",
}
