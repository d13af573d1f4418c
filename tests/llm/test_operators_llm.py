"""Each operator against a brute-force version on small made-up tables that hold the awkward cases."""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanwork import bitset
from gleanwork.llm.common import new_path
from gleanwork.llm import common, components, decontam, exactdedup, langid, linededup, packing, quality, queries, simhash, substring, urlfilter, warc

SPACE = "[\x20\x09-\x0d]+"
#: doc_id, text, and columns whose names the operators use inside.
KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, gone string, row string, score string, items string, lines string"


def made_up(seed=0, n=40):
    """Texts with copies, near copies, shared passages, repeated rows, nulls, odd white space and one very long text."""
    r = random.Random(seed)
    words = [f"w{r.randrange(400)}" for _ in range(300)] + ["the", "of", "and", "é", "ไทย", "X!"] * 20
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(30)
    rows = []
    for i in range(n):
        lines = [text(r.randrange(1, 40)) for _ in range(r.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(r.randrange(len(lines) + 1), passage)
        rows.append([i * 3 + 1, "\n".join(lines)])
    for k in range(6):  # exact copies, with other white space
        rows.append([200 + k, rows[k][1].replace(" ", "  ") if k % 2 else rows[k][1]])
    for k in range(6, 12):  # near copies: a word or two differ
        w = rows[k][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append([0 if k == 6 else 300 + k, " ".join(w)])
    rows += [[400, None], [401, ""], [402, " \t\n\x0b"], [403, "one"], [404, "one two"], [405, "One TWO"], [406, "a\nb\na\n\n\nb c d e f\nf e d c b\n"], [407, text(30_000)], [None, rows[0][1]], [None, None], [408, "12 + 34 = !?"]]
    rows.append(list(rows[5]))  # a row twice
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def frame(spark, rows, n=3):
    full = [(i, t, "en" if i is None or i % 2 else "fr", f"s{(i or 0) % 3}", len(t or ""), 7, 8, "g", "r", "s", "i", "l") for i, t in rows]
    return spark.createDataFrame(full, KIND).repartition(n)


@pytest.fixture(scope="module")
def rows():
    return made_up()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_bitset(spark):
    at = spark.createDataFrame([(0,), (7,), (32767,), (32768,), (99999,), (None,)], "at long")
    bits = bitset.build(at, F.col("at"), 100_000)
    probe = spark.range(131072).filter(bitset.has(bits, F.col("id")))
    assert got(probe, "id") == sorted([(0,), (7,), (32767,), (32768,), (99999,)], key=repr)
    assert not bitset.build(at.limit(0), F.col("at"), 1).selectExpr("exists(blocks, b -> exists(b, w -> w <> 0))").first()[0]
    with pytest.raises(ValueError):
        bitset.checked_bits(1 << 40)


def test_workers_hold_one_cache():
    common.worker_cache("a")["x"] = 1
    assert common.worker_cache("a") == {"x": 1} and common.worker_cache("b") == {} and common.worker_cache("a") == {}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or sum(x in f for f in edges if f[0] != f[1])}
    out = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: v for k, v in expected.items() if k in out} and {k for k in expected if expected[k] != k} <= set(out)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 --------------------------------------------------------------------------------------------

URLS = [
    "https://A.Example.org/es/x?q#f", "http://example.org/en/12", "http://notexample.org/en/1", "https://x.com/fr/", "https://com/de/1", "https://x.com/de", "ftp://net/", "no scheme", "", None,
    "https://e.org", "https://e.org?x=/es/", "x://u@y.org/#://z.com/fr/", "a://b://c.com/fr/", "https://.org/", "https://com.evil.net/fr/", "HTTPS://EXAMPLE.ORG/ES/", "https://example.org/en/1\n2",
]


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [r for r in rules if r[0] and host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
    best = max(fit, key=lambda r: (len(r[0] + (r[1] or "")), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + (best[1] or ""), best[2] if best else default


@pytest.mark.parametrize("rules", [queries.RULES, [("org", "", "block"), ("net", None, "block"), ("example.org", "/en/", "allow"), ("example.org", "/en/", "block"), (None, "/", "block"), ("", "/", "block")], []])
def test_url_filter(spark, rules):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, key long, rule string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    expected = sorted([(i, *judged(u, rules)) for i, u in enumerate([*URLS, URLS[0]])], key=repr)
    assert got(urlfilter.url_filter(pages, table), "page_id", "host", "path", "rule", "verdict") == expected
    assert urlfilter.url_filter(pages.limit(0), table).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 26, 40])
def test_url_filter_by_parts(spark, most_bits):
    """Hundreds of rules, of hosts and paths of any length, at once and in parts."""
    r = random.Random(2)
    hosts = [".".join(r.choice("abc") * r.randrange(1, 4) for _ in range(r.randrange(1, 4))) for _ in range(60)] + ["h" * 3000]
    rules = [(h, "/" + "x" * r.randrange(0, 3), r.choice(["allow", "block"])) for h in hosts]
    urls = [f"http://{r.choice(['', 'www.', 'a.'])}{r.choice(hosts)}/{'x' * r.randrange(4)}{'y' * (5000 if k == 7 else 1)}" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), most_bits=most_bits)
    expected = []
    for i, u in enumerate(urls):
        rest = u.split("://")[1]
        host, path = rest[: rest.index("/")], rest[rest.index("/") :]
        fits = sorted(((len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        rule = fits[0][2] if fits else None
        expected.append((i, rule, "block" if any(h + p == rule and v == "block" for h, p, v in rules) else "allow"))
    assert got(found, "page_id", "rule", "verdict") == sorted(expected, key=repr)


def test_cascade_is_exact(spark):
    """Many keys: the levels' false positives are all encoded."""
    universe = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = urlfilter.Cascade(universe.filter("crc32(key) % 10 = 0"), universe)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.has(F.col("key")) != (F.crc32("key") % 10 == 0)).count() == 0


# --- 2 --------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i is None, i))
    keep = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, v in groups.items()}
    expected = []
    for i, t in rows:
        k = re.sub(SPACE, "", t or "")
        expected.append((i, keep[k], len(groups[k]), i == keep[k]))
    assert got(exactdedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept") == sorted(expected, key=repr)
    assert exactdedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_with_full_filters(docs):
    """Filters with so few bits that everything passes only cost work."""
    columns = ("doc_id", "keep_id", "group_size", "kept")
    assert got(exactdedup.exact_dedup(docs, filter_bits=bitset.BLOCK, prefix_chars=1), *columns) == got(exactdedup.exact_dedup(docs), *columns)


# --- 3 --------------------------------------------------------------------------------------------


def test_language_kernel():
    """The model's scores are those of kernel ridge regression on Nyström features, with the kernel computed set by set."""
    r = random.Random(1)
    texts = ["".join(r.choice("abc " if i % 2 else "xyzé ") for _ in range(60)) + "a" for i in range(24)]
    langs = ["p" if i % 2 else "q" for i in range(24)]
    model = langid.fit(texts, langs, landmarks=4, ridge=0.1)

    def grams(t):
        t = f" {' '.join(t.lower().split())} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    z = [t for name in ("p", "q") for t in [x for x, y in zip(texts, langs) if y == name][:4]]
    kz, kx = np.array([[kernel(a, b) for b in z] for a in z]), np.array([[kernel(a, b) for b in z] for a in texts])
    w, v = np.linalg.eigh(kz)
    phi = kx @ (v[:, w > 1e-6 * w.max()] / np.sqrt(w[w > 1e-6 * w.max()]))
    y = np.array([[1 if x == n else -1 for n in ("p", "q")] for x in langs])
    expected = phi @ np.linalg.solve(phi.T @ phi + 0.1 * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(model.scores(texts), expected, atol=1e-3)


def test_language_id_cases(spark, docs, rows):
    model = langid.train(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i in (400, 401, 402, 408):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in out.values()) and len(langid.identify(docs, model).collect()) == len(rows)
    nothing = langid.train(docs.filter("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    changed = langid.identify(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz"), "doc_id": F.lit(5)}), model)
    assert got(changed, "text", "lang_pred", "score") == got(langid.identify(docs, model), "text", "lang_pred", "score")


def test_language_accuracy(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 300 and right / n >= 0.99


def test_share_of_known_letters():
    """Texts in a script or with words unlike the learned ones share few n-grams, whatever the regression says; digits and marks don't count."""
    model = langid.fit(["the cat sat on the mat and the dog ran", "le chat est sur la table et le chien court"] * 2, ["en", "fr"] * 2)
    foreign = ["Сегодня утром в городе было тихо", "今天早上城市很安静", "Σήμερα το πρωί", "zqx kvj wpq", "Цена 1000 руб. 3.14 (2019)"]
    assert max(map(model.known, foreign)) < 0.1
    assert min(map(model.known, ["The cat ran!", "le chien 4501042323994846 court", "the dog " * 5000, "dog = 40d78a45c418324758e099"])) >= 0.8
    assert langid.fit([], []).known("text") == 0


def test_pieces_and_tables_change_nothing(monkeypatch):
    """Texts give the same with the table of n-grams and without it, whole and in pieces; n-grams of symbols that no landmark has count too."""
    model = langid.fit(["the cat sat on the mat and the dog ran", "le chat est sur la table et le chien court"] * 2, ["en", "fr"] * 2)
    texts = ["the cat ran 12 times!", "the " * 400 + "日本", "", "x", "  ", "q1", "le\u0301 chien"]
    whole = model.scores(texts), [model.known(t) for t in texts]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert [model.rows_of(t)[1] for t in texts] == [len(grams(f" {' '.join(t.lower().split())} ")) for t in texts]
    for piece, symbols, together in ((1 << 20, 0, 1), (7, 160, 5)):
        monkeypatch.setattr(langid, "PIECE", piece), monkeypatch.setattr(langid, "SYMBOLS", symbols), monkeypatch.setattr(langid, "TOGETHER", together)
        model._tables.clear()
        assert np.allclose(model.scores(texts), whole[0]) and np.allclose([model.known(t) for t in texts], whole[1])


def test_training_sample(spark):
    """Long texts are learned from, the largest languages only, and at most so many texts of each; a dirty column is no burden."""
    rows = [(i, ("abc " if i % 2 else "xyz ") * (30_000 if i < 4 else 5), "p" if i % 2 else "q") for i in range(40)] + [(100 + i, "noise text", f"dirty{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs.filter("doc_id < 4")).languages == ["p", "q"]
    assert langid.train(docs, per_language=3, languages=2).languages == ["p", "q"]
    out = langid.identify(docs.withColumn("SCORE", F.lit(1)).withColumn("a.b", F.lit(2)), langid.train(docs, per_language=5, languages=2), known="known")
    assert out.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score", "known"]
    assert {(r["lang"], r["lang_pred"]) for r in out.filter("doc_id < 100").collect()} == {("p", "p"), ("q", "q")}


# --- 4 --------------------------------------------------------------------------------------------


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    expected = defaultdict(int)
    for i, t in rows:
        expected[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == binascii.crc32(np.array(r["ids"], "<u4").tobytes())
    single = {i for i, _ in rows if i is not None and sum(x[0] == i for x in rows) == 1}
    for i in single:
        pieces = sorted(per_doc[i], key=lambda r: r["start"])
        ids = tuple(x for p in pieces for x in p["ids"])
        assert (i, ids) in expected and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    assert sum(len(k[1]) * n for k, n in expected.items()) == sum(r["length"] for r in out)
    used = 0
    for pieces in per_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert (total := sum(p["length"] for p in pieces)) <= packing.CAPACITY
        used += total
    assert len(per_sequence) <= used / packing.CAPACITY * 1.02 + 2
    assert sorted(per_sequence) == list(range(len(per_sequence)))
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_cuts():
    for n in [*range(1, 5000), 100_000]:
        pieces = packing.cuts(n)
        assert sum(pieces) == n and all(0 < p <= packing.CAPACITY for p in pieces) and len(pieces) <= n // packing.CAPACITY + 6


def test_word_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    own = packing.WordEncoder(whole)
    assert isinstance(packing.encoder(queries.tokenizer_path()), packing.WordEncoder)
    texts = ["It's A\ttest\u00a0x\u2028y\x1cz  it'll", "ΑΣ ΑΣΑ. \u0301e e\u0301", "a<|endoftext|>b <|startoftext|> <|x", "日本 12.5% ---\r\n😀😀", "", " ", "'s 'S s'", "ｆｕｌｌ İ ß"]
    texts += [" ".join(texts), *(t or "" for _, t in made_up(3))]
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for cache, together in ((1 << 20, 1 << 20), (8, 100), (50, 1 << 20)):
        monkeypatch.setattr(packing, "CACHE", cache), monkeypatch.setattr(packing, "TOGETHER", together)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(iter(texts))] == expected


def test_packing_with_another_tokenizer(spark):
    """A tokenizer that isn't one of words, or has other steps, is asked for each text."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    one, texts = Tokenizer.from_file(path), ["It's A  test\n", "", "x" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = defaultdict(list)
    for r in sorted(packing.pack(docs, path, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(ids[r["doc_id"]])
        ids[r["doc_id"]] += r["ids"]
    assert dict(ids) == {i: [*one.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


# --- 5 --------------------------------------------------------------------------------------------


def print_of(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, rows):
    prints = [print_of(t) for _, t in rows]
    assert [simhash.fingerprint(t) for _, t in rows] == prints
    label = list(range(len(rows)))
    for i in range(len(rows)):  # the closure of all links, by brute force
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = defaultdict(list)
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x].append(i)
    expected = [(i, p - (1 << 64) * (p >> 63), min(least[x], default=None)) for (i, _), p, x in zip(rows, prints, label)]
    assert got(simhash.simhash_dedup(docs), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_anchors_lose_no_link(spark):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63, 1 << 31]
    for p in prints[:50]:
        for d in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in r.sample(range(64), d)))
    prints = sorted({p - (1 << 64) * (p >> 63) for p in prints})
    expected = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(x) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "f long"), "f").collect()} == expected


# --- 6 --------------------------------------------------------------------------------------------


def test_discriminant():
    """Scores are Bayes' rule with the regularised densities."""
    r = np.random.default_rng(0)
    d = 3
    x = [r.normal(size=(50, d)), r.normal(size=(80, d)) * 2 + 1]
    model = quality.model_of(np.array([50.0, 80.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.3, 0.1)
    cov = [np.cov(a.T, bias=True) for a in x]
    pooled = (50 * cov[0] + 80 * cov[1]) / 130
    log = []
    for k in (0, 1):
        s = 0.7 * cov[k] + 0.3 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-9 * np.eye(d)
        diff = x[1] - x[k].mean(0)
        log.append(np.log([51, 81][k] / 132) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", diff, np.linalg.inv(s), diff))
    assert np.allclose(model.scores(x[1]), 1 / (1 + np.exp(log[0] - log[1])))


def test_statistics_and_sums(spark, rows, docs):
    """Some statistics by their definitions, and the sums that executors add up against those of all rows at once."""
    text = "The cat. the dog, THE end!\nab 12\n\nab 12"
    x = dict(zip(quality.NAMES, quality.statistics(text)))
    share = lambda n, of: math.asin(math.sqrt(n / of))
    words = text.split()
    assert x["chars"] == math.log1p(len(text)) and x["words"] == math.log1p(10) and abs(x["digits"] - share(4, len(text))) < 1e-12
    assert abs(x["distinct_words"] - share(8, 10)) < 1e-12 and abs(x["distinct_lines"] - share(2, 3)) < 1e-12 and abs(x["upper"] - share(4, sum(c.isalpha() for c in text))) < 1e-12
    assert abs(x["short_words"] - share(sum(len(w) <= 3 for w in words), 10)) < 1e-12 and abs(x["capital_words"] - share(2, 10)) < 1e-12 and x["next_same"] == 0
    labels = spark.createDataFrame([(i, i % 3 % 2) for i, _ in rows if i is not None] + [(1, 7)], "doc_id long, quality int")
    measured = quality.measured(docs)
    model = quality.train(measured, labels)
    of = defaultdict(list)
    for i, t in rows:
        if i is not None:
            n = sum(1 for k, _ in rows if k == i)
            of[i % 3 % 2] += [quality.statistics(t)] * n
    own = [np.array(of[k]) for k in (0, 1)]
    expected = quality.model_of(np.array([len(a) for a in own], float), np.array([a.sum(axis=0) for a in own]), np.array([a.T @ a for a in own]))
    assert np.allclose(model.means, expected.means) and np.allclose(model.constants, expected.constants) and np.allclose(model.prior, expected.prior)
    some = np.array([quality.statistics(t) for _, t in rows])
    assert np.allclose(model.scores(some), expected.scores(some), atol=1e-6)


def test_quality_cases(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2, 0, 1) for k, (i, _) in enumerate(rows)] + [(9999, 1, 0, 1), (1, None, 0, 1), (None, 1, 0, 1), (4, 7, 0, 1)], "doc_id long, quality int, toxic int, x int")
    out = quality.classify(docs, labels)
    assert out.count() == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.collect())
    one = quality.classify(docs, labels.filter("quality = 1"))
    assert len({r["score"] for r in one.collect()}) == 1 and one.first()["score"] > 0.9
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = found.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert right / n >= 0.95


# --- 7 --------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n", "é" * 50_000, "<p>a</p>", "\r\n\r\n", "\x1f\x8b\x08"]
    rows = [(9 - k if k != 3 else None, f"https://e.com/{k} ü\r\n" if k else None, h, "x") for k, h in enumerate(html)]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string").repartition(3)
    first = defaultdict(list)
    for i, _, h, _ in rows:
        first[h or ""].append(i)
    expected = []
    for i, _, h, _ in rows:
        b, least = (h or "").encode(), min((x for x in first[h or ""] if x is not None), default=None)
        again = len(first[h or ""]) > 1 and i != least
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", least if again else None))
    assert got(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    # Payloads below the limit are all responses.
    assert {r[0] for r in got(warc.round_trip(pages, min_revisit_bytes=1_000_000), "record_type")} == {"response"}


def test_warc_of_awkward_pages(spark):
    """Headers of any length, payloads over an archive's size, many small archives, and every row when all rows of a group have no id."""
    rows = [(k, f"https://e.com/{'p' * (70_000 if k == 1 else 3)}{k}", "y" * (2_000_000 if k == 2 else 400) + str(k % 40)) for k in range(120)] + [(None, "u", "same"), (None, "v", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(new_path(spark, "archives"))
    found = warc.round_trip(pages, path, archive_bytes=5_000).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    assert sorted((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] is not None) == sorted((i, u, len(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, u, h in rows if i is not None)
    assert [r["record_type"] for r in found if r["page_id"] is None] == ["response"] * 2
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert len(sizes) > 10 and sorted(sizes)[-3] <= 5_000


def test_long_archives():
    """A thousand members, a file packed as a whole, and one that is sound but holds damage."""
    records = [warc.frame({"WARC-Type": "response", "X-Page-Id": str(k)}, b"x" * 500) for k in range(1000)]
    plain = b"".join(records)
    members = b"".join(warc.frame({"WARC-Type": "response", "X-Page-Id": str(k)}, b"x" * 500, True) for k in range(1000))
    whole = gzip.compress(plain)
    for data in (plain, members, whole):
        assert [x.headers["x-page-id"] for x in warc.salvage(data)] == [str(k) for k in range(1000)]
    damaged = gzip.compress(records[0] + b"junk" + records[1])
    found = [*warc.salvage(b"??" + damaged)]
    assert [(type(x).__name__, x.offset, getattr(x, "length", None)) for x in found] == [("Gap", 0, 2), ("Record", 2, None), ("Gap", 2, 4), ("Record", 2, None)] and "member" in found[2].reason


@pytest.mark.parametrize("compress", [False, True])
def test_salvage(compress):
    records = [warc.frame({"WARC-Type": "response", "X-Page-Id": str(k), "WARC-Block-Digest": f"sha1:{warc.payload_digest(b)}"}, b, compress) for k, b in enumerate((b"zero", b"one WARC/1.1\r\n", b"", b"three" * 99))]
    whole = b"".join(records)
    ids = lambda data: [x.headers.get("x-page-id", "1") for x in warc.salvage(data) if isinstance(x, warc.Record)]
    assert ids(whole) == ["0", "1", "2", "3"] and not any(isinstance(x, warc.Gap) for x in warc.salvage(whole))
    # Damage in any byte of the second record loses that record at most, and all bytes are accounted for.
    start, end = len(records[0]), len(records[0]) + len(records[1])
    for at in range(start, end):
        data = bytearray(whole)
        data[at] ^= 0x55
        found = [*warc.salvage(bytes(data))]
        assert [x for x in ids(bytes(data)) if x in ("0", "2", "3")] == ["0", "2", "3"]
        for gap in (x for x in found if isinstance(x, warc.Gap)):
            assert start <= gap.offset and gap.offset + gap.length <= end and gap.reason
    cut_short = [*warc.salvage(whole[:-3])]
    assert ids(whole[:-3]) == ["0", "1", "2"] and isinstance(cut_short[-1], warc.Gap) and cut_short[-1].offset + cut_short[-1].length == len(whole) - 3
    mixed = b"junk" + records[2] + b"\x1f\x8b\x08junk" + records[3]
    assert ids(mixed) == ["2", "3"] and [(g.offset, g.length) for g in warc.salvage(mixed) if isinstance(g, warc.Gap)] == [(0, 4), (4 + len(records[2]), 7)]
    assert [*warc.salvage(b"")] == []


def test_read_archives_logs_gaps(spark):
    record = warc.frame({"WARC-Type": "response"}, b"x")
    table = spark.createDataFrame([("p", b"??" + record), ("q", None)], "path string, content binary")
    assert got(warc.read_archives(table), "path", "offset", "length", "reason", "type") == sorted([("p", 0, 2, "no version line", None), ("p", 2, None, None, "response")], key=repr)


# --- 8 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [3, 13, 30])
def test_substring_dedup(docs, rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in words:
        out = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                out[k : k + window] = [True] * window
        expected.append((i, len(w), sum(out), hashlib.sha256(b" ".join(x for x, y in zip(w, out) if not y)).hexdigest()))
    found = substring.substring_dedup(docs, window=window, texts=True)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found.collect())
    assert substring.substring_dedup(docs.limit(0), window=window).count() == 0


def test_doubling():
    assert substring.lengths(13) == [7, 13] and substring.lengths(50) == [7, 13, 25, 50] and substring.lengths(5) == [5]
    h = substring.word_hashes([b"a", b"b", b"c", b"d"] * 5)
    for n in range(1, 21):
        w = substring.rolled(h, n, substring.B1)
        assert len(w) == 21 - n and len({*w.tolist()}) == min(4, 21 - n)
    assert len(substring.rolled(h, 21, substring.B1)) == 0


# --- 9 --------------------------------------------------------------------------------------------


def removed_lines(rows, num=4, den=5):
    lines, seen, out = [], [], set()
    for i, t in rows:
        if i is not None and t is not None:
            lines += [(i, k, frozenset(x for x in re.split(SPACE, line.lower()) if x)) for k, line in enumerate(t.split("\n"))]
    for i, k, s in sorted(lines, key=lambda x: x[:2]):
        if s and any((i, k) != (j, m) and len(s & o) * (num + den) >= num * (len(s) + len(o)) for j, m, o in seen):
            out.add((i, k))
        if s:
            seen.append((i, k, s))
    return out


def test_line_dedup(docs, rows):
    out = removed_lines(rows)
    expected = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for k, x in enumerate(lines) if i is None or (i, k) not in out]
        expected.append((i, "\n".join(left) if t is not None else None, len(lines), len(lines) - len(left), "g", "l"))
    found = linededup.dedup_lines(docs)
    assert got(found, "doc_id", "text", "n_lines", "n_removed", "gone", "lines") == sorted(expected, key=repr)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def carried(df):
    """Columns that the projections of the optimised plan put out."""
    return re.findall(r"(?:AS |, |\[)(ranks|_level\d+)#\d+", "\n".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in x))


def test_rows_never_carry_tables(spark, docs):
    """Bitsets and the rarity table reach lambdas as subqueries, not as columns of rows."""
    ranks = linededup.rarity(docs.select(linededup.plain(F.col("text")).alias("text")), buckets=1024)
    toks = linededup._tokenised(linededup._lines(docs, "doc_id", "text"), ranks, 1024)
    assert not carried(toks.select("id", F.xxhash64("toks"), F.size("toks"), "toks"))
    pages = spark.createDataFrame([(1, "https://example.org/es/1")], "page_id long, url string")
    found = urlfilter.url_filter(pages, spark.createDataFrame(queries.RULES, "host string, path string, verdict string"))
    assert not carried(found) and "scalar-subquery" in found._jdf.queryExecution().optimizedPlan().toString()


def test_line_dedup_of_random_lines(spark):
    """Many similar lines over few words, where all filters are tight; also other thresholds, and a rarity table with one bucket in use."""
    r = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"w{r.randrange(14)}" for _ in range(r.randrange(1, 12))) for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity, num, den in ((0.8, 4, 5), (0.5, 1, 2), (1.0, 1, 1)):
        found = linededup.removed_lines(docs, similarity=similarity, buckets=1024)
        assert {(x["id"], x["line"]) for x in found.collect()} == removed_lines(rows, num, den)


# --- 10 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dense", [0, 1 << 16])
def test_wand_finds_all_above_threshold(monkeypatch, dense):
    """The index's search against the scores of all items, with bounds in a plain array and without."""
    monkeypatch.setattr(decontam, "DENSE", dense)
    r = random.Random(4)
    text = lambda n: " ".join(f"t{int(r.paretovariate(0.6)) % 80}" for _ in range(n))
    items = [(i, text(r.randrange(3, 30)), text(3)) for i in range(90)]
    index = decontam.Index(items, block=4)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(60):
            own = [index.terms[w] for w in set(text(60).split()) if w in index.terms]
            scores = defaultdict(float)
            for t in own:
                for i, v in zip(*index.postings[t]):
                    scores[i] += v
            assert {i: round(s, 6) for i, s in index.search(own, threshold)} == {i: round(s, 6) for i, s in scores.items() if s >= threshold - 1e-9} if own else True


def test_parts():
    assert decontam.parts("Who did it? The cook.") == ("Who did it?", "The cook")
    assert decontam.parts("no sentence here") == ("no sentence here", "") and decontam.parts("One.") == ("One.", "") and decontam.parts("") == ("", "")


def test_decontamination(spark):
    r = random.Random(5)
    fill = lambda n: " ".join(f"z{r.randrange(5000)}" for _ in range(n))
    items = [(k, fill(20) + ". " + fill(8) + ".") for k in range(5)] + [(5, None), (6, " "), (7, "short one"), (None, fill(9))]
    whole = items[0][1]
    changed = " ".join(w if k != 3 else "other" for k, w in enumerate(items[2][1].split()))
    cases = {
        1: (whole, [0]), 2: (fill(777) + "\n" + whole.upper().replace(". ", " -- ") + fill(500), [0]), 3: (fill(200), []), 4: (items[1][1].split(". ")[0] + fill(50), []), 5: (changed, []),
        6: (None, []), 7: ("", []), 8: (items[3][1] + fill(20_000) + " " + items[4][1], [3, 4]), 9: (fill(3) + " Short, one! " + fill(3), [7]), 10: ("one short", []),
    }
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in cases.items()], "doc_id long, text string, found string").repartition(2)
    table = spark.createDataFrame(items, "item_id long, text string")
    out = {x["doc_id"]: x for x in decontam.decontaminate(docs, table).collect()}
    # Item 2's question lost 5 of its 16 shingles: below 80 %.
    assert {i: x["items"] for i, x in out.items()} == {i: e for i, (_, e) in cases.items()}
    assert all(x["contaminated"] == bool(x["items"]) == (x["best_score"] > 0.3) and x["found"] == "x" for x in out.values())
    assert not decontam.decontaminate(docs, table.limit(0)).filter("contaminated").count() and decontam.decontaminate(docs.limit(0), table).count() == 0
    answers = spark.createDataFrame([(0, "who are you", "nobody at all")], "item_id long, text string, answer string")
    two = spark.createDataFrame([(1, "Who are you? Nobody, at all."), (2, "who are you then")], "doc_id long, text string")
    assert got(decontam.decontaminate(two, answers, answer_col="answer"), "doc_id", "contaminated") == [(1, True), (2, False)]


def test_cut_copies_are_found(spark):
    """A copy without the last word, with another one, or without a short last sentence is one; a copy of less than 80 % isn't."""
    head = " ".join(f"q{k}" for k in range(40))
    table = spark.createDataFrame([(0, f"{head}. Yes."), (1, f"What is it? {head.replace('q', 'r')}.")], "item_id long, text string")
    texts = [f"x {head} y", f"{head}. No.", f"{head}. Yes", " ".join(head.split()[:33]), head.replace("q", "r"), "What is it? Yes."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(decontam.decontaminate(docs, table), "doc_id", "items") == [(0, [0]), (1, [0]), (2, [0]), (3, []), (4, [1]), (5, [])]
    split = table.select("item_id", F.lit(head).alias("text"), F.lit("Yes").alias("answer")).filter("item_id = 0")
    assert got(decontam.decontaminate(docs, split, answer_col="answer"), "doc_id", "items") == [(0, []), (1, []), (2, [0]), (3, []), (4, []), (5, [])]


def held_items(text, items, overlap=0.8):
    """Items whose longer part and whole text, or question and answer, the text's passages cover, by brute force over all windows."""
    words = decontam.words_of(text)
    out = []
    for i, t in items:
        if i is None or not decontam.words_of(t):
            continue
        q, a = (decontam.shingles(decontam.words_of(x)) for x in decontam.parts(t))
        whole = decontam.shingles(decontam.words_of(" ".join(decontam.parts(t))))
        longest = max(len(decontam.words_of(x)) for _, x in items)
        step = longest

        def share(part, own):
            n = len(next(iter(part)))
            return len(part & decontam.shingles(own, n)) / len(part) if own else 0

        for at in range(0, max(1, len(words)), step):
            own = words[at : at + 2 * step]
            if own and (all(share(x, own) >= overlap for x in (q, a) if x) or all(share(x, own) >= overlap for x in (max(q, a, key=len), whole))):
                out.append(i)
                break
    return sorted(out)


def test_retrieval_misses_no_overlap(spark):
    """Edited copies of items with a common stem and rare words, against brute force over all items and passages; also by parts."""
    r = random.Random(8)
    stem = [f"stem{k}" for k in range(20)]
    items = [(i, " ".join([*stem, *(f"rare{i}x{k}" for k in range(4))])) for i in range(25)] + [(100 + i, " ".join(f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randrange(6, 40))) + ".") for i in range(25)]
    texts = [" ".join(stem)]
    for _, t in items:
        w = t.split()
        for k in (1, 3):
            copy = list(w)
            for _ in range(k):
                copy[r.choice([0, len(copy) - 1, r.randrange(len(copy))])] = "changed"
            texts.append(" ".join(["before"] * r.randrange(60) + copy + ["after"] * r.randrange(60)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = [(i, held_items(t, items)) for i, t in enumerate(texts)]
    assert any(len(x) >= 25 for _, x in expected)
    index = decontam.Index(sorted((i, *decontam.parts(t)) for i, t in items), split=True)
    assert [(i, sorted(index.hits(t))) for i, t in enumerate(texts)] == expected
    many = {i: x for i, x in got(decontam.decontaminate(docs, table, max_chars=2000), "doc_id", "items")}
    # Parts have passages of their own lengths, so that they may find an item in one that brute force parts otherwise.
    assert all(set(x) <= set(many[i]) for i, x in expected) and sum(map(len, many.values())) <= 1.1 * sum(len(x) for _, x in expected)


def test_decontamination_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 0, 0, 0, 0)], "doc_id long, text string, Items int, BEST_SCORE int, `a.b` int, found int")
    out = decontam.decontaminate(docs, spark.createDataFrame([(3, "one two three four five six")], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "a.b", "found", "contaminated", "items", "best_score"] and out.first()["items"] == [3]


def test_crc_is_unsigned():
    assert zlib.crc32(b"") == 0 and all(0 <= zlib.crc32(bytes([k])) < 1 << 32 for k in range(256))
