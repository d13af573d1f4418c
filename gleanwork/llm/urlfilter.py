"""URL filters: exact membership in rule lists by a cascade of Bloom filters.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that are not listed but pass
level 0, level 2 the listed keys that pass level 1, and so on until no key passes wrongly. A key of
the corpus is listed exactly if the first level that refuses it is odd, or, if none refuses it, the
last level is even. Level 0's false-positive rate is chosen so that level 1 is no larger than the
list; all later levels shrink geometrically. So the cascade's size is bounded by the list and the
logarithm of the number of the corpus's keys; a list too long for that is taken in parts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import LOWER, UPPER, cut

LIST_BITS = bitset.MAX_BITS // 2  # 64 MB, for about 20 million rules at once; longer lists are taken in parts


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    bits: DataFrame
    size: int
    hashes: int


def _probe(key: Column, level: int, i: int, size: int) -> Column:
    """The i-th position of a key, with a hash function of the level's own."""
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(size))


def _build(keys: DataFrame, level: int, count: int, rate: float) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    size = bitset.checked_bits(max(1, math.ceil(count * -math.log2(rate) / math.log(2))))
    at = keys.select(F.explode(F.array(*[_probe(F.col("key"), level, i, size) for i in range(hashes)])).alias("at"))
    return Level(bitset.build(at, F.col("at"), size), size, hashes)


def _passes(level: Level, number: int, key: Column, blocks: Column | None = None) -> Column:
    """Whether the level has the key. blocks: a column with its bitset, for use in a lambda."""
    if blocks is not None:
        return F.forall(F.array(*[_probe(key, number, i, level.size) for i in range(level.hashes)]), lambda at: bitset.has(blocks, at))
    ok = F.lit(True)
    for i in range(level.hashes):
        ok = ok & bitset.has(level.bits, _probe(key, number, i, level.size))
    return ok


def _rate(n: int, universe: DataFrame) -> float:
    """Level 0's false-positive rate for n listed keys."""
    others = max(1, universe.select(F.approx_count_distinct("key", 0.02)).first()[0])
    return min(0.5, n * math.sqrt(0.5) / others)


def parts_of(listed: DataFrame, universe: DataFrame, most_bits: int) -> int:
    """In how many parts, by the keys' hash, a list must be taken for its level 0 to have at most about so many bits."""
    n = listed.count()
    return max(1, math.ceil(n * -math.log2(_rate(n, universe)) / math.log(2) / most_bits)) if n else 1


class Cascade:
    """Exact membership of the keys of `universe` in those of `listed` (each one column, key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        listed = cut(listed.filter("key IS NOT NULL").distinct(), "listed")
        n = listed.count()
        self.levels: list[Level] = []
        if not n:
            return
        self.levels.append(_build(listed, 0, n, _rate(n, universe)))
        # Of the corpus's keys that pass level 0, the listed ones are told apart by an aggregation, without a join.
        passing = universe.filter("key IS NOT NULL").filter(_passes(self.levels[0], 0, F.col("key"))).distinct()
        marked = listed.select("key", F.lit(1).alias("in_list")).union(passing.select("key", F.lit(0)))
        rest = cut(marked.groupBy("key").agg(F.max("in_list").alias("in_list")), "passing")
        # Each level halves what passes wrongly, by a hash function of its own, so that levels end.
        for number in count(1):
            side = rest.filter(F.col("in_list") == (number + 1) % 2).select("key")
            keys = side.count()
            if not keys:
                return
            self.levels.append(_build(side, number, keys, 0.5))
            # What this level does not refuse and should: the other side's keys that pass it.
            stays = (F.col("in_list") == (number + 1) % 2) | _passes(self.levels[-1], number, F.col("key"))
            rest = cut(rest.filter(stays), "passing")

    def columns(self, name: str) -> dict[str, Column]:
        """The levels' bitsets as columns, which a lambda can use where it can't hold a subquery."""
        return {f"{name}{number}": level.bits.scalar() for number, level in enumerate(self.levels)}

    def has(self, key: Column, name: str | None = None) -> Column:
        """Whether the key is listed; name: that of columns() of the same rows."""
        out = F.lit(bool(len(self.levels) % 2))
        for number, level in reversed([*enumerate(self.levels)]):
            blocks = F.col(f"{name}{number}") if name else None
            out = F.when(_passes(level, number, key, blocks), out).otherwise(F.lit(bool(number % 2)))
        return out & key.isNotNull()


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bits: int = LIST_BITS) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    rules has columns host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest fitting rule (host and path
    together; of equally long ones, that with the longer host) decides. rule is its host and path.
    Where none fits, rule is null and the verdict is `default`: a url that no list holds passes.

    A url's candidates are its host's suffixes with its path's prefixes, of the lengths that the
    rules have; all candidates of the corpus are the cascade's key universe. Two cascades, of all
    rules and of the blocking ones, then tell the longest listed candidate and its verdict without a
    join. Lists whose level 0 would have over most_bits bits are taken in parts, one pass each. The only things collected are the distinct lengths of the rules' paths.

    Nulls: a null url, or one without ://, has an empty host and path, which no rule fits. Rules with
    a null or empty host never fit, a null path is empty; if a rule occurs with both verdicts, block
    wins. Repeated rows give repeated results; empty tables of pages or rules are fine. Other columns
    of either table are ignored.
    """
    rules = cut(
        rules.filter("host <> ''").select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("block")),
        "rules",
    )
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Suffixes that start at the host's beginning or behind a dot.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.length(F.concat(s, p)).alias("n"), F.length(s).alias("h"), F.concat(s, p).alias("key")))))
    candidates = F.when(F.col("host") != "", F.reverse(F.sort_array(pairs)))
    universe = urls.select(F.explode(candidates).alias("c")).select("c.key")
    parts = parts_of(rules.select("key").distinct(), universe, most_bits)
    mine = lambda key, part: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)) == part if parts > 1 else F.lit(True)
    # Longest first: the first listed candidate is the rule, or the longest of those that the parts have.
    # Candidates and bitset columns are used once each, so the optimiser makes one projection of these
    # three, with the subqueries in the lambda, and rows never carry a bitset.
    found = urls
    for part in range(parts):
        listed = Cascade(rules.select("key").filter(mine(F.col("key"), part)), universe.filter(mine(F.col("key"), part)))
        rows = found.withColumn("candidates", candidates).withColumns(listed.columns("_level"))
        hit = F.get(F.filter("candidates", lambda c: mine(c["key"], part) & listed.has(c["key"], "_level")), F.lit(0))  # noqa: B023
        if parts == 1:
            found = rows.select("id", "host", "path", hit["key"].alias("rule"))
        else:  # a table between parts: a task then holds the bitsets of one
            found = cut(rows.select("id", "host", "path", (F.greatest("best", hit) if part else hit).alias("best")), "part")
    if parts > 1:
        found = found.select("id", "host", "path", F.col("best")["key"].alias("rule"))
    blocks = F.lit(False)
    for part in range(parts):
        blocked = Cascade(rules.filter("block").select("key").filter(mine(F.col("key"), part)), universe.filter(mine(F.col("key"), part)))
        one = mine(F.col("rule"), part) & blocked.has(F.col("rule"))
        if parts == 1:
            blocks = one
        else:
            found = cut(found.withColumn("blocks", F.coalesce(one, F.lit(False)) | (F.col("blocks") if part else F.lit(False))), "part")
            blocks = F.col("blocks")
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocks, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
