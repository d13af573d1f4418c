"""Line deduplication by an exact set-similarity join, in SQL functions only.

A line's tokens are its different words. All lines order tokens by one global rule, the rarest
first, so that lines with a Jaccard similarity of at least t share a token in their first
n - ceil(t n) + 1 (prefix filter). A common token is in ever more lines as the corpus grows, so from HEAVY
words of its bucket on, a token is a key only together with the one that follows it in the line's order: see
_reach(). A word that occurs once in all documents is no key: no other line can have it. Pairs are then pruned by
size (length filter), by how many tokens
can still be shared behind the matching positions (positional filter), and by a 128-bit parity
signature, which bounds the symmetric difference; what is left is verified on the words themselves.
A pair with many keys in common makes a row where a run of them starts, not for each.

Rarity is looked up in a table of fixed size: the logarithm of the number of words of all documents
that fall into the token's bucket. Any order gives right results; a coarse one costs some candidates.

A line goes if any earlier line is similar to it. So it is enough to find one. Of lines with the same
text only the first goes on; the others go. Each is then held against the first line that has one of its
pivots too, the first PIVOTS pairs of neighbours among its keys: in large groups of near copies that settles almost
all, with a few pairs for each. Only the others take part in the join as the later line of a pair, and of
their candidates the one with the nearest signature is verified first: lines that it settles need no other.

Tables that grow with the corpus are joined by sorting, never broadcast.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import SPACES, col, cut, drop_cut, free_names, others

BUCKETS = 1 << 18  # of the rarity table: 2 MB
FILTER_BITS = 1 << 26
SIMILARITY = 0.8
HASH_BITS = 56  # of a token; its rank of commonness stands above them
HEAVY = 512  # words of a bucket from which on its tokens are keys in pairs only
SPLIT = 1 << 14  # a bucket with this part of all words or more has its tokens in the other half of a line's signature
PIVOTS = 8
END = 0  # stands for what follows the last token


def plain(text: Column) -> Column:
    """The text in lower case, with a blank for all white space but line feeds."""
    text = F.lower(text)
    for c in SPACES.replace(" ", "").replace("\n", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs, words that share 32 bits of hash together. docs: texts that are plain(). A written table."""
    words = docs.select(F.explode(F.split(F.replace(col(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    return cut(words.select(_word(F.shiftrightunsigned(F.xxhash64("w"), 64 - HASH_BITS)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def rarity(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, counts: DataFrame | None = None) -> DataFrame:
    """One row, one column, ranks: array<long> with the rank of commonness of each bucket's words, in a token's top byte.

    docs: texts that are plain(); buckets: a power of two, at least 1024; counts: their word_counts(), where they are there.
    """
    counts = word_counts(docs, text_col) if counts is None else counts
    counts = counts.groupBy(_bucket("word", buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    blank = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    full = counts.union(blank).groupBy("bucket").agg(F.sum("n").alias("n"))
    rank = F.shiftleft(_commonness(F.col("n")), HASH_BITS).alias("rank")
    rows = full.select(F.shiftright("bucket", 10).alias("hi"), F.struct("bucket", rank).alias("x"))
    inner = rows.groupBy("hi").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["rank"]).alias("ranks"))
    return cut(inner.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hi", "ranks"))), lambda x: x["ranks"])).alias("ranks")), "rarity")


def _commonness(words: Column) -> Column:
    return F.least(F.floor(F.log2(words + 1.0) * 3), F.lit(120)).cast("long")


def _word(token: Column) -> Column:
    """The 32 bits of a token's hash by which words are counted, and that are the key where a token is one alone."""
    return F.shiftright(F.call_function("shiftleft", token, F.lit(32)), 32).cast("int")


def _bucket(word: Column | str, buckets: int) -> Column:
    return (F.col(word) if isinstance(word, str) else word).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text) of lines that aren't blank, the text being plain()."""
    rows = docs.filter(col(id_col).isNotNull())
    return rows.select(col(id_col).alias("id"), F.posexplode(F.split(plain(col(text_col)), "\n")).alias("line", "text")).filter(F.ltrim("text") != "")


def _tokenised(lines: DataFrame, ranks: DataFrame, buckets: int) -> DataFrame:
    """lines with toks: the different tokens, the rarest first (rank of commonness in the top byte, hash below)."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))

    def packed(h: Column) -> Column:
        token = F.shiftrightunsigned(h, 64 - HASH_BITS)
        return F.coalesce(F.get(F.col("ranks"), _bucket(token, buckets)), F.lit(0).cast("long")).bitwiseOR(token)

    # A lambda can't hold a subquery, but a column. All that toks is made of is used once, so the optimiser
    # makes one projection of it, with the subquery in the lambda, and rows never carry the table.
    return lines.withColumn("ranks", ranks.scalar()).withColumn("toks", F.sort_array(F.transform(hashes, packed))).drop("ranks", "text")


def _reach(n: Column, light: Column, t: Fraction) -> tuple[Column, Column]:
    """How many of a line's keys it has as the longer and as the shorter of a similar pair; a key stands at each token.

    n: its tokens; light: those under HEAVY, which stand first. Let the lines x and y share o tokens, A being what x
    has besides at most. If the first shared token is light, at most A tokens of x stand before it: A + 1 keys will do.
    Else none of x's light tokens is shared. Of the o gaps behind shared tokens (the last one up to the end), fewer have
    another token of x or y in them, as t > 1/2 and so o > n_x + n_y - 2 o. So there is a first gap without, and the pair of
    tokens around it is a key of both. In front of it each gap has one of a heavy tokens of x or b of y that aren't shared, so it
    stands at light + 2 a + b at most, with a <= n_x - o - light and b <= n_y - o: at 2 n_x + n_y - 3 o - light. With
    o >= t (n_x + n_y) / (1 + t), this is greatest where n_y is least or most, which is how the numbers below come about.
    """
    share = lambda least, most: F.when(light > n - least, n - least + 1).otherwise(F.least(n, F.floor(n * most.numerator / F.lit(most.denominator)).cast("int") - light + 1))
    least = lambda f: F.ceil(n * f.numerator / F.lit(f.denominator)).cast("int")
    even = 3 * (1 - t) / (1 + t)
    return share(least(t), max(2 * (1 - t), even)), share(least(2 * t / (1 + t)), max((1 - t) / t, even))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, buckets: int = BUCKETS, filter_bits: int = FILTER_BITS, heavy: int = HEAVY) -> DataFrame:
    """(id, line) of every line that goes, perhaps more than once: see dedup_lines(). A written table."""
    t = Fraction(str(similarity))
    num, den = t.numerator, t.denominator
    key, pair = F.struct("id", "line"), ["x_id", "x_line", "y_id", "y_line"]
    at_line = lambda bits: F.pmod(F.xxhash64("id", "line"), F.lit(bits))
    least_overlap = lambda a, b: F.ceil((a + b) * num / F.lit(num + den))

    # Lines with the same text: all but the first go, and take no further part.
    every = _lines(docs, id_col, text_col)
    hashes = cut(every.select("id", "line", F.xxhash64("text").alias("h"), F.hash("text").alias("h2")), "hashes")
    groups = hashes.groupBy("h", "h2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "h2", "first")
    copies = cut(hashes.join(groups.hint("merge"), ["h", "h2"]).filter(key > F.col("first")).select("id", "line"), "copies")
    gone = [copies]
    # Bitsets tell them without a join: what is in the first and not in the second is a copy. Some copies may stay, no other line goes.
    bits = bitset.fitting(copies, filter_bits)
    first = bitset.build(copies, at_line(bits), bits)
    mistaken = hashes.select("id", "line").filter(bitset.has(first, at_line(bits))).join(copies, ["id", "line"], "left_anti")
    second = bitset.build(mistaken, at_line(bits), bits)
    different = every.filter(~bitset.has(first, at_line(bits)) | bitset.has(second, at_line(bits)))

    n = F.size("toks")
    counts = word_counts(docs.select(plain(col(text_col)).alias("text")))
    ranks = rarity(docs, "text", buckets, counts)
    split = (counts.agg(F.sum("n")).first()[0] or 0) // SPLIT
    again = counts.filter("n > 1")
    word_bits = bitset.fitting(again, filter_bits)
    at_word = lambda x: F.pmod(x.cast("long"), F.lit(word_bits))
    repeated = bitset.build(again, at_word(F.col("word")), word_bits)
    bit = lambda x: F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parity = lambda toks: F.aggregate(toks, none, lambda a, x: a.bitwiseXOR(bit(x)))
    # How many tokens are rarer than that, without a lambda: the place among them of a token that would be the first of the others.
    under = lambda words: (F.array_position(F.sort_array(F.array_append("toks", limit := F.shiftleft(_commonness(F.lit(words)), HASH_BITS))), limit) - 1).cast("int")
    # Each token is looked at once for the signature: rarer ones have their parities in `rare`, the others in `rest`.
    signature = parity(F.slice("toks", 1, F.col("rarer"))).alias("rare"), parity(F.slice("toks", F.col("rarer") + 1, n)).alias("rest")
    # Keys are of 32 bits: what that confuses are a few more candidates.
    light = under(heavy) if 2 * t > 1 else n
    follows = lambda i: F.coalesce(F.get("toks", i + 1), F.lit(END).cast("long"))
    key_at = lambda x, i: F.when(i < F.col("light"), _word(x)).otherwise(F.hash(x, follows(i)))
    prefix = F.transform(F.slice("toks", 1, _reach(n, F.col("light"), t)[0]), key_at)
    rows = _tokenised(different, ranks, buckets).withColumns({"light": light, "rarer": under(split)})
    payload = ["id", "line", "n", "light", "rare", "rest"]
    rows = rows.select("id", "line", n.alias("n"), "light", *signature, prefix.alias("prefix")).withColumn("repeated", repeated.scalar())
    # Null where a token is no key. As in _tokenised(), the subquery ends up in the lambda.
    shared = F.transform("prefix", lambda k, i: F.when((i >= F.col("light")) | bitset.has(F.col("repeated"), at_word(k)), k))
    lines = cut(rows.select(*payload, shared.alias("prefix")), "lines").filter("n > 0")
    for old in (hashes, counts, ranks, repeated, first, second):
        drop_cut(old)

    def apart(x: str, y: str) -> Column:
        """Bits in which the signatures differ: not more than tokens that only one has."""
        rare, rest = (F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in ("rare", "rest"))
        return rare + rest

    def fits(x: str, y: str, nx: Column, ny: Column) -> Column:
        """Length filter and parity signature."""
        return (nx * num <= ny * den) & (ny * num <= nx * den) & (apart(x, y) <= nx + ny - 2 * least_overlap(nx, ny))

    def verified(pairs: DataFrame) -> DataFrame:
        """(id, line) of the later lines of those pairs that really are similar, by their words."""
        wanted = cut(pairs.select(F.col("x_id").alias("id"), F.col("x_line").alias("line")).union(pairs.select("y_id", "y_line")).distinct(), "wanted")
        bits = bitset.fitting(wanted, filter_bits)
        at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
        chosen, exact = bitset.build(wanted, at(F.col("id")), bits), bitset.build(wanted, at_line(bits), bits)
        texts = _lines(docs.filter(bitset.has(chosen, at(col(id_col)))), id_col, text_col).filter(bitset.has(exact, at_line(bits))).join(wanted, ["id", "line"], "left_semi")
        words = cut(texts.select("id", "line", F.array_remove(F.array_distinct(F.split("text", " ")), "").alias("words")), "words")
        x, y = (words.select(F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line"), F.col("words").alias(f"{s}_words")) for s in "xy")
        both = pairs.join(x.hint("merge"), ["x_id", "x_line"]).join(y.hint("merge"), ["y_id", "y_line"])
        common = F.size(F.array_intersect("x_words", "y_words"))
        true = common * (num + den) >= (F.size("x_words") + F.size("y_words")) * num
        later = cut(both.filter(true).select(F.col("x_id").alias("id"), F.col("x_line").alias("line")).distinct(), "later")
        for old in (wanted, chosen, exact, words):
            drop_cut(old)
        return later

    # First the first line with one of the same pivots. Only lines that share one take part in the join.
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "line", "n", "rare", "rest")]
    pivots = F.array(*(F.xxhash64(F.get("keys", F.lit(i)), F.coalesce(F.get("keys", F.lit(i + 1)), F.lit(END))) for i in range(PIVOTS)))
    ends = lines.withColumn("keys", F.array_compact("prefix")).select(F.explode(F.slice(pivots, 1, F.size("keys"))).alias("end"), "id", "line", "n", "rare", "rest")
    least = cut(ends.groupBy("end").agg(F.min("id").alias("earliest"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("end", "earliest"), "least")
    bits = bitset.fitting(least, filter_bits)
    at_end = lambda bits: F.pmod(F.xxhash64("end"), F.lit(bits))
    shared = bitset.build(least, at_end(bits), bits)
    held = cut(ends.filter(bitset.has(shared, at_end(bits))).join(least.hint("merge"), "end"), "ends")
    firsts = held.filter("id = earliest").groupBy("end").agg(F.min(F.struct("line", "id", "n", "rare", "rest")).alias("y")).select("end", "y.*").select("end", *side("y"))
    pairs = held.select("end", *side("x")).join(firsts.hint("merge"), "end").filter((F.struct("x_id", "x_line") > F.struct("y_id", "y_line")) & fits("x_", "y_", F.col("x_n"), F.col("y_n")))
    pairs = cut(pairs.select(pair).distinct(), "pairs")
    settled = verified(pairs)
    gone.append(settled)
    for old in (least, shared, held, pairs):
        drop_cut(old)

    # Then all prefixes, for t as the longer line of a pair and for 2 t / (1 + t) of its tokens as the shorter one.
    # The later of the two must not be settled yet.
    bits = bitset.fitting(settled, filter_bits)
    chosen = bitset.build(settled, at_line(bits), bits)
    maybe = lines.filter(bitset.has(chosen, at_line(bits))).join(settled.withColumn("settled", F.lit(1)), ["id", "line"], "left")
    flagged = lines.filter(~bitset.has(chosen, at_line(bits))).select(*payload, "prefix", F.lit(0).alias("settled")).union(maybe.select(*payload, "prefix", F.coalesce("settled", F.lit(0))))

    def entries(s: str, tokens: Column) -> DataFrame:
        """A row per key, with the key before; n, the key's place and the marks of tokens alone and of settled lines share a column."""
        rows = flagged.select(*payload, "settled", "prefix", F.posexplode(tokens).alias("at", "tok")).filter("tok is not null")
        back = F.when(F.col("at") > 0, F.get("prefix", F.col("at") - 1)).alias(f"{s}_back")
        marks = F.col("settled") + F.when(F.col("at") < F.col("light"), F.lit(2)).otherwise(F.lit(0))
        packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft("at", 2).cast("long")).bitwiseOR(marks.cast("long"))
        return rows.select("tok", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "line", "rare", "rest")], back, packed.alias(f"{s}_x"))

    longer = entries("l", F.col("prefix"))
    shorter = entries("s", F.slice("prefix", 1, _reach(F.col("n"), F.col("light"), t)[1]))
    place = lambda s: F.shiftright(F.col(f"{s}_x").bitwiseAND(F.lit((1 << 32) - 1)), 2)
    nl, ns, al, as_ = F.shiftright("l_x", 32), F.shiftright("s_x", 32), place("l"), place("s")
    alone = F.col("l_x").bitwiseAND(F.col("s_x")).bitwiseAND(F.lit(2)) != 0
    # Places count from 0: tokens before the match, and the match and what follows. If the first shared token is a key alone, none
    # before it is shared, and that pair of places must do. Where the keys before are the same, the pair has a row there or yet further
    # in front, with the same filters passed: the sum is the same there.
    before_it = F.when(alone, F.lit(0)).otherwise(F.least(al, as_))
    positional = before_it + F.least(nl - al, ns - as_) >= least_overlap(nl, ns)
    starts = ~F.coalesce(F.col("l_back") == F.col("s_back"), F.lit(False))
    l_key, s_key = F.struct("l_id", "l_line"), F.struct("s_id", "s_line")
    useful = F.when(s_key < l_key, F.col("l_x")).otherwise(F.col("s_x")).bitwiseAND(F.lit(1)) == 0
    found = longer.join(shorter.hint("merge"), "tok").filter((nl >= ns) & fits("l_", "s_", nl, ns) & starts & positional & useful & (l_key != s_key))
    later = lambda c: F.when(s_key < l_key, F.col(f"l_{c}")).otherwise(F.col(f"s_{c}"))
    before = lambda c: F.when(s_key < l_key, F.col(f"s_{c}")).otherwise(F.col(f"l_{c}"))
    found = found.select(later("id").alias("x_id"), later("line").alias("x_line"), before("id").alias("y_id"), before("line").alias("y_line"), apart("l_", "s_").alias("apart"))
    found = cut(found.groupBy(pair).agg(F.min("apart").alias("apart")), "candidates")
    for old in (lines, chosen):
        drop_cut(old)
    nearest = found.groupBy("x_id", "x_line").agg(F.min(F.struct("apart", "y_id", "y_line")).alias("y"))
    nearest = cut(nearest.select("x_id", "x_line", F.col("y.y_id").alias("y_id"), F.col("y.y_line").alias("y_line")), "pairs")
    gone.append(verified(nearest))
    left = found.join(gone[-1].toDF("x_id", "x_line"), ["x_id", "x_line"], "left_anti").join(nearest, pair, "left_anti")
    left = cut(left.select(pair), "pairs")
    gone.append(verified(left))
    out = cut(reduce(DataFrame.union, gone), "removed")
    for old in (found, nearest, left, *gone):
        drop_cut(old)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, names: tuple[str, str] = ("n_lines", "n_removed"), **options: int) -> DataFrame:
    """docs with text_col less its removed lines, and two more columns, by default n_lines and n_removed (long).

    Lines are separated by line feeds; a line's tokens are its different words (runs without ASCII
    white space, in lower case). A line is removed if an earlier one, by (id, number in its text),
    has a Jaccard similarity of at least `similarity` to it; lines are judged on the input, whether
    or not the earlier line is removed too. Lines without tokens stay. Lines with different words are
    compared by the words; lines with the same text are told by 96 bits of hash.

    Nulls: a null text stays null and has no lines; rows with a null id stay as they are and remove
    nothing. Rows that share an id are one document: a line number is removed in all of them if in
    one, so repeated rows don't remove each other's lines. Empty tables give no rows. Columns of docs
    with the new ones' names, in any letter case, are replaced, other ones kept.
    """
    filter_bits = options.get("filter_bits", FILTER_BITS)
    lines = removed_lines(docs, id_col, text_col, similarity, **options)
    # By document, for those that lose a line: which numbers go.
    gone = cut(lines.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    drop_cut(lines)
    bits = bitset.fitting(gone, filter_bits)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    chosen = bitset.build(gone, at(F.col("id")), bits)
    kept = others(docs, *names)
    key, text, lost, split, edges, left = free_names(docs, "key_", "text_", "gone_", "lines_", "edges_", "left_")
    base = docs.select(*map(col, kept), col(id_col).alias(key), col(text_col).alias(text))
    # Only documents that may lose a line take part in the join.
    maybe = F.coalesce(bitset.has(chosen, at(F.col(key))), F.lit(False))
    gone = gone.select(F.col("id").alias(key), F.col("gone").alias(lost))
    hit = base.filter(maybe).join(gone.hint("merge"), key, "left").select(*map(col, kept), text, lost)
    rest = base.filter(~maybe)

    def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
        """df with a column that is computed once: the optimiser doesn't move it from a generator to where it is used, again and again."""
        return df.select("*", F.explode_outer(F.array(value)).alias(name))

    hit = settle(hit, split, F.split(text, "\n"))
    # What stays lies between removed lines: two neighbours in `edges` bound a slice each.
    size = F.size(split)
    bounds = F.concat(F.array(F.lit(-1)), F.filter(lost, lambda i: i < F.size(split)), F.array(size))
    hit = settle(hit, edges, F.when(F.col(lost).isNotNull() & F.col(text).isNotNull(), bounds))
    edge = lambda i: F.get(F.col(edges), i)
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(F.col(split), edge(i - 1) + 2, edge(i) - edge(i - 1) - 1))
    loses = F.col(edges).isNotNull()
    hit = settle(hit, left, F.when(loses, F.array_join(F.flatten(between), "\n")).otherwise(F.col(text)))
    n_removed = F.when(loses, F.size(edges) - 2).otherwise(F.lit(0)).cast("long")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1, F.lit(0)).cast("long")

    def columns(of: str, n_removed: Column) -> list[Column]:
        return [*(F.col(of).alias(c) if c.lower() == text_col.lower() else col(c) for c in kept), n_lines.alias(names[0]), n_removed.alias(names[1])]

    return hit.select(columns(left, n_removed)).union(rest.select(columns(text, F.lit(0).cast("long"))))
